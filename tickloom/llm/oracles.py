"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

import re

from tickloom.llm.common import LOWER, UPPER
from tickloom.llm.url_filters import CONTRACT_RULES, DEFAULT_PATTERNS


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _condition(host: str, path: str) -> str:
    """One of the method's patterns as a condition on host and path."""
    part = lambda s, any_: re.escape(s).replace(r"\*", any_)
    h = rf"^(.*\.)?{part(host, '.*')}$" if host else "^.*$"
    return f"(regexp_matches(host, {_quoted('(?s)' + h)}) AND regexp_matches(path, {_quoted('(?s)^' + part(path, '.*'))}))"


def url_filters() -> str:
    own = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in CONTRACT_RULES)
    patterns = sorted(DEFAULT_PATTERNS, key=lambda r: -len(r[0] + r[1]))
    method = " ".join(f"WHEN {_condition(h, p)} THEN {_quoted(h + p)}" for h, p, _ in patterns)
    return f"""
WITH rules(h, p, v) AS (VALUES {own}),
cut AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM split, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
judged AS (SELECT page_id, host, path, rule, v, CASE WHEN rule IS NULL THEN CASE {method} END END AS method_rule FROM split LEFT JOIN fit USING (k))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN method_rule IS NOT NULL OR host = '' THEN 'block' ELSE 'allow' END AS verdict, method_rule FROM judged"""


WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE x = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m USING (vec_id)"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
windows AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (g) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_PLAIN = r"regexp_extract_all(translate(coalesce({text}, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 byte by byte over the hexadecimal digits of a word's UTF-8 bytes.
RESAMPLING = rf"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
own AS (SELECT doc_id, {_PLAIN.format(text="text")} AS ws FROM documents),
wanted AS (SELECT {_PLAIN.format(text="text")} AS ws FROM benchmark),
words AS (SELECT word, hex(word) AS x FROM (SELECT unnest(ws) AS word FROM own UNION SELECT unnest(ws) FROM wanted)),
bytes AS (SELECT word, list_transform(range(1, len(x), 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1) AS b FROM words),
bucket AS (SELECT word, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS k FROM bytes, crc),
s AS (SELECT k, count(*) AS n FROM (SELECT unnest(ws) AS word FROM own) JOIN bucket USING (word) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM (SELECT unnest(ws) AS word FROM wanted) JOIN bucket USING (word) GROUP BY k),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gain AS (SELECT k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM (SELECT range AS k FROM range(10000)) LEFT JOIN s USING (k) LEFT JOIN t USING (k), totals),
weighed AS (SELECT doc_id, sum(g) AS weight FROM (SELECT doc_id, unnest(ws) AS word FROM own) JOIN bucket USING (word) JOIN gain USING (k) GROUP BY doc_id),
h AS (SELECT doc_id, ws, sha256('2024:' || doc_id)[1:8] AS x FROM own),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || x)::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM h LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


def clustering(rounds: int = 10) -> str:
    """Rounds of assignment and exact means, one after the other."""
    assigned = lambda r: f"""a{r} AS (SELECT vec_id, arg_min(c, d * 100 + c) AS cluster, min(d) AS distance FROM (SELECT vec_id, c, list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM ok, c{r}) GROUP BY vec_id)"""
    moved = lambda r: f"""m{r} AS (SELECT cluster, list(s ORDER BY i) AS m FROM (SELECT cluster, i, CASE WHEN sum(v) < 0 THEN -((-sum(v) + count(*) - 1) // count(*)) ELSE sum(v) // count(*) END::BIGINT AS s FROM (SELECT cluster, unnest(e) AS v, unnest(range(64)) AS i FROM ok JOIN a{r} USING (vec_id)) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN m{r} n ON n.cluster = o.c)"""  # noqa: E731
    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
WITH ok AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, e AS m FROM ok ORDER BY sha256('3:' || vec_id) LIMIT 8),
{steps},
{assigned(rounds)},
shas AS (SELECT c AS cluster, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM c{rounds}),
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(distance) FROM a{rounds})::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN shas USING (cluster) JOIN sums USING (cluster)"""


ORACLES = {
    "op1_url_filters": url_filters(), "op3_minhash_dedup": MINHASH, "op4_embedding_dedup": EMBEDDINGS, "op9_substring_dedup": SUBSTRINGS,
    "op11_importance_resampling": RESAMPLING, "op13_centroid_clustering": clustering(),
}
