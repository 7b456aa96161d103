"""Importance resampling, nearest neighbours and centroid clustering against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tickloom.llm import centroid_clustering as cc
from tickloom.llm import importance_resampling as ir
from tickloom.llm import vector_search as vs

PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, grams):
    w = PLAIN.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % ir.BUCKETS for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, grams, percent, least):
    own = [(i, *runs(t, grams)) for i, t in docs]
    s, t = Counter(k for _, _, x in own for k in x), Counter(k for x in target for k in runs(x, grams)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (sa + ir.BUCKETS) / ((s[k] + 1) * (ta + ir.BUCKETS)))) for k in s}
    rows = []
    for i, n, x in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in x)
        rows.append([i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("grams", "percent", "least"), [((1, 1), 10, 20), ((1, 2), 50, 1), ((2, 3), 100, 0)])
def test_resampling_equals_brute_force(spark, docs, grams, percent, least):
    extra = [(None, "The lone word " * 30), (None, "The lone word " * 30), (-1, None), (-2, ""), (-3, "ÀÉ x" * 40_000), (-4, "z" * 50_000 + " AbC-dEf 12")]
    extra += [(7, "one row that comes often, " * 9)] * 40
    df = docs([(*e, None) for e in extra]).selectExpr("*", "1 AS turn", "2 AS n_features")
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in ir.resample(df, wanted, grams=grams, percent=percent, least_words=least).collect()), key=str)
    assert got == resampled([(r.doc_id, r.text) for r in df.collect()], target, grams, percent, least)


def test_resampling_of_nothing(spark, empty):
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ir.resample(empty, some).collect() == []
    assert sorted(tuple(r) for r in ir.resample(some, empty).collect()) == [tuple(r) for r in resampled([(1, "a b"), (2, None)], [], (1, 1), 10, 20)]


def test_quickselect_narrows_to_each_place(spark):
    rng = np.random.default_rng(5)
    rows = [(int(x), 0, int(i % 7), 0, i) for i, x in enumerate(rng.integers(0, 40, 300))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ir.KEY))
    for k in (1, 2, 150, 299, 300):
        assert tuple(ir.kth(df, k, pivots=3)) == sorted(rows)[k - 1]


def test_crc_of_ranges():
    words = [b"", b"a", b"ab", "äé".encode(), b"x" * 64, b"y" * 65, b"z" * 5000]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert ir.crc32s(data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(w) for w in words]


def neighbours(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    best = defaultdict(dict)
    for i, x in ok:
        if i % every == 0:
            for j, y in ok:
                if i != j and len(x) == len(y):
                    c = float(vs.cosines(x[None], y[None])[0])
                    best[i][j] = max(best[i].get(j, -2), c)
    return {i: sorted(b.items(), key=lambda t: (-t[1], t[0]))[:k] for i, b in best.items()}


def odd_vectors(v):
    return [(-1, None), (-2, [0.0] * 64), (-3, [1.0] * 63 + [None]), (-50, [float("nan")] * 64), (None, v), (-100, []), (-150, [1.0, 2.0]), (-151, [1.0, 2.1]), (-152, [-1.0, 0.5]),
            (-200, [2 * x for x in v]), (-200, [2 * x for x in v]), (-200, [-x for x in v]), (-250, [float("inf")] + v[1:])] + [(10_000 + i, v) for i in range(60)]


def test_search_of_everything_is_exact(spark):
    """With all leaves opened the result is that of brute force, with copies, repeated ids and other lengths."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 300")
    v = df.where("vec_id = 100").first().embedding
    both = df.unionByName(spark.createDataFrame(odd_vectors(v), df.schema)).selectExpr("*", "1 AS id", "2 AS v", "3 AS rank", "4 AS q")
    want = neighbours([(r.vec_id, r.embedding) for r in both.collect()], 5, 50)
    got = defaultdict(list)
    for r in sorted(vs.nearest(both, recall=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    hit = sum(len(set(dict(got[q])) & set(dict(b))) for q, b in want.items())
    assert set(got) == {q for q, b in want.items() if b}
    assert hit >= 0.95 * sum(map(len, want.values()))
    for q in (10_050, -200, 100):  # among copies: the smallest ids, not one's own
        assert got[q] == want[q]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered, monkeypatch):
    monkeypatch.setattr(vs, "BIN", 300)
    monkeypatch.setattr(vs, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 24)) * (0.15 if clustered else 1)
    if clustered:
        x += rng.standard_normal((40, 24))[rng.integers(0, 40, 6000)]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vs.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 50):
        c = u @ u[q]
        c[q] = -2
        hit += len(set(dict(got[q])) & set(np.argsort(-c)[:5].tolist()))
        assert all(abs(s - c[i]) < 1e-12 for i, s in got[q]) and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hit >= 0.9 * 5 * 120


def test_queue_opens_leaves_by_rank():
    rng = np.random.default_rng(4)
    x = vs.unit(rng.standard_normal((500, 8)))
    f = vs.Forest(x, 2000, 3)
    sizes = np.bincount(f.file(x).ravel(), minlength=f.leaves)
    ranks = np.zeros(f.leaves)
    for k, t in enumerate(f.trees):
        m = t.margins(x[:1])[0]
        for leaf in range(f.each):
            node = leaf + len(t.cuts)
            while node:
                up = (node - 1) // 2
                ranks[leaf + k * f.each] += m[up] ** 2 if (node == 2 * up + 2) != (m[up] > 0) else 0
                node = up
    opened = next(f.opened(x[:1], sizes, float("inf")))
    assert len(opened) == (sizes > 0).sum() and np.allclose(ranks[opened], np.sort(ranks[sizes > 0]))
    assert f.file(x[:1])[0, 0] in opened[:3]


def measured(most):
    """A mapInArrow that fails when a function that makes bits has made its process grow by more than `most` MB."""
    plain = DataFrame.mapInArrow

    def map_in_arrow(df, fn, schema):
        def run(batches):
            import resource

            top = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
            was = top()
            for out in fn(batches):
                if (grown := top() - was) > most:
                    raise MemoryError(f"{schema}: {grown} MB")
                yield out

        return plain(df, run if "bits" in schema else fn, schema)

    return map_in_arrow


def test_what_a_search_holds_is_bounded(spark, monkeypatch):
    """Thousands of queries in one batch, each of which opens all of 2,048 leaves."""
    monkeypatch.setattr(vs, "_budget", lambda *a: float("inf"))
    monkeypatch.setattr(vs, "LEAF", 4)
    monkeypatch.setattr(vs, "SLAB", 1 << 16)
    monkeypatch.setattr(DataFrame, "mapInArrow", measured(60))
    x = np.random.default_rng(6).standard_normal((3000, 32))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(3000), "embedding": pa.array(list(x))})).coalesce(1)
    monkeypatch.setattr(vs, "stored", lambda df, what, plain=vs.stored: plain(df.coalesce(1), what))
    assert vs.nearest(df, asked=F.lit(True)).groupBy("query_id").count().where("count = 5").count() == 3000


@pytest.mark.parametrize("dims", [(5,), (5, 9)])
def test_cells_hold_each_pair_that_is_opened(spark, monkeypatch, dims):
    """With spans of some vectors, parts of them, and spans whose queries are dealt out: all pairs are compared, and none is lost."""
    for name, value in (("BIN", 7), ("BLOCK", 5), ("LEAF", 32), ("HELD", 16 * 80), ("SLAB", 64), ("NUMBERS", 90), ("SHARES", 1 << 20), ("WORK", 900)):
        monkeypatch.setattr(vs, name, value)
    seen = []
    monkeypatch.setattr(vs.Spans, "dealt", lambda self, *a, plain=vs.Spans.dealt: (plain(self, *a), seen.append(self)))
    rng = np.random.default_rng(7)
    rows = [(i, [float(a) for a in rng.integers(-2, 3, dims[i % len(dims)])]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = neighbours(rows, 5, 3)
    got = defaultdict(list)
    monkeypatch.setattr(vs, "_budget", lambda *a: float("inf"))
    for r in vs.nearest(df, asked=F.col("vec_id") % 3 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == want
    assert (seen[0].parts > 1).any() and (seen[0].salts > 1).any() and set(seen[0].dim) == set(dims)


def test_search_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert vs.nearest(spark.createDataFrame([], schema)).collect() == []
    assert vs.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).collect() == []
    assert [tuple(r)[:3] for r in vs.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], schema)).collect()] == [(0, 1, 3)]
    assert vs.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (3, [2.0, 1.0])], schema)).collect() == []


def clustered(rows, k, rounds):
    kept = [(i, [cc._integer(x, 1024) for x in v], v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(r[0]), r[2]))[:k]]
    x = np.array([v for _, v, _ in kept], object)

    def assign():
        d = np.stack([((x - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)
        best = [min(range(len(centroids)), key=lambda c: (row[c], c)) for row in d]
        return np.array(best), [int(row[c]) for row, c in zip(d, best, strict=True)]

    for _ in range(rounds):
        best, _ = assign()
        centroids = [[int(s) // int((best == c).sum()) for s in x[best == c].sum(axis=0)] if (best == c).any() else old for c, old in enumerate(centroids)]
    best, d = assign()
    fits = lambda v: v if v < 1 << 63 else None
    own = {c: [a for a, b in zip(d, best.tolist(), strict=True) if b == c] for c in set(best.tolist())}
    sums = {c: fits(sum(a)) if all(v < 1 << 63 for v in a) else None for c, a in own.items()}
    total = fits(sum(d)) if None not in sums.values() else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, fits(a), sums[c], total, shas[c]) for (i, _, _), c, a in zip(kept, best.tolist(), d, strict=True)), key=str)


@pytest.mark.parametrize("odd", [[], [(-1, None), (-2, [1.0] * 63), (-3, [float("nan")] * 64), (-4, [None] * 64), (None, [0.5] * 64), (-7, [0.0] * 64), (-7, [0.0] * 64), (-7, [0.1] * 64)] + [(3, [0.25] * 64)] * 30,
                                 [(-5, [3e38] * 64), (-6, [-3e38] * 63 + [1.0]), (-8, [200_000.0] + [0.0] * 63)]])
def test_clusters_equal_brute_force(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    both = df.unionByName(spark.createDataFrame(odd, df.schema)).selectExpr("*", "1 AS cluster", "2 AS x", "3 AS h")
    got = sorted((tuple(r) for r in cc.cluster(both, rounds=4).collect()), key=str)
    assert got == clustered([(r.vec_id, r.embedding) for r in both.collect()], 8, 4)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert cc.cluster(spark.createDataFrame([], schema)).collect() == []
    three = [(i, [float(i)] * 64) for i in (1, 2, 3)]
    assert sorted(tuple(r) for r in cc.cluster(spark.createDataFrame(three, schema)).collect()) == clustered(three, 8, 10)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((3000, 16)) * 20 + rng.standard_normal((30, 16))[rng.integers(0, 30, 3000)] * 1000).astype(np.int64)
    c = x[:8].tolist()
    a = cc.Apexes(x[:64].tolist())
    best, least, compared = cc.nearest(x, a.of(x), c, a)
    d = np.stack([cc.squared(x, v) for v in c], axis=1)
    assert (best == d.argmin(axis=1)).all() and least == d.min(axis=1).tolist() and compared < 0.3 * d.size
    p, q = a.of(x[:50]), a.of(x[50:100])
    low = np.sqrt(((p[:, None, :-1] - q[None, :, :-1]) ** 2).sum(axis=2))
    true = np.sqrt(((x[:50, None] - x[None, 50:100]) ** 2).sum(axis=2))
    assert (low <= true * (1 + 1e-6) + 1e-3).all()
