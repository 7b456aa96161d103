"""Operators on documents against brute force, with odd rows, and on an empty table."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import pairs_of
from pyspark.sql import functions as F

from tickloom.llm import components, decontamination, language_id, license_scan, lm_scoring, minhash_dedup, mixing, substring_dedup, token_binary


def split(text):
    return (text or "").encode().split()


def fold(text):
    return (text or "").encode().lower().split()


ODD = [(-5, None, "src0"), (-4, "", None), (-3, " \t\n", "src1"), (-2, "A b\x0bC", None), (-1, "a B c ", "new"), (None, "null id here", "src0"), (10**12, "solo", None), (10**12 + 1, "Solo", "src2")]


# ---- near duplicates


def link_components(ids, links):
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = fold(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    inverted, links = defaultdict(list), []
    for i, s in sets.items():
        met = Counter(j for g in s for j in inverted[g])
        links += [(i, j) for j, c in met.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
        for g in s:
            inverted[g].append(i)
    comp = link_components([i for i in sets if i is not None], [x for x in links if None not in x])
    return sorted((i, len(s), comp.get(i), comp.get(i, i) == i) for i, s in sets.items() if i is not None)


def test_minhash_equals_brute_force(docs):
    words = [f"w{k}" for k in range(60)]
    chain = [(2_000_000 + k, " ".join(words[:30] + [f"x{j}" for j in range(k)] + words[30:]), None) for k in range(0, 9, 2)]  # links form a chain
    df = docs([r for r in ODD if r[0] is not None] + chain)
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(df, shingle=4, percent=80).collect())
    assert got == near(pairs_of(df), 4, 80)


def test_minhash_null_ids_repeats_and_nothing(docs, empty, spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)])
    assert minhash_dedup.near_duplicates(empty).collect() == []


def test_all_texts_of_an_id_link(spark):
    """One id on several texts has the links of each, and its empty texts link with nothing."""
    texts = [" ".join(f"t{k}w{j}" for j in range(60)) for k in range(5)]
    rows = [(1, t) for t in texts] + [(10 + k, t + " more") for k, t in enumerate(texts)]
    rows += [(30, "x " + texts[0][::-1]), (30, ""), (31, "y " + texts[0][::-1]), (31, None), (40, texts[2][::-1]), (40, ""), (41, ""), (41, texts[3][::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1), (30, 30), (31, 30), (40, 40), (41, 41)} | {(10 + k, 1) for k in range(5)}


def test_a_group_whose_smallest_member_is_not_like_the_others(spark):
    """A bucket's smallest id links with nobody: the other members still find each other."""
    rng = random.Random(3)
    words = [f"v{k}" for k in range(200)]
    base = " ".join(words)
    other = " ".join(words[:150] + [f"u{k}" for k in range(60)])
    rows = [(1, other)] + [(k, base + f" tail{rng.random()}") for k in range(2, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {1: 1} | {k: 2 for k in range(2, 12)}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(a, a + 1) for a in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(7, 7)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == link_components(nodes, [e for e in edges if e[0] != e[1]])


# ---- substrings


def windows_removed(rows, n=50):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                x = tuple(w[k : k + n])
                first[x] = min(i, first.get(x, i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((str(i), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_substrings_equal_brute_force(docs, empty):
    text = " ".join(f"t{k % 97}" for k in range(300))
    odd = [*ODD, (None, text, None), (-9, "the " * 500, None), (-8, "the " * 300 + text, None), (-8, "the " * 300 + text, None), (10**13, "\x0b".join(text.split()[3:53]) + " end", None), (10**13, "other " * 60, None)]
    df = docs(odd)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect())
    assert got == windows_removed(pairs_of(df))
    assert substring_dedup.substring_dedup(empty).collect() == []


def test_spans_are_the_words_removed(spark):
    text = [f"s{k}" for k in range(120)]
    df = spark.createDataFrame([(1, " ".join(text[10:90])), (2, " ".join(["x", *text, "y"]))], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {1: [], 2: [(11, 91)]}


# ---- tokens


def test_tokens_equal_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = [*ODD, (-7, "<|endoftext|> x<|startoftext|>y  \u00c9\u0301\u03a9 \u0391\u03a3 don't I'LL \u00a0\u2003 \u00bd x\u00b2 \U0001f600\u200d", None), (-6, "a " * 70_000, None)]
    df = docs(odd)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for i, text in sorted(pairs_of(df), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in token_binary.round_trip(df).collect()), key=lambda r: r[1]) == want
    assert token_binary.round_trip(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 50, 700])
def test_code_lengths_are_optimal(n):
    rng = random.Random(n)
    counts = np.array([rng.randint(1, 10**6) for _ in range(n)])
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        total += (s := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, s)
    lengths = token_binary.code_lengths(counts, 40)
    assert (counts * lengths).sum() == (total if n > 1 else counts[0])
    short = token_binary.code_lengths(2 ** np.arange(40), 7)
    assert short.max() <= 7 and (2.0**-short).sum() <= 1


def test_bits_round_trip_across_checkpoints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.geometric(0.05, n).astype(np.uint32)
        some, counts = np.unique(np.append(ids, [1, 2]), return_counts=True)
        codes = token_binary.Codes(some, token_binary.code_lengths(counts))
        bits, marks = token_binary.pack(ids, *codes.encoding())
        assert (token_binary.unpack(bits, marks, n, *codes.decoding(), codes.longest) == ids).all()


# ---- mixing


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 1000, 1023, 1024, 1025, 4097])
def test_places_are_permuted(spark, n):
    for source, turn in ((0, 0), (1, 0), (0, 1)):
        df = spark.range(n).select("id", mixing.permuted(F.lit(source), F.lit(turn), F.col("id"), F.lit(n).cast("long")).alias("p"))
        got = [r.p for r in df.orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        steps = {(y - x) % n for x, y in zip(got, got[1:])}
        assert n < 100 or len(steps) > n / 3  # no rotation and no constant stride


def test_places_of_a_huge_source(spark):
    n = 5_000_000_000_000
    df = spark.range(n - 2000, n).select(mixing.permuted(F.lit(3), F.lit(1), F.col("id"), F.lit(n)).alias("p"))
    got = [r.p for r in df.collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < n and max(got) - min(got) > n / 2


def test_mix_meets_its_targets(docs, empty):
    df = docs(ODD, "/root/testdata/sf0.01")
    rows = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(split(t))) for i, t in pairs_of(df))
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(b[0] for b in by.values()), {}
    while over := [s for s in names if s not in full and (total - sum(full.values())) * weights[s] / sum(weights[x] for x in names if x not in full) > 2 * by[s][0]]:
        full |= {s: 2.0 * by[s][0] for s in over}
    for r in rows:
        target = full.get(r.source, (total - sum(full.values())) * weights[r.source] / sum(weights[x] for x in names if x not in full))
        assert math.isclose(r.target, target, rel_tol=1e-9) and r.source_size == by[r.source][0]
        assert abs(by[r.source][1] - target) <= max(0.03 * target, 2 * mixing.BLOCK)
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(empty).collect() == []


def test_mixed_documents_hold_the_taken_words(docs):
    df = docs(ODD)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    texts = {i: split(t) for i, t in pairs_of(df)}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text.encode().split(b" ") for r in out.collect()}
    assert {i: len(w) for i, w in got.items()} == taken
    assert all(not Counter(w) - Counter(texts[i] * 2) for i, w in got.items())


def test_texts_are_dealt_once_to_be_mixed(spark, monkeypatch):
    """To meet the blocks taken of them; places are found from sizes alone. Before, a window and the join shuffled the texts."""
    rows = [(i % 7, f"s{i % 3}", " ".join(f"w{i}x{k}" for k in range(150 + i))) for i in range(60)]  # ids repeat, texts differ
    rows += [(None, None, "a b c " * 40), (3, "s0", None), (4, "s1", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    placed, positioned = [], mixing.positioned
    monkeypatch.setattr(mixing, "positioned", lambda d, *a: placed.append(d.columns) or positioned(d, *a))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = {}
    for i, s, t in rows:
        for w in (t or "").split():
            words[w] = (i, s)
    got = out.collect()
    assert got and all(words[w] == (r.doc_id, r.source) for r in got for w in r.text.split())
    assert placed == [["_at", "doc_id", "source", "size"]]


# ---- models


def test_language_of_held_out_texts(docs, empty):
    df = docs([*ODD, (-7, "1234 !!", None), (-8, "and the " * 100_000, None)], "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in language_id.held_out_prediction(df).collect()}
    lang = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    held = [r for i, r in got.items() if i is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    known = [r for r in held if lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (-3, -4, -5, -7)] == ["und"] * 4 and got[-8].lang_pred == "en"
    assert language_id.held_out_prediction(empty).collect() == []


def test_bundles_equal_bound_letters():
    import pyarrow as pa

    from tickloom.llm.common import Texts

    third, _ = language_id.letters()
    slot = language_id.letter_slots()
    text = "Éa  b"
    s = [0, *[int(slot[ord(c)]) for c in text.replace("  ", " ")], 0]
    want = sum(np.roll(third[s[k - 1]], 2).astype(int) * np.roll(third[s[k]], 1) * third[s[k + 1]] for k in range(1, len(s) - 1) if s[k])
    assert (language_id.bundles(Texts(pa.array([None, text])))[1] == want).all()


def test_scores_of_the_language_model(docs, empty):
    df = docs([*[r for r in ODD if r[0] is not None], (-7, "The the", None), (-7, "The the", None)], "/root/testdata/sf0.01")
    tokens = lambda t: [*fold(t), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = pairs_of(df)
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, z = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / z) for w in tokens(t)), 4)) for i, t in rows)
    got = lm_scoring.contract(df).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)
    assert all(r.score < 0 for r in got) and lm_scoring.contract(empty).collect() == []


def test_class_probabilities_sum_to_one():
    model = lm_scoring.Model()
    model.before[:] = np.random.default_rng(1).normal(size=model.before.shape)
    assert np.allclose(np.exp(model.log_probabilities(np.arange(500))).sum(axis=1), 1, atol=1e-5)


def test_packed_numbers_come_back():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for kind, x in (("<u4", rng.integers(0, 1 << 32, 500)), ("<u8", rng.integers(0, 1 << 63, 500)), ("<f8", rng.normal(size=500)), ("u1", rng.integers(0, 256, 500)), ("<u4", [])):
        x = np.asarray(x).astype(kind)
        assert (lm_scoring.unpacked(pa.scalar(lm_scoring.packed(x), pa.binary()), kind, len(x)) == x).all()
    x = np.sort(rng.integers(0, 1 << 64, 500, dtype=np.uint64))
    edge = np.array([0, 0, 100, 350, 500])
    assert (np.cumsum(lm_scoring.steps(x), dtype=np.uint64) == x).all()
    parts = [np.cumsum(lm_scoring.steps(x, edge)[a:b], dtype=np.uint64) for a, b in zip(edge, edge[1:])]
    assert (np.concatenate(parts) == x).all()


def test_what_blocks_carry_of_a_word_and_its_features_is_a_few_bytes(spark):
    """Shuffled and stored are the words of blocks and their features; before, 20 bytes a word and 12 a feature."""
    rng = random.Random(4)
    rows = [(i, i % 5 > 0, " ".join(f"w{int(rng.paretovariate(0.6)) % 20000}" for _ in range(400))) for i in range(500)]
    blocks = lm_scoring._coded(spark.createDataFrame(rows, "doc_id long, learn boolean, text string").coalesce(1)).cache()
    counts = lm_scoring._counted(blocks, 4).cache()
    words = blocks.agg({"size": "sum"}).first()[0]
    size = lambda df, *names: sum(len(r[n]) for r in df.select(*names).collect() for n in names)
    assert words > 2000 and size(blocks, "words", "counts") < 10 * words and size(blocks, "places") < 2.5 * 200_500 and size(counts, "sums") < 3 * words
    vocabulary = lm_scoring._vocabulary(counts)
    assert vocabulary.tokens == 400 * 401
    coded = lm_scoring._read_blocks(blocks.drop("counts").join(lm_scoring._by_block(counts), "block"), vocabulary, 4).cache()
    sums = [c["sums"] for r in lm_scoring._summed(coded, 4).collect() for c in r["sums"]]

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(lm_scoring.Block(batch, k).features()[0]) for k in range(batch.num_rows)], pa.int64())], names=["n"])

    n = coded.select(*lm_scoring.Block.COLUMNS).mapInArrow(features, "n long").agg({"n": "sum"}).first()[0]
    assert n > 20_000 and sum(map(len, sums)) < 2 * n


def test_blocks_are_not_shuffled_to_meet_the_sums_of_their_features(spark):
    """Only lists of features by range and their sums by block are; before, the blocks' texts were too."""
    from tickloom.llm.common import stored_in_buckets

    docs = spark.createDataFrame([(i, i % 5 > 0, f"a b{i} c a b{i % 3}") for i in range(40)], "doc_id long, learn boolean, text string")
    blocks = lm_scoring._coded(docs).cache()
    counts = lm_scoring._counted(blocks, 4).cache()
    read = lm_scoring._read_blocks(blocks.join(lm_scoring._by_block(counts), "block"), lm_scoring._vocabulary(counts), 4)
    coded, name = stored_in_buckets(read, "test-read", "block")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = lm_scoring._scores(coded, lm_scoring.Model(), 4)
        assert scores._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert scores.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql(f"DROP TABLE {name}")
    before = [t.name for t in spark.catalog.listTables()]
    lm_scoring.contract(docs.drop("learn")).collect()
    assert [t.name for t in spark.catalog.listTables()] == before  # no table is left


def test_rare_words_are_predicted_by_the_words_before(spark):
    """400 rare words that each follow one word, in a vocabulary far over that of the classes: context must tell them."""
    rng = random.Random(8)
    text = lambda: " ".join(f"a{k} b{k}" for k in (rng.randrange(400) for _ in range(60)))
    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    out = [r for r in lm_scoring.contract(docs).collect() if r.held_out]
    # half of the words follow from the word before; one strength for all contexts costs some of what that is worth
    assert len(out) > 30 and sum(r.score for r in out) > 0.7 * sum(r.base_score for r in out)


def test_blended_shares_sum_to_one():
    rng = np.random.default_rng(3)
    share, near, far = rng.dirichlet(np.ones(50)), rng.integers(0, 4, 50), rng.integers(0, 9, 50)
    for m in lm_scoring.STRENGTHS:
        total = lm_scoring.blended(near, near.sum(), lm_scoring.blended(far, far.sum(), share, m), m)
        assert np.isclose(total.sum(), 1) and (total > 0).all()


def test_licenses(docs, spark, empty):
    found = [(1, "MIT", "some prose\nReleased under the MIT License."), (2, "Apache-2.0", "x y z\n\nLicensed under the Apache License, Version 2.0.\nmore"), (3, None, "You need a license to drive."), (4, None, None), (5, None, "")]
    df = docs([(-i, t, None) for i, _, t in found], "/root/testdata/sf0.01")
    got = [(r.doc_id, r.paragraph, r.family) for r in license_scan.license_scan(df).collect()]
    assert {x for x in got if x[0] < 0} == {(-1, 1, "MIT"), (-2, 2, "Apache-2.0")}
    marks = {"CC-BY-NC": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License."}
    want = {(i, k, f) for i, t in pairs_of(df) for k, line in enumerate((t or "").split("\n")) for f, m in marks.items() if m in line}
    assert set(got) == want and license_scan.license_scan(empty).collect() == []


NOTICES = [
    ("licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND"), ("Licensed under CC BY 4.0.", "CC-BY"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND"), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL"), ("This library is licensed under the GNU Lesser General Public License.", "LGPL"), ("Released under the ISC License.", "ISC"), ("Released under the MIT License.", "MIT"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("Released under CC0 1.0.", "CC0"),
]
NO_NOTICES = ["You need a license to drive a car in this country.", "The license of the agency, version 2.0, was renewed.", "Students of MIT released a new study under the old law.", "Licensed under the terms of the state of Maine, he sold fish.",
              "The general public was free to use the library.", "The Apache people lived in the south, version three of the story says.", "All rights reserved."]


def test_notices_and_what_looks_like_them(docs):
    """Each notice is named with its own family or not at all; at most a tenth is missed, and nothing else is named."""
    df = docs([(-1 - i, t, None) for i, (t, _) in enumerate(NOTICES)] + [(-100 - i, t, None) for i, t in enumerate(NO_NOTICES)], "/root/testdata/sf0.01")
    got = {r.doc_id: r.family for r in license_scan.license_scan(df).where("doc_id < 0").collect()}
    assert all(got.get(-1 - i, f) == f for i, (_, f) in enumerate(NOTICES)), [(t, got.get(-1 - i)) for i, (t, f) in enumerate(NOTICES) if got.get(-1 - i, f) != f]
    assert sum(-1 - i in got for i in range(len(NOTICES))) >= 0.9 * len(NOTICES), [t for i, (t, _) in enumerate(NOTICES) if -1 - i not in got]
    assert not [i for i in got if i <= -100]


# ---- decontamination


def local(a, t):
    best, row = 0, [0] * (len(t) + 1)
    for x in a:
        new = [0] * (len(t) + 1)
        for j, y in enumerate(t, 1):
            new[j] = max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[j - 1] - 1)
            best = max(best, new[j])
        row = new
    return best


def test_alignment_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(60):
        a, t = [[rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(2)]
        assert decontamination.align(np.array(a), np.array(t))[0] == local(a, t)


def test_copies_and_edited_copies_are_found(docs, empty, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("*", "1 AS score")
    text = {r.item_id: r.text.split() for r in items.collect()}
    long = [i for i, w in sorted(text.items()) if len(w) >= 30][:3]
    rng = random.Random(4)
    edited = [w if rng.random() > 0.12 else "zzz" for w in text[long[1]]]
    odd = [(-1, "lead in " + " ".join(text[long[0]]) + " and out", None), (-2, "aaa bbb " * 50 + " ".join(edited), None), (-3, " ".join(text[long[2]][:8]), None), (-4, None, None), (-5, "", None)]
    df = docs(odd)
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, items).collect()}
    assert (-1, long[0]) in got and got[-1, long[0]].score == 1 and (got[-1, long[0]].start, got[-1, long[0]].end) == (2, 2 + len(text[long[0]]))
    assert (-2, long[1]) in got and got[-2, long[1]].score < 1 and not any(d in (-3, -4, -5) for d, _ in got)
    folded = {i: fold(" ".join(w)) for i, w in text.items()}
    for i, t in pairs_of(df):
        w = fold(t)
        for k, item in folded.items():
            if {tuple(item[j : j + 5]) for j in range(len(item) - 4)} & {tuple(w[j : j + 5]) for j in range(len(w) - 4)}:
                assert ((i, k) in got) == (local(item, w) >= decontamination.needed(len(item))), (i, k)
    assert decontamination.contaminated(empty, items).collect() == [] and decontamination.contaminated(df, items.limit(0)).collect() == []
    assert decontamination.clean(df, items).columns == df.columns


def test_edits_at_regular_distances_equal_alignment_of_all_pairs(spark):
    """Every 4th to 7th word replaced, dropped, or one inserted after every 2nd to 6th; an exact copy makes the broken n-grams rarest."""
    rng, items, texts = random.Random(6), [], []
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    for length in (3, 8, 9, 16, 40, 60):
        item = [word() for _ in range(length)]
        items.append((length, " ".join(item)))
        edits = [item] + [[w if k % d else x for k, w in enumerate(item)] for d in (3, 4, 5, 6, 7) for x in ("zz",)] + [[w for k, w in enumerate(item) if k % d] for d in (4, 5, 7)]
        edits += [[y for k, w in enumerate(item, 1) for y in ([w, "zz"] if k % d == 0 else [w])] for d in (1, 2, 3, 4, 6)]
        edits += [[w if rng.random() > rate else word() for w in item] for rate in (0.15, 0.2, 0.25) for _ in range(6)]
        edits += [[y for w in item for y in rng.choice([[w], [w], [w], [w], [], [w, word()], [word()]])] for _ in range(12)]
        texts += [[word() for _ in range(rng.randrange(5))] + e + [word() for _ in range(rng.randrange(5))] for e in edits]
    items.append((1, "aa bb"))
    want = {}
    for i, t in enumerate(texts):
        for k, x in items:
            s = local(x.split(), t)
            if len(x.split()) >= 3 and s >= max(0.5 * len(x.split()), min(len(x.split()), 8)):
                want[i, k] = s
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(want) and {(r.doc_id, r.item_id): round(r.score * r.item_words) for r in got} == want
    assert all(local(dict(items)[r.item_id].split(), texts[r.doc_id][r.start : r.end]) == want[r.doc_id, r.item_id] for r in got)
