from collections import Counter

import numpy as np

from tickloom.llm import embedding_dedup as e


def brute(rows, cos):
    ok = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = {i: i for i, _ in rows}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for dim in {len(v) for _, _, v in ok}:
        own = [x for x in ok if len(x[2]) == dim]
        x = np.array([v / np.linalg.norm(v) for _, _, v in own])
        for a, b in zip(*np.nonzero(x @ x.T >= cos - 1e-12), strict=True):
            if a != b:
                links[own[a][0]] += 1
                p, q = find(own[a][1]), find(own[b][1])
                parent[max(p, q)] = min(p, q)
    return sorted((i, links[k], find(i), find(i) == i) for k, (i, _) in enumerate(rows))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 100)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    v = rows[3][1]
    rng = np.random.default_rng(1)
    chain = [np.array(v) / np.linalg.norm(v)]
    for _ in range(6):
        step = rng.normal(size=64)
        step -= step @ chain[-1] * chain[-1]
        chain.append(chain[-1] * 0.96 + step / np.linalg.norm(step) * np.sqrt(1 - 0.96**2))  # neighbours link, others do not
    odd = [(-1, None), (-2, [0.0] * 64), (-3, [1.0] * 63 + [None]), (-4, [float("nan")] * 64), (-5, []), (-6, [1.0, 2.0]), (-7, [1.0, 2.1]), (-8, [2 * x for x in v]), (-8, [2 * x for x in v]), (-9, [float("inf")] + v[1:])]
    odd += [(-20 - k, [float(x) for x in c]) for k, c in enumerate(chain[1:])]
    both = df.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).selectExpr("*", "1 AS id", "2 AS v", "3 AS component")
    got = sorted(tuple(r) for r in e.near_vectors(both).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in both.collect()], 0.95)


def test_nothing(spark):
    assert e.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    got = e.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, True), (1, 0, True)]


def test_count_is_calibrated():
    rng = np.random.default_rng(2)
    d = rng.normal(0, np.sqrt(0.1), (200_000, e.PROJECTIONS))
    assert ((np.abs(d) <= e.WINDOW).sum(axis=1) >= e.least_count(0.95)).mean() > 0.9999
