import random

import corpus_pipeline as p
from llm_helpers import pairs_of

from tickloom.llm import decontamination, minhash_dedup


def test_stages(spark, docs, tmp_path):
    sf = "/root/testdata/sf0.001"
    extra = [(-1, None, "src0"), (-2, "", None), (None, "la la li lo", "src0")]
    start = docs(extra).drop("score")
    now, seen = start, [start]
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, now, sf)
        if k < len(p.STAGES) - 1:
            assert out.columns == start.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert ids[0] - ids[1] == {-1, -2}
    near = {r.doc_id for r in minhash_dedup.near_duplicates(seen[1]).where("not kept").collect()}
    assert near and ids[1] - ids[2] == near
    bad = {r.doc_id for r in decontamination.contaminated(seen[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert bad and ids[2] - ids[3] == bad
    texts = dict(pairs_of(seen[3]))
    assert ids[4] <= ids[3] and all(set(t.split()) <= set(texts[i].split()) for i, t in pairs_of(seen[4]))
    rows = sorted(seen[5].collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))] and len(rows) == seen[4].count()


def test_no_documents(spark, empty, tmp_path):
    now = empty
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, now, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    assert now.count() == 0


def test_first_stage_keeps_clean_and_drops_noise(spark, docs):
    rng = random.Random(2)
    noise = [(9_000_000 + i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) if rng.random() > 0.2 else " " for _ in range(300)), "src0") for i in range(100)]
    noise += [(9_100_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)), "src0") for i in range(100)]
    start = docs(noise, "/root/testdata/sf0.01")
    kept = {r.doc_id for r in p.identify_language(spark, start, "").select("doc_id").collect()}
    clean = {r.doc_id for r in start.where("doc_id < 9000000 and length(text) > 30").select("doc_id").collect()}
    assert not [i for i, _, _ in noise if i in kept] and len(clean - kept) <= 0.005 * len(clean)


def test_working_columns_do_not_clash(spark, docs):
    sf = "/root/testdata/sf0.001"
    names = ("pred", "cosine", "place", "_bad", "_turn", "_language", "_likeness", "_row", "_text", "_key")
    plain, odd = docs([]), docs([]).selectExpr("*", *[f"doc_id AS `{n}`" for n in names])
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, plain, sf).collect()) and all(r[n] == r.doc_id for r in rows for n in names)
