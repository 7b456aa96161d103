"""Matches counted without listing pairs: the same numbers as the pairs give."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import store as st
from tickloom.streaming import live

PATTERNS = "pattern_id string, symbol string, pattern_type string, confidence double"
SUBS = "subscriber long, symbols array<string>, pattern_types array<string>, min_confidence double"
# Ids that repeat with one key and with several, missing ids, keys and confidences, equal confidences, values beyond 0 to 1.
FOUND = [("a", "X", "chart", 0.9), ("b", "Y", "chart", 0.8), ("c", "X", "price", 0.8), ("c", "X", "price", 0.85), ("d", "X", "chart", 0.7), ("d", "Y", "price", 0.95),
         (None, "X", "chart", 0.9), (None, "Y", "chart", 0.9), ("e", None, "chart", 0.9), ("f", "X", None, 0.9), ("g", "X", "chart", None), ("h", "Z", "chart", 7.0),
         ("i", "Z", "chart", 3.0), ("j", "Z", "chart", -4.0), ("k", "X", "chart", float("nan"))]
WANTED = [(1, ["X"], ["chart"], 0.8), (2, [], [], 0.8), (3, ["X", "Y"], None, 0.8), (4, [], ["chart", "price"], 0.9), (5, ["X"], [], 0.9), (5, [], ["price"], 0.5),
          (6, ["X", "X", None], ["chart"], None), (6, ["X"], ["chart"], 0.85), (7, ["Q"], [], 0.1), (None, ["Y"], [], 0.8), (8, ["Z"], [], 3.5), (9, ["Z"], [], -5.0), (1, ["Y"], ["chart"], 0.8),
          (10, ["X"], ["chart"], 0.8), (11, [], [], 0.8)]


def test_match_counts_equal_the_listed_pairs(spark):
    patterns, subs = spark.createDataFrame(FOUND, PATTERNS), spark.createDataFrame(WANTED, SUBS)
    pairs = st.match_subscriptions(patterns, subs).groupBy("subscriber").agg(F.count(F.lit(1)).alias("matches"))
    want = {r.subscriber: r.matches for r in pairs.collect()}
    assert want and {r.subscriber: r.matches for r in st.match_counts(patterns, subs).collect()} == want


def test_match_counts_make_no_pairs_of_plain_keys(spark):
    """3,000 patterns and 3,000 subscribers to all of them: nine million pairs, none of which is listed."""
    patterns = spark.range(3000).select(F.col("id").cast("string").alias("pattern_id"), F.lit("X").alias("symbol"), F.lit("chart").alias("pattern_type"), (F.col("id") / 3000).alias("confidence"))
    none = F.array().cast("array<string>")
    subs = spark.range(3000).select(F.col("id").alias("subscriber"), none.alias("symbols"), none.alias("pattern_types"), (F.col("id") / 3000).alias("min_confidence"))
    got = st.match_counts(patterns, subs).collect()
    assert {r.subscriber: r.matches for r in got} == {k: 3000 - k for k in range(3000)}


def test_alert_classes_stand_for_their_members(spark):
    patterns = spark.createDataFrame([(p, s, k, c) for p, s, k, c in FOUND], PATTERNS)
    subs = spark.createDataFrame([*WANTED, (20, ["Y", "X"], [], 0.8), (21, ["X", "Y", "X"], None, 0.8)], SUBS)
    classes = live.alert_classes(subs)
    assert classes.count() == 13 and classes.agg(F.sum("members")).first()[0] == len(WANTED) + 2
    each = live.alert_stream(patterns, subs).groupBy("channel").agg(F.count(F.lit(1)).alias("n")).collect()
    by_class = live.alert_stream(patterns, classes).groupBy("channel").agg(F.sum("members").alias("n")).collect()
    assert {r.channel: r.n for r in by_class} == {r.channel: r.n for r in each}


@pytest.mark.parametrize("call", ["profiles", "least_scores"])
def test_the_language_stage_learns_from_all_labelled_rows(spark, monkeypatch, call):
    import corpus_pipeline
    from tickloom.llm import language_id

    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("id") % 10 != 0, "en").alias("lang"))
    seen = []
    monkeypatch.setattr(language_id, "profiles", lambda d: (call == "profiles" and seen.append(d.count())) or {})
    monkeypatch.setattr(language_id, "least_scores", lambda d, p: (call == "least_scores" and seen.append(d.count())) or [])
    corpus_pipeline.identify_language(spark, docs, "")
    assert seen == [27_000]


def test_least_scores_are_quantiles_of_all_texts(spark):
    import numpy as np

    from tickloom.llm import language_id

    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [(i, " ".join(words[(i * k) % 7] for k in range(1, 4 + i % 9)), "en") for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None, "en"), (401, "...", "en")], "doc_id long, text string, lang string")
    prototypes = language_id.profiles(docs)
    judged = language_id.identify(docs, prototypes).where("lang_pred = 'en'").select(language_id.length_class().alias("bin"), "score").collect()
    want = {}
    for r in judged:
        want.setdefault(r.bin, []).append(r.score)
    want = {b: 0.75 * np.quantile(v, 0.001) for b, v in want.items() if len(v) >= 50}
    got = dict(language_id.least_scores(docs, prototypes))
    assert want and got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-5 for b in want)
