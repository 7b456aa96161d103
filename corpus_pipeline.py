"""The corpus pipeline: raw documents to mixed, clean token files. Each stage is written as Parquet and read as the next one's input.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents; the last
returns the index of the token files. Texts are read whole. Rows with a null doc_id pass the filters; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import decontamination, language_id, minhash_dedup, mixing, token_binary
from tickloom.llm.common import shared_path, spare, table

#: SQL cannot express the stages (random vectors, minima of hashes, alignments); tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known: those without letters go, and those that resemble its prototype less than nearly
    all labelled documents of their length do. Null and empty texts have no letters; ties cannot occur; rows that repeat share a fate.
    """
    labelled = docs.where("lang is not null")
    prototypes = language_id.profiles(labelled)
    floors = language_id.least_scores(labelled, prototypes)
    pred, cosine = spare(docs, "pred"), spare(docs, "cosine")
    judged = language_id.identify(docs, prototypes, names_out=(pred, cosine))
    return judged.where((F.col(pred) != language_id.UNKNOWN) & (F.col(cosine) >= language_id.least_score(floors))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; of rows with one id, that with the
    smallest hash of its text. Rows with a null id stay, and so does each text without words, which is like no other.
    """
    kept = minhash_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    own = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    place = spare(docs, "place")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = own.withColumn(place, turn).where(F.col(place) == 1).select(docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts, and rows with a null id, stay; repeated rows share a fate."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, blocks taken twice standing twice; documents not taken go.

    Null texts have no words and go; a null source is a source of its own, the last; repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the token files, read back from them."""
    return token_binary.round_trip(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
