"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import centroid_clustering, decontamination, embedding_dedup, importance_resampling, language_id, license_scan, lm_scoring, minhash_dedup, mixing, substring_dedup, token_binary, url_filters, vector_search
from tickloom.llm.common import table
from tickloom.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["ORACLES", "QUERIES"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filters(spark: SparkSession, path: str) -> DataFrame:
    return url_filters.contract(spark, table(spark, path, "pages"))


@query
def op2_license_scan(spark: SparkSession, path: str) -> DataFrame:
    return license_scan.license_scan(table(spark, path, "documents"))


@query
def op3_minhash_dedup(spark: SparkSession, path: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, path, "documents"), shingle=4, percent=80)


@query
def op4_embedding_dedup(spark: SparkSession, path: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, path, "embeddings"))


@query
def op5_decontamination(spark: SparkSession, path: str) -> DataFrame:
    return decontamination.contaminated(table(spark, path, "documents"), table(spark, path, "benchmark"))


@query
def op6_mixing(spark: SparkSession, path: str) -> DataFrame:
    return mixing.mix(table(spark, path, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op7_lm_scoring(spark: SparkSession, path: str) -> DataFrame:
    return lm_scoring.contract(table(spark, path, "documents"))


@query
def op8_token_binary(spark: SparkSession, path: str) -> DataFrame:
    return token_binary.round_trip(table(spark, path, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, path, "documents"), spans=False).drop("spans")


@query
def op10_language_id(spark: SparkSession, path: str) -> DataFrame:
    return language_id.held_out_prediction(table(spark, path, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    return importance_resampling.resample(table(spark, path, "documents"), table(spark, path, "benchmark"))


@query
def op12_nearest_neighbours(spark: SparkSession, path: str) -> DataFrame:
    return vector_search.nearest(table(spark, path, "embeddings"))


@query
def op13_centroid_clustering(spark: SparkSession, path: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, path, "embeddings"))
