"""Registry of the named queries: a plan over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.adapters import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "q_indicators", "q_volume", "q_patterns", "q_trend", "q_volprice", "q_sources", "q_quality",
    "q_relational", "q_aggregates", "q_joins", "q_store", "q_confidence", "q_validation", "q_streaming",
]


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load() -> None:
    for m in MODULES:
        import_module(f"tickloom.plans.{m}")


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        return lambda spark, path: fn(Tables(spark, path))

    return {name: bind(fn) for name, fn in PLANS.items()}


def rounded(df: DataFrame, keys: list[str], digits: int = 6, **cols) -> DataFrame:
    """Keys, then the named columns rounded."""
    return df.select(
        *keys, *[F.round(F.col(v) if isinstance(v, str) else v, digits).alias(k) for k, v in cols.items()]
    )


def round_many(col: Column | str, digits: int) -> Column:
    """F.round of a double for very many rows: by arithmetic, and by F.round, which writes each number as text, only where both could differ.

    That is near a half, for zero, negative and large numbers, and for null and NaN.
    """
    x = F.col(col) if isinstance(col, str) else col
    scaled = x * 10.0**digits
    whole = F.rint(scaled)
    return F.when(scaled.between(0.5, 1e9) & (F.abs(scaled - whole) < 0.499999), whole / 10.0**digits).otherwise(F.round(x, digits))


def lines(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """symbol, idx and the rounded columns of an indexed frame."""
    return rounded(df, ["symbol", "idx"], digits, **{c: c for c in cols})
