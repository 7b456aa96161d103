"""Turning per-bar conditions into pattern rows: one pass over the frame, one explode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.schemas import SERIES, risk_reward

Value = Column | float | str | None


def _c(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


@dataclass
class Rule:
    """A pattern that ends at the current bar and spans ``span`` bars before it."""

    name: Value
    when: Column
    direction: Value
    confidence: Value
    span: int = 0
    entry: Value = None
    target: Value = None
    stop: Value = None
    start_idx: Column | None = None
    meta: dict[str, Value] = field(default_factory=dict)

    def struct(self, kind: str) -> Column:
        entry = F.col("close") if self.entry is None else _c(self.entry)
        start = F.col("idx") - self.span if self.start_idx is None else self.start_idx
        pairs = [x for k, v in self.meta.items() for x in (F.lit(k), _c(v).cast("double"))]
        meta = F.create_map(*pairs) if pairs else F.create_map()
        start_ts = F.lag("ts", self.span).over(fr.order()) if self.span else F.col("ts")
        return F.struct(
            F.lit(kind).alias("pattern_type"), _c(self.name).cast("string").alias("pattern_name"),
            _c(self.direction).cast("string").alias("direction"),
            start.cast("long").alias("start_idx"), F.col("idx").alias("end_idx"),
            start_ts.alias("start_ts"), F.col("ts").alias("end_ts"),
            _c(self.confidence).cast("double").alias("confidence"),
            entry.cast("double").alias("entry_price"),
            _c(self.target).cast("double").alias("target_price"),
            _c(self.stop).cast("double").alias("stop_loss"),
            meta.cast("map<string,double>").alias("metadata"),
        )


def emit(df: DataFrame, kind: str, rules: Sequence[Rule]) -> DataFrame:
    """Pattern rows of a framed DataFrame, in the order of the rules within a bar."""
    found = df.select(
        *SERIES, "core", F.array(*[F.when(r.when, r.struct(kind)) for r in rules]).alias("_found")
    )
    found = found.filter("core").withColumn("p", F.explode(F.array_compact("_found")))
    return found.select(*SERIES, "p.*").withColumn(
        "risk_reward", risk_reward(F.col("entry_price"), F.col("target_price"), F.col("stop_loss"))
    )
