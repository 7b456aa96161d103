"""Trendlines through runs of local extrema, and channels between them.

Every run of consecutive peaks (or troughs) of a series is a candidate line, so candidates grow with the square of the extrema. They
are fitted in parallel: a task takes some starting points, fits all runs from each with running sums, and keeps what correlates
well enough; packed candidates are all that is shuffled.

Dropping similar lines depends on the candidates' order. One pass per series and side streams its packed candidates in that
order, holding the closes (8 bytes a bar) and the lines kept. Kept lines are filed under cells of slope and
intercept on a logarithmic grid; a candidate's twins can lie only in its own cell and those beside it. Touches are
counted only for candidates that would be kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.stats import t_quantile, t_two_sided
from tickloom.schemas import SERIES, positive, require

#: Neighbours on each side that an extremum beats; least correlation; and how near two lines are in parts of the older one.
ORDER, LEAST_R, ALPHA, TWIN = 5, 0.8, 0.05, 0.1
#: Starting points of a task, and candidates of a packed row, about.
STARTS, PACKED = 64, 1 << 16
#: Width of a cell: a ratio from 1 - TWIN to 1 + TWIN spans less.
_CELL = -math.log1p(-TWIN) + 1e-9
_CANDIDATE = np.dtype([("start", "<i8"), ("end", "<i8"), ("points", "<i8"), ("slope", "<f8"), ("base", "<f8"), ("r", "<f8")])
_LINES = (
    "symbol string, timeframe string, line_type string, slope double, intercept double, r_squared double, p_value double, "
    "touches long, start_idx long, end_idx long, angle_degrees double, strength double"
)


def least_correlations(points: int) -> np.ndarray:
    """By number of points: the correlation that a line must exceed to be strong and significant."""
    out = np.full(points + 1, LEAST_R)
    for n in range(3, min(points, 12) + 1):
        t = t_quantile(ALPHA, n - 2)
        out[n] = max(LEAST_R, t / math.sqrt(t * t + n - 2))
    return out


def fits(x: np.ndarray, v: np.ndarray, first: int, min_points: int, least: np.ndarray) -> np.ndarray:
    """Candidates among the runs that start at one point, by running sums from it."""
    x, v = x[first:], v[first:]
    dx, dv, n = (x - x[0]).astype(float), v - v[0], np.arange(1, len(x) + 1)
    sx, sv = np.cumsum(dx), np.cumsum(dv)
    sxx, sxv, svv = np.cumsum(dx * dx) - sx * sx / n, np.cumsum(dx * dv) - sx * sv / n, np.cumsum(dv * dv) - sv * sv / n
    with np.errstate(divide="ignore", invalid="ignore"):
        slope, r = sxv / sxx, np.clip(sxv / np.sqrt(sxx * svv), -1, 1)
    use = (n >= max(3, min_points)) & (svv > 1e-18 * max(1.0, np.abs(v).max()) ** 2) & (np.abs(r) > least[: len(x) + 1][n])
    at = np.flatnonzero(use)
    out = np.empty(len(at), _CANDIDATE)
    out["start"], out["end"], out["points"], out["slope"], out["r"] = x[0], x[at], n[at], slope[at], r[at]
    out["base"] = (sv[at] - slope[at] * sx[at]) / n[at] + v[0] - slope[at] * x[0]
    return out


class Lines:
    """The lines of one side of a series, added in order; of twins the better fit stays."""

    def __init__(self, closes: np.ndarray, min_points: int, max_dev: float):
        self.closes, self.min_points, self.max_dev = closes, min_points, max_dev
        self.at = np.arange(len(closes), dtype=float)
        self.kept: dict[int, np.void] = {}  # by turn of arrival
        self.cells: dict[tuple[int, ...], list[int]] = {}
        self.turn = 0

    def touches(self, slope: float, base: float, enough: int | None = None) -> int:
        """Bars near the line; counting stops at `enough`."""
        found = 0
        for k in range(0, len(self.closes), 8192):
            line = slope * self.at[k : k + 8192] + base
            with np.errstate(divide="ignore", invalid="ignore"):
                found += int((np.abs(self.closes[k : k + 8192] - line) / line < self.max_dev).sum())
            if enough is not None and found >= enough:
                break
        return found

    @staticmethod
    def cell(c: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            logs = [np.where(c[k] != 0, np.floor(np.log(np.abs(c[k])) / _CELL), 0).astype(np.int64) for k in ("slope", "base")]
        return np.stack([np.sign(c["slope"]).astype(np.int64), logs[0], np.sign(c["base"]).astype(np.int64), logs[1]], axis=1)

    def _near(self, cell: tuple[int, ...]) -> list[int]:
        a, b, c, d = cell
        return sorted(t for i in (-1, 0, 1) for j in (-1, 0, 1) for t in self.cells.get((a, b + i, c, d + j), ()))

    def add(self, candidates: np.ndarray) -> None:
        cells = self.cell(candidates)
        edge = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
        for run, cell in zip(np.split(candidates, edge), cells[np.concatenate([[0], edge])], strict=True):
            self._add_run(run, tuple(cell.tolist()))

    def _add_run(self, run: np.ndarray, cell: tuple[int, ...]) -> None:
        k = 0
        while k < len(run):
            part, near = run[k : k + 512], self._near(cell)
            twin = np.full(len(part), -1)
            if near:
                old = np.array([self.kept[t] for t in near], _CANDIDATE)
                alike = (np.abs(part["slope"][:, None] - old["slope"]) < np.abs(old["slope"]) * TWIN) & (np.abs(part["base"][:, None] - old["base"]) < np.abs(old["base"]) * TWIN)
                twin = np.where(alike.any(axis=1), alike.argmax(axis=1), -1)
                wins = (twin < 0) | (part["r"] ** 2 > old["r"][twin] ** 2)
            else:
                wins = np.ones(len(part), bool)
            first = int(wins.argmax())
            if not wins[first]:
                k += len(part)
                continue
            line = part[first]
            if self.touches(line["slope"], line["base"], self.min_points) >= self.min_points:
                if twin[first] >= 0:
                    gone = near[twin[first]]
                    del self.kept[gone]
                    for own in self.cells.values():
                        if gone in own:
                            own.remove(gone)
                            break
                self.kept[self.turn] = line
                self.cells.setdefault(cell, []).append(self.turn)
                self.turn += 1
            k += first + 1

    def rows(self) -> Iterator[tuple]:
        for c in self.kept.values():
            slope, base, r, free = float(c["slope"]), float(c["base"]), float(c["r"]), int(c["points"]) - 2
            p = t_two_sided(math.inf if abs(r) == 1 else r * math.sqrt(free / (1 - r * r)), free)
            yield slope, base, r * r, p, self.touches(slope, base), int(c["start"]), int(c["end"]), math.degrees(math.atan(slope)), abs(r)


def trendlines(bars: DataFrame, min_points: int = 3, max_dev: float = 0.05) -> DataFrame:
    """Resistance and support lines of each whole series of at least 2 * min_points bars.

    A line is a least-squares fit through at least min_points consecutive extrema with |r| over 0.8 and p under 0.05, near which at
    least min_points bars lie. Of lines with slope and intercept within a tenth of an older one only the better fit stays.
    """
    require(bars, "close")
    positive(min_points=min_points)
    df = fr.framed(bars, back=ORDER, ahead=ORDER)
    kind = F.when(fr.is_peak("close", ORDER), "resistance").when(fr.is_trough("close", ORDER), "support")
    long_enough = df.withColumn("line_type", kind).filter(F.col("core") & (F.col("n") >= 2 * min_points)).select(*fr.BLOCK, "idx", "close", "line_type")
    points = long_enough.filter("line_type is not null").groupBy(*SERIES, "line_type").agg(F.array_sort(F.collect_list(F.struct("idx", "close"))).alias("p"))
    starts = F.sequence(F.lit(0), F.size("p") - min_points, F.lit(STARTS))
    tasks = points.filter(F.size("p") >= min_points).select(*SERIES, "line_type", F.col("p.idx").alias("x"), F.col("p.close").alias("v"), F.explode(starts).alias("first"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key = [batch.column(k).slice(r, 1) for k in range(3)]
                x, v, first = np.asarray(batch.column(3)[r].values), np.asarray(batch.column(4)[r].values), batch.column(5)[r].as_py()
                least, found, held, turn = least_correlations(len(x)), [], 0, first
                for k in range(first, min(first + STARTS, len(x) - min_points + 1)):
                    found.append(fits(x, v, k, min_points, least))
                    held += len(found[-1])
                    if held >= PACKED:
                        yield pa.RecordBatch.from_arrays([*key, pa.array([turn], pa.int64()), pa.array([np.concatenate(found).tobytes()], pa.binary())], names=names)
                        found, held, turn = [], 0, k + 1
                if held:
                    yield pa.RecordBatch.from_arrays([*key, pa.array([turn], pa.int64()), pa.array([np.concatenate(found).tobytes()], pa.binary())], names=names)

    names = [*SERIES, "line_type", "turn", "packed"]
    candidates = tasks.repartition(*SERIES, "line_type", "first").mapInArrow(fit, "symbol string, timeframe string, line_type string, turn long, packed binary")
    closes = long_enough.groupBy(*fr.BLOCK).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "close"))), lambda e: e["close"]).alias("closes"))
    sides = F.explode(F.array(F.lit("resistance"), F.lit("support"))).alias("line_type")
    # the closes of a series come before its candidates
    stream = closes.select(*SERIES, sides, (F.col("blk") - (1 << 40)).alias("turn"), "closes", F.lit(None).cast("binary").alias("packed")).unionByName(
        candidates.withColumn("closes", F.lit(None).cast("array<double>")))

    def drop_twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, lines = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            out = [(*key, *row) for row in lines.rows()] if lines is not None else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[c.split()[0] for c in _LINES.split(", ")])

        for batch in batches:
            for r in range(batch.num_rows):
                own = tuple(batch.column(k)[r].as_py() for k in range(3))
                if own != key:
                    yield from done()
                    key, parts, lines = own, [], None
                if batch.column("packed")[r].is_valid:
                    if lines is None:
                        lines = Lines(np.concatenate(parts), min_points, max_dev)
                    lines.add(np.frombuffer(batch.column("packed")[r].as_buffer(), _CANDIDATE))
                else:
                    parts.append(batch.column("closes")[r].values.to_numpy(zero_copy_only=False).astype(float))
        yield from done()

    by = [*SERIES, "line_type"]
    return stream.repartition(*by).sortWithinPartitions(*by, "turn").select(*by, "turn", "closes", "packed").mapInArrow(drop_twins, _LINES)


def channels(lines: DataFrame) -> DataFrame:
    """Resistance and support lines of one series with slopes within 20 %, resistance above; met by cells of the slope's logarithm."""
    near, reach = 0.2, 1.0 + 0.2 / 2
    width = math.log(reach / (2 - reach)) + 1e-9  # the widest ratio of two such slopes
    cell = F.floor(F.log(F.abs("slope")) / width)
    sloped = lines.filter("slope <> 0").withColumn("_sign", F.signum("slope"))
    own = ("slope", "intercept", "strength", "start_idx", "end_idx")
    up = sloped.filter("line_type = 'resistance'").select(*SERIES, "_sign", cell.alias("_cell"), F.struct(*own).alias("u"))
    low = sloped.filter("line_type = 'support'").select(*SERIES, "_sign", F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"), F.struct(*own).alias("w"))
    a, b = F.col("u.slope"), F.col("w.slope")
    fit = (F.abs(a - b) / ((F.abs(a) + F.abs(b)) / 2) < near) & (F.col("u.intercept") > F.col("w.intercept"))
    return up.join(low, [*SERIES, "_sign", "_cell"]).filter(fit).select(
        *SERIES, a.alias("upper_slope"), F.col("u.intercept").alias("upper_intercept"), b.alias("lower_slope"), F.col("w.intercept").alias("lower_intercept"),
        (F.col("u.intercept") - F.col("w.intercept")).alias("width"), F.greatest("u.start_idx", "w.start_idx").alias("start_idx"),
        F.least("u.end_idx", "w.end_idx").alias("end_idx"), ((F.col("u.strength") + F.col("w.strength")) / 2).alias("strength"))
