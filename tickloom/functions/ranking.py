"""Order statistics over the pairs of a series, without forming the pairs.

A pair of bars rises, falls or ties. Counting them is counting inversions, done twice over: a series is cut into blocks by
position, and its values into ranges that hold about a block's rows each.

- Pairs inside one block are counted there, by merging sorted halves.
- Pairs in different blocks and different ranges need only the blocks' counts by range: one pass over the blocks of a series, with a running
  vector of counts.
- Pairs in one range and different blocks are counted where the range's rows meet, in the order of their blocks.

A value that very many rows share is a range of its own, in which no pair rises or falls, so nothing of it is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import frames as fr
from tickloom.functions.lineage import cut_lineage
from tickloom.schemas import SERIES

#: Pairs of a series that are listed one by one; bars drawn for pivots; rounds at most.
LISTED, DRAWN, ROUNDS = 1 << 21, 1500, 40
#: Two prices on a slanted axis are equal within this part of the largest.
GRID = 2.0**-36


def balance(values: np.ndarray) -> int:
    """Rising minus falling pairs of an array in order: sorted halves are merged, all of one width at once."""
    m = len(values)
    if m < 2:
        return 0
    _, rank = np.unique(values, return_inverse=True)
    size = 1 << (m - 1).bit_length()
    top = int(rank.max()) + 2
    rows = np.full(size, top - 1, np.int64)  # padding stands behind and above all
    rows[:m] = rank
    total, width = 0, 1
    while width < size:
        rows = np.sort(rows.reshape(-1, width), axis=1)
        left, right = rows[0::2], rows[1::2]
        shift = np.arange(len(left), dtype=np.int64)[:, None] * top
        sorted_left = (left + shift).ravel()
        lower = np.searchsorted(sorted_left, (right + shift).ravel(), "left")
        upper = np.searchsorted(sorted_left, (right + shift).ravel(), "right")
        # lower counts the smaller ones before, and all of the rows above; the rest of the own row is equal or larger
        base = np.repeat(np.arange(len(left)) * width, width)
        total += int((lower - base).sum() - (base + width - upper).sum())
        width *= 2
    return total - m * (size - m)


def packed(df: DataFrame, col: str) -> DataFrame:
    """SERIES, n, blk, x (positions), v (values, nulls left out) of each series in blocks; a long series has larger ones."""
    base = fr.index_bars(df)
    size = F.greatest(F.lit(fr.block_rows_of(df.sparkSession)), F.ceil(8 * F.sqrt("n")))
    rows = base.filter(F.col(col).isNotNull()).select(*SERIES, "n", F.floor(F.col("idx") / size).alias("blk"), F.struct("idx", F.col(col).cast("double").alias("v")).alias("e"))
    lists = rows.groupBy(*SERIES, "n", "blk").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return lists.select(*SERIES, "n", "blk", F.col("e.idx").alias("x"), F.col("e.v").alias("v"))


def _array(batch: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return batch.column(name)[r].values.to_numpy(zero_copy_only=False)


def _same(batch: pa.RecordBatch, r: int, keys: list[str], times: int) -> list[pa.Array]:
    return [batch.column(k).take(pa.array([r] * times, pa.int32())) for k in keys]


def pair_counts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m (values), s (rising minus falling pairs), tied (pairs), tie_term (sum of t(t-1)(2t+5) over groups of t equal values).

    ``blocks`` has keys, blk and v, the values of a block in order.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name in keys)
    keys = [f.name for f in blocks.schema if f.name in keys]
    parts = F.count(F.lit(1)).over(fr.Window.partitionBy(*keys)).alias("parts")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v, k = np.sort(_array(batch, "v", r)), batch.column("parts")[r].as_py()
                some = v[(np.arange(1, k) * len(v)) // k] if len(v) else v
                yield pa.RecordBatch.from_arrays([*_same(batch, r, keys, 1), pa.array([k], pa.int64()), pa.array([some], pa.list_(pa.float64()))], names=[*keys, "parts", "some"])

    drawn = blocks.select(*keys, "v", parts).mapInArrow(draw, f"{schema}, parts long, some array<double>")
    drawn = drawn.groupBy(*keys).agg(F.max("parts").alias("parts"), F.array_sort(F.flatten(F.collect_list("some"))).alias("some"))
    # regular samples of sorted blocks: no range holds many more rows than two blocks
    at = F.sequence(F.col("parts") - 1, F.greatest(F.col("parts") - 1, F.size("some").cast("long") - 1), F.greatest(F.col("parts"), F.lit(1)))
    cuts = drawn.select(*keys, F.when(F.size("some") > 0, F.array_distinct(F.transform(at, lambda i: F.get("some", i.cast("int"))))).otherwise(F.array().cast("array<double>")).alias("cuts"))
    out = f"{schema}, kind int, blk long, part long, v array<double>, c array<long>, s long, m long, tied double, tie_term double"
    names = [*keys, "kind", "blk", "part", "v", "c", "s", "m", "tied", "tie_term"]

    def rows(key: list[pa.Array], k: int, kind: int, blk: list, part: list, v: list, c: list, s: list, m: list, tied: list, term: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([*key, pa.array([kind] * k, pa.int32()), *(pa.array(x, t) for x, t in zip((blk, part, v, c, s, m, tied, term), kinds, strict=True))], names=names)

    def ties(counts: np.ndarray) -> tuple[float, float]:
        t = counts.astype(float)
        return float((t * (t - 1) / 2).sum()), float((t * (t - 1) * (2 * t + 5)).sum())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v, cut, blk = _array(batch, "v", r), _array(batch, "cuts", r), batch.column("blk")[r].as_py()
                # even ranges lie between cuts, odd ones are cuts
                part = np.searchsorted(cut, v, "left") + np.searchsorted(cut, v, "right")
                found, counts = np.unique(part, return_counts=True)
                yield rows(_same(batch, r, keys, 1), 1, 0, [blk], [None], [None], [None], [balance(v)], [len(v)], [0.0], [0.0])
                yield rows(_same(batch, r, keys, 1), 1, 1, [blk], [len(cut)], [None], [np.stack([found, counts]).ravel()], [None], [0], [0.0], [0.0])
                order = np.argsort(part, kind="stable")
                cells = dict(zip(found.tolist(), np.split(v[order], np.cumsum(counts)[:-1]), strict=True))
                some = [p for p in cells if p % 2 == 0]
                if some:
                    n = len(some)
                    yield rows(_same(batch, r, keys, n), n, 2, [blk] * n, some, [cells[p] for p in some], [None] * n, [None] * n, [0] * n, [0.0] * n, [0.0] * n)

    pieces = cut_lineage(blocks.select(*keys, "blk", "v").join(cuts, keys).mapInArrow(inside, out))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, s, last = None, None, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield rows(last, 1, 3, [None], [None], [None], [None], [s], [0], *([x] for x in ties(held[1::2])))

        for batch in batches:
            for r in range(batch.num_rows):
                own = tuple(batch.column(k)[r].as_py() for k in keys)
                if own != key:
                    yield from done()
                    key, held, s, last = own, np.zeros(2 * batch.column("part")[r].as_py() + 1, np.int64), 0, _same(batch, r, keys, 1)
                found, counts = _array(batch, "c", r).reshape(2, -1)
                below = np.cumsum(held)
                s += int((counts * (below[found] - held[found] - (below[-1] - below[found]))).sum())
                held[found] += counts
        yield from done()

    ordered = pieces.filter("kind = 1").repartition(*keys).sortWithinPartitions(*keys, "blk").mapInArrow(across, out)
    ranges = pieces.filter("kind = 2").groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("blk", "v"))).alias("e")).select(*keys, F.col("e.v").alias("cells"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cells = batch.column("cells")[r].values
                of = np.diff(np.asarray(cells.offsets))
                v = cells.flatten().to_numpy(zero_copy_only=False)
                own = np.split(v, np.cumsum(of)[:-1])
                s = balance(v) - sum(balance(c) for c in own)
                yield rows(_same(batch, r, keys, 1), 1, 4, [None], [None], [None], [None], [s], [0], *([x] for x in ties(np.unique(v, return_counts=True)[1])))

    every = pieces.filter("kind = 0").unionByName(ordered).unionByName(ranges.mapInArrow(together, out))
    return every.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("tied").alias("tied"), F.sum("tie_term").alias("tie_term"))


def pair_balance(df: DataFrame, col: str) -> DataFrame:
    """Per series: its length ``n``, rising minus falling pairs ``s``, and the tie term of the variance. Nulls form no pairs."""
    blocks = packed(df, col)
    return pair_counts(blocks, [*SERIES, "n"]).select(*SERIES, "n", "s", "tie_term")


def on_slope(x: np.ndarray, v: np.ndarray, slope: float, scale: float, span: int) -> np.ndarray:
    """Values with a line of this slope taken off, in whole steps: a pair rises if its slope is greater, and ties if it is equal."""
    if np.isinf(slope):
        return -np.sign(slope) * x.astype(float)
    return np.floor((v - slope * x) / (GRID * (scale + abs(slope) * span) or 1.0) + 0.377)


def median_slope(df: DataFrame, col: str) -> DataFrame:
    """Median of the slopes of all pairs (Sen's slope), one row per series; null for fewer than two values.

    An interval around the median is narrowed: pivots are slopes of pairs among some bars drawn at random, and one pass counts exactly
    how many slopes lie below and on each. Once at most LISTED pairs lie inside, these are listed: they are the pairs whose order
    differs between the two ends of the interval, found by merging blocks that are sorted for one end and searched for the other.
    """
    blocks = cut_lineage(packed(df, col))
    # every step of the search uses one scale for a series, so that a pair is on the same side whenever it is asked
    state = blocks.groupBy(*SERIES).agg(F.sum(F.size("v")).cast("long").alias("m"), F.max(F.array_max(F.transform("v", F.abs))).alias("scale"), F.max(F.array_max("x")).alias("span"))
    pairs = F.expr("m * (m - 1) div 2")
    state = state.select(
        *SERIES, "m", "scale", "span", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), pairs.alias("upto"),
        F.expr("(m * (m - 1) div 2 - 1) div 2").alias("k1"), F.expr("(m * (m - 1) div 2) div 2").alias("k2"), F.lit(None).cast("double").alias("v1"), F.lit(None).cast("double").alias("v2"))
    state = cut_lineage(state.filter("m > 1"))
    wide = (F.col("upto") - F.col("below") > LISTED) & (F.col("v1").isNull() | F.col("v2").isNull())
    for turn in range(ROUNDS):
        if not state.filter(wide).limit(1).count():
            break
        state = cut_lineage(_narrowed(blocks, state, wide, turn))
    listed = _listed(blocks, state)
    out = state.join(listed, SERIES, "left").select(*SERIES, F.coalesce("v1", "w1").alias("a"), F.coalesce("v2", "w2").alias("b"))
    series = blocks.select(*SERIES).distinct()
    return series.join(out, SERIES, "left").select(*SERIES, ((F.col("a") + F.col("b")) / 2).alias("sen_slope"))


def _narrowed(blocks: DataFrame, state: DataFrame, wide, turn: int) -> DataFrame:
    active = state.filter(wide)
    k = F.when(F.col("v1").isNull(), F.col("k1")).otherwise(F.col("k2"))
    share = ((k - F.col("below") + 0.5) / (F.col("upto") - F.col("below"))).alias("share")
    bars = blocks.join(active.select(*SERIES, "m"), SERIES).select(*SERIES, F.explode(F.arrays_zip("x", "v")).alias("e"), "m")
    luck = F.pmod(F.xxhash64("symbol", "timeframe", "e.x", F.lit(turn)), F.col("m"))
    drawn = bars.filter(luck < DRAWN).groupBy(*SERIES).agg(F.array_sort(F.collect_list("e")).alias("e"))
    drawn = drawn.select(*SERIES, F.col("e.x").alias("x"), F.col("e.v").alias("v")).join(active.select(*SERIES, "lo", "hi", share), SERIES)

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, v = _array(batch, "x", r), _array(batch, "v", r)
                lo, hi, of = (batch.column(c)[r].as_py() for c in ("lo", "hi", "share"))
                i, j = np.triu_indices(len(x), 1)
                slopes = (v[j] - v[i]) / (x[j] - x[i])
                slopes = np.sort(slopes[(slopes > lo) & (slopes < hi)])
                if len(slopes):
                    off = 1.5 / np.sqrt(min(len(slopes), DRAWN))
                    at = np.clip(np.array([of - off, of, of + off]) * len(slopes), 0, len(slopes) - 1).astype(int)
                    found = np.unique(slopes[at])
                else:  # too few slopes inside to meet one: halve the interval
                    found = np.array([lo / 2 + hi / 2]) if np.isfinite([lo, hi]).all() else np.array([0.0])
                yield pa.RecordBatch.from_arrays([*_same(batch, r, SERIES, len(found)), pa.array(found)], names=[*SERIES, "pivot"])

    tried = drawn.mapInArrow(pivots, "symbol string, timeframe string, pivot double").join(active.select(*SERIES, "scale", "span"), SERIES)

    def slanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                z = on_slope(_array(batch, "x", r), _array(batch, "v", r), *(batch.column(c)[r].as_py() for c in ("pivot", "scale", "span")))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(r, 1) for c in (*SERIES, "pivot", "blk")] + [pa.array([z], pa.list_(pa.float64()))], names=[*SERIES, "pivot", "blk", "v"])

    counts = pair_counts(blocks.join(tried, SERIES).mapInArrow(slanted, "symbol string, timeframe string, pivot double, blk long, v array<double>"), [*SERIES, "pivot"])
    # slopes below the pivot fall, equal ones tie
    each = counts.select(*SERIES, "pivot", F.expr("(m * (m - 1) div 2 - cast(tied as long) - s) div 2").alias("under"), F.col("tied").cast("long").alias("on"))
    tests = each.groupBy(*SERIES).agg(F.collect_list(F.struct("pivot", "under", "on")).alias("tests"))
    s = state.join(tests, SERIES, "left").withColumn("tests", F.coalesce("tests", F.array().cast("array<struct<pivot:double,under:long,on:long>>")))
    hit = lambda c: F.get(F.filter("tests", lambda t: (t["under"] <= F.col(c)) & (F.col(c) < t["under"] + t["on"])), F.lit(0))["pivot"]
    s = s.withColumns({"v1": F.coalesce("v1", hit("k1")), "v2": F.coalesce("v2", hit("k2"))})
    first, last = F.when(F.col("v1").isNull(), F.col("k1")).otherwise(F.col("k2")), F.when(F.col("v2").isNull(), F.col("k2")).otherwise(F.col("k1"))
    low = F.array_max(F.transform(F.filter("tests", lambda t: t["under"] + t["on"] <= first), lambda t: F.struct(t["pivot"].alias("p"), (t["under"] + t["on"]).alias("n"))))
    high = F.array_min(F.transform(F.filter("tests", lambda t: t["under"] > last), lambda t: F.struct(t["pivot"].alias("p"), t["under"].alias("n"))))
    s = s.withColumns({"_low": low, "_high": high})
    return s.withColumns({
        "lo": F.coalesce("_low.p", "lo"), "below": F.coalesce("_low.n", "below"), "hi": F.coalesce("_high.p", "hi"), "upto": F.coalesce("_high.n", "upto"),
    }).drop("tests", "_low", "_high")


def _listed(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """w1, w2 of each series: the slopes of ranks k1 and k2, from those between lo and hi."""
    open_ = state.filter("v1 is null or v2 is null")
    ends = open_.select(*SERIES, "scale", "span", "lo", "hi")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, v = _array(batch, "x", r), _array(batch, "v", r)
                lo, hi, *sizes = (batch.column(c)[r].as_py() for c in ("lo", "hi", "scale", "span"))
                cells = [pa.array(c) for c in (x, v, on_slope(x, v, lo, *sizes), on_slope(x, v, hi, *sizes))]
                yield pa.RecordBatch.from_arrays([*_same(batch, r, SERIES, len(x)), *cells], names=[*SERIES, "x", "v", "z", "w"])

    rows = blocks.join(ends, SERIES).mapInArrow(both, "symbol string, timeframe string, x long, v double, z double, w double")
    # positions in the order of the lower end, cut into blocks
    ranked = rows.repartitionByRange(*SERIES, "z", "x").sortWithinPartitions(*SERIES, "z", "x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [c.to_pylist() for c in (batch.column(0), batch.column(1))]
            edge = [0] + [i for i in range(1, batch.num_rows) if (key[0][i], key[1][i]) != (key[0][i - 1], key[1][i - 1])] + [batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                for k in range(a, b, 4096):
                    part = batch.slice(k, min(4096, b - k))
                    x, v, z, w = (part.column(c).to_numpy() for c in range(2, 6))
                    cells = [pa.array([c], pa.list_(t)) for c, t in ((x, pa.int64()), (v, pa.float64()), (z, pa.float64()), (w, pa.float64()))]
                    bounds = [pa.array([c]) for c in (z[0], z[-1], w.min(), w.max())]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), part.column(1).slice(0, 1), pa.array([int(x[0])], pa.int64()), *bounds, *cells],
                                                     names=[*SERIES, "head", "z0", "z1", "w0", "w1", "x", "v", "z", "w"])

    bag = cut_lineage(ranked.mapInArrow(cut, "symbol string, timeframe string, head long, z0 double, z1 double, w0 double, w1 double, x array<long>, v array<double>, z array<double>, w array<double>"))
    side = lambda s: bag.select(*SERIES, *[F.col(c).alias(s + c) for c in ("head", "z0", "z1", "w0", "w1")])
    meet = side("a_").join(side("b_"), SERIES).filter("(a_z0, a_z1, a_head) <= (b_z0, b_z1, b_head) and a_w1 > b_w0").select(*SERIES, "a_head", "b_head")
    data = lambda s: bag.select(*SERIES, F.col("head").alias(s + "_head"), *[F.col(c).alias(s + c) for c in ("x", "v", "z", "w")])
    meet = meet.join(data("a"), [*SERIES, "a_head"]).join(data("b"), [*SERIES, "b_head"])

    def flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                xa, va, za, wa, xb, vb, zb, wb = (_array(batch, s + c, r) for s in "ab" for c in "xvzw")
                same = batch.column("a_head")[r].as_py() == batch.column("b_head")[r].as_py()
                order = np.argsort(wb, kind="stable")
                n = np.searchsorted(wb[order], wa, "left")  # those below at the upper end
                found = []
                for k in range(0, len(xa), 256):
                    of = n[k : k + 256]
                    i = np.repeat(np.arange(k, k + len(of)), of)
                    j = order[np.arange(int(of.sum())) - np.repeat(np.cumsum(of) - of, of)]
                    up = za[i] < zb[j]
                    if same:
                        up &= i != j
                    i, j = i[up], j[up]
                    found.append((vb[j] - va[i]) / (xb[j] - xa[i]))
                slopes = np.concatenate(found)
                if len(slopes):
                    yield pa.RecordBatch.from_arrays([*_same(batch, r, SERIES, 1), pa.array([slopes], pa.list_(pa.float64()))], names=[*SERIES, "slopes"])

    slopes = meet.mapInArrow(flipped, "symbol string, timeframe string, slopes array<double>").groupBy(*SERIES).agg(F.flatten(F.collect_list("slopes")).alias("slopes"))
    asked = slopes.join(open_.select(*SERIES, "below", "k1", "k2"), SERIES)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v, below, k1, k2 = _array(batch, "slopes", r), *(batch.column(c)[r].as_py() for c in ("below", "k1", "k2"))
                at = [k - below if 0 <= k - below < len(v) else None for k in (k1, k2)]
                part = np.partition(v, [a for a in at if a is not None]) if any(a is not None for a in at) else v
                yield pa.RecordBatch.from_arrays([*_same(batch, r, SERIES, 1), *(pa.array([None if a is None else float(part[a])], pa.float64()) for a in at)], names=[*SERIES, "w1", "w2"])

    return asked.mapInArrow(choose, "symbol string, timeframe string, w1 double, w2 double")
