"""Near-duplicate embeddings by collision counting.

Unit vectors are projected on PROJECTIONS random directions. For vectors at the least cosine the difference of a projection is
normal with variance 2 - 2 cos, so the chance of a collision (the other's projection lies in the window around one's own) is
known, and the count that a linked pair misses with a chance of MISS is a quantile of a binomial distribution. Vectors are
sorted by the first projection and cut into blocks; blocks whose windows on it overlap are compared: collisions are counted for
each pair of vectors on 8-bit projections, and pairs that reach the count are verified by their cosine in double precision.

Equal vectors are one, with a multiplicity, before this. A task returns, for each vector, its number of links and an
edge to the smallest vector it found connected: never a row for each pair. The tables shuffled are blocks of vectors. In
a window on one random direction lies a fixed share of all unit vectors, so the number of block pairs, and the counting, grow
with the square of the number of different vectors; a block pair takes 10 ms of one core.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored
from tickloom.llm.components import components

PROJECTIONS = 24
#: Half width of the window, and that of the first projection, by which blocks meet, in units of its standard deviation.
WINDOW, REACH = 0.6, 5.0
#: Chance that a pair at the least cosine stays below the count.
MISS = 1e-6
BLOCK, TILE = 2048, 256
#: Steps of the 8-bit projections in one unit.
STEPS = 32

BLOCKS = "dim int, block long, low double, high double, ids binary, copies binary, vectors binary, codes binary"


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(20260104 + dim).standard_normal((dim, PROJECTIONS))


def least_count(cos: float) -> int:
    """The largest count that a pair at this cosine misses with a chance of at most MISS."""
    p = erf(WINDOW / sqrt(2 - 2 * cos) / sqrt(2))
    below, t = 0.0, 0
    while below + (step := comb(PROJECTIONS, t) * p**t * (1 - p) ** (PROJECTIONS - t)) <= MISS:
        below, t = below + step, t + 1
    return t


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square under- or overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projected(vectors: DataFrame) -> DataFrame:
    """id, copies, dim, p (first projection), vector and codes (8-bit projections) as bytes, of valid vectors."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                raw = np.asarray(lists.take(pa.array(rows)).flatten()).reshape(len(rows), dim)
                p = _unit(raw) @ directions(int(dim))
                codes = np.clip(np.round(p * STEPS), -127, 127).astype(np.int8).view(np.uint8)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(rows), dim, np.int32)), pa.array(p[:, 0]),
                     pa.array([v.tobytes() for v in raw.astype("<f8")], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["id", "copies", "dim", "p", "vector", "codes"])

    return vectors.select("id", "copies", "v").mapInArrow(project, "id long, copies long, dim int, p double, vector binary, codes binary")


def _blocks(projected: DataFrame, single: bool) -> DataFrame:
    kind = "<f4" if single else "<f8"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, copies, dims, p, vectors, codes = zip(*rows, strict=True)
            raw = np.frombuffer(b"".join(vectors), "<f8").astype(kind)
            cells = [
                pa.array([dims[0]], pa.int32()), pa.array([ids[0]], pa.int64()), pa.array([p[0]]), pa.array([p[-1]]),
                *[pa.array([x], pa.binary()) for x in (np.array(ids, "<i8").tobytes(), np.array(copies, "<i8").tobytes(), raw.tobytes(), b"".join(codes))],
            ]
            return pa.RecordBatch.from_arrays(cells, names=["dim", "block", "low", "high", "ids", "copies", "vectors", "codes"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if rows and (len(rows) == BLOCK or row[2] != rows[0][2]):
                    yield block()
                    rows = []
                rows.append(row)
        if rows:
            yield block()

    ordered = projected.repartitionByRange("dim", "p").sortWithinPartitions("dim", "p", "id")
    return ordered.mapInArrow(cut, BLOCKS)


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of u and v in an array of parents: smaller positions win."""
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _links(pairs: DataFrame, cos: float, single: bool) -> DataFrame:
    """id, links (with multiplicity), root (smallest id found connected, null for itself) of vectors with links."""
    kind, least = ("<f4" if single else "<f8"), least_count(cos)
    width = np.uint8(int(np.ceil(WINDOW * STEPS)) + 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                dim, same = row["dim"], row["a"] == row["b"]
                ids = [np.frombuffer(row[s + "ids"], "<i8") for s in "ab"]
                weight = [np.frombuffer(row[s + "copies"], "<i8") for s in "ab"]
                x, y = (_unit(np.frombuffer(row[s + "vectors"], kind).reshape(-1, dim)) for s in "ab")
                cx, cy = (np.ascontiguousarray(np.frombuffer(row[s + "codes"], np.uint8).reshape(-1, PROJECTIONS).T) for s in "ab")
                n, m = len(x), len(y)
                everyone = np.concatenate(ids)
                order = np.argsort(everyone, kind="stable")  # positions in order of ids, so that the smallest wins
                place = np.empty(n + m, np.int64)
                place[order] = np.arange(n + m)
                label, links = np.arange(n + m), np.zeros(n + m, np.int64)
                if same:
                    place[n:] = place[:n]
                for t in range(0, n, TILE):
                    e = min(t + TILE, n)
                    count = np.zeros((e - t, m), np.uint8)
                    for j in range(PROJECTIONS):
                        gap = cx[j, t:e, None] - (cy[j][None, :] - width)
                        count += gap <= width * np.uint8(2)
                    some = count >= least
                    if same:
                        some &= np.arange(t, e)[:, None] < np.arange(m)[None, :]
                    i, j = np.nonzero(some)
                    if not len(i):
                        continue
                    if len(i) > some.size // 50:
                        sure = (x[t:e] @ y.T)[i, j] >= cos
                    else:
                        sure = np.einsum("ij,ij->i", x[t + i], y[j]) >= cos
                    i, j = t + i[sure], j[sure]
                    if len(i):
                        links[:n] += np.bincount(i, weights=weight[1][j], minlength=n).astype(np.int64)
                        back = np.bincount(j, weights=weight[0][i], minlength=m).astype(np.int64)
                        if same:
                            links[:n] += back
                        else:
                            links[n:] += back
                        _merge(label, place[i], place[n + j])
                found = np.flatnonzero(links)
                root = everyone[order][label[place[found]]]
                yield pa.RecordBatch.from_arrays([pa.array(everyone[found]), pa.array(links[found]), pa.array(root, mask=root == everyone[found])], names=["id", "links", "root"])

    return pairs.mapInArrow(compare, "id long, links long, root long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cos: float = 0.95) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable, its own included), kept, for each row.

    Vectors that are null, empty, zero, or hold a null, NaN or infinite component link with nothing, and so do rows
    with a null id. Vectors of different lengths never link. Rows with equal vectors link with each other; an id that
    repeats with different vectors is one node with the links of all of them. No rows, no result rows; other columns are not
    carried.
    """
    single = vectors.schema[column].dataType.elementType.typeName() == "float"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    groups = stored(rows.where(valid).groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    projected = stored(_projected(groups), "projections")
    blocks = stored(_blocks(projected, single), "blocks")
    # blocks meet by cells on the first projection: a block covers those of its range, and the next for its reach
    reach = REACH * sqrt(2 - 2 * cos)
    ends = blocks.select("dim", "block", "low", "high")
    cell = lambda c: F.floor(F.col(c) / reach)
    own = ends.select("dim", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(cell("low"), cell("high") + 1)).alias("cell"))
    other = ends.select("dim", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell("low"), cell("high") + 1)).alias("cell"))
    near = (F.col("low_b") - F.col("high_a") <= reach) & (F.col("low_a") - F.col("high_b") <= reach)
    pairs = stored(own.join(other, ["dim", "cell"]).where((F.col("a") <= F.col("b")) & near).select("dim", "a", "b").distinct(), "block-pairs")
    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(s + c) for c in ("ids", "copies", "vectors", "codes")])
    tested = stored(_links(pairs.join(side("a"), "a").join(side("b"), "b"), cos, single), "links")
    counts = tested.groupBy("id").agg(F.sum("links").alias("links"))
    found = stored(components(tested.where("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v"))), "components")
    alike = stored(groups.where("copies > 1"), "equal")
    out = rows.withColumn("valid", valid).join(alike.select("v", F.col("id").alias("lead"), "copies"), "v", "left")
    out = out.select("vec_id", F.when(F.col("valid"), F.coalesce("lead", "vec_id")).alias("id"), F.coalesce(F.when(F.col("valid"), F.col("copies") - 1), F.lit(0)).alias("equal"))
    out = out.join(counts, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", (F.col("equal") + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
