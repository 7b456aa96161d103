"""Exact k-means on integer vectors, with N-simplex bounds in front of the exact comparison.

Some pivots are drawn from the vectors. The distances between them fix a simplex, and a vector's distances to them fix its apex over that
simplex: coordinates by a triangular system, and an altitude. Distances to pivots are computed once and only apexes are kept. For
two apexes the Euclidean distance is a lower bound of the distance of their vectors, and that with one altitude mirrored an upper
bound. A round computes the centroids' apexes, and for each vector drops every centroid whose lower bound exceeds the
least upper bound by more than the rounding can explain; what is left is compared by exact squared distances of integers.

Vectors live in a table in the shared folder. A round is one pass: tasks return sums of components by cluster, in limbs of
40 bits that Spark adds up, so only clusters x components numbers reach the driver, which makes the next centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored

SCALE, SEED, CLUSTERS, ROUNDS, SIZE = 1024, 3, 8, 10, 64
PIVOTS = 16
#: Vectors, the first by hash, among which pivots are chosen far apart.
PIVOT_SAMPLE = 64
#: A pivot's altitude over those before it, in parts of the first distance, at least.
LEAST_ALTITUDE = 1e-2
#: Slack of the bounds in parts of the distances that they come from: far above the rounding of apexes.
SLACK = 1e-5
#: Components up to this are narrow: squared distances of narrow vectors fit 64 bits for up to 2^7 components.
NARROW = 1 << 27
LIMB = 40


class Apexes:
    """Apexes over the simplex of pivots, computed from distances alone."""

    def __init__(self, sample: list[list[int]], pivots: int = PIVOTS):
        x = np.array(sample, float).reshape(len(sample), len(sample[0]) if sample else 0)
        chosen: list[int] = [0] if len(x) else []
        altitude = ((x - x[0]) ** 2).sum(axis=1) if len(x) else np.empty(0)
        rest, first = (x - x[0] if len(x) else x), None
        while chosen and len(chosen) < min(pivots, len(x)):
            k = int(np.argmax(altitude))
            first = first or math.sqrt(altitude[k])
            if not first or math.sqrt(altitude[k]) < LEAST_ALTITUDE * first:
                break
            chosen.append(k)
            axis = rest[k] / np.linalg.norm(rest[k])
            rest = rest - np.outer(rest @ axis, axis)
            altitude = (rest**2).sum(axis=1)
        self.pivots = [sample[k] for k in chosen]
        p = x[chosen]
        self.squares = ((p[1:] - p[0]) ** 2).sum(axis=1) if len(p) else np.empty(0)
        gram = (p[1:] - p[0]) @ (p[1:] - p[0]).T if len(p) else np.empty((0, 0))
        self.base = np.linalg.cholesky(gram) if len(gram) else gram

    def of(self, x: np.ndarray) -> np.ndarray:
        """Apex of each narrow vector; the last two columns are its altitude and its distance to the first pivot."""
        d = np.stack([squared(x, p) for p in self.pivots], axis=1).astype(float) if self.pivots else np.zeros((len(x), 1))
        y = np.zeros((len(x), len(self.base)))
        for i, row in enumerate(self.base):  # forward substitution, one pivot after the other
            y[:, i] = ((d[:, 0] + self.squares[i] - d[:, i + 1]) / 2 - (y[:, :i] * row[:i]).sum(axis=1)) / row[i]
        high = np.sqrt(np.maximum(d[:, 0] - (y**2).sum(axis=1), 0))
        return np.concatenate([y, high[:, None], np.sqrt(d[:, :1])], axis=1)


def squared(x: np.ndarray, c: list[int]) -> np.ndarray:
    """Exact squared distances of integer vectors to one: 64-bit integers, or Python's where one side is wide."""
    if x.dtype == object or max(map(abs, c), default=0) > NARROW or len(c) > 128:
        return ((x.astype(object) - np.array(c, object)) ** 2).sum(axis=1)
    return ((x - np.array(c, np.int64)) ** 2).sum(axis=1)


def nearest(x: np.ndarray, apex: np.ndarray | None, centroids: list[list[int]], apexes: Apexes) -> tuple[np.ndarray, list[int], int]:
    """Nearest centroid of each vector, the exact squared distance to it, and how many exact comparisons this took."""
    n, k = len(x), len(centroids)
    narrow = [i for i, c in enumerate(centroids) if max(map(abs, c), default=0) <= NARROW]
    open_ = np.ones((n, k), bool)
    if apex is not None and narrow and apexes.pivots:
        own = apexes.of(np.array([centroids[i] for i in narrow], np.int64))
        flat = ((apex[:, None, :-2] - own[None, :, :-2]) ** 2).sum(axis=2)
        lower = np.sqrt(flat + (apex[:, None, -2] - own[None, :, -2]) ** 2)
        upper = np.sqrt(flat + (apex[:, None, -2] + own[None, :, -2]) ** 2)
        slack = SLACK * (apex[:, None, -1] + own[None, :, -1] + 1)
        open_[:, narrow] = lower - slack <= (upper + slack).min(axis=1, keepdims=True)
    best = np.full(n, -1, np.int64)
    least = np.zeros(n, object if x.dtype == object or len(narrow) < k or x.shape[1] > 128 else np.int64)
    for i, c in enumerate(centroids):
        rows = np.flatnonzero(open_[:, i])
        d = squared(x[rows], c)
        closer = (best[rows] < 0) | (d < least[rows])
        best[rows[closer]], least[rows[closer]] = i, d[closer]
    return best, least.tolist(), int(open_.sum())


def _integer(x: float, scale: int) -> int:
    """floor(scale * x) without overflow."""
    return int(x) * scale if abs(x) >= 1 << 60 else math.floor(x * scale)


def _integers(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id, x (narrow components as bytes), wide (others as text) of the kept vectors."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.asarray(batch.column(1).flatten()).astype(np.float64).reshape(-1, size)
            small = (np.abs(raw) < NARROW // scale).all(axis=1)
            cells = [None] * len(raw)
            for i in np.flatnonzero(small):
                cells[i] = np.floor(raw[i] * scale).astype("<i4").tobytes()
            texts = [None if s else ",".join(str(_integer(v, scale)) for v in raw[i].tolist()) for i, s in enumerate(small)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pa.array(texts, pa.string())], names=["vec_id", "x", "wide"])

    return vectors.mapInArrow(turn, "vec_id long, x binary, wide string")


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their components: the narrow ones in one array, the wide ones in another."""
    wide = batch.column("wide")
    narrow = np.asarray(wide.is_null())
    rows = np.flatnonzero(narrow)
    if len(rows):
        yield rows, np.frombuffer(b"".join(batch.column("x").take(pa.array(rows)).to_pylist()), "<i4").reshape(len(rows), -1).astype(np.int64)
    rows = np.flatnonzero(~narrow)
    if len(rows):
        yield rows, np.array([[int(v) for v in wide[int(i)].as_py().split(",")] for i in rows], object)


def _apex_of(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    if x.dtype == object:
        return None
    return np.frombuffer(b"".join(batch.column("apex").take(pa.array(rows)).to_pylist()), "<f8").reshape(len(rows), -1)


def _sums(table: DataFrame, centroids: list[list[int]], apexes: Apexes) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Vectors of each cluster, and exact sums of their components."""
    k, size = len(centroids), len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [[0] * size for _ in range(k)], np.zeros(k, np.int64)
        for batch in batches:
            for rows, x in _groups(batch):
                best, _, _ = nearest(x, _apex_of(batch, rows, x), centroids, apexes)
                for c in np.unique(best).tolist():
                    count[c] += int((best == c).sum())
                    total[c] = [a + int(b) for a, b in zip(total[c], x[best == c].sum(axis=0), strict=True)]
        out = []
        for c in np.flatnonzero(count).tolist():
            out.append((c, -1, 0, int(count[c])))
            for i, v in enumerate(total[c]):
                limb = 0
                while v not in (0, -1):  # the last limb carries the sign
                    out.append((c, i, limb, v & ((1 << LIMB) - 1)))
                    v, limb = v >> LIMB, limb + 1
                if v:
                    out.append((c, i, limb, v))
        cells = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(a), t) for a, t in zip(cells, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "i", "limb", "v"])

    parts = table.mapInArrow(add, "cluster int, i int, limb int, v long").groupBy("cluster", "i", "limb").agg(F.sum("v").alias("v")).collect()
    counts, sums = {}, {}
    for r in parts:
        if r["i"] < 0:
            counts[r["cluster"]] = r["v"]
        else:
            sums.setdefault(r["cluster"], [0] * size)[r["i"]] += r["v"] << (LIMB * r["limb"])
    return counts, {c: sums.get(c, [0] * size) for c in counts}


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors that are null, hold a null or non-finite component or have another number of components are not kept and not
    returned. Seeds are the vectors with the smallest hash of their id; ties of repeated ids go to the vector that sorts first, and a null
    id comes last. With fewer vectors than clusters there are as many clusters as vectors. Equal rows are each clustered. Squared
    distances and their sums that a long cannot hold are null; assignments and centroids are exact all the same. No vectors, no
    rows; other columns are not carried.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.where(F.coalesce((F.size("v") == size) & finite, F.lit(False)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = valid.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(max(clusters, PIVOT_SAMPLE)).collect()
    seeds = [[_integer(x, scale) for x in r["v"]] for r in first]
    centroids = seeds[:clusters]
    apexes = Apexes([v for v in seeds if max(map(abs, v), default=0) <= NARROW])

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[bytes | None] = [None] * batch.num_rows
            for at, x in _groups(batch):
                if x.dtype != object:
                    for i, a in zip(at.tolist(), apexes.of(x).astype("<f8"), strict=True):
                        cells[i] = a.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("vec_id", "x", "wide")] + [pa.array(cells, pa.binary())], names=["vec_id", "x", "wide", "apex"])

    table = stored(_integers(valid, size, scale).mapInArrow(cache, "vec_id long, x binary, wide string, apex binary"), "apexes")
    for _ in range(rounds if centroids else 0):
        counts, sums = _sums(table, centroids, apexes)
        centroids = [[s // counts[c] for s in sums[c]] if c in counts else old for c, old in enumerate(centroids)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, least = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for at, x in _groups(batch):
                own, distance, _ = nearest(x, _apex_of(batch, at, x), centroids, apexes)
                best[at] = own
                for i, d in zip(at.tolist(), distance, strict=True):
                    least[i] = d if d < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best), pa.array(least, pa.int64())], names=["vec_id", "cluster", "distance"])

    placed = stored(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    whole = lambda v: v if v is not None and v < 1 << 63 else None
    sums = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    inertia = {c: whole(int(r["s"])) if not r["lost"] else None for c, r in sums.items()}
    total = whole(sum(inertia.values())) if None not in inertia.values() else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return placed.select(
        "vec_id", "cluster", "distance", pick([inertia.get(c) for c in range(max(len(centroids), 1))], "long").alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"), pick(shas, "string").alias("centroid_sha256"),
    )
