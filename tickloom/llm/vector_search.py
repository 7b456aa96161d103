"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one priority queue over all of them.

1. Equal vectors are one class, which carries its few smallest ids. A bounded sample of classes fits the trees: a node's plane is the
   direction between two random vectors of the node, cut at the median. Every class is then filed under a leaf of each tree.
2. Leaves are gathered in spans of consecutive ones that hold some MB of vectors; a leaf of more is a span in several parts.
3. A query opens leaves in the order of one queue over all trees: a leaf's rank is the sum of the squared margins by which the query
   lies on the other side of the planes above it. It stops when the opened leaves hold `budget` vectors.
4. The budget is calibrated at each run, on all rows: PILOTS queries are answered exactly, and the budget is the least that finds the share
   RECALL of their neighbours. It is a share of the data where vectors have no near neighbours, and some leaves where they have.
5. Vectors and queries meet in cells: a span's part with those queries that opened a leaf of the span; where they are many, the span's
   vectors go to several cells and its queries are dealt out to them. A task holds the vectors of one cell, sorted by leaf, and the queries
   stream past in blocks: exact cosines, of which the best few of each query are kept.

The trees, the leaves' sizes and the pilots have a bounded size, and so has all that a task holds at a time: leaves opened by some
queries, a cell's vectors, a block of queries and its scores, what is kept of them. With more than SAMPLE / 4 x LEAF vectors the leaves
grow, and so do the comparisons of a query, in proportion; recall stays calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import U64, discard, mixed, stored

TREES, LEAF, SAMPLE = 4, 64, 65_536
PILOTS, RECALL = 256, 0.97
#: Vectors of a span at least, unless HELD bytes of them are fewer; queries of a block, scores of one product, and numbers in one copy.
BIN, BLOCK, SLAB, NUMBERS = 4096, 4096, 1 << 20, 1 << 19
#: Bytes of a cell's vectors, and of rows that are sent at once.
HELD, SENT = 32 << 20, 4 << 20
#: Spans for each core at least, as far as BIN allows; a cell may have one part in so many of a core's work, and this many products anyway.
SPANS, SHARES, WORK = 4, 2, 1 << 34
#: Partitions of the cells at most.
CELLS = 20_000
#: Preliminary scores nearer than this are told apart by the exact ones.
ROUNDING = 1e-9

#: Numbers of a sample, and the order that draws it.
SAMPLE_NUMBERS = 1 << 22
DRAWN = ("xxhash64(ids)", "ids")

#: Stands for the leaf of queries, which come after the vectors of their cell.
ASKS = 1 << 62
MET = "cell long, leaf long, id long, first binary, v binary"


class Tree:
    """A complete binary tree of planes: children of node k are 2k + 1 and 2k + 2, leaves follow the last plane."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth, self.planes, self.cuts = depth, np.zeros(((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1)
        groups = {0: np.arange(len(x))}
        for k in range(len(self.cuts)):
            own = groups.pop(k)
            a, b = x[rng.choice(own, 2, replace=len(own) < 2)] if len(own) else rng.standard_normal((2, x.shape[1]))
            plane = a - b if np.abs(a - b).max() > 1e-12 else rng.standard_normal(x.shape[1])
            self.planes[k] = plane / np.linalg.norm(plane)
            side = (x[own] * self.planes[k]).sum(axis=1)
            self.cuts[k] = np.median(side) if len(own) else 0.0
            groups[2 * k + 1], groups[2 * k + 2] = own[side <= self.cuts[k]], own[side > self.cuts[k]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,kj->ik", x, self.planes) - self.cuts  # no threads of a matrix library in the driver

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """Of each vector and leaf, the sum of the squared margins of the planes that part them."""
        margins, out = self.margins(x), np.zeros((len(x), 1))
        for d in range(self.depth):
            m = margins[:, (1 << d) - 1 : (2 << d) - 1]
            below = np.empty((len(x), 2 << d))
            below[:, 0::2], below[:, 1::2] = out + np.where(m > 0, m * m, 0.0), out + np.where(m > 0, 0.0, m * m)
            out = below
        return out

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for s in range(0, len(x), 4096):
            part = x[s : s + 4096]
            node = np.zeros(len(part), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((part * self.planes[node]).sum(axis=1) > self.cuts[node])
            out[s : s + 4096] = node - len(self.cuts)
        return out


class Forest:
    """Trees over vectors of one length; leaves are numbered through all of them."""

    def __init__(self, x: np.ndarray, vectors: int, trees: int, seed: int = 20261201):
        depth = max(0, int(np.ceil(np.log2(max(1, vectors) / LEAF)))) if vectors > LEAF else 0
        depth = min(depth, max(0, int(np.log2(max(1, len(x)) / 4))))
        rng = np.random.default_rng(seed + x.shape[1])
        self.trees = [Tree(x, depth, rng) for _ in range(trees)]
        self.each = 1 << depth

    @property
    def leaves(self) -> int:
        return self.each * len(self.trees)

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaves of each vector, a column for each tree."""
        return np.stack([t.leaf(x) + k * self.each for k, t in enumerate(self.trees)], axis=1)

    def opened(self, x: np.ndarray, sizes: np.ndarray, budget: float) -> Iterator[np.ndarray]:
        """For each query the leaves that hold vectors, in the queue's order, until they hold `budget` of them."""
        full = np.flatnonzero(sizes)
        for s in range(0, len(x), step := max(1, SLAB // self.leaves)):
            part = x[s : s + step]
            order = full[np.argsort(np.concatenate([t.ranks(part) for t in self.trees], axis=1)[:, full], axis=1, kind="stable")]
            for leaves in order:
                yield leaves[: np.searchsorted(np.cumsum(sizes[leaves]), budget) + 1].copy()


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square under- or overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; each depends on its two rows alone."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _lists(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _classes(rows: DataFrame, few: int, asked: Column) -> DataFrame:
    """id (a number of its own), ids (the smallest few rows with the vector), dim, v, asked (one of them is a query) of distinct vectors."""
    own = rows.groupBy("v", "vec_id").agg(F.max(asked).alias("asked"))
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = own.select("v", "vec_id").withColumn("turn", first).where(F.col("turn") <= few).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked_ones = own.where("asked").select("v").distinct().withColumn("asked", F.lit(True))
    return ids.join(asked_ones, "v", "left").select(F.monotonically_increasing_id().alias("id"), "ids", F.size("v").alias("dim"), "v", F.coalesce("asked", F.lit(False)).alias("asked"))


def _slices(batch: pa.RecordBatch, leaves: dict[int, int] | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows with vectors of one length each, few enough for copies of them and, if the number of leaves is given, for a flag of each."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        for s in range(0, len(own), step := max(1, min(NUMBERS // dim, 16 * SLAB // leaves[dim] if leaves else NUMBERS))):
            yield dim, batch.take(pa.array(own[s : s + step]))


def _cells_of(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of each row, which all have as many."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _filed(classes: DataFrame, forests: dict[int, Forest], base: dict[int, int]) -> DataFrame:
    """Classes with their leaves, one of each tree."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _slices(batch):
                leaves = forests[dim].file(unit(_lists(own.column("v"), dim))) + base[dim]
                offsets = np.arange(len(leaves) + 1, dtype=np.int32) * np.int32(leaves.shape[1])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves.ravel()))], names=[*own.schema.names, "leaves"])

    return classes.mapInArrow(file, "id long, ids array<long>, dim int, v array<" + classes.schema["v"].dataType.elementType.simpleString() + ">, asked boolean, leaves array<long>")


def _askers(filed: DataFrame, forests: dict[int, Forest], base: dict[int, int], sizes: np.ndarray, budgets: dict[int, float]) -> DataFrame:
    """id, dim, v, bits: queries with the leaves that they open, a bit for each leaf of their length."""

    count = {dim: f.leaves for dim, f in forests.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _slices(batch, count):
                forest = forests[dim]
                bits = np.zeros((own.num_rows, forest.leaves), bool)
                for q, leaves in enumerate(forest.opened(unit(_lists(own.column("v"), dim)), sizes[base[dim] : base[dim] + forest.leaves], budgets[dim])):
                    bits[q, leaves] = True
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("dim"), own.column("v"), _cells_of(np.packbits(bits, axis=1))], names=["id", "dim", "v", "bits"])

    return filed.where("asked").select("id", "dim", "v").mapInArrow(search, f"id long, dim int, v {filed.schema['v'].dataType.simpleString()}, bits binary")


@dataclass
class Spans:
    """Runs of leaves of one length whose vectors lie together: where each begins and ends, its parts, and its cells."""

    dim: np.ndarray
    first: np.ndarray
    end: np.ndarray
    parts: np.ndarray
    salts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, leaves: dict[int, int], base: dict[int, int], most: dict[int, int]) -> Spans:
        """most: the vectors of a part, by length."""
        rows = []
        for dim, count in leaves.items():
            begin, held = base[dim], 0
            for leaf, n in enumerate(sizes[base[dim] : base[dim] + count].tolist(), base[dim]):
                if held and held + n > most[dim]:
                    rows.append((dim, begin, leaf, -(-held // most[dim])))
                    begin, held = leaf, 0
                held += n
            rows.append((dim, begin, base[dim] + count, max(1, -(-held // most[dim]))))
        dim, first, end, parts = np.array(rows, np.int64).reshape(-1, 4).T
        return cls(dim, first, end, parts, np.ones(len(rows), np.int64))

    @property
    def cells(self) -> np.ndarray:
        """The first cell of each span, and their number."""
        return np.concatenate([[0], np.cumsum(self.parts * self.salts)])

    def dealt(self, held: np.ndarray, asked: np.ndarray, shares: int) -> None:
        """More cells for the spans whose vectors (held) and queries (asked) make more than a share of all products."""
        work = -(-held // self.parts) * asked * self.dim
        self.salts = np.maximum(1, -(-work // max(WORK, int((work * self.parts).sum()) // shares)))

    def at(self, dim: int) -> np.ndarray:
        return np.flatnonzero(self.dim == dim)

    def met(self, bits: np.ndarray, dim: int, base: int) -> np.ndarray:
        """Which spans of this length hold a leaf that is opened."""
        return np.maximum.reduceat(bits, self.first[self.at(dim)] - base, axis=1).astype(bool)


def _unpacked(column: pa.Array, leaves: int) -> np.ndarray:
    return np.unpackbits(_bytes_of(column), axis=1, count=leaves)


def _asked_of(queries: DataFrame, spans: Spans, leaves: dict[int, int], base: dict[int, int]) -> np.ndarray:
    """The number of queries that meet each span."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(spans.dim), np.int64)
        for batch in batches:
            for dim, own in _slices(batch, leaves):
                n[spans.at(dim)] += spans.met(_unpacked(own.column("bits"), leaves[dim]), dim, base[dim]).sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["span", "n"])

    out = np.zeros(len(spans.dim), np.int64)
    for r in queries.select("dim", "bits").mapInArrow(count, "span long, n long").groupBy("span").agg(F.sum("n").alias("n")).collect():
        out[r["span"]] = r["n"]
    return out


def _met(filed: DataFrame, queries: DataFrame, spans: Spans, leaves: dict[int, int], base: dict[int, int], few: int, kind: str) -> DataFrame:
    """Vectors and queries of each cell, in a partition of its own or of some cells: vectors by leaf, then queries with the bits of the span's leaves."""
    cells, of = spans.cells, np.repeat(np.arange(len(spans.dim)), spans.end - spans.first)  # spans lie without gaps

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _slices(batch):
                v = _lists(own.column("v"), dim).astype(kind)
                filed_under = np.asarray(own.column("leaves").flatten()).reshape(len(v), -1)
                id_ = np.asarray(own.column("id"))
                first = np.zeros((len(v), 1 + 8 * few), np.uint8)
                count = np.asarray(own.column("ids").value_lengths())
                ids = np.full((len(v), few), -1, "<i8")
                ids[np.arange(few)[None, :] < count[:, None]] = np.asarray(own.column("ids").flatten())
                first[:, 0], first[:, 1:] = count, ids.view(np.uint8)
                step = max(1, SENT // (v.itemsize * dim + first.shape[1]))
                for leaf in filed_under.T:
                    span = of[leaf]
                    begin = cells[span] + (mixed(id_.astype(U64)) % spans.parts[span].astype(U64)).astype(np.int64) * spans.salts[span]
                    row = np.repeat(np.arange(len(v)), spans.salts[span])
                    cell = begin[row] + np.arange(len(row)) - np.searchsorted(row, row)
                    for s in range(0, len(row), step):
                        r = row[s : s + step]
                        yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + step]), pa.array(leaf[r]), pa.array(id_[r]), _cells_of(first[r]), _cells_of(v[r])], names=["cell", "leaf", "id", "first", "v"])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _slices(batch, leaves):
                v, id_ = _lists(own.column("v"), dim).astype(kind), np.asarray(own.column("id"))
                bits = _unpacked(own.column("bits"), leaves[dim])
                met, at = spans.met(bits, dim, base[dim]), spans.at(dim)
                for k in np.flatnonzero(met.any(axis=0)).tolist():
                    span = at[k]
                    rows = np.flatnonzero(met[:, k])
                    salt = (mixed(id_[rows].astype(U64)) % U64(spans.salts[span])).astype(np.int64)
                    part = np.packbits(bits[rows, spans.first[span] - base[dim] : spans.end[span] - base[dim]], axis=1)
                    for turn in range(spans.parts[span]):
                        yield pa.RecordBatch.from_arrays([pa.array(cells[span] + turn * spans.salts[span] + salt), pa.array(np.full(len(rows), ASKS)), pa.array(id_[rows]), _cells_of(part), _cells_of(v[rows])], names=["cell", "leaf", "id", "first", "v"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small batches as larger ones."""
        some: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            some.append(batch)
            held += batch.nbytes
            if held >= SENT:
                yield pa.concat_batches(some)
                some, held = [], 0
        if some:
            yield pa.concat_batches(some)

    parts = int(max(1, min(CELLS, cells[-1])))
    rows = filed.select("id", "ids", "dim", "v", "leaves").mapInArrow(vectors, MET).union(queries.mapInArrow(lambda batches: gathered(asks(batches)), MET))
    return rows.repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", "leaf")


def best_of(q: np.ndarray, x: np.ndarray, k: int, units: tuple[np.ndarray, np.ndarray] | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row positions, and exact cosines, of each query's k best rows and all that tie with the last.

    units: q and x as unit vectors, if known. floor: scores below it are of no use; where each query has one, all others are returned.
    """
    qu, xu = units or (unit(q), unit(x))
    known = floor is not None and len(floor) and floor.min() > -2
    some_q, some_x = [], []
    for s in range(0, len(q), step := max(1, SLAB // max(1, len(x)))):
        score = qu[s : s + step] @ xu.T
        least = np.full(len(score), -2.0)
        if len(x) > k and not known:
            least = np.partition(score, -k, axis=1)[:, -k]
        if floor is not None:
            least = np.maximum(least, floor[s : s + step])
        i, j = np.nonzero(score >= least[:, None] - ROUNDING)
        some_q.append(i + s)
        some_x.append(j)
    i, j = np.concatenate(some_q), np.concatenate(some_x)
    step = max(1, NUMBERS // x.shape[1])
    return i, j, np.concatenate([cosines(q[i[s : s + step]], x[j[s : s + step]]) for s in range(0, len(i), step)] or [np.empty(0)])


def _best_ids(i: np.ndarray, ids: np.ndarray, score: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query i, the few best ids: ties to the smaller id."""
    order = np.lexsort((-score, ids, i))
    i, score, ids = i[order], score[order], ids[order]
    new = np.ones(len(i), bool)  # an id counts with its best vector
    new[1:] = (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])
    order = np.flatnonzero(new)[np.lexsort((ids[new], -score[new], i[new]))]
    i, score, ids = i[order], score[order], ids[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < few
    return i[keep], ids[keep], score[keep]


class Cell:
    """The vectors of a cell, sorted by leaf."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], dim: int, first: int, few: int, kind: str):
        leaf, own, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.x, self.few = v.view(kind).reshape(-1, dim), few
        self.count, self.ids = own[:, 0], np.ascontiguousarray(own[:, 1:]).view("<i8")
        leaves, begin = np.unique(leaf, return_index=True)
        self.leaves = list(zip((leaves - first).tolist(), begin.tolist(), [*begin[1:].tolist(), len(leaf)], strict=True))

    def answer(self, bits: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vec_id and score: of each query, the few best ids in the leaves that it opened."""
        qu, dim = unit(q), q.shape[1]
        floor = np.full(len(q), -2.0)  # the score of a query's few-th id so far
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        found: list[tuple[np.ndarray, ...]] = []
        more = 0

        def merge() -> None:
            nonlocal best, more
            i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
            n = self.count[j].astype(np.int64)
            ids = self.ids[j][np.arange(self.few)[None, :] < n[:, None]]
            best = _best_ids(*(np.concatenate(c) for c in zip(best, (np.repeat(i, n), ids, np.repeat(score, n)), strict=True)), self.few)
            last = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == self.few - 1
            floor[best[0][last]] = best[2][last]
            found.clear()
            more = 0

        rows = max(1, min(BIN, NUMBERS // dim))
        for leaf, a, b in self.leaves:
            own = np.flatnonzero(bits[:, leaf >> 3] >> (7 - (leaf & 7)) & 1)
            if not len(own):
                continue
            for s in range(a, b, rows):
                x = self.x[s : min(b, s + rows)].astype(float)
                xu = unit(x)
                for at in range(0, len(own), step := max(1, SLAB // len(x))):
                    some = own[at : at + step]
                    i, j, score = best_of(q[some], x, self.few, (qu[some], xu), floor[some])
                    found.append((some[i], s + j, score))
                    more += len(i)
                    if more > 4 * len(q) + 1024:
                        merge()
        if found:
            merge()
        return best


def _compared(met: DataFrame, spans: Spans, few: int, kind: str) -> DataFrame:
    """q, vec_id, score: of each cell, the few best ids for each query in the leaves that it opened."""
    cells = spans.cells

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = -1, [], None
        block: list[tuple[np.ndarray, ...]] = []

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal held, cell
            span = int(np.searchsorted(cells, now, "right")) - 1
            dim = int(spans.dim[span])
            if held:
                cell, held = Cell(held, dim, int(spans.first[span]), few, kind), []
            ids, bits, v = (np.concatenate(c) for c in zip(*block, strict=True))
            block.clear()
            if cell is None:  # a part without vectors
                return
            for s in range(0, len(ids), step := max(1, min(BLOCK, NUMBERS // dim))):
                i, found, score = cell.answer(bits[s : s + step], v[s : s + step].view(kind).reshape(-1, dim).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + step][i]), pa.array(found), pa.array(score)], names=["q", "vec_id", "score"])

        for batch in batches:
            at, leaf, id_ = (np.asarray(batch.column(k)) for k in range(3))
            ends = np.flatnonzero((at[1:] != at[:-1]) | ((leaf[1:] == ASKS) != (leaf[:-1] == ASKS))) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if at[a] != now:
                    if block:
                        yield from answered()
                    now, held, cell = at[a], [], None
                first, v = (_bytes_of(batch.column(k).slice(a, b - a)).copy() for k in (3, 4))
                if leaf[a] != ASKS:
                    held.append((leaf[a:b].copy(), first, v))
                    continue
                block.append((id_[a:b].copy(), first, v))
                if sum(len(x[0]) for x in block) >= BLOCK or sum(x[2].nbytes for x in block) >= SENT:
                    yield from answered()
        if block:
            yield from answered()

    return met.mapInArrow(compare, "q long, vec_id long, score double")


def _drawn(classes: DataFrame, n: int, most: int) -> DataFrame:
    """The first `most` of n classes by a hash; only classes with small hashes are sorted."""
    if n > 4 * most:
        small = classes.where(F.xxhash64("ids") < F.lit(-(1 << 63) + int((1 << 64) * (1.5 * most + 100) / n)))
        classes = small if small.count() >= most else classes
    return classes.orderBy(*map(F.expr, DRAWN)).limit(most)


def _pilots(filed: DataFrame, dim: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """PILOTS query vectors of this length, and the vectors of the k nearest classes of each, found exactly over all rows."""
    own = filed.where(F.col("dim") == dim)
    drawn = own.where("asked").select("id", "v", "ids").orderBy(*map(F.expr, DRAWN)).limit(PILOTS).collect()
    q = np.array([r["v"] for r in drawn], float).reshape(len(drawn), dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty((0, dim))
        for batch in batches:
            for s in range(0, batch.num_rows, step := max(1, min(BIN, NUMBERS // dim))):
                part = batch.slice(s, step)
                x = _lists(part.column("v"), dim)
                i, j, score = best_of(q, x, k + 1)
                i, score, ids, x = (np.concatenate(c) for c in zip(best, (i, score, np.asarray(part.column("id"))[j], x[j]), strict=True))
                order = np.lexsort((ids, -score, i))
                keep = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) <= k]
                best = i[keep], score[keep], ids[keep], x[keep]
        i, score, ids, x = best
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(dim))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(score), pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["q", "score", "id", "v"])

    near = own.select("id", "v").mapInArrow(exact, "q int, score double, id long, v array<double>") if len(q) else filed.limit(0).select(F.lit(0).alias("q"), F.lit(0.0).alias("score"), "id", F.col("v").cast("array<double>").alias("v"))
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found: list[list[list[float]]] = [[] for _ in drawn]
    for r in near.withColumn("turn", turn).where(F.col("turn") <= k + 1).collect():
        if r["v"] != drawn[r["q"]]["v"]:
            found[r["q"]].append(r["v"])
    return q, [np.array(x, float).reshape(-1, dim) for x in found]


def _budget(forest: Forest, sizes: np.ndarray, q: np.ndarray, near: list[np.ndarray], recall: float) -> float:
    """The least number of vectors to open that finds this share of the pilots' neighbours; all where there are none."""
    needed = []
    for leaves, x in zip(forest.opened(unit(q), sizes, float("inf")), near, strict=True):
        if len(x):
            held = np.full(forest.leaves, np.inf)
            held[leaves] = np.cumsum(sizes[leaves])
            needed += held[forest.file(unit(x))].min(axis=1).tolist()
    return float(np.quantile(needed, recall, method="higher")) if needed else float("inf")


def nearest(vectors: DataFrame, asked: Column | None = None, k: int = 5, key: str = "vec_id", column: str = "embedding", trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `asked` holds, its k nearest found, best first, ties to the smaller id.

    `asked` is a condition on the column vec_id; by default each id divisible by 50. Vectors that are null, empty, zero, or hold a
    null or non-finite component take no part, nor do rows with a null id. Only vectors of one length are compared. An id
    that repeats is one: its score is the largest over its vectors, and it is never its own neighbour. With fewer
    candidates all are returned. No rows, no result rows; other columns are not carried.
    """
    asked = F.col("vec_id") % 50 == 0 if asked is None else asked
    few = k + 1  # one's own id may be among them
    single = vectors.schema[column].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    classes = stored(_classes(rows, few, asked), "classes")
    totals = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()}
    forests, base, at = {}, {}, 0
    for dim, n in totals.items():
        sample = _drawn(classes.where(F.col("dim") == dim), n, max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))).select("v").toArrow()["v"].combine_chunks()
        forests[dim], base[dim] = Forest(unit(_lists(sample, dim)), n, trees), at
        at += forests[dim].leaves
    spark = vectors.sparkSession
    filed = stored(_filed(classes, forests, base), "filed")
    discard(spark, classes)
    sizes = np.zeros(at, np.int64)
    for r in filed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    budgets = {dim: _budget(f, sizes[base[dim] : base[dim] + f.leaves], *_pilots(filed, dim, k), recall) for dim, f in forests.items()}
    queries = stored(_askers(filed, forests, base, sizes, budgets), "queries")
    cores = spark.sparkContext.defaultParallelism
    width = {dim: dim * np.dtype(kind).itemsize + 8 * few + 24 for dim in forests}
    leaves = {dim: f.leaves for dim, f in forests.items()}
    spans = Spans.of(sizes, leaves, base, {dim: max(1, min(max(BIN, int(sizes.sum()) // (SPANS * cores)), HELD // width[dim])) for dim in forests})
    spans.dealt(np.add.reduceat(sizes, spans.first) if len(sizes) else sizes, _asked_of(queries, spans, leaves, base), SHARES * cores)
    met = _met(filed, queries, spans, leaves, base, few, kind)
    found = stored(_compared(met, spans, few, kind), "found").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    top = found.withColumn("turn", turn).where(F.col("turn") <= few).groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    # the class of each query row; rows of one class share its result
    lead = rows.where(asked).select("vec_id", "v").distinct().join(filed.where("asked").select("v", F.col("id").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q")
    each = stored(lead, "askers").join(stored(top, "top"), "q").select("query_id", F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score").where("query_id <> vec_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
