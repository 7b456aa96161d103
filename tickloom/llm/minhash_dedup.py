"""Near-duplicate documents by MinHash.

1. A document's word shingles become 64-bit hashes; each of HASHES universal hash functions keeps its minimum over them.
2. Documents with one and the same shingle set are one class (a hash of the sorted set); only its smallest id goes on.
3. Banding: ROWS minima make a bucket's key, BANDS times. A pair with similarity s meets with 1 - (1 - s^ROWS)^BANDS: all but
   3 in a million at 0.8. Texts of documents that share a bucket are read again for their full sets.
4. Links of a bucket's members to two of them are tried first, to the smallest id and to the member that meets most others
   in all its buckets (the text of which the others are edited copies, if there is one): the signatures must agree well enough, then the full sets are
   compared. Components of these links follow.
5. Where members of a bucket then lie in several components, pairs across components could still be links. Documents that such
   buckets connect form groups, cut into chunks of bounded size; every two chunks of a group meet in one task, which
   compares full sets by products of incidence matrices and returns, for each document, one link for each other component.
   No pair is left out, and none that is no link leaves a task.
6. Components of all links by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import U64, Words, binaries, mixed, ngrams, pieces, sequence_hash, stored
from tickloom.llm.components import components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Bits of the bitmap by which texts are chosen to be read again.
FILTER_BITS = 24
#: A chunk of a group: about so many shingles and documents; and the shingles of one matrix product.
CHUNK_SHINGLES, CHUNK_DOCS, SLAB = 200_000, 128, 2048
_random = np.random.default_rng(20260103)
_A = _random.integers(0, 1 << 63, HASHES, dtype=U64) * U64(2) + U64(1)
_B = _random.integers(0, 1 << 64, HASHES, dtype=U64)
_MIX = _random.integers(0, 1 << 63, ROWS, dtype=U64) * U64(2) + U64(1)


def signature(x: np.ndarray) -> np.ndarray:
    """The upper half of the minimum of each hash function a x + b modulo 2^64."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, U64)
    for k in range(0, len(x), 512):
        h = np.multiply.outer(x[k : k + 512], _A)
        h += _B
        np.minimum(low, h.min(axis=0), out=low)
    return (low >> U64(32)).astype(np.uint32)


def short(sig: np.ndarray) -> np.ndarray:
    """Half of each minimum: enough to count agreements."""
    return (sig & np.uint32(0xFFFF)).astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: its rows and its number, mixed."""
    parts = sig.reshape(BANDS, ROWS).astype(U64) * _MIX
    return (parts.sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64)) * U64(0x9E3779B97F4A7C15)


def _sets(t, n: int, fold: bool) -> Iterator[np.ndarray]:
    w = Words(t, fold=fold)
    for i in range(t.n):
        yield np.unique(ngrams(w.hash[w.first[i] : w.first[i + 1]], n))


def sketches(docs: DataFrame, shingle: int, fold: bool) -> DataFrame:
    """doc_id, n (shingles), one and two (hashes of the set), keys (of the bands)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in pieces(batch, "text"):
                n, one, two, keys = [], [], [], []
                for s in _sets(t, shingle, fold):
                    n.append(len(s))
                    one.append(sequence_hash(s, 3))
                    two.append(sequence_hash(s[::-1], 4))
                    keys.append(band_keys(signature(s)).view(np.int64))
                at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys)))],
                    names=["doc_id", "n", "one", "two", "keys"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, one long, two long, keys array<long>")


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.view(U64)) & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every id of the table has its bit: a filter that may let others pass, but loses none."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_bit(np.asarray(batch.column(0)))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in ids.coalesce(8).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, fold: bool) -> DataFrame:
    """doc_id, n, sig (short minima), set (all shingles) of the wanted documents, one row for each different set of an id that is not empty.

    The texts are read where they lie; only sets are shuffled. What the bitmap lets pass besides goes in the join.
    """
    packed = id_filter(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[_bit(np.asarray(batch.column(0)))]))
            for a, b, t in pieces(batch, "text"):
                parts = list(_sets(t, shingle, fold))
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(p) for p in parts], pa.int64()), binaries([short(signature(p)) for p in parts]), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).view(np.int64)))],
                    names=["doc_id", "n", "sig", "set"])

    made = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(sets, "doc_id long, n long, sig binary, set array<long>")
    own = made.where("n > 0").join(wanted, "doc_id", "left_semi").withColumn("one", F.xxhash64("set"))
    return own.dropDuplicates(["doc_id", "one"]).drop("one")


def agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures agree in at least this share."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, HASHES) for k in (2, 3)]
            ok = pa.array((both[0] == both[1]).mean(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(ok)

    return pairs.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _within(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that are links: signatures agree, then full sets have 100 * intersection >= percent * union.

    The sets travel with the pairs that are left after the signatures: in two joins, by either id.
    """
    share = percent / 100
    side = lambda s, *c: sets.select(F.col("doc_id").alias(s), *[F.col(x).alias(x[0] + s) for x in c])
    sized = pairs.join(side("a", "n", "sig"), "a").join(side("b", "n", "sig"), "b").where(_within(F.col("na"), F.col("nb"), percent))
    # an id with several sets is met by each of them
    likely = stored(agreeing(sized, share - 5 * sqrt(share * (1 - share) / HASHES)).distinct(), "likely")
    joined = likely.join(side("b", "set"), "b").join(side("a", "set"), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = joined.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("both"))
    return joined.where(F.col("common") * 100 >= (F.col("both") - F.col("common")) * percent).select("a", "b").distinct()


def _blocks(left: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """group, chunk and its members' ids, components, sizes and sets: documents that buckets connect, cut into chunks of bounded size."""
    groups = stored(components(edges), "groups")
    own = left.join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    own = own.join(sets.select("doc_id", "n", "set"), "doc_id")
    sizes = stored(own.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count(F.lit(1)) / CHUNK_DOCS)).alias("chunks"), F.min("comp").alias("c1"), F.max("comp").alias("c2")), "group-sizes")
    own = own.join(sizes.where("c1 < c2").select("grp", "chunks"), "grp").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks"))
    return own.groupBy("grp", "chunk").agg(F.first("chunks").alias("chunks"), F.collect_list(F.struct("doc_id", "comp", "set")).alias("docs"))


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y: products of incidence matrices, a slab of shingles at a time."""
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(flat_x, flat_y)

    def places(flat: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[k] == flat if len(shared) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[hit]
        order = np.argsort(k[hit], kind="stable")
        return k[hit][order], row[order]

    (kx, rx), (ky, ry) = places(flat_x, x), places(flat_y, y)
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(shared), SLAB):
        width = min(SLAB, len(shared) - low)
        sides = []
        for k, r, n in ((kx, rx, len(x)), (ky, ry, len(y))):
            p, q = np.searchsorted(k, [low, low + width])
            m = np.zeros((n, width), np.float32)
            m[r[p:q], k[p:q] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _across(blocks: DataFrame, percent: int) -> DataFrame:
    """Links a, b between components, one for each document and component that it links with.

    Every two chunks of a group meet in one task, which compares all their full sets; only links leave it.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for k in range(batch.num_rows):
                both = []
                for side in (0, 1):
                    docs = batch.column(side)[k].values
                    lists = docs.field("set")
                    at = np.asarray(lists.offsets)[: len(lists) + 1]
                    flat = np.asarray(lists.values)
                    both.append((np.asarray(docs.field("doc_id")), np.asarray(docs.field("comp")), [flat[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]))
                (ids, comp, x), (ids2, comp2, y) = both
                common = _common(x, y)
                union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
                i, j = np.nonzero((100 * common >= percent * union) & (comp[:, None] != comp2[None, :]))
                if len(i):
                    _, first = np.unique(np.stack([ids[i], comp2[j]]), axis=1, return_index=True)
                    out.append(np.stack([ids[i[first]], ids2[j[first]]]))
            found = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.min(axis=0)), pa.array(found.max(axis=0))], names=["a", "b"])

    order = F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1))
    pairs = blocks.select("grp", F.col("chunk").alias("i"), order.alias("j"))
    side = lambda s, k: blocks.select("grp", F.col("chunk").alias(k), F.col("docs").alias(s))
    met = pairs.join(side("x", "i"), ["grp", "i"]).join(side("y", "j"), ["grp", "j"])
    return met.select("x", "y").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included), kept, one row per row of docs.

    Links join documents whose sets of `shingle`-word sequences have 100 * intersection >= percent * union; a text of fewer
    words is one sequence. Null and empty texts, and texts of white space, have no set and link with nothing. A row with a null id
    links with nothing and keeps a null component. Rows that repeat an id are one document: sets of all of them count for it, and
    each has its own n_shingles. An empty table gives an empty result; other columns are not carried.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = stored(sketches(source, shingle, fold), "sketches")
    real = sketch.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # classes of equal sets, then one row for each class
    many = stored(real.groupBy("one", "two").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "copied")
    copies = real.select("doc_id", "one", "two").join(many, ["one", "two"]).where("doc_id <> lead").select(F.col("lead").alias("u"), F.col("doc_id").alias("v"))
    leads = real.join(many, ["one", "two"], "left").where("lead is null or doc_id = lead")
    bands = stored(leads.select("doc_id", F.explode("keys").alias("band")), "bands")
    buckets = stored(bands.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").drop("high"), "buckets")
    members = stored(bands.join(buckets, "band"), "members")
    # the member that shares most buckets with most others: the text that its edited copies have in common
    weights = members.groupBy("doc_id").agg(F.sum("size").alias("w"))
    hubs = stored(members.join(weights, "doc_id").groupBy("band").agg(F.max(F.struct("w", "doc_id")).getField("doc_id").alias("hub")), "hubs")
    sets = stored(full_sets(source, members.select("doc_id").distinct(), shingle, fold), "sets")
    stars = members.where("doc_id > low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    stars = stars.union(members.join(hubs, "band").where("doc_id <> hub").select(F.least("doc_id", "hub"), F.greatest("doc_id", "hub"))).distinct()
    first = stored(confirmed(stars, sets, percent), "links")
    found = stored(components(first.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    # what is left: members of buckets that are in several components
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "low", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = stored(placed, "placed")
    apart = stored(placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("band"), "apart")
    loose = stored(placed.join(apart, "band").select("band", "low", "doc_id", "component"), "loose")
    left = loose.select("doc_id", F.col("component").alias("comp")).distinct()
    # what a bucket's members have in common holds for their components too: they are groups together
    edges = loose.select(F.col("low").alias("u"), F.col("doc_id").alias("v")).where("u <> v").distinct()
    second = _across(stored(_blocks(left, edges, sets), "chunks"), percent)
    links = first.unionByName(second).select(F.col("a").alias("u"), F.col("b").alias("v")).union(copies)
    final = stored(components(links), "final")
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
