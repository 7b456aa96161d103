"""Substring dedup against content-defined reference blocks.

This stands in for relative Lempel-Ziv parsing: no match is extended to a longest factor and no list of factors is made; equal
blocks and windows are found by their hashes, which removes the same words (README, "Choices").

Every document is cut at the same places wherever the same words stand: each window of WINDOW words has a seed, the smallest hash
of the SEED-word sequences in it, and consecutive windows with one seed form a block. The blocks of all documents are the
reference, indexed by seed. A document is held against every indexed block of its seeds:

* a whole block that a document with a smaller id also has is covered at once;
* in a block that differs from others of its seed, every window is compared with the windows of the other blocks of that seed, so
  what is covered ends at the exact word.

Equal windows have equal seeds, so a window in an earlier document is never missed. Sources are only blocks' first documents: a
later document with the same block is covered whole. A window's fate is min(document) by its hash, never a pair of documents, so
a passage that a third of all documents share costs a row for each of its blocks in each document. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import U64, Texts, Words, mixed, pieces, powers, sequence_hash, stored

WINDOW, SEED = 50, 16
#: Windows in a block at most; only repetitive text gets there.
LONGEST = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Sequence:
    """Hashes of word ranges of one document from running sums."""

    def __init__(self, h: np.ndarray):
        self.power, self.inverse = powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * self.power[: len(h)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))

    def windows(self, n: int) -> np.ndarray:
        k = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:k]) * self.inverse[:k])


def running_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def seeds(s: Sequence, window: int, seed: int) -> np.ndarray:
    return running_min(s.windows(seed), window - seed + 1)


def blocks(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each block."""
    edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    length = np.diff(np.append(edge, len(m)))
    if (length > LONGEST).any():
        more = (length + LONGEST - 1) // LONGEST
        inner = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        edge = np.repeat(edge, more) + inner * LONGEST
        length = np.minimum(np.repeat(length, more) - inner * LONGEST, LONGEST)
    return edge, length


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _kept(t: Texts, w: Words, i: int, keep: np.ndarray | None = None) -> str:
    """sha256 of the words of text i, or of those to keep, joined by one space."""
    a, b = w.first[i], w.first[i + 1]
    data, starts, ends = t.data, w.starts[a:b], w.ends[a:b]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return EMPTY_SHA
    # the bytes of each word and one byte after it, which becomes the space
    size = ends - starts + 1
    stop = np.cumsum(size)
    at = np.repeat(starts - stop + size, size) + np.arange(stop[-1])
    out = data[np.minimum(at, len(data) - 1)]
    out[stop - 1] = 32
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def _scan(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in pieces(batch, "text"):
                w = Words(t, fold=False)
                n, one, two, sha, m_, s_, at_, len_ = [], [], [], [], [], [], [], []
                for i in range(t.n):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    n.append(len(h))
                    one.append(sequence_hash(h))
                    two.append(sequence_hash(h[::-1], 2))
                    sha.append(_kept(t, w, i))
                    if len(h) >= window:
                        q = Sequence(h)
                        m = seeds(q, window, seed)
                        at, length = blocks(m)
                        s_.append(q.ranges(at, at + length + window - 1).view(np.int64))
                        m_.append(m[at].view(np.int64))
                    else:
                        at = length = np.empty(0, np.int64)
                        s_.append(at)
                        m_.append(at)
                    at_.append(at)
                    len_.append(length)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sha),
                     _lists(m_, pa.int64()), _lists(s_, pa.int64()), _lists(at_, pa.int32()), _lists(len_, pa.int32())],
                    names=["doc_id", "row", "n_words", "one", "two", "sha", "m", "s", "at", "len"])

    kind = "doc_id long, row long, n_words long, one long, two long, sha string, m array<long>, s array<long>, at array<int>, len array<int>"
    return docs.select("doc_id", "row", "text").mapInArrow(scan, kind)


def _boundary_windows(parsed: DataFrame, window: int) -> DataFrame:
    """doc_id, row, at, w: the hash of each window in the blocks to check."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, found = batch.column(0), batch.column(1), batch.column(3)
            for a, b, t in pieces(batch, "text"):
                w = Words(t, fold=False)
                who, at_, w_ = [], [], []
                for i in range(t.n):
                    q = Sequence(w.hash[w.first[i] : w.first[i + 1]])
                    at = np.concatenate([np.arange(x["at"], x["at"] + x["len"]) for x in found[a + i].as_py() if x["check"]])
                    at_.append(at)
                    w_.append(q.ranges(at, at + window).view(np.int64))
                    who.append(np.full(len(at), a + i))
                k = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([ids.take(k), rows.take(k), pa.array(np.concatenate(at_), pa.int32()), pa.array(np.concatenate(w_), pa.int64())], names=["doc_id", "row", "at", "w"])

    return parsed.where(F.exists("found", lambda x: x["check"])).select("doc_id", "row", "text", "found").mapInArrow(emit, "doc_id long, row long, at int, w long")


def _removed(parsed: DataFrame, window: int, spans: bool) -> DataFrame:
    """doc_id, row, n_removed, kept_sha256, and the factors as spans of words, of documents with covered windows."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hits = batch.column(3), batch.column(4)
            for a, b, t in pieces(batch, "text"):
                w = Words(t, fold=False, hashes=False)
                n, sha, spans_ = [], [], []
                for i in range(t.n):
                    size = int(w.first[i + 1] - w.first[i])
                    edge = np.zeros(size + 1, np.int64)
                    for x in found[a + i].as_py():
                        if not x["check"]:
                            edge[x["at"]] += 1
                            edge[x["at"] + x["len"] + window - 1] -= 1
                    single = np.array(hits[a + i].as_py() or [], np.int64)
                    np.add.at(edge, single, 1)
                    np.add.at(edge, single + window, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n.append(int(gone.sum()))
                    sha.append(_kept(t, w, i, ~gone))
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans_.append([{"start": int(p), "end": int(q)} for p, q in turn.reshape(-1, 2)] if spans else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "row", "n_removed", "kept_sha256", "spans"])

    return parsed.select("doc_id", "row", "text", "found", "hits").mapInArrow(remove, "doc_id long, row long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans: the words of each document that windows repeated from a smaller id cover.

    A null text has no words. A null id is no document's source and loses nothing. Rows with one id do not remove each
    other's words. Documents under `window` words lose nothing. An empty table gives an empty result; other columns are
    not carried, whatever their names.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("text"))
    scan = stored(_scan(source, window, seed), "scan")
    long = scan.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # copies of a whole word sequence: every window of a later one stands in the first
    copies = stored(long.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "copies")
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    parse = long.join(copies, ["one", "two"], "left").where(~later).select("doc_id", "row", F.explode(F.arrays_zip("m", "s", "at", "len")).alias("b")).select("doc_id", "row", "b.*")
    # the index: seeds that two documents have, and whether their blocks differ
    shared = stored(
        parse.groupBy("m").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("s").alias("s1"), F.max("s").alias("s2"))
        .where("first < last").select("m", "first", (F.col("s1") < F.col("s2")).alias("differ")), "seeds")
    met = stored(parse.join(shared, "m"), "blocks")
    firsts = stored(met.where("differ").groupBy("m", "s").agg(F.min("doc_id").alias("first_s"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    met = met.join(firsts, ["m", "s"], "left").withColumn("source", F.when(F.col("differ"), F.coalesce("first_s", "doc_id")).otherwise(F.col("first")))
    met = met.where("differ or source < doc_id").select("doc_id", "row", F.struct("at", "len", (F.col("source") >= F.col("doc_id")).alias("check")).alias("x"))
    found = met.groupBy("doc_id", "row").agg(F.collect_list("x").alias("found"))
    parsed = stored(source.join(found, ["doc_id", "row"]).select("doc_id", "row", "text", "found"), "parsed")
    windows = stored(_boundary_windows(parsed, window), "windows")
    first_w = stored(windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "window-firsts")
    hits = windows.join(first_w, "w").where("first < doc_id").groupBy("doc_id", "row").agg(F.collect_list("at").alias("hits"))
    done = _removed(parsed.join(hits, ["doc_id", "row"], "left"), window, spans).dropDuplicates(["doc_id", "row"])
    whole = scan.select("doc_id", "row", "n_words", "one", "two", "sha").join(copies, ["one", "two"], "left")
    whole = whole.withColumn("copy", later & (F.col("n_words") >= window)).select("doc_id", "row", "n_words", "sha", "copy")
    out = whole.join(done, ["doc_id", "row"], "left")
    return out.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", F.array())).alias("spans"),
    )
