"""Token ids in a binary format: canonical, length-limited Huffman codes from the counts of all ids.

The file format is a folder with two Parquet tables. `codes` has the code length of each id that occurs; canonical codes follow
from the lengths. `blocks` has runs of whole documents in ascending order: document ids and token counts, the code bits, and a
checkpoint, the bit offset, of every CHECKPOINT-th token. A block is decoded on its own, all its checkpoints at once, by a table
that maps the next `limit` bits to an id and the length of its code.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import Texts, Words, pieces, shared_path, stored

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Longest code in bits, at least enough for all ids; a decoding table has 2^limit entries.
LIMIT = 20
#: Tokens in a block (a longer document is a block of its own), and between two checkpoints.
BLOCK_TOKENS, CHECKPOINT = 1 << 18, 256
#: Bytes of text whose distinct words are looked up at once.
ENCODED = 4 << 20
#: Words that the encoder gets in one text.
JOINED = 256
#: A worker forgets its table of encoded words beyond so many.
CACHED_WORDS = 3 << 19

BLOCK_SCHEMA = "part int, block int, n_docs int, n_tokens long, docs binary, absent binary, counts binary, checkpoints binary, bits binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- tokenizing


class WordEncoder:
    """Ids of texts by an encoder that drops white space and works on each word by itself, so each distinct word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.length, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another and the number of each word's; JOINED words at a time, told apart by where tokens start."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        ids, counts = [], []
        for group, e in zip(groups, self.encoder.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            begins = np.cumsum([0] + [len(x) + 1 for x in group[:-1]])
            starts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        w = Words(texts, fold=False)
        # distinct words in order of their hash: they are looked up, and new ones merged, in one sweep of the table
        distinct, which, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > CACHED_WORDS:
            self.forget()
        place = np.searchsorted(self.hash, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hash)
        known[inside] = self.hash[place[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            at, data = which[new], texts.data
            words = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(w.starts[at], w.ends[at], strict=True)]
            flat, length = self._encoded(words)
            begin = len(self.ids) + np.cumsum(length) - length
            self.hash, self.at, self.length = (np.insert(x, place[new], y) for x, y in ((self.hash, distinct[new]), (self.at, begin), (self.length, length)))
            self.ids = np.concatenate([self.ids, flat])
            place = np.searchsorted(self.hash, distinct)
        length = self.length[place][inverse]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.at[place][inverse] - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[w.first])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def id_kind(path: str, end_id: int = END_ID) -> str:
    """The unsigned little-endian integers that hold the ids of a vocabulary: of 16 bits where they suffice."""
    return "<u2" if max(encoder(path).encoder.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (as id_kind says, the end id last) of every whole text; a null text is empty."""
    path = path or vocabulary_path()
    kind = id_kind(path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for a, b, t in pieces(batch, "text", ENCODED):
                ids, counts = words.encode(t)
                ends = np.cumsum(counts)
                out = [np.append(ids[e - n : e], end_id).astype(kind).tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


# ---- codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    items, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(items) // 2
        both = np.concatenate([leaves, items[0 : 2 * pairs : 2] + items[1 : 2 * pairs : 2]])
        by = np.argsort(both, kind="stable")
        items = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        used = int(flags[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes: in order of length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.longest = int(self.lengths[-1]) if len(ids) else 1
        # left-aligned codes are sums of the space that the codes before take
        space = np.int64(1) << (self.longest - self.lengths)
        self.codes = ((np.cumsum(space) - space) >> (self.longest - self.lengths)).astype(np.uint64)
        self.space = space

    def encoding(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], length[self.ids] = self.codes, self.lengths
        return code, length

    def decoding(self) -> tuple[np.ndarray, np.ndarray]:
        free = (1 << self.longest) - int(self.space.sum()) if len(self.ids) else 2
        ids = np.concatenate([np.repeat(self.ids, self.space), np.zeros(free, np.uint32)])
        lengths = np.concatenate([np.repeat(self.lengths, self.space), np.ones(free, np.int64)])
        return ids, lengths


def pack(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code bits of ids, first bit highest, and the bit offset of every CHECKPOINT-th."""
    n, c = length[ids], code[ids]
    ends = np.cumsum(n)
    begin = ends - n
    words = np.zeros(int(ends[-1] >> 6) + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        w, room = begin >> 6, 64 - (begin & 63) - n
        high = np.where(room >= 0, c << np.maximum(room, 0).astype(np.uint64), c >> np.maximum(-room, 0).astype(np.uint64))
        edge = np.flatnonzero(np.diff(w, prepend=-1))
        words[w[edge]] |= np.bitwise_or.reduceat(high, edge)
        over = np.flatnonzero(room < 0)
        words[w[over] + 1] |= c[over] << (64 + room[over]).astype(np.uint64)
    size = (int(ends[-1]) + 7) // 8 if len(ids) else 0
    return words.astype(">u8").tobytes()[:size], begin[::CHECKPOINT]


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, ids: np.ndarray, lengths: np.ndarray, longest: int) -> np.ndarray:
    """n ids, every stretch between checkpoints in step with the others."""
    if not n:
        return np.empty(0, np.uint32)
    raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    ahead = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at, last, shift = checkpoints.astype(np.int64), len(ahead) - 1, np.uint32(32 - longest)
    out = np.empty((CHECKPOINT, len(at)), np.uint32)
    for k in range(CHECKPOINT):
        entry = (ahead[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
        out[k] = ids[entry]
        at += lengths[entry]
    return out.T.reshape(-1)[:n]


# ---- writing and reading


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """id, n over all rows; a task sums its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            t = Texts(batch.column(0).cast(pa.large_binary()).view(pa.large_string()))
            if len(t.data):
                n = np.bincount(np.frombuffer(t.data.tobytes(), kind), minlength=len(total))
                n[: len(total)] += total
                total = n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(ids: DataFrame, path: str, kind: str, limit: int = LIMIT) -> None:
    """Write doc_id and ids (of this kind of integer, and stored: they are read twice) in the file format, ascending by doc_id.

    Null ids come first; rows with the same doc_id are in the order of their ids. The driver gets one count per
    distinct id, at most the size of the vocabulary, and sends out one code each.
    """
    counts = id_counts(ids, kind).collect()
    some = np.array([r["id"] for r in counts], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in counts], np.int64), limit)
    spark = ids.sparkSession
    spark.createDataFrame(pa.table({"id": pa.array(some, pa.int64()), "length": pa.array(lengths, pa.int32())}).to_pandas(), "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    codes = Codes(some, lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = codes.encoding()
        part, block = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            bits, marks = pack(ids, code, length)
            row = {
                "part": part, "block": block, "n_docs": len(docs), "n_tokens": len(ids),
                "docs": np.array([d or 0 for d in docs], "<i8").tobytes(), "absent": np.packbits([d is None for d in docs]).tobytes(),
                "counts": np.array([len(p) for p in parts], "<u4").tobytes(), "checkpoints": marks.astype("<i8").tobytes(), "bits": bits,
            }
            kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), kind)
                if docs and size + len(own) > BLOCK_TOKENS:
                    yield flush()
                    block, size, docs, parts = block + 1, 0, [], []
                docs.append(d)
                parts.append(own)
                size += len(own)
        if docs:
            yield flush()

    ordered = ids.select("doc_id", "ids").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids themselves on demand, decoded from files."""
    codes = spark.read.parquet(f"{path}/codes").collect()
    made = Codes(np.array([r["id"] for r in codes], np.int64), np.array([r["length"] for r in codes], np.int64))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = made.decoding()
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                docs = np.frombuffer(row["docs"], "<i8")
                absent = np.unpackbits(np.frombuffer(row["absent"], np.uint8), count=len(docs)).astype(bool)
                flat = unpack(row["bits"], np.frombuffer(row["checkpoints"], "<i8"), row["n_tokens"], table, lengths, made.longest).astype("<u4")
                ends = np.cumsum(counts)
                raw = [flat[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                cols = [
                    pa.array(np.full(len(docs), row["part"], np.int32)), pa.array(np.full(len(docs), row["block"], np.int32)), pa.array(docs, mask=absent),
                    pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                ]
                names = ["part", "block", "doc_id", "here", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(raw, pa.binary())] if ids else []), names=names + ["ids"] * ids)

    blocks = spark.read.parquet(f"{path}/blocks")
    decoded = blocks.mapInArrow(decode, "part int, block int, doc_id long, here long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    # where a block begins: tokens of the parts before, then of the blocks before in its part; a row per part, then per block
    sizes = blocks.select("part", "block", "n_tokens")
    ahead = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", ahead(Window.orderBy("part")).alias("part_start"))
    starts = sizes.select("part", "block", ahead(Window.partitionBy("part").orderBy("block")).alias("block_start")).join(parts, "part")
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("here")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written.

    A null text has the end id alone; a null doc_id comes before all others; repeated rows are documents of their own; other
    columns are not carried. Without documents the files hold no block and the result is empty.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(stored(tokenized(docs), "ids"), path, id_kind(vocabulary_path()))
    return read(spark, path)
