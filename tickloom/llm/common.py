"""Shared parts: words and their hashes straight from Arrow buffers, written intermediates, table access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tickloom.functions.lineage import remove, shared_folder

#: White space of every contract: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SEGMENT = 1 << 20
U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.default_rng(20260101).integers(0, 1 << 64, 256, dtype=U64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_STEPS = np.random.default_rng(20260102).integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


# ---- intermediates in the folder that all executors share


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    return shared_folder(spark, f"llm-{what}")


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written to a table in the shared folder and read again: a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_in_buckets(df: DataFrame, what: str, key: str) -> tuple[DataFrame, str]:
    """stored() as a table in buckets by key, as many as a shuffle has partitions: joins by key read them where they lie. Its
    name, which the owner drops; the files stay in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    name = f"tickloom_{path.rsplit('-', 1)[1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).options(path=path, compression="zstd").saveAsTable(name)
    return spark.table(name), name


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, path)


# ---- columns


def schema_with(df: DataFrame, added: StructType, drop: tuple[str, ...] = ()) -> StructType:
    """The columns of df, then the added ones; an old column with an added name gives way."""
    names = {f.name.lower() for f in added} | {d.lower() for d in drop}
    return StructType([StructField(f.name, f.dataType, True) for f in df.schema if f.name.lower() not in names] + list(added))


def without(df: DataFrame, *names: str) -> DataFrame:
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def spare(df: DataFrame, name: str) -> str:
    """This name, or one made from it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(batch: pa.RecordBatch, added: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    gone = {n.lower() for n in added} | {d.lower() for d in drop}
    keep = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in gone]
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(added.values()), names=[n for n, _ in keep] + list(added))


# ---- texts as bytes


class Texts:
    """The bytes of consecutive texts and where each begins; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        n, at = len(column), column.offset
        off = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        self.data = raw[off[0] : off[-1]]
        self.null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
        self.n = n

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def pieces(batch: pa.RecordBatch, column: str, limit: int = SEGMENT) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows of about `limit` bytes of text, one whole text at least."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        end = min(end, n)
        yield start, end, Texts(col.slice(start, end - start))
        start = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    have = len(_powers[0])
    if have < n:
        n = max(n, SEGMENT + 4096)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of texts: byte ranges, 64-bit hashes, and where each text's words begin (`first`).

    Another table of the bytes that separate words may be given.
    """

    def __init__(self, texts: Texts, fold: bool = True, hashes: bool = True, spaces: np.ndarray = _IS_SPACE):
        data, off = texts.data, texts.offsets
        word = ~spaces[data]
        begins, ends = word.copy(), word.copy()
        if len(data):
            begins[1:] &= ~word[:-1]
            ends[:-1] &= ~word[1:]
            cut = off[:-1][(off[:-1] > 0) & (off[:-1] < len(data))]
            begins[cut] = word[cut]
            ends[cut - 1] = word[cut - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, off)
        self.data = data
        if hashes:
            self.hash = self._hashes(_FOLDED if fold else _BYTES)

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        starts, ends, out = self.starts, self.ends, np.empty(len(self.starts), U64)
        k = 0
        while k < len(starts):
            j = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
            a, b = int(starts[k]), int(ends[j - 1])
            power, inverse = powers(b - a + 1)
            sums = np.empty(b - a + 1, U64)
            sums[0] = 0
            np.cumsum(codes[self.data[a:b]] * power[: b - a], out=sums[1:])
            s, e = starts[k:j] - a, ends[k:j] - a
            out[k:j] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD1B54A32D192ED03))
            k = j
        return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word sequences of one word sequence, in order; one of the whole where it is shorter, none where it is empty."""
    if len(h) == 0:
        return np.empty(0, U64)
    return grams_at(h, tuple(range(min(n, len(h)))))


def grams_at(h: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words at these ascending places behind each start; those of ngrams() for the same words without the gaps."""
    out = np.full(len(h) - places[-1], U64(len(places) * 0x632BE59BD9B4E019 & _MASK), U64)
    for j, x in enumerate(places):
        out += h[x : len(h) - places[-1] + x] * _STEPS[j]
    return mixed(out)


def sequence_hash(h: np.ndarray, seed: int = 1) -> int:
    """A signed 64-bit hash of a whole sequence of hashes."""
    power, _ = powers(len(h) + 1)
    total = int((h * power[: len(h)]).sum(dtype=U64)) if len(h) else 0
    x = np.array([(total ^ (len(h) * _BASE_INVERSE + seed)) & _MASK], U64)
    return int(mixed(x).view(np.int64)[0])


def binaries(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())
