"""Importance resampling: draw the documents whose features look most like those of a target distribution.

1. Features are runs of words, hashed to buckets by the crc32 of their bytes. Each task adds up one array of bucket counts, over
   all documents and over all target texts; the sums, one number for each bucket, become an array of gains (scaled log ratios).
2. A document's weight is the sum of its features' gains, looked up in that array; Gumbel noise from its id makes the best
   scores a draw without replacement in proportion to the weights.
3. The k-th key is found by quickselect: a few random rows are pivots, one pass counts exactly how many keys lie below, on and
   between them, and the part that holds the k-th key is written and searched on. The parts shrink by the number of pivots, so all
   rounds together read little more than the first.
4. Rows up to that key are the winners. They alone are sorted, by ranges, and numbered by their range's offset and their place in it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import Texts, Words, discard, pieces, stored

BUCKETS, SCALE = 10_000, 1000
#: Random pivot keys of a round.
PIVOTS = 15
#: Words longer than this are hashed one by one.
LONG = 64

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x41:0x5B] = _SEPARATOR[0x61:0x7B] = _SEPARATOR[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: The composite key, best first: score, ids before null, smaller id; equal rows differ by a number that the written table gives them.
KEY = ("worse", "nameless", "id", "n_features", "turn")


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each byte range, byte by byte over all ranges at once."""
    size = ends - starts
    out = np.empty(len(starts), np.int64)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left = starts[short], -size[short]
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -k))  # ranges longer than k come first
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out[short] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: Texts, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the text it belongs to, and the number of words of each text."""
    w = Words(texts, hashes=False, spaces=_SEPARATOR)
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1  # words in lower case, one space after each
    starts = ends - size
    source = np.repeat(w.starts - starts, size + 1) + np.arange(int(ends[-1]) + 1 if len(ends) else 0)
    line = _LOWER[w.data[np.minimum(source, len(w.data) - 1)]] if len(ends) else np.empty(0, np.uint8)
    line[ends] = 32
    owner = np.repeat(np.arange(texts.n), np.diff(w.first))
    last = w.first[1:][owner]  # end of the text's words, for each word
    found, of = [], []
    for n in range(least, most + 1):
        run = np.flatnonzero(np.arange(len(starts)) + n <= last)
        found.append(crc32s(line, starts[run], ends[run + n - 1]) % buckets)
        of.append(owner[run])
    return np.concatenate(found), np.concatenate(of), np.diff(w.first)


def _counts(texts: DataFrame, column: str, least: int, most: int, buckets: int) -> dict[int, int]:
    """Occurrences of each bucket over all texts: an array for each task, added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, t in pieces(batch, column):
                seen += np.bincount(features(t, least, most, buckets)[0], minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["bucket", "n"])

    parts = texts.select(column).mapInArrow(count, "bucket int, n long")
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Scaled log ratio of each bucket's smoothed shares of target and source, rounded down."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: float(target.get(b, 0) + 1) * s_all / (float(source.get(b, 0) + 1) * t_all)
    return np.array([math.floor(SCALE * math.log(ratio(b))) for b in range(buckets)], np.int64)


def _weighed(docs: DataFrame, key: str, text: str, gain: np.ndarray, least: int, most: int) -> DataFrame:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in pieces(batch, text):
                bucket, of, words = features(t, least, most, len(gain))
                n = np.bincount(of, minlength=t.n)
                weight = np.zeros(t.n, np.int64)
                np.add.at(weight, of, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def _key(values: Row | None = None) -> Column:
    """The composite key of a row, or of given values."""
    return F.struct(*[(F.col(c) if values is None else F.lit(values[c]).cast("long")).alias(c) for c in KEY])


def kth(rows: DataFrame, k: int, pivots: int = PIVOTS) -> Row:
    """The k-th smallest composite key (k from 1 to the number of rows); keys are distinct. At most `pivots` rows reach the driver in a round."""
    spark, part, owned, turn = rows.sparkSession, rows.select(*KEY), False, 0
    while True:
        drawn = part.orderBy(F.xxhash64("turn", F.lit(turn)), *KEY).limit(pivots).collect()
        drawn.sort(key=lambda r: tuple(r))
        # twice the number of pivots below a key, and one more on a pivot
        place = sum(((_key() > _key(p)).cast("int") + (_key() >= _key(p)).cast("int") for p in drawn), F.lit(0))
        counts = {r["place"]: r["n"] for r in part.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = 0
        while k > counts.get(at, 0):
            k -= counts.get(at, 0)
            at += 1
        if at % 2:
            return drawn[at // 2]
        narrower = stored(part.where(place == at), "quickselect")
        if owned:
            discard(spark, part)
        part, owned, turn = narrower, True, turn + 1


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 2024,
             percent: int = 10, least_words: int = 20, grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Null and empty texts have no features and weight 0, and with fewer than `least_words` words a document is never drawn. Ties go
    to the smaller id; a null id is hashed as the empty text and loses every tie. Rows that repeat are each counted, scored and
    drawn: rows equal in all of these columns share consecutive ranks in any order. Empty targets give every bucket the smoothed
    share; no documents, no rows. Other columns are not carried.
    """
    own, wanted = _counts(docs, text, *grams, buckets), _counts(target, target_text, *grams, buckets)
    weighed = _weighed(docs, key, text, gains(own, wanted, buckets), *grams)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(
        weighed.withColumn("score", F.col("weight") + noise)
        .withColumns({"worse": -F.col("score"), "nameless": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "turn": F.monotonically_increasing_id()}),
        "scored",
    )
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    columns = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    won = (F.col("n_words") >= least_words) & (_key() <= _key(kth(eligible, drawn)))
    ordered = scored.where(won).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    # the number of a row in its range, and that of the range, in one
    placed = stored(ordered.select(*columns, F.monotonically_increasing_id().alias("at")), "winners")
    span = F.shiftright("at", 33)
    offsets = placed.groupBy(span.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.withColumn("range", span).join(offsets, "range").select(*columns, (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))
    return ranked.unionByName(scored.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")))
