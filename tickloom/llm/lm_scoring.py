"""Language-model scoring with a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class, history). Classes are frequent tokens, each alone, then tokens by powers of
two of their count, the end of a text, and the unknown token. A softmax over weights of three hashed features of the history gives
the class a prior: the word before (bigram), the nearest frequent word before that (skip), and both together (trigram, hashed
to PAIRS rows). Its histories have 65,536 values, so the counts of (history, class) over all training texts are the prior's
sufficient statistics: each update computes the gradient on parts of that table, in tasks, and adds the parts up. In training a
token counts as the class that it has when its own occurrence is left out, so the unknown class learns from words that occur once.

What grows with the corpus are the features of words themselves: the counts of (word before, class), (word before, word) and
(skip word, word) over all training texts. The class's prior meets the first, a word's share of its class the others: after o of n
tokens in a context, P = (o + m * prior) / (n + m), so probabilities sum to one. m is the one of STRENGTHS that makes the training
tokens most likely when each is left out of its own counts; the last ignores the context. Features are hashed to 32 bits
in each of some ranges, more as the texts have more tokens; a block's distinct features meet their sums over all blocks by range.

Token counts are never held whole: texts are coded in blocks of about BLOCK bytes against the block's own word list, and only
these word lists, and the lists of features, meet the counts of the corpus, both by ranges of hashes and packed: as differences of sorted
hashes, in compressed planes of bytes. A prior of fixed size goes to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import U64, Words, crc_mod, discard, mixed, pieces, stored, stored_in_buckets

BLOCK = 8 << 20
#: Frequent words with a bucket of their own in histories; of these, words with a class of their own.
FREQUENT, ALONE = 192, 40
BUCKETS, CLASSES, PAIRS = 256, 64, 2048
END_CLASS, UNKNOWN_CLASS, FIRST_BIN = ALONE, ALONE + 1, ALONE + 2
BINS = CLASSES - FIRST_BIN
#: Buckets of words that are not known, and of a text's begin and end.
STRANGE, EDGE = BUCKETS - 2, BUCKETS - 1
NOTHING = FREQUENT
ROUNDS, SMOOTH = 12, 0.5
#: Weights of the prior against the counts of a context.
STRENGTHS = np.array([1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 1e12])
#: Ranges of hashed features: at least, and features of blocks in one at most, about.
LEAST_RANGES, RANGE = 64, 2 << 20
END = np.uint64(0x5851F42D4C957F2D)
LISTS = "doc_ids array<long>, train array<boolean>, lengths array<long>"


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: high bytes that are zero and values that repeat cost next to nothing."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(cell: pa.Scalar, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = pa.decompress(cell.as_buffer(), n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def steps(x: np.ndarray, edge: np.ndarray | None = None) -> np.ndarray:
    """Differences of sorted numbers, each first one (of the list, or from an edge on) as it is."""
    out = x.copy()
    out[1:] -= x[:-1]
    if edge is not None:
        first = edge[edge < len(x)]
        out[first] = x[first]
    return out


def _coded(docs: DataFrame) -> DataFrame:
    """Blocks: documents, the block's word hashes with their counts in training texts, and the words as places in that list."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, t in pieces(batch, "text", BLOCK):
                w = Words(t)
                lengths = np.diff(w.first) + 1
                h = np.insert(w.hash, w.first[1:], END)
                train = np.asarray(batch.column(1).slice(a, b - a))
                words, place = np.unique(h, return_inverse=True)
                counts = np.bincount(place[np.repeat(train, lengths)], minlength=len(words))
                cells = [
                    pa.array([part << 32 | k], pa.int64()), pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())), pa.array([train.tolist()], pa.list_(pa.bool_())),
                    pa.array([lengths], pa.list_(pa.int64())), pa.array([len(words)], pa.int64()), *(pa.array([packed(x)], pa.binary()) for x in (steps(words), counts.astype("<u4"), place.astype("<u4"))),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=["block", "doc_ids", "train", "lengths", "size", "words", "counts", "places"])
                k += 1

    return docs.select("doc_id", "learn", "text").mapInArrow(code, f"block long, {LISTS}, size long, words binary, counts binary, places binary")


class Vocabulary:
    """What maps a word's hash and count to its bucket and class: frequent words, the counts' bins and their masses."""

    def __init__(self, frequent: list[tuple[int, int]], masses: dict[int, int], tokens: int, types: int):
        self.frequent = np.array([h for h, _ in frequent], np.int64)
        self.mass = np.ones(BINS)
        for b, m in masses.items():
            self.mass[b] = m
        self.tokens, self.types = tokens, types

    def buckets(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A word's rank if it is frequent, else one of the others by its hash; words without a count are strange."""
        words = words.view(np.int64)
        out = (FREQUENT + np.mod(words, STRANGE - FREQUENT)).astype(np.uint8)
        if len(self.frequent):
            order = np.argsort(self.frequent)
            at = np.minimum(np.searchsorted(self.frequent[order], words), len(order) - 1)
            out = np.where(self.frequent[order][at] == words, order[at], out).astype(np.uint8)
        return np.where(counts > 0, out, STRANGE).astype(np.uint8)

    def classes(self, bucket: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.where(counts > 0, FIRST_BIN + np.minimum(BINS - 1, np.log2(np.maximum(counts, 1)).astype(np.int64)), UNKNOWN_CLASS)
        return np.where(bucket < ALONE, bucket, np.where(bucket == EDGE, END_CLASS, out))


def _starts(ranges: int) -> np.ndarray:
    """The least hash of each of some ranges of equal width."""
    return np.array([k * ((1 << 64) // ranges + 1) for k in range(ranges)], U64)


def _counted(blocks: DataFrame, ranges: int) -> DataFrame:
    """For each block and range of word hashes the words' counts in all training texts; one row of each range has the range's number of tokens and words, its most frequent words, and the tokens of words by power of two of their count."""
    end = int(END.view(np.int64))
    starts = _starts(ranges)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size = batch.column("size")[k].as_py()
                words = np.cumsum(unpacked(batch.column("words")[k], "<u8", size), dtype=U64)
                n = unpacked(batch.column("counts")[k], "<u4", size)
                edge = np.append(np.searchsorted(words, starts), size)
                part = np.flatnonzero(np.diff(edge))
                gaps, cut = steps(words, edge), lambda x: pa.array([packed(x[edge[p] : edge[p + 1]]) for p in part], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(part), pa.int64()), pa.array(np.diff(edge)[part], pa.int64()), cut(gaps), cut(n)],
                    names=["part", "block", "size", "words", "counts"])

    def add(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_pylist()
        words = [np.cumsum(unpacked(x, "<u8", m), dtype=U64) for x, m in zip(group.column("words"), sizes, strict=True)]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpacked(x, "<u4", m) for x, m in zip(group.column("counts"), sizes, strict=True)]), len(distinct)).astype("<u8")
        c, word = total.astype(np.int64), distinct.view(np.int64)
        real = np.flatnonzero((c > 0) & (word != end))
        top = real[np.lexsort((word[real], -c[real]))[:FREQUENT]]
        masses = np.bincount(np.minimum(BINS - 1, np.log2(c[real]).astype(np.int64)), c[real], BINS).astype(np.int64)
        once = lambda x, kind: pa.array([x] + [None] * (len(sizes) - 1), kind)
        return pa.table({
            "block": group.column("block"), "part": group.column("part"),
            "sums": pa.array([packed(x) for x in np.split(total[place], np.cumsum(sizes)[:-1])], pa.binary()),
            "tokens": once(int(c.sum()), pa.int64()), "types": once(int((c > 0).sum()), pa.int64()),
            "top": once([{"word": int(word[k]), "c": int(c[k])} for k in top], pa.list_(pa.struct([("word", pa.int64()), ("c", pa.int64())]))),
            "masses": once(masses.tolist(), pa.list_(pa.int64()))})

    kind = "block long, part int, sums binary, tokens long, types long, top array<struct<word:long,c:long>>, masses array<long>"
    return blocks.select("block", "size", "words", "counts").mapInArrow(listed, "part int, block long, size long, words binary, counts binary").groupBy("part").applyInArrow(add, kind)


def _by_block(sums: DataFrame) -> DataFrame:
    return sums.groupBy("block").agg(F.collect_list(F.struct("part", "sums")).alias("sums"))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """Reads at most FREQUENT words and one sum for each bin."""
    total = counts.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    top = [(r["word"], r["c"]) for r in counts.select(F.inline("top")).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    masses = {r["pos"]: r["m"] for r in counts.select(F.posexplode("masses")).where("col > 0").groupBy("pos").agg(F.sum("col").alias("m")).collect()}
    for _, c in top[:ALONE]:
        masses[min(BINS - 1, int(log2(c)))] -= c
    return Vocabulary(top, masses, total["n"] or 0, total["v"] or 0)


def histories(bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code of each token's history within its text: bucket of the word before, and the nearest frequent word before that.

    A frequent word's bucket is its rank.
    """
    n = len(bucket)
    bucket = bucket.astype(np.int64)
    start = np.zeros(n, np.int64)
    start[first] = first
    start = np.maximum.accumulate(start)
    seen = np.maximum.accumulate(np.where(bucket < FREQUENT, np.arange(n), -1))
    before = np.full(n, EDGE)
    before[1:] = bucket[:-1]
    before[first] = EDGE
    skip = np.full(n, -1)
    skip[2:] = seen[:-2]
    skip = np.where((skip >= start) & (skip >= 0), bucket[np.maximum(skip, 0)], NOTHING)
    return before * 256 + skip


def _read_blocks(blocks: DataFrame, vocabulary: Vocabulary, ranges: int) -> DataFrame:
    """For each block: what of the score needs no weights, histories and classes of all tokens, and the training counts."""
    z = vocabulary.tokens + 0.5 * (vocabulary.types + 1)
    starts = _starts(ranges)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size = batch.column("size")[k].as_py()
                words = np.cumsum(unpacked(batch.column("words")[k], "<u8", size), dtype=U64)
                sums = batch.column("sums")[k].values
                edge = np.append(np.searchsorted(words, starts), size)
                c = np.zeros(size, np.int64)
                for part, cell in zip(sums.field("part").to_pylist(), sums.field("sums"), strict=True):
                    c[edge[part] : edge[part + 1]] = unpacked(cell, "<u8", edge[part + 1] - edge[part])
                bucket = vocabulary.buckets(words, c)
                lengths = np.asarray(batch.column("lengths")[k].values)
                train = np.asarray(batch.column("train")[k].values.to_numpy(zero_copy_only=False))
                first = np.cumsum(lengths) - lengths
                at = unpacked(batch.column("places")[k], "<u4", lengths.sum())
                if size:
                    bucket[at[first[0] + lengths[0] - 1]] = EDGE  # the end token, known or not
                own, left_out = vocabulary.classes(bucket, c), vocabulary.classes(bucket, np.maximum(c - 1, 0))
                within = np.where(own >= FIRST_BIN, np.log10(np.maximum(c, 1) / vocabulary.mass[np.maximum(own - FIRST_BIN, 0)]), 0.0)
                base = np.log10((c + 0.5) / z)
                teach = np.repeat(train, lengths)
                codes, n = np.unique(histories(bucket[at], first)[teach] * CLASSES + left_out[at][teach], return_counts=True)
                per_text = lambda x: np.add.reduceat(x[at], first)
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                raw = lambda x, kind: pa.array([packed(x.astype(kind))], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(k, 1) for x in ("block", "doc_ids", "train", "lengths", "size", "words", "places")), one(per_text((c > 0).astype(np.int64)), pa.int64()), one(per_text(base), pa.float64()),
                     raw(within, "<f8"), raw(c, "<i8"), raw(bucket, "u1"), raw(own, "u1"), one(codes, pa.int32()), one(n, pa.int64())],
                    names=["block", "doc_ids", "train", "lengths", "size", "words", "places", "known", "base", "shares", "counts", "buckets", "classes", "codes", "n"])

    kind = f"block long, {LISTS}, size long, words binary, places binary, known array<long>, base array<double>, shares binary, counts binary, buckets binary, classes binary, codes array<int>, n array<long>"
    return blocks.select("block", "doc_ids", "train", "lengths", "size", "words", "places", "sums").mapInArrow(read, kind)


class Block:
    """A coded block: its tokens as places in its word list, what is known of these words, and its features."""

    COLUMNS = ("block", "doc_ids", "train", "lengths", "size", "words", "places", "known", "base", "shares", "counts", "buckets", "classes")

    def __init__(self, batch: pa.RecordBatch, k: int):
        column = lambda name: batch.column(name)[k]
        size = column("size").as_py()
        raw = lambda name, kind: unpacked(column(name), kind, size)
        self.lengths = np.asarray(column("lengths").values)
        self.at = unpacked(column("places"), "<u4", self.lengths.sum()).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(column("train").values.to_numpy(zero_copy_only=False).astype(bool), self.lengths)
        self.words = np.cumsum(raw("words", "<u8"), dtype=U64)
        self.share, self.count, self.bucket, self.own = (raw(x, t) for x, t in (("shares", "<f8"), ("counts", "<i8"), ("buckets", "u1"), ("classes", "u1")))
        self.history = histories(self.bucket[self.at], self.first)

    def features(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct features and their counts in training texts; for each token the places of (before, class), then for words of classes with many (before, class), (before, word), (skip, class) and (skip, word); -1 where it has no such feature.

        A word that occurs once teaches its context the unknown class, so that a class's words are those which occur at least twice.
        """
        size = len(self.words)
        before = np.empty(len(self.at), np.int64)
        before[1:] = self.at[:-1]
        before[self.first] = self.at[self.first[0] + self.lengths[0] - 1]  # the end token stands for a text's begin
        taught = np.where(self.count == 1, UNKNOWN_CLASS, self.own)
        binned = (self.own >= FIRST_BIN) & (self.count > 1)
        keys, counts, places, total = [], [], [], 0
        for k, (context, left) in enumerate(((self.words, before), (np.arange(256, dtype=U64), self.history & 255))):
            pair, place, n = np.unique(left * size + self.at, return_inverse=True, return_counts=True)
            n = np.bincount(place[self.train], minlength=len(pair))
            left, word = np.divmod(pair, size)
            some = np.flatnonzero(binned[word])
            # the class factor counts all words after a word, the other only those of classes with many words
            rows = [(np.arange(len(pair)), self.own, 0), (some, self.own, 1)] if k == 0 else [(some, self.own, 2)]
            for of, kind, salt in rows:
                code, inverse = np.unique(left[of] * CLASSES + (taught if salt == 0 else kind)[word[of]], return_inverse=True)
                where = np.full(len(pair), -1)
                where[of] = inverse + total
                keys.append(mixed(mixed(context[code // CLASSES] + U64(salt)) + (code % CLASSES).astype(U64)))
                counts.append(np.bincount(inverse, n[of], len(code)))
                total += len(code)
                places.append(where[place])
            where = np.full(len(pair), -1)
            where[some] = np.arange(len(some)) + total
            keys.append(mixed(mixed(context[left[some]] + U64(8 + k)) + self.words[word[some]]))
            counts.append(n[some])
            total += len(some)
            places.append(where[place])
        return np.concatenate(keys), np.concatenate(counts).astype(np.int64), places


def _by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by range, and where each range begins in it."""
    part = (keys >> U64(32)) % U64(ranges)
    order = np.lexsort((keys & U64(0xFFFFFFFF), part))
    return order, np.searchsorted(part[order], np.arange(ranges + 1).astype(U64))


def _summed(coded: DataFrame, ranges: int) -> DataFrame:
    """block, sums (part, counts): for each block and range of features, in the order of _by_range, their counts over all blocks."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if not len(batch.column("lengths")[k].values):
                    continue
                keys, counts, _ = Block(batch, k).features()
                order, edge = _by_range(keys, ranges)
                low, n = steps((keys[order] & U64(0xFFFFFFFF)).astype("<u4"), edge), counts[order].astype("<u4")
                part = np.flatnonzero(np.diff(edge))
                cut = lambda x: pa.array([packed(x[edge[p] : edge[p + 1]]) for p in part], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(part), pa.int64()), pa.array(np.diff(edge)[part], pa.int64()), cut(low), cut(n)],
                    names=["part", "block", "size", "low", "n"])

    def add(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_pylist()
        low = [np.cumsum(unpacked(x, "<u4", m), dtype=np.uint32) for x, m in zip(group.column("low"), sizes, strict=True)]
        distinct, place = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpacked(x, "<u4", m) for x, m in zip(group.column("n"), sizes, strict=True)]), len(distinct)).astype("<u8")[place]
        cells = np.split(total, np.cumsum(sizes)[:-1])
        return pa.table({"block": group.column("block"), "part": group.column("part"), "sums": pa.array([packed(x) for x in cells], pa.binary())})

    lists = coded.select(*Block.COLUMNS).mapInArrow(listed, "part int, block long, size long, low binary, n binary")
    sums = lists.groupBy("part").applyInArrow(add, "block long, part int, sums binary")
    return _by_block(sums)


def blended(o: np.ndarray, n: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    return (o + strength * prior) / (n + strength)


class Model:
    """Weights of the features by class; rows: the word before, the skipped-to word, the pair; and one for the class alone."""

    def __init__(self):
        self.before, self.skip = np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((BUCKETS, CLASSES), np.float32)
        self.pair, self.alone = np.zeros((PAIRS, CLASSES), np.float32), np.zeros(CLASSES, np.float32)

    @staticmethod
    def pair_row(history: np.ndarray) -> np.ndarray:
        return ((history.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) >> U64(40)).astype(np.int64) % PAIRS

    def log_probabilities(self, history: np.ndarray) -> np.ndarray:
        """Natural logarithm of each class's probability after each history."""
        x = self.before[history >> 8] + self.skip[history & 255] + self.pair[self.pair_row(history)] + self.alone
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _sums(history: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """A table by history summed up by feature."""
    out = []
    for rows, size in ((history >> 8, BUCKETS), (history & 255, BUCKETS), (Model.pair_row(history), PAIRS)):
        order = np.argsort(rows, kind="stable")
        edge = np.flatnonzero(np.diff(rows[order], prepend=-1))
        s = np.zeros((size, CLASSES))
        if len(order):
            s[rows[order][edge]] = np.add.reduceat(table[order], edge, axis=0)
        out.append(s)
    return out


def train(statistics: DataFrame, rounds: int = ROUNDS) -> Model:
    """Rounds of distributed gradient updates on code, n (history * CLASSES + class, count).

    The gradient of the log likelihood is observed minus expected counts of each feature and class. Tasks sum both for their
    part of the table; the step for a weight is the logarithm of their smoothed ratio, divided by the features of a
    history, which never overshoots. The table has at most 65,536 x CLASSES rows however large the corpus is.
    """
    model = Model()
    totals = {r["k"]: r["n"] for r in statistics.groupBy((F.col("code") % CLASSES).alias("k")).agg(F.sum("n").alias("n")).collect()}
    total = sum(totals.values())
    model.alone[:] = [log((totals.get(k, 0) + SMOOTH) / (total + SMOOTH * CLASSES)) for k in range(CLASSES)]
    if not total:
        return model
    parts = statistics.select("code", "n").coalesce(8)

    def summed(observed: bool) -> list[np.ndarray]:
        """Counts by feature over all parts, observed or as the model expects them: under a megabyte from each task."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(65536 * CLASSES)
            for batch in batches:
                np.add.at(seen, np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            seen = seen.reshape(-1, CLASSES)
            history = np.flatnonzero(seen.any(axis=1))
            table = seen[history]
            if not observed:
                table = np.exp(model.log_probabilities(history)) * table.sum(axis=1, keepdims=True)
            sums = [x.astype(np.float32).tobytes() for x in _sums(history, table)]
            yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array(sums, pa.binary())], names=["k", "sums"])

        out = [np.zeros((n, CLASSES)) for n in (BUCKETS, BUCKETS, PAIRS)]
        for r in parts.mapInArrow(count, "k int, sums binary").toLocalIterator():
            out[r["k"]] += np.frombuffer(r["sums"], np.float32).reshape(-1, CLASSES)
        return out

    observed = summed(True)
    for _ in range(rounds):
        for weights, o, e in zip((model.before, model.skip, model.pair), observed, summed(False), strict=True):
            weights += (np.log((o + SMOOTH) / (e + SMOOTH)) / 3).astype(np.float32)
    return model


def _scores(coded: DataFrame, model: Model, ranges: int) -> DataFrame:
    """A row for each text with its scores by strength, for the class and for the word; `left` has those of training texts with each token left out of its counts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([model.log_probabilities(np.arange(k, k + 4096)) for k in range(0, 65536, 4096)])
        for batch in batches:
            for k in range(batch.num_rows):
                b = Block(batch, k)
                keys, _, places = b.features()
                order, edge = _by_range(keys, ranges)
                total = np.zeros(len(keys) + 1)  # the last is of tokens without the feature
                sums = batch.column("sums")[k].values
                for part, cell in zip(sums.field("part").to_pylist(), sums.field("sums"), strict=True):
                    of = order[edge[part] : edge[part + 1]]
                    total[of] = unpacked(cell, "<u8", len(of))
                in_class, near_class, near, far_class, far = (total[x] for x in places)
                own = b.own[b.at]
                # how often a word stands before another is its count
                before = np.empty(len(b.at), np.int64)
                before[1:] = b.at[:-1]
                before[b.first] = b.at[b.first[0] + b.lengths[0] - 1]
                n = b.count[before]
                prior, share = np.exp(table[b.history, own].astype(np.float64)), 10 ** b.share[b.at]
                # a word that occurs once is not of the class that it teaches
                once = b.count[b.at] == 1
                binned = places[2] >= 0
                out = {"score": ([], []), "left": ([], [])}
                for name, less in (("score", 0), ("left", b.train)):
                    if name == "left":
                        prior = np.where(once, np.exp(table[b.history, UNKNOWN_CLASS].astype(np.float64)), prior)
                    o = in_class if name == "left" else np.where(once, 0, in_class)
                    for m in STRENGTHS:
                        x = np.log10(blended(np.maximum(o - less, 0), np.maximum(n - less, 0), prior, m))
                        far_share = blended(np.maximum(far - less, 0), np.maximum(far_class - less, 0), share, m)
                        y = np.where(binned, np.log10(blended(np.maximum(near - less, 0), np.maximum(near_class - less, 0), far_share, m)), b.share[b.at])
                        for values, of in zip((x, y), out[name], strict=True):
                            of.append(np.add.reduceat(np.where(b.train, values, 0) if name == "left" else values, b.first))
                lists = [pa.array(list(np.stack(x, axis=1)), pa.list_(pa.float64())) for x in (*out["score"], *out["left"])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[k].values, pa.array(b.lengths), batch.column("known")[k].values, batch.column("base")[k].values, *lists],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "class", "word", "left_class", "left_word"])

    columns = coded.select(*Block.COLUMNS).join(_summed(coded, ranges), "block")
    return columns.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, class array<double>, word array<double>, left_class array<double>, left_word array<double>")


def score(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text, learned from the rows where `learn` holds.

    Null and empty texts are one end token. A null `learn` is false. Rows that repeat are each counted and scored. Without any
    training row all tokens are unknown, and the base score is that of one unknown type. Other columns are not carried.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    blocks = stored(_coded(source), "coded")
    tokens = blocks.select(F.explode("lengths").alias("n")).agg(F.sum("n")).first()[0] or 0
    ranges = max(LEAST_RANGES, 2 * tokens // RANGE)
    counts = stored(_counted(blocks, ranges), "counts")
    vocabulary = _vocabulary(counts)
    # in buckets, so that the blocks meet the sums of their features without another shuffle of their texts
    coded, name = stored_in_buckets(_read_blocks(blocks.drop("counts").join(_by_block(counts), "block"), vocabulary, ranges), "read", "block")
    discard(spark, counts)
    discard(spark, blocks)
    statistics = coded.select(F.explode(F.arrays_zip("codes", "n")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.n").alias("n"))
    model = train(stored(statistics, "statistics"), rounds)
    scored = stored(_scores(coded, model, ranges), "scored")
    discard(spark, coded)
    spark.sql(f"DROP TABLE {name}")
    # the strengths that make the training tokens, each left out, most likely
    best = []
    for name in ("class", "word"):
        sums = scored.agg(*[F.sum(F.col(f"left_{name}")[k]) for k in range(len(STRENGTHS))]).first()
        best.append(int(np.argmax([float("-inf") if x is None else x for x in sums])) if vocabulary.tokens else len(STRENGTHS) - 1)
    total = F.col("class")[best[0]] + F.col("word")[best[1]]
    return scored.select("doc_id", "n_tokens", "n_known", "base_score", total.alias("score"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"))


def contract(docs: DataFrame) -> DataFrame:
    """Learns from documents whose crc32 modulo 5 is not 1; a null doc_id is neither learned from nor held out."""
    out = score(docs, crc_mod("doc_id", 5) != 1)
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
