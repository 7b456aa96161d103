"""Benchmark decontamination: n-gram seeds join training texts to test items, then Smith-Waterman alignment scores them.

Texts and items are words with A to Z in lower case. Where a text holds a seed of an item, the stretch around it in which the
whole item could stand is aligned with the item: +1 for an equal word, -1 for another word, an inserted or a missing one; the
best local alignment's score over the item's length is the match's score: 1 for a whole copy.

Seeds are all 3-grams of an item, and its 4-grams with a word inserted in the middle. With the default score no match can lack
both: the best alignment has m equal words in runs, with an error at least between two runs, and m minus the errors is half of
the item or more. If no run has three words, that leaves room for a few runs of one word, other errors or words of the item not
met (2 x other errors + short runs + words not met <= 2), so of the seven runs or more some pair is two words, an inserted one,
two words. Before a stretch is aligned, another exact bound may pass it over: the runs hold m less their number word pairs of the
item, so where a match stands, there are at least as many as its score less one.

Items are taken in blocks of bounded size, each searched in all texts; seeds of a block go to the workers. Texts are read where they
lie and nothing is shuffled but the matches, so a passage in a third of all documents costs an alignment for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import U64, Texts, Words, grams_at, mixed, ngrams, pieces, stored

SEED = 3
#: Least score of a match; in words, at least LEAST_WORDS or the whole of a shorter item.
SCORE, LEAST_WORDS = 0.5, 8
#: Words of the items searched at once: what a worker holds.
BLOCK_GRAMS = 1 << 20
#: Rows that a worker makes at once of seeds, or of word pairs, and items.
CHUNK = 1 << 20
MATCHES = "doc_id long, item_id long, score double, start long, end long, item_words long"


class Index:
    """Words of a block of items, and the sorted hashes of their seeds with the items of each, behind a table of bits."""

    def __init__(self, words: list[np.ndarray], n: int = SEED):
        self.n, self.first = n, np.cumsum([0, *map(len, words)])
        self.flat = np.concatenate(words) if words else np.empty(0, U64)
        length, gram, item = np.diff(self.first), [], []
        for size in (n, 4):
            of, place = _expanded(self.first[:-1], np.where(length >= n, np.maximum(length - size + 1, 0), 0))
            gram.append(ngrams(self.flat, size)[place])
            item.append(of)
        gram, item = np.concatenate(gram), np.concatenate(item)
        order = np.lexsort((item, gram))
        gram, item = gram[order], item[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])
        gram, self.item = gram[new], item[new].astype(np.int32)
        self.distinct, begin = np.unique(gram, return_index=True)
        self.begin = np.append(begin, len(gram))
        bits = max(16, int(8 * len(self.distinct) - 1).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.some = np.zeros(1 << bits, bool)
        self.some[self.distinct & self.mask] = True

    def words(self, item: int) -> np.ndarray:
        return self.flat[self.first[item] : self.first[item + 1]]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of grams that are in the index, and their place among its distinct ones."""
        at = np.flatnonzero(self.some[grams & self.mask])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.distinct, grams[at]), len(self.distinct) - 1)
        hit = self.distinct[k] == grams[at]
        return at[hit], k[hit]


def split_grams(h: np.ndarray) -> np.ndarray:
    """Hashes of two words and two more behind a word between, equal to those of the 4-gram without that word."""
    return grams_at(h, (0, 1, 3, 4)) if len(h) >= 5 else np.empty(0, U64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the end of its first place in the text.

    A row at a time: a gap in the text is a running maximum of scores with the distance added back.
    """
    far = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == word, 1, -1))
        row = np.maximum.accumulate(new + far) - far
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def needed(length, score: float = SCORE):
    """Least score in words of a match of an item of `length` words; of one or of an array of them."""
    return np.maximum(score * length, np.minimum(length, LEAST_WORDS))


def _item_words(rows: list) -> list[np.ndarray]:
    w = Words(Texts(pa.array([r["text"] or "" for r in rows], pa.large_string())))
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about CHUNK in sum, one row at least."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CHUNK, "right")))
        yield start, end
        start = end


def _expanded(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the range's number and the place, of every place in them."""
    of = np.repeat(np.arange(len(size)), size)
    return of, begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)


def _met(w: Words, index: Index) -> np.ndarray:
    """Rows (text, item) where the text holds a seed of the item."""
    docs, ks = [], []
    for grams, span in ((ngrams(w.hash, index.n) if len(w.hash) >= index.n else np.empty(0, U64), index.n), (split_grams(w.hash), 5)):
        at, k = index.find(grams)
        doc = np.searchsorted(w.first, at, "right") - 1
        inside = at + span <= w.first[doc + 1]
        docs.append(doc[inside])
        ks.append(k[inside])
    # a seed that stands in a text repeatedly counts once
    seeds = np.unique(np.concatenate(docs) * len(index.distinct) + np.concatenate(ks))
    doc, k = np.divmod(seeds, max(1, len(index.distinct)))
    size, items, out = index.begin[k + 1] - index.begin[k], len(index.first), [np.empty(0, np.int64)]
    for a, b in _chunks(size):
        of, place = _expanded(index.begin[k[a:b]], size[a:b])
        out.append(np.unique(doc[a:b][of] * items + index.item[place]))
    return np.stack(np.divmod(np.unique(np.concatenate(out)), items), axis=1)


def _enough_pairs(met: np.ndarray, w: Words, index: Index, pairs: np.ndarray, score: float) -> np.ndarray:
    """Of rows (text, item), those where the text holds as many of the item's word pairs as a match needs."""
    if not len(met):
        return met
    held = ngrams(w.hash, 2)
    doc = np.searchsorted(w.first, np.arange(len(held)), "right") - 1
    salt = lambda x: mixed(x.astype(U64) + U64(1))
    own = np.isin(doc, met[:, 0]) & (np.arange(len(held)) + 2 <= w.first[doc + 1])
    held = np.unique(held[own] + salt(doc[own]))
    length = np.diff(index.first)[met[:, 1]]
    keep = np.zeros(len(met), bool)
    for a, b in _chunks(length - 1):
        of, place = _expanded(index.first[met[a:b, 1]], length[a:b] - 1)
        key = pairs[place] + salt(met[a:b, 0])[of]
        if len(held):
            there = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
            keep[a:b] = np.bincount(of[there], minlength=b - a) >= needed(length[a:b], score) - 1
    return met[keep]


def stretches(own: np.ndarray, text: np.ndarray, n: int = SEED, score: float = SCORE) -> list[list[int]]:
    """The stretches of a text in which an item may stand; overlapping ones joined."""
    length, size = len(own), len(text)
    p, q = [], []
    for mine, grams in ((ngrams(own, n), ngrams(text, n)), (ngrams(own, 4) if length >= 4 else own[:0], split_grams(text))):
        order = np.argsort(mine, kind="stable")
        low, high = np.searchsorted(mine[order], grams, "left"), np.searchsorted(mine[order], grams, "right")
        of, place = _expanded(low, high - low)
        p.append(of)
        q.append(order[place])
    p, q = np.concatenate(p), np.concatenate(q)
    # as many words may be inserted as a match of the least score can bear, and on each side no more than there are words to match
    bear = int(length - needed(length, score))
    low, high = np.maximum(0, p - q - np.minimum(q, bear)), np.minimum(size, p + length - q + np.minimum(length - q, bear))
    both = np.concatenate([[0], np.cumsum(np.isin(ngrams(text, 2), ngrams(own, 2)))])
    enough = both[np.maximum(low, high - 1)] - both[low] >= needed(length, score) - 1
    out: list[list[int]] = []
    for a, b in sorted(set(zip(low[enough].tolist(), high[enough].tolist(), strict=True))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def best_place(own: np.ndarray, text: np.ndarray, n: int = SEED, score: float = SCORE) -> tuple[int, int, int]:
    """Score in words, start and end of the first of the item's best places in a text; zeros where no seed leads to a match."""
    best = (0, 0, 0)
    for low, high in stretches(own, text, n, score):
        s, end = align(own, text[low:high])
        if s > best[0]:
            back, length = align(own[::-1], text[low : low + end][::-1])
            best = (s, low + end - length, low + end)
    return best if best[0] >= needed(len(own), score) else (0, 0, 0)


def _search(texts: DataFrame, index: Index, ids: list, score: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ngrams(index.flat, 2)
        for batch in batches:
            out = []
            for a, _, t in pieces(batch, "text"):
                w = Words(t)
                for d, item in _enough_pairs(_met(w, index), w, index, pairs, score).tolist():
                    own = index.words(item)
                    s, start, end = best_place(own, w.hash[w.first[d] : w.first[d + 1]], index.n, score)
                    if s:
                        out.append((batch.column(0)[a + d].as_py(), ids[item], s / len(own), start, end, len(own)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "score", "start", "end", "item_words"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True)], names=names)

    return texts.select("doc_id", "text").mapInArrow(search, MATCHES)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Items in blocks of BLOCK_GRAMS words; the driver holds one block."""
    block, size = [], 0
    for r in items.toLocalIterator():
        words = len((r["text"] or "").split())
        if block and size + words > BLOCK_GRAMS:
            yield block
            block, size = [], 0
        block.append(r)
        size += words
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", seed: int = SEED, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, start, end (words of the text), item_words: the best place of each item in each text that holds it.

    No match of a score of a half or more is missed with seeds of up to three words. Null and empty texts hold nothing. Items that are null, empty or shorter than a seed are found nowhere. Repeated texts and
    repeated items are each reported; a null id is reported as null. Of equal places the first counts. Without items, or
    without texts, there are no matches. Other columns are not carried.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    found = None
    for rows in _item_blocks(items):
        index = Index(_item_words(rows), seed)
        if not len(index.distinct):
            continue
        matches = _search(texts, index, [r["item_id"] for r in rows], score)
        found = matches if found is None else found.unionByName(matches)
    if found is None:
        return texts.sparkSession.range(0).selectExpr("id doc_id", "id item_id", "double(id) score", "id start", "id end", "id item_words")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark. Rows with a null id stay."""
    bad = stored(contaminated(docs, benchmark, key, text).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
