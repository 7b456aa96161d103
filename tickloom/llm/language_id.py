"""Language identification with hyperdimensional profiles.

A letter is a random vector of +1 and -1. A trigram binds its three letters: the first vector is permuted (rotated) twice,
the second once, the third not at all, and the three are multiplied. A text is the bundle (sum) of its trigrams, a language
prototype the bundle of its texts at unit length. A text gets the language whose prototype has the largest cosine.

Letters are what Unicode calls alphabetic, in lower case; A to Z have a vector of their own, all others share 37 by a hash.
A run of other characters is one boundary, which has a vector too; a trigram never has the boundary in its middle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tickloom.llm.common import Texts, crc_mod, extended, pieces, schema_with

DIM = 512
SLOTS = 64
UNKNOWN = "und"
#: Texts in one matrix product.
ROWS = 128

_cache: dict[str, np.ndarray] = {}


def letter_slots() -> np.ndarray:
    """Slot of every code point: 0 for what is no letter."""
    if "slots" not in _cache:
        slots = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                slots[cp] = low - 96 if 97 <= low <= 122 else 27 + ((low * 2654435761) >> 11) % 37
        _cache["slots"] = slots
    return _cache["slots"]


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the third letter, and of each bound pair of a first and a second."""
    if "third" not in _cache:
        base = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SLOTS, DIM))
        first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        _cache["third"], _cache["pair"] = base, (first[:, None, :] * second[None, :, :]).reshape(SLOTS * SLOTS, DIM)
    return _cache["third"], _cache["pair"]


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the texts one after another, and where each text's begin."""
    decoded = [texts.text(i).decode("utf-8", "replace") for i in range(texts.n)]
    points = np.frombuffer(("\0".join(decoded) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = letter_slots()[points]
    keep = np.ones(len(slots), bool)
    keep[1:] = (slots[1:] != 0) | (slots[:-1] != 0)
    place = np.flatnonzero(keep)
    s = np.concatenate([[0], slots[place], [0]]).astype(np.int32)
    middle = np.flatnonzero(s[1:-1]) + 1
    codes = s[middle - 1] << 12 | s[middle] << 6 | s[middle + 1]
    ends = np.cumsum([len(d) + 1 for d in decoded])
    return codes, np.concatenate([[0], np.searchsorted(place[middle - 1], ends)])


def bundles(texts: Texts) -> np.ndarray:
    """One vector per text; zeros where it has no letter."""
    codes, first = trigrams(texts)
    third, pair = letters()
    out = np.zeros((texts.n, DIM), np.float32)
    for a in range(0, texts.n, ROWS):
        b = min(a + ROWS, texts.n)
        distinct, counts = [], []
        for i in range(a, b):
            c = np.sort(codes[first[i] : first[i + 1]])
            edge = np.flatnonzero(np.diff(c, prepend=-1))
            distinct.append(c[edge])
            counts.append(np.diff(edge, append=len(c)))
        used = np.unique(np.concatenate(distinct))
        if not len(used):
            continue
        table = np.zeros((b - a, len(used)), np.float32)
        for k, (d, n) in enumerate(zip(distinct, counts, strict=True)):
            table[k, np.searchsorted(used, d)] = n
        out[a:b] = table @ (pair[used >> 6] * third[used & 63]).astype(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def profiles(docs: DataFrame, text: str = "text", label: str = "lang") -> dict[str, list[float]]:
    """Prototype of each label: the sum of its texts' unit vectors. Null labels and texts without letters teach nothing.

    Tasks return one vector per label, so the driver gets labels x tasks vectors in a shuffle and one per label in the end.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for a, b, t in pieces(batch, "text"):
                vectors = _unit(bundles(t)).astype(np.float64)
                group = np.array(names[a:b], object)
                for name in set(names[a:b]):
                    sums[name] = sums.get(name, 0) + vectors[group == name].sum(axis=0)
        rows = [(n, i, float(x)) for n, v in sums.items() for i, x in enumerate(v)]
        yield pa.RecordBatch.from_pydict({"label": pa.array([r[0] for r in rows], pa.string()), "dim": pa.array([r[1] for r in rows], pa.int32()), "x": pa.array([r[2] for r in rows], pa.float64())})

    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sums = known.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).mapInArrow(partial, "label string, dim int, x double")
    found = sums.groupBy("label", "dim").agg(F.round(F.sum("x"), 6).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return {r["label"]: [p["x"] for p in r["v"]] for r in found.collect() if any(p["x"] for p in r["v"])}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text", names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, then lang_pred and score (cosine, 0 to 1) or as named; older columns of these names give way.

    Null texts, texts without letters, and all texts if there are no prototypes: `und` with score 0. A tie goes to the
    first label in order. Repeated rows get the same answer; a text of any length is read whole.
    """
    names = sorted(prototypes)
    matrix = _unit(np.array([prototypes[n] for n in names], np.float64)) if names else np.zeros((0, DIM))
    pred, cosine = names_out
    added = StructType([StructField(pred, StringType()), StructField(cosine, DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, _, t in pieces(batch, text):
                v = bundles(t).astype(np.float64)
                some = v.any(axis=1)
                if not names:
                    some[:] = False
                    best = top = np.zeros(t.n, np.int64)
                else:
                    cos = _unit(v) @ matrix.T
                    best = cos.argmax(axis=1)
                    top = np.clip(cos[np.arange(t.n), best], 0.0, 1.0)
                langs += [names[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)]
                scores.append(np.where(some, top, 0.0))
            yield extended(batch, {pred: pa.array(langs, pa.string()), cosine: pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    return docs.mapInArrow(predict, schema_with(docs, added))


def length_class(text: str = "text") -> Column:
    """Binary logarithm of the text's length."""
    return F.floor(F.log2(F.length(text) + 1)).cast("int")


def least_scores(labelled: DataFrame, prototypes: dict[str, list[float]], text: str = "text", share: float = 0.001, slack: float = 0.75, rows: int = 50) -> list[tuple[int, float]]:
    """(length class, score) pairs: what nearly all labelled texts of this length exceed, less some slack.

    Lengths with fewer than `rows` texts say nothing; a text is held to the nearest shorter length that does, and to nothing below
    the first. All labelled texts count; scores are counted to six places before they meet, so a length has at most a million of them.
    """
    judged = identify(labelled.select(F.col(text).alias("text")), prototypes, names_out=("found", "cosine")).where(F.col("found") != UNKNOWN)
    counts = judged.groupBy(length_class().alias("bin"), F.round("cosine", 6).alias("cosine")).agg(F.count(F.lit(1)).alias("times"))
    bins = counts.groupBy("bin").agg(F.sum("times").alias("n"), F.percentile("cosine", F.lit(share), F.col("times")).alias("q")).where(F.col("n") >= rows)
    return [(r["bin"], slack * r["q"]) for r in bins.orderBy("bin").collect()]


def least_score(floors: list[tuple[int, float]], text: str = "text") -> Column:
    """The score that a text of this length must reach."""
    out = F.lit(0.0)
    for at, floor in floors:
        out = F.when(length_class(text) >= at, F.lit(floor)).otherwise(out)
    return out


def held_out_prediction(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents whose crc32 modulo 4 is not 2, predicted for all.

    A null doc_id belongs to neither side: nothing is learned from it, and held_out is false.
    """
    fold = crc_mod("doc_id", 4)
    learned = profiles(docs.where(fold != 2))
    every = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return identify(every, learned).select("doc_id", "held_out", "lang_pred", "score")
