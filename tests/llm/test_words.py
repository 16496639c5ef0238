import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm.words import PLAIN, SPACED, LOWER, bounds, grams, slices, word_table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ALPHABET = st.text(alphabet="aAzZ09é漢😀 \n\t.-_/@[`{~\x00\x7f", max_size=40)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


@settings(deadline=None)
@given(st.lists(st.none() | ALPHABET, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for row, data, offsets in slices(pa.array(texts, pa.string())):
        n = len(offsets) - 1
        for kind, pattern in ((PLAIN, WORD), (SPACED, re.compile("[^\x20\x09-\x0d]+"))):
            lowered = LOWER[data]
            starts, ends, owner = bounds(lowered, offsets, kind)
            whole = lowered.tobytes()
            got = [[] for _ in range(n)]
            for a, b, o in zip(starts, ends, owner):
                got[o].append(whole[a:b].decode())
            assert got == [pattern.findall(lower(t or "")) for t in texts[row : row + n]]


@settings(deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=6), st.integers(1, 4))
def test_equal_grams_have_equal_hashes(texts, n):
    (_, data, offsets), *_ = slices(pa.array(texts, pa.string()))
    words, owner, place = word_table(data, offsets)
    codes, first = grams(words, owner, n)
    found = [WORD.findall(lower(t)) for t in texts]
    keys = [tuple(found[owner[i]][place[i] : place[i] + n]) for i in first]
    assert len(keys) == sum(max(0, len(w) - n + 1) for w in found)
    assert len(set(keys)) == len(set(codes.tolist())) and len(set(zip(keys, codes.tolist()))) == len(set(keys))


def test_sliced_arrays_and_empty_columns():
    column = pa.array(["x y", "z", None, "w"], pa.string()).slice(1, 3)
    (_, data, offsets), = slices(column)
    assert data.tobytes() == b"zw" and offsets.tolist() == [0, 1, 1, 2]
    assert list(slices(pa.array([], pa.string()))) == []
    assert np.array_equal(word_table(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0], np.zeros(0, np.uint64))
