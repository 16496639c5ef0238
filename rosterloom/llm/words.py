"""Words of Arrow text columns as flat numpy arrays: bounds, owners and 64-bit hashes.

Two word classes are byte-exact on UTF-8, as every byte of a non-ASCII character
is 0x80 or more: *plain* words (ASCII letters and digits in lower case, and
everything non-ASCII) and *spaced* words (runs without ASCII white space).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer single text is taken alone.
SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_LOWERED = LOWER.astype(int)
PLAIN = (_LOWERED >= 0x80) | ((_LOWERED >= 0x30) & (_LOWERED <= 0x39)) | ((_LOWERED >= 0x61) & (_LOWERED <= 0x7A))
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each text in them) for runs of rows of bounded size; null is empty."""
    if column.null_count:
        column = column.fill_null(pa.scalar(b"", pa.binary()).cast(column.type))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word, in order."""
    inside = kind[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    start[first], end[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sizes = ends - starts
        heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
        values = BYTE_HASH[data[np.repeat(starts, sizes) + place]] * powers(int(sizes.max()))[place]
        return mix(np.add.reduceat(values, heads) + sizes.astype(np.uint64))


def grams(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``n`` words inside one text."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:count] == owner[n - 1 :])
    with np.errstate(over="ignore"):
        out = words[at].copy()
        for j in range(1, n):
            out = mix(out * _BASE + words[at + j])
        return (mix(out) if n == 1 else out), at


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index, and index within its text of every plain word, in lower case."""
    lowered = LOWER[data]
    starts, ends, owner = bounds(lowered, offsets, PLAIN)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    return hashes(lowered, starts, ends), owner, np.arange(len(owner)) - first[owner]


def distinct_grams(words: np.ndarray, owner: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of the distinct runs of ``n`` words, by owner and hash; a text of fewer words is one run."""
    sizes = np.bincount(owner, minlength=n_texts)
    codes, first = grams(words, owner, n)
    parts = [(codes, owner[first])]
    for fewer in range(1, n):
        if (sizes == fewer).any():
            codes, first = grams(words, owner, fewer)
            whole = sizes[owner[first]] == fewer
            parts.append((codes[whole], owner[first][whole]))
    codes, of = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes)
    small = of[order].astype(np.uint16) if n_texts <= 1 << 16 else of[order]
    order = order[np.argsort(small, kind="stable")]
    codes, of = codes[order], of[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], codes[at], np.diff(np.append(at, len(codes)))
