"""Byte-level pre-tokens, cut exactly as the public byte-level BPE vocabulary expects.

Texts are Arrow columns; bounds are found for blocks of them at once, and the distinct
pre-tokens of a block are looked up once each.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from rosterloom.llm.words import slices

#: Fixed value: the pre-token pattern of the vocabulary. ``starts`` finds its matches without running it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE = 1, 2, 3
#: A longer text is cut into blocks of about so many bytes.
BLOCK_BYTES = 1 << 20
#: Bytes of words and ids that an encoder remembers, with what Python needs for an entry beside them.
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 180

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or 0 for every code point."""
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    every, out = "".join(map(chr, points)), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            out[points[found.start() : found.end()]] = kind
    return out


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points, and where each begins (None: at its own number)."""
    if data.max() < 0x80:
        return data, None
    lead = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
    points = data[lead].astype(np.int32)
    wide = np.flatnonzero(points >= 0x80)
    first, at = points[wide], lead[wide]
    more = lambda j: (data[np.minimum(at + j, len(data) - 1)] & 0x3F).astype(np.int32)
    two = (first & 0x1F) << 6 | more(1)
    three = (first & 0x0F) << 12 | more(1) << 6 | more(2)
    four = (first & 0x07) << 18 | more(1) << 12 | more(2) << 6 | more(3)
    points[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return points, lead


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the texts of a block begin, in bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    points, lead = characters(data)
    n, kind = len(points), classes()[points]
    heads = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    heads = heads if lead is None else np.searchsorted(lead, heads)
    head = np.zeros(n + 1, bool)
    head[heads] = head[n] = True
    space, blank = kind == SPACE, points == 0x20
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) & ~(blank[:-1] & ~space[1:])  # one blank belongs to the run after it
    start[:-1] |= space[:-1] & ~space[1:] & ~head[1:-1]  # so the last white space before a run stands apart
    start |= head[:-1]
    quotes = np.flatnonzero(start & (points == 0x27))
    if len(quotes):
        one, two = quotes + 1, quotes + 2
        inside = ~head[one]
        next_one = np.where(inside, points[np.minimum(one, n - 1)], 0)
        next_two = np.where(inside & ~head[np.minimum(two, n)], points[np.minimum(two, n - 1)], 0)
        is_one = np.isin(next_one, [ord(c) for c in "stmd"])
        pair = next_one.astype(np.int64) << 8 | next_two
        is_two = np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (next_two < 256)
        start[one[is_one | is_two]] = False
        ends = np.concatenate((two[is_one], two[is_two] + 1))
        start[ends[ends < n]] = True
    return np.flatnonzero(start) if lead is None else lead[start]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) as ``slices``, with long texts in several blocks of one text each.

    They are cut before a blank that follows an ASCII letter or digit, where a pre-token begins in any case.
    """
    for row, data, offsets in slices(column, BLOCK_BYTES):
        at = 0
        while len(offsets) == 2 and len(data) - at > 2 * BLOCK_BYTES:
            there = at + BLOCK_BYTES
            while there < len(data):  # look on in steps, as most texts have a blank soon
                ahead = data[there - 1 : there + 4096]
                cut = np.flatnonzero(_ALNUM[ahead[:-1]] & (ahead[1:] == 0x20))
                if len(cut):
                    there += int(cut[0])
                    break
                there += 4096
            if there >= len(data):
                break
            yield row, data[at:there], np.array([0, there - at])
            at = there
        yield row, data[at:], offsets if not at else np.array([0, len(data) - at])


class Pretokenizer:
    """Pre-tokens of Arrow columns, with added tokens kept whole."""

    def __init__(self, added: list[str]):
        self._added = re.compile(b"|".join(re.escape(a.encode()) for a in sorted(added, key=len, reverse=True))) if added else None

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The pre-tokens of a block, and the number of the first of each text (and the total)."""
        at = starts(data, offsets)
        whole = data.tobytes()
        if self._added and self._added.search(whole):
            at = self._with_added(data, whole, offsets, at)
        first = np.searchsorted(at, offsets)
        bounds = np.append(at, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(whole)]), first

    def _with_added(self, data, whole: bytes, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        edges, inside = [offsets], np.zeros(len(data) + 1, bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for found in self._added.finditer(whole, a, b):
                edges.append(np.array(found.span()))
                inside[found.start() + 1 : found.end()] = True
        at = starts(data, np.unique(np.concatenate(edges)))
        return at[~inside[at]]


def listed(words: pa.BinaryArray) -> list[bytes]:
    """``words`` as a list, without a scalar object for each."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    whole = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]


def gather(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (from ``first``, so many as ``sizes``) that ``which`` names, one after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return values[np.repeat(first[which] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Encodes Arrow text columns in one Python worker; ``learn`` gives the ids of words not remembered.

    Words and ids are little-endian 32-bit integers in bytes; what is remembered is bounded in bytes.
    """

    def __init__(self, added: dict[str, int], learn: Callable[[list[bytes]], list[bytes]]):
        self._pretokenizer, self._learn, self._memo, self._held = Pretokenizer(list(added)), learn, {}, 0
        self._added = {t.encode(): np.array([i], "<u4").tobytes() for t, i in added.items()}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if self._held > MEMO_BYTES:
            self._memo = dict(self._added)
            self._held = 0
        elif not self._memo:
            self._memo = dict(self._added)
        found = list(map(self._memo.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        learned = self._learn([words[i] for i in new])
        for i, ids in zip(new, learned):
            found[i] = ids
            size = len(words[i]) + len(ids)
            if size <= MEMO_BYTES >> 10:
                self._memo[words[i]] = ids
                self._held += size + ENTRY_BYTES
        return found

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a block."""
        words, first = self._pretokenizer.words(data, offsets)
        if not len(words):
            return [b""] * (len(offsets) - 1)
        coded = words.dictionary_encode()
        found = self._ids(listed(coded.dictionary))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        which = coded.indices.to_numpy()
        ids = gather(np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes, which)
        ends = np.concatenate(([0], np.cumsum(sizes[which])))[first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column, block by block."""
        waiting, row = [], -1  # of a text that comes in several blocks
        for at, data, offsets in blocks(column):
            found = self.block(data, offsets)
            if row >= 0 and at != row:
                yield b"".join(waiting)
                row = -1
            if len(found) == 1:
                waiting, row = ([*waiting, found[0]] if row == at else found), at
            else:
                yield from found
        if row >= 0:
            yield b"".join(waiting)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file's JSON text."""

    def __init__(self, text: str):
        file = json.loads(text)
        model, letters = file["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.bytes |= {i: token.encode() for token, i in self.added.items()}
        self.single = [0] * 256
        for i, b in self.bytes.items():
            if len(b) == 1 and i not in self.added.values():
                self.single[b[0]] = i
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = list(pairs)
        #: Rank of a merge by its pair of ids (first * 2^32 + second), and the id that each rank makes.
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = array("i", (ids[a + b] for a, b in pairs))


_held: tuple[str, object] = ("", None)


def held(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, once for each key in a row: a Python worker holds one such object at a time."""
    global _held
    if _held[0] != key:
        _held = ("", None)  # let go before the next one is made
        _held = (key, make())
    return _held[1]
