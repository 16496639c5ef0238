"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Spark counts the pre-tokens of all texts; the most frequent ones are compiled into a
minimal acyclic automaton that shares prefixes and suffixes. Its arcs carry counts that
add up to a word's number, and numbers point to id sequences. The automaton is one file
that each executor fetches once and its Python workers memory-map. A word that the
lexicon lacks is merged exactly, pair by pair.
"""

from __future__ import annotations

import heapq
import os
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.pretokens import BLOCK_BYTES, Encoder, Pretokenizer, Vocabulary, blocks, gather, held
from rosterloom.llm.shared import open_folder, shared_dir, stored
from rosterloom.llm.words import slices

#: Least share of all pre-tokens that puts a word into the lexicon, which so has at most 1 / SHARE words.
SHARE = 1 / (1 << 17)
#: Longer words stay out of the lexicon.
WORD_BYTES = 48
#: Ids that are decoded at once.
DECODED = 1 << 18
#: From this length on a word is merged with a heap.
HEAP_FROM = 48


def merge(word: bytes, of: Vocabulary) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
    ids = list(map(of.single.__getitem__, word))
    if len(ids) >= HEAP_FROM:
        return _merge_long(ids, of)
    rank, made, none = of.ranks.get, of.made, len(of.made)
    ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
    while ranks:
        least = min(ranks)
        if least == none:
            break
        i = ranks.index(least)
        ids[i] = new = made[least]
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank(new << 32 | ids[i + 1], none)
        if i:
            ranks[i - 1] = rank(ids[i - 1] << 32 | new, none)
    return ids


def _merge_long(ids: list[int], of: Vocabulary) -> list[int]:
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def offer(i):
        j = after[i]
        if j < n and (rank := of.ranks.get(ids[i] << 32 | ids[j])) is not None:
            heapq.heappush(queue, (rank, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        rank, i, a, b = heapq.heappop(queue)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = of.made[rank], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


class PairRanks:
    """Ranks of pairs of ids as an open hash table in numpy, for many words at once."""

    def __init__(self, of: Vocabulary):
        keys = np.fromiter(of.ranks, np.uint64, len(of.ranks))
        ranks = np.fromiter(of.ranks.values(), np.int32, len(of.ranks))
        self.none, self._bits = np.int32(len(of.made)), max(4, int(len(keys) * 4).bit_length())
        size = 1 << self._bits
        self._keys, self._ranks = np.full(size, np.uint64(2**64 - 1)), np.full(size, self.none, np.int32)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):  # each free place takes one of the keys that want it; the rest move on
            free = self._keys[at[todo]] == np.uint64(2**64 - 1)
            places, one = np.unique(at[todo][free], return_index=True)
            taken = todo[free][one]
            self._keys[places], self._ranks[places] = keys[taken], ranks[taken]
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)
        self.made, self.single = np.array(of.made, np.int32), np.array(of.single, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        at = self._place(keys)
        out, todo = np.full(len(keys), self.none, np.int32), np.arange(len(keys))
        while len(todo):
            seen = self._keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self._ranks[at[todo[hit]]]
            todo = todo[~hit & (seen != np.uint64(2**64 - 1))]
            at[todo] = (at[todo] + 1) & (len(self._keys) - 1)
        return out


def merge_many(words: list[bytes], ranks: PairRanks) -> list[bytes]:
    """Ids of pre-tokens of 1 to WORD_BYTES bytes as little-endian 32-bit integers; a round merges one pair in every word."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(sizes.max())
    inside = np.arange(wide) < sizes[:, None]
    ids = np.zeros((len(words), wide), np.int32)
    ids[inside] = ranks.single[np.frombuffer(b"".join(words), np.uint8)]
    alive = inside.copy()
    after = np.tile(np.arange(1, wide + 1, dtype=np.int32), (len(words), 1))
    before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (len(words), 1))
    pairs = np.full((len(words), wide), ranks.none)
    row, at = np.nonzero(inside[:, 1:])
    pairs[row, at] = ranks.get(ids[row, at], ids[row, at + 1])
    row = np.arange(len(words))
    while len(row):
        block = pairs[row]
        at = block.argmin(axis=1)  # the leftmost of equals
        best = block[np.arange(len(row)), at]
        on = best < ranks.none
        row, at, best = row[on], at[on], best[on]
        if not len(row):
            break
        gone = after[row, at]
        ids[row, at], alive[row, gone], pairs[row, gone] = ranks.made[best], False, ranks.none
        after[row, at] = follow = after[row, gone]
        pairs[row, at] = ranks.none
        more = follow < sizes[row]
        r, a, f = row[more], at[more], follow[more]
        before[r, f] = a
        pairs[r, a] = ranks.get(ids[r, a], ids[r, f])
        back = before[row, at] >= 0
        r, a = row[back], at[back]
        b = before[r, a]
        pairs[r, b] = ranks.get(ids[r, b], ids[r, a])
    flat = ids[alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton file: arcs in order of state and label (key, target, count of words before it), final states, then the id sequences by word number."""
    register: dict[tuple, int] = {}
    arcs_of, final, count = [], [], []  # by state, children first

    def settle(node) -> int:
        arcs = tuple((label, child if isinstance(child, int) else settle(child)) for label, child in node[1].items())
        key = (node[0], arcs)
        if key not in register:
            register[key] = len(arcs_of)
            arcs_of.append(arcs)
            final.append(node[0])
            count.append(node[0] + sum(count[t] for _, t in arcs))
        return register[key]

    # Words come in order, so that a branch is settled as soon as the next word leaves it.
    root = [False, {}]
    path, last = [root], b""
    for word in sorted(words):
        common = len(os.path.commonprefix([word, last]))
        for depth in range(len(last), common, -1):
            path[depth - 1][1][last[depth - 1]] = settle(path[depth])
        del path[common + 1 :]
        for b in word[common:]:
            path[-1][1][b] = node = [False, {}]
            path.append(node)
        path[-1][0], last = True, word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1][last[depth - 1]] = settle(path[depth])
    start = settle(root)
    keys, targets, skips = array("Q"), array("I"), array("I")
    for state, arcs in enumerate(arcs_of):
        passed = int(final[state])
        for label, target in arcs:
            keys.append(state << 8 | label)
            targets.append(target)
            skips.append(passed)
            passed += count[target]
    ends, ids = array("I", [0]), array("I")
    for word in sorted(words):
        ids.extend(words[word])
        ends.append(len(ids))
    parts = [x.tobytes() for x in (keys, targets, skips, array("I", map(int, final)), ends, ids)]
    return array("Q", [start, *map(len, parts)]).tobytes() + b"".join(parts)


class Lexicon:
    """A memory-mapped automaton; many words walk through it side by side."""

    def __init__(self, path: str):
        start, *sizes = np.fromfile(path, np.uint64, 7).tolist()
        self._start, at, parts = start, 56, []
        whole = np.memmap(path, np.uint8, "r")
        for size, kind in zip(sizes, (np.uint64, *[np.uint32] * 5)):
            parts.append(whole[at : at + size].view(kind))
            at += size
        self._keys, self._target, self._skip, self._final, self._end, self._ids = parts

    def get(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian 32-bit integers, or None."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        state, number = np.full(len(words), self._start, np.uint64), np.zeros(len(words), np.int64)
        letters, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        on, step = np.flatnonzero(sizes), 0
        known = sizes == 0
        while len(on):
            key = state[on] << np.uint64(8) | letters[first[on] + step]
            arc = np.minimum(np.searchsorted(self._keys, key), max(0, len(self._keys) - 1))
            there = self._keys[arc] == key if len(self._keys) else np.zeros(len(on), bool)
            on, arc, step = on[there], arc[there], step + 1
            state[on], number[on] = self._target[arc], number[on] + self._skip[arc]
            done = sizes[on] == step
            known[on[done]] = True
            on = on[~done]
        known &= self._final[state.astype(np.int64)] == 1
        out: list[bytes | None] = [None] * len(words)
        for i in np.flatnonzero(known).tolist():
            out[i] = self._ids[self._end[number[i]] : self._end[number[i] + 1]].tobytes()
        return out


def encoder(of: Vocabulary, lexicon: Lexicon) -> Encoder:
    """Looks words up in the lexicon, and merges the ones it lacks."""
    ranks = PairRanks(of)

    def learn(words: list[bytes]) -> list[bytes]:
        found = lexicon.get(words)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i in unseen:
            if len(words[i]) > WORD_BYTES:
                found[i] = array("I", merge(words[i], of)).tobytes()
        unseen = sorted((i for i in unseen if found[i] is None), key=lambda i: len(words[i]))  # those of a block are of about one length
        for at in range(0, len(unseen), 1 << 12):
            part = unseen[at : at + (1 << 12)]
            for i, ids in zip(part, merge_many([words[i] for i in part], ranks)):
                found[i] = ids
        return found

    return Encoder(of.added, learn)


class Decoder:
    """Decodes columns of ids."""

    def __init__(self, of: Vocabulary):
        sizes = np.zeros(max(of.bytes) + 1, np.int64)
        sizes[list(of.bytes)] = [len(b) for b in of.bytes.values()]
        self._sizes, self._first = sizes, np.cumsum(sizes) - sizes
        self._letters = np.frombuffer(b"".join(of.bytes[i] for i in sorted(of.bytes)), np.uint8)

    def _bytes(self, ids: np.ndarray) -> bytes:
        return gather(self._letters, self._first, self._sizes, ids).tobytes()

    def texts(self, column: pa.Array):
        for _, data, offsets in slices(column, 4 * DECODED):
            ids, ends = np.frombuffer(data.tobytes(), "<u4"), (offsets >> 2)
            if len(ends) == 2:
                yield b"".join(self._bytes(ids[i : i + DECODED]) for i in range(0, len(ids), DECODED)).decode("utf-8", "replace")
                continue
            whole, cuts = self._bytes(ids), np.concatenate(([0], np.cumsum(self._sizes[ids])))[ends].tolist()
            yield from (whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:]))


def _count_words(batches):
    """Counts of the pre-tokens of each block; Spark adds them up, within each task first."""
    pretokenizer = Pretokenizer([])
    for batch in batches:
        for _, data, offsets in blocks(batch.column(0)):
            words, _ = pretokenizer.words(data, offsets)
            counted = words.value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])


def frequent_words(documents: DataFrame, share: float = SHARE) -> list[bytes]:
    """The pre-tokens that make up at least ``share`` of all pre-tokens of all texts."""
    counted = stored(documents.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    counted = counted.filter((F.col("n") >= max(1, share * total)) & (F.octet_length("word") <= WORD_BYTES))
    return [bytes(r.word) for r in counted.select("word").collect()]


class Codec:
    """Encoder and decoder columns for one tokenizer file and one lexicon."""

    def __init__(self, documents: DataFrame, tokenizer_file: str, share: float = SHARE):
        with open(tokenizer_file, encoding="utf-8") as file:
            text = file.read()
        spark = documents.sparkSession
        vocabulary = Vocabulary(text)
        chosen = {w: merge(w, vocabulary) for w in frequent_words(documents, share)}
        self._name = f"lexicon-{uuid.uuid4().hex}.bin"
        folder = shared_dir(spark)
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{self._name}") as file:
            file.write(compile_lexicon(chosen))
        spark.sparkContext.addFile(f"{folder}/{self._name}")
        self._file = spark.sparkContext.broadcast(text)

    def loader(self):
        """What gives a Python worker its encoder and decoder."""
        name, file = self._name, self._file

        def make():
            vocabulary = Vocabulary(file.value)
            return encoder(vocabulary, Lexicon(SparkFiles.get(name))), Decoder(vocabulary)

        return lambda: held(name, make)

    def encode(self, text: Column) -> Column:
        """Ids as binary, little-endian unsigned 32-bit integers; null and empty texts have none."""
        load = self.loader()

        def run(texts: pa.Array) -> pa.Array:
            return pa.array(load()[0].texts(texts), pa.binary())

        return F.arrow_udf(run, "binary")(text)

    def decode(self, ids: Column) -> Column:
        """The text of such ids; bytes that are no UTF-8 become U+FFFD. Null gives an empty text."""
        load = self.loader()

        def run(column: pa.Array) -> pa.Array:
            return pa.array(load()[1].texts(column), pa.string())

        return F.arrow_udf(run, "string")(ids)


def encode_decode(documents: DataFrame, tokenizer_file: str, share: float = SHARE) -> DataFrame:
    """``documents`` with ``ids`` (binary) and ``decoded``; every row is kept, columns of these names are replaced.

    Null and empty texts have no ids and decode to an empty text; a very long text is encoded and
    decoded piece by piece, whole; repeated rows and ties are encoded each; an empty table gives
    none; other columns are kept, whatever their names.
    """
    load = Codec(documents, tokenizer_file, share).loader()
    others = documents.drop("ids", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema)
    return others.mapInArrow(_coder(load), f"{schema}, ids binary, decoded string").select(*(f"`{c}`" for c in documents.columns if c not in ("ids", "decoded")), "ids", "decoded")


def _coder(load):
    """Batches with ids and decoded, in pieces of bounded bytes, so that a task never holds those of a whole batch."""
    def run(batches):
        encode, decode = (x.texts for x in load())
        for batch in batches:
            at, names = batch.schema.get_field_index("text"), [*batch.schema.names, "ids", "decoded"]
            starts = [row for row, _, _ in slices(batch.column(at), BLOCK_BYTES)]
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                piece = batch.slice(start, end - start)
                ids = pa.array(encode(piece.column(at)), pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns, ids, pa.array(decode(ids), pa.string())], names=names)

    return run
