"""Language ID with word-first backoff.

Known words are scored by their log frequency in each language. An unseen word is scored
place by place with the longest known character n-gram that starts there, 4 letters down
to 1. Model size is bounded by the rule itself: what is kept has at least ``SHARE`` of a
language's words (or n-grams of one length), so there are at most 1 / SHARE of each.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.pretokens import LETTER, blocks, characters, classes, held, listed
from rosterloom.llm.shared import free_name, held_out, stored

#: Least share of a language's words that makes a word known; the same for n-grams of each length.
SHARE = 2e-5
LONGEST = 4
#: Added to every count.
SMOOTH = 0.5
#: Words whose scores a Python worker remembers, and their bytes; letters of words whose n-grams are counted at once.
MEMO, MEMO_BYTES, CHARS = 1 << 18, 1 << 22, 1 << 20
#: Of an alphabet below this size, LONGEST letters fit one number.
MOST_LETTERS = 55_000

_COUNTS = "lang string, n int, gram string, count long"


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The runs of letters and of other characters of a block of texts: their bytes, which are letters, and the text of each."""
    points, lead = characters(data)
    letter = classes()[points] == LETTER
    start = np.ones(len(points), bool)
    start[1:] = letter[1:] != letter[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads if lead is None else np.searchsorted(lead, heads)] = True
    at = np.flatnonzero(start)
    begin = at if lead is None else lead[at]
    bounds = np.append(begin, len(data)).astype(np.int32)
    owner = np.searchsorted(offsets, begin, side="right") - 1
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())]), letter[at], owner


class Letters:
    """Words between their marks as letters, each a number of an alphabet; n-grams of up to LONGEST letters are one number."""

    def __init__(self, words: list[str], alphabet: np.ndarray | None = None):
        points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32)
        self.owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
        self.alphabet = np.unique(points) if alphabet is None else alphabet
        at = np.minimum(np.searchsorted(self.alphabet, points), max(0, len(self.alphabet) - 1))
        self._codes = np.where(self.alphabet[at] == points, at, len(self.alphabet)) if len(self.alphabet) else np.zeros(len(points), np.int64)
        self.fits = len(self.alphabet) < MOST_LETTERS

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams begin, and their numbers."""
        count = max(0, len(self.owner) - n + 1)
        at = np.flatnonzero(self.owner[:count] == self.owner[n - 1 :][:count])
        return at, reduce(lambda key, j: key * (len(self.alphabet) + 1) + self._codes[at + j], range(1, n), self._codes[at].astype(np.int64))

    def spelled(self, keys: np.ndarray, n: int) -> list[str]:
        letters = np.empty((len(keys), n), np.uint32)
        for j in range(n - 1, -1, -1):
            keys, code = np.divmod(keys, len(self.alphabet) + 1)
            letters[:, j] = self.alphabet[code]
        whole = letters.tobytes().decode("utf-32-le")
        return [whole[i : i + n] for i in range(0, n * len(letters), n)]


def _rows(langs, n, grams, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(n, pa.int32()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "n", "gram", "count"])


def _count_words(batches):
    """How often each word of a block is there in each language; Spark adds them up, within each task first."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        names, lang_of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        for row, data, offsets in blocks(pc.utf8_lower(batch.column(1))):
            if not len(data):
                continue
            runs, letter, owner = word_runs(data, offsets)
            words = runs.dictionary_encode()
            keys = words.indices.to_numpy().astype(np.int64) * len(names) + lang_of[row + owner]
            keys, counts = np.unique(keys[letter], return_counts=True)
            yield _rows([names[k] for k in (keys % len(names)).tolist()], np.zeros(len(keys)), words.dictionary.take(pa.array(keys // len(names))).cast(pa.string()), counts)


def _count_grams(batches):
    """Counts of the n-grams of counted words, by language, for about CHARS letters at a time."""
    waiting: dict[str, list[tuple[str, int]]] = defaultdict(list)
    held_chars = 0

    def counted(lang: str, words: list[tuple[str, int]]):
        letters = Letters([w for w, _ in words])
        if not letters.fits:
            half = len(words) // 2
            if half:
                yield from counted(lang, words[:half])
                yield from counted(lang, words[half:])
                return
            marked, times = f"<{words[0][0]}>", words[0][1]
            every = [marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)]
            yield _rows([lang] * len(every), list(map(len, every)), every, [times] * len(every))
            return
        times = np.array([c for _, c in words], np.int64)[letters.owner]
        for n in range(1, LONGEST + 1):
            at, keys = letters.grams(n)
            keys, where = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, where, times[at])
            yield _rows([lang] * len(keys), np.full(len(keys), n), letters.spelled(keys, n), sums)

    for batch in batches:
        for lang, word, count in zip(*(c.to_pylist() for c in batch.columns)):
            waiting[lang].append((word, count))
            held_chars += len(word) + 2
            if held_chars > CHARS:
                for name, words in waiting.items():
                    yield from counted(name, words)
                waiting.clear()
                held_chars = 0
    for name, words in waiting.items():
        yield from counted(name, words)


class Model:
    """Log frequencies by gram, one column for each language, centred so that a row only tells languages apart."""

    def __init__(self, langs: list[str], rows: list[tuple[int, str, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        index: dict[tuple[int, str], int] = {}
        for n, gram, _, _ in rows:
            index.setdefault((n, gram), len(index))
        counts = np.full((len(index), max(1, len(langs))), SMOOTH)
        for n, gram, lang, count in rows:
            counts[index[n, gram], place[lang]] += count
        kinds = np.array([n for n, _ in index], int)
        size = np.array([[totals.get((lang, n), 0) for lang in langs] for n in range(LONGEST + 1)], float).reshape(LONGEST + 1, -1)
        vocabulary = np.bincount(kinds, minlength=LONGEST + 1)[:, None] * SMOOTH + 1
        logs = np.log(counts) - np.log(size + vocabulary)[kinds] if len(index) else counts
        self.scores = (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)
        self.known = {gram: i for (n, gram), i in index.items() if n == 0}
        spelled = [[(gram, i) for (n, gram), i in index.items() if n == size] for size in range(1, LONGEST + 1)]
        points = np.frombuffer("".join(gram for grams in spelled for gram, _ in grams).encode("utf-32-le"), np.uint32)
        self._alphabet = np.unique(points)
        self._by_gram = None if len(self._alphabet) < MOST_LETTERS else {gram: i for grams in spelled for gram, i in grams}
        #: By length the numbers of the known n-grams, in order, and their rows.
        self._grams = []
        for size, grams in enumerate(spelled, 1):
            codes = np.searchsorted(self._alphabet, np.frombuffer("".join(g for g, _ in grams).encode("utf-32-le"), np.uint32)).reshape(-1, size)
            keys = reduce(lambda key, j: key * (len(self._alphabet) + 1) + codes[:, j], range(1, size), codes[:, 0].astype(np.int64))  # noqa: B023
            order = np.argsort(keys, kind="stable")
            self._grams.append((keys[order], np.array([i for _, i in grams], np.int64)[order]))

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: its own, or the mean of those of the longest known n-grams, place by place; zeros without any."""
        known = np.array([self.known.get(w, -1) for w in words], np.int64)
        out = np.zeros((len(words), self.scores.shape[1]), np.float32)
        out[known >= 0] = self.scores[known[known >= 0]]
        unseen = np.flatnonzero(known < 0)
        for first in range(0, len(unseen), 1 << 14):
            part = unseen[first : first + (1 << 14)]
            letters = Letters([words[i] for i in part], self._alphabet)
            found = np.full(len(letters.owner), -1, np.int64)
            if self._by_gram is not None:
                found = np.array([self._longest(f"<{words[i]}>", j) for i in part for j in range(len(words[i]) + 2)], np.int64)
            for n in range(LONGEST if self._by_gram is None else 0, 0, -1):
                keys, rows = self._grams[n - 1]
                if len(keys):
                    at, asked = letters.grams(n)
                    at, asked = at[found[at] < 0], asked[found[at] < 0]
                    place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    hit = keys[place] == asked
                    found[at[hit]] = rows[place[hit]]
            owner, rows = letters.owner[found >= 0], found[found >= 0]
            sizes = np.maximum(1, np.bincount(owner, minlength=len(part)))
            for k in range(out.shape[1]):
                out[part, k] = np.bincount(owner, weights=self.scores[rows, k], minlength=len(part)) / sizes
        return out

    def _longest(self, marked: str, i: int) -> int:
        return next((at for n in range(min(LONGEST, len(marked) - i), 0, -1) if (at := self._by_gram.get(marked[i : i + n])) is not None), -1)

    def word(self, word: str) -> np.ndarray:
        return self.words([word])[0]


class _Scorer:
    """Sums of scores of texts; remembers words and their scores within bounds."""

    def __init__(self, model: Model):
        self.model, self._known, self._bytes = model, {}, 0
        self._table = np.zeros((MEMO, max(1, len(model.langs))), np.float32)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words in the table; a block may bring more than it held until then."""
        if self._bytes > MEMO_BYTES or len(self._known) + len(words) > len(self._table):
            self._known.clear()
            self._bytes = 0
            if len(words) > len(self._table):
                self._table = np.zeros((len(words), self._table.shape[1]), np.float32)
        new = [w for w in words if w not in self._known]
        if new:
            at = len(self._known)
            self._table[at : at + len(new)] = self.model.words([w.decode() for w in new])
            self._known.update(zip(new, range(at, at + len(new))))
            self._bytes += sum(map(len, new))
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The sum of scores of every text by language, and its number of words."""
        sums, counts = np.zeros((len(column), self._table.shape[1])), np.zeros(len(column), np.int64)
        for row, data, offsets in blocks(pc.utf8_lower(column)):
            if not len(data):
                continue
            runs, letter, owner = word_runs(data, offsets)
            words = runs.filter(pa.array(letter)).dictionary_encode()
            place, owner, n = self._places(listed(words.dictionary))[words.indices.to_numpy()], owner[letter], len(offsets) - 1
            counts[row : row + n] += np.bincount(owner, minlength=n)
            for k in range(sums.shape[1]):
                sums[row : row + n, k] += np.bincount(owner, weights=self._table[place, k], minlength=n)
        return sums, counts


def learn(documents: DataFrame, share: float = SHARE) -> Model:
    """Count words and n-grams of all given (lang, text) rows and keep those frequent in some language."""
    counted = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    added = lambda rows: stored(rows.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")))
    words = added(counted.mapInArrow(_count_words, _COUNTS))
    counted = words.unionAll(added(words.select("lang", "gram", "count").mapInArrow(_count_grams, _COUNTS)))
    totals = {(r.lang, r.n): r.total for r in counted.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()}
    if not totals:
        return Model([], [], {})
    least = F.create_map(*(F.lit(x) for (lang, n), total in totals.items() for x in (f"{n} {lang}", max(1, math.ceil(share * total)))))
    frequent = F.col("count") >= least[F.concat_ws(" ", "n", "lang")]
    rows = counted.withColumn("kept", F.max(frequent).over(Window.partitionBy("n", "gram"))).filter("kept").select("n", "gram", "lang", "count").collect()
    return Model(sorted({lang for lang, _ in totals}), [tuple(r) for r in rows], totals)


def identify(documents: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``documents`` with two more columns: ``pred`` and ``score`` (0 to 1: the language's share of the posterior).

    A null or empty text, one without a letter, and every text under a model that learned nothing
    gets ``und`` and 0. A very long text is scored whole. Ties go to the first language in order.
    Every row is kept as it is, repeated ones too; an empty table gives none. Columns that are
    named ``pred`` or ``score`` already are replaced; all others are kept, whatever their names.
    """
    shared, key = documents.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        scorer = held(key, lambda: _Scorer(shared.value))
        sums, counts = scorer.texts(texts)
        best = sums.argmax(axis=1)
        score = 1 / np.exp(sums - sums[np.arange(len(sums)), best][:, None]).sum(axis=1)
        said = (counts > 0) & bool(scorer.model.langs)
        names = np.array([*scorer.model.langs, "und"], object)[np.where(said, best, len(scorer.model.langs))]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(said, score, 0.0))], names=["lang", "score"])

    # Marked so that a filter on the result isn't pushed below it, which would run the model twice.
    said = F.arrow_udf(run, "lang string, score double").asNondeterministic()
    said_in = free_name("_said", documents.columns)
    out = documents.withColumn(said_in, said(F.col("text")))
    return out.withColumn(pred, F.col(said_in)["lang"]).withColumn(score, F.col(said_in)["score"]).drop(said_in)


def learn_and_identify(documents: DataFrame, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Learn from the rows that are not held out, then identify all rows."""
    return identify(documents, learn(documents.filter(~held_out(F.col("doc_id")))), pred, score)
