"""Benchmark decontamination by winnowing.

Every text gives k-gram hashes of its words; of each window of consecutive k-gram
hashes the smallest (the rightmost of equals) is a fingerprint. Spark joins the
fingerprints of documents and benchmark items, and each joined pair is extended
word by word on both sides. Any shared run of ``SPAN`` words has a fingerprint in
common, so no such run is missed; runs that stay shorter after extension are dropped.
An item of fewer words than ``SPAN`` is looked up whole, at every place of a document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.shared import cut, few, with_row_id
from rosterloom.llm.words import grams, slices, word_table

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: Words on either side of a fingerprint that decide whether a shared run reaches SPAN words.
REACH = SPAN - GRAM
#: Up to so many distinct fingerprints of the benchmark (8 bytes each) go to the
#: executors beforehand; beyond it the same join runs on all fingerprints by shuffle.
PREFILTER = 2_000_000
#: Up to so many rows of items (their fingerprints with the words around, some 150 bytes each) are
#: broadcast; beyond it they are joined by shuffle.
BROADCAST_ITEMS = 100_000

_PRINT = "n int, hash long, pos int, left array<long>, right array<long>"
_ARROW = [pa.field("n", pa.int32()), pa.field("hash", pa.int64()), pa.field("pos", pa.int32()), pa.field("left", pa.list_(pa.int64())), pa.field("right", pa.list_(pa.int64()))]


def winnow(codes: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indexes into ``codes`` of the smallest of each window inside one text, the rightmost of equals."""
    count = len(codes) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(owner[first[:count]] == owner[first[WINDOW - 1 :]])
    windows = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[whole]
    best, at = windows[:, WINDOW - 1].copy(), whole + WINDOW - 1
    for j in range(WINDOW - 2, -1, -1):
        less = windows[:, j] < best
        best[less], at[less] = windows[less, j], whole[less] + j
    return np.unique(at)


def _sides(words: np.ndarray, owner: np.ndarray, at: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before (nearest first) and after each k-gram; ``edge`` stands beyond a text's end."""
    def take(places):
        safe = np.clip(places, 0, len(words) - 1)
        same = (places == safe) & (owner[safe] == owner[at][:, None])
        return np.where(same, words[safe].view(np.int64), edge)

    steps = np.arange(REACH)
    return take(at[:, None] - 1 - steps), take(at[:, None] + GRAM + steps)


def _rows(n, codes, places, left, right) -> list[pa.Array]:
    def lists(block):
        if block is None:
            return pa.nulls(len(codes), pa.list_(pa.int64()))
        return pa.ListArray.from_arrays(np.arange(0, block.size + 1, REACH, dtype=np.int32), block.reshape(-1))

    return [pa.array(np.full(len(codes), n, np.int32)), pa.array(codes.view(np.int64)), pa.array(places.astype(np.int32)), lists(left), lists(right)]


def _item_prints(batches):
    """Fingerprints of benchmark items, or the whole of a short item."""
    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in slices(batch.column(1)):
            words, owner, place = word_table(data, offsets)
            counts = np.bincount(owner, minlength=len(offsets) - 1)
            codes, first = grams(words, owner, GRAM)
            at = winnow(codes, first, owner)
            begin = first[at]
            parts = [(owner[begin], _rows(SPAN, codes[at], place[begin], *_sides(words, owner, begin, -2)))]
            for n in np.unique(counts[(counts > 0) & (counts < SPAN)]):
                codes, first = grams(words, owner, int(n))
                short = counts[owner[first]] == n
                parts.append((owner[first[short]], _rows(int(n), codes[short], place[first[short]], None, None)))
            for of, columns in parts:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + of)), *columns], schema=pa.schema([pa.field("item_id", ids.type), *_ARROW]))


def _document_prints(known, lengths):
    """A row for each document, with n 0, and one for each fingerprint that may be in the benchmark."""
    def run(batches):
        filters = known.value if known is not None else None

        def kept(n, codes):
            if filters is None:
                return np.ones(len(codes), bool)
            have = filters.get(n, np.zeros(0, np.uint64))
            if not len(have):
                return np.zeros(len(codes), bool)
            return have[np.minimum(np.searchsorted(have, codes), len(have) - 1)] == codes

        for batch in batches:
            ids, docs = batch.column(0), batch.column(1)
            schema = pa.schema([pa.field("_row", pa.int64()), pa.field("doc_id", docs.type), pa.field("n_words", pa.int64()), *_ARROW])
            for row, data, offsets in slices(batch.column(2)):
                words, owner, place = word_table(data, offsets)
                counts = np.bincount(owner, minlength=len(offsets) - 1)
                zero = np.zeros(len(counts), np.uint64)
                parts = [(np.arange(len(counts)), pa.array(counts), _rows(0, zero, zero, None, None))]
                for n in lengths:
                    codes, first = grams(words, owner, GRAM if n == SPAN else n)
                    at = winnow(codes, first, owner) if n == SPAN else np.arange(len(codes))
                    at = at[kept(n, codes[at])]
                    begin = first[at]
                    sides = _sides(words, owner, begin, -1) if n == SPAN and len(begin) else (None, None)
                    parts.append((owner[begin], pa.nulls(len(at), pa.int64()), _rows(n, codes[at], place[begin], *sides)))
                for of, total, columns in parts:
                    if len(of):
                        take = pa.array(row + of)
                        yield pa.RecordBatch.from_arrays([ids.take(take), docs.take(take), total, *columns], schema=schema)

    return run


def _reach(mine: str, theirs: str) -> F.Column:
    """How many words in a row are equal, going away from the fingerprint."""
    same = [F.get(mine, F.lit(j)) == F.get(theirs, F.lit(j)) for j in range(REACH)]
    out = F.lit(REACH)
    for j in reversed(range(REACH)):
        out = F.when(~same[j], F.lit(j)).otherwise(out)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, prefilter: int = PREFILTER, broadcast: int = BROADCAST_ITEMS) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_words, n_hit, item_ids (sorted as strings), spans.

    ``spans`` are the hit runs of words as (start, end), end exclusive. Null and empty
    texts and items have no words and never match; very long texts are searched whole; repeated
    rows and rows with equal or null doc_id stay apart; equal items each count under their own
    item_id (a null item_id still marks words, but is not counted), ties of item_ids once; other
    columns are ignored, whatever their names. An empty benchmark hits nothing, and an empty
    table of documents gives no row.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    # Without places: an item that repeats itself would else meet a document that does so at every pair of places.
    prints = cut(benchmark.select("item_id", "text").mapInArrow(_item_prints, f"item_id {kind}, {_PRINT}").drop("pos").distinct())
    lengths = sorted(r.n for r in prints.select("n").distinct().collect())  # SPAN values at most
    codes = prints.select("n", "hash").distinct()
    known = None
    if codes.count() <= prefilter:
        found = codes.toPandas()
        known = documents.sparkSession.sparkContext.broadcast({int(n): np.sort(x.to_numpy(np.int64).view(np.uint64)) for n, x in found.groupby("n")["hash"]})
    doc_kind = documents.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(documents.select("doc_id", "text")).select("_row", "doc_id", "text").mapInArrow(_document_prints(known, lengths), f"_row long, doc_id {doc_kind}, n_words long, {_PRINT}")
    items = prints.select("item_id", "n", "hash", F.col("left").alias("_left"), F.col("right").alias("_right"), F.lit(True).alias("_found"))
    joined = rows.join(few(items, broadcast), ["n", "hash"], "left")
    before, after = _reach("left", "_left"), _reach("right", "_right")
    short = F.col("n") < SPAN
    joined = joined.filter((F.col("n") == 0) | F.col("_found")).select(
        "_row", "doc_id", "n_words", "item_id",
        F.when(F.col("_found"), F.struct(
            F.when(short, F.col("pos")).otherwise(F.col("pos") - before).alias("start"),
            F.when(short, F.col("pos") + F.col("n")).otherwise(F.col("pos") + GRAM + after).alias("end"),
            (short | (before + after + GRAM >= SPAN)).alias("long"),
        )).alias("span"),
    )
    good = F.col("span.long")
    out = joined.groupBy("_row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(good, F.struct("span.start", "span.end")))).alias("spans"),
        F.sort_array(F.collect_set(F.when(good, F.col("item_id").cast("string")))).alias("item_ids"),
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("total"), F.greatest(a["end"], s["end"]).alias("end")),
    )
    return out.select("doc_id", "n_words", merged["total"].alias("n_hit"), "item_ids", "spans")
