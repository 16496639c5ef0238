"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text; a cut lies where the hash of the last 16
bytes falls under a mask and is the smallest such hash within ``APART`` bytes. Cuts so
depend on nearby bytes only: an insertion moves no cut farther on. A chunk is two
neighbouring pieces between cuts, and chunks overlap by one piece. Chunks are compared by
digest, and a run of repeated chunks of ``LEAST`` bytes or more is a repeated passage. The
first place of a chunk in the corpus stays, later ones can be removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.shared import aliased, cut, few, let, scan, stored, with_row_id
from rosterloom.llm.words import BYTE_HASH, slices

#: Bytes that the low WINDOW bits of a hash look back on; bits of the mask (a cut offered every 16
#: bytes on average); least distance of cuts; greatest size of a piece.
WINDOW, MASK_BITS, APART, GREATEST = 16, 4, 20, 8192
#: Bytes of overlapping repeated chunks that make a repeated passage: about 17 words, so that a
#: passage of 50 words shows even where its first and last pieces differ.
LEAST = 100

_GEAR = (BYTE_HASH >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + G[byte] (mod 2^32) after every byte, by doubling spans."""
    h = _GEAR[data]
    with np.errstate(over="ignore"):
        for shift in (1, 2, 4, 8, 16):
            if len(h) > shift:
                more = h.copy()
                more[shift:] += h[:-shift] << np.uint32(shift)
                h = more
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks end, for all texts of a slice: content cuts, text ends, and forced cuts in long chunks.

    A cut inside a character moves to its end, so that every chunk is UTF-8.
    """
    h = gear(data) & np.uint32((1 << WINDOW) - 1)
    at = np.flatnonzero((h >> np.uint32(WINDOW - MASK_BITS)) == 0)
    if len(at):  # the hash is whole only WINDOW bytes into a text
        owner = np.searchsorted(offsets, at, side="right") - 1
        whole = at - offsets[owner] >= WINDOW - 1
        at, owner = at[whole], owner[whole]
        value, beaten = h[at], np.zeros(len(at), bool)
        for step in range(1, APART):
            near = (at[step:] - at[:-step] < APART) & (owner[step:] == owner[:-step])
            if not near.any():
                break
            beaten[step:] |= near & (value[:-step] <= value[step:])
            beaten[:-step] |= near & (value[:-step] > value[step:])
        at = at[~beaten] + 1
    ends = np.union1d(at, offsets[1:][offsets[1:] > offsets[:-1]])
    starts = np.concatenate(([0], ends[:-1]))
    long = np.flatnonzero(ends - starts > GREATEST)
    forced = [np.arange(starts[i] + GREATEST, ends[i], GREATEST) for i in long]
    ends = np.union1d(ends, np.concatenate(forced)) if forced else ends
    for _ in range(3):
        inside = (data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80
        ends = np.where((ends < len(data)) & inside, ends + 1, ends)
    return np.unique(ends)


def _chunks(batches):
    """A row for each text (its size and number of chunks) and one for each chunk (place in bytes, digest)."""
    for batch in batches:
        ids, docs = batch.column(0), batch.column(1)
        schema = pa.schema([("_row", pa.int64()), ("doc_id", docs.type), ("n_chunks", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])
        for row, data, offsets in slices(batch.column(2)):
            ends = cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
            owner = np.searchsorted(offsets, starts, side="right") - 1
            if len(ends):  # two pieces each; a text of one piece is a chunk of it
                last = np.append(owner[1:] != owner[:-1], True)
                alone = last & np.append(True, owner[1:] != owner[:-1])
                at = np.flatnonzero(~last | alone)
                ends = np.where(alone[at], ends[at], ends[np.minimum(at + 1, len(ends) - 1)])
                starts, owner = starts[at], owner[at]
            n = len(offsets) - 1
            take, none = pa.array(row + np.arange(n)), pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(take), docs.take(take), pa.array(np.bincount(owner, minlength=n)), none, pa.array(np.diff(offsets).astype(np.int32)), pa.nulls(n, pa.binary())], schema=schema)
            if len(ends):
                whole = data.tobytes()
                digests = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                places = [pa.array((x - offsets[owner]).astype(np.int32)) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + owner)), pa.nulls(len(ends), docs.type), pa.nulls(len(ends), pa.int64()), *places, pa.array(digests, pa.binary())], schema=schema)


def repeated_passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_chunks, n_bytes, n_dup_chunks, n_removable, repeats, dup_bytes, most_places, passages, other_docs.

    ``passages`` are (start, end) in bytes of UTF-8 of the runs of repeated chunks, within a text
    or across texts, and ``dup_bytes`` how many they hold; ``n_removable`` counts their
    chunks that are not the first of their digest. ``repeats`` is true if a passage is shared with
    another row; ``other_docs`` are doc_ids that share one: where its chunks come first, or last
    if they come first here; ``most_places`` is at how many places of the corpus the commonest of
    its chunks stands. Null and empty texts have no chunks; very long texts are chunked whole;
    repeated rows and rows with equal or null doc_id stay apart (equal texts are repeats); of
    equal chunks that in the row read first comes first; an empty table gives no row; other
    columns are ignored, whatever their names.
    """
    return _passages(with_row_id(documents.select("doc_id", "text")), least).drop("_row", "removed")


def without_repeated_passages(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``documents`` without the repeated passages of their texts, but for the first place of each chunk; other columns as they are."""
    safe, restored = aliased(documents)
    numbered = stored(with_row_id(safe))
    found = cut(_passages(numbered.select("_row", "doc_id", "text"), least).filter(F.size("removed") > 0).select("_row", "removed"))
    joined = numbered.join(few(found), "_row", "left")
    data = F.col("text").cast("binary")

    def kept(removed):
        between = lambda at, s: F.when(s["start"] > at, F.substring(data, at + 1, s["start"] - at).cast("string")).otherwise("")
        pieces = scan(removed, F.lit(0), lambda at, s: F.greatest(at, s["end"]), between, "string")
        rest = let(F.array_max(F.transform(removed, lambda s: s["end"])), lambda end: F.substring(data, end + 1, F.octet_length("text")).cast("string"))
        return F.concat(F.array_join(pieces, ""), rest)

    return restored(joined.withColumn("text", F.when(F.size("removed") > 0, let(F.col("removed"), kept)).otherwise(F.col("text"))))


def _passages(documents: DataFrame, least: int) -> DataFrame:
    """The rows of ``repeated_passages`` with _row, and ``removed``: (start, end) of what can go, apart from pieces of chunks that stay."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    numbered = documents.select("_row", "doc_id", "text")
    rows = stored(numbered.mapInArrow(_chunks, f"_row long, doc_id {kind}, n_chunks long, start int, end int, digest binary"))
    chunks, texts = rows.filter("digest IS NOT NULL"), rows.filter("digest IS NULL")
    # Partial sums make one row of a digest in each task, however often it is there.
    place = F.struct("_row", "start")
    digests = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("places")).filter("first < last")
    digests = stored(digests.select("digest", "places", F.col("first._row").alias("first_row"), F.col("first.start").alias("first_start"), F.col("last._row").alias("last_row")))
    repeated = chunks.join(digests, "digest").select("_row", "start", "end", "places", "first_row", "first_start", "last_row")
    along = Window.partitionBy("_row").orderBy("start")
    runs = repeated.withColumn("run", F.sum((F.col("start") > F.coalesce(F.lag("end").over(along), F.lit(-1))).cast("int")).over(along))
    removable = (F.col("_row") != F.col("first_row")) | (F.col("start") != F.col("first_start"))
    other = F.when(F.col("first_row") != F.col("_row"), F.col("first_row")).when(F.col("last_row") != F.col("_row"), F.col("last_row"))
    # A chunk shares a piece with the chunk on either side, which stays if that one does.
    stays = F.when(~removable, F.struct("start", "end"))
    from_, to = F.greatest("start", F.coalesce(F.lag(stays).over(along)["end"], F.col("start"))), F.least("end", F.coalesce(F.lead(stays).over(along)["start"], F.col("end")))
    runs = runs.withColumn("gone", F.when(removable & (from_ < to), F.struct(from_.alias("start"), to.alias("end"))))
    runs = runs.groupBy("_row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("places").alias("places"), F.collect_list("gone").alias("gone"),
        F.count(F.when(removable, 1)).alias("removable"),
        (F.max(F.when(other.isNotNull(), F.col("end"))) - F.min(F.when(other.isNotNull(), F.col("start")))).alias("across"), F.collect_set(other).alias("others"),
    ).filter(F.col("end") - F.col("start") >= least)
    found = runs.groupBy("_row").agg(
        F.sum("n").alias("n_dup_chunks"), F.sum("removable").alias("n_removable"), F.sum(F.col("end") - F.col("start")).alias("dup_bytes"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("passages"), F.max("across").alias("across"),
        F.max("places").alias("most_places"), F.sort_array(F.flatten(F.collect_list("gone"))).alias("removed"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("across") >= least, F.col("others"))))).alias("others"),
    )
    found = cut(found)
    names = texts.select(F.col("_row").alias("other_row"), F.col("doc_id").alias("other_doc"))
    others = cut(found.select("_row", F.explode("others").alias("other_row")).join(names, "other_row").select("_row", "other_doc"))
    others = others.groupBy("_row").agg(F.array_sort(F.collect_set("other_doc")).alias("other_docs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = texts.select("_row", "doc_id", "n_chunks", F.col("end").cast("long").alias("n_bytes")).join(found.drop("others"), "_row", "left").join(others, "_row", "left")
    none, no_docs = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast(f"array<{kind}>")
    return out.select(
        "_row", "doc_id", "n_chunks", "n_bytes", zero("n_dup_chunks"), zero("n_removable"), F.coalesce(F.col("across") >= least, F.lit(False)).alias("repeats"), zero("dup_bytes"), zero("most_places"),
        F.coalesce("passages", none).alias("passages"), F.coalesce("other_docs", no_docs).alias("other_docs"), F.coalesce("removed", none).alias("removed"),
    )
