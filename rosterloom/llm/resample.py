"""Importance resampling towards the n-gram distribution of a target table.

Separators of a text are collapsed to single spaces, and an overlapped regular expression with
boundary lookarounds then finds every run of n words, overlapping ones too, as a span of bytes,
whose CRC names one of ``BUCKETS`` buckets. A text is kept as its counts by bucket, so it is
scanned once: the counts of all documents and of all target texts give each bucket's gain, and
a document weighs the mean gain of its features. A draw without replacement takes the highest
of weight plus Gumbel noise, which a digest of the document's id gives.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.shared import stored, with_row_id
from rosterloom.llm.words import LOWER, PLAIN, slices

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"

#: Bytes in lower case, with a space for each byte that is in no word.
_CLEAN = bytes(np.where(PLAIN, LOWER, 0x20).astype(np.uint8))
_SPACES = regex.compile(rb" +")


def spans_of(n: int):
    """Matches of every run of ``n`` words of a collapsed text, when searched overlapped."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def _features(text: bytes, patterns: list) -> tuple[np.ndarray, int]:
    """Bucket of every feature of a text, and its number of words."""
    collapsed = _SPACES.sub(b" ", text.translate(_CLEAN)).strip(b" ")
    found = [zlib.crc32(m[0]) % BUCKETS for p in patterns for m in p.finditer(collapsed, overlapped=True)]
    return np.array(found, np.int64), collapsed.count(b" ") + 1 if collapsed else 0


def _scan(longest: int):
    """n_words, and the distinct buckets of a text with their counts."""
    def run(batches):
        patterns = [spans_of(n) for n in range(1, longest + 1)]
        for batch in batches:
            for row, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                n, raw = len(offsets) - 1, data.tobytes()
                words, sizes, buckets, counts = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
                for i in range(n):
                    found, words[i] = _features(raw[offsets[i] : offsets[i + 1]], patterns)
                    own, many = np.unique(found, return_counts=True)
                    sizes[i] = len(own)
                    buckets.append(own)
                    counts.append(many)
                edges = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((buckets, np.int32), (counts, np.int64))]
                piece = batch.slice(row, n)
                kept = [(name, column) for name, column in zip(piece.schema.names, piece.columns) if name != "text"]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(words), *lists], names=[*(name for name, _ in kept), "n_words", "buckets", "counts"])

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The columns of ``texts`` but for text, with n_words, buckets and counts, written once."""
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema if f.name != "text")
    return stored(texts.mapInArrow(_scan(longest), f"{kept}n_words long, buckets array<int>, counts array<long>"))


def _totals(counted: DataFrame) -> np.ndarray:
    """Features of all rows by bucket: at most ``BUCKETS`` numbers, whatever the table's size."""
    rows = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("of")).groupBy("of.buckets").agg(F.sum("of.counts").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the documents."""
    all_s, all_t = float(documents.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray):
    """n_features and weight from the counts by bucket."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("buckets")
            buckets, counts = batch.column(at), batch.column(batch.schema.get_field_index("counts"))
            ends = np.cumsum(np.concatenate(([0], buckets.value_lengths().to_numpy(zero_copy_only=False))))
            many = counts.flatten().to_numpy(zero_copy_only=False)
            run_of = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])
            n, total = run_of(many), run_of(many * gain[buckets.flatten().to_numpy(zero_copy_only=False)])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n.astype(np.int64)), pa.array(weight.astype(np.int64))], names=[*batch.schema.names[:at], "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise that the id decides."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digest, 16, 10).cast("long") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(uniform)))


def ranked(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``rows`` with _place: 0, 1, 2... in the order of ``by`` over all of them.

    Rows are sorted by range, and a partition's places begin where those of the partitions before
    it end; the driver sees one count for each partition.
    """
    sorted_ = stored(rows.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_first"))
    joined = sorted_.withColumn("part", part).join(F.broadcast(first), "part")
    return joined.withColumn("_place", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "_at", "_first")


def resample(documents: DataFrame, target: DataFrame, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_features, weight, score and rank (null if not drawn).

    Null and empty texts and texts without words have no features, weight 0, and are never drawn;
    very long texts are scanned whole. Ties go to the smaller doc_id, null first, and then to the
    row read first; repeated rows have equal scores and are drawn each. A null doc_id draws as the
    empty text does. An empty table of documents gives no row; with an empty target all features
    count as not seen there. Other columns are ignored, whatever their names.
    """
    counted = bucket_counts(with_row_id(documents.select("doc_id", "text")), longest)
    gain = gains(_totals(counted), _totals(bucket_counts(target.select("text"), longest)))
    kind = documents.schema["doc_id"].dataType.simpleString()
    weighed = counted.select("doc_id", "_row", "n_words", "buckets", "counts").mapInArrow(_weigh(gain), f"doc_id {kind}, _row long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_open", F.col("n_words") >= least_words)
    drawn = counted.filter(F.col("n_words") >= least_words).count() * percent // 100
    out = ranked(scored, [F.desc("_open"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("_row")])
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
