"""License scans by diagonal voting.

All word k-grams of a document that stand in a template are joined with their places
there, by hash and by their words, so that a vote is a word-by-word match; each pair votes
for the diagonal (place in document minus place in template). Neighbouring diagonals, as left
by words put in or left out, are merged. A merged diagonal counts if its votes hold enough
k-grams and enough words of its template within a span of about its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.llm.license_texts import NOTICES, PHRASES, TEXTS
from rosterloom.llm.shared import with_row_id
from rosterloom.llm.words import LOWER, PLAIN, bounds, grams, slices, word_table

GRAM = 3
#: Diagonals at most so far apart belong together.
NEIGHBOUR = 3
#: Share of a template's k-grams, and of its words, that its merged diagonal must hold; short
#: templates, which often differ by a version number only, must be held whole.
COVER, SHORT = 0.8, 10

#: Grams of a template and its words, in its own order: the phrases first.
TEMPLATES = [(label, text, kind) for kind, texts in (("phrase", PHRASES), ("notice", NOTICES), ("text", TEXTS)) for label, text in texts]


def _spelled(lowered: bytes, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[str]:
    """The words of the k-grams that begin with the words ``at``, one blank between them."""
    return [b" ".join(lowered[starts[i + j] : ends[i + j]] for j in range(GRAM)).decode() for i in at.tolist()]


def template_grams() -> list[tuple[int, str, bool, int, int, int, str, int]]:
    """(template, label, is phrase, k-grams and words of the template, hash, gram, place): some thousand rows, whatever the input."""
    out = []
    for number, (label, text, kind) in enumerate(TEMPLATES):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        words, owner, _ = word_table(data, offsets)
        codes, first = grams(words, owner, GRAM)
        starts, ends, _ = bounds(LOWER[data], offsets, PLAIN)
        spelled = _spelled(LOWER[data].tobytes(), starts, ends, first)
        out += [(number, label, kind == "phrase", len(codes), len(words), int(h), g, int(p)) for h, g, p in zip(codes.view(np.int64), spelled, first)]
    return out


def _gram_rows(batches):
    """A row for each document, with a null hash, and one for each of its k-grams whose hash a template has, with its words."""
    known = np.unique(np.array([r[5] for r in template_grams()], np.int64))
    for batch in batches:
        ids, docs = batch.column(0), batch.column(1)
        schema = pa.schema([pa.field("_row", pa.int64()), pa.field("doc_id", docs.type), pa.field("n_words", pa.int64()), pa.field("hash", pa.int64()), pa.field("gram", pa.string()), pa.field("pos", pa.int32())])
        for row, data, offsets in slices(batch.column(2)):
            words, owner, place = word_table(data, offsets)
            counts = np.bincount(owner, minlength=len(offsets) - 1)
            take = pa.array(row + np.arange(len(counts)))
            none = len(take)
            yield pa.RecordBatch.from_arrays([ids.take(take), docs.take(take), pa.array(counts), pa.nulls(none, pa.int64()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int32())], schema=schema)
            codes, first = grams(words, owner, GRAM)
            codes = codes.view(np.int64)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes)
            if len(at):
                lowered = LOWER[data]
                starts, ends, _ = bounds(lowered, offsets, PLAIN)
                take = pa.array(row + owner[first[at]])
                columns = [ids.take(take), docs.take(take), pa.nulls(len(take), pa.int64()), pa.array(codes[at]), pa.array(_spelled(lowered.tobytes(), starts, ends, first[at]), pa.string()), pa.array(place[first[at]].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def scan_licenses(documents: DataFrame, cover: float = COVER) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words: counts 0, labels empty, score 0. Very long texts are
    scanned whole; repeated rows and rows with equal or null doc_id stay apart; a document that
    holds several templates has all their labels, so there are no ties; an empty table gives no
    row; other columns are ignored, whatever their names. ``score`` is the largest share of a
    template's words that the document holds (1 at a phrase, 0 below ``cover``).
    """
    spark: SparkSession = documents.sparkSession
    templates = F.broadcast(spark.createDataFrame(template_grams(), "template int, label string, phrase boolean, size int, length int, hash long, gram string, at int"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = with_row_id(documents.select("doc_id", "text")).select("_row", "doc_id", "text").mapInArrow(_gram_rows, f"_row long, doc_id {kind}, n_words long, hash long, gram string, pos int")
    votes = rows.join(templates, ["hash", "gram"], "left").withColumn("diagonal", F.col("pos") - F.col("at"))
    diagonals = votes.groupBy("_row", "template", "label", "phrase", "size", "length", "diagonal").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"),
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("at").alias("places"),
    )
    along = Window.partitionBy("_row", "template").orderBy("phrase", "diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOUR
    apart |= F.col("phrase") | (F.col("low") - F.lag("high").over(along) > F.col("size") + NEIGHBOUR)
    merged = (
        diagonals.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(along))
        .groupBy("_row", "template", "label", "phrase", "size", "length", "run")
        .agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.min("diagonal").alias("start"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"),
        )
        .withColumn("votes", F.size("places"))
        .withColumn("words", F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1))))))
    )
    share = F.col("words") / F.col("length")
    base = F.col("phrase") & (F.col("votes") == F.col("size"))
    enough = F.when(F.col("size") < SHORT, 1.0).otherwise(cover)
    own = ~F.col("phrase") & (F.col("votes") >= enough * F.col("size")) & (share >= enough) & (F.col("high") - F.col("low") < 2 * F.col("size") + NEIGHBOUR)
    out = merged.groupBy("_row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(base | own, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base | own, share)), F.lit(0.0)).alias("score"),
    )
    return out.drop("_row")
