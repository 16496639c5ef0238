"""A corpus pipeline of five stages: language ID, near-dedup, decontamination, personal data, BPE.

Each stage works on all that the one before kept, and is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import bpe, decontam, langid, near_dup, pii
from rosterloom.llm.shared import aliased, free_name, stored, table, without_rows

#: A document whose most likely language has less than this of the posterior is in no known language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; a missing lang is filled in.

    Null and empty texts and those without a letter go. Very long texts are scored whole; ties
    go to the first language; repeated rows are decided each, alike; an empty table gives none;
    other columns are kept, whatever their names.
    """
    safe, restored = aliased(docs)
    said = langid.learn_and_identify(safe)
    said = said.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return restored(said.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays.

    Of repeated rows one stays, and of equal doc_ids the first row read. Null and empty texts and
    those without words are each a class of their own and stay; very long texts are compared
    whole; an empty table gives none; other columns are kept, whatever their names.
    """
    return near_dup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go.

    Null and empty texts share none and stay; very long texts are searched whole; repeated rows
    and equal doc_ids are decided each; an empty table gives none, and an empty benchmark drops
    none; other columns are kept, whatever their names.
    """
    benchmark = table(spark, sf_dir, "benchmark")

    def contaminated(numbered: DataFrame) -> DataFrame:
        found = decontam.contamination(numbered.select(F.col("_row").alias("doc_id"), "text"), benchmark)
        return found.filter("n_hit > 0").select(F.col("doc_id").alias("_row"))

    return without_rows(docs, contaminated)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; n_chars is counted anew.

    Null and empty texts stay as they are; very long texts are masked whole; repeated rows are
    masked each, alike; of spans with one start the first kind is named; an empty table gives
    none; other columns are kept, whatever their names.
    """
    safe, restored = aliased(docs)
    found = pii.find_spans(safe, safe.columns)
    masked = restored(found.withColumn("text", pii.masked(F.col("text"), "spans")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*(F.col(f"`{c}`") for c in docs.columns))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text as decoded from them; n_tokens and ids come after the columns of ``docs``.

    A null or empty text has no ids and becomes an empty text; very long texts are encoded whole;
    repeated rows are encoded each; there are no ties; an empty table gives none. Other columns
    are kept; one of them that is named n_tokens or ids keeps its name, and the new one gets an
    underscore more.
    """
    safe, _ = aliased(docs)
    coded = bpe.encode_decode(safe, public_tokenizers.path("byte_bpe_50k.json"))
    own = [(F.col("decoded") if c == "text" else F.col(c)).alias(name) for c, name in zip(safe.columns, docs.columns)]
    return coded.select(*own, (F.octet_length("ids") / 4).cast("long").alias(free_name("n_tokens", docs.columns)), F.col("ids").alias(free_name("ids", docs.columns)))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe_codec", bpe_codec),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
