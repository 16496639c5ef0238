"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import bpe, chunk_dedup, count_tree, decontam, dialogue, langid, license_scan, near_dup, pii, quality_model, quality_rules, resample, token_files
from rosterloom.llm.shared import held_out, table

TOKENIZER = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = langid.learn_and_identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    folder = token_files.token_folder(documents)
    return token_files.read_token_files(token_files.write_token_files(documents, public_tokenizers.path(TOKENIZER), folder), folder)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("distance")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.score(documents, quality_model.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))
    return repaired.withColumn("repaired_sha256", dialogue.repaired_digest(F.col("repaired"))).drop("repaired")


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tree.linked(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_personal_data": op4_personal_data,
    "op5_token_files": op5_token_files,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
    "op13_importance_resampling": op13_importance_resampling,
}

#: Words of a text, as the contracts have them; ``{0}`` is the text.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: A row for each word of a document: r (row), p (place), w.
_DOCUMENT_WORDS = f"""
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS MATERIALIZED (SELECT r, unnest(range(len(l))) AS p, unnest(l) AS w FROM (SELECT r, {_WORDS.format("text")} AS l FROM d))"""


def _run_of(n: int) -> str:
    """The word at hand and the n - 1 after it, as columns of a window."""
    return " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])


_SPACED = _WORDS.replace(r"\x00-\x2F\x3A-\x60\x7B-\x7F", r"\x20\x09-\x0D")
_SETS = """
sizes AS (SELECT r, count(*) AS n FROM t GROUP BY r),
runs AS ({0}),
sets AS MATERIALIZED (SELECT DISTINCT r, hash(g) AS g FROM runs),
counts AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM sets a JOIN sets b ON a.g = b.g AND a.r < b.r GROUP BY ALL)""".format(
    " UNION ALL ".join(f"SELECT r, g FROM (SELECT r, {_run_of(n)} AS g FROM t JOIN sizes USING (r) WHERE least(n, {count_tree.SHINGLE}) = {n} WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE g IS NOT NULL" for n in range(1, count_tree.SHINGLE + 1))
)

#: CRC-32 of ``{0}``, byte by byte; ``t`` is the table of its polynomial, made in ``k``.
_CRC_TABLE = "k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda j: 0::UBIGINT)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::UBIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INT + 1])), 4294967295::UBIGINT)"

ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": f"""
WITH {_DOCUMENT_WORDS},
b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS.format("text")} AS l FROM benchmark),
u AS (SELECT i, item_id, least(len(l), {decontam.SPAN}) AS n, unnest(range(len(l))) AS p, unnest(l) AS w FROM b),
items AS ({" UNION ALL ".join(f"SELECT item_id, n, g FROM (SELECT item_id, n, {_run_of(n)} AS g FROM u WHERE n = {n} WINDOW o AS (PARTITION BY i ORDER BY p)) WHERE g IS NOT NULL" for n in range(1, decontam.SPAN + 1))}),
wanted AS (SELECT DISTINCT item_id, n, g FROM items),
windows AS ({" UNION ALL ".join(f"SELECT r, p, {n} AS n, g FROM (SELECT r, p, {_run_of(n)} AS g FROM t WHERE {n} IN (SELECT n FROM wanted) WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE g IS NOT NULL" for n in range(1, decontam.SPAN + 1))}),
found AS (SELECT r, p, n, item_id FROM windows JOIN wanted USING (n, g)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words FROM t GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN sizes USING (r) LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)""",
    "op8_near_duplicates": f"""
WITH RECURSIVE {_DOCUMENT_WORDS},
sizes AS (SELECT r, count(*) AS n FROM t GROUP BY r),
runs AS ({" UNION ALL ".join(f"SELECT r, g FROM (SELECT r, {_run_of(n)} AS g FROM t JOIN sizes USING (r) WHERE least(n, {near_dup.SHINGLE}) = {n} WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE g IS NOT NULL" for n in range(1, near_dup.SHINGLE + 1))}),
sets AS MATERIALIZED (SELECT DISTINCT r, hash(g) AS g FROM runs),
counts AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM sets a JOIN sets b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN counts x ON x.r = a JOIN counts y ON y.r = b WHERE common >= {near_dup.SIMILAR} * (x.n + y.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT r, r AS label FROM d UNION SELECT b, label FROM reached JOIN edges ON a = r),
labels AS (SELECT r, min(label) AS label FROM reached GROUP BY r)
SELECT d.doc_id, c.doc_id AS class_id, d.r = label AS kept FROM d JOIN labels USING (r) JOIN d c ON c.r = label""",
    "op12_ngram_jaccard_join": f"""
WITH RECURSIVE {_DOCUMENT_WORDS.replace(_WORDS.format("text"), _SPACED.format("text"))}, {_SETS},
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN counts x ON x.r = a JOIN counts y ON y.r = b WHERE 100 * common >= {count_tree.PERCENT} * (x.n + y.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT r, doc_id FROM d UNION SELECT b, doc_id FROM reached JOIN edges ON a = r),
labels AS (SELECT r, min(doc_id) AS component_id FROM reached GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN labels USING (r) LEFT JOIN counts USING (r)""",
    "op13_importance_resampling": f"""
WITH {_DOCUMENT_WORDS}, {_CRC_TABLE},
b AS (SELECT unnest({_WORDS.format("text")}) AS w FROM benchmark),
seen AS (SELECT w, count(*) AS n FROM t GROUP BY w), wanted AS (SELECT w, count(*) AS n FROM b GROUP BY w),
named AS MATERIALIZED (SELECT w, {_CRC.format("w")} % {resample.BUCKETS} AS bucket FROM (SELECT w FROM seen UNION SELECT w FROM wanted), k),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM seen JOIN named USING (w) GROUP BY bucket), t1 AS (SELECT bucket, sum(n)::BIGINT AS t FROM wanted JOIN named USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t1)::DOUBLE AS all_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {resample.BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {resample.BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t1 USING (bucket), sums),
of_doc AS (SELECT r, count(*) AS n, sum(gain) AS total FROM t JOIN named USING (w) JOIN gains USING (bucket) GROUP BY r),
weighed AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total / n::DOUBLE), 0)::BIGINT AS weight, ('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN of_doc USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {resample.PERCENT} // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (r)""",
}
