"""Registered queries of the roster engine, with the SQL that gives the same rows.

The star tables stand in for rosters: customers and orders for records and their rows,
parts for free text, lineitems for repeated entities, events for ordered segments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.errors import message
from rosterloom.functions import dates, text, validate
from rosterloom.operators import classify, documents, keys, lookup, markup, reshape, templates, update
from rosterloom.plans import pipeline, program, trees
from rosterloom.schema import ColumnRef
from rosterloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "1999-01-01"
#: A small reference grid, as (number, name, code).
GRID = [(0, "small ring", "SR"), (1, "red wigdet", "RW"), (2, "blue bolt", "BB"), (3, "gear", "GE"), (4, "old anvil", "OA"), (5, "hot plate", "HP"), (6, "new  bolt", "NB"), (7, "large gizmos", "LG")]
GRID_SQL = "grid(grid_no, grid_name, code) AS (VALUES " + ", ".join(f"({n}, '{a}', '{c}')" for n, a, c in GRID) + ")"


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Rows that take long each, dealt out to all cores: a short file of many rows is one task otherwise."""
    return frame.repartition(4 * frame.sparkSession.sparkContext.defaultParallelism)


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRID, "grid_no int, grid_name string, code string")


def us(column: str):
    return F.date_format(column, dates.OUTPUT)


# Records and single values


@query("SELECT o_custkey, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY 1, 2")
def q_record_keys(spark, sf_dir):
    return keys.record_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("""
SELECT o_custkey,
  arg_min(o_orderstatus, o_orderkey) AS o_orderstatus,
  CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'Clarify: Multiple values found, Picking up the first value|Input: ' || arg_min(o_orderstatus, o_orderkey) ELSE '' END AS o_orderstatus_message,
  arg_min(o_orderpriority, o_orderkey) AS o_orderpriority,
  CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'Clarify: Multiple values found, Picking up the first value|Input: ' || arg_min(o_orderpriority, o_orderkey) ELSE '' END AS o_orderpriority_message
FROM orders GROUP BY o_custkey""")
def q_single_value_conflict(spark, sf_dir):
    return keys.single_values(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderkey"])


@query("""
SELECT c_custkey,
  CASE WHEN c_acctbal >= 5000 THEN c_custkey::VARCHAR WHEN s_suppkey IS NOT NULL THEN s_suppkey::VARCHAR ELSE '' END AS "FINAL_NPI",
  CASE WHEN c_acctbal >= 5000 THEN 'I' WHEN s_suppkey IS NOT NULL THEN 'G' ELSE 'rejected' END AS "NPI_TYPE_IND"
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def q_final_id(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(supplier, F.col("c_custkey") == F.col("s_suppkey"), "left")
    joined = joined.withColumn("own", F.when(F.col("c_acctbal") >= 5000, F.col("c_custkey").cast("string")).otherwise(" "))
    return keys.final_id(joined, "own", "s_suppkey").select("c_custkey", "FINAL_NPI", "NPI_TYPE_IND")


# Scalar rules


@query("""
SELECT p_partkey,
  CASE WHEN length(p_name) > 9 THEN 'Clarify: Invalid length|Input: ' || p_name ELSE p_name END AS name_max,
  CASE WHEN length(p_type) <> 5 THEN 'Reject: Must be 5|Input: ' || p_type ELSE p_type END AS type_exact
FROM part""")
def q_validate_length(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", validate.length(F.col("p_name"), 9).alias("name_max"), validate.length(F.col("p_type"), 5, exact=True, kind="R", text="Must be 5").alias("type_exact"))


@query("""
WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS v, date_diff('day', DATE '1999-01-01', o_orderdate::DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN d <= -365 THEN 'Clarify: Effective date too far in the past|Input: ' || v
  WHEN d > 90 THEN 'Clarify: Effective date too far in the future|Input: ' || v ELSE v END AS effective FROM x""")
def q_effective_window(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.effective_window(us("o_orderdate"), F.lit(AS_OF).cast("date")).alias("effective"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%m/%d/%Y') AS v, date_diff('day', l_shipdate::DATE, DATE '1999-01-01') AS late FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN late > 730 THEN 'Reject: two years late|Input: ' || v WHEN late > 365 THEN 'Clarify: a year late|Input: ' || v
  WHEN -late > 90 THEN 'Reject: too early|Input: ' || v ELSE v END AS effective FROM x""")
def q_effective_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", us("l_shipdate").alias("shipped"))
    tree = trees.compile_tree(trees.TREES["effectiveDate"], rows, [{"col": "shipped"}, "01/01/1999", "two years late", "a year late", "too early"])
    return rows.withColumn("effective", tree).drop("shipped")


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '1' ELSE '0' END AS board5,
  CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'Reject: no segment|Input: ' END ELSE '' END AS license,
  CASE WHEN c_nationkey IN (0, 7) THEN lower(trim(c_name)) ELSE 'Reject: other name|Input: ' || c_name END AS last_name,
  CASE WHEN c_nationkey > 12 THEN 'Y' ELSE 'N' END AS later, 'x' AS found
FROM customer""")
def q_trees(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "h").otherwise("").alias("house"),
        F.when(F.col("c_acctbal") >= 0, "ok").otherwise("").alias("solvent"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey").isin(0, 7), F.upper("c_name")).otherwise("").alias("expected"),
    )
    tree = lambda name, *a: trees.compile_tree(trees.TREES[name], rows, list(a))
    return rows.select(
        "c_custkey", tree("var_board5", {"col": "house"}).alias("board5"),
        tree("licenseExpiryDate", {"col": "solvent"}, {"col": "segment"}, "no segment").alias("license"),
        tree("lastName", {"col": "c_name"}, "other name", {"col": "expected"}).alias("last_name"),
        trees.compile_tree(["if", ["greater", {"col": "c_nationkey"}, 12], "Y", "N"], rows).alias("later"),
        trees.compile_tree(["if", ["found", "c_na"], "x", "y"], rows).alias("found"),
    )


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MID' WHEN '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS priority FROM orders""")
def q_std_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.standard_value(F.col("o_orderpriority"), {"HIGH": ["1-urgent", "2-high"], "MID": ["3-medium"], "LOW": ["5-low"]}).alias("priority"))


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS spaced,
  regexp_replace(p_brand, '[^A-Za-z0-9 #]', '', 'g') AS kept, regexp_replace(regexp_replace(p_brand || ' / ' || p_name, '[^A-Za-z0-9 ]', '', 'g'), ' +', '', 'g') AS squeezed FROM part""")
def q_remove_punct(spark, sf_dir):
    brand = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.remove_punctuation(brand).alias("spaced"), text.remove_punctuation(brand, 1, "#").alias("kept"), text.remove_punctuation(F.concat_ws(" / ", brand, "p_name"), 2).alias("squeezed"))


@query(r"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_type || ' ' || p_name, '(?i)\bstandard\b', 'STD', 'g'), '(?i)\beconomy\b', 'ECON', 'g'), '(?i)\bsmall\b', 'SM', 'g') AS short FROM part""")
def q_abbrev_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.replace_words(F.concat_ws(" ", "p_type", "p_name"), {"small": "SM", "economy": "ECON", "standard": "STD"}).alias("short"))


@query(r"""
SELECT p_partkey, CASE WHEN length(v) <= 12 THEN v WHEN length(s1) <= 12 THEN s1 WHEN length(s2) <= 12 THEN s2 WHEN length(s3) <= 12 THEN s3 ELSE 'Clarify: Too long|Input: ' || v END AS fitted FROM (
  SELECT *, regexp_replace(s2, '(?i)\B[aeiou]\B', '', 'g') AS s3 FROM (
  SELECT *, trim(regexp_replace(regexp_replace(s1, '(?i)\b(a|an|and|at|by|for|in|of|on|or|the|to|with)\b', '', 'g'), '\s+', ' ', 'g')) AS s2 FROM (
    SELECT p_partkey, p_name || ' of ' || p_brand AS v, regexp_replace(p_name || ' of ' || p_brand, '(?i)\bBrand\b', 'Br', 'g') AS s1 FROM part)))""")
def q_abbreviate(spark, sf_dir):
    value = F.concat_ws(" of ", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.abbreviate(value, 12, {"Brand": "Br"}).alias("fitted"))


_PHONE = "'+1 (' || (200 + c_nationkey) || ') 555-' || lpad((c_custkey % 10000)::VARCHAR, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 4 END, '0')"


@query(f"""
WITH x AS (SELECT c_custkey, {_PHONE} AS v FROM customer), y AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM x)
SELECT c_custkey, CASE WHEN length(d) = 11 AND d[1] = '1' THEN d[2:] WHEN length(d) = 10 THEN d ELSE 'Clarify: Invalid phone number|Input: ' || v END AS phone FROM y""")
def q_phone_clean(spark, sf_dir):
    last = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    short = F.substring((F.col("c_custkey") % 10000).cast("string"), 1, 3)
    last = F.when(F.col("c_custkey") % 7 == 0, F.lpad(short, 3, "0")).otherwise(last)
    value = F.concat(F.lit("+1 ("), (F.col("c_nationkey") + 200).cast("string"), F.lit(") 555-"), last)
    return table(spark, sf_dir, "customer").select("c_custkey", text.phone(value).alias("phone"))


@query("""
WITH x AS (SELECT c_custkey, (c_custkey * 7919)::VARCHAR AS v FROM customer), y AS (SELECT *, CASE WHEN length(v) IN (4, 8) THEN '0' || v ELSE v END AS f FROM x)
SELECT c_custkey, CASE WHEN length(f) IN (5, 9) THEN f[1:5] ELSE 'Clarify: Invalid zip code|Input: ' || v END AS zip, CASE WHEN length(v) = 9 THEN v[6:9] WHEN length(v) = 8 THEN v[5:8] ELSE '' END AS plus4 FROM y""")
def q_zip5(spark, sf_dir):
    value = (F.col("c_custkey") * 7919).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", text.zip5(value).alias("zip"), text.zip4(value).alias("plus4"))


@query(r"""
WITH a AS (SELECT doc_id, CASE WHEN regexp_extract(text, '[A-Z][a-z]+ [a-z]+ [a-z]+', 0) <> '' THEN regexp_extract(text, '[A-Z][a-z]+ [a-z]+ [a-z]+', 0) ELSE text END AS v FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_extract(v, '[a-z]+ [a-z]+$', 0) <> '' THEN regexp_extract(v, '[a-z]+ [a-z]+$', 0) ELSE v END) AS found FROM a""")
def q_apply_regex(spark, sf_dir):
    found = text.apply_regexes(F.col("text"), ["[A-Z][a-z]+ [a-z]+ [a-z]+", "[a-z]+ [a-z]+$"])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(found.cast("binary")).alias("found"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') THEN 'E' WHEN regexp_matches(text, '(?i)(https?://|www\.)') THEN 'W' ELSE '' END AS kind FROM documents
UNION ALL SELECT -page_id - 1, CASE WHEN regexp_matches(url, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') THEN 'E' WHEN regexp_matches(url, '(?i)(https?://|www\.)') THEN 'W' ELSE '' END FROM pages""")
def q_email_url(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", text.electronic_type(F.col("text")).alias("kind"))
    return texts.unionAll(table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id"), text.electronic_type(F.col("url")).alias("kind")))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS short, strftime(o_orderdate, '%m/%d/%Y') AS serial, strftime(o_orderdate, '%m/%d/%Y') AS worded,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Reject: Invalid date|Input: ' || o_orderpriority ELSE '' END AS bad FROM orders""")
def q_parse_date(spark, sf_dir):
    day = F.col("o_orderdate")
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise("  ")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.parse_date(F.date_format(day, "yyyy-MM-dd")).alias("iso"), dates.parse_date(F.date_format(day, "M/d/yy")).alias("short"),
        dates.parse_date(F.datediff(day, F.lit(dates.SERIAL_START).cast("date")).cast("string")).alias("serial"),
        dates.parse_date(F.date_format(day, "MMM d, yyyy")).alias("worded"), dates.parse_date(bad).alias("bad"),
    )


@query("""
SELECT o_orderkey, date_diff('day', DATE '1999-01-01', o_orderdate::DATE) AS days, abs(date_diff('day', DATE '1999-01-01', o_orderdate::DATE)) AS days_apart,
  strftime(CASE WHEN o_orderdate > DATE '1999-01-01' THEN o_orderdate - INTERVAL 1200 MONTH ELSE o_orderdate END, '%m/%d/%Y') AS born FROM orders""")
def q_day_diff(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.days_between(us("o_orderdate"), F.lit("01/01/1999")).cast("long").alias("days"),
        dates.days_between(us("o_orderdate"), F.lit("01/01/1999"), absolute=True).cast("long").alias("days_apart"),
        dates.birth_date(us("o_orderdate"), F.lit(AS_OF).cast("date")).alias("born"),
    )


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR ELSE '' END AS min_age,
  CASE p_size % 3 WHEN 0 THEN (p_size + 5)::VARCHAR WHEN 2 THEN p_size::VARCHAR ELSE '' END AS max_age FROM part""")
def q_age_limits(spark, sf_dir):
    n = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 3 == 0, F.concat(n, F.lit(" - "), (F.col("p_size") + 5).cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(n, F.lit(" and up"))).otherwise(F.concat(F.lit("under "), n))
    return table(spark, sf_dir, "part").select("p_partkey", text.age_limits(value).alias("a")).select("p_partkey", "a.min_age", "a.max_age")


@query("""
SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last, p_type AS middle, split_part(p_name, ' ', 1) AS comma_last,
  upper(p_name[1]) || upper(split_part(p_name, ' ', 2)[1]) AS letters, regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants FROM part""")
def q_names(spark, sf_dir):
    word = F.split("p_name", " ")
    full = text.name_parts(F.concat_ws("  ", word[0], "p_type", word[1]))
    comma = text.name_parts(F.concat(word[0], F.lit(", "), word[1]))
    return table(spark, sf_dir, "part").select("p_partkey", full["first"].alias("first"), full["last"].alias("last"), full["middle"].alias("middle"), comma["last"].alias("comma_last"), text.acronym(F.col("p_name")).alias("letters"), text.without_vowels(F.col("p_name")).alias("consonants"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Clarify: Only zeros|Input: 000' ELSE c_custkey::VARCHAR END AS zeros,
  CASE WHEN length(c_custkey::VARCHAR) < 3 THEN 'Clarify: Too few digits|Input: ' || c_custkey ELSE c_custkey::VARCHAR END AS enough,
  CASE WHEN c_acctbal < 0 THEN 'Reject: needed|Input: ' ELSE c_name END AS needed, CASE WHEN c_acctbal < 0 AND c_nationkey = 3 THEN 'Clarify: Field missing|Input: ' WHEN c_acctbal < 0 THEN '' ELSE c_name END AS together,
  'Clarify: Not alphanumeric|Input: ' || c_name AS plain FROM customer""")
def q_validate_more(spark, sf_dir):
    key, name = F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))
    driver = F.when(F.col("c_nationkey") == 3, "x").otherwise("")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", validate.not_zeros(F.when(F.col("c_custkey") % 9 == 0, "000").otherwise(key)).alias("zeros"), validate.fewer_digits(key, 3).alias("enough"),
        validate.mandatory(name, "R", "needed").alias("needed"), validate.correlated(name, [driver]).alias("together"), validate.alphanumeric(F.col("c_name")).alias("plain"),
    )


@query("""
SELECT c_custkey, CASE WHEN levenshtein(lower(c_name), 'customer#000000012') <= 2 THEN c_name ELSE 'Reject: Name mismatch|Input: ' || c_name END AS checked,
  round(100.0 * (18 - levenshtein(c_name, 'Customer#000000012')) / 18, 4) AS percent FROM customer""")
def q_edit_check(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", validate.edit_check(F.col("c_name"), F.lit("CUSTOMER#000000012")).alias("checked"), text.match_percent(F.col("c_name"), F.lit("Customer#000000012")).alias("percent"))


# Reshaping


@query("""
SELECT p_partkey, 'PRIMARY' AS tag, 0 AS set_no, p_name AS "NAME", p_type AS "TYPE" FROM part
UNION ALL SELECT p_partkey, 'SECONDARY', 1, p_brand, NULL FROM part""")
def q_unpivot_general(spark, sf_dir):
    refs = {"p_name": ColumnRef("PRIMARY", "NAME", 0), "p_type": ColumnRef("PRIMARY", "TYPE", 0), "p_brand": ColumnRef("SECONDARY", "NAME", 1)}
    return reshape.unpivot(table(spark, sf_dir, "part").select("p_partkey", *refs), ["p_partkey"], refs)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'PLSV' AS tag, 0 AS set_no, l_returnflag AS "CODE", l_partkey::VARCHAR || ',' || l_suppkey::VARCHAR AS phones FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'BILL', 1, l_linestatus, '' FROM lineitem""")
def q_unpivot_address(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("PLSV@CODE@0"), F.col("l_partkey").alias("PLSV@PHONE#0@0"), F.col("l_suppkey").alias("PLSV@PHONE#1@0"), F.col("l_linestatus").alias("BILL@CODE@1"))
    long = reshape.unpivot(wide, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return long.withColumn("phones", F.array_join(F.transform("PHONE", lambda g: g["value"]), ",")).drop("PHONE")


@query("""
SELECT p_partkey, unnest(generate_series(0, len(w) - 1))::INT AS part_no, unnest(w) AS part FROM (SELECT p_partkey, list_filter(string_split(replace(p_name, ' ', ','), ','), lambda x: x <> '') AS w FROM part)""")
def q_split_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", ","), F.lit(" ;, ")).alias("names"))
    return reshape.split_rows(rows, "names").drop("names")


@query("""
WITH a AS (SELECT o_custkey, o_orderkey AS open_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS s FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT o_custkey, o_orderkey AS done_key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS s FROM orders WHERE o_orderstatus = 'F'),
k AS (SELECT DISTINCT o_custkey, a.s AS sa, b.s AS sb FROM a FULL JOIN b USING (o_custkey)),
r AS (SELECT o_custkey, sa, sb, unnest(generate_series(1, greatest(coalesce(sa, 0), coalesce(sb, 0)))) AS i FROM k)
SELECT r.o_custkey, r.i::INT AS row_no, a.open_key, b.done_key FROM r LEFT JOIN a ON a.o_custkey = r.o_custkey AND a.n = least(r.i, r.sa) LEFT JOIN b ON b.o_custkey = r.o_custkey AND b.n = least(r.i, r.sb)""")
def q_zip_ffill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    left = orders.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("open_key"))
    right = orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("done_key"))
    return reshape.zip_frames(left, right, ["o_custkey"], ("open_key", "done_key"))


@query("""
WITH x AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS ks, list_sort(list(DISTINCT o_orderstatus)) AS ss FROM orders GROUP BY 1), r AS (SELECT *, unnest(generate_series(1, greatest(len(ks), len(ss)))) AS i FROM x)
SELECT o_custkey, i::INT AS row_no, ks[least(i, len(ks))] AS ks_item, ss[least(i, len(ss))] AS ss_item FROM r""")
def q_concat_subframes(spark, sf_dir):
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"), F.sort_array(F.collect_set("o_orderstatus")).alias("ss"))
    return reshape.zip_fill(nested, ["ks", "ss"]).drop("ks", "ss")


@query("""
SELECT n_nationkey AS c_nationkey, coalesce(c_custkey, -1) AS c_custkey, coalesce(c_name, '') AS c_name
FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON c_nationkey = n_nationkey""")
def q_default_row(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select("c_nationkey", "c_custkey", "c_name")
    return reshape.default_row(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")), rich, ["c_nationkey"], {"c_custkey": -1, "c_name": ""})


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS "ROW_NUM", count(*) OVER (PARTITION BY o_custkey) AS "ROW_COUNT" FROM orders""")
def q_row_numbers(spark, sf_dir):
    return reshape.numbered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", F.col("ROW_NUM").cast("long").alias("ROW_NUM"), "ROW_COUNT")


@query("""
WITH x AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END, p_type], lambda v: v <> '') AS f FROM part)
SELECT p_partkey, coalesce(f[1], '') AS slot1, coalesce(f[2], '') AS slot2, coalesce(f[3], '') AS slot3 FROM x""")
def q_compact_slots(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("slot1"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(" ").alias("slot2"), F.col("p_type").alias("slot3"))
    return reshape.compact_slots(wide, ["slot1", "slot2", "slot3"])


@query("""SELECT o_custkey, string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1""")
def q_collect_rows(spark, sf_dir):
    nested = reshape.collect_rows(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], "rows")
    return nested.select("o_custkey", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["o_orderstatus"])), ";").alias("orders"))


# Updates within records


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0.08 AND l_returnflag = 'R' THEN 'Reject: discount on return|Input: R' WHEN l_quantity < 5 THEN l_linestatus ELSE l_returnflag END AS l_returnflag FROM lineitem""")
def q_cond_update(spark, sf_dir):
    cases = [("l_discount > 0.08D AND l_returnflag = 'R'", message("R", "discount on return", F.col("l_returnflag"))), (F.col("l_quantity") < 5, F.col("l_linestatus"))]
    return update.conditional_update(table(spark, sf_dir, "lineitem"), "l_returnflag", cases).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query("""
SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_values, 'Clarify: More than one value|Input: ' || min(l_suppkey) AS message FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def q_dup_clarify(spark, sf_dir):
    return update.clarify_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("""
SELECT lang, source, doc_id, quality FROM (SELECT d.lang, d.source, d.doc_id, l.quality, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY l.quality DESC NULLS LAST, l.toxic ASC NULLS LAST, d.doc_id) AS r
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE r = 1""")
def q_priority_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "source", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return update.best_of_group(rows, ["lang", "source"], [F.desc_nulls_last("quality"), F.asc_nulls_last("toxic"), F.asc("doc_id")]).select("lang", "source", "doc_id", "quality")


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS places FROM events GROUP BY 1")
def q_locate_tabs(spark, sf_dir):
    return update.located_in(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'P' ELSE 'S' END AS indicator FROM events")
def q_first_of_group(spark, sf_dir):
    return update.first_of_group(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "indicator").select("event_id", "indicator")


@query("""
WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN props ELSE '' END AS p FROM events)
SELECT event_id, CASE WHEN p <> '' THEN p ELSE coalesce(first_value(nullif(p, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') END AS p FROM x""")
def q_group_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("props")).otherwise(" ").alias("p"))
    return update.fill_group(rows, "p", ["user_id"], ["ts", "event_id"]).select("event_id", "p")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM events""")
def q_forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("props")).otherwise("").alias("p"))
    return update.forward_fill(rows, "p", ["user_id"], ["ts", "event_id"]).select("event_id", "p")


@query("SELECT o_custkey, strftime(min(o_orderdate), '%m/%d/%Y') AS first_date FROM orders GROUP BY 1")
def q_min_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), dates.OUTPUT).alias("first_date"))


@query("""
SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_flagged, CASE count(*) FILTER (WHERE o_orderpriority = '1-URGENT') WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS state FROM orders GROUP BY 1""")
def q_exactly_one_of(spark, sf_dir):
    return update.exactly_one_of(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) > 1 THEN 'Y' ELSE 'N' END AS "DELETE_FLAG" FROM lineitem""")
def q_self_dup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return update.duplicates_within(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_returnflag")


# Joins between tables


@query("""
SELECT o_custkey, o_orderkey, c_name, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'Y' ELSE 'N' END AS "FIRST_ROW"
FROM (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_acctbal > 0) b RIGHT JOIN (SELECT o_custkey, o_orderkey FROM orders) o USING (o_custkey)""")
def q_prepend_base(spark, sf_dir):
    base = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return templates.prepend_base(base, table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), f AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, o.n AS open_rows, o.p AS open_o_orderpriority, f.n AS done_rows, f.p AS done_o_orderpriority FROM o JOIN f USING (o_custkey)""")
def q_cross_template(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return templates.across({"open": orders.filter("o_orderstatus = 'O'"), "done": orders.filter("o_orderstatus = 'F'")}, ["o_custkey"], "o_orderpriority")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'Y' ELSE 'N' END AS "COMMON" FROM orders WHERE o_orderstatus = 'O'""")
def q_common_flag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    of = lambda s: orders.filter(F.col("o_orderstatus") == s)
    return templates.common_flag(of("O"), [of("F"), of("P")], ["o_custkey"]).select("o_orderkey", "COMMON")


@query("""
WITH s AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier),
c AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)
SELECT coalesce(s.nation, c.nation) AS nation, coalesce(s.n, c.n)::INT AS "ROW_NUM", s_suppkey, c_custkey, CASE WHEN s.n IS NULL THEN 'right_only' WHEN c.n IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM s FULL JOIN c ON s.nation = c.nation AND s.n = c.n""")
def q_outer_board(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    right = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return templates.outer_by_rank(left, right, ["nation"], (["s_suppkey"], ["c_custkey"]))


@query("""
SELECT coalesce(p.k, l.k) AS partkey, p_name, n_lines, CASE WHEN p.k IS NULL THEN 'right_only' WHEN l.k IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM (SELECT p_partkey AS k, p_name FROM part) p FULL JOIN (SELECT l_partkey + 100 AS k, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON p.k = l.k""")
def q_outer_indicator(spark, sf_dir):
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_name")
    right = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 100).alias("partkey")).agg(F.count("*").alias("n_lines"))
    return templates.outer(left, right, ["partkey"])


_WILD = [("1", "BUILDING"), ("3", "*"), ("*", "MACHINERY"), ("7", "no segment")]


@query(f"""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM (VALUES {", ".join(map(str, _WILD))}) g(n, s) WHERE (n = '*' OR n = c_nationkey::VARCHAR) AND (s = '*' OR s = c_mktsegment))""")
def q_semi_wild(spark, sf_dir):
    wanted = spark.createDataFrame(_WILD, "c_nationkey string, c_mktsegment string")
    return templates.semi_wild(table(spark, sf_dir, "customer"), wanted, ["c_nationkey", "c_mktsegment"]).select("c_custkey")


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND bool_or(event_type = 'purchase') OVER (PARTITION BY user_id) THEN 'purchase' ELSE event_type END AS grouped_action FROM events""")
def q_regroup_actions(spark, sf_dir):
    return templates.regroup_actions(table(spark, sf_dir, "events"), ["user_id"], "event_type", {"purchase": ["click", "view"]}).select("event_id", "grouped_action")


@query("""
WITH i AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R' GROUP BY 1)
SELECT i.l_orderkey, i.n AS input_rows, coalesce(r.n, 0) AS returned_rows, coalesce(o.n, 0) AS open_rows,
  CASE WHEN coalesce(r.n, 0) + coalesce(o.n, 0) = i.n THEN 'complete' WHEN coalesce(r.n, 0) + coalesce(o.n, 0) = 0 THEN 'missing' ELSE 'partial' END AS state
FROM i LEFT JOIN r USING (l_orderkey) LEFT JOIN o USING (l_orderkey)""")
def q_reconcile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return templates.reconcile(lines, {"returned": lines.filter("l_returnflag = 'R'"), "open": lines.filter("l_linestatus = 'O' AND l_returnflag <> 'R'")}, ["l_orderkey"])


@query("""
SELECT p_partkey::VARCHAR AS "Part", lpad(p_size::VARCHAR, 4, '0') AS "Size", '' AS "Note", p_name AS "Name" FROM part""")
def q_project_output(spark, sf_dir):
    schema = [{"outputColName": "Part", "dfColName": "p_partkey", "dataType": "text"}, {"outputColName": "Size", "dfColName": "p_size", "dataType": "numeric", "format": "0000"}, {"outputColName": "Note", "dfColName": "absent"}, {"outputColName": "Name", "dfColName": "p_name"}]
    return templates.project(table(spark, sf_dir, "part"), schema)


# Lookups


@query(f"""
WITH {GRID_SQL}, g AS (SELECT *, trim(regexp_replace(lower(grid_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM grid)
SELECT p_partkey, grid_no, code FROM part LEFT JOIN g ON trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) = k""")
def q_lookup_exact(spark, sf_dir):
    return lookup.lookup_exact(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", grid(spark), "grid_name").select("p_partkey", "grid_no", "code")


_FUZZY_SQL = """
q AS (SELECT DISTINCT p_name, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS q FROM part),
g AS (SELECT *, list_filter(string_split_regex(lower(grid_name), '[^a-z0-9]+'), lambda x: x <> '') AS g FROM grid),
h AS (SELECT p_name, grid_no, code, q, g, len(list_filter(q, lambda a: len(list_filter(g, lambda b: levenshtein(a, b) <= {edits})) > 0)) AS hit FROM q, g),
s AS (SELECT *, hit + CASE WHEN len(q) = len(g) THEN len(q) + 1 ELSE 0 END AS score, levenshtein(array_to_string(q, ' '), array_to_string(g, ' ')) AS e FROM h WHERE hit > 0 {more}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, e, grid_no) AS r FROM s) WHERE r = 1)"""


@query(f"WITH {GRID_SQL}, {_FUZZY_SQL.format(edits=1, more='')} SELECT p_partkey, grid_no, code, score::DOUBLE AS score FROM part LEFT JOIN b USING (p_name)")
def q_lookup_fuzzy1(spark, sf_dir):
    return lookup.lookup_fuzzy(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", grid(spark), "grid_name").select("p_partkey", "grid_no", "code", "score")


@query(f"WITH {GRID_SQL}, {_FUZZY_SQL.format(edits=2, more='AND hit = len(q) AND len(q) = len(g)')} SELECT p_partkey, grid_no, code FROM part LEFT JOIN b USING (p_name)")
def q_lookup_restrict(spark, sf_dir):
    return lookup.lookup_fuzzy(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", grid(spark), "grid_name", 2, every=True, restrict=True).select("p_partkey", "grid_no", "code")


@query(f"""
WITH {GRID_SQL}, q AS (SELECT DISTINCT p_name, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS q FROM part),
g AS (SELECT *, list_filter(string_split_regex(lower(grid_name), '[^a-z0-9]+'), lambda x: x <> '') AS g FROM grid),
h AS (SELECT *, array_to_string(q, ' ') = array_to_string(g, ' ') AS ex, len(q) = len(g) AND len(list_filter(q, lambda a: len(list_filter(g, lambda b: levenshtein(a, b) <= 1)) > 0)) = len(q) AS fz,
  len(list_filter(q, lambda a: list_contains(g, a))) AS wd, levenshtein(array_to_string(q, ' '), array_to_string(g, ' ')) AS e FROM q, g),
s AS (SELECT *, CASE WHEN ex THEN 3 WHEN fz THEN 2 WHEN wd > 0 THEN 1 ELSE 0 END AS rank, CASE WHEN ex THEN 0 WHEN fz THEN 0 ELSE wd + CASE WHEN len(q) = len(g) THEN len(q) + 1 ELSE 0 END END AS sc FROM h),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY rank DESC, sc DESC, e, grid_no) AS r FROM s WHERE rank > 0) WHERE r = 1)
SELECT p_partkey, grid_no, code, CASE rank WHEN 3 THEN 'exact' WHEN 2 THEN 'fuzzy' WHEN 1 THEN 'words' ELSE 'none' END AS rung FROM part LEFT JOIN b USING (p_name)""")
def q_lookup_ladder(spark, sf_dir):
    return lookup.lookup_ladder(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", grid(spark), "grid_name").select("p_partkey", "grid_no", "code", "rung")


# Texts, logs and documents


@query(r"""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'of the') THEN 'SPECIAL' WHEN b IS NOT NULL AND o IS NOT NULL THEN b || ' ' || o WHEN b IS NOT NULL THEN b ELSE 'OTHER' END AS action FROM (
SELECT *, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(and|et|und)([^a-z0-9]|$)') THEN 'ADD' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(or|ou|de)([^a-z0-9]|$)') THEN 'CHANGE' END AS b,
  CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(is|est|ist)([^a-z0-9]|$)') THEN 'PROVIDER' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(in|dans|la)([^a-z0-9]|$)') THEN 'ADDRESS' END AS o FROM conversations)""")
def q_action_class(spark, sf_dir):
    label = classify.action_class(F.col("text"), {"ADD": ["and", "et", "und"], "CHANGE": ["or", "ou", "de"]}, {"PROVIDER": ["is", "est", "ist"], "ADDRESS": ["in", "dans", "la"]}, {"of the": "SPECIAL"})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("action"))


@query("""
SELECT user_id, event_type, n_votes, latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_votes DESC, latest DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n_votes, max(ts) AS latest FROM events GROUP BY 1, 2)) WHERE r = 1""")
def q_majority_latest(spark, sf_dir):
    return classify.learned_labels(table(spark, sf_dir, "events"), "user_id", "event_type", "ts").select("user_id", "event_type", "n_votes", "latest")


@query("SELECT c_nationkey, md5(string_agg(DISTINCT c_custkey::VARCHAR, '|' ORDER BY c_custkey::VARCHAR)) AS key_hash, count(DISTINCT c_custkey) AS n_values FROM customer GROUP BY 1")
def q_md5_keys(spark, sf_dir):
    return classify.key_hashes(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey")


@query("""
SELECT e.event_id, e.user_id, e.value, round(sum(e.value) OVER (PARTITION BY e.user_id), 4) AS token_total, c_name FROM events e JOIN customer ON c_custkey = e.user_id""")
def q_run_log(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    log = classify.run_log(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), customers, "user_id", "value")
    return log.withColumn("token_total", F.round("token_total", 4))


@query("""
SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS by_marker,
  sum(CASE WHEN event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS by_change
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def q_page_segments(spark, sf_dir):
    rows, order = table(spark, sf_dir, "events"), ["ts", "event_id"]
    marked = documents.records_by_marker(rows, ["user_id"], order, F.col("event_type") == "signup").withColumnRenamed("record_no", "by_marker")
    return documents.records_by_change(marked, ["user_id"], order, "event_type").select("event_id", "by_marker", F.col("record_no").alias("by_change"))


@query("""
SELECT event_id, sum(CASE WHEN prev IS NULL OR epoch(ts) - epoch(prev) > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS record_no
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)""")
def q_session_events(spark, sf_dir):
    return documents.records_by_gap(table(spark, sf_dir, "events"), ["user_id"], "ts", 21600).select("event_id", "record_no")


_WORDS = "SELECT l_orderkey AS doc_id, (l_linenumber % 2)::INT AS page, (l_partkey % 50) * 10.0 AS x0, (l_suppkey % 20) * 5.0 + l_discount * 10 AS y0, (l_partkey % 50) * 10.0 + 8 AS x1, (l_suppkey % 20) * 5.0 + 4 AS y1, l_returnflag || l_partkey AS word FROM lineitem"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as words with boxes."""
    x, y = F.col("l_partkey") % 50 * 10.0, F.col("l_suppkey") % 20 * 5.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("page"), x.alias("x0"), (y + F.col("l_discount") * 10).alias("y0"),
        (x + 8).alias("x1"), (y + 4).alias("y1"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("word"),
    )


@query(f"""
WITH w AS ({_WORDS}), a AS (SELECT *, lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS p FROM w),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR y0 - p > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) AS line_no FROM a)
SELECT doc_id, page, line_no, round(min(y0), 4) AS y0, max(y1) AS y1, string_agg(word, ' ' ORDER BY x0, word) AS text FROM b GROUP BY 1, 2, 3""")
def q_text_lines(spark, sf_dir):
    return documents.text_lines(words(spark, sf_dir)).withColumn("y0", F.round("y0", 4))


@query(f"""
WITH w AS ({_WORDS}) SELECT doc_id, page, 'top' AS name, string_agg(word, ' ' ORDER BY y0, x0, word) AS text FROM w WHERE x0 >= 0 AND x1 <= 250 AND y0 >= 0 AND y1 <= 50 GROUP BY 1, 2""")
def q_region_text(spark, sf_dir):
    found = words(spark, sf_dir)
    regions = found.select("doc_id", "page").distinct().select("*", F.lit("top").alias("name"), F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(250.0).alias("max_x"), F.lit(50.0).alias("max_y"))
    return documents.region_text(found, regions)


@query(f"""
WITH w AS ({_WORDS}), a AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, y0 ROWS UNBOUNDED PRECEDING) AS column_no FROM a)
SELECT doc_id, page, column_no, count(*) AS n_words FROM b GROUP BY 1, 2, 3""")
def q_table_columns(spark, sf_dir):
    return documents.table_columns(words(spark, sf_dir)).groupBy("doc_id", "page", "column_no").agg(F.count("*").alias("n_words"))


@query("""
WITH a AS (SELECT *, lag(l_returnflag = 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS open FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem)),
b AS (SELECT *, sum(CASE WHEN open IS NULL OR NOT open THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS run_no FROM a)
SELECT l_orderkey, run_no, string_agg(l_partkey || CASE WHEN l_returnflag = 'R' THEN ',' ELSE '' END, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS item FROM b GROUP BY 1, 2""")
def q_merge_delimited(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    rows = rows.withColumn("item", F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", ",").otherwise("")))
    return documents.merge_delimited(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "item")


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS page_lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="')) AS n_links FROM pages""")
def q_html_fields(spark, sf_dir):
    return markup.page_fields(table(spark, sf_dir, "pages"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def q_grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2")
def q_stream_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.read_rows(spark, f"{sf_dir}/events.parque[t]", schema)  # as a pattern: a stream's path may not be one file
    return ingest.run_once(ingest.windowed_counts(stream, "ts", "event_type", late="365 days"))


# Programs and the whole run


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderstatus = 'P' THEN 'Clarify: pending|Input: P' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice >= 0 THEN 'Y' ELSE 'N' END AS priced FROM orders""")
def q_rule_program(spark, sf_dir):
    frames = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")}
    steps = [
        {"layer": "cleanse", "type": "ROW", "steps": [
            {"frame": "orders", "rule": "standard_value", "output": "priority", "arguments": {"value": {"col": "o_orderpriority"}, "synonyms": {"HIGH": ["1-URGENT", "2-HIGH"]}}},
            {"frame": "orders", "rule": "tree", "output": "priced", "arguments": {"tree": "isEffectiveDateNotEmpty", "bind": [{"col": "o_totalprice"}]}},
        ]},
        {"layer": "update", "type": "DF", "steps": [
            {"frame": "orders", "rule": "update_where", "arguments": {"column": "o_orderstatus", "where": {"col": "o_orderstatus", "equals": "P"}, "message": ["C", "pending"]}},
        ]},
    ]
    out = program.run_program(steps, frames)["orders"]
    return out.select("o_orderkey", "priority", F.col("o_orderstatus").alias("status"), "priced")


@query("""
WITH r AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p, count(DISTINCT o_orderpriority) AS n, min(o_orderdate) AS d, count(*) AS c FROM orders GROUP BY 1)
SELECT o_custkey::VARCHAR AS "Key", coalesce(c_name, '') AS "Name", CASE WHEN n > 1 THEN 'Clarify: Multiple values found, Picking up the first value|Input: ' || p ELSE p END AS "Priority", strftime(d, '%m/%d/%Y') AS "First", lpad(c::VARCHAR, 4, '0') AS "Rows"
FROM r LEFT JOIN customer ON c_custkey = o_custkey""")
def q_roster_run(spark, sf_dir):
    return pipeline.roster_run(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


from rosterloom import form_queries, rule_queries  # noqa: E402, F401  register their queries too
