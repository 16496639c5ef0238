"""Registered queries of the rules on rows, names, addresses, lookups by several fields, and programs from JSON."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from rosterloom.errors import is_message, parts
from rosterloom.functions import clean, hours, tagging, text
from rosterloom.operators import keys, lookup, rows, templates, update
from rosterloom.plans import program
from rosterloom.queries import GRID, GRID_SQL, grid, query, spread, table
from rosterloom.schema import ColumnRef, assign_headers, drift_rows, match_formats
from rosterloom.sources import config, spreadsheet, tables
from rosterloom.streaming import ingest

# Programs

_PROGRAM = json.dumps([
    {"LayerName": "cleanse", "LayerType": "ROW", "ProcessStage": 0, "Transformation": [{"orders": {"derivations": [
        {"name": "standard_value", "type": "var", "input": [{"col": "o_orderpriority"}, {"HIGH": ["1-URGENT", "2-HIGH"]}], "col": "priority"},
        {"name": "isEffectiveDateNotEmpty", "type": "tree", "input": [{"col": "o_orderstatus"}], "col": "filled"},
        {"name": "value_or", "type": "mv_cmn", "input": [{"col": "filled"}, {"col": "priority"}], "col": "again"},
        {"name": "phone", "input": {"value": {"col": "absent"}}, "col": "lost"},
        {"name": "name_parts", "input": [{"col": "o_orderpriority"}], "col": ["last", "first", "middle"]},
    ]}}]},
    {"LayerName": "update", "LayerType": "DF", "ProcessStage": 0, "Transformation": [{"orders": {"derivations": [
        {"name": "no_such_rule", "input": {}},
        {"name": "update_where", "input": "{'column': 'o_orderstatus', 'where': {'col': 'o_orderstatus', 'equals': 'P'}, 'message': ['C', 'pending']}"},
    ]}}]},
    {"LayerName": "later", "LayerType": "DF", "ProcessStage": 1, "Transformation": [{"orders": {"derivations": [{"name": "drop_columns", "input": {"columns": ["priority"]}}]}}]},
])


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' ELSE o_orderpriority END AS priority, 'Y' AS again, 'Error: Undefined Error|Input: ' AS lost,
  CASE WHEN o_orderstatus = 'P' THEN 'Clarify: pending|Input: P' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderpriority LIKE '% %' THEN regexp_extract(o_orderpriority, '([^ ]+)$', 1) ELSE o_orderpriority END AS last_word, 2 AS n_trapped FROM orders""")
def q_json_program(spark, sf_dir):
    trapped: list[str] = []
    frames = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")}
    out = program.run_program(config.program(json.loads(_PROGRAM), stage=0), frames, trapped=trapped)["orders"]
    return out.select("o_orderkey", "priority", "again", "lost", F.col("o_orderstatus").alias("status"), F.col("last").alias("last_word"), F.lit(len(trapped)).alias("n_trapped"))


_TRAPPED = [{"layer": "derive", "type": "ROW", "steps": [
    {"frame": "orders", "rule": "quotient", "output": "times", "arguments": [{"col": "o_orderkey"}, {"col": "part"}]},
    {"frame": "orders", "rule": "number", "output": "number", "arguments": [{"col": "code"}]},
    {"frame": "orders", "rule": "joined", "output": "both", "arguments": [[{"col": "times"}, {"col": "number"}], "/"]},
]}]


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Error: Undefined Error|Input: ' ELSE (o_orderkey // (o_orderkey % 5))::VARCHAR END AS times,
  CASE WHEN o_orderstatus = 'P' THEN 'Error: Undefined Error|Input: ' WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey::VARCHAR END AS number FROM orders)
SELECT *, concat_ws('/', times, number) AS both FROM x""")
def q_trapped_rows(spark, sf_dir):
    code = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("part"), code.alias("code"))
    return program.run_program(_TRAPPED, {"orders": orders}, trapped=[])["orders"].drop("part", "code")


_DYNAMIC = [{"layer": "derive", "type": "ROW", "steps": [
    {"frame": "orders", "rule": "named_value", "output": "DYNAMIC", "arguments": [{"col": "name"}, {"col": "o_orderstatus"}]},
    {"frame": "orders", "rule": "named_values", "output": "DYNAMIC", "arguments": [{"col": "names"}, {"col": "codes"}]},
]}]


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderstatus END AS "PRIO_2", CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderstatus END AS "PRIO_3",
  CASE WHEN o_orderpriority LIKE '4%' THEN o_orderstatus END AS "PRIO_4", CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END AS "PRIO_5",
  CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 7)::VARCHAR END AS "TAG_0", CASE WHEN o_custkey % 3 = 1 THEN (o_custkey % 7)::VARCHAR END AS "TAG_1", CASE WHEN o_custkey % 3 = 2 THEN 'last' ELSE 'was' END AS held FROM orders""")
def q_dynamic_columns(spark, sf_dir):
    prio, k = F.substring("o_orderpriority", 1, 1), F.col("o_custkey") % 3
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(prio != "1", F.concat(F.lit("PRIO_"), prio)).otherwise("").alias("name"), F.lit("was").alias("held"),
        F.when(k == 2, F.array(F.lit("held"), F.lit(" "), F.lit("held"))).otherwise(F.array(F.concat(F.lit("TAG_"), k.cast("string")))).alias("names"),
        F.when(k == 2, F.array(F.lit("first"), F.lit("none"), F.lit("last"))).otherwise(F.array((F.col("o_custkey") % 7).cast("string"))).alias("codes"),
    )
    return program.run_program(_DYNAMIC, {"orders": orders})["orders"].drop("o_orderstatus", "name", "names", "codes")


_FIELDS = {"SIZE": ["smal", "largge"], "COLOUR": ["redd", "blu", "greeen"], "KIND": ["widgett", "rings", "bollt"], "OTHER": ["widget", "smalls", "platte"], "GRADE": ["economi", "standart", "promos"], "MATTER": ["standard", "brasss", "copperr"]}
_TAKEN = {"OTHER": 2}
_ALIASES = ", ".join(f"('{f}', '{a}')" for f, own in _FIELDS.items() for a in own)


@query(f"""
WITH RECURSIVE f AS (SELECT p_partkey AS file, unnest(range(len(l)))::BIGINT AS place, unnest(l) AS header FROM (SELECT p_partkey, string_split(lower(p_type || ' ' || p_name || ' ' || p_type), ' ') AS l FROM part)),
a(field, alias) AS (VALUES {_ALIASES}), h AS (SELECT DISTINCT header FROM f),
s AS (SELECT header, field, max(round(100.0::DOUBLE * (greatest(length(header), length(alias)) - levenshtein(header, alias)) / greatest(length(header), length(alias)), 4)) AS score FROM h, a GROUP BY 1, 2),
c AS (SELECT header, list((field, score) ORDER BY score DESC, field) AS cs FROM s WHERE score > 75 GROUP BY 1),
rows_ AS (SELECT f.*, coalesce(cs, []) AS cs FROM f LEFT JOIN c USING (header)),
g AS (SELECT file, -1::BIGINT AS place, ''::VARCHAR AS header, NULL::VARCHAR AS field, NULL::DOUBLE AS score, []::VARCHAR[] AS taken FROM (SELECT DISTINCT file FROM f)
  UNION ALL SELECT file, place, header, b[1], b[2], CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b[1]) END
  FROM (SELECT r.file, r.place, r.header, g.taken, list_filter(r.cs, lambda x: len(list_filter(g.taken, lambda t: t = x[1])) < CASE WHEN x[1] = 'OTHER' THEN 2 ELSE 1 END)[1] AS b FROM g JOIN rows_ r ON r.file = g.file AND r.place = g.place + 1))
SELECT file, place, header, field, score FROM g WHERE place >= 0""")
def q_header_assignment(spark, sf_dir):
    words = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_type")), " ")
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.posexplode(words).alias("place", "header"))
    return assign_headers(files, _FIELDS, _TAKEN)


_FILTERED = [{"layer": "filter", "type": "DF", "steps": [
    {"frame": "orders", "rule": "keep_or_default", "output": "all", "arguments": {"key": ["o_custkey"], "order": ["o_orderkey"], "where": {"all": [{"col": "o_orderstatus", "equals": "P"}, {"col": "o_orderpriority", "in": ["1-URGENT", "2-HIGH"]}]}}},
    {"frame": "orders", "rule": "keep_or_default", "output": "top", "arguments": {"key": ["o_custkey"], "order": ["o_orderkey"], "where": {"col": "o_orderstatus", "equals": "O"}, "top_row": True}},
]}]


@query("""
WITH k AS (SELECT DISTINCT o_custkey FROM orders), a AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
t AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT 'all' AS step, o_custkey, o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority FROM k LEFT JOIN a USING (o_custkey)
UNION ALL SELECT 'top', o_custkey, o_orderkey, coalesce(o_orderstatus, ''), coalesce(o_orderpriority, '') FROM k LEFT JOIN t USING (o_custkey)""")
def q_keep_or_default(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    found = program.run_program(_FILTERED, {"orders": orders})
    return found["all"].withColumn("step", F.lit("all")).unionByName(found["top"].withColumn("step", F.lit("top")))


_ASKED = "SELECT o_custkey AS k, 'custmer ' || lpad(o_custkey::VARCHAR, 9, '0') AS v FROM orders"


@query(f"""
WITH q AS (SELECT DISTINCT * FROM ({_ASKED})), g AS (SELECT c_custkey AS grid_no, lpad(c_custkey::VARCHAR, 9, '0') AS c FROM customer),
w AS (SELECT k, grid_no, row_number() OVER (PARTITION BY k ORDER BY levenshtein(v, 'customer ' || c), grid_no) AS r FROM q JOIN g ON levenshtein(substr(v, 9), c) <= 1)
SELECT o_orderkey, grid_no FROM orders LEFT JOIN w ON k = o_custkey AND r = 1""")
def q_lookup_hot(spark, sf_dir):
    """One word is in every text and every grid row; the other one finds the candidates."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("custmer "), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("v"))
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid_no"), F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("c"))
    return lookup.lookup_fuzzy(asked, "v", held, "c", 1, every=True).select("o_orderkey", "grid_no")


_TABLE_STEPS = [{"outTemplate": "both", "name": "move_common", "type": "interTmplt", "input": {"cols": {"open": {"intersection": ["o_custkey"], "deleteFlag": True}, "done": {"intersection": ["o_custkey"], "deleteFlag": True}}}}]


@query("""
WITH both_ AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM both_) THEN 'both' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS template FROM orders WHERE o_orderstatus IN ('O', 'F')""")
def q_table_steps(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    frames = {"open": orders.filter("o_orderstatus = 'O'"), "done": orders.filter("o_orderstatus = 'F'")}
    found = program.run_program(config.table_steps(_TABLE_STEPS), frames)
    one, two, three = (found[n].select("o_orderkey", "o_custkey", F.lit(n).alias("template")) for n in ("open", "done", "both"))
    return one.unionAll(two).unionAll(three)


@query("""
SELECT c_custkey, c_name AS "NAME", '' AS "NOTE", CASE WHEN c_nationkey IN (1, 2) THEN 'near' ELSE 'far' END AS place FROM customer
WHERE contains(c_name, '7') AND NOT contains(c_name, '9') AND c_mktsegment NOT IN ('BUILDING') AND trim(CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END) <> ''""")
def q_frame_rules(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    frame = customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment")).alias("filled"), F.lit("x").alias("NOTE"))
    steps = [
        {"frame": "c", "rule": "keep_where", "arguments": {"where": {"all": [{"col": "c_name", "matches": "7"}, {"not": {"col": "c_name", "matches": "9"}}]}}},
        {"frame": "c", "rule": "keep_where", "arguments": {"where": {"all": [{"not": {"col": "c_mktsegment", "in": ["BUILDING"]}}, {"col": "filled", "blank": False}]}}},
        {"frame": "c", "rule": "drop_blank_rows", "arguments": {"columns": ["filled"]}},
        {"frame": "c", "rule": "rename", "arguments": {"names": {"c_name": "NAME"}}},
        {"frame": "c", "rule": "blank_columns", "arguments": {"columns": ["NOTE"]}},
        {"frame": "c", "rule": "drop_columns", "arguments": {"columns": ["c_mktsegment", "not there"]}},
    ]
    out = program.run_program([{"layer": "l", "type": "DF", "steps": steps}], {"c": frame})["c"]
    return out.select("c_custkey", "NAME", "NOTE", F.when(F.col("c_nationkey").isin(1, 2), "near").otherwise("far").alias("place"))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 2 END AS r, min(CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey) AS b FROM orders) WHERE r = b""")
def q_keep_first_where(spark, sf_dir):
    wheres = [{"col": "o_orderstatus", "equals": "P"}, {"col": "o_orderpriority", "equals": "5-LOW"}]
    return program.keep_first_where(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], wheres).select("o_custkey", "o_orderkey")


@query("""
SELECT o_orderkey, first_part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_sibling_value(spark, sf_dir):
    frames = {"orders": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "lines": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")}
    step = {"frame": "orders", "rule": "join_first", "arguments": {"other": {"frame": "lines"}, "key": ["k"], "column": "l_partkey", "order": ["l_linenumber", "l_partkey"], "output": "first_part"}}
    return program.run_program([{"layer": "l", "type": "DF", "steps": [step]}], frames)["orders"].withColumnRenamed("k", "o_orderkey")


# Lookups

_BRANDS = [(n, name, f"Brand#{10 + n}") for n, name, _ in GRID] + [(20, "red widget", "Brand#12"), (21, "red widget", "Brand#30"), (22, "blue bolts", "Brand#31")]
_BRANDS_SQL = "grid(grid_no, grid_name, brand) AS (VALUES " + ", ".join(f"({n}, '{a}', '{b}')" for n, a, b in _BRANDS) + ")"
_CUT = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_HIT = "len(list_filter({0}, lambda a: len(list_filter({1}, lambda b: levenshtein(a, b) <= {2})) > 0))"


def brands(spark):
    return spark.createDataFrame(_BRANDS, "grid_no int, grid_name string, brand string")


@query(f"""
WITH {_BRANDS_SQL}, q AS (SELECT DISTINCT p_name, p_brand, {_CUT.format("p_name")} AS a, {_CUT.format("p_brand")} AS b FROM part), g AS (SELECT *, {_CUT.format("grid_name")} AS c, {_CUT.format("brand")} AS d FROM grid),
h AS (SELECT *, {_HIT.format("a", "c", 1)} AS h1, {_HIT.format("b", "d", 0)} AS h2 FROM q, g),
s AS (SELECT *, h1 + CASE WHEN len(a) = len(c) THEN len(a) + 1 ELSE 0 END + CASE WHEN h2 > 0 THEN h2 + CASE WHEN len(b) = len(d) THEN len(b) + 1 ELSE 0 END ELSE 0 END AS score,
  levenshtein(array_to_string(a, ' '), array_to_string(c, ' ')) + CASE WHEN h2 > 0 THEN levenshtein(array_to_string(b, ' '), array_to_string(d, ' ')) ELSE 0 END AS e FROM h WHERE h1 > 0),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY score DESC, e, grid_no) AS r FROM s) WHERE r = 1)
SELECT p_partkey, grid_no, score::DOUBLE AS score FROM part LEFT JOIN w USING (p_name, p_brand)""")
def q_lookup_composite(spark, sf_dir):
    fields = [lookup.FieldQuery("p_name", "grid_name", 1), lookup.FieldQuery("p_brand", "brand", 0, must=False)]
    return lookup.lookup_composite(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), brands(spark), fields).select("p_partkey", "grid_no", "score")


@query(f"""
WITH {_BRANDS_SQL}, q AS (SELECT DISTINCT p_name, {_CUT.format("p_name")} AS a FROM part), g AS (SELECT *, {_CUT.format("grid_name")} AS c FROM grid),
h AS (SELECT *, {_HIT.format("a", "c", 0)} AS h1, levenshtein(array_to_string(a, ' '), array_to_string(c, ' ')) AS e FROM q, g),
w AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY p_name ORDER BY h1 + CASE WHEN len(a) = len(c) THEN len(a) + 1 ELSE 0 END DESC, e) AS r FROM h WHERE h1 > 0) WHERE r = 1)
SELECT p_partkey, grid_no, brand FROM part LEFT JOIN w USING (p_name)""")
def q_leading_hits(spark, sf_dir):
    return lookup.leading_hits(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", brands(spark), "grid_name").select("p_partkey", "grid_no", "brand")


@query(f"""
WITH {GRID_SQL}, q AS (SELECT DISTINCT p_name || ' kit' AS v, {_CUT.format("p_name || ' kit'")} AS a FROM part), g AS (SELECT *, {_CUT.format("grid_name")} AS c FROM grid),
h AS (SELECT *, {_HIT.format("a", "c", 1)} AS h1, levenshtein(array_to_string(a, ' '), array_to_string(c, ' ')) AS e FROM q, g),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY h1 + CASE WHEN len(a) = len(c) THEN len(a) + 1 ELSE 0 END DESC, e, grid_no) AS r FROM h WHERE h1 >= 0.6 * len(a)) WHERE r = 1)
SELECT p_partkey, grid_no FROM part LEFT JOIN w ON v = p_name || ' kit'""")
def q_lookup_least(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" kit")).alias("v"))
    return lookup.lookup_fuzzy(asked, "v", grid(spark), "grid_name", 1, least=0.6).select("p_partkey", "grid_no")


@query(f"""
WITH lots AS (SELECT DISTINCT l_orderkey * 1000000 + l_partkey AS grid_no, replace(p_name, 'i', '') || ' ' || l_orderkey AS lot FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT *, {_CUT.format("lot")} AS c FROM lots), q AS (SELECT DISTINCT p_name, {_CUT.format("p_name")} AS a FROM part),
h AS (SELECT p_name, grid_no, {_HIT.format("a", "c", 1)} AS h1, a, c FROM q, g WHERE levenshtein(a[1], c[1]) <= 1 OR levenshtein(a[2], c[2]) <= 1),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY h1 DESC, levenshtein(array_to_string(a, ' '), array_to_string(c, ' ')), grid_no) AS r FROM h WHERE h1 > 0) WHERE r = 1)
SELECT p_partkey, grid_no, h1 AS n_found FROM part LEFT JOIN w USING (p_name)""")
def q_lookup_large(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    lots = lines.select((F.col("l_orderkey") * 1_000_000 + F.col("p_partkey")).alias("grid_no"), F.concat(F.translate("p_name", "i", ""), F.lit(" "), F.col("l_orderkey").cast("string")).alias("lot")).distinct()
    found = lookup.lookup_fuzzy(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", lots, "lot")
    return found.select("p_partkey", "grid_no", F.col("score").cast("long").alias("n_found"))


@query("SELECT n_nationkey AS grid_no, n_name FROM nation")
def q_match_all(spark, sf_dir):
    return lookup.all_rows(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("grid_no"), "n_name"))


_ALIASES = {"RING": ["small ring", "rings"], "WIDGET": ["red widgets", "wdget red"], "BOLT": ["bleu bolt", "hot bolt"]}
_ALIAS_ROWS = ", ".join(f"({i}, '{f}', '{a}')" for i, (f, a) in enumerate((f, a) for f, own in _ALIASES.items() for a in own))


@query(f"""
WITH a(n, field, alias) AS (VALUES {_ALIAS_ROWS}), s AS (SELECT p_name, n, field, alias, round(100.0 * (greatest(length(p_name), length(alias)) - levenshtein(lower(p_name), alias)) / greatest(length(p_name), length(alias)), 4) AS percent FROM (SELECT DISTINCT p_name FROM part), a),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY percent DESC, n) AS r FROM s) WHERE r = 1 AND percent >= 75)
SELECT p_partkey, field, alias, percent FROM part LEFT JOIN b USING (p_name)""")
def q_best_alias(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.best_alias(F.col("p_name"), _ALIASES).alias("b")).select("p_partkey", "b.field", "b.alias", "b.percent")


_FORMATS = {"full": ["click", "error", "purchase", "signup", "view"], "four": ["click", "error", "view", "signup"], "other": ["view", "absent"]}
_FORMAT_ROWS = ", ".join(f"('{f}', {i}, '{h}')" for f, own in _FORMATS.items() for i, h in enumerate(own))


@query(f"""
WITH s(format, place, header) AS (VALUES {_FORMAT_ROWS}), f AS (SELECT user_id AS file, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS place, event_type AS header FROM (SELECT DISTINCT user_id, event_type FROM events)),
a AS (SELECT file, list(header ORDER BY place) AS l FROM f GROUP BY 1), b AS (SELECT format, list(header ORDER BY place) AS m FROM s GROUP BY 1),
c AS (SELECT file, format, count(*) AS n FROM f JOIN s USING (header) GROUP BY 1, 2),
p AS (SELECT file, format, CASE WHEN l = m THEN 100 WHEN n * 90 // greatest(len(l), len(m)) >= 70 THEN n * 90 // greatest(len(l), len(m)) ELSE 0 END AS percent FROM c JOIN a USING (file) JOIN b USING (format))
SELECT file, format, percent::INT AS percent, row_number() OVER (PARTITION BY file ORDER BY percent DESC, format) = 1 AND percent > 0 AS best FROM p""")
def q_header_overlap(spark, sf_dir):
    files = keys.record_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])
    files = rows.numbered_places(files.select(F.col("user_id").alias("file"), F.col("event_type").alias("header")), ["file"], ["header"], "place")
    saved = spark.createDataFrame([(f, i, h) for f, own in _FORMATS.items() for i, h in enumerate(own)], "format string, place int, header string")
    return match_formats(files, saved)


@query(f"""
WITH s(format, place, header) AS (VALUES {_FORMAT_ROWS}), f AS (SELECT DISTINCT user_id AS file, event_type AS header FROM events), o AS (SELECT header FROM s WHERE format = 'four')
SELECT u.file, coalesce(f.header, o.header) AS header, CASE WHEN o.header IS NULL THEN 'new' WHEN f.header IS NULL THEN 'removed' ELSE 'unchanged' END AS state
FROM (SELECT DISTINCT file FROM f) u CROSS JOIN (SELECT DISTINCT header FROM (SELECT header FROM f UNION ALL SELECT header FROM o)) x LEFT JOIN f ON f.file = u.file AND f.header = x.header LEFT JOIN o ON o.header = x.header
WHERE f.header IS NOT NULL OR o.header IS NOT NULL""")
def q_header_drift(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("header")).distinct()
    return drift_rows(files, _FORMATS["four"])


# Rows of a record


@query("""
SELECT o_orderkey, o_orderstatus, 0 AS clone_no FROM orders UNION ALL SELECT o_orderkey, 'X', n::INT FROM orders, (VALUES (1), (2)) c(n) WHERE o_orderstatus = 'P'""")
def q_clone_rows(spark, sf_dir):
    return rows.clone_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus = 'P'", {"o_orderstatus": "X"}, 2)


@query("""
SELECT l_returnflag, l_linestatus, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def q_template_dedupe(spark, sf_dir):
    lines = rows.without_duplicates(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey"))
    return rows.without_duplicates(lines, ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN '555' || c_custkey ELSE '' END AS phone, CASE WHEN c_custkey % 4 > 1 THEN '777' || c_custkey END AS fax, CASE WHEN c_custkey % 5 = 0 THEN 'M' ELSE ' ' END AS kind FROM customer)
SELECT c_custkey, phone AS "NUMBER", CASE WHEN trim(kind) = '' THEN 'P' ELSE kind END AS "KIND" FROM x WHERE phone <> ''
UNION ALL SELECT c_custkey, fax, CASE WHEN trim(kind) = '' THEN 'F' ELSE kind END FROM x WHERE coalesce(fax, '') <> ''
UNION ALL SELECT c_custkey, '', kind FROM x WHERE phone = '' AND coalesce(fax, '') = ''""")
def q_contact_rows(spark, sf_dir):
    key = F.col("c_custkey")
    frame = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 > 0, F.concat(F.lit("555"), key.cast("string"))).otherwise("").alias("phone"), F.when(key % 4 > 1, F.concat(F.lit("777"), key.cast("string"))).alias("fax"), F.when(key % 5 == 0, "M").otherwise(" ").alias("kind"))
    return rows.contact_rows(frame, "phone", "fax", "kind", ["c_custkey", "NUMBER", "KIND"]).select("c_custkey", "NUMBER", "KIND")


@query("""
SELECT p_partkey, '{"A@0":"' || p_name || '","B@1":"' || p_type || '"}' AS "NAME", '{"A@0":{"0":"' || p_size || '","1":"' || p_brand || '"}}' AS "PHONE" FROM part""")
def q_nested_maps(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("A@NAME@0"), F.col("p_type").alias("B@NAME@1"), F.col("p_size").alias("A@PHONE#0@0"), F.col("p_brand").alias("A@PHONE#1@0"))
    return rows.nested_maps(wide).select("p_partkey", F.to_json("NAME").alias("NAME"), F.to_json("PHONE").alias("PHONE"))


@query("""SELECT p_partkey, p_name AS "A@NAME@0", p_type AS "A@NAME@1", p_brand AS "B@NAME@2", p_size AS "B@CODE#0@2", p_retailprice AS "B@CODE#1@2" FROM part""")
def q_renumbered_sets(spark, sf_dir):
    refs = {"p_name": ColumnRef("A", "NAME", 0), "p_type": ColumnRef("A", "NAME", 3), "p_brand": ColumnRef("B", "NAME", 0), "p_size": ColumnRef("B", "CODE", 0, 0), "p_retailprice": ColumnRef("B", "CODE", 0, 1)}
    wide = table(spark, sf_dir, "part").select("p_partkey", *(F.col(c).alias(r.name) for c, r in refs.items()))
    return rows.renumbered_sets(wide)


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS s FROM orders)
SELECT o_custkey, o_orderkey, n >= s - 2 AS late FROM x WHERE n >= 1 AND n < 3 OR n >= s - 2""")
def q_sliced(spark, sf_dir):
    orders, order = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]
    early, late = rows.sliced(orders, ["o_custkey"], order, 1, 3), rows.sliced(orders, ["o_custkey"], order, -2)
    both = late.withColumn("late", F.lit(True)).unionByName(early.join(late.select("o_orderkey"), "o_orderkey", "left_anti").withColumn("late", F.lit(False)))
    return rows.sorted_rows(both, ["o_custkey", "o_orderdate"], [True, False]).select("o_custkey", "o_orderkey", "late")


@query("""
WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS addr, CASE event_type WHEN 'click' THEN 'Bill' WHEN 'view' THEN 'plsv' WHEN 'signup' THEN 'MAIL' ELSE 'cred' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'P' ELSE 's' END AS ind, CASE WHEN event_id % 3 = 0 THEN 'm' ELSE '' END AS mail FROM events)
SELECT event_id, CASE WHEN addr = '' THEN '' WHEN kind = 'Bill' AND count(*) FILTER (WHERE kind = 'Bill' AND addr <> '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 1 THEN 'Clarify: Multiple billing address|Input: '
  WHEN kind IN ('Bill', 'MAIL') OR (kind = 'plsv' AND ind = 'P' AND mail = '') THEN 'P' ELSE 'S' END AS "CORRESPONDENCE" FROM x""")
def q_correspondence(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "Bill").when(F.col("event_type") == "view", "plsv").when(F.col("event_type") == "signup", "MAIL").otherwise("cred")
    frame = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("addr"), kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "P").otherwise("s").alias("ind"), F.when(F.col("event_id") % 3 == 0, "m").otherwise("").alias("mail"))
    return rows.correspondence(frame, ["user_id"], ["ts", "event_id"], "addr", "kind", "mail", "ind").select("event_id", "CORRESPONDENCE")


@query("""
WITH a AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'Bill' WHEN 'purchase' THEN 'cred' ELSE 'plsv' END AS kind FROM events), c AS (SELECT c_custkey AS user_id, c_name FROM customer),
h AS (SELECT *, bool_or(kind = 'cred') OVER (PARTITION BY user_id) AS has FROM a), f AS (SELECT *, CASE WHEN has THEN kind = 'cred' ELSE kind = 'Bill' END AS flag FROM h)
SELECT event_id, coalesce(f.user_id, c.user_id) AS user_id, kind, c_name FROM f FULL JOIN c ON f.user_id = c.user_id AND flag""")
def q_contact_addresses(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "Bill").when(F.col("event_type") == "purchase", "cred").otherwise("plsv")
    addresses = table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"))
    contact = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return templates.contact_addresses(addresses, contact, "kind", ["user_id"]).select("event_id", "user_id", "kind", "c_name")


@query("""SELECT o_orderkey, coalesce(c_name, 'Error: Not in registry|Input: ') AS c_name, coalesce(c_mktsegment, 'Error: Not in registry|Input: ') AS c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def q_enriched(spark, sf_dir):
    registry = table(spark, sf_dir, "customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return templates.enriched(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), registry, "o_custkey", ["c_name", "c_mktsegment"], "Error: Not in registry|Input: ").drop("o_custkey")


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_returnflag = 'R') AS all_returned, bool_or(l_discount > 0.09) AS any_cheap, bool_and(l_discount > 0.09) AS all_cheap FROM lineitem GROUP BY 1""")
def q_any_all(spark, sf_dir):
    return templates.any_all(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"returned": F.col("l_returnflag") == "R", "cheap": F.col("l_discount") > 0.09})


@query("""
SELECT k AS o_custkey, count(*) FILTER (WHERE t = 'o') AS orders_rows, count(*) FILTER (WHERE t = 'c') AS customers_rows, count(*) FILTER (WHERE t = 'e') AS events_rows
FROM (SELECT o_custkey AS k, 'o' AS t FROM orders UNION ALL SELECT c_custkey, 'c' FROM customer UNION ALL SELECT user_id, 'e' FROM events) GROUP BY 1""")
def q_occurrence_pivot(spark, sf_dir):
    frames = {"orders": table(spark, sf_dir, "orders"), "customers": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "events": table(spark, sf_dir, "events").withColumnRenamed("user_id", "o_custkey")}
    return templates.occurrence_pivot(frames, ["o_custkey"])


@query("""
WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'click' THEN props ELSE '' END AS p FROM events)
SELECT event_id, CASE WHEN p <> '' THEN p ELSE coalesce(last_value(nullif(p, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') END AS p FROM x""")
def q_group_fill_last(spark, sf_dir):
    frame = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("props")).otherwise(" ").alias("p"))
    return update.fill_group(frame, "p", ["user_id"], ["ts", "event_id"], from_first=False).select("event_id", "p")


# Cleaning

_STANDARDS = {"SIZE": ["small", "large"], "COLOR": ["red", "blue"], "STATE": ["old", "hot"]}


@query(r"""
WITH x AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS v, regexp_extract(p_name || ' ' || lower(p_type), '(?:^|\s)(small|large|red|blue|old|hot)(?:\s|$)', 1) AS w FROM part)
SELECT p_partkey, CASE WHEN w IN ('small', 'large') THEN 'SIZE' WHEN w IN ('red', 'blue') THEN 'COLOR' WHEN w IN ('old', 'hot') THEN 'STATE' ELSE 'none' END AS indicator,
  CASE WHEN regexp_matches(v, '\b(small|large)\b') THEN 'S' WHEN regexp_matches(v, '\b(red|blue)\b') THEN 'P' WHEN regexp_matches(v, '\b(old|hot)\b') THEN 'S' ELSE v END AS rank,
  CASE WHEN regexp_matches(v, '(?i)RED|hot') THEN 'warm' WHEN regexp_matches(v, '(?i)blue') THEN 'cold' ELSE v END AS cased FROM x""")
def q_indicators(spark, sf_dir):
    value = F.concat_ws(" ", "p_name", F.lower("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", clean.indicator(value, _STANDARDS, "none").alias("indicator"), clean.primary_secondary(value, _STANDARDS, "COLOR").alias("rank"),
        clean.regex_value(value, {"warm": "red|HOT", "cold": "blue"}).alias("cased"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '207Q' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') || 'X' ELSE 'code ' || c_custkey END AS code,
  CASE WHEN c_acctbal < 0 AND c_nationkey > 5 THEN 'Clarify: Mandatory field Missing Value|Input: ' WHEN c_acctbal < 0 THEN '' ELSE c_name END AS needed FROM customer""")
def q_group_mandatory(spark, sf_dir):
    key = F.col("c_custkey")
    value = F.when(key % 2 == 0, F.concat(F.lit("see 207Q"), F.lpad((key % 100000).cast("string"), 5, "0"), F.lit("X please"))).otherwise(F.concat(F.lit("code "), key.cast("string")))
    needed = clean.group_mandatory(F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")), F.when(F.col("c_nationkey") > 5, "x").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.taxonomy_code(value).alias("code"), needed.alias("needed"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_custkey::VARCHAR END AS number, CASE WHEN c_custkey % 4 = 1 THEN 'North' ELSE '' END AS direction, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'Oak Hill' ELSE 'Elm' END AS street,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'St' WHEN 2 THEN 'Avenue' ELSE '' END AS type, CASE WHEN c_custkey % 4 = 2 THEN 'Suite 12B' WHEN c_custkey % 4 = 3 THEN '# 7' ELSE '' END AS unit, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR ELSE '' END AS box,
  CASE c_custkey % 4 WHEN 0 THEN 'Salem' WHEN 1 THEN 'New Town' WHEN 2 THEN 'Springfield' ELSE '' END AS city, CASE c_custkey % 4 WHEN 3 THEN '' WHEN 1 THEN 'IL' WHEN 2 THEN 'OH' ELSE 'OR' END AS state, CASE c_custkey % 4 WHEN 3 THEN '' WHEN 1 THEN '62704' WHEN 2 THEN '43215-1234' ELSE '97301' END AS zip,
  CASE WHEN c_custkey % 4 = 0 THEN 'Y' ELSE 'N' END AS po_box FROM customer""")
def q_address_parts(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("P.O. Box "), key, F.lit(", Salem, or 97301"))).when(F.col("c_custkey") % 4 == 1, F.concat(key, F.lit(" North  Oak Hill St., New Town, IL 62704")))
    line = line.when(F.col("c_custkey") % 4 == 2, F.concat(key, F.lit(" Elm Avenue Suite 12B, Springfield OH 43215-1234"))).otherwise(F.concat(key, F.lit(" Elm, # 7")))
    rows_ = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", tagging.address_parts(line).alias("a"), program.po_box(line).alias("po_box"))
    return rows_.select("c_custkey", "a.*", "po_box").drop("recipient", "post_direction")


# The pieces of address lines, dealt out by key: 3 x 4 x 4 x 3 x 4 x 4 forms (a number, direction, type and so on of each kind, with and without commas)
_PIECES = {
    "number": ["12", "4501B", "20010"], "direction": ["", "North", "SW", "E"], "type": ["Street", "Ave", "Blvd", "Ln"], "post_direction": ["", "NE", "South"],
    "unit": ["", "Suite 12B", "# 7", "Apt 210"], "city": ["Salem", "New Town", "St Paul", "Springfield"],
}
_STATES, _TITLED = ["OR", "il", "Ohio", "IN"], "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"


def _dealt_sql() -> str:
    by, out = 1, []
    for name, values in _PIECES.items():
        out.append("CASE c_custkey // %d %% %d %s END AS %s" % (by, len(values), " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)), name))
        by *= len(values)
    return ", ".join(out)


@query(f"""
WITH dealt AS (SELECT c_custkey, {_dealt_sql()}, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Building' ELSE {_TITLED} END AS street FROM customer)
SELECT c_custkey, number, direction, street || ' Oak' AS street, type, post_direction, unit, city, CASE c_custkey % 4 {" ".join(f"WHEN {i} THEN '{v.upper()}'" for i, v in enumerate(_STATES))} END AS state,
  (10000 + c_custkey % 80000)::VARCHAR AS zip, number || CASE WHEN direction = '' THEN '' ELSE ' ' || direction END || ' ' || street || ' Oak ' || type || CASE WHEN post_direction = '' THEN '' ELSE ' ' || post_direction END || ';' || unit || ';' || city || ';'
    || CASE c_custkey % 4 {" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_STATES))} END || ';' || (10000 + c_custkey % 80000)::VARCHAR AS cleansed FROM dealt""")
def q_address_tags(spark, sf_dir):
    """Lines of 2,304 forms, tagged by the sequence model; and the same from fields that hold each other's words."""
    by, dealt = 1, {}
    for name, values in _PIECES.items():
        dealt[name] = F.get(F.array(*map(F.lit, values)), (F.floor(F.col("c_custkey") / by) % len(values)).cast("int"))
        by *= len(values)
    street = F.concat(F.initcap("c_mktsegment"), F.lit(" Oak"))
    front = text.joined_words(dealt["number"], dealt["direction"], street, dealt["type"], dealt["post_direction"])
    state = F.get(F.array(*map(F.lit, _STATES)), (F.col("c_custkey") % 4).cast("int"))
    zip_code = (F.col("c_custkey") % 80_000 + 10_000).cast("string")
    comma = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(", ")
    line = F.concat(front, F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(","), dealt["unit"], comma, dealt["city"], F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(" , "), state, F.lit(" "), zip_code)
    none = F.lit(None).cast("string")
    cleansed = tagging.parsed_address(text.joined_words(front, dealt["unit"]), none, text.joined_words(dealt["city"], state), none, zip_code)
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", tagging.address_parts(line).alias("a"), cleansed.alias("cleansed")).select("c_custkey", *(f"a.{n}" for n in [*_PIECES, "street", "state", "zip"]), "cleansed")


@query("""
SELECT c_custkey, (c_custkey % 900 + 100)::VARCHAR AS extension, CASE WHEN c_custkey % 3 = 0 THEN 'Reject' ELSE NULL END AS severity, CASE WHEN c_custkey % 3 = 0 THEN 'bad' END AS message, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS input, c_custkey % 3 = 0 AS is_message,
  split_part(c_name, '#', 2) AS last, 'A' AS first, CASE WHEN c_nationkey > 12 THEN c_name ELSE 'Boss' END AS registered, CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'b' ELSE 'a' END AS taxonomy FROM customer""")
def q_records(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    said = F.when(key % 3 == 0, F.concat(F.lit("Reject: bad|Input: "), name)).otherwise(name)
    packed = F.to_json(F.array(F.struct(F.split(name, "#")[1].alias("last"), F.lit("A").alias("first"), F.lit("").alias("middle"))))
    none = F.lit(None).cast("string")
    basic = F.struct(name.alias("last_name"), none.alias("first_name"), none.alias("middle_name"), none.alias("credential"), *((F.lit("Boss") if n == "last_name" else none).alias(f"authorized_official_{n}") for n in ("last_name", "first_name", "middle_name", "credential")))
    registered = clean.registry_name(basic, F.when(F.col("c_nationkey") > 12, "NPI-1").otherwise("NPI-2"))
    tax = lambda code, primary: F.struct(F.lit(code).alias("code"), F.lit("").alias("desc"), F.lit(primary).alias("primary"))
    taxonomies = F.when(F.col("c_nationkey") % 3 == 0, F.array().cast("array<struct<code:string,desc:string,primary:boolean>>")).when(F.col("c_nationkey") % 3 == 1, F.array(tax("a", False), tax("b", True))).otherwise(F.array(tax("a", False), tax("c", False)))
    extension = text.phone_extension(F.concat(F.lit("555-1234 ext. "), (key % 900 + 100).cast("string")))
    out = table(spark, sf_dir, "customer").select(
        "c_custkey", extension.alias("extension"), parts(said).alias("m"), is_message(said).alias("is_message"), clean.packed_names(packed)[0].alias("n"),
        registered["last_name"].alias("registered"), clean.primary_taxonomy(taxonomies).alias("taxonomy"),
    )
    return out.select("c_custkey", "extension", "m.severity", "m.message", "m.input", "is_message", "n.last", "n.first", "registered", "taxonomy")


# (phrase, Monday, Friday, Saturday, days)
_PHRASES = [
    ("Mon-Fri 8:30 am to 5pm; Sun closed", "08:30AM-05:00PM", "08:30AM-05:00PM", "", 5), ("m-f 9-5", "09:00AM-05:00PM", "09:00AM-05:00PM", "", 5), ("Daily 7am-7pm", "07:00AM-07:00PM", "07:00AM-07:00PM", "07:00AM-07:00PM", 7),
    ("24/7", "12:00AM-11:59PM", "12:00AM-11:59PM", "12:00AM-11:59PM", 7), ("Weekdays 8 to 4; Sat 9-12", "08:00AM-04:00PM", "08:00AM-04:00PM", "09:00AM-12:00PM", 6), ("Mon, Wed & Fri 10:00a-2:30p", "10:00AM-02:30PM", "10:00AM-02:30PM", "", 3),
    ("sat-mon 24 hours", "12:00AM-11:59PM", "", "12:00AM-11:59PM", 3), ("by appointment", "", "", "", 0), ("th 8-5 f 8-12", "", "08:00AM-12:00PM", "", 2), ("Weekend 10-4pm; mon 0900-1730", "09:00AM-05:30PM", "", "10:00AM-04:00PM", 3),
]


@query(f"""
SELECT o_orderkey, mon, fri, sat, days AS n_days FROM orders JOIN (VALUES {", ".join(f"({i}, '{m}', '{f}', '{s}', {d})" for i, (_, m, f, s, d) in enumerate(_PHRASES))}) p(n, mon, fri, sat, days) ON n = o_orderkey % {len(_PHRASES)}""")
def q_work_hours(spark, sf_dir):
    phrase = F.get(F.array(*(F.lit(p[0]) for p in _PHRASES)), (F.col("o_orderkey") % len(_PHRASES)).cast("int"))
    found = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", hours.working_hours(phrase).alias("h"))
    of = lambda day: F.coalesce(F.concat(F.try_element_at("h", F.lit(day))["start"], F.lit("-"), F.try_element_at("h", F.lit(day))["end"]), F.lit("")).alias(day)
    return found.select("o_orderkey", *map(of, ("mon", "fri", "sat")), F.size("h").alias("n_days"))


@query("""
SELECT o_orderkey, lpad((o_orderkey % 4 + 7)::VARCHAR, 2, '0') || ':00AM-12:00PM' AS first, '01:00PM-0' || (o_orderkey % 3 + 3) || ':00PM' AS second FROM orders""")
def q_break_hours(spark, sf_dir):
    at = lambda n, half: F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit(f":00{half}"))
    whole = F.struct(at(F.col("o_orderkey") % 4 + 7, "AM").alias("start"), at(F.col("o_orderkey") % 3 + 3, "PM").alias("end"))
    split = table(spark, sf_dir, "orders").select("o_orderkey", hours.without_break(whole, "12:00PM", "01:00PM").alias("h"))
    of = lambda i, name: F.concat_ws("-", F.col("h")[i]["start"], F.col("h")[i]["end"]).alias(name)
    return split.select("o_orderkey", of(0, "first"), of(1, "second"))


# Files and streams


@query("""SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name || ', "x"' || chr(10) || 'y' END AS note FROM nation""")
def q_delimited_round_trip(spark, sf_dir):
    folder = ingest.work_folder(spark)
    note = F.when(F.col("n_nationkey") % 5 == 0, "n/a").otherwise(F.concat("n_name", F.lit(', "x"\ny')))
    tables.write_tables({"nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("N_NationKey"), note.alias("Note"))}, folder, "csv")
    return tables.read_delimited(spark, f"{folder}/nation").select("n_nationkey", "note")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment AS segment FROM customer")
def q_workbook_round_trip(spark, sf_dir):
    folder = ingest.work_folder(spark)
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("C_Name"), F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment", F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("book"))
    spreadsheet.write_workbooks(customers, f"{folder}/books", file="book", tab="c_mktsegment", order=["c_custkey"])
    cells = spreadsheet.store_cells(spark, f"{folder}/books", f"{folder}/cells")
    tabs = [r.tab for r in cells.select("tab").distinct().orderBy("tab").limit(16).collect()]
    return reduce(lambda a, b: a.unionByName(b), (spreadsheet.tab_frame(cells, t).select("c_custkey", "c_name", "c_acctbal", F.lit(t).alias("segment")) for t in tabs))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS record FROM nation""")
def q_json_records(spark, sf_dir):
    return tables.as_records(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@query("""SELECT 'orders' AS "table", count(*) AS n_lines, count(DISTINCT o_custkey) AS n_ids FROM orders UNION ALL SELECT 'customers', count(*), count(DISTINCT c_custkey) FROM customer""")
def q_counts_sheet(spark, sf_dir):
    return tables.counts_sheet({"orders": table(spark, sf_dir, "orders"), "customers": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")}, "o_custkey")


@query("SELECT user_id, arg_min(event_type, (ts, event_type)) AS event_type, arg_min(props, (ts, props)) AS props FROM events GROUP BY 1")
def q_stream_first_values(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.read_rows(spark, f"{sf_dir}/events.parque[t]", schema)
    return ingest.first_values(stream, ["user_id"], ["event_type", "props"], "ts").select("user_id", "event_type", "props")
