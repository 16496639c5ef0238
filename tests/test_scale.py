"""What keeps the work of queries in proportion to their tables."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

import rosterloom.rule_queries  # noqa: F401
from rosterloom import form_queries
from rosterloom.operators import forms, lookup
from rosterloom.plans import program
from rosterloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_grid_rows_that_look_alike_are_scored_once(spark, monkeypatch):
    grid = spark.range(1, 301).select(F.col("id").alias("grid_no"), F.concat(F.lit("red rng lot"), F.col("id").cast("string")).alias("name"))
    asked = spark.createDataFrame([("red ring",), ("red",), ("blue",), (None,)], "v string")
    scores, seen = lookup._scored(asked.select(F.col("v").alias("_asked"), F.col("v").alias("_text")), grid, "name", 1, False, False, 0.0, False)
    assert sorted((r._asked, r.score) for r in scores.collect()) == [("red", 1.0), ("red ring", 2.0)] and seen.count() == 300
    found = []
    for named in (lookup.NAMED, 0):
        monkeypatch.setattr(lookup, "NAMED", named)
        found.append(sorted((str(r.v), r.grid_no, r.score) for r in lookup.lookup_fuzzy(asked, "v", grid, "name").collect()))
    assert found[0] == found[1] == [("None", None, None), ("blue", None, None), ("red", 1, 1.0), ("red ring", 1, 2.0)]


def test_words_meet_only_within_one_edit(spark):
    cut = lambda n: {"".join(t) for t in itertools.product("ab0", repeat=n)}
    rows = spark.createDataFrame([(w,) for w in sorted(cut(1) | cut(2) | cut(3) | {"abc0", "acb0", "bacb"})], "w string")
    side = lambda own: rows.select(F.col("w").alias("q" if own else "g"), F.explode(lookup.near_keys(F.col("w"), 1, own)).alias("k"))
    met = {tuple(r) for r in side(True).join(side(False), "k").select("q", "g").distinct().collect()}
    near = rows.select(F.col("w").alias("q")).crossJoin(rows.select(F.col("w").alias("g"))).filter(F.levenshtein("q", "g") <= 1)
    assert met == {tuple(r) for r in near.collect()}


def test_no_lookup_table_is_broadcast_by_its_estimated_size(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("grid_no"), F.concat(F.lit("customer "), F.col("id").cast("string")).alias("name")).write.parquet(str(tmp_path / "grid"))
    grid = spark.read.parquet(str(tmp_path / "grid"))
    asked = grid.select(F.col("name").alias("_asked"), F.col("name").alias("_text"))
    for every in (True, False):
        plan = lookup.scored_pairs(asked, grid, "name", every=every)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan


def test_tables_that_share_keys_are_not_sorted(spark):
    frames = {n: spark.createDataFrame([(k, n) for k in keys], "k int, v string") for n, keys in {"a": [1, 1, 2, None, 4], "b": [2, 1, None, 3], "c": [2, 5, 1]}.items()}
    found = program.move_common(frames, ["a", "b", "c"], "all", ["k"])
    assert {n: sorted((r.k or 0, r.v) for r in f.collect()) for n, f in found.items()} == {"a": [(0, "a"), (4, "a")], "b": [(0, "b"), (3, "b")], "c": [(5, "c")], "all": [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")]}
    for frame in found.values():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortKey", "") and "BroadcastExchange" not in plan


def test_characters_are_dealt_out_once(spark):
    """One exchange of the characters and two of their heights, however many windows follow."""
    chars = spark.range(60).selectExpr("id % 3 AS doc_id", "id % 2 + 1 AS page", "id AS seq", "(id % 20) * 6.0D AS x0", "(id % 2) * 20.0D AS y0", "(id % 20) * 6.0D + 5 AS x1", "(id % 2) * 20.0D + 9 AS y1", "'a' AS char", "'r' AS font", "9 AS size")
    found = forms.laid_out(forms.words_from_boxes(chars))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert found.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_only_html_is_dealt_out_for_words_from_boxes(spark):
    """Characters and words stay where their page's html is, and are computed once."""
    plan = QUERIES["q_words_from_boxes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_more_pages_are_in_more_parts(spark, monkeypatch):
    monkeypatch.setattr(form_queries, "PAGES", 1)
    assert form_queries.form_words(spark, DATA).rdd.getNumPartitions() == spark.read.parquet(f"{DATA}/pages.parquet").count() > form_queries.PARTS * spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["q_address_tags", "q_address_parts", "q_work_hours", "q_table_cells"])
def test_a_short_file_is_not_one_task(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
