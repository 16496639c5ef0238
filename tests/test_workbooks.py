"""Workbooks: round trips through the executors, headers of many files, headers above numbers."""

import pytest
from pyspark.sql import functions as F

from rosterloom.schema import clean_headers
from rosterloom.sources import spreadsheet


def test_round_trip_of_many_files(spark, tmp_path):
    """50 files of different headers, written by the executors, are one table again; cells are parsed once."""
    rows = [(f"file {f:02d}", "data" if r % 4 else "notes", r, f"k{f}-{r}", None if r % 5 == 0 else f"a&<b> {r}\né\x01") for f in range(50) for r in range(12)]
    frame = spark.createDataFrame(rows, "file string, tab string, r int, key string, value string").repartition(7)
    for part in range(5):
        mine = frame.filter(F.pmod(F.substring("file", 6, 2).cast("int"), F.lit(5)) == part).withColumnRenamed("value", f"value {part}")
        spreadsheet.write_workbooks(mine, str(tmp_path / "books"), file="file", tab="tab", order=["r"])
    assert len(list((tmp_path / "books").glob("*.xlsx"))) == 50 and not list((tmp_path / "books").glob("_temporary*"))
    cells = spreadsheet.store_cells(spark, str(tmp_path / "books"), str(tmp_path / "cells"))
    table = spreadsheet.tab_frame(cells, "data", with_file=True)
    assert table.columns[:4] == ["file", "row_ix", "r", "key"] and sorted(table.columns[4:]) == [f"value {i}" for i in range(5)]
    got = {r.key: (r.file[-12:-5], int(r.r), [r[f"value {i}"] for i in range(5)]) for r in table.collect()}
    want = {}
    for file, tab, r, key, value in rows:
        if tab == "data":
            values = [None] * 5
            values[int(file[-2:]) % 5] = None if value is None else value.replace("\x01", "")
            want[key] = (file.replace(" ", "_"), r, values)
    assert got == want
    last = {r.file: r.row_ix for r in table.groupBy("file").agg(F.max("row_ix").alias("row_ix")).collect()}
    assert set(last.values()) == {9}


def test_full_sheets_and_partitions(spark, tmp_path):
    spreadsheet.write_workbooks(spark.range(25).repartition(2), str(tmp_path / "out"), order=["id"], sheet_rows=6)
    cells = spreadsheet.read_cells(spark, str(tmp_path / "out"))
    assert cells.filter("row_ix > 0").count() == 25 and {r.tab for r in cells.select("tab").distinct().collect()} >= {"Sheet1", "Sheet1 (2)", "Sheet1 (3)"}
    assert cells.filter("row_ix > 5").count() == 0


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    broken = spark.range(10).repartition(2).withColumn("id", F.expr("CASE WHEN id = 7 THEN raise_error('no') ELSE id END"))
    with pytest.raises(Exception, match="no"):
        spreadsheet.write_workbooks(broken, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.xlsx"))


def frame_of(spark, *tabs):
    rows = [(f"f{i}", "t", r, list(map(lambda c: None if c == "" else c, row))) for i, tab in enumerate(tabs) for r, row in enumerate(tab)]
    return spark.createDataFrame(rows, "file string, tab string, row_ix long, cells array<string>")


def test_headers_above_numbers(spark):
    titled = [["Report", "", ""], ["Name", "Id", "Zip"], ["a", "1", "60601"], ["b", "2", ""]]
    short_head = [["x y", "", ""], ["Name", "Id", ""], ["a", "1", "60601"]]
    numbers_first = [["1", "2", "3"], ["4", "5", ""]]
    words_only = [["Name", "Id"], ["a", "b"], ["", ""], ["c", ""], ["", ""]]
    named_by_year = [["Total", "2019", "2020"], ["Name", "Id", "Zip"], ["a", "1", "2"]]
    found = {r.file: (r.header_ix, r.header, r.last_ix, r.width, r.first_data_ix) for r in spreadsheet.header_rows(frame_of(spark, titled, short_head, numbers_first, words_only, named_by_year)).collect()}
    assert found["f0"] == (1, ["name", "id", "zip"], 3, 3, 2)
    assert found["f1"] == (1, ["name", "id", "empty_column"], 2, 3, 2)
    assert found["f2"] == (-1, ["col0", "col1", "col2"], 1, 3, 0)
    assert found["f3"] == (0, ["name", "id"], 3, 2, 1)
    assert found["f4"] == (-1, ["col0", "col1", "col2"], 2, 3, 0)
    table = spreadsheet.tab_frame(frame_of(spark, titled, short_head, words_only), "t", with_file=True)
    assert table.columns == ["file", "row_ix", "name", "id", "empty_column", "zip"] and table.count() == 6
    assert spreadsheet.tab_frame(frame_of(spark, titled).limit(0), "t").columns == ["row_ix"]


def test_clean_names_are_those_of_the_plan(spark):
    headers = ["A\nb", "", None, "A b", " x ", "X", "a \n b"]
    got = spark.createDataFrame([(headers,)], "h array<string>").select(spreadsheet.clean_names(F.col("h")).alias("r")).first().r
    assert got == clean_headers(headers)
