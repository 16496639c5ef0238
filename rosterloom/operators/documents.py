"""Forms as words with boxes: lines, records, anchored regions, columns of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(frame: DataFrame, key: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Number the runs of rows that begin where ``starts`` holds."""
    along = Window.partitionBy(*key).orderBy(*order)
    return frame.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def text_lines(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines of a page: words whose tops lie within ``tolerance`` of the word before, from top to bottom."""
    key, order = ["doc_id", "page"], ["y0", "x0"]
    along = Window.partitionBy(*key).orderBy(*order)
    lined = _islands(words, key, order, F.col("y0") - F.lag("y0").over(along) > tolerance, "line_no")
    return lined.groupBy(*key, "line_no").agg(
        F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word"))), lambda w: w["word"]), " ").alias("text"),
    )


def records_by_marker(rows: DataFrame, key: list[str], order: list[str], marker: Column) -> DataFrame:
    """A record begins at every row with the marker; rows before the first one are record 0."""
    return _islands(rows, key, order, F.coalesce(marker, F.lit(False)), "record_no")


def records_by_change(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """A record begins where a value changes."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return _islands(rows, key, order, ~F.col(value).eqNullSafe(before) | before.isNull(), "record_no")


def records_by_gap(rows: DataFrame, key: list[str], order: str, seconds: float) -> DataFrame:
    """A record begins after a pause of more than ``seconds``."""
    before = F.lag(order).over(Window.partitionBy(*key).orderBy(order))
    pause = F.col(order).cast("timestamp").cast("double") - before.cast("timestamp").cast("double")
    return _islands(rows, key, [order], before.isNull() | (pause > seconds), "record_no")


def anchors(words: DataFrame, text: str, occurrence: int = 1) -> DataFrame:
    """The box of the ``occurrence``-th place (-1: the last) of one word on each page."""
    found = words.filter(F.lower("word") == text.lower())
    forward = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*((F.desc("y0"), F.desc("x0")) if occurrence < 0 else ("y0", "x0"))))
    return found.withColumn("_n", forward).filter(F.col("_n") == abs(occurrence)).select("doc_id", "page", *(F.col(c).alias(f"anchor_{c}") for c in ("x0", "y0", "x1", "y1")))


def region_text(words: DataFrame, regions: DataFrame) -> DataFrame:
    """The words inside each region (doc_id, page, name, min_x, min_y, max_x, max_y), in reading order."""
    inside = (F.col("x0") >= F.col("min_x")) & (F.col("x1") <= F.col("max_x")) & (F.col("y0") >= F.col("min_y")) & (F.col("y1") <= F.col("max_y"))
    hits = words.join(regions, ["doc_id", "page"]).filter(inside)
    read = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "word"))), lambda w: w["word"])
    return hits.groupBy("doc_id", "page", "name").agg(F.array_join(read, " ").alias("text"))


def table_columns(words: DataFrame, gap: float = 10.0) -> DataFrame:
    """Column numbers of table words: on a page, a column begins right of a gap that no word crosses."""
    along = Window.partitionBy("doc_id", "page").orderBy("x0", "y0")
    reach = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return _islands(words, ["doc_id", "page"], ["x0", "y0"], reach.isNull() | (F.col("x0") - reach > gap), "column_no")


def merge_delimited(rows: DataFrame, key: list[str], order: list[str], column: str, delimiter: str = ",") -> DataFrame:
    """Join a row to the next while it ends in the delimiter."""
    before = F.lag(F.rtrim(F.col(column)).endswith(delimiter)).over(Window.partitionBy(*key).orderBy(*order))
    runs = _islands(rows, key, order, before.isNull() | ~before, "run_no")
    text = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("_text")))), lambda r: r["_text"])
    return runs.groupBy(*key, "run_no").agg(F.array_join(text, " ").alias(column))
