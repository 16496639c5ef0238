"""Wide to long and back: repeated columns, delimited cells, nested groups and default rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.functions.text import blank
from rosterloom.schema import ColumnRef, repeated


def unpivot(frame: DataFrame, ids: list[str], refs: dict[str, ColumnRef] | None = None, drop_blank: bool = True) -> DataFrame:
    """One row for each repeated set of a wide row: tag, set_no and a column for each field.

    Nested groups of a field become an array of structs (group, value). All sets of a row are
    built as one array of structs and exploded, so nothing is shuffled.
    """
    refs = repeated(frame) if refs is None else refs
    fields = sorted({r.field for r in refs.values()})
    nested = {r.field for r in refs.values() if r.group is not None}
    sets = sorted({(r.set, r.tag) for r in refs.values()})

    def value(tag: str, number: int, field: str) -> Column:
        own = sorted(((r.group or 0), c) for c, r in refs.items() if (r.tag, r.set, r.field) == (tag, number, field))
        if field not in nested:
            return F.col(f"`{own[0][1]}`").cast("string") if own else F.lit(None).cast("string")
        groups = F.array(*(F.struct(F.lit(g).alias("group"), F.col(f"`{c}`").cast("string").alias("value")) for g, c in own)).cast("array<struct<group:int,value:string>>")
        return F.filter(groups, lambda g: ~blank(g["value"]))

    rows = [F.struct(F.lit(tag).alias("tag"), F.lit(number).alias("set_no"), *(value(tag, number, f).alias(f) for f in fields)) for number, tag in sets]
    long = frame.select(*ids, F.explode(F.array(*rows)).alias("_set")).select(*ids, "_set.*")
    if drop_blank:
        full = F.lit(False)
        for f in fields:
            full |= (F.size(f) > 0) if f in nested else ~blank(F.col(f))
        long = long.filter(full)
    return long


def split_rows(frame: DataFrame, column: str, delimiters: str = ",;&") -> DataFrame:
    """A row for each part of a delimited cell, with its place from 0; a blank cell keeps one row."""
    parts = F.filter(F.transform(F.split(F.col(column), f"[{delimiters}]"), lambda t: F.trim(t)), lambda t: t != "")
    return frame.select("*", F.posexplode_outer(parts).alias("part_no", "part")).withColumn("part", F.coalesce("part", F.lit("")))


def zip_fill(frame: DataFrame, columns: list[str], repeat_last: bool = True) -> DataFrame:
    """Explode several array columns side by side; a shorter one repeats its last element, or is null."""
    longest = F.greatest(*(F.size(c) for c in columns), F.lit(1))
    at = F.explode(F.sequence(F.lit(1), longest)).alias("_at")
    out = frame.select("*", at)
    for c in columns:
        place = F.least(F.col("_at"), F.size(c)) if repeat_last else F.col("_at")
        out = out.withColumn(f"{c}_item", F.when((F.size(c) > 0) & (place <= F.size(c)), F.get(c, place - 1)))
    return out.withColumnRenamed("_at", "row_no")


def zip_frames(left: DataFrame, right: DataFrame, key: list[str], order: tuple[str, str]) -> DataFrame:
    """Rows of two frames of a record side by side by rank; where one ends, its last row repeats. A record of one frame has nulls for the other."""
    ranked = []
    for frame, by in zip((left, right), order):
        along = Window.partitionBy(*key)
        ranked.append(frame.withColumn("_n", F.row_number().over(along.orderBy(by))).withColumn("_size", F.count("*").over(along)))
    a = ranked[0].withColumnRenamed("_size", "_size_a").withColumnRenamed("_n", "_n_a")
    b = ranked[1].withColumnRenamed("_size", "_size_b").withColumnRenamed("_n", "_n_b")
    sizes = a.select(*key, "_size_a").distinct().join(b.select(*key, "_size_b").distinct(), key, "full")
    rows = sizes.select("*", F.explode(F.sequence(F.lit(1), F.greatest("_size_a", "_size_b").cast("int"))).alias("row_no"))
    rows = rows.withColumns({"_n_a": F.least("row_no", "_size_a").cast("int"), "_n_b": F.least("row_no", "_size_b").cast("int")}).drop("_size_a", "_size_b")
    # least() passes over the null size of a frame without rows; no row has the rank that it then gives.
    return rows.join(a.drop("_size_a"), [*key, "_n_a"], "left").join(b.drop("_size_b"), [*key, "_n_b"], "left").drop("_n_a", "_n_b")


def default_row(base: DataFrame, rows: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """``rows`` of every key of ``base``; a key without any gets one row of ``defaults``."""
    out = base.select(*key).distinct().join(rows, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def numbered(frame: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """ROW_NUM from 0 and ROW_COUNT within a key."""
    along = Window.partitionBy(*key)
    return frame.withColumns({"ROW_NUM": F.row_number().over(along.orderBy(*order)) - 1, "ROW_COUNT": F.count("*").over(along)})


def collect_rows(frame: DataFrame, key: list[str], columns: list[str], name: str) -> DataFrame:
    """The rows of a key as one sorted array of structs."""
    return frame.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def compact_slots(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Move the non-blank values of numbered slots to the front, in order."""
    full = F.filter(F.array(*columns), lambda v: ~blank(v))
    kept = frame.withColumn("_full", full)
    return kept.withColumns({c: F.coalesce(F.get("_full", F.lit(i)), F.lit("")) for i, c in enumerate(columns)}).drop("_full")
