"""The end-to-end run: raw rows to validated output tables of every transaction type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import dates
from rosterloom.operators import keys, reshape, templates
from rosterloom.plans.program import drop_blank_rows, run_program
from rosterloom.schema import MISSING, RECORD_KEY, repeated


def normalised(raw: DataFrame) -> DataFrame:
    """All cells as text; missing tokens and null become blank, and rows without any value go."""
    text = raw.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns))
    cells = {c: F.when(F.col(f"`{c}`").isin(*MISSING) | F.col(f"`{c}`").isNull(), "").otherwise(F.trim(f"`{c}`")) for c in raw.columns}
    return drop_blank_rows(text.withColumns(cells))


def canonical(raw: DataFrame, mapping: dict[str, str], actions: dict[str, str] | None = None) -> DataFrame:
    """Mapped columns under their canonical names, with ids, row numbers and the validated action.

    ``mapping`` is header to canonical name. Row numbers keep the order of the file within a
    partition; they order first values and are not consecutive.
    """
    frame = normalised(raw.select(*(F.col(f"`{h}`").alias(c) for h, c in mapping.items())))
    for column in ("INDIVIDUAL_NPI", "GROUP_NPI", "TAX_ID", "NAME_FIRST", "NAME_LAST", "ACTION"):
        if column not in frame.columns:
            frame = frame.withColumn(column, F.lit(""))
    frame = keys.final_id(frame.withColumn("TAX_ID", F.regexp_replace("TAX_ID", "[^0-9]", "")), "INDIVIDUAL_NPI", "GROUP_NPI")
    action = F.upper("ACTION")
    for label, template in (actions or {}).items():
        action = F.when(F.upper("ACTION") == label.upper(), template).otherwise(action)
    return frame.withColumn("VALIDATED_ACTION", F.when(action == "", "DEMO OTHER").otherwise(action)).withColumn("row_ix", F.monotonically_increasing_id())


def split_frames(frame: DataFrame, categories: dict[str, list[str]]) -> dict[str, DataFrame]:
    """``singleValue`` (one row for each record) and a long frame for each category of repeated fields.

    Every frame is keyed by the record; a category whose record has no rows gets one blank row.
    """
    refs = repeated(frame)
    single = [c for c in frame.columns if c not in refs and c not in (*RECORD_KEY, "row_ix")]
    out = {"singleValue": keys.single_values(frame, RECORD_KEY, single, ["row_ix"])}
    for name, fields in categories.items():
        own = {c: r for c, r in refs.items() if r.field in fields}
        if own:
            long = reshape.unpivot(frame.select(*RECORD_KEY, *own), RECORD_KEY, own).distinct()
            base = out["singleValue"].select(*RECORD_KEY)
            out[name] = reshape.numbered(base.join(long, RECORD_KEY, "left"), RECORD_KEY, ["set_no", "tag"])
    return out


def run(raw: DataFrame, mapping: dict[str, str], categories: dict[str, list[str]], programs: dict[str, list[dict]], schemas: dict[str, list[dict]], join: dict[str, str], actions: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The output table of every transaction type in ``programs``.

    ``join`` names the category frame whose rows a type's output has, next to the single
    values of the record. The plan of a type reads its own rows only; nothing is collected.
    """
    frame = canonical(raw, mapping, actions)
    tables = {}
    for kind, layers in programs.items():
        frames = run_program(layers, split_frames(frame.filter(F.col("VALIDATED_ACTION") == kind), categories), kind)
        out = frames["singleValue"]
        if join.get(kind) in frames:
            out = templates.prepend_base(out, frames[join[kind]], RECORD_KEY, ["ROW_NUM"])
        tables[kind] = templates.project(out, schemas[kind])
    return tables


def roster_run(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """A small whole run: single values of a record with conflicts in band, its first date, its base columns, the output projection."""
    single = keys.single_values(orders, ["o_custkey"], ["o_orderpriority"], ["o_orderkey"])
    dated = orders.groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), dates.OUTPUT).alias("first"), F.count("*").alias("n"))
    names = customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    joined = single.join(dated, "o_custkey").join(names, "o_custkey", "left")
    joined = joined.withColumn("priority", F.when(F.col("o_orderpriority_message") != "", F.col("o_orderpriority_message")).otherwise(F.col("o_orderpriority")))
    return templates.project(joined, [
        {"outputColName": "Key", "dfColName": "o_custkey", "dataType": "text"}, {"outputColName": "Name", "dfColName": "c_name"}, {"outputColName": "Priority", "dfColName": "priority"},
        {"outputColName": "First", "dfColName": "first"}, {"outputColName": "Rows", "dfColName": "n", "dataType": "numeric", "format": "0000"},
    ])
