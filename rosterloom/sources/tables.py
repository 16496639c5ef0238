"""Delimited text, Parquet and JSON: rosters in, output tables out."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.operators.templates import reconcile
from rosterloom.schema import MISSING, clean_headers
from rosterloom.sources.spreadsheet import workbook, write_workbooks


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text under clean headers, missing tokens as null; nothing is inferred.

    A quoted cell may hold line ends, so a file is one task; quotes inside are doubled or escaped.
    """
    frame = spark.read.csv(path, header=True, sep=separator, inferSchema=False, multiLine=True)
    frame = frame.toDF(*clean_headers(frame.columns))
    return frame.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in frame.columns))


def snapshot(frame: DataFrame, rows: int = 100) -> list[dict]:
    """The first rows for a preview."""
    return [r.asDict() for r in frame.limit(rows).collect()]


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each output table under its own name, by the executors; kinds are csv, workbook and Spark's own."""
    for name, frame in tables.items():
        if kind == "workbook":
            write_workbooks(frame, f"{folder}/{name}")
            continue
        writer = frame.write.mode("overwrite")
        target = f"{folder}/{name}"
        writer.option("header", True).csv(target) if kind == "csv" else writer.format(kind).save(target)


def as_records(frame: DataFrame) -> DataFrame:
    """One JSON text for each row, in the column order."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def as_document(frame: DataFrame, rows: int = 10_000) -> str:
    """A small table as ``{colSet, dataSet, order}``; more than ``rows`` rows are refused."""
    found = frame.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError("too many rows for one document; use as_records")
    return json.dumps({"colSet": frame.columns, "dataSet": [list(map(lambda v: None if v is None else str(v), r)) for r in found], "order": list(range(len(frame.columns)))})


def counts_sheet(tables: dict[str, DataFrame], id_column: str) -> DataFrame:
    """Lines and distinct ids of every output table."""
    parts = [f.agg(F.count("*").alias("n_lines"), F.countDistinct(id_column).alias("n_ids")).select(F.lit(n).alias("table"), "n_lines", "n_ids") for n, f in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_sheets(outputs: dict[str, DataFrame], inputs: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """The sheets of a run's report: every output table, their counts, their columns, and what became of each input key."""
    spark = inputs.sparkSession
    columns = [(name, i, c) for name, frame in outputs.items() for i, c in enumerate(frame.columns)]
    meta = spark.createDataFrame(columns, "table string, place int, column string")
    return {**outputs, "CONSOLIDATED": counts_sheet(outputs, key[0]), "META": meta, "RECONCILIATION": reconcile(inputs, outputs, key)}


def zipped_workbooks(tables: dict[str, DataFrame]) -> bytes:
    """A ZIP with a workbook for each small table."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
        for name, frame in tables.items():
            bundle.writestr(f"{name}.xlsx", workbook({name: frame}))
    return out.getvalue()
