"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many narrow rows (a number or two each) are broadcast.
BROADCAST_ROWS = 1_000_000


#: Items of an array that are scanned before what they gave is put away.
RUN = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without the setting (a local test) gets a folder of its own.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="rosterloom-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def open_folder(uri: str):
    """File system and path of a folder that Spark names by a URI or a plain path."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later steps read it and lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, as Parquet: for wide tables of which later steps read some columns only."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows, so that equal or null doc_ids stay apart through shuffles."""
    return df.withColumn(name, F.monotonically_increasing_id())


def aliased(documents: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``documents`` with columns that no operator uses under names that can't clash, and what gives them back."""
    names, known = documents.columns, {"doc_id", "text", "lang", "source"}
    safe = [c if c in known else f"column{i}" for i, c in enumerate(names)]
    return documents.toDF(*safe), lambda df: df.select(*safe).toDF(*names)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores after it as make it differ from all of ``taken``."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, marked for broadcast if there are at most ``most`` of them; beyond that Spark joins by shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def perhaps(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``perhaps``: false where column ``name`` is surely none of ``ids``'.

    What is broadcast is a bitmap of at most ``BROADCAST_ROWS`` cells of 64 bits, whatever the number of ids.
    """
    cell = F.pmod(F.shiftright(F.xxhash64(name), 6), F.lit(BROADCAST_ROWS)).alias("_cell")
    bit = f"shiftleft(1L, CAST(xxhash64(`{name}`) & 63 AS INT))"
    cells = stored(ids.select(cell, F.expr(bit).alias("_bit")).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits")))
    joined = rows.select("*", cell).join(F.broadcast(cells), "_cell", "left")
    return joined.select(*rows.columns, F.expr(f"coalesce(_bits & {bit} != 0, false)").alias("perhaps"))


def among(rows: DataFrame, ids: DataFrame, name: str, inside: bool = True) -> DataFrame:
    """The ``rows`` whose column ``name``, which is not null, is one of ``ids``' (distinct); or, not ``inside``, the other ones.

    Where the ids are too many to be broadcast, only rows that are perhaps among them are dealt out.
    """
    how = "left_semi" if inside else "left_anti"
    if ids.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), name, how)
    marked = perhaps(rows, ids, name)
    found = marked.filter("perhaps").join(ids, name, how)
    return (found if inside else marked.filter("NOT perhaps").unionByName(found)).select(*rows.columns)


def without_rows(documents: DataFrame, rejected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``documents`` without the rows whose ``_row`` ``rejected(numbered documents)`` returns.

    The numbered rows are written once, so that both readings see the same numbers.
    """
    safe, restored = aliased(documents)
    numbered = stored(with_row_id(safe))
    return restored(numbered.join(few(cut(rejected(numbered).select("_row"))), "_row", "left_anti"))


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5, is 0: such rows are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, state: Column, after, out, kind: str) -> Column:
    """``out(state, item)`` (of SQL type ``kind``) of every item of an array, where ``after(state, item)`` is the state for the next one.

    An append copies its array. Appending to arrays of ``RUN`` items, and these to one array,
    keeps the time near linear.
    """
    def run(state, part):
        none = F.array().cast(f"array<{kind}>")
        step = lambda a, x: F.struct(after(a["state"], x).alias("state"), F.array_append(a["out"], out(a["state"], x)).alias("out"))
        return F.aggregate(part, F.struct(state.alias("state"), none.alias("out")), step)

    def runs(a, part):
        return let(run(a["state"], part), lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).alias("out")))

    none = F.array().cast(f"array<array<{kind}>>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda c: F.slice(items, c * RUN + 1, F.lit(RUN)))
    whole = F.aggregate(parts, F.struct(state.alias("state"), none.alias("out")), runs)
    return F.when(F.size(items) == 0, F.array().cast(f"array<{kind}>")).otherwise(F.flatten(whole["out"]))
