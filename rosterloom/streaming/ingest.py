"""Rosters and run logs as streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a machine-local one only where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_rows(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(rows: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of a key in tumbling windows; rows later than the watermark are dropped."""
    stamped = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    counts = stamped.groupBy(F.window("_time", size), key).agg(F.count("*").alias("n_rows"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n_rows")


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drain what is there, and return the sink's rows; the last batch of a complete result replaces the ones before."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def first_values(stream: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """The first value of every key, by ``order`` and then the value, drained as a table.

    Spark keeps one row of state for each key and adds what a batch brings to it, whatever the
    order of the batches; nothing that is there is read again.
    """
    folded = stream.groupBy(*key).agg(*(F.min(F.struct(order, F.col(c).alias("value"))).alias(c) for c in values))
    return run_once(folded.select(*key, *(F.col(c)["value"].alias(c) for c in values)))
