"""Records: keys, final ids, single values and their conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.errors import message
from rosterloom.functions.text import blank

#: Fixed value: the message of a single value that differs within a record.
CONFLICT = "Multiple values found, Picking up the first value"


def record_keys(frame: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys with their row counts."""
    return frame.groupBy(*key).agg(F.count("*").alias("n_rows"))


def final_id(frame: DataFrame, individual: str, group: str) -> DataFrame:
    """FINAL_NPI and NPI_TYPE_IND: the individual id (I), else the group id (G), else blank (rejected)."""
    own, other = F.col(individual).cast("string"), F.col(group).cast("string")
    return frame.withColumns({
        "FINAL_NPI": F.when(~blank(own), own).when(~blank(other), other).otherwise(""),
        "NPI_TYPE_IND": F.when(~blank(own), "I").when(~blank(other), "G").otherwise("rejected"),
    })


def single_values(frame: DataFrame, key: list[str], values: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first value of every column by ``order``, and a message where values differ.

    One aggregation with partial sums: the first value is the minimum of (order, value), and
    values differ when their minimum and maximum do, so no set of values is held.
    """
    picked = []
    for c in values:
        first = F.min(F.struct(*order, F.col(c).alias("value")))["value"]
        differ = F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
        picked += [first.alias(c), F.when(differ, message("C", CONFLICT, first)).otherwise(F.lit("")).alias(f"{c}_message")]
    return frame.groupBy(*key).agg(*picked)
