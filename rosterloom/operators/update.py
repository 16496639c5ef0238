"""Updates, indicators and duplicates within records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.errors import message
from rosterloom.functions.text import blank


def conditional_update(frame: DataFrame, column: str, cases: list[tuple[Column | str, Column]]) -> DataFrame:
    """The first case whose predicate holds sets the column; else it stays."""
    out = F.col(column)
    for predicate, value in reversed(cases):
        out = F.when(F.expr(predicate) if isinstance(predicate, str) else predicate, value).otherwise(out)
    return frame.withColumn(column, out)


def first_of_group(frame: DataFrame, key: list[str], order: list[str], name: str, yes: str = "P", no: str = "S") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return frame.withColumn(name, F.when(rank == 1, yes).otherwise(no))


def fill_group(frame: DataFrame, column: str, key: list[str], order: list[str], from_first: bool = True) -> DataFrame:
    """A blank takes the first (or last) non-blank value of its group."""
    full = F.when(~blank(F.col(column)), F.col(column))
    along = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = (F.first if from_first else F.last)(full, ignorenulls=True).over(along)
    return frame.withColumn(column, F.coalesce(full, donor, F.lit("")))


def forward_fill(frame: DataFrame, column: str, key: list[str], order: list[str]) -> DataFrame:
    along = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn(column, F.last(F.when(~blank(F.col(column)), F.col(column)), ignorenulls=True).over(along))


def clarify_duplicates(frame: DataFrame, key: list[str], value: str, text: str = "More than one value") -> DataFrame:
    """Keys with more than one distinct value, and a message that names the smallest."""
    found = frame.groupBy(*key).agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("low")).filter("n_values > 1")
    return found.select(*key, "n_values", message("C", text, F.col("low").cast("string")).alias("message"))


def best_of_group(frame: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return frame.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def exactly_one_of(frame: DataFrame, key: list[str], flag: Column) -> DataFrame:
    """none, one or many rows of a key with the flag."""
    n = F.count(F.when(flag, 1))
    return frame.groupBy(*key).agg(n.alias("n_flagged"), F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("state"))


def located_in(frame: DataFrame, key: list[str], place: str) -> DataFrame:
    """The distinct places of a key, sorted and comma-joined."""
    return frame.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(place)), ", ").alias("places"))


def duplicates_within(frame: DataFrame, key: list[str], order: list[str], name: str = "DELETE_FLAG") -> DataFrame:
    """Mark every row that repeats an earlier one of the same key (a self join on unequal rows, as a window)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return frame.withColumn(name, F.when(rank > 1, "Y").otherwise("N"))
