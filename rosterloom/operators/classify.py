"""Action labels of request texts, and the labels learned from users' choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def action_class(text: Column, bases: dict[str, list[str]], objects: dict[str, list[str]], special: dict[str, str] | None = None) -> Column:
    """``BASE OBJECT`` of the first base verb and the first object found as words, a special phrase before both, else OTHER."""
    low = F.lower(text)
    found = lambda table: F.coalesce(*(F.when(low.rlike(rf"(?<![a-z0-9])({'|'.join(names)})(?![a-z0-9])"), F.lit(key)) for key, names in table.items()))
    base, thing = found(bases), found(objects)
    out = F.when(base.isNotNull() & thing.isNotNull(), F.concat(base, F.lit(" "), thing)).when(base.isNotNull(), base).otherwise("OTHER")
    for phrase, label in reversed((special or {}).items()):
        out = F.when(low.contains(phrase), label).otherwise(out)
    return out


def learned_labels(choices: DataFrame, key: str, label: str, time: str) -> DataFrame:
    """The label chosen most often for each key; of equals the latest, then the first in order."""
    votes = choices.groupBy(key, label).agg(F.count("*").alias("n_votes"), F.max(time).alias("latest"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_votes"), F.desc("latest"), label))
    return votes.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def key_hashes(frame: DataFrame, group: list[str], column: str) -> DataFrame:
    """md5 of a group's sorted distinct values: equal groups have equal hashes."""
    joined = F.array_join(F.sort_array(F.collect_set(F.col(column).cast("string"))), "|")
    return frame.groupBy(*group).agg(F.md5(joined.cast("binary")).alias("key_hash"), F.countDistinct(column).alias("n_values"))


def run_log(logs: DataFrame, outputs: DataFrame, token: str, amount: str) -> DataFrame:
    """Logs joined to outputs by token, with the token's total beside every row."""
    joined = logs.join(outputs, token)
    return joined.withColumn("token_total", F.sum(amount).over(Window.partitionBy(token)))
