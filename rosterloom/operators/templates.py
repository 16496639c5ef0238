"""Operators between the output tables of transaction types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.operators.update import first_of_group


def shared_keys(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """The keys that every frame has, to be joined by hash: each is there once, so that the other side's rows are neither sorted nor held, however many a key has."""
    marked = (f.select(*key, F.lit(i).alias("_frame")) for i, f in enumerate(frames))
    flags = [F.bool_or(F.col("_frame") == i).alias(f"_in{i}") for i in range(len(frames))]
    every = reduce(lambda a, b: a & b, (F.col(f"_in{i}") for i in range(len(frames))))
    return reduce(lambda a, b: a.unionAll(b), marked).groupBy(*key).agg(*flags).filter(every).select(*key).hint("shuffle_hash")


def across(frames: dict[str, DataFrame], key: list[str], column: str) -> DataFrame:
    """Keys in all tables, with how many rows and which smallest value of ``column`` each has."""
    keys = shared_keys(list(frames.values()), key)
    for name, frame in frames.items():
        sums = frame.groupBy(*key).agg(F.count("*").alias(f"{name}_rows"), F.min(column).alias(f"{name}_{column}"))
        keys = keys.join(sums, key)
    return keys


def common_flag(frame: DataFrame, others: list[DataFrame], key: list[str], name: str = "COMMON") -> DataFrame:
    """Y on the rows whose key every other table has too."""
    return frame.join(shared_keys([frame, *others], key).withColumn(name, F.lit("Y")), key, "left").fillna("N", [name])


def prepend_base(base: DataFrame, template: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A template's rows with the base columns of their key in front, and a mark on the first of each key."""
    return first_of_group(base.join(template, key, "right"), key, order, "FIRST_ROW", "Y", "N")


def regroup_actions(frame: DataFrame, key: list[str], action: str, groups: dict[str, list[str]]) -> DataFrame:
    """Within a key, actions merge into the target action that is present and lists them; windows of booleans, no join."""
    out, along = F.col(action), Window.partitionBy(*key)
    for target, sources in groups.items():
        present = F.bool_or(F.col(action) == target).over(along)
        out = F.when(present & F.col(action).isin(*sources), F.lit(target)).otherwise(out)
    return frame.withColumn("grouped_action", out)


def outer(left: DataFrame, right: DataFrame, key: list[str], flags: tuple[str, str, str] = ("both", "left_only", "right_only")) -> DataFrame:
    """Full outer join with a note which side has the row."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), flags[2]).when(F.col("_r").isNull(), flags[1]).otherwise(flags[0])
    return a.join(b, key, "full").withColumn("side", side).drop("_l", "_r")


def outer_by_rank(left: DataFrame, right: DataFrame, key: list[str], order: tuple[list[str], list[str]]) -> DataFrame:
    """The n-th row of a key beside the n-th of the other frame (ROW_NUM from 0), and which side has it."""
    ranked = [f.withColumn("ROW_NUM", F.row_number().over(Window.partitionBy(*key).orderBy(*by)) - 1) for f, by in zip((left, right), order)]
    return outer(*ranked, [*key, "ROW_NUM"])


def semi_wild(frame: DataFrame, grid: DataFrame, columns: list[str], wild: str = "*") -> DataFrame:
    """The rows that some grid row matches in every column, where ``wild`` in the grid matches anything.

    A row asks for each of its 2^n keys with some columns wild, so the join is on equal keys.
    """
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    keys = [F.struct(*(F.lit(wild) if mask >> i & 1 else F.coalesce(t, F.lit("")) for i, t in enumerate(text))) for mask in range(2 ** len(columns))]
    asked = frame.withColumn("_id", F.monotonically_increasing_id())
    named = F.struct(*(F.coalesce(t, F.lit("")).alias(f"col{i + 1}") for i, t in enumerate(text)))
    wanted = grid.select(F.to_json(named).alias("_key")).distinct()
    json = lambda k: F.to_json(F.struct(*(k[f"col{i + 1}"].alias(f"col{i + 1}") for i in range(len(columns)))))
    found = asked.select("_id", F.explode(F.array(*keys)).alias("_k")).select("_id", json(F.col("_k")).alias("_key")).join(wanted, "_key", "left_semi").select("_id").distinct()
    return asked.join(found, "_id", "left_semi").drop("_id")


def contact_addresses(addresses: DataFrame, contact: DataFrame, kind: str, key: list[str], first: list[str] = ("cred",), otherwise: list[str] = ("bill", "combo")) -> DataFrame:
    """The contact of a record beside its addresses of the kinds ``first``, or if it has none of the kinds ``otherwise``.

    Other addresses stay without contact, and a contact that meets no address stays without address.
    """
    low = F.lower(F.col(kind))
    has = F.bool_or(low.isin(*first)).over(Window.partitionBy(*key))
    flagged = addresses.withColumn("_flag", F.when(F.when(has, low.isin(*first)).otherwise(low.isin(*otherwise)), 1).otherwise(0))
    return flagged.join(contact.withColumn("_flag", F.lit(1)), [*key, "_flag"], "full").drop("_flag")


def enriched(frame: DataFrame, registry: DataFrame, key: str, columns: list[str], missing: str | Column = "") -> DataFrame:
    """Columns of a registry by id, looked up once for each distinct id; an id that it lacks gives ``missing``."""
    ids = frame.select(key).filter(F.col(key).isNotNull()).distinct()
    found = ids.join(registry.select(key, *columns).dropDuplicates([key]), key)
    out = frame.join(found.withColumn("_known", F.lit(True)), key, "left")
    return out.withColumns({c: F.when(F.col("_known"), F.col(c).cast("string")).otherwise(missing if isinstance(missing, Column) else F.lit(missing)) for c in columns}).drop("_known")


def any_all(frame: DataFrame, key: list[str], conditions: dict[str, Column]) -> DataFrame:
    """For every key whether any and whether all rows meet each condition; null counts as unmet."""
    met = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    return frame.groupBy(*key).agg(*(f(c).alias(f"{how}_{n}") for n, c in met.items() for how, f in (("any", F.bool_or), ("all", F.bool_and))))


def occurrence_pivot(frames: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """How many rows of each key each table has, a column for each table: one aggregation over all tables."""
    every = reduce(lambda a, b: a.unionByName(b), (f.select(*key, F.lit(n).alias("_table")) for n, f in frames.items()))
    return every.groupBy(*key).agg(*(F.count(F.when(F.col("_table") == n, 1)).alias(f"{n}_rows") for n in frames))


def reconcile(inputs: DataFrame, outputs: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """For every input key: rows read, rows written to each table, and whether all of them are there."""
    out = inputs.groupBy(*key).agg(F.count("*").alias("input_rows"))
    for name, frame in outputs.items():
        out = out.join(frame.groupBy(*key).agg(F.count("*").alias(f"{name}_rows")), key, "left")
    columns = [f"{n}_rows" for n in outputs]
    out = out.fillna(0, columns)
    total: Column = reduce(lambda a, b: a + b, map(F.col, columns))
    return out.withColumn("state", F.when(total == F.col("input_rows"), "complete").when(total == 0, "missing").otherwise("partial"))


def project(frame: DataFrame, schema: list[dict]) -> DataFrame:
    """The output columns of a template in order: text, or numeric padded to its format's width."""
    columns = []
    for column in schema:
        source = column["dfColName"]
        value = F.col(source).cast("string") if source in frame.columns else F.lit("")
        value = F.coalesce(value, F.lit(""))
        if column.get("dataType") == "numeric" and column.get("format"):
            width = len(column["format"])
            value = F.when(value.rlike("^[0-9]+$") & (F.length(value) < width), F.lpad(value, width, "0")).otherwise(value)
        columns.append(value.alias(column["outputColName"]))
    return frame.select(*columns)
