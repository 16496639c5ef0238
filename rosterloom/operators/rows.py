"""Rows of a record: order, slices, copies, repeats and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.errors import message
from rosterloom.functions.text import blank
from rosterloom.schema import ColumnRef, repeated


def sorted_rows(frame: DataFrame, columns: list[str], ascending: list[bool] | bool = True) -> DataFrame:
    """Sorted by columns, each in its direction, nulls last either way."""
    ways = [ascending] * len(columns) if isinstance(ascending, bool) else ascending
    return frame.orderBy(*(F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in zip(columns, ways)))


def sliced(frame: DataFrame, key: list[str], order: list[str], start: int = 0, stop: int | None = None) -> DataFrame:
    """The rows of each key from place ``start`` to before ``stop``; negative places count from the end."""
    along = Window.partitionBy(*key)
    ranked = frame.withColumn("_at", F.row_number().over(along.orderBy(*order)) - 1).withColumn("_size", F.count("*").over(along))
    place = lambda n: F.lit(n) if n >= 0 else F.col("_size") + n
    kept = F.col("_at") >= place(start)
    if stop is not None:
        kept &= F.col("_at") < place(stop)
    return ranked.filter(kept).drop("_at", "_size")


def clone_rows(frame: DataFrame, where: Column | str, changes: dict[str, object], copies: int = 1, number: str = "clone_no") -> DataFrame:
    """Every row (number 0), and ``copies`` of the rows that meet ``where`` with ``changes`` made."""
    met = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    out = frame.select("*", F.explode(F.when(met, F.sequence(F.lit(0), F.lit(copies))).otherwise(F.array(F.lit(0)))).alias(number))
    return out.withColumns({c: F.when(F.col(number) > 0, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def without_clones(frame: DataFrame, number: str = "clone_no") -> DataFrame:
    """The rows as they were before ``clone_rows``, but for what it changed in none of them."""
    return frame.filter(F.col(number) == 0).drop(number)


def without_duplicates(frame: DataFrame, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row of equals: in all columns, or the first by ``order`` of those equal in ``columns``."""
    if columns is None:
        return frame.distinct()
    if order is None:
        return frame.dropDuplicates(columns)
    return frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*columns).orderBy(*order))).filter("_rank = 1").drop("_rank")


def contact_rows(frame: DataFrame, phone: str, fax: str, kind: str, levels: list[str], number: str = "NUMBER", derived: str = "KIND") -> DataFrame:
    """A row for the phone and one for the fax, of kind P and F where ``kind`` is blank; a row without either stays. One row of equals in ``levels`` is kept."""
    row = lambda c, letter: F.when(~blank(F.col(c)), F.struct(F.col(c).alias("value"), F.when(blank(F.col(kind)), F.lit(letter)).otherwise(F.col(kind)).alias("kind")))
    found = F.array_compact(F.array(row(phone, "P"), row(fax, "F")))
    none = F.array(F.struct(F.lit("").alias("value"), F.coalesce(F.col(kind), F.lit("")).alias("kind")))
    long = frame.withColumn("_row", F.explode(F.when(F.size(found) > 0, found).otherwise(none)))
    return long.withColumns({number: F.col("_row.value"), derived: F.col("_row.kind")}).drop("_row").dropDuplicates(levels)


def nested_maps(frame: DataFrame, refs: dict[str, ColumnRef] | None = None) -> DataFrame:
    """The repeated columns of each field as one map: TAG@SET to the value, or to a map of the values by group number."""
    refs = repeated(frame) if refs is None else refs
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    out = {}
    for field in dict.fromkeys(r.field for r in refs.values()):
        sets: dict[str, list[tuple[int | None, str]]] = {}
        for column, r in refs.items():
            if r.field == field:
                sets.setdefault(f"{r.tag}@{r.set}", []).append((r.group, column))
        nested = any(g is not None for own in sets.values() for g, _ in own)
        value = lambda own: F.create_map(*(x for g, c in own for x in (F.lit(str(g or 0)), text(c)))) if nested else text(own[0][1])  # noqa: E731, B023
        out[field] = F.create_map(*(x for name, own in sets.items() for x in (F.lit(name), value(own))))
    return frame.select(*(f"`{c}`" for c in frame.columns if c not in refs), *(m.alias(f) for f, m in out.items()))


def renumbered_sets(frame: DataFrame) -> DataFrame:
    """Set numbers that no two tags of a field group share: the sets of each tag follow those of the tags before it, as many as its fullest field has."""
    refs = repeated(frame)
    most: dict[str, int] = {}
    for r in refs.values():
        sets = {o.set for o in refs.values() if (o.tag, o.field) == (r.tag, r.field)}
        most[r.tag] = max(most.get(r.tag, 0), len(sets))
    start, first = 0, {}
    for tag, n in most.items():
        first[tag], start = start, start + n
    order = {(tag, s): i for tag in most for i, s in enumerate(sorted({r.set for r in refs.values() if r.tag == tag}))}
    names = {c: ColumnRef(r.tag, r.field, first[r.tag] + order[r.tag, r.set], r.group).name for c, r in refs.items()}
    return frame.withColumnsRenamed(names)


def numbered_places(frame: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Places of the rows of a key, from 0."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def occurrence(frame: DataFrame, key: list[str], order: list[str], counted: Column | str, name: str) -> DataFrame:
    """How many rows of the key up to this one meet ``counted``: the running count that a per-record counter holds."""
    met = F.expr(counted) if isinstance(counted, str) else counted
    along = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn(name, F.sum(F.coalesce(met.cast("long"), F.lit(0))).over(along))


def correspondence(frame: DataFrame, key: list[str], order: list[str], address: str, kind: str, mail: str, indicator: str, name: str = "CORRESPONDENCE") -> DataFrame:
    """P or S for each address of a record, blank without one; every bill address after the first of its key is a clarification."""
    low = F.lower(F.trim(F.coalesce(F.col(kind), F.lit(""))))
    bill = ~blank(F.col(address)) & (low == "bill")
    counted = occurrence(frame, key, order, bill, "_bills")
    practice = blank(F.col(mail)) & (low == "plsv") & (F.lower(F.trim(F.col(indicator))) == "p")
    letter = F.when(low.isin("bill", "mail", "combo") | F.coalesce(practice, F.lit(False)), F.lit("P")).otherwise("S")
    out = F.when(blank(F.col(address)), F.lit("")).when(bill & (F.col("_bills") > 1), message("C", "Multiple billing address")).otherwise(letter)
    return counted.withColumn(name, out).drop("_bills")
