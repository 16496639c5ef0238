"""Rule programs: layers of steps over named frames, planned as DataFrame operations.

A program is a list of ``{"layer", "type": "ROW" | "DF" | "TABLES", "steps": [...]}``. A ROW step
adds an output column (or several, from a struct) to a frame; consecutive ROW steps of a frame
that don't read each other's outputs become one projection. A DF step replaces a frame, and a
TABLES step works on several. Arguments are constants, ``{"col": name}`` or ``{"frame": name}``;
names are checked when the program is planned. The output ``DYNAMIC`` takes the names of its columns
from the rule's map, so they are known only from the data. All rules are Columns or DataFrames, so Catalyst
sees one plan for the whole program. ``rosterloom.sources.config`` reads programs from JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from rosterloom.errors import UNDEFINED, attempted
from rosterloom.errors import trapped as trapped_value
from rosterloom.errors import message as envelope
from rosterloom.functions import clean, dates, hours, tagging, text, validate
from rosterloom.operators import documents, forms, keys, reshape, rows, templates, update
from rosterloom.plans import trees

ROW_RULES: dict[str, Callable[..., Column]] = {}
FRAME_RULES: dict[str, Callable[..., DataFrame]] = {}
#: Rules over all frames by name, which return the frames they change.
TABLE_RULES: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def row_rule(name: str, scope: str = "common"):
    def register(rule):
        ROW_RULES[f"{scope}.{name}"] = rule
        return rule

    return register


def frame_rule(name: str, scope: str = "common"):
    def register(rule):
        FRAME_RULES[f"{scope}.{name}"] = rule
        return rule

    return register


def _find(table: dict, name: str, scope: str):
    """A template's own rule, else the common one."""
    rule = table.get(f"{scope}.{name}") or table.get(f"common.{name}")
    if rule is None:
        raise ValueError(f"no rule is named {name!r}")
    return rule


# Row rules that are Column functions as they are

for _name, _rule in {
    "standard_value": text.standard_value, "remove_punctuation": text.remove_punctuation, "replace_words": text.replace_words, "phone": text.phone,
    "phone_extension": text.phone_extension, "zip5": text.zip5, "zip4": text.zip4, "apply_regexes": text.apply_regexes, "electronic_type": text.electronic_type,
    "zero_padded": text.zero_padded, "abbreviate": text.abbreviate, "parse_date": dates.parse_date, "days_between": dates.days_between,
    "effective_window": dates.effective_window, "birth_date": dates.birth_date, "length": validate.length, "not_zeros": validate.not_zeros,
    "fewer_digits": validate.fewer_digits, "numeric": validate.numeric, "alphanumeric": validate.alphanumeric, "mandatory": validate.mandatory,
    "correlated": validate.correlated, "edit_check": validate.edit_check, "name_parts": text.name_parts, "age_limits": text.age_limits,
    "working_hours": hours.working_hours, "regex_value": clean.regex_value, "taxonomy_code": clean.taxonomy_code, "indicator": clean.indicator,
    "primary_secondary": clean.primary_secondary, "group_mandatory": clean.group_mandatory, "address_parts": tagging.address_parts, "parsed_address": tagging.parsed_address, "packed_names": clean.packed_names,
}.items():
    ROW_RULES[f"common.{_name}"] = _rule


@row_rule("value_or")
def value_or(value: Column, otherwise: Column) -> Column:
    return F.when(text.blank(value), otherwise).otherwise(value)


@row_rule("quotient")
def quotient(left: Column, right: Column) -> Column:
    """Whole times that ``right`` goes into ``left``."""
    return F.floor(left / right)


@row_rule("number")
def number(value: Column) -> Column:
    return value.cast("long")


@row_rule("named_value")
def named_value(name: Column, value: Column) -> Column:
    """For the output DYNAMIC: the value under the name that the row gives; none under a blank name."""
    return F.when(~text.blank(name), F.create_map(name, value.cast("string")))


@row_rule("named_values")
def named_values(names: Column, values: Column) -> Column:
    """The same for arrays of names and values; of equal names the last counts."""
    pairs = F.zip_with(names, values.cast("array<string>"), lambda n, v: F.struct(n.alias("key"), v.alias("value")))
    last = F.filter(pairs, lambda p, i: ~text.blank(p["key"]) & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


@row_rule("joined")
def joined(values: list[Column], separator: str = " ") -> Column:
    """The non-blank values, joined."""
    return F.array_join(F.filter(F.array(*values), lambda v: ~text.blank(v)), separator)


@row_rule("po_box")
def po_box(value: Column, answer: str = "Y", otherwise: str = "N") -> Column:
    return F.when(text.is_po_box(value), answer).otherwise(otherwise)


# Frame rules


def predicate(frame: DataFrame, where: dict) -> Column:
    """``{"col", "equals" | "in" | "matches" | "blank"}``, or ``{"all" | "any": [...]}``, or ``{"not": ...}``."""
    if "all" in where or "any" in where:
        out = F.lit("all" in where)
        for part in where.get("all") or where.get("any"):
            out = out & predicate(frame, part) if "all" in where else out | predicate(frame, part)
        return out
    if "not" in where:
        return ~predicate(frame, where["not"])
    if where["col"] not in frame.columns:
        raise ValueError(f"no column is named {where['col']!r}")
    column = F.col(f"`{where['col']}`")
    if "equals" in where:
        return F.coalesce(column == F.lit(where["equals"]), F.lit(False))
    if "in" in where:
        return F.coalesce(column.isin(*where["in"]), F.lit(False))
    if "matches" in where:
        return F.coalesce(column.rlike(where["matches"]), F.lit(False))
    return text.blank(column) if where["blank"] else ~text.blank(column)


@frame_rule("update_where")
def update_where(frame: DataFrame, column: str, where: dict, value=None, message: list[str] | None = None) -> DataFrame:
    new = envelope(message[0], message[1], F.col(column)) if message else (value if isinstance(value, Column) else F.lit(value))
    return update.conditional_update(frame, column, [(predicate(frame, where), new)])


@frame_rule("keep_where")
def keep_where(frame: DataFrame, where: dict) -> DataFrame:
    return frame.filter(predicate(frame, where))


@frame_rule("keep_first_where")
def keep_first_where(frame: DataFrame, key: list[str], order: list[str], wheres: list[dict]) -> DataFrame:
    """The rows of the first predicate that any row of a key meets, in priority order; all rows if none does."""
    rank = F.lit(len(wheres))
    for i, where in reversed(list(enumerate(wheres))):
        rank = F.when(predicate(frame, where), i).otherwise(rank)
    ranked = frame.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy(*key)))
    return ranked.filter("_rank = _best").drop("_rank", "_best")


@frame_rule("keep_or_default")
def keep_or_default(frame: DataFrame, key: list[str], order: list[str], where: dict, top_row: bool = False) -> DataFrame:
    """The rows of each key that meet ``where``, or only the first of them; a key without one has one row of blanks (null in columns that aren't text)."""
    met = frame.withColumn("_met", predicate(frame, where))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_met"), *order))
    kept = met.withColumn("_place", place).filter((F.col("_place") == 1) | (F.col("_met") & F.lit(not top_row)))
    blanks = {f.name: F.lit("") if f.dataType.simpleString() == "string" else F.lit(None).cast(f.dataType) for f in frame.schema if f.name not in key}
    return kept.withColumns({c: F.when(F.col("_met"), F.col(f"`{c}`")).otherwise(b) for c, b in blanks.items()}).drop("_met", "_place")


@frame_rule("blank_columns")
def blank_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: F.lit("") for c in columns})


@frame_rule("drop_columns")
def drop_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.drop(*columns)


@frame_rule("rename")
def rename(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    return frame.withColumnsRenamed(names)


@frame_rule("drop_blank_rows")
def drop_blank_rows(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    full = F.lit(False)
    for c in columns or frame.columns:
        full |= ~text.blank(F.col(f"`{c}`").cast("string"))
    return frame.filter(full)


@frame_rule("join_first")
def join_first(frame: DataFrame, other: DataFrame, key: list[str], column: str, order: list[str], output: str) -> DataFrame:
    """A sibling frame's first value of the same record; all siblings' values cost one aggregate and one join."""
    first = other.groupBy(*key).agg(F.min(F.struct(*order, F.col(column).alias("_value")))["_value"].alias(output))
    return frame.join(first, key, "left")


FRAME_RULES |= {
    "common.split_rows": reshape.split_rows, "common.zip_fill": reshape.zip_fill, "common.numbered": reshape.numbered, "common.compact_slots": reshape.compact_slots,
    "common.default_row": lambda frame, base, key, defaults: reshape.default_row(base, frame, key, defaults), "common.unpivot": reshape.unpivot,
    "common.first_of_group": update.first_of_group, "common.fill_group": update.fill_group, "common.forward_fill": update.forward_fill,
    "common.duplicates_within": update.duplicates_within, "common.located_in": update.located_in, "common.final_id": keys.final_id,
    "common.single_values": keys.single_values, "common.project": templates.project, "common.regroup_actions": templates.regroup_actions,
    "common.sorted_rows": rows.sorted_rows, "common.sliced": rows.sliced, "common.clone_rows": rows.clone_rows, "common.without_duplicates": rows.without_duplicates,
    "common.contact_rows": rows.contact_rows, "common.nested_maps": rows.nested_maps, "common.occurrence": rows.occurrence, "common.renumbered_sets": rows.renumbered_sets,
    "common.text_lines": documents.text_lines, "common.table_columns": documents.table_columns, "common.region_text": documents.region_text,
    "common.records_by_gap": documents.records_by_gap, "common.records_by_change": documents.records_by_change, "common.merge_delimited": documents.merge_delimited,
    "common.words_from_boxes": forms.words_from_boxes, "common.table_cells": forms.table_cells, "common.laid_out": forms.laid_out,
}


# Rules between tables


def table_rule(name: str, scope: str = "common"):
    def register(rule):
        TABLE_RULES[f"{scope}.{name}"] = rule
        return rule

    return register


def _of(frames: dict[str, DataFrame], names: list[str]) -> list[DataFrame]:
    missing = [n for n in names if n not in frames]
    if missing:
        raise ValueError(f"no frame is named {missing[0]!r}")
    return [frames[n] for n in names]


@table_rule("common_flag")
def common_flag(frames, output: str, others: list[str], key: list[str], name: str = "COMMON"):
    frame, *rest = _of(frames, [output, *others])
    return {output: templates.common_flag(frame, rest, key, name)}


@table_rule("move_common")
def move_common(frames, sources: list[str], output: str, key: list[str], delete: bool = True):
    """The rows whose key all ``sources`` have go to the table ``output``, and with ``delete`` leave their tables."""
    found = _of(frames, sources)
    shared = templates.shared_keys(found, key)
    moved = found[0].join(shared, key, "left_semi")
    for frame in found[1:]:
        moved = moved.unionByName(frame.join(shared, key, "left_semi"), allowMissingColumns=True)
    if output in frames:
        moved = frames[output].unionByName(moved, allowMissingColumns=True)
    left = {n: f.join(shared, key, "left_anti") for n, f in zip(sources, found)} if delete else {}
    return {**left, output: moved}


@table_rule("across")
def across(frames, sources: list[str], output: str, key: list[str], column: str):
    return {output: templates.across(dict(zip(sources, _of(frames, sources))), key, column)}


@table_rule("prepend_base")
def prepend_base(frames, base: str, output: str, key: list[str], order: list[str]):
    first, template = _of(frames, [base, output])
    return {output: templates.prepend_base(first, template, key, order)}


@table_rule("reconcile")
def reconcile(frames, inputs: str, outputs: list[str], output: str, key: list[str]):
    first, *rest = _of(frames, [inputs, *outputs])
    return {output: templates.reconcile(first, dict(zip(outputs, rest)), key)}


def _bound(value, frame: DataFrame, frames: dict[str, DataFrame]):
    """An argument as its Column, frame or constant; lists and maps element by element."""
    if isinstance(value, dict) and set(value) == {"col"}:
        if value["col"] not in frame.columns:
            raise ValueError(f"no column is named {value['col']!r}")
        return F.col(f"`{value['col']}`")
    if isinstance(value, dict) and set(value) == {"frame"}:
        return frames[value["frame"]]
    if isinstance(value, dict) and set(value) == {"date"}:
        return F.lit(value["date"]).cast("date")
    if isinstance(value, list):
        return [_bound(v, frame, frames) for v in value]
    return value


def _row_column(step: dict, frame: DataFrame, frames: dict[str, DataFrame], scope: str) -> Column:
    scope = step.get("scope", scope)
    arguments = step.get("arguments", {})
    if step["rule"] == "tree":
        tree = arguments["tree"]
        return trees.strict(trees.compile_tree(trees.TREES[tree] if isinstance(tree, str) else tree, frame, arguments.get("bind", [])))
    rule = _find(ROW_RULES, step["rule"], scope)
    if isinstance(arguments, list):
        return rule(*(_bound(v, frame, frames) for v in arguments))
    return rule(**{k: _bound(v, frame, frames) for k, v in arguments.items()})


def _outputs(step: dict, frame: DataFrame, frames: dict[str, DataFrame], scope: str) -> dict[str, Column]:
    """The columns that a ROW step adds; of a list of outputs each takes one field of the rule's struct."""
    value, names = _row_column(step, frame, frames, scope), step["output"]
    if step.get("guard"):
        value = trees.guarded(value)
    if isinstance(names, str):
        return {names: value}
    fields = frame.select(value.alias("value")).schema[0].dataType.fieldNames()
    if len(fields) != len(names):
        raise ValueError(f"{step['rule']!r} gives {len(fields)} values, not {len(names)}")
    return {n: value.getField(f) for n, f in zip(names, fields)}


#: Fixed value: the output whose columns the rule names.
DYNAMIC = "DYNAMIC"


def _caught(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.from_json(attempted(F.to_json(value))["value"], kind)
    return trapped_value(value)


def _mentions(value, names: set[str]) -> bool:
    """Whether an argument needs one of the columns ``names``, or any column by its name."""
    if isinstance(value, dict):
        return value.get("col") in names or any(_mentions(v, names) for v in value.values())
    if isinstance(value, (list, tuple)):
        return value[:1] == ["found"] or any(_mentions(v, names) for v in value)
    return isinstance(value, str) and value in trees.TREES and _mentions(trees.TREES[value], names)


#: The most columns that one DYNAMIC step may add.
MOST_NAMES = 256


def dynamic_columns(frame: DataFrame, named: Column, most: int = MOST_NAMES) -> DataFrame:
    """``frame`` with a text column for each name that the map ``named`` has in any row; refused beyond ``most`` names.

    A row without a name keeps that column's value, if there is such a column, else it is null.
    The names are found in a pass of their own, of which the driver sees ``most`` and one at most.
    """
    taken = "_named"
    while taken in frame.columns:
        taken += "_"
    held = frame.withColumn(taken, named)
    names = sorted(r[0] for r in held.select(F.explode(F.map_keys(taken))).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} names of columns")
    there = {c.lower(): c for c in frame.columns}
    value = lambda n: F.try_element_at(taken, F.lit(n))
    old = lambda n: F.col(f"`{there[n.lower()]}`").cast("string")
    return held.withColumns({there.get(n.lower(), n): F.when(F.map_contains_key(taken, F.lit(n)), value(n)).otherwise(old(n)) if n.lower() in there else value(n) for n in names}).drop(taken)


@contextmanager
def _strict_arithmetic(frame: DataFrame):
    """Rules planned here fail where they can't compute a value, whatever the session's mode, so that it can be trapped."""
    conf = frame.sparkSession.conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "true")
    try:
        yield
    finally:
        conf.set("spark.sql.ansi.enabled", before)


class _Pending:
    """ROW steps of one frame that wait for one projection."""

    def __init__(self, frames: dict[str, DataFrame]):
        self._frames, self._name, self._columns = frames, None, {}

    def flush(self) -> None:
        if self._columns:
            self._frames[self._name] = self._frames[self._name].withColumns(self._columns)
        self._name, self._columns = None, {}

    def before(self, name: str, arguments) -> None:
        """A step that reads what is waiting, or whose frame is another, sees it done."""
        if name != self._name or _mentions(arguments, set(self._columns)) or (isinstance(arguments, dict) and any(isinstance(v, dict) and "frame" in v for v in arguments.values())):
            self.flush()
        self._name = name

    def add(self, columns: dict[str, Column]) -> None:
        self._columns |= columns


def run_program(layers: list[dict], frames: dict[str, DataFrame], scope: str = "common", trapped: list[str] | None = None) -> dict[str, DataFrame]:
    """Plan all layers; the result is the named frames after the last one.

    With a list ``trapped`` a rule that can't be planned is noted there and the program goes on:
    a ROW rule leaves the undefined error in its output, a DF or TABLES rule its frames as they
    were. A ROW rule that fails in some rows only while it runs leaves the undefined error in those
    rows; its plain outputs are text then, and an array, map or struct is null there. Without a list
    both raise. A frame that isn't there always raises.
    """
    frames, failures = dict(frames), (AnalysisException, ValueError, TypeError, LookupError)
    pending = _Pending(frames)

    def tried(step: dict, run, instead) -> None:
        if trapped is None:
            return run()
        try:
            return run()
        except failures as error:
            trapped.append(f"{step['rule']}: {error}")
            return instead()

    def add_row(name: str, step: dict) -> None:
        pending.before(name, step.get("arguments", {}))
        names = [step["output"]] if isinstance(step["output"], str) else step["output"]

        def run():
            if step["output"] == DYNAMIC:
                pending.flush()
                frames[name] = dynamic_columns(frames[name], _row_column(step, frames[name], frames, scope))
                return
            columns = _outputs(step, frames[name], frames, scope)
            if trapped is None:
                return pending.add(columns)
            pending.flush()
            with _strict_arithmetic(frames[name]):
                kinds = frames[name].select(*(c.alias(n) for n, c in columns.items())).schema  # analysed now, so that it fails here
                frames[name] = frames[name].withColumns({n: _caught(c, kinds[n].dataType) for n, c in columns.items()})

        tried(step, run, lambda: pending.add({n: F.lit(UNDEFINED) for n in names}))

    def change_frame(name: str, step: dict) -> None:
        def run():
            plain = ("where", "wheres")
            arguments = {k: v if k in plain else _bound(v, frames[name], frames) for k, v in step.get("arguments", {}).items()}
            frames[step.get("output", name)] = _find(FRAME_RULES, step["rule"], step.get("scope", scope))(frames[name], **arguments)

        tried(step, run, lambda: None)

    def change_tables(step: dict) -> None:
        tried(step, lambda: frames.update(_find(TABLE_RULES, step["rule"], step.get("scope", scope))(frames, **step.get("arguments", {}))), lambda: None)

    for layer in layers:
        for step in layer["steps"]:
            if layer["type"] == "TABLES":
                pending.flush()
                change_tables(step)
                continue
            name = step["frame"]
            if name not in frames:
                raise ValueError(f"no frame is named {name!r}")
            if layer["type"] == "ROW":
                add_row(name, step)
            else:
                pending.flush()
                change_frame(name, step)
    pending.flush()
    return frames
