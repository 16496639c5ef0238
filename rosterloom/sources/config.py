"""JSON files of a run: rule programs, saved mappings, field dictionaries and output schemas."""

from __future__ import annotations

import ast
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from rosterloom.schema import ColumnRef

#: Fixed value: a saved mapping with this text in place of its columns leaves its sheet out.
IGNORED = "to be ignored"
#: Types of a step that are not rules of a scope of their own.
COMMON, TREE, TABLES = ("var", "mv_cmn", None), "tree", "interTmplt"


def read_json(spark: SparkSession, path: str):
    """One JSON file, from any file system that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _argument(value):
    """A string that is a Python literal becomes what it says; nothing is evaluated."""
    if isinstance(value, str):
        try:
            return ast.literal_eval(value)
        except (ValueError, SyntaxError):
            return value
    return value


def _step(category: str, derivation: dict) -> dict:
    given, kind = _argument(derivation.get("input", {})), derivation.get("type")
    if kind == TREE:
        bound = given if isinstance(given, list) else [given]
        return {"frame": category, "rule": "tree", "output": derivation["col"], "arguments": {"tree": derivation["name"], "bind": bound}}
    out = {"frame": category, "rule": derivation["name"], "arguments": given if isinstance(given, (list, dict)) else [given]}
    if derivation.get("col") is not None:
        out["output"] = derivation["col"]
    return out if kind in COMMON else {**out, "scope": kind}


def program(layers: list[dict], stage: int | None = None) -> list[dict]:
    """The layers of a program file as ``run_program`` takes them; of one process stage, or of all."""
    out = []
    for layer in layers:
        if stage is not None and layer.get("ProcessStage", 0) != stage:
            continue
        steps = [_step(category, d) for part in layer["Transformation"] for category, body in part.items() for d in body.get("derivations") or []]
        out.append({"layer": layer.get("LayerName", ""), "type": layer.get("LayerType", "DF"), "steps": steps})
    return out


def table_steps(steps: list[dict]) -> list[dict]:
    """Inter-template steps as a TABLES layer: the keys that all templates of ``cols`` share move to the output template."""
    out = []
    for step in steps:
        given = _argument(step["input"])
        arguments = given if "cols" not in given else {
            "sources": list(given["cols"]), "output": step["outTemplate"],
            "key": next(iter(given["cols"].values()))["intersection"], "delete": any(c.get("deleteFlag") for c in given["cols"].values()),
        }
        out.append({"rule": step["name"], "arguments": arguments})
    return [{"layer": TABLES, "type": "TABLES", "steps": out}]


@dataclass(frozen=True)
class SavedMapping:
    """The mapping of one saved format; an ignored sheet has no columns."""

    headers: list[str]
    single: dict[str, str] = field(default_factory=dict)
    repeated: dict[str, dict[str, ColumnRef]] = field(default_factory=dict)
    ignored: bool = False


def saved_mappings(saved: dict) -> dict[str, SavedMapping]:
    """Saved formats by their number."""
    out = {}
    for number, entry in saved.items():
        mappings = entry.get("mappings", IGNORED)
        headers = entry.get("format") or entry.get("diheader") or []
        if mappings == IGNORED:
            out[number] = SavedMapping(headers, ignored=True)
            continue
        repeated = {category: {h: ref for h, name in own.items() if (ref := ColumnRef.parse(name))} for category, own in mappings.get("mv", {}).items()}
        out[number] = SavedMapping(headers, dict(mappings.get("sv", {})), repeated)
    return out


def aliases(dictionary: dict) -> dict[str, list[str]]:
    """Field to the headers it may have, from a dictionary of single or repeated fields."""
    out = {}
    for name, entry in dictionary.items():
        columns = list(entry.get("Input_Column", []))
        for part in entry.get("Column_Type", []):
            columns += part.get("Input_Column", [])
        out[name] = columns
    return out


def output_columns(schema: dict) -> list[dict]:
    """The columns of an output schema, as ``project`` takes them."""
    return list(schema["finalDfColNames"])
