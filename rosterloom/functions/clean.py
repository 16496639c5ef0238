"""Cleaning rules on free text: indicators, codes and packed records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.errors import message
from rosterloom.functions.text import blank


def regex_value(value: Column, patterns: dict[str, str]) -> Column:
    """The key of the first pattern that is found in the value, in any letter case; else the value."""
    out = value
    for key, pattern in reversed(patterns.items()):
        out = F.when(F.coalesce(value.rlike(f"(?i){pattern}"), F.lit(False)), F.lit(key)).otherwise(out)
    return out


def taxonomy_code(value: Column) -> Column:
    """The first ten-letter code of letters and digits that ends in x and has both in front; else the value."""
    code = F.regexp_extract(value, r"(?i)(?=\b[a-z0-9]{9}x\b)((?:[a-z]+[0-9]|[0-9]+[a-z])[a-z0-9]*)", 1)
    return F.when(code != "", code).otherwise(value)


def indicator(value: Column, standards: dict[str, list[str]], otherwise: str | Column = "") -> Column:
    """The standard key whose word the value has first, between blanks or its ends; in any letter case, first listed key of equals."""
    names = {w.lower(): key for key, words in reversed(standards.items()) for w in words}
    either = "|".join(re.escape(w) for w in sorted(names, key=lambda w: (-len(w), w)))
    word = F.lower(F.regexp_extract(value, rf"(?i)(?:^|\s)({either})(?=\s|$)", 1))
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), word)
    return F.coalesce(found, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def primary_secondary(value: Column, standards: dict[str, list[str]], primary: str = "PRIMARY") -> Column:
    """P if a word of ``primary`` is in the value, S for a word of any other key, in the order of the keys; else the value."""
    out = value
    for key, words in reversed(standards.items()):
        hit = value.rlike(rf"(?i)\b(?:{'|'.join(map(re.escape, words))})\b")
        out = F.when(F.coalesce(hit, F.lit(False)), "P" if key.upper() == primary.upper() else "S").otherwise(out)
    return out


def group_mandatory(value: Column, flag: Column, text: str = "Mandatory field Missing Value") -> Column:
    """A blank value of a group that is there (``flag`` is filled) is a clarification."""
    return F.when(~blank(flag) & blank(value), message("C", text)).otherwise(value)


def packed_names(value: Column) -> Column:
    """last, first and middle of a packed list of names, ``[{"last": ..., "first": ..., "middle": ...}, ...]``: an array, empty if it can't be read."""
    kind = "array<struct<last:string,first:string,middle:string>>"
    return F.coalesce(F.from_json(value, kind), F.array().cast(kind))


def registry_name(basic: Column, kind: Column) -> Column:
    """The name of a registry record: its own for an individual (NPI-1), else its authorised official's."""
    field = lambda name: F.when(kind == "NPI-1", basic[name]).otherwise(basic[f"authorized_official_{name}"])
    return F.struct(*(F.coalesce(field(n), F.lit("")).alias(n) for n in ("last_name", "first_name", "middle_name", "credential")))


def primary_taxonomy(taxonomies: Column) -> Column:
    """The code of the primary taxonomy, else of the first one; null without any."""
    first = lambda xs: F.try_element_at(xs, F.lit(1))["code"]
    return F.coalesce(first(F.filter(taxonomies, lambda t: F.coalesce(t["primary"], F.lit(False)))), first(taxonomies))
