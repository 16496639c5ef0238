"""In-band messages: a cell holds a value or ``Severity: message|Input: value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities by their letter; any other letter is a clarification.
SEVERITIES = {"R": "Reject: ", "E": "Error: "}
CLARIFY = "Clarify: "
#: Fixed value: an input that stands for "no value" and is left out of messages.
NO_INPUT = "9999999999"
#: Fixed value: what a failed row rule leaves.
UNDEFINED = "Error: Undefined Error|Input: "


def message(kind: str, text: str | Column, value: Column | None = None) -> Column:
    """The message of severity ``kind`` about ``value``."""
    value = F.lit("") if value is None else F.coalesce(value.cast("string"), F.lit(""))
    shown = F.when(value == NO_INPUT, F.lit("")).otherwise(value)
    return F.concat(F.lit(SEVERITIES.get(kind, CLARIFY)), text if isinstance(text, Column) else F.lit(text), F.lit("|Input: "), shown)


def is_message(value: Column) -> Column:
    """Whether a cell holds a message, in any letter case."""
    return F.coalesce(F.lower(value).rlike("reject:|error:|clarify:"), F.lit(False))


def unless_message(value: Column, result: Column) -> Column:
    """``result``, but a message passes through."""
    return F.when(is_message(value), value).otherwise(result)


def parts(value: Column) -> Column:
    """severity, message and input of a cell; null for a plain value."""
    pattern = r"(?s)^(Reject|Error|Clarify): (.*)\|Input: (.*)$"
    found = [F.regexp_extract(value, pattern, i) for i in (1, 2, 3)]
    return F.when(value.rlike(pattern), F.struct(found[0].alias("severity"), found[1].alias("message"), found[2].alias("input")))


#: Stands for "no value" where null says that a value could not be computed; no roster text is that character.
_NOTHING = "\x00"


def attempted(value: Column) -> Column:
    """A struct of ``value`` as text and ``failed``: whether computing it failed in this row; a row that fails doesn't fail the job.

    The text goes through bytes by a function that gives null for whatever it can't do, which holds for
    its arguments too. As the body of a lambda the value is computed there only, not ahead of the row.
    """
    text = F.transform(F.array(F.lit(0)), lambda _: F.coalesce(value.cast("string"), F.lit(_NOTHING)))[0]
    told = lambda t: F.struct(F.nullif(F.decode(t, "utf-8"), F.lit(_NOTHING)).alias("value"), t.isNull().alias("failed"))
    return F.transform(F.array(F.try_to_binary(text, F.lit("utf-8"))), told)[0]


def trapped(value: Column) -> Column:
    """``value`` as text, with the undefined error in rows where computing it fails."""
    return F.transform(F.array(attempted(value)), lambda a: F.when(a["failed"], F.lit(UNDEFINED)).otherwise(a["value"]))[0]
