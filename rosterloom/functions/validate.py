"""Validation rules: the value passes, or becomes a message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.errors import message, unless_message
from rosterloom.functions.text import blank, digits


def length(value: Column, size: int, exact: bool = False, mandatory: bool = False, kind: str = "C", text: str = "Invalid length") -> Column:
    """At most ``size`` characters, or exactly that many; a blank passes unless it is mandatory."""
    wrong = F.length(value) != size if exact else F.length(value) > size
    out = F.when(blank(value), message(kind, text, value) if mandatory else value).when(wrong, message(kind, text, value)).otherwise(value)
    return unless_message(value, out)


def not_zeros(value: Column, kind: str = "C", text: str = "Only zeros") -> Column:
    return F.when(value.rlike("^0+$"), message(kind, text, value)).otherwise(value)


def fewer_digits(value: Column, least: int, kind: str = "C", text: str = "Too few digits") -> Column:
    return unless_message(value, F.when(F.length(digits(value)) < least, message(kind, text, value)).otherwise(value))


def numeric(value: Column, kind: str = "C", text: str = "Not numeric") -> Column:
    return unless_message(value, F.when(blank(value) | value.rlike("^[0-9]+$"), value).otherwise(message(kind, text, value)))


def alphanumeric(value: Column, kind: str = "C", text: str = "Not alphanumeric") -> Column:
    return unless_message(value, F.when(blank(value) | value.rlike("^[A-Za-z0-9 ]+$"), value).otherwise(message(kind, text, value)))


def mandatory(value: Column, kind: str = "C", text: str = "Mandatory field missing") -> Column:
    """A blank, or the placeholder 00000, becomes a message."""
    return F.when(blank(value) | (F.trim(value) == "00000"), message(kind, text, value)).otherwise(value)


def correlated(value: Column, drivers: list[Column], kind: str = "C", text: str = "Field missing") -> Column:
    """A blank becomes a message only if a driver is filled."""
    filled = reduce(lambda a, b: a | b, (~blank(d) for d in drivers))
    return F.when(blank(value) & filled, message(kind, text, value)).otherwise(value)


def edit_check(value: Column, expected: Column, most: int = 2, kind: str = "R", text: str = "Name mismatch") -> Column:
    """The value, if it is within ``most`` edits of what is expected."""
    near = F.levenshtein(F.lower(F.trim(value)), F.lower(F.trim(expected)), most) >= 0
    return unless_message(value, F.when(near, value).otherwise(message(kind, text, value)))
