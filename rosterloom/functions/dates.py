"""Date rules on strings as MM/dd/yyyy; the reference day is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.errors import message, unless_message
from rosterloom.functions.text import blank, let

#: Formats with the shapes of the texts that they read, and the day that spreadsheet serials count from.
FORMATS = {
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}", "yyyy-M-d": r"\d{4}-\d{1,2}-\d{1,2}", "M-d-yyyy": r"\d{1,2}-\d{1,2}-\d{4}",
    "d MMM yyyy": r"\d{1,2} [A-Za-z]{3} \d{4}", "MMM d, yyyy": r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d yyyy": r"[A-Za-z]{3} \d{1,2} \d{4}",
    "MMMM d, yyyy": r"[A-Za-z]{4,9} \d{1,2}, \d{4}", "MMMM d yyyy": r"[A-Za-z]{4,9} \d{1,2} \d{4}", "yyyyMMdd": r"\d{8}", "M/yyyy": r"\d{1,2}/\d{4}", "yyyy": r"\d{4}",
}
OUTPUT, SERIAL_START = "MM/dd/yyyy", "1899-12-30"
#: Days in the past and ahead that an effective date may lie.
PAST, AHEAD = 365, 90


def _full_year(text: Column) -> Column:
    """The text with a two-digit year at its end filled up."""
    def filled(short):
        century = F.when(short.cast("int") < 50, "20").otherwise("19")
        return F.when(short != "", F.concat(F.regexp_replace(text, r"\d{2}$", ""), century, short)).otherwise(text)

    return let(F.regexp_extract(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$", 3), filled)


def _dated(text: Column) -> Column:
    serial = F.when(text.rlike(r"^[1-9]\d{4}(\.0+)?$"), F.date_add(F.lit(SERIAL_START).cast("date"), F.regexp_extract(text, r"^(\d{5})", 1).try_cast("int")))
    # A text has one shape, so one format is tried: a parser that fails costs far more than a pattern.
    dated = F.lit(None).cast("date")
    for form, shape in FORMATS.items():
        dated = F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(form)).cast("date")).otherwise(dated)
    return F.coalesce(serial, dated)


def to_day(value: Column) -> Column:
    """A date from the formats above, two-digit years (00-49: 2000s), or a serial number; null if none fits."""
    text = F.regexp_replace(F.trim(value), r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?$", "")
    return let(let(text, _full_year), _dated)


def parse_date(value: Column, kind: str = "R", text: str = "Invalid date") -> Column:
    """The date as MM/dd/yyyy; blank stays blank, what is no date becomes a message."""
    def said(v):
        day = lambda d: F.when(blank(v), F.lit("")).when(d.isNotNull(), F.date_format(d, OUTPUT)).otherwise(message(kind, text, v))
        return unless_message(v, let(to_day(v), day))

    return let(value, said)


def days_between(left: Column, right: Column, absolute: bool = False) -> Column:
    """Days from ``right`` to ``left``, both MM/dd/yyyy; null if either is no date."""
    days = F.datediff(*(F.try_to_timestamp(x, F.lit(OUTPUT)).cast("date") for x in (left, right)))
    return F.abs(days) if absolute else days


def effective_window(value: Column, as_of: Column, past: int = PAST, ahead: int = AHEAD) -> Column:
    """The date, or a clarification if it is missing, ``past`` days or more gone, or over ``ahead`` days ahead."""
    days = F.datediff(F.try_to_timestamp(value, F.lit(OUTPUT)).cast("date"), as_of)
    return unless_message(
        value,
        F.when(blank(value), message("C", "Effective date missing", value))
        .when(days.isNull(), message("C", "Invalid effective date", value))
        .when(days <= -past, message("C", "Effective date too far in the past", value))
        .when(days > ahead, message("C", "Effective date too far in the future", value))
        .otherwise(value),
    )


def birth_date(value: Column, as_of: Column) -> Column:
    """A date after ``as_of`` is taken for one a century earlier."""
    said = lambda day: F.date_format(F.when(day > as_of, F.add_months(day, -1200)).otherwise(day), OUTPUT)
    return F.coalesce(let(to_day(value), said), value)
