"""Working hours as text: day ranges and times to a map of day to opening and closing time, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions.text import let

#: Days by their first three letters, in order, and words for groups of them.
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
GROUPS = {"daily": DAYS, "everyday": DAYS, "every day": DAYS, "weekdays": DAYS[:5], "weekday": DAYS[:5], "weekends": DAYS[5:], "weekend": DAYS[5:]}

_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun|m|tu|w|th|f|sa|su)[a-z]*"
_TO, _AND = r"\s*(?:-|–|to|thru|through)\s*", r"\s*(?:,|&|and|/)\s*"
_ALWAYS = r"^\s*24\s*(/\s*7|hours( a day)?|hrs)\s*$"
#: Days, then closed, all day, or hour, minute and half of the opening and of the closing time.
_PART = (
    rf"({'|'.join(GROUPS)}|{_DAY}(?:\s*(?:-|–|to|thru|through|,|&|and|/)\s*{_DAY})*)[\s:.]*"
    r"(?:(closed)|(24\s*(?:hours|hrs|h)?|24\s*/\s*7)(?![:\d])|"
    rf"(\d{{1,2}})(?::?(\d{{2}}))?\s*([ap])?\.?m?\.?{_TO}(\d{{1,2}})(?::?(\d{{2}}))?\s*([ap])?\.?m?\.?)"
)
_ALL_DAY = ("12:00AM", "11:59PM")
#: Stands between the groups of a part; no text of working hours has it.
_BREAK = "\x01"


def _table(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _number(name: Column) -> Column:
    """The day that a name stands for, by its first three, two or one letters."""
    of = [{day[:size]: i for i, day in reversed(list(enumerate(DAYS)))} for size in (3, 2, 1)]
    return F.coalesce(*(F.try_element_at(_table(t), F.substring(name, 1, size)) for t, size in zip(of, (3, 2, 1))))


def _days(text: Column) -> Column:
    every = F.array(*map(F.lit, DAYS))

    def span(names):
        first, last = _number(names[0]), _number(F.element_at(names, -1))
        return F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(7))), lambda k: F.get(every, F.pmod(first + k, F.lit(7))))

    spans = F.transform(F.split(text, _AND), lambda x: let(F.filter(F.split(x, _TO), lambda n: n != ""), span))
    groups = F.create_map(*(c for name, days in GROUPS.items() for c in (F.lit(name), F.array(*map(F.lit, days)))))
    return F.coalesce(F.try_element_at(groups, F.trim(text)), F.flatten(spans))


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(two(F.pmod(hour - 1, F.lit(12)) + 1), F.lit(":"), two(minute), F.upper(half), F.lit("M"))


def _entries(part: Column) -> Column:
    """Array of (day, start, end) of one part; a missing half of the day is taken so that opening comes before closing."""
    # One match gives all groups of the pattern; each is then named as often as needed.
    groups = F.split(F.regexp_replace(part, _PART, _BREAK.join(f"${i}" for i in range(1, 10))), _BREAK, -1)
    number = lambda g, i: F.coalesce(g[i - 1].try_cast("int"), F.lit(0))
    read = lambda g: let(F.struct(g[0].alias("days"), (g[1] != "").alias("closed"), (g[2] != "").alias("always"), number(g, 4).alias("a"), number(g, 5).alias("m"), g[5].alias("first"), number(g, 7).alias("b"), number(g, 8).alias("n"), g[8].alias("last")), _timed)
    return let(groups, read)


def _timed(said: Column) -> Column:
    a, m, b, n = said["a"], said["m"], said["b"], said["n"]
    half = lambda text, hour: F.when(text != "", text).when(hour > 12, F.lit("p"))
    good = (F.greatest(m, n) <= 59) & (F.greatest(a, b) <= 24)

    def of_halves(halves):
        last = halves["last"]
        noon = (a == 12) | F.coalesce((last == "p") & (a % 12 < b % 12) & (a % 12 < 6), F.lit(False))
        return let(F.coalesce(halves["first"], F.when(noon, F.lit("p")).otherwise("a")), lambda first: of_first(first, last))

    def of_first(first, last):
        last = F.coalesce(last, F.when((first == "a") & (b % 12 > a % 12) & (b >= 9) & (b != 12) & (a < 6), F.lit("a")).otherwise("p"))
        start = F.when(said["always"], F.lit(_ALL_DAY[0])).when(good, _clock(a, m, first))
        end = F.when(said["always"], F.lit(_ALL_DAY[1])).when(good, _clock(b, n, last))
        return F.when(~said["closed"] & (said["always"] | good), F.struct(start.alias("start"), end.alias("end")))

    def daily(h):
        days = F.transform(_days(said["days"]), lambda d: F.struct(d.alias("day"), h["start"].alias("start"), h["end"].alias("end")))
        return F.when(h.isNull(), F.array().cast("array<struct<day:string,start:string,end:string>>")).otherwise(days)

    return let(let(F.struct(half(said["first"], a).alias("first"), half(said["last"], b).alias("last")), of_halves), daily)


def working_hours(text: Column) -> Column:
    """Map of day to its start and end as hh:mmAM; what comes later counts, null and free text give an empty map."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def by_day(entries):
        def of(day):
            own = lambda e: F.struct(F.lit(day).alias("key"), F.struct(e["start"].alias("start"), e["end"].alias("end")).alias("value"))
            return let(F.try_element_at(F.filter(entries, lambda e: e["day"] == day), F.lit(-1)), lambda e: F.when(e.isNotNull(), own(e)))

        return F.map_from_entries(F.array_compact(F.array(*map(of, DAYS))))

    always = F.array(*(F.struct(F.lit(d).alias("day"), F.lit(_ALL_DAY[0]).alias("start"), F.lit(_ALL_DAY[1]).alias("end")) for d in DAYS))
    parts = lambda text: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)), _entries))
    found = let(low, lambda text: F.when(text.rlike(_ALWAYS), always).otherwise(parts(text)))
    return let(found, by_day)


def without_break(hours: Column, start: str, end: str) -> Column:
    """The hours before and after a break, as pairs; clock texts as parsed above."""
    minutes = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit("hh:mma"))) / 60
    a, b = minutes(hours["start"]), minutes(hours["end"])
    s, e = minutes(F.lit(start)), minutes(F.lit(end))
    pair = lambda x, y: F.struct(x.alias("start"), y.alias("end"))
    whole = F.array(pair(hours["start"], hours["end"]))
    return F.when((a < s) & (e < b), F.array(pair(hours["start"], F.lit(start)), pair(F.lit(end), hours["end"]))).otherwise(whole)
