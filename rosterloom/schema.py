"""Names of canonical columns: ``TAG@FIELD[#GROUP]@SET``, and the plan-time work on headers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.functions import text

#: The columns that make a record, and the tokens that are read as missing.
RECORD_KEY = ["FINAL_NPI", "TAX_ID", "NAME_FIRST", "NAME_LAST", "VALIDATED_ACTION"]
MISSING = ["na", "n/a", "None", "none", "Na"]
#: Full match, least match that counts, and the weight of a partial one, in percent.
FULL_MATCH, LEAST_MATCH, PARTIAL_WEIGHT = 100, 70, 90
#: Fixed value: a header takes a field only above this score, in percent.
LEAST_SCORE = 75.0

_NAME = re.compile(r"^(?P<tag>[^@]+)@(?P<field>[^@#]+)(#(?P<group>\d+))?@(?P<set>\d+)$")


@dataclass(frozen=True)
class ColumnRef:
    """One repeated field of a wide roster: its tag, field, nested group number and set number."""

    tag: str
    field: str
    set: int
    group: int | None = None

    @classmethod
    def parse(cls, name: str) -> ColumnRef | None:
        found = _NAME.match(name)
        if not found:
            return None
        return cls(found["tag"], found["field"], int(found["set"]), None if found["group"] is None else int(found["group"]))

    @property
    def name(self) -> str:
        return f"{self.tag}@{self.field}{'' if self.group is None else f'#{self.group}'}@{self.set}"

    @property
    def indicator(self) -> str:
        """The part of an address tag before its type: PRIM of PRIM_PLSV, nothing of PLSV."""
        return self.tag.partition("_")[0] if "_" in self.tag else ""

    @property
    def type(self) -> str:
        return self.tag.partition("_")[2] or self.tag


def repeated(frame: DataFrame) -> dict[str, ColumnRef]:
    """The columns of ``frame`` that follow the grammar."""
    return {c: ref for c in frame.columns if (ref := ColumnRef.parse(c))}


def clean_headers(headers: list[str | None]) -> list[str]:
    """Lower case, line ends to blanks, blanks named, duplicates numbered .1, .2, ..."""
    seen: dict[str, int] = {}
    out = []
    for header in headers:
        name = re.sub(r"\s*\n\s*", " ", header or "").strip().lower() or "empty_column"
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(f"{name}.{count}" if count else name)
    return out


def header_row(rows: list[list[str | None]]) -> int:
    """The first row that is filled to the sheet's width, else the first with a value."""
    width = max((sum(bool(c and c.strip()) for c in row) for row in rows), default=0)
    filled = [sum(bool(c and c.strip()) for c in row) for row in rows]
    return next((i for i, n in enumerate(filled) if n == width and n), next((i for i, n in enumerate(filled) if n), 0))


def format_match(headers: list[str], saved: list[str]) -> int:
    """Percent that ``saved`` fits: 100 if equal, else the common share times 90, and 0 below 70."""
    if headers == saved:
        return FULL_MATCH
    common = len(set(headers) & set(saved))
    percent = common * PARTIAL_WEIGHT // max(1, len(headers), len(saved))
    return percent if percent >= LEAST_MATCH else 0


def match_formats(files: DataFrame, saved: DataFrame) -> DataFrame:
    """file, format and percent of every pair with a header in common, and ``best``: the format that fits a file best.

    ``files`` has file, place and header, ``saved`` has format, place and header. The percent is
    that of ``format_match``, and ties go to the lowest format, as in ``best_format``.
    """
    listed = lambda frame, key: frame.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "header"))).alias("_rows")).select(key, F.transform("_rows", lambda r: r["header"]).alias("_list"))
    a, b = listed(files, "file"), listed(saved, "format").withColumnRenamed("_list", "_saved")
    shared = files.select("file", "header").distinct().join(saved.select("format", "header").distinct(), "header").groupBy("file", "format").agg(F.count("*").alias("_common"))
    pairs = shared.join(a, "file").join(b, "format")
    percent = F.floor(F.col("_common") * PARTIAL_WEIGHT / F.greatest(F.size("_list"), F.size("_saved"))).cast("int")
    percent = F.when(F.col("_list") == F.col("_saved"), FULL_MATCH).when(percent >= LEAST_MATCH, percent).otherwise(0)
    pairs = pairs.select("file", "format", percent.alias("percent"))
    first = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("percent"), "format")) == 1
    return pairs.withColumn("best", first & (F.col("percent") > 0))


def best_format(headers: list[str], saved: dict[str, list[str]]) -> tuple[str | None, int]:
    """The saved format that fits best; ties go to the lowest key."""
    scored = [(-format_match(headers, columns), key) for key, columns in saved.items()]
    percent, key = min(scored, default=(0, None))
    return (key, -percent) if percent else (None, 0)


def map_headers(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Header by canonical field: the first alias that is a header wins, and a header is used once."""
    free, found = set(headers), {}
    for field, names in aliases.items():
        hit = next((n for n in names if n in free), None)
        if hit is not None:
            found[field] = hit
            free.discard(hit)
    return found


def map_repeated(headers: list[str], fields: dict[str, list[str]], tag: str = "GENERAL", starts: str | None = None, groups: frozenset[str] = frozenset()) -> dict[str, ColumnRef]:
    """Columns of repeated fields in header order.

    A new set begins at the field ``starts``, or whenever a field comes again that is not
    in ``groups``; a field of ``groups`` that comes again in a set begins a new group.
    """
    where = {alias: field for field, names in fields.items() for alias in names}
    out: dict[str, ColumnRef] = {}
    number, used = -1, {}
    for header in headers:
        field = where.get(header)
        if field is None:
            continue
        again = field in used and field not in groups
        if number < 0 or field == starts or (starts is None and again):
            number, used = number + 1, {}
        used[field] = used.get(field, -1) + 1
        out[header] = ColumnRef(tag, field, number, used[field] if field in groups else None)
    return out


def alias_scores(headers: DataFrame, aliases: dict[str, list[str]], least: float = LEAST_SCORE) -> DataFrame:
    """header, field and score of each distinct header with each field that has an alias like it, by the best of its aliases.

    The score is ``text.match_percent`` of both in lower case; only those above ``least`` are given.
    Two texts of the longer length n that differ in k letters have n + 1 - 2k of their pairs of
    neighbouring letters (with the ends) in common at least, so candidates are found by those pairs.
    """
    spark = headers.sparkSession
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.concat(F.lit("\x02"), c, F.lit("\x03")), i, F.lit(2)))
    # Equal pairs of one text are numbered, so that what two texts have in common is counted as often as both have it.
    numbered = lambda frame, key: frame.groupBy(*key, "pair").agg(F.count("*").alias("n")).select(*key, "pair", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("n"))
    known = spark.createDataFrame([(field, a.lower()) for field, own in aliases.items() for a in own] or [("", "")], "field string, alias string").filter("field != ''").distinct()
    asked = headers.select(F.lower("header").alias("text")).distinct().filter("text != ''")
    of_alias = numbered(known.select("alias").distinct().select("alias", F.explode(pairs(F.col("alias"))).alias("pair")), ["alias"])
    of_text = numbered(asked.select("text", F.explode(pairs(F.col("text"))).alias("pair")), ["text"])
    common = of_text.join(F.broadcast(of_alias), ["pair", "n"]).groupBy("text", "alias").agg(F.count("*").alias("common"))
    longer = F.greatest(F.length("text"), F.length("alias"))
    near = common.filter(F.col("common") >= longer + 1 - 2 * F.floor(longer * (100 - least) / 100))
    scored = near.withColumn("score", text.match_percent(F.col("text"), F.col("alias"))).filter(F.col("score") > least)
    best = scored.join(F.broadcast(known), "alias").groupBy("text", "field").agg(F.max("score").alias("score"))
    return headers.select("header").distinct().join(best, F.lower("header") == F.col("text")).select("header", "field", "score")


def assign_headers(files: DataFrame, aliases: dict[str, list[str]], counts: dict[str, int] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """``files`` (file, place, header) with the field and score that each header takes, null if none is left for it.

    In the order of their places, the headers of a file take their best field that is still free, of equals
    the first by name. A field is taken once, or as often as ``counts`` says. All distinct headers are
    scored together; each file's headers are then one row, and taking turns is a fold over it.
    """
    candidates = alias_scores(files, aliases, least).groupBy("header").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "field"))).alias("candidates"))
    none = F.array().cast(candidates.schema["candidates"].dataType)
    rows = files.join(candidates, "header", "left").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "header", F.coalesce("candidates", none).alias("candidates")))).alias("rows"))
    limits = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)) if counts else None
    limit = lambda field: F.lit(1) if limits is None else F.coalesce(F.try_element_at(limits, field), F.lit(1))
    taken_type = "array<struct<place:bigint,header:string,field:string,score:double>>"

    def take(done, row):
        free = F.filter(row["candidates"], lambda c: F.size(F.filter(done, lambda d: d["field"] == c["field"])) < limit(c["field"]))
        chosen = lambda c: F.array_append(done, F.struct(row["place"].cast("long").alias("place"), row["header"].alias("header"), c["field"].alias("field"), (-c["rank"]).alias("score")))
        return F.transform(F.array(F.get(free, F.lit(0))), chosen)[0]

    taken = rows.select("file", F.explode(F.aggregate("rows", F.array().cast(taken_type), take)).alias("of"))
    return taken.select("file", "of.place", "of.header", "of.field", "of.score")


def drift_rows(files: DataFrame, saved: list[str]) -> DataFrame:
    """file, header and state (new, removed, unchanged) of every file (file, header) against the headers of a saved format."""
    held = files.select("file", "header").distinct()
    wanted = held.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, saved))).alias("header")).withColumn("_saved", F.lit(True))
    both = held.withColumn("_there", F.lit(True)).join(wanted, ["file", "header"], "full")
    return both.select("file", "header", F.when(F.col("_saved").isNull(), "new").when(F.col("_there").isNull(), "removed").otherwise("unchanged").alias("state"))


def drift(headers: list[str], saved: list[str]) -> dict[str, list[str]]:
    """What is new, removed and unchanged against a saved format."""
    return {
        "new": [h for h in headers if h not in set(saved)],
        "removed": [s for s in saved if s not in set(headers)],
        "unchanged": [h for h in headers if h in set(saved)],
    }
