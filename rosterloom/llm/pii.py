"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Fixed patterns give the base spans, which are the seeds, each taken whole. Every token with a
digit or an @ and every run of digit groups outside them is a candidate. A pattern is a
neighbouring word, alone or with the coarse or exact shape, or the exact shape. Spark scores
the graph of patterns and instances in rounds: a pattern is as good as the share of its
instances that are known, an instance as sure as its best patterns before, after and in it
together make it. Candidates that good patterns of one kind find become spans of that kind,
if their characters are those of the kind's seeds and their length is near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.shared import cut, few, let, scan, stored, with_row_id

#: The kinds in their order. The patterns are the contract's, with guards and
#: possessive repeats that match the same and keep the time linear on long runs.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Runs of these characters that hold a digit or an @ are candidates.
TOKEN = r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
#: Groups of digits that blanks or brackets join are candidates too.
GROUPS = r"(?<![A-Za-z0-9._%+@-])[+(]{0,2}+[0-9]++(?:[\x20().-]{1,3}[0-9]++){1,7}(?![A-Za-z0-9_%@])"
#: A length class of digits ends before each of these numbers.
DIGITS = (7, 10, 14, 20)
#: The digit groups at the end of a phone number stand for it if they have so many digits.
LOCAL = 7
#: Least share of known instances and least number of known instances of a good pattern; least
#: certainty of a new instance.
PRECISION, SUPPORT, CERTAIN = 0.6, 5, 0.8
#: Up to so many texts' found spans are broadcast; beyond it they are joined by shuffle.
BROADCAST_TEXTS = 100_000
#: Characters of the pieces that a text with spans is cut into.
PIECE = 4096


def _cuts(text: Column, pattern: str, build) -> Column:
    """``build(places)`` of the matches of ``pattern``: structs of start, end, found, and the text before and after.

    That text goes to the next match, and over it if there is no word between.
    """
    def placed(x):
        piece, found = lambda i: F.get(x["pieces"], i), lambda i: F.coalesce(F.get(x["found"], i), F.lit(""))
        before = lambda i: F.when((i > 0) & piece(i).rlike(r"^\s*+$"), found(i - 1)).otherwise(piece(i))
        after = lambda i: F.when(piece(i + 1).rlike(r"^\S*+\s++$"), F.concat(piece(i + 1), found(i + 1))).otherwise(piece(i + 1))
        start = lambda at, i: at + F.length(piece(i))
        end = lambda at, i: start(at, i) + F.length(F.get(x["found"], i))
        place = lambda at, i: F.struct(start(at, i).alias("start"), end(at, i).alias("end"), F.get(x["found"], i).alias("found"), before(i).alias("before"), after(i).alias("after"))
        empty = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")
        numbers = let(F.sequence(F.lit(0), F.size(x["found"]) - 1), lambda n: scan(n, F.lit(0), end, place, "struct<start:int,end:int,found:string,before:string,after:string>"))
        return F.when(F.size(x["found"]) == 0, empty).otherwise(numbers)

    whole = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(let(whole, placed), build)


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _base_places(text: Column) -> Column:
    """Array of (start, kind number, end, found, before, after) of the base spans, in order."""
    def of(kind):
        number = KINDS.index(kind)
        placed = lambda p: F.struct(p["start"].alias("start"), F.lit(number).alias("kind"), p["end"].alias("end"), p["found"].alias("found"), p["before"].alias("before"), p["after"].alias("after"))
        good = lambda places: F.transform(F.filter(places, lambda p: _valid(kind, p["found"])), placed)
        needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string,before:string,after:string>>")
        return F.when(needed, _cuts(text, PATTERNS[kind], good)).otherwise(none)

    return F.sort_array(F.concat(*map(of, KINDS)))


def _narrow(places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end) of the base spans, in order; code points, end exclusive."""
    return _narrow(_base_places(text))


def _instance(found: Column) -> Column:
    """What mentions of one identifier have in common: lower case; only the digits, if there are just digits and separators and no four short groups with dots."""
    digits = found.rlike(r"^[+0-9\x20().-]+$") & ~found.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    return F.when(digits, F.regexp_replace(found, "[^0-9]", "")).otherwise(F.lower(found))


def _coarse(instance: Column) -> tuple[Column, Column]:
    """Kind of characters and length class of an instance."""
    only = instance.rlike("^[0-9]+$")
    kind = F.when(instance.rlike("^[^@]+@[^@]+$"), "@").when(instance.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), ".").when(only, "9").otherwise("a")
    length = sum(((F.length(instance) >= n).cast("int") for n in DIGITS), F.lit(0))
    return kind, F.when(only, length).otherwise(0)


def _mention(start: Column, end: Column, instance: Column, found: Column, before: Column, after: Column, seed: Column, part: bool) -> Column:
    exact = F.regexp_replace(F.regexp_replace(found, "[A-Za-z]+", "a"), "[0-9]", "9")
    coarse = F.concat(*(c.cast("string") for c in _coarse(instance)))
    blanks = lambda x: F.translate(x, "\t\n\x0b\f\r", "     ")
    left = F.substring_index(F.rtrim(blanks(before)), " ", -1)
    right = F.coalesce(F.get(F.split(blanks(after), " +", 3), F.lit(1)), F.lit(""))
    context = lambda side, word, *shape: F.when(word != "", F.concat_ws(" ", F.lit(side), F.lower(word), *shape))
    beside = [context(side, word, *shape) for side, word in (("<", left), (">", right)) for shape in ((), (F.lit("~"), coarse), (F.lit("="), exact))]
    return F.struct(start.alias("start"), end.alias("end"), instance.alias("instance"), F.array_compact(F.array(*beside, F.concat(F.lit("= "), exact))).alias("patterns"), seed.alias("seed"), F.lit(part).alias("part"))


def _candidates(text: Column, base: str) -> Column:
    """Mentions of the tokens with a digit or an @ and of the digit groups that overlap no base span."""
    def trimmed(p):
        found = F.regexp_replace(p["found"], r"(?<![._%-])[._%-]++$", "")
        return F.struct(p["start"].alias("start"), (p["start"] + F.length(found)).alias("end"), found.alias("found"), p["before"].alias("before"), p["after"].alias("after"))

    one = lambda p: let(_instance(p["found"]), lambda i: _mention(p["start"], p["end"], i, p["found"], p["before"], p["after"], F.lit(-1), False))
    build = lambda places: F.transform(_free(F.transform(places, trimmed), F.col(base)), one)
    return F.concat(_cuts(text, TOKEN, build), _cuts(text, GROUPS, build))


def _free(places: Column, base: Column) -> Column:
    """The places that overlap no base span: one pass sees the ends of spans before them, one the starts of spans after."""
    fields = ["start", "kind", "end", "found", "before", "after"]
    typed = F.transform(places, lambda p: F.struct(*((F.lit(len(KINDS)) if f == "kind" else p[f]).alias(f) for f in fields)))
    is_base = lambda x: x["kind"] < len(KINDS)

    def of(every):
        before = scan(every, F.lit(0), lambda s, x: F.when(is_base(x), F.greatest(s, x["end"])).otherwise(s), lambda s, x: s > x["start"], "boolean")
        after = let(F.reverse(every), lambda r: F.reverse(scan(r, F.lit(2**31 - 1), lambda s, x: F.when(is_base(x), x["start"]).otherwise(s), lambda s, x: s < x["end"], "boolean")))
        free = let(F.struct(before.alias("before"), after.alias("after")), lambda f: F.filter(every, lambda x, i: ~is_base(x) & ~F.get(f["before"], i) & ~F.get(f["after"], i)))
        return F.transform(free, lambda p: F.struct(*(p[f].alias(f) for f in fields if f != "kind")))

    plain = F.transform(places, lambda p: F.struct(*(p[f].alias(f) for f in fields if f != "kind")))
    return F.when((F.size(base) == 0) | (F.size(places) == 0), plain).otherwise(let(F.sort_array(F.concat(base, typed)), of))


def _seeds(places: Column) -> Column:
    """Mentions of the base spans, and of the ends of phone numbers, which are written without what is before them too."""
    def whole(p):
        return let(_instance(p["found"]), lambda i: _mention(p["start"], p["end"], i, p["found"], p["before"], p["after"], p["kind"], False))

    def ends(p):
        groups = F.filter(F.split(p["found"], "[^0-9]+"), lambda g: g != "")

        def of(g):
            last = F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_join(F.slice(g, i + 1, F.size(g)), ""))
            return F.transform(F.filter(last, lambda d: F.length(d) >= LOCAL), lambda d: _mention(p["start"], p["end"], d, d, p["before"], p["after"], p["kind"], True))

        return let(groups, of)

    phones = F.filter(places, lambda p: p["kind"] == KINDS.index("phone"))
    return F.concat(F.transform(places, whole), F.flatten(F.transform(phones, ends)))


def _discover(mentions: DataFrame) -> DataFrame:
    """Instances that good patterns find, seeds among them: instance and kind.

    What is found counts as known in the next round, until a round finds nothing more.
    """
    edges = mentions.select("instance", "seed", "part", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance")
    edges = cut(edges.agg(F.max("seed").alias("seed"), F.max(F.when(~F.col("part"), F.col("seed"))).alias("whole")))
    seeds = sure = cut(edges.filter("seed >= 0").groupBy("instance").agg(F.max("seed").alias("kind"), F.max("whole").alias("whole")).withColumn("certain", F.lit(1.0)))
    found = None
    sure = sure.drop("whole")
    characters, length = _coarse(F.col("instance"))
    fits = seeds.filter("whole >= 0").groupBy("kind", characters.alias("characters")).agg((F.min(length) - 1).alias("least"), (F.max(length) + 1).alias("most"))
    fits = F.broadcast(cut(fits))
    while True:
        known = edges.filter("whole IS NOT NULL").select("pattern", "instance").join(sure, "instance", "left")
        counted = known.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("certain").alias("good"))
        total = counted.groupBy("pattern").agg(F.sum("n").alias("total"), F.max(F.struct(F.coalesce("good", F.lit(0.0)), "kind")).alias("best"))
        best = total.select("pattern", F.col("best.kind").alias("kind"), (F.col("best.col1") / F.col("total")).alias("share"), F.col("best.col1").alias("support"))
        best = cut(best.filter((F.col("share") >= PRECISION) & (F.col("support") >= SUPPORT)))
        voted = edges.select("pattern", "instance").join(few(best, BROADCAST_TEXTS), "pattern").groupBy("instance", "kind")
        unsure = [1 - F.coalesce(F.max(F.when(F.left("pattern", F.lit(1)) == side, F.col("share"))), F.lit(0.0)) for side in "<>="]
        voted = voted.agg((1 - unsure[0] * unsure[1] * unsure[2]).alias("certain")).withColumns({"characters": characters, "length": length})
        voted = cut(voted.join(fits, ["kind", "characters"]).filter("length BETWEEN least AND most").select("instance", "kind", "certain"))
        chosen = voted.groupBy("instance").agg(F.max(F.struct("certain", "kind")).alias("best"))
        chosen = chosen.select("instance", "best.kind", "best.certain").filter(F.col("certain") >= CERTAIN)
        fresh = cut(chosen if found is None else chosen.join(found.select("instance"), "instance", "left_anti"))
        found = fresh if found is None else cut(found.unionByName(fresh))
        if fresh.isEmpty():
            break
        sure = cut(seeds.select("instance", "kind", "certain").unionByName(found.join(seeds.select("instance"), "instance", "left_anti")))
    return found.join(seeds.select("instance", F.col("kind").alias("seed")), "instance", "left").filter("seed IS NULL OR seed = kind").select("instance", "kind")


def _outer(found: Column) -> Column:
    """Array of (start, kind, end) of the spans (start, less end, kind), in order, that lie in no span before them."""
    span = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["end"]).alias("end"))
    fresh = scan(found, F.lit(0), lambda at, s: F.greatest(at, -s["end"]), lambda at, s: F.when(-s["end"] > at, span(s)), "struct<start:int,kind:int,end:int>")
    return F.array_compact(fresh)


def find_spans(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of every row, with ``base`` and ``spans``.

    Both are arrays of (start, kind, end) by start, then kind as listed, then end; ``kind`` is
    a number of ``KINDS``. Null and empty texts have no spans; very long texts are searched
    whole, in time near linear; repeated rows and rows with equal or null doc_id stay apart, and
    repeats support a pattern once; of two kinds equally certain the last listed is taken; an
    empty table gives none; columns that are not kept may have any name. Found spans never
    overlap a base span.
    """
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_row_id(documents.select(*dict.fromkeys([*keep, "text"]))).withColumn("_text", text)
    rows = rows.withColumn("_places", _base_places(F.col("_text")))
    tokens = F.when(F.col("_text").rlike("[0-9@]"), F.concat(_seeds(F.col("_places")), _candidates(F.col("_text"), "_places")))
    rows = stored(rows.select("_row", *keep, _narrow(F.col("_places")).alias("base"), tokens.alias("tokens")))
    mentions = cut(rows.filter(F.size("tokens") > 0).select("_row", F.explode("tokens").alias("t")).select("_row", "t.*"))
    found = cut(_discover(mentions))
    extra = mentions.filter("seed < 0").select("_row", "start", "end", "instance").join(few(found, BROADCAST_TEXTS), "instance")
    extra = extra.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("end")).alias("end"), "kind"))).alias("extra"))
    extra = cut(extra.select("_row", _outer(F.col("extra")).alias("extra")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(few(extra, BROADCAST_TEXTS), "_row", "left").select(*keep, "base", F.sort_array(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def span_text(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: str) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    name = F.array(*map(F.lit, KINDS))
    number = lambda at: F.floor(at / PIECE).cast("int")

    def of(pieces):
        def part(start, end):  # of the text, from the pieces that it lies in
            inside = F.array_join(F.slice(pieces, number(start) + 1, number(end - 1) - number(start) + 1), "")
            return F.when(end > start, F.substring(inside, start % PIECE + 1, end - start)).otherwise("")

        after = lambda at, s: F.greatest(at, s["end"])
        out = lambda at, s: F.when(s["start"] >= at, F.concat(part(at, s["start"]), F.lit("["), F.get(name, s["kind"]), F.lit("]"))).otherwise("")
        rest = let(F.array_max(F.transform(spans, lambda s: s["end"])), lambda end: part(end, F.length(text)))
        return F.concat(F.array_join(scan(F.col(spans), F.lit(0), after, out, "string"), ""), rest)

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of)).otherwise(text)
