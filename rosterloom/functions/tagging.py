"""Address lines, taken apart by a sequence model: the cheapest path of tags over the words of a line.

A ``Model`` says what it costs that a tag follows another (inside a part of the line, or after a comma)
and that a word of some class has a tag. The path is found by an ``aggregate`` over the words, all in Spark expressions.
``DEFAULT`` is a small table of costs; ``learned`` takes them from tagged lines.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.errors import message
from rosterloom.functions.text import let

TAGS = ["begin", "recipient", "number", "pre", "street", "type", "post", "box_type", "box", "unit_type", "unit", "city", "state", "zip"]
CLASSES = ["zip", "number", "ordinal", "direction", "type", "unit", "box", "state", "id", "word", "any"]
#: What a step costs that a model doesn't name, and one that can't be.
RARE, NEVER = 15, 10_000

#: Words that end a street name, directions, words before a unit or box, states.
STREETS = ["street", "st", "avenue", "ave", "av", "road", "rd", "boulevard", "blvd", "drive", "dr", "lane", "ln", "court", "ct", "parkway", "pkwy", "highway", "hwy", "place", "pl", "way", "circle", "cir", "terrace", "ter", "square", "sq", "plaza", "trail", "pike", "loop"]
DIRECTIONS = ["north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest", "n", "s", "e", "w", "ne", "nw", "se", "sw"]
UNITS = ["suite", "ste", "unit", "apt", "apartment", "floor", "fl", "room", "rm", "building", "bldg", "dept", "#"]
BOXES = ["po", "p", "o", "post", "office", "box", "pob"]
STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA PR RI SC SD TN TX UT VT VA WA WV WI WY".lower().split()
STATE_NAMES = "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah vermont virginia washington wisconsin wyoming".split()

# tag: what may follow it, with the cost inside a part and after a comma
_MOVES = """
begin: number 0 0, recipient 2 2, box_type 0 0, street 4 4, pre 5 5, unit_type 4 4, city 6 6, state 8 8, zip 8 8
recipient: recipient 0 6, number 2 0, box_type 2 0, street 8 4, unit_type 5 3
number: pre 0 6, street 0 6, number 4 6, type 6 9
pre: street 0 6, type 5 9, pre 6 9
street: street 1 6, type 0 6, post 1 6, unit_type 2 1, city 5 0, state 7 5, box_type 4 2, unit 6 5
type: post 0 6, unit_type 1 0, city 2 0, street 5 8, type 4 9, box_type 3 1, state 7 5, unit 5 4
post: unit_type 1 0, city 2 0, box_type 3 1, state 7 5, unit 5 4
box_type: box_type 0 6, box 0 6
box: unit_type 2 1, city 2 0, number 4 3, state 7 4
unit_type: unit 0 4, unit_type 3 5
unit: unit 3 5, city 2 0, unit_type 2 1, state 6 3, number 4 4
city: city 0 6, state 0 0, zip 2 1
state: zip 0 0, state 5 9
zip: zip 6 6
"""
# tag: what it costs that a line ends with it
_ENDS = "zip 0, state 1, city 2, unit 2, type 2, post 2, street 2, box 2, number 5, recipient 6, pre 6, unit_type 6, box_type 6"
# class: the tags of such a word
_WORDS = """
zip: zip 0, number 2, unit 4, box 2
number: number 0, unit 1, box 0, street 5, zip 6
ordinal: street 0, unit 3
direction: pre 0, post 0, street 3, city 2, recipient 5
type: type 0, street 3, city 4, recipient 5
unit: unit_type 0, street 6, city 6, recipient 5
box: box_type 0, street 5
state: state 0
id: unit 0, number 3, box 1, street 4
word: street 1, city 1, recipient 1, unit 4
any: begin 10000
"""


@dataclass(frozen=True)
class Model:
    """Costs: ``moves[comma][tag]`` of the tags before it, ``ends`` of the last tag, ``words[class]`` of the tags; all in the order of ``TAGS``."""

    moves: list[list[list[int]]]
    ends: list[int]
    words: list[list[int]]


def _costs(text: str) -> dict[str, list[int]]:
    return {part.split()[0]: [int(c) for c in part.split()[1:]] for part in text.split(", ")}


def _model(moves: str, ends: str, words: str) -> Model:
    follow = {a: _costs(rest) for a, rest in (line.split(": ") for line in moves.strip().splitlines())}
    classes = {k: _costs(rest) for k, rest in (line.split(": ") for line in words.strip().splitlines())}
    last = _costs(ends)
    return Model(
        [[[NEVER if b == "begin" else follow[a].get(b, [RARE, RARE])[comma] for a in TAGS] for b in TAGS] for comma in (0, 1)],
        [last.get(t, [RARE])[0] for t in TAGS],
        [[classes[k].get(t, [RARE])[0] for t in TAGS] for k in CLASSES],
    )


DEFAULT = _model(_MOVES, _ENDS, _WORDS)


def line_words(line: Column) -> Column:
    """text and comma (whether one stands before it) of each word of a line; dots go, and # is a word. Empty for a null or blank line."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), "[.]", ""), "#", " # ")
    marked = F.trim(F.regexp_replace(F.regexp_replace(spaced, r"\s*,[\s,]*", " ,"), r"\s+", " "))
    found = F.filter(F.split(marked, " "), lambda w: ~w.isin("", ","))
    return F.transform(found, lambda w: F.struct(F.ltrim(w, F.lit(",")).alias("text"), w.startswith(",").alias("comma")))


def word_classes(word: Column) -> list[Column]:
    """Whether a word, in lower case, is of each of ``CLASSES``; of the last one all are."""
    shaped = [word.rlike(p) for p in (r"^\d{5}(-\d{4})?$", r"^\d+[a-z]?(-\d+)?$", r"^\d+(st|nd|rd|th)$")]
    listed = [word.isin(names) for names in (DIRECTIONS, STREETS, UNITS, BOXES, STATES + STATE_NAMES)]
    return [*shaped, *listed, word.rlike(r"^([a-z]|[a-z]-?\d+[a-z]?|\d+-?[a-z]+)$"), word.rlike(r"\p{L}"), F.lit(True)]


def _numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<bigint>")


def tags(words: Column, model: Model = DEFAULT) -> Column:
    """The cheapest tags of ``line_words``, an array of their places in ``TAGS``.

    A word costs what its cheapest class does. Of equal paths, the one whose last tag stands first in ``TAGS``
    is taken, then by the tag before it, and so on. No words give no tags.
    """
    size = len(TAGS)
    # A cost is held times the number of tags, so that the cheapest tag before it fits into its remainder.
    steps = [F.array(*(_numbers([c * size + i for i, c in enumerate(row)]) for row in model.moves[comma])) for comma in (0, 1)]
    classes = F.array(*(_numbers([c * size for c in row]) for row in model.words))

    def cost(word):
        held = let(F.lower(word["text"]), lambda low: F.filter(F.transform(F.array(*word_classes(low)), lambda c, i: F.when(c, i)), lambda i: i.isNotNull()))
        return F.aggregate(held, _numbers([NEVER * size] * size), lambda best, k: F.zip_with(best, F.get(classes, k), lambda a, b: F.least(a, b)))

    def step(state, word):
        table = F.when(word["comma"], steps[1]).otherwise(steps[0])
        reached = F.transform(table, lambda row: F.array_min(F.zip_with(state["cost"], row, lambda c, m: c + m)))
        return let(
            reached,
            lambda r: F.struct(
                F.zip_with(r, cost(word), lambda c, w: c - c % size + w).alias("cost"),
                F.concat(state["back"], F.array(F.transform(r, lambda c: (c % size).cast("int")))).alias("back"),
            ),
        )

    start = F.struct(_numbers([0] + [NEVER * size] * (size - 1)).alias("cost"), F.array().cast("array<array<int>>").alias("back"))

    def path(state):
        last = F.array_min(F.zip_with(state["cost"], _numbers([c * size + i for i, c in enumerate(model.ends)]), lambda c, e: c + e)) % size
        whole = F.aggregate(
            F.reverse(state["back"]), F.struct(last.cast("int").alias("at"), F.array().cast("array<int>").alias("path")),
            lambda s, back: F.struct(F.get(back, s["at"]).alias("at"), F.concat(s["path"], F.array(s["at"])).alias("path")),
        )
        return F.reverse(whole["path"])

    return F.aggregate(words, start, step, path)


def tagged_words(line: Column, model: Model = DEFAULT) -> Column:
    """text, comma and tag (by name) of each word of a line."""
    names = F.array(*(F.lit(t) for t in TAGS))
    return let(line_words(line), lambda words: F.zip_with(words, tags(words, model), lambda w, t: F.struct(w["text"].alias("text"), w["comma"].alias("comma"), F.get(names, t).alias("tag"))))


def _of(words: Column, *wanted: str) -> Column:
    return F.array_join(F.transform(F.filter(words, lambda w: w["tag"].isin(*wanted)), lambda w: w["text"]), " ")


def address_parts(line: Column, model: Model = DEFAULT) -> Column:
    """recipient, number, direction, street, type, post_direction, unit, box, city, state and zip of an address line; blank where absent."""
    return let(
        tagged_words(line, model),
        lambda w: F.struct(
            _of(w, "number").alias("number"), _of(w, "pre").alias("direction"), _of(w, "street").alias("street"), _of(w, "type").alias("type"), _of(w, "unit_type", "unit").alias("unit"), _of(w, "box").alias("box"),
            _of(w, "city").alias("city"), F.upper(_of(w, "state")).alias("state"), _of(w, "zip").alias("zip"), _of(w, "recipient").alias("recipient"), _of(w, "post").alias("post_direction"),
        ),
    )


_LINES = {"address1": ["recipient", "number", "pre", "street", "type", "post", "box_type", "box"], "address2": ["unit_type", "unit"], "city": ["city"], "state": ["state"], "zip": ["zip"]}


def parsed_address(address1: Column, address2: Column, city: Column, state: Column, zip_code: Column, model: Model = DEFAULT) -> Column:
    """``address1;address2;city;state;zip`` of an address whose fields may hold each other's words.

    The fields are one line, tagged as a whole. Where the words of a part don't stand together the line is tagged
    again without commas; if they still don't, the address is left as it was, with an error in address1.
    A zip that isn't found stays; null fields are blank.
    """
    given = [F.coalesce(c, F.lit("")) for c in (address1, address2, city, state, zip_code)]

    def runs(words):
        """The parts in the order of the line, one for each run of words."""
        part = F.transform(words, lambda w: F.coalesce(*(F.when(w["tag"].isin(tags_), F.lit(name)) for name, tags_ in _LINES.items())))
        return let(part, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x)))

    def whole(words):
        return let(runs(words), lambda r: F.size(r) == F.size(F.array_distinct(r)))

    def shown(words, original):
        cells = [_of(words, *wanted) for wanted in _LINES.values()]
        return F.concat_ws(";", *cells[:-1], F.when(cells[-1] == "", original[4]).otherwise(cells[-1]))

    def read(f):
        original = [f[name] for name in _LINES]
        line = F.concat_ws(",", *original)
        failed = F.concat_ws(";", message("E", "Unparsed Address", original[0]), *original[1:])
        again = lambda: let(tagged_words(F.regexp_replace(line, ",", " "), model), lambda w: F.when(whole(w), shown(w, original)).otherwise(failed))
        return let(tagged_words(line, model), lambda w: F.when(whole(w), shown(w, original)).otherwise(again()))

    return let(F.struct(*(c.alias(name) for name, c in zip(_LINES, given))), read)


def learned(tagged: DataFrame, line: str = "line", names: str = "tags", unseen: float = 0.5) -> Model:
    """Costs from tagged lines: 10 times the negative logarithms of how often a tag follows another, ends a line, and has words of a class.

    ``line`` is a text and ``names`` the array of its words' tags; lines with null or another number of tags
    than words, or with a tag that isn't in ``TAGS``, are refused when the job runs. Every count has ``unseen`` added. Counting is one
    shuffle of partial counts; at most 2 x tags x tags + classes x tags numbers come to the driver.
    """
    known = F.array(*(F.lit(t) for t in TAGS[1:]))
    words = line_words(F.col(line))
    fits = F.coalesce((F.size(words) == F.size(names)) & (F.size(F.array_except(names, known)) == 0), F.lit(False))
    checked = tagged.select(words.alias("_w"), F.when(fits, F.col(names)).otherwise(F.raise_error(F.lit("a line and its tags don't fit"))).alias("_t"))
    after = F.transform("_w", lambda w, i: F.struct(F.lit("move").alias("kind"), w["comma"].cast("int").alias("x"), F.when(i == 0, F.lit("begin")).otherwise(F.get("_t", i - 1)).alias("a"), F.get("_t", i).alias("b")))
    held = F.flatten(F.transform("_w", lambda w, i: F.filter(F.transform(F.array(*word_classes(F.lower(w["text"]))), lambda c, k: F.struct(F.when(c, F.lit("word")).alias("kind"), k.alias("x"), F.lit("").alias("a"), F.get("_t", i).alias("b"))), lambda s: s["kind"].isNotNull())))
    last = F.filter(F.array(F.struct(F.lit("end").alias("kind"), F.lit(0).alias("x"), F.lit("").alias("a"), F.element_at("_t", -1).alias("b"))), lambda s: F.size("_t") > 0)
    rows = checked.select(F.explode(F.concat(after, held, last)).alias("s")).groupBy("s.kind", "s.x", "s.a", "s.b").count().collect()
    seen = {(r.kind, r.x, r.a, r.b): r["count"] for r in rows}

    def costs(of: list[float]) -> list[int]:
        total = sum(of) + unseen * len(of)
        return [round(-10 * math.log((n + unseen) / total)) for n in of]

    def over(kind, xs, a):  # costs of all (x, tag) of one state
        flat = costs([seen.get((kind, x, a, b), 0) for x in xs for b in TAGS[1:]])
        return {(x, b): flat[i * (len(TAGS) - 1) + j] for i, x in enumerate(xs) for j, b in enumerate(TAGS[1:])}

    moves = {a: over("move", (0, 1), a) for a in TAGS}
    ends = over("end", (0,), "")
    by_tag = {b: costs([seen.get(("word", k, "", b), 0) for k in range(len(CLASSES) - 1)]) for b in TAGS[1:]}
    return Model(
        [[[NEVER if b == "begin" else moves[a][x, b] for a in TAGS] for b in TAGS] for x in (0, 1)],
        [RARE if b == "begin" else ends[0, b] for b in TAGS],
        [[NEVER if b == "begin" else by_tag[b][k] if k < len(CLASSES) - 1 else max(by_tag[b]) for b in TAGS] for k in range(len(CLASSES))],
    )
