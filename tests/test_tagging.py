"""Address tags: the cheapest path against all paths, lines with known parts, learned costs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import tagging
from rosterloom.functions.tagging import CLASSES, DEFAULT, TAGS


def brute(words, classes, model):
    """The cheapest of all paths; of equal ones that with the least last tag, then the least before it."""
    emitted = [[min(model.words[k][t] for k in held) for t in range(len(TAGS))] for held in classes]

    def cost(path):
        total, before = model.ends[path[-1]], 0
        for (_, comma), emit, t in zip(words, emitted, path):
            total, before = total + model.moves[int(comma)][t][before] + emit[t], t
        return total

    return min(itertools.product(range(1, len(TAGS)), repeat=len(words)), key=lambda p: (cost(p), p[::-1]))


def test_paths_against_all_paths(spark):
    vocabulary = ["12", "97301", "1st", "ne", "St", "Suite", "#", "PO", "box", "OR", "ohio", "B", "12B", "Elm", "salem", "--", "é", ",", ","]
    chance = random.Random(5)
    lines = [" ".join(chance.choices(vocabulary, k=chance.randint(1, 5))) for _ in range(150)]
    low = lambda w: F.array(*tagging.word_classes(F.lower(w["text"])))
    flat = tagging.Model([[[0] * len(TAGS)] * len(TAGS)] * 2, [0] * len(TAGS), [[0] * len(TAGS)] * len(CLASSES))
    frame = spark.createDataFrame([(x,) for x in lines], "line string").select("line", tagging.line_words(F.col("line")).alias("w"))
    rows = frame.select("line", "w", F.transform("w", low).alias("c"), tagging.tags(F.col("w")).alias("t"), tagging.tags(F.col("w"), flat).alias("f")).collect()
    seen = 0
    for r in rows:
        words = [(w.text, w.comma) for w in r.w]
        if not words:
            assert r.t == []
        elif len(words) <= 4:
            held = [[k for k, h in enumerate(c) if h] for c in r.c]
            assert r.t == list(brute(words, held, DEFAULT)), r.line
            assert r.f[1:] == [0] * (len(words) - 1) or len(words) == 1
            seen += 1
    assert seen > 100


LINES = {
    "101 North Oak Hill St., New Town, IL 62704": dict(number="101", direction="North", street="Oak Hill", type="St", city="New Town", state="IL", zip="62704"),
    "P.O. Box 55, Salem or 97301-0001": dict(box="55", city="Salem", state="OR", zip="97301-0001"),
    "100 N Main St NE, St Louis MO 63101": dict(number="100", direction="N", street="Main", type="St", post_direction="NE", city="St Louis", state="MO", zip="63101"),
    "Mercy Clinic, 7 42nd Street #4, Provo, Utah": dict(recipient="Mercy Clinic", number="7", street="42nd", type="Street", unit="# 4", city="Provo", state="UTAH"),
    "12 Elm": dict(number="12", street="Elm"), "Suite 4, 12 Elm Ave": dict(unit="Suite 4", number="12", street="Elm", type="Ave"), "": {}, None: {}, " ,, ": {},
}


def test_known_lines(spark):
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, line string")
    for r in frame.select("i", "line", tagging.address_parts(F.col("line")).alias("a")).collect():
        assert {k: v for k, v in r.a.asDict().items() if v} == LINES[r.line], r.line


def test_a_long_line(spark):
    """6,003 words; the path is that of a plain table of costs."""
    line = "12 " + "Elm " * 3000 + "St, " + "New " * 3000 + "Salem OR"
    words = F.transform(tagging.line_words(F.col("line")), lambda w: F.struct(w["comma"].alias("comma"), F.array(*tagging.word_classes(F.lower(w["text"]))).alias("held")))
    row = spark.createDataFrame([(line,)], "line string").select(words.alias("w"), tagging.tags(tagging.line_words(F.col("line"))).alias("t")).first()
    best, back = [0] + [tagging.NEVER] * (len(TAGS) - 1), []
    for w in row.w:
        reached = [min((best[a] + DEFAULT.moves[int(w.comma)][t][a], a) for a in range(len(TAGS))) for t in range(len(TAGS))]
        best = [cost + min(DEFAULT.words[k][t] for k, h in enumerate(w.held) if h) for t, (cost, _) in enumerate(reached)]
        back.append([a for _, a in reached])
    at = min(range(len(TAGS)), key=lambda t: (best[t] + DEFAULT.ends[t], t))
    path = []
    for step in reversed(back):
        path.append(at)
        at = step[at]
    assert row.t == path[::-1] and len(path) == 6004


def test_parsed_address(spark):
    rows = [
        ("12 Elm St Suite 4", "Salem OR", None, "", "97301"), ("12 Elm St", "", "Salem", "OR", ""), (None, None, None, None, None),
        ("Suite 3 12 Elm St Suite 4", "9 Oak St", "Salem OR 97301 Salem", "OR", "97301"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string, s string, z string")
    got = [r.p for r in frame.select("i", tagging.parsed_address(*(F.col(c) for c in "abcsz")).alias("p")).orderBy("i").collect()]
    assert got == [
        "12 Elm St;Suite 4;Salem;OR;97301", "12 Elm St;;Salem;OR;", ";;;;",
        "Error: Unparsed Address|Input: Suite 3 12 Elm St Suite 4;9 Oak St;Salem OR 97301 Salem;OR;97301",
    ]


def test_learned_costs(spark):
    """Costs from lines that a made-up office writes backwards; tags of unseen lines follow."""
    backwards = [(f"9{i:04d} OR, Town{chr(97 + i)}, Elm{chr(97 + i)} St {i}", ["zip", "state", "city", "street", "type", "number"]) for i in range(20)]
    model = tagging.learned(spark.createDataFrame(backwards, "line string, tags array<string>"))
    frame = spark.createDataFrame([("97301 OR, Salem, Oak St 12",)], "line string")
    got = frame.select(tagging.tagged_words(F.col("line"), model).alias("w")).first().w
    assert [w.tag for w in got] == ["zip", "state", "city", "street", "type", "number"]
    for bad in ([("12 Elm", ["number"])], [("12", ["begin"])], [("12", None)]):
        with pytest.raises(Exception, match="don't fit"):
            tagging.learned(spark.createDataFrame(bad, "line string, tags array<string>"))
    assert len(tagging.learned(spark.createDataFrame([], "line string, tags array<string>")).words) == len(CLASSES)
