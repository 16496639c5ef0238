import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[kind], text or "") if valid(kind, m.group())]
    return [(s, k, e) for s, k, e in sorted(spans)]


TEXTS = [
    "a@b.com_x@y.z", "a@b.cc@d.e.f", "..@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.000 1.2.3", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (312) 555-0100, +1--2", "+12345678901234567", "é漢 a.b@c.de 😀 10.0.0.1",
    "9" * 40, "0 0 0 0 0 0 0 0 0 0 0 0 0 0", "a@b", "@@@", "1..2.3.4", "x" * 5000 + "@y.z", "1." * 3000, "a.b@" + "c." * 3000 + "d", "",
]


def spans(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(2)
    rows = frame.select("i", pii.base_spans(F.coalesce("t", F.lit(""))).alias("s")).collect()
    return [[tuple(s) for s in r.s] for r in sorted(rows, key=lambda r: r.i)]


def test_base_spans(spark):
    assert spans(spark, TEXTS) == [brute(t) for t in TEXTS]


@settings(deadline=None, max_examples=8)
@given(st.lists(st.text(alphabet="ab19.@+-() é😀", max_size=60), min_size=20, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    assert spans(spark, texts) == [brute(t) for t in texts]


def test_contexts_find_unseen_identifiers(spark, prose):
    rows = [(i, f"{prose(i, 12)} card number 4111 {prose(i + 500, 9)}") for i in range(5)]
    seeds = [(100 + i, f"{prose(i + 900, 10)} write to user{i}x@mail.example.com today {prose(i + 700, 8)}") for i in range(30)]
    unseen = [(200, f"{prose(1, 10)} write to user9x@mail today {prose(2, 8)}"), (201, f"{prose(3, 5)} buy 12345678 bolts")]
    docs = spark.createDataFrame(rows + seeds + unseen, "doc_id long, text string")
    mentions = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert all(len(mentions[100 + i].spans) == 1 for i in range(30))
    assert mentions[201].spans == [] and all(mentions[i].spans == [] for i in range(5))
    start = len(f"{prose(1, 10)} write to ")
    assert [tuple(s) for s in mentions[200].spans] == [(start, 0, start + len("user9x@mail"))]


def test_texts_of_many_identifiers(spark):
    """Thousands of base spans, candidates beside and inside them, and their masks: more than one run of the scans."""
    texts = [" ".join(f"m a{i}@b.com {i * 7919} 10.0.{i % 256}.7x" for i in range(3000)), " ".join(map(str, range(20_000))), "9 " * 3000 + "+1 (312) 555-0100"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_spans(frame, ["doc_id", "text"]).withColumn("m", pii.masked(F.col("text"), "spans")).collect()
    for r in rows:
        assert [tuple(s) for s in r.base] == brute(r.text)
        at, out = 0, []
        for s in r.spans:
            if s.start >= at:
                out += [r.text[at : s.start], f"[{pii.KINDS[s.kind]}]"]
            at = max(at, s.end)
        assert r.m == "".join([*out, r.text[at:]])


def test_rounds_go_on_until_nothing_is_found(spark, prose):
    """Each round learns the next context from what the last one found: a chain of five, each link a third as long."""
    rows = [f"{prose(i, 5)} link0 user{i}x@mail.example.com tail0 {prose(i + 70, 5)}" for i in range(567)]
    for k, size in enumerate((189, 63, 21, 7)):
        for there in (k, k + 1):
            rows += [f"{prose(1000 * k + i, 5)} link{there} user{k}y{i}@mail tail{there} {prose(7000 + i, 5)}" for i in range(size)]
    rows.append(f"{prose(5, 5)} link4 name@host tail4 {prose(6, 5)}")
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = found_texts(frame)
    assert found[len(rows) - 1] == [("email", "name@host")]


def found_texts(documents):
    rows = pii.find_spans(documents, ["doc_id", "text"]).collect()
    return {r.doc_id: [(pii.KINDS[s.kind], r.text[s.start : s.end]) for s in r.spans] for r in rows}


def test_contexts_find_identifiers_of_other_forms(spark, prose):
    """Contexts are learned from full forms, and find short ones: none has the shape of a seed."""
    rows = [(i, f"{prose(i, 6)} write to user{i}x@mail.example.com today {prose(i + 70, 6)}") for i in range(30)]
    rows += [(100 + i, f"{prose(i + 200, 6)} dial +1 (312) 555-{1000 + i} please {prose(i + 270, 6)}") for i in range(30)]
    planted = {900: ("email", "user9x@mail", "write to", "today"), 901: ("phone", "(415) 555 2671", "dial", "please"), 902: ("phone", "7946-0958", "dial", "please")}
    rows += [(i, f"{prose(i, 6)} {before} {x} {after} {prose(i + 50, 6)}") for i, (_, x, before, after) in planted.items()]
    rows += [(990, f"{prose(5, 6)} dial 2024 please {prose(6, 6)}"), (991, f"{prose(7, 6)} dial key9 please"), (992, f"{prose(8, 6)} buy 12345678 bolts")]
    found = found_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert all(len(found[i]) == 1 for i in [*range(30), *range(100, 130)])
    assert {i: found[i] for i in planted} == {i: [(kind, x)] for i, (kind, x, _, _) in planted.items()}
    assert not found[990] and not found[991] and not found[992]


def test_seeds_are_found_without_what_makes_them_sure(spark, prose):
    """The ends of phone numbers that are certain in one text are found in others, in any context."""
    rows = [(i, f"{prose(i, 6)} call +44 20-7946-{1000 + i} now {prose(i + 70, 6)}") for i in range(20)]
    rows += [(100 + i, f"{prose(i + 200, 6)} tel +1 (312) 555-{1000 + i} or {prose(i + 270, 6)}") for i in range(20)]
    rows += [(900, f"{prose(1, 6)} reach 20-7946-1003 soon"), (901, f"{prose(2, 6)} old 555-1004 too"), (902, f"{prose(3, 6)} reach 20-7946-8888 soon")]
    found = found_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert found[900] == [("phone", "20-7946-1003")] and found[901] == [("phone", "555-1004")]
    assert found[902] == []


def test_masks(spark):
    frame = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4"), (2, "none"), (3, None)], "doc_id long, text string")
    found = pii.find_spans(frame, ["doc_id", "text"]).withColumn("m", pii.masked(F.col("text"), "spans"))
    assert {r.doc_id: r.m for r in found.collect()} == {1: "é [email], [ip]", 2: "none", 3: None}


@pytest.mark.parametrize("keep", [None, ["doc_id", "text"]])
def test_odd_rows(odd_rows, no_rows, keep):
    rows = pii.find_spans(odd_rows, keep).select("doc_id", pii.span_text("base").alias("b"), pii.span_text("spans").alias("s")).collect()
    assert len(rows) == 16
    assert {r.doc_id: r.b for r in rows if r.b} == {11: "email:5:22"}
    assert pii.find_spans(no_rows, keep).count() == 0
