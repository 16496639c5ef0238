import re

import pytest

from rosterloom.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(decontam.SPAN, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (items_here := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in items_here if x is not None}
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(spark, prose):
    items = [(i, prose(i, 3 + i % 40)) for i in range(60)] + [(1, prose(1, 30)), (70, "short one"), (71, ""), (None, prose(99, 25)), (72, None), (73, "a b " * 20), (74, "!!")]
    docs = []
    for i in range(80):
        own, (_, item) = prose(3000 + i, 40 + 3 * i).split(), items[i % len(items)]
        taken = words(item)[i % 3 : i % 3 + 5 + i % 20]
        docs.append((i, " ".join([*own[: i % 30], *taken, *own[i % 30 :]])))
    docs += [(100, "Short ONE, short-one"), (101, "a b " * 300), (102, ""), (103, None), (104, prose(99, 25)), (104, prose(99, 25))]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return docs, items, *frames


@pytest.mark.parametrize("prefilter", [decontam.PREFILTER, 0])
@pytest.mark.parametrize("broadcast", [decontam.BROADCAST_ITEMS, 0])
def test_every_shared_window_is_found(case, prefilter, broadcast):
    docs, items, documents, benchmark = case
    rows = decontam.contamination(documents, benchmark, prefilter, broadcast).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in rows), key=str) == brute(docs, items)


def test_odd_rows(odd_rows, no_rows, case):
    rows = decontam.contamination(odd_rows, odd_rows.selectExpr("doc_id AS item_id", "text")).collect()
    assert len(rows) == 16 and all(r.n_hit == r.n_words for r in rows)
    assert {r.n_hit for r in decontam.contamination(odd_rows, no_rows.selectExpr("doc_id AS item_id", "text")).collect()} == {0}
    assert decontam.contamination(no_rows, case[3]).count() == 0
