import hashlib
import math
import re
import zlib

import pytest

from rosterloom.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items, longest):
    def features(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    seen, wanted = [features(t)[0] for _, t in docs], [features(t)[0] for t in items]
    s, t = {}, {}
    for of, counts in ((seen, s), (wanted, t)):
        for xs in of:
            for x in xs:
                counts[x] = counts.get(x, 0) + 1
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1.0) * (all_s + 10000) / ((s.get(b, 0) + 1.0) * (all_t + 10000))))
    rows = []
    for (doc, text), xs in zip(docs, seen):
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, xs)) // len(xs) if xs else 0
        rows.append((doc, len(xs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), features(text)[1] >= 20))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    place = {}
    for i, r in enumerate(order[: len(order) // 10]):
        place.setdefault(r[:4], []).append(i + 1)
    return sorted(((*r[:4], place[r[:4]].pop(0) if place.get(r[:4]) else None) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_is_that_of_brute_force(spark, prose, longest):
    docs = [(i, prose(i, 5 + i % 60)) for i in range(150)] + [(200, None), (201, ""), (202, "... !"), (203, "Ünï-CODÉ 漢字, ß " * 30), (204, "a\tb\nA b " * 400), (5, prose(5, 40)), (5, prose(5, 40)), (None, prose(8, 50))]
    items = [prose(i, 30) for i in range(0, 150, 7)] + [None, "", "ünï codé"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resample.resample(frame, spark.createDataFrame([(t,) for t in items], "text string").repartition(3), longest).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, longest)


def test_spans_overlap():
    found = [m[0] for m in resample.spans_of(2).finditer(b"aa b cc", overlapped=True)]
    assert found == [b"aa b", b"b cc"]


def test_odd_rows(odd_rows, no_rows):
    rows = resample.resample(odd_rows, odd_rows).collect()
    assert len(rows) == 16 and {r.n_features for r in rows if r.doc_id in (3, 4, 5)} == {0} and sum(r.n_features for r in rows if r.doc_id == 7) == 30_000
    assert [r.rank for r in rows if r.rank] == list(range(1, len([r for r in rows if r.rank]) + 1))
    assert {r.weight for r in resample.resample(odd_rows, no_rows).collect() if r.n_features == 0} == {0}
    assert resample.resample(no_rows, odd_rows).count() == 0
