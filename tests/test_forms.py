"""Form operators against plain versions that walk a document word by word."""

import random

import pyarrow as pa
import pytest

from rosterloom.functions import boxes
from rosterloom.operators import forms
from rosterloom.operators.forms import Anchor, Delimiters, GroupBox, Region

SCHEMA = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, word string"
TERMS = "name of tax id no group end phone (a) b cc start Name: IDs".split()


def document(rng, doc, pages=4, lines=9):
    rows = []
    for page in range(1, pages + 1):
        for line in range(rng.randint(3, lines)):
            x = 10.0 * rng.randint(0, 3)
            for _ in range(rng.randint(1, 6)):
                word = rng.choice(TERMS)
                rows.append((doc, page, x, line * 12.0 + rng.choice([0.0, 0.5]), x + 6.0 * len(word), line * 12.0 + 10, word))
                x += 6.0 * len(word) + rng.choice([3.0, 4.0, 30.0])
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [r for doc in range(40) for r in document(rng, doc)]


@pytest.fixture(scope="module")
def words(spark, rows):
    return forms.reading_order(spark.createDataFrame(rows, SCHEMA).repartition(3)).cache()


def pages_of(rows, doc):
    """Words of each page in reading order: (x0, y0, x1, y1, word, line)."""
    out = {}
    for page in sorted({r[1] for r in rows if r[0] == doc}):
        found, line, before = [], 0, None
        for r in sorted((r for r in rows if r[0] == doc and r[1] == page), key=lambda r: (r[3], r[2], r[6])):
            line += before is None or r[3] - before > 2
            before = r[3]
            found.append((*r[2:], line))
        out[page] = sorted(found, key=lambda w: (w[5], w[0], w[1], w[4]))
    return out


def places(pages, phrase):
    parts = phrase.split()
    return [(p, i, ws[i], ws[i + len(parts) - 1], i + len(parts) - 1) for p, ws in pages.items() for i in range(len(ws) - len(parts) + 1) if all(part in ws[i + j][4] for j, part in enumerate(parts))]


def sections(pages, header, footer):
    out = {}
    for p, ws in pages.items():
        last = max(w[5] for w in ws)
        out[p] = (max((w[3] for w in ws if w[5] <= header), default=min(w[1] for w in ws)), min((w[1] for w in ws if footer and w[5] > last - footer), default=max(w[3] for w in ws)))
    return out


def point(side, anchor, place):
    _, _, first, last, _ = place
    return (first[0], first[3]) if anchor.point == "bottom_left" else (last[2], last[1])


def brute_region(pages, spec, parts):
    everything = [w for ws in pages.values() for w in ws]
    x0, y0, x1, y1 = min(w[0] for w in everything), min(w[1] for w in everything), max(w[2] for w in everything), max(w[3] for w in everything)
    found, after = {}, (0, 0)
    if spec.start:
        first = next((hits for t in spec.start.texts if (hits := places(pages, t))), None)
        if not first:
            return {}
        after = first[0][:2]
    for side in forms.SIDES:
        if anchor := getattr(spec, side):
            hits = next((h for t in anchor.texts if (h := [x for x in places(pages, t) if x[:2] >= after])), [])
            n = anchor.occurrence
            if len(hits) < abs(n):
                return {}
            hit = hits[n - 1 if n > 0 else n]
            found[side] = (hit[0], *point(side, anchor, hit))
    left, right = (found[s][1] if s in found else d for s, d in (("left", x0), ("right", x1)))
    if "top" in found and "bottom" in found:
        (pt, _, t), (pb, _, b) = found["top"], found["bottom"]
        first = pt - 1 if pt == pb and t >= b else pt
        spans = {p: (t if p == first else parts[p][0], b if p == pb else parts[p][1]) for p in range(first, pb + 1) if p in pages}
    elif not found:
        spans = {p: (y0, y1) for p in pages}
    else:
        p = found[next(s for s in ("top", "bottom", "left", "right") if s in found)][0]
        spans = {p: (found["top"][2] if "top" in found else y0, found["bottom"][2] if "bottom" in found else y1)}
    return {p: (left, a, right, b) for p, (a, b) in spans.items()}


def inside(w, box):
    return box[0] - w[0] <= 1 and w[0] <= box[2] and w[2] >= box[0] and w[2] - box[2] <= 1 and w[1] >= box[1] and w[1] <= box[3] and w[3] >= box[1] and w[3] <= box[3]


SPECS = {
    "over": Region(top=Anchor(("tax id", "name of"), "top_right"), bottom=Anchor(("end", "phone"), "bottom_left", -1)),
    "one": Region(left=Anchor(("group",)), top=Anchor(("name",), "bottom_left", 2)),
    "after": Region(top=Anchor(("id",), "top_right"), bottom=Anchor(("no",), "bottom_left", 1), start=Anchor(("missing words", "start"))),
    "side": Region(right=Anchor(("cc",), "top_right", -2)),
    "none": Region(top=Anchor(("not there",))),
    "whole": Region(),
}


def test_regions_over_pages(words, rows):
    found = forms.regions(words, SPECS, forms.page_sections(words, 1, 1))
    got = {(r.doc_id, r.name, r.page): (r.min_x, r.min_y, r.max_x, r.max_y) for r in found.collect()}
    texts = {(r.doc_id, r.name): r.text for r in forms.joined_text(forms.region_words(words, found), ["doc_id", "name"]).collect()}
    want, said, spans = {}, {}, 0
    for doc in range(40):
        pages = pages_of(rows, doc)
        for name, spec in SPECS.items():
            boxes = brute_region(pages, spec, sections(pages, 1, 1))
            spans += len(boxes) > 1 and name != "whole"
            want |= {(doc, name, p): b for p, b in boxes.items()}
            if hits := [w[4] for p in sorted(boxes) for w in pages[p] if inside(w, boxes[p])]:
                said[doc, name] = " ".join(hits)
    assert got == want and texts == said and spans > 10


def brute_blocks(pages, d):
    phrases = [*d.first, *d.second]
    lowered = {p: [(*w[:4], w[4].lower(), w[5]) for w in ws] for p, ws in pages.items()}
    hits, seen = [], set()
    for p, i, first, last, _, k in sorted(((*h, k) for k, t in enumerate(phrases) for h in places(lowered, t.lower())), key=lambda h: (h[0], h[1], h[5])):
        if (p, i) not in seen:
            seen.add((p, i))
            hits.append((p, first, last, k >= len(d.first)))
    if d.second:
        beside = lambda i: 0 <= i < len(hits) and hits[i][3]
        hits = [h for i, h in enumerate(hits) if h[3] or not beside(i - 1 if d.opens else i + 1)]
    edges = sorted({(0 if d.across else p, (first[0] if d.opens else last[2]) if d.across else (last[1] if d.opens else first[3])) for p, first, last, _ in hits})
    out = {}
    for b in range(len(edges)):
        low, high = (edges[b], edges[b + 1] if b + 1 < len(edges) else None) if d.opens else (edges[b - 1] if b else None, edges[b])
        for p, ws in pages.items():
            for n, w in enumerate(ws):
                near, far = ((0 if d.across else p, v) for v in ((w[0] + 1, w[2] - 1) if d.across else (w[1], w[3])))
                near_end = near if d.opens else far
                own = (low is None or near >= low) and (high is None or far <= high)
                # A word is in one block: the one that its near end is in.
                own &= (high is None or near_end < high) if d.opens else (low is None or near_end > low)
                if own:
                    out.setdefault(b + 1, []).append((p, n, w[4]))
    return {b: " ".join(x[2] for x in sorted(ws)) for b, ws in out.items()}


@pytest.mark.parametrize("delimiters", [
    Delimiters(("name of", "group")), Delimiters(("tax",), opens=False), Delimiters(("id", "no"), ("phone",)), Delimiters(("ID",), ("END", "cc"), opens=False),
    Delimiters(("phone",), across=True), Delimiters(("group no", "b"), opens=False, across=True), Delimiters(("absent",)),
])
def test_loop_blocks(words, rows, delimiters):
    blocks = forms.loop_blocks(words, delimiters, ["doc_id"])
    got = {(r.doc_id, r.block): r.text for r in forms.joined_text(blocks, ["doc_id", "block"]).collect()}
    assert got == {(doc, b): t for doc in range(40) for b, t in brute_blocks(pages_of(rows, doc), delimiters).items()}


LABELS = ["name of tax", "name", "of", "id no", "id", "group"]


def brute_labels(pages):
    hits = [(p, i, last, LABELS[k], first, end, k) for k, t in enumerate(LABELS) for p, i, first, end, last in places(pages, t)]
    return [h for h in hits if not any(o is not h and o[0] == h[0] and o[1] <= h[1] and h[2] <= o[2] and ((o[1], o[2]) != (h[1], h[2]) or o[6] < h[6]) for o in hits)]


def test_group_boxes(words, rows):
    spec = GroupBox({"left": "bottom_left", "top": "top_right", "right": "top_right", "bottom": "bottom_left"}, {"right": (("phone", "cc"), "bottom_left"), "bottom": (("end",), "top_right"), "left": ((), "top_right")})
    got = sorted((r.doc_id, r.page, r.n, r.label, r.min_x, r.min_y, r.max_x, r.max_y) for r in forms.group_boxes(words, LABELS, spec).collect())
    value = lambda place, side, corner: {"left": (place[0][0], place[1][2]), "right": (place[0][0], place[1][2]), "top": (place[0][3], place[1][1]), "bottom": (place[0][3], place[1][1])}[side][corner == "top_right"]
    want = []
    for doc in range(40):
        pages = pages_of(rows, doc)
        everything = [w for ws in pages.values() for w in ws]
        edge = {"left": min(w[0] for w in everything), "top": min(w[1] for w in everything), "right": max(w[2] for w in everything), "bottom": max(w[3] for w in everything)}
        labels = brute_labels(pages)
        for p, n, _, label, first, last, _ in labels:
            box = {s: value((first, last), s, spec.own[s]) for s in forms.SIDES}
            for side, (texts, corner) in spec.until.items():
                ends = [edge[side]] + [value(h[2:4], side, corner) for t in texts for h in places(pages, t)] + [value(o[4:6], side, corner) for o in labels if o[3] != label]
                own = box[side]
                box[side] = max((e for e in ends if e <= own), default=own) if side in ("left", "top") else min((e for e in ends if e >= own), default=own)
            want.append((doc, p, n, label, box["left"], box["top"], box["right"], box["bottom"]))
    assert got == sorted(want) and len(got) > 300


@pytest.mark.parametrize("cell", [10.0, 60.0, 1000.0])
def test_nearest_labels(spark, words, rows, cell):
    hits = [(doc, h[0], i, h[4][0], h[4][1], h[5][2], h[5][3]) for doc in range(40) for i, h in enumerate(brute_labels(pages_of(rows, doc)))]
    labels = spark.createDataFrame(hits, "doc_id long, page int, label_no int, x0 double, y0 double, x1 double, y1 double")
    asked = words.select("doc_id", "page", "n", "x0", "y0")
    got = {(r.doc_id, r.page, r.n): (r.distance, r.label_no) for r in forms.nearest_labels(asked, labels, cell=cell).collect()}
    want = {}
    for doc in range(40):
        for p, ws in pages_of(rows, doc).items():
            for n, w in enumerate(ws):
                best = min(((max(w[0] - h[5], 0) + max(w[1] - h[6], 0), h[2]) for h in hits if h[:2] == (doc, p) and h[3] <= w[0] and h[4] <= w[1]), default=None)
                if best:
                    want[doc, p, n] = best
    assert got == want and len(got) > 500


@pytest.mark.parametrize("header_rows", [None, 1])
def test_table_cells(words, rows, header_rows):
    got = {(r.doc_id, r.row_no, r.column_no): r.text for r in forms.table_cells(words, ["doc_id"], 10.0, header_rows).collect()}
    want = {}
    for doc in range(40):
        table = []
        for ws in pages_of(rows, doc).values():
            for line in sorted({w[5] for w in ws}):
                cells = []
                for w in (w for w in ws if w[5] == line):
                    if cells and w[0] - cells[-1][2] <= 10:
                        cells[-1] = (f"{cells[-1][0]} {w[4]}", cells[-1][1], w[2])
                    else:
                        cells.append((w[4], w[0], w[2]))
                table.append(cells)
        columns = max(table, key=len)
        aligned = []
        for cells in table:
            if len(cells) == len(columns):
                aligned.append(tuple(c[0] for c in cells))
            else:
                aligned.append(tuple(next((c[0] for c in cells if c[1] <= k[1] <= c[2] or k[1] <= c[1] <= k[2]), "") for k in columns))
        if header_rows is not None:
            aligned = list(dict.fromkeys(aligned))[header_rows:]
        want |= {(doc, i + 1, k + 1): t for i, r in enumerate(aligned) for k, t in enumerate(r)}
    assert got == want


def test_empty_tables(words):
    none = words.limit(0)
    assert forms.regions(none, SPECS, forms.page_sections(none)).count() == 0
    assert forms.loop_blocks(none, Delimiters(("a",)), ["doc_id"]).count() == 0
    assert forms.group_boxes(none, LABELS, GroupBox(dict.fromkeys(forms.SIDES, "top_right"))).count() == 0
    assert forms.table_cells(none, ["doc_id"], 5.0).count() == 0


def characters(rng, doc):
    """Lines of characters at odd heights, in no order across lines, with two fonts."""
    rows, seq = [], 0
    for page in (1, 2):
        boxes = []
        for line in range(rng.randint(1, 6)):
            x, size = 10.0, rng.choice([8, 9])
            for _ in range(rng.randint(1, 25)):
                y = line * rng.choice([11.0, 11.0, 7.0]) + rng.choice([0.0, 0.0, 1.0, 3.0])
                boxes.append((x, y, x + 5.0, y + size, rng.choice("abc "), rng.choice("rrrrb"), size))
                x += 5.0 + rng.choice([0.0, 0.0, 0.0, 0.5, 2.0, 7.0])
        rng.shuffle(boxes)
        for b in boxes:
            rows.append((doc, page, seq, *b))
            seq += 1
    return rows


def brute_words(chars):
    def overlap(a, b):
        shared = min(a[1], b[1]) - max(a[0], b[0])
        return (a[0] <= b[0] and b[1] <= a[1]) or (b[0] <= a[0] and a[1] <= b[1]) or (shared >= 0 and shared > 0.5 * min(a[1] - a[0], b[1] - b[0]))

    lines, held = [], {}
    for seq, x0, y0, x1, y1, char, font, size in sorted(chars):
        if not char.strip():
            continue
        at = next((i for i, s in enumerate(lines) if overlap((y0, y1), s)), None)
        if at is None:
            at = len(lines)
            lines.append((y0, y1))
        held.setdefault(at + 1, []).append((x0, y0, x1, y1, seq, char, font, size))
    out = []
    for line, own in held.items():
        own.sort()
        gaps = [max(0.0, b[0] - a[2]) for a, b in zip(own, own[1:])]
        mode = max(gaps, key=lambda g: (gaps.count(g), -gaps.index(g)), default=0)
        words = [[own[0]]]
        for a, b in zip(own, own[1:]):
            if (b[0] - a[2]) // 1 > mode or a[6:] != b[6:]:
                words.append([])
            words[-1].append(b)
        for n, w in enumerate(words):
            out.append((line, n, min(c[0] for c in w), min(c[1] for c in w), max(c[2] for c in w), max(c[3] for c in w), "".join(c[5] for c in w), *w[0][6:]))
    return sorted(out)


def test_words_from_boxes(spark):
    rng = random.Random(12)
    rows = [r for doc in range(25) for r in characters(rng, doc)]
    chars = spark.createDataFrame(rows, "doc_id long, page int, seq int, x0 double, y0 double, x1 double, y1 double, char string, font string, size int").repartition(3)
    words = forms.words_from_boxes(chars)
    got = {}
    for r in words.collect():
        got.setdefault((r.doc_id, r.page), []).append((r.line, r.word_no, r.x0, r.y0, r.x1, r.y1, r.word, r.font, r["size"]))
    want = {(doc, page): w for doc in range(25) for page in (1, 2) if (w := brute_words([r[2:] for r in rows if r[:2] == (doc, page)]))}
    assert {k: sorted(v) for k, v in got.items()} == want
    laid = {}
    for r in forms.laid_out(words).collect():
        laid.setdefault((r.doc_id, r.page), {})[r.line] = (r.y0, r.y1)
    for key, found in want.items():
        spans = {line: (min(w[3] for w in found if w[0] == line), max(w[5] for w in found if w[0] == line)) for line in {w[0] for w in found}}
        end = 19.0
        for line in sorted(spans, key=lambda k: (*spans[k], k)):
            y0, end = end + 1, end + 1 + spans[line][1] - spans[line][0]
            assert laid[key][line] == pytest.approx((y0, end), abs=2e-3)


def test_laid_words_are_the_words_laid_out(spark, monkeypatch):
    """Also where pages are worked on one by one or all together, and with blanks, nulls, and a page of blanks alone."""
    rng = random.Random(8)
    rows = [(f"d{doc}", *r[1:]) for doc in range(12) for r in characters(rng, doc)]
    rows += [("odd", 1, 0, None, 0.0, 5.0, 9.0, "a", None, 9), ("odd", 1, 1, 5.0, 0.0, None, 9.0, "é", None, 9), ("odd", 1, 2, 10.0, 0.0, 15.0, 9.0, "b", "r", None), ("odd", 1, 3, 15.0, None, 20.0, 9.0, "c", "r", None), ("odd", 1, 4, 20.0, 0.0, 25.0, 9.0, None, "r", 9)]
    rows += [("blank", 1, 0, 0.0, 0.0, 5.0, 9.0, " ", "r", 9)]
    chars = spark.createDataFrame(rows, "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double, char string, font string, size int").repartition(3)
    want = sorted(map(str, forms.laid_out(forms.words_from_boxes(chars)).collect()))
    assert sorted(map(str, forms.laid_words(chars).collect())) == want
    assert [(r.word_no, r.x0, r.x1, r.word, r.font, r["size"]) for r in forms.words_from_boxes(chars).filter("doc_id = 'odd'").orderBy("word_no").collect()] == [(0, 5.0, 5.0, "aé", None, 9), (1, 10.0, 15.0, "b", "r", None)]
    assert chars.filter("doc_id = 'blank'").count() == 1 and "blank" not in str(want)
    at_once = list(boxes.words_of_pages(["doc_id"])(iter([pages_of_characters(rows)])))
    monkeypatch.setattr(boxes, "TOGETHER", 1)
    one_by_one = list(boxes.words_of_pages(["doc_id"])(iter([pages_of_characters(rows)])))
    assert len(at_once) == 1 < len(one_by_one) and pa.Table.from_batches(at_once).to_pylist() == pa.Table.from_batches(one_by_one).to_pylist()
    assert list(boxes.words_of_pages(["doc_id"])(iter([pages_of_characters(rows).slice(0, 0)]))) == [] and forms.laid_words(chars.limit(0)).count() == 0


def pages_of_characters(rows):
    names = ("seq", "x0", "y0", "x1", "y1", "char", "font", "size")
    pages = {}
    for r in rows:
        if r[4] is not None and (r[7] or "").strip():
            pages.setdefault(r[:2], []).append(dict(zip(names, r[2:])))
    return pa.RecordBatch.from_pylist([{"doc_id": doc, "page": page, "_chars": found} for (doc, page), found in pages.items()])


def test_margin_fit(spark, words, rows):
    """The least whole margins with which the expected texts are in their regions; smaller ones lose a text."""
    first = {(doc, "one"): pages_of(rows, doc)[1][1:3] for doc in range(40)}
    found = spark.createDataFrame([(doc, 1, "one", ws[0][0] + doc % 4 + 0.5, ws[0][1] + 0.2, ws[1][2] - doc % 3, ws[0][3] + 5.0) for (doc, _), ws in first.items()], "doc_id long, page int, name string, min_x double, min_y double, max_x double, max_y double")
    expected = spark.createDataFrame([(doc, "one", f"{ws[0][4]} {ws[1][4]}") for (doc, _), ws in first.items()], "doc_id long, name string, text string")
    fit = forms.margin_fit(words, found, expected).collect()
    once = [doc for (doc, _), ws in first.items() if len(places({1: pages_of(rows, doc)[1]}, f"{ws[0][4]} {ws[1][4]}")) == 1]
    box = {r.doc_id: r for r in found.collect()}
    over = lambda doc: max(box[doc].min_x - first[doc, "one"][0][0], first[doc, "one"][1][2] - box[doc].max_x)
    tall = lambda doc: max(box[doc].min_y - min(w[1] for w in first[doc, "one"]), max(w[3] for w in first[doc, "one"]) - box[doc].max_y)
    assert [tuple(r) for r in fit] == [("one", max(int(-(-over(d) // 1)) for d in once), max(max(0, int(-(-tall(d) // 1))) for d in once), len(once))] and len(once) > 15
