"""Fields of forms: regions between anchor texts, over page breaks too, repeated blocks, groups by nearest labels, tables.

Words are rows (key, page, x0, y0, x1, y1, word) of a document that ``key`` names; x grows to the
right and y downwards. A phrase stands where consecutive words of a page hold its words. All
orders are those of reading: by page, line and x; a page's words are one window, a document's
anchors one group.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.functions.boxes import words_of_pages
from rosterloom.functions.text import let

#: How far a word may lie outside a region on the left and right, above and below.
X_MARGIN, Y_MARGIN = 1.0, 0.0
SIDES = ("left", "top", "right", "bottom")
KEY = ["doc_id"]


@dataclass(frozen=True)
class Anchor:
    """The first of ``texts`` that a document has, at its ``occurrence``-th place (-1: the last).

    ``point`` is the ``bottom_left`` corner of the place's first word or the ``top_right`` one of its last word.
    """

    texts: tuple[str, ...]
    point: str = "bottom_left"
    occurrence: int = 1


@dataclass(frozen=True)
class Region:
    """Anchors of the sides; a side without one is the page's. Anchors before the first place of ``start`` don't count."""

    left: Anchor | None = None
    top: Anchor | None = None
    right: Anchor | None = None
    bottom: Anchor | None = None
    start: Anchor | None = None

    def anchors(self) -> dict[str, Anchor]:
        return {side: a for side in (*SIDES, "start") if (a := getattr(self, side)) is not None}


@dataclass(frozen=True)
class Delimiters:
    """Phrases that begin (``opens``) or end a block. A ``first`` one next to a ``second`` one is no delimiter.

    Of blocks that delimiters open, the second one comes before it; else after it. Blocks follow
    each other downwards, or to the right if ``across``.
    """

    first: tuple[str, ...]
    second: tuple[str, ...] = ()
    opens: bool = True
    across: bool = False


@dataclass(frozen=True)
class GroupBox:
    """The box of a label's value: each side is at the label's own corner, or at the nearest of other texts beyond it.

    ``own`` names the label's corner for each side; ``until`` the texts, and the corner of theirs, that
    end the box. Other labels and the edges of the block end it too.
    """

    own: dict[str, str]
    until: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)


def _starts(frame: DataFrame, by: Window, order: list[str], new: Column, name: str) -> DataFrame:
    return frame.withColumn(name, F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def reading_order(words: DataFrame, key: list[str] = KEY, tolerance: float = 2.0) -> DataFrame:
    """``words`` with line_no and n, from 0 on each page; a line begins where y0 grows by more than ``tolerance``."""
    page = Window.partitionBy(*key, "page")
    lined = _starts(words, page, ["y0", "x0", "word"], F.col("y0") - F.lag("y0").over(page.orderBy("y0", "x0", "word")) > tolerance, "line_no")
    return lined.withColumn("n", F.row_number().over(page.orderBy("line_no", "x0", "y0", "word")) - 1)


def phrase_hits(words: DataFrame, phrases: list[str], key: list[str] = KEY, any_case: bool = False) -> DataFrame:
    """Every place of every phrase in words with ``n``: key, page, n, last (its last word), phrase (its number), and its box.

    left and bottom are those of the first word, right and top those of the last.
    """
    page = Window.partitionBy(*key, "page").orderBy("n")
    split = [(i, (p.lower() if any_case else p).split()) for i, p in enumerate(phrases)]
    split = [(i, parts) for i, parts in split if parts]
    longest = max((len(parts) for _, parts in split), default=1)
    text = F.lower("word") if any_case else F.col("word")
    ahead = words.select("*", *(F.lead(text, j).over(page).alias(f"_word{j}") for j in range(longest)), *(F.lead(F.struct("x1", "y0"), j).over(page).alias(f"_end{j}") for j in range(longest)))

    def at(i: int, parts: list[str]) -> Column:
        here = reduce(lambda a, b: a & b, (F.col(f"_word{j}").contains(part) for j, part in enumerate(parts)))
        return F.when(here, F.struct(F.lit(i).alias("phrase"), F.lit(len(parts) - 1).alias("more"), F.col(f"_end{len(parts) - 1}.x1").alias("right"), F.col(f"_end{len(parts) - 1}.y0").alias("top")))

    places = F.array_compact(F.array(*(at(i, parts) for i, parts in split))) if split else F.array().cast("array<struct<phrase:int,more:int,right:double,top:double>>")
    hits = ahead.select(*key, "page", "n", F.col("x0").alias("left"), F.col("y1").alias("bottom"), F.explode(places).alias("at"))
    return hits.select(*key, "page", "n", (F.col("n") + F.col("at.more")).alias("last"), "at.phrase", "left", "at.top", "at.right", "bottom")


def page_sections(words: DataFrame, header_lines: int = 0, footer_lines: int = 0, key: list[str] = KEY) -> DataFrame:
    """head and foot of each page: where its first lines end and its last lines begin; with no lines, the page's own edges. Words have line_no."""
    last = words.groupBy(*key, "page").agg(F.max("line_no").alias("_lines"))
    inside = words.join(last, [*key, "page"])
    head = F.max(F.when(F.col("line_no") <= header_lines, F.col("y1"))) if header_lines else F.min("y0")
    foot = F.min(F.when(F.col("line_no") > F.col("_lines") - footer_lines, F.col("y0"))) if footer_lines else F.max("y1")
    return inside.groupBy(*key, "page").agg(head.alias("head"), foot.alias("foot"))


def _resolved(anchored: Column, side: str, anchor: Anchor, after: Column | None) -> Column:
    """(page, x, y) of an anchor among all hits of a document's region, null if it isn't there."""
    own = F.filter(anchored, lambda h: (h["side"] == side) if after is None else (h["side"] == side) & (F.struct(h["page"], h["n"]) >= after))
    first = F.array_min(F.transform(own, lambda h: h["alternative"]))
    of_first = let(first, lambda k: F.array_sort(F.transform(F.filter(own, lambda h: h["alternative"] == k), lambda h: F.struct(h["page"], h["n"], h["x"], h["y"]))))
    return let(of_first, lambda found: F.try_element_at(found, F.lit(anchor.occurrence)))


def regions(words: DataFrame, specs: dict[str, Region], sections: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, name, page, min_x, min_y, max_x, max_y) of each region on each of its pages; words have ``n``.

    A region whose anchors aren't all there is none. From its top anchor it goes to its bottom
    anchor: on one page, or over the pages up to the bottom anchor's without headers and footers in
    between; a bottom above the top on the same page means that the region began on the page before.
    A region with one of the two is on that anchor's page, with neither on that of its first anchor on
    the left or right, and with no anchor on every page.
    """
    box = words.groupBy(*key).agg(F.min("x0").alias("_x0"), F.min("y0").alias("_y0"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"), F.min("page").alias("_first"), F.max("page").alias("_last"))
    phrases = sorted({t for s in specs.values() for a in s.anchors().values() for t in a.texts})
    number = {p: i for i, p in enumerate(phrases)}
    uses = [(name, side, alternative, number[t], a.point) for name, s in specs.items() for side, a in s.anchors().items() for alternative, t in enumerate(a.texts)]
    use = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), F.lit(k).alias("alternative"), F.lit(p).alias("phrase"), F.lit(point == "top_right").alias("end")) for name, side, k, p, point in uses))
    hits = phrase_hits(words, phrases, key)
    found = hits.select("*", F.explode(F.filter(use, lambda u: u["phrase"] == F.col("phrase"))).alias("use")) if uses else None
    out = []
    anchored = {name for name, *_ in uses}
    if anchored:
        x, y = (F.when(F.col("use.end"), F.col(a)).otherwise(F.col(b)) for a, b in (("right", "left"), ("top", "bottom")))
        hit = F.struct(F.col("use.side").alias("side"), F.col("use.alternative").alias("alternative"), "page", "n", x.alias("x"), y.alias("y"))
        gathered = found.groupBy(*key, F.col("use.name").alias("name")).agg(F.collect_list(hit).alias("hits")).join(box, key)
        for name in sorted(anchored):
            out.append(_region_pages(gathered.filter(F.col("name") == name), specs[name], key))
    whole = [name for name in specs if name not in anchored]
    if whole:
        names = F.explode(F.array(*map(F.lit, whole))).alias("name")
        pages = box.select(*key, names, "_x0", "_x1", "_y0", "_y1", F.explode(F.sequence("_first", "_last")).alias("page"))
        out.append(pages.select(*key, "name", "page", F.col("_x0").alias("min_x"), F.col("_x1").alias("max_x"), F.col("_y0").alias("from_y"), F.col("_y1").alias("to_y")))
    joined = reduce(DataFrame.unionByName, out).join(sections, [*key, "page"])
    return joined.select(*key, "name", "page", "min_x", F.coalesce("from_y", "head").alias("min_y"), "max_x", F.coalesce("to_y", "foot").alias("max_y"))


def _region_pages(rows: DataFrame, spec: Region, key: list[str]) -> DataFrame:
    """(key, name, page, min_x, max_x, from_y, to_y) of one region; null where a page's header or footer bounds it."""
    places = spec.anchors()
    after = None
    if "start" in places:
        rows = rows.withColumn("_start", _resolved(F.col("hits"), "start", places.pop("start"), None)).filter("_start IS NOT NULL")
        after = F.struct(F.col("_start.page").alias("page"), F.col("_start.n").alias("n"))
    for side, anchor in places.items():
        rows = rows.withColumn(f"_{side}", _resolved(F.col("hits"), side, anchor, after)).filter(F.col(f"_{side}").isNotNull())
    value = lambda side, part, otherwise: F.col(f"_{side}.{part}") if side in places else F.col(otherwise)
    rows = rows.select(*key, "name", "_first", "_last", "_y0", "_y1", value("left", "x", "_x0").alias("min_x"), value("right", "x", "_x1").alias("max_x"), *(f"_{s}" for s in places))
    if "top" in places and "bottom" in places:
        top, bottom = F.col("_top"), F.col("_bottom")
        before = (top["page"] == bottom["page"]) & (top["y"] >= bottom["y"])
        first = top["page"] - before.cast("int")
        rows = rows.withColumn("_from", first).filter(F.col("_from") <= bottom["page"])
        rows = rows.withColumn("page", F.explode(F.sequence("_from", bottom["page"])))
        from_y, to_y = F.when(F.col("page") == F.col("_from"), top["y"]), F.when(F.col("page") == bottom["page"], bottom["y"])
    else:
        side = next((s for s in ("top", "bottom", "left", "right") if s in places), None)
        rows = rows.withColumn("page", F.explode(F.sequence("_first", "_last")) if side is None else F.col(f"_{side}.page"))
        from_y, to_y = value("top", "y", "_y0"), value("bottom", "y", "_y1")
    return rows.select(*key, "name", "page", "min_x", "max_x", from_y.alias("from_y"), to_y.alias("to_y"))


def region_words(words: DataFrame, found: DataFrame, key: list[str] = KEY, x_margin: float = X_MARGIN, y_margin: float = Y_MARGIN) -> DataFrame:
    """The words in each region, with its name; a word may lie beyond an edge by the margin, but not wholly."""
    c = F.col
    inside = (c("x0") >= c("min_x") - x_margin) & (c("x0") <= c("max_x")) & (c("x1") >= c("min_x")) & (c("x1") <= c("max_x") + x_margin)
    inside &= (c("y0") >= c("min_y") - y_margin) & (c("y0") <= c("max_y")) & (c("y1") >= c("min_y")) & (c("y1") <= c("max_y") + y_margin)
    return words.join(found, [*key, "page"]).filter(inside).drop("min_x", "min_y", "max_x", "max_y")


def joined_text(words: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and text: its words in reading order."""
    read = F.transform(F.sort_array(F.collect_list(F.struct("page", "n", "word"))), lambda w: w["word"])
    return words.groupBy(*by).agg(F.array_join(read, " ").alias("text"))


def loop_blocks(words: DataFrame, delimiters: Delimiters, by: list[str], x_margin: float = X_MARGIN, y_margin: float = Y_MARGIN) -> DataFrame:
    """``words`` (those of each region, with ``by`` naming it) with the number of the block that they are in, from 1.

    Words before the first block that a delimiter opens, or after the last that one ends, are in none, and
    so is a word that lies across an edge by more than the margin.
    """
    order = Window.partitionBy(*by).orderBy("page", "n", "phrase")
    phrases = [*delimiters.first, *delimiters.second]
    page = Window.partitionBy(*by, "page").orderBy("n")
    hits = phrase_hits(words.withColumn("n", F.row_number().over(page)), phrases, by, any_case=True)
    hits = hits.withColumn("_twin", F.lag(F.struct("page", "n")).over(order).eqNullSafe(F.struct("page", "n"))).filter(~F.col("_twin"))
    if delimiters.second:
        first = F.col("phrase") < len(delimiters.first)
        beside = F.lag("phrase").over(order) if delimiters.opens else F.lead("phrase").over(order)
        hits = hits.withColumn("_out", first & (F.coalesce(beside, F.lit(-1)) >= len(delimiters.first))).filter(~F.col("_out"))
    # An edge is a place on the axis along which the blocks follow each other.
    corner = (F.col("left") if delimiters.opens else F.col("right")) if delimiters.across else F.col("top") if delimiters.opens else F.col("bottom")
    place = F.struct(F.lit(0).alias("page") if delimiters.across else F.col("page").cast("int").alias("page"), corner.cast("double").alias("at"))
    along = Window.partitionBy(*by).orderBy("_place")
    edges = hits.select(*by, place.alias("_place")).distinct().withColumn("block", F.row_number().over(along))
    if delimiters.opens:
        blocks = edges.select(*by, "block", F.col("_place").alias("_low"), F.lead("_place").over(along).alias("_high"))
    else:
        blocks = edges.select(*by, "block", F.lag("_place").over(along).alias("_low"), F.col("_place").alias("_high"))
    low, high, margin = ("x0", "x1", x_margin) if delimiters.across else ("y0", "y1", y_margin)
    at = lambda c: F.struct(F.lit(0).alias("page") if delimiters.across else F.col("page").cast("int").alias("page"), c.cast("double").alias("at"))
    # A running count of edges puts each word into the block that its near end is in.
    near = at(F.col(low) + margin) if delimiters.opens else at(F.col(high) - margin)
    first = F.lit(0 if delimiters.opens else 1)
    names = words.columns
    events = words.select(*by, near.alias("_place"), (1 - first).alias("_turn"), F.lit(0).alias("_edge"), F.struct(*names).alias("_word"))
    marks = edges.select(*by, "_place", first.alias("_turn"), F.lit(1).alias("_edge"), F.lit(None).cast(events.schema["_word"].dataType).alias("_word"))
    count = F.sum("_edge").over(Window.partitionBy(*by).orderBy("_place", "_turn").rowsBetween(Window.unboundedPreceding, 0))
    placed = events.unionByName(marks).withColumn("block", count + (0 if delimiters.opens else 1)).filter("_edge = 0").select("_word.*", "block")
    joined = placed.join(blocks, [*by, "block"])
    fits = (F.col("_low").isNull() | (at(F.col(low) + margin) >= F.col("_low"))) & (F.col("_high").isNull() | (at(F.col(high) - margin) <= F.col("_high")))
    return joined.filter(fits).drop("_low", "_high")


def label_hits(words: DataFrame, labels: list[str], key: list[str] = KEY) -> DataFrame:
    """Places of labels, without those that lie within a longer one; of labels at one place the first listed. With ``label``."""
    hits = phrase_hits(words, labels, key)
    before = Window.partitionBy(*key, "page").orderBy("n", F.desc("last"), "phrase").rowsBetween(Window.unboundedPreceding, -1)
    kept = hits.withColumn("_reach", F.max("last").over(before)).filter(F.col("_reach").isNull() | (F.col("last") > F.col("_reach")))
    return kept.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.col("phrase") + 1)).drop("_reach")


def group_boxes(words: DataFrame, labels: list[str], spec: GroupBox, key: list[str] = KEY) -> DataFrame:
    """(key, page, n, label, min_x, min_y, max_x, max_y): the box of the value of each label's place; words have ``n``.

    A side's edge is the nearest one, among the anchor texts of the side, the other labels and the
    edges of all words, that is not before the label's own corner. Edges and labels are in one order,
    where the last edge passed is the nearest, so no label meets all anchors.
    """
    own = label_hits(words, labels, key)
    corner = lambda side, point: {"left": "left", "right": "left", "top": "bottom", "bottom": "bottom"}[side] if point == "bottom_left" else {"left": "right", "right": "right", "top": "top", "bottom": "top"}[side]
    box = words.groupBy(*key).agg(F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"))
    place = [*key, "page", "n", "last", "label"]
    out = own.select(*place, *(F.col(corner(side, spec.own[side])).alias(f"_{side}") for side in SIDES))
    for side, (texts, point) in spec.until.items():
        anchors = phrase_hits(words, list(texts), key).select(*key, F.col(corner(side, point)).alias("_at"), F.lit(None).cast("string").alias("_of")) if texts else None
        edges = own.select(*key, F.col(corner(side, point)).alias("_at"), F.col("label").alias("_of"))
        edges = edges if anchors is None else edges.unionByName(anchors)
        edges = edges.unionByName(box.select(*key, F.col(side).alias("_at"), F.lit(None).cast("string").alias("_of"))).distinct()
        out = _nearest_edge(out, edges, side, key)
    names = {"left": "min_x", "top": "min_y", "right": "max_x", "bottom": "max_y"}
    return out.select(*place, *(F.col(f"_{side}").alias(names[side]) for side in SIDES))


def _nearest_edge(rows: DataFrame, edges: DataFrame, side: str, key: list[str]) -> DataFrame:
    """``rows`` with _``side`` moved to the nearest of ``edges`` that is not before it; edges of the row's own label don't count."""
    low, column = side in ("left", "top"), f"_{side}"
    rank = F.col("_at") if low else -F.col("_at")
    # Of each label's edges the nearest two labels are enough: one of them is not the row's own.
    marks = edges.groupBy(*key, "_at").agg(F.min("_of").alias("_least"), F.max("_of").alias("_most"), F.max(F.col("_of").isNull()).alias("_any"))
    marks = marks.select(*key, rank.alias("_rank"), F.lit(0).alias("_turn"), F.struct("_at", "_least", "_most", "_any").alias("_edge"), F.lit(None).cast(f"struct<{','.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema)}>").alias("_row"))
    asked = rows.select(*key, (F.col(column) if low else -F.col(column)).alias("_rank"), F.lit(1).alias("_turn"), F.lit(None).cast(marks.schema["_edge"].dataType).alias("_edge"), F.struct(*rows.columns).alias("_row"))
    order = Window.partitionBy(*key).orderBy("_rank", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked)
    # The last edge of no label or of several, and the last of one label and the last of another one before it.
    free = F.last(F.when(F.col("_edge._any") | (F.col("_edge._least") != F.col("_edge._most")), F.col("_edge._at")), ignorenulls=True).over(order)
    single = F.when(F.col("_edge._least").isNotNull(), F.struct(F.col("_edge._least").alias("of"), F.col("_edge._at").alias("at")))
    both = both.withColumn("_free", free).withColumn("_last", F.last(single, ignorenulls=True).over(order))
    step = Window.partitionBy(*key).orderBy("_rank", "_turn")
    before = F.lag("_last").over(step)
    both = both.withColumn("_before", F.when((F.col("_turn") == 0) & (F.col("_last.of") != before["of"]), before))
    both = both.withColumn("_other", F.last("_before", ignorenulls=True).over(order))
    answered = both.filter("_turn = 1")
    by_label = F.when(F.col("_last.of") != F.col("_row.label"), F.col("_last.at")).otherwise(F.col("_other.at"))
    nearest = F.greatest(by_label, "_free") if low else F.least(by_label, "_free")
    kept = [F.coalesce(nearest, F.col(f"_row.{column}")).alias(column) if c == column else F.col(f"_row.`{c}`").alias(c) for c in rows.columns]
    return answered.select(*kept)


def nearest_labels(words: DataFrame, labels: DataFrame, key: list[str] = KEY, cell: float = 60.0) -> DataFrame:
    """Each word with the nearest label (label_no, x0, y0, x1, y1 of ``labels``) of its page that stands left of it or above, and its distance.

    The distance is between the boxes, as steps right plus steps down; ties go to the lower label_no.
    Labels are in a grid: a word first asks the cells that reach ``cell`` away, and only one that
    found none near enough there asks all labels of its page.
    """
    c = F.col
    right = F.greatest(c("x0") - c("l_x1"), F.lit(0.0))
    down = F.greatest(c("y0") - c("l_y1"), F.lit(0.0))
    before = (c("l_x0") <= c("x0")) & (c("l_y0") <= c("y0"))
    named = labels.select(*key, "page", "label_no", *(c(k).alias(f"l_{k}") for k in ("x0", "y0", "x1", "y1")))
    cells = lambda low, high: F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int"))
    grid = named.select("*", F.explode(cells(c("l_x0"), c("l_x1"))).alias("_cx")).select("*", F.explode(cells(c("l_y0"), c("l_y1"))).alias("_cy"))
    asked = words.select("*", F.explode(cells(c("x0") - cell, c("x0"))).alias("_cx")).select("*", F.explode(cells(c("y0") - cell, c("y0"))).alias("_cy"))
    best = F.min(F.struct((right + down).alias("distance"), "label_no")).alias("_best")
    near = asked.join(grid, [*key, "page", "_cx", "_cy"]).filter(before).groupBy(*words.columns).agg(best).filter(c("_best.distance") <= cell)
    far = words.join(near, words.columns, "left_anti").join(named, [*key, "page"]).filter(before).groupBy(*words.columns).agg(best)
    return near.unionByName(far).select(*words.columns, "_best.label_no", "_best.distance")


def table_cells(words: DataFrame, by: list[str], gap: float, header_rows: int | None = None) -> DataFrame:
    """(by, row_no, column_no, text) of a table's words, over all its pages: its cells, columns aligned to the first row of most cells.

    A row is a line, a cell ends where the next word begins more than ``gap`` to the right. The cell of
    a shorter row that reaches over a column's cell first is its text there; a column that none
    reaches is blank. With ``header_rows``, equal rows are one, and so many rows at the top go.
    Words have line_no.
    """
    line = Window.partitionBy(*by, "page", "line_no").orderBy("n")
    celled = words.withColumn("_cell", F.sum((F.coalesce(F.col("x0") - F.lag("x1").over(line), F.lit(0.0)) > gap).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda w: w["word"]), " ")
    cells = celled.groupBy(*by, "page", "line_no", "_cell").agg(text.alias("text"), F.min_by("x0", "n").alias("x0"), F.max_by("x1", "n").alias("x1"))
    lines = cells.groupBy(*by, "page", "line_no").agg(F.sort_array(F.collect_list(F.struct("_cell", "text", "x0", "x1"))).alias("cells"))
    table = Window.partitionBy(*by)
    lines = lines.withColumn("_at", F.struct("page", "line_no"))
    widest = F.max_by("cells", F.struct(F.size("cells"), -F.col("page"), -F.col("line_no"))).over(table)
    lines = lines.withColumn("_columns", widest)
    over = lambda cell, column: ((cell["x0"] <= column["x0"]) & (cell["x1"] >= column["x0"])) | ((column["x0"] <= cell["x0"]) & (column["x1"] >= cell["x0"]))
    aligned = F.transform("_columns", lambda column: F.coalesce(F.get(F.filter("cells", lambda cell: over(cell, column)), F.lit(0))["text"], F.lit("")))
    plain = F.transform("cells", lambda cell: cell["text"])
    rows = lines.select(*by, "_at", F.when(F.size("cells") == F.size("_columns"), plain).otherwise(aligned).alias("texts"))
    if header_rows is not None:
        rows = rows.groupBy(*by, "texts").agg(F.min("_at").alias("_at"))
    rows = rows.withColumn("row_no", F.row_number().over(table.orderBy("_at")) - (header_rows or 0)).filter("row_no > 0")
    return rows.select(*by, "row_no", F.posexplode("texts").alias("_column", "text")).select(*by, "row_no", (F.col("_column") + 1).alias("column_no"), "text")


def page_words(chars: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Words (key, page, line, word_no, x0, y0, x1, y1, word, font, size) of characters (key, page, seq, x0, y0, x1, y1, char, font, size) that aren't blank.

    In the order of ``seq``, a character joins the first line whose first character's height overlaps its own (one
    holds the other, or they share more than half of either one), else it begins one; lines are numbered as they
    begin. A line is read by x. A word ends where the gap, cut to whole units, is more than the line's commonest gap (of
    equally common ones the first), or where the font or its size changes. _high is the height of a word's line, _below
    that of all _rank lines of its page from the top down to it.

    A page's characters become one row, by page once, and a task goes over its pages by arrays of many pages at a time.
    seq is a number.
    """
    boxes = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    seen = chars.filter((F.trim("char") != "") & F.col("y0").isNotNull() & F.col("y1").isNotNull()).select(*key, "page", "seq", *boxes, "char", "font", "size")
    # A struct that is built before is kept as bytes; one built within the aggregate would be objects.
    packed = seen.select(*key, "page", F.struct("seq", "x0", "y0", "x1", "y1", "char", "font", "size").alias("_char"))
    pages = packed.groupBy(*key, "page").agg(F.collect_list("_char").alias("_chars"))
    kind = {f.name: f.dataType.simpleString() for f in seen.schema}
    out = [*((c, kind[c]) for c in (*key, "page")), ("line", "int"), ("word_no", "bigint"), *((c, "double") for c in ("x0", "y0", "x1", "y1")), ("word", "string"), ("font", kind["font"]), ("size", kind["size"]), ("_high", "double"), ("_below", "double"), ("_rank", "bigint")]
    return pages.mapInArrow(words_of_pages(key), ", ".join(f"`{c}` {t}" for c, t in out))


def words_from_boxes(chars: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The words of single characters with boxes and fonts; see ``page_words``."""
    return page_words(chars, key).drop("_high", "_below", "_rank")


def laid_words(chars: DataFrame, key: list[str] = KEY, top: float = 20.0, between: float = 1.0) -> DataFrame:
    """``laid_out`` of ``words_from_boxes``, without dealing out or sorting the words: a page's lines are laid where its words are found."""
    end = F.lit(top) + F.col("_below") + F.lit(between) * (F.col("_rank") - 1)
    words = page_words(chars, key).withColumns({"y0": F.round(end - F.col("_high"), 3), "y1": F.round(end, 3)})
    line = [*key, "page", "line"]
    return words.select(*line, *(c for c in words.columns if c not in (*line, "y0", "y1", "_high", "_below", "_rank")), "y0", "y1")


def laid_out(words: DataFrame, key: list[str] = KEY, top: float = 20.0, between: float = 1.0) -> DataFrame:
    """``words`` (with line) with the lines of each page laid below each other, ``between`` apart from ``top`` on; words take their line's height."""
    line = [*key, "page", "line"]
    of = Window.partitionBy(*line)
    lined = words.withColumns({"_y0": F.min("y0").over(of), "_y1": F.max("y1").over(of), "_lead": F.row_number().over(of.orderBy("word_no")) == 1})
    # Words of a line are peers: each has the sum over all lines down to its own, of which one word counts.
    down = Window.partitionBy(*key, "page").orderBy("_y0", "_y1", "line").rangeBetween(Window.unboundedPreceding, 0)
    height = F.col("_y1") - F.col("_y0")
    end = F.lit(top) + F.sum(F.when(F.col("_lead"), height + between).otherwise(0.0)).over(down) - between
    placed = lined.withColumn("_end", end).withColumns({"y0": F.round(F.col("_end") - height, 3), "y1": F.round("_end", 3)})
    return placed.select(*line, *(c for c in words.columns if c not in (*line, "y0", "y1")), "y0", "y1")


def margin_fit(words: DataFrame, found: DataFrame, expected: DataFrame, key: list[str] = KEY) -> DataFrame:
    """name, x_margin, y_margin and n: the least whole margins with which each region holds its expected texts, of ``n`` documents.

    ``expected`` has key, name and text, ``found`` the regions. A text counts if it stands on its region's page at one
    place only. Every text is one row with its four overhangs, so that all margins are one aggregate.
    """
    pages = words.groupBy(*key, "page").agg(F.array_sort(F.collect_list(F.struct("n", "word", "x0", "y0", "x1", "y1"))).alias("_words"))
    asked = expected.withColumn("_text", F.filter(F.split("text", " +"), lambda w: w != "")).filter(F.size("_text") > 0)
    both = asked.join(found, [*key, "name"]).join(pages, [*key, "page"])
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - F.size("_text") + 1, F.lit(1)))
    there = lambda i: F.forall(F.sequence(F.lit(0), F.size("_text") - 1), lambda j: F.coalesce(F.try_element_at("_words", i + j)["word"].contains(F.try_element_at("_text", j + 1)), F.lit(False)))
    hits = both.withColumn("_hits", F.filter(starts, there)).filter(F.size("_hits") == 1)
    place = hits.withColumn("_box", F.slice("_words", F.element_at("_hits", 1), F.size("_text")))
    first, last = F.element_at("_box", 1), F.element_at("_box", -1)
    over = lambda *sides: F.ceil(F.greatest(F.lit(0.0), *sides)).cast("long")
    x = over(F.col("min_x") - first["x0"], last["x1"] - F.col("max_x"))
    y = over(F.col("min_y") - F.least(first["y0"], last["y0"]), F.greatest(first["y1"], last["y1"]) - F.col("max_y"))
    return place.groupBy("name").agg(F.max(x).alias("x_margin"), F.max(y).alias("y_margin"), F.count("*").alias("n"))
