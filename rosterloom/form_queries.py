"""Registered queries of the form operators: the words of web pages, laid out as forms of several pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.operators import forms
from rosterloom.operators.forms import Anchor, Delimiters, GroupBox, Region
from rosterloom.queries import query, table

#: A line has so many words, a form page so many lines.
PER_LINE, LINES = 8, 10
#: The pages are in so many parts for each core, of so many pages at most: a part in work is much larger than its html.
PARTS, PAGES = 4, 1000


def form_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each page's text, in lines on form pages."""
    found = F.regexp_extract_all(F.regexp_replace("html", "<[^>]*>", " "), F.lit(r"[^ \n]+"), F.lit(0))
    # Pages are dealt out by document once, as html; what follows is by document and needs no other shuffle of words.
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    parts = max(PARTS * spark.sparkContext.defaultParallelism, -(-pages.count() // PAGES))
    pages = pages.repartition(parts, "doc_id")
    words = pages.select("doc_id", F.posexplode(found).alias("w", "word"))
    x, line = F.col("w") % PER_LINE * 50.0, F.floor(F.col("w") / PER_LINE)
    y = line % LINES * 12.0
    laid = words.select("doc_id", (F.floor(line / LINES) + 1).cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + F.least(F.length("word"), F.lit(9)) * 5.0).alias("x1"), (y + 10.0).alias("y1"), "word")
    return forms.reading_order(laid)


_WORDS = rf"""
u AS (SELECT page_id AS doc_id, unnest(range(len(l))) AS w, unnest(l) AS word FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^ \n]+') AS l FROM pages)),
w AS (SELECT doc_id, (w // {PER_LINE * LINES} + 1)::INT AS page, (w % {PER_LINE * LINES})::INT AS n, (w // {PER_LINE} % {LINES})::INT + 1 AS line_no, (w % {PER_LINE}) * 50.0::DOUBLE AS x0, (w // {PER_LINE} % {LINES}) * 12.0::DOUBLE AS y0,
  (w % {PER_LINE}) * 50.0::DOUBLE + least(length(word), 9) * 5.0::DOUBLE AS x1, (w // {PER_LINE} % {LINES}) * 12.0::DOUBLE + 10.0::DOUBLE AS y1, word FROM u),
box AS (SELECT doc_id, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM w GROUP BY 1)"""


def _hits(phrases, lowered: bool = False) -> str:
    """doc_id, page, n, last, phrase, left, top, right, bottom of every place of the phrases."""
    text, parts = ("lower(word)", [p.lower().split() for p in phrases]) if lowered else ("word", [p.split() for p in phrases])
    return " UNION ALL ".join(
        f"SELECT doc_id, page, n, n + {len(ws) - 1} AS last, {i} AS phrase, '{phrases[i]}' AS label, x0 AS \"left\", lead(y0, {len(ws) - 1}) OVER o AS top, lead(x1, {len(ws) - 1}) OVER o AS \"right\", y1 AS bottom FROM w "
        f"WINDOW o AS (PARTITION BY doc_id, page ORDER BY n) QUALIFY {' AND '.join(f'''contains({text if not j else f'lead({text}, {j}) OVER o'}, '{part}')''' for j, part in enumerate(ws))}"
        for i, ws in enumerate(parts)
    )


_SPECS = {
    "passage": Region(top=Anchor(("of the", "und", "de la"), "top_right", 2), bottom=Anchor(("the", "die", "le"), "bottom_left", -1)),
    "column": Region(left=Anchor(("and", "der", "un"), "bottom_left"), top=Anchor(("and", "der", "un"), "bottom_left")),
}


@query(f"""
WITH {_WORDS}, last AS (SELECT doc_id, page, max(line_no) AS lines FROM w GROUP BY 1, 2),
sections AS (SELECT w.doc_id, w.page, max(CASE WHEN line_no <= 1 THEN y1 END) AS head, min(CASE WHEN line_no > lines - 1 THEN y0 END) AS foot FROM w JOIN last USING (doc_id, page) GROUP BY 1, 2),
t AS ({_hits(_SPECS["passage"].top.texts)}), b AS ({_hits(_SPECS["passage"].bottom.texts)}), l AS ({_hits(_SPECS["column"].left.texts)}),
top AS (SELECT doc_id, page AS pt, top AS t FROM t WHERE phrase = (SELECT min(phrase) FROM t x WHERE x.doc_id = t.doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, n) = 2),
bottom AS (SELECT doc_id, page AS pb, bottom AS b FROM b WHERE phrase = (SELECT min(phrase) FROM b x WHERE x.doc_id = b.doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page DESC, n DESC) = 1),
at_left AS (SELECT doc_id, page AS pt, "left" AS x, bottom AS y FROM l WHERE phrase = (SELECT min(phrase) FROM l x WHERE x.doc_id = l.doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, n) = 1),
spans AS (SELECT doc_id, pb, t, b, CASE WHEN pt = pb AND t >= b THEN pt - 1 ELSE pt END AS pf FROM top JOIN bottom USING (doc_id)),
regions AS (
  SELECT s.doc_id, 'passage' AS name, p.page, bx0 AS min_x, CASE WHEN p.page = pf THEN t ELSE head END AS min_y, bx1 AS max_x, CASE WHEN p.page = pb THEN b ELSE foot END AS max_y FROM spans s JOIN sections p ON p.doc_id = s.doc_id AND p.page BETWEEN pf AND pb JOIN box ON box.doc_id = s.doc_id
  UNION ALL SELECT doc_id, 'column', pt, x, y, bx1, by1 FROM at_left JOIN box USING (doc_id))
SELECT r.doc_id, name, string_agg(word, ' ' ORDER BY r.page, n) AS text, count(DISTINCT r.page) AS n_pages, min(min_y) AS min_y, max(max_y) AS max_y FROM regions r JOIN w ON w.doc_id = r.doc_id AND w.page = r.page
  AND x0 >= min_x - 1 AND x0 <= max_x AND x1 >= min_x AND x1 <= max_x + 1 AND y0 >= min_y AND y0 <= max_y AND y1 >= min_y AND y1 <= max_y GROUP BY 1, 2""")
def q_anchor_regions(spark, sf_dir):
    words = form_words(spark, sf_dir)
    found = forms.regions(words, _SPECS, forms.page_sections(words, 1, 1))
    there = forms.region_words(words, found).select("doc_id", "name", "page").distinct()
    extent = found.join(there, ["doc_id", "name", "page"]).groupBy("doc_id", "name").agg(F.count("*").alias("n_pages"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
    return forms.joined_text(forms.region_words(words, found), ["doc_id", "name"]).join(extent, ["doc_id", "name"])


_LOOP = Delimiters(("and", "und", "et"), ("of", "der", "de"))
_TAIL = Delimiters(("that", "nicht", "pour"), opens=False)


@query(f"""
WITH {_WORDS}, h AS (SELECT *, lag(phrase) OVER (PARTITION BY doc_id ORDER BY page, n) AS beside FROM (SELECT * FROM ({_hits([*_LOOP.first, *_LOOP.second], True)}) QUALIFY row_number() OVER (PARTITION BY doc_id, page, n ORDER BY phrase) = 1)),
e AS (SELECT *, row_number() OVER o AS block, lead(pos) OVER o AS until FROM (SELECT DISTINCT doc_id, (page, top) AS pos FROM h WHERE phrase >= 3 OR coalesce(beside, -1) < 3) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS ({_hits(_TAIL.first, True)}),
f AS (SELECT *, row_number() OVER o AS block, lag(pos) OVER o AS since FROM (SELECT DISTINCT doc_id, (page, bottom) AS pos FROM g) WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT w.doc_id, 'opened' AS kind, block, string_agg(word, ' ' ORDER BY page, n) AS text FROM w JOIN e ON w.doc_id = e.doc_id AND (page, y0) >= pos AND (until IS NULL OR ((page, y0) < until AND (page, y1) <= until)) GROUP BY ALL
UNION ALL SELECT w.doc_id, 'ended', block, string_agg(word, ' ' ORDER BY page, n) FROM w JOIN f ON w.doc_id = f.doc_id AND (page, y1) <= pos AND (since IS NULL OR ((page, y1) > since AND (page, y0) >= since)) GROUP BY ALL""")
def q_loop_blocks(spark, sf_dir):
    words = form_words(spark, sf_dir)
    found = [forms.joined_text(forms.loop_blocks(words, d, ["doc_id"]), ["doc_id", "block"]).withColumn("kind", F.lit(kind)) for kind, d in (("opened", _LOOP), ("ended", _TAIL))]
    return found[0].unionByName(found[1])


_LABELS = ["of the", "the", "of", "de la", "de", "der"]
_LABEL_SQL = f"h AS ({_hits(_LABELS)}), k AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.doc_id = b.doc_id AND a.page = b.page AND b.n <= a.n AND b.last >= a.last AND (b.n < a.n OR b.last > a.last OR b.phrase < a.phrase)))"


@query(f"""
WITH {_WORDS}, {_LABEL_SQL}, m AS (SELECT *, n AS label_no, bottom - 10 AS l_y0, top + 10 AS l_y1 FROM k)
SELECT w.doc_id, w.page, w.n, arg_min(label_no, (greatest(x0 - "right", 0) + greatest(y0 - l_y1, 0), label_no)) AS label_no, min(greatest(x0 - "right", 0) + greatest(y0 - l_y1, 0)) AS distance
FROM w JOIN m ON w.doc_id = m.doc_id AND w.page = m.page AND m."left" <= x0 AND l_y0 <= y0 GROUP BY 1, 2, 3""")
def q_label_groups(spark, sf_dir):
    words = form_words(spark, sf_dir)
    hits = forms.label_hits(words, _LABELS).select("doc_id", "page", F.col("n").alias("label_no"), F.col("left").alias("x0"), (F.col("bottom") - 10).alias("y0"), F.col("right").alias("x1"), (F.col("top") + 10).alias("y1"))
    return forms.nearest_labels(words.select("doc_id", "page", "n", "x0", "y0"), hits).select("doc_id", "page", "n", "label_no", "distance")


_GROUP = GroupBox({"left": "bottom_left", "top": "top_right", "right": "top_right", "bottom": "bottom_left"}, {"right": (("and", "und", "et"), "bottom_left"), "bottom": (("to", "zu", "que"), "top_right")})


@query(f"""
WITH {_WORDS}, {_LABEL_SQL}, r AS ({_hits(_GROUP.until["right"][0])}), d AS ({_hits(_GROUP.until["bottom"][0])}),
xs AS (SELECT doc_id, "left" AS pos, NULL AS label FROM r UNION SELECT doc_id, "left", label FROM k UNION SELECT doc_id, bx1, NULL FROM box),
ys AS (SELECT doc_id, top AS pos, NULL AS label FROM d UNION SELECT doc_id, top, label FROM k UNION SELECT doc_id, by1, NULL FROM box),
x AS (SELECT k.doc_id, k.page, k.n, min(pos) AS pos FROM k JOIN xs ON xs.doc_id = k.doc_id AND pos >= "right" AND xs.label IS DISTINCT FROM k.label GROUP BY 1, 2, 3),
y AS (SELECT k.doc_id, k.page, k.n, min(pos) AS pos FROM k JOIN ys ON ys.doc_id = k.doc_id AND pos >= bottom AND ys.label IS DISTINCT FROM k.label GROUP BY 1, 2, 3)
SELECT k.doc_id, k.page, k.n, k.label, k."left" AS min_x, k.top AS min_y, coalesce(x.pos, k."right") AS max_x, coalesce(y.pos, k.bottom) AS max_y FROM k LEFT JOIN x USING (doc_id, page, n) LEFT JOIN y USING (doc_id, page, n)""")
def q_group_boxes(spark, sf_dir):
    return forms.group_boxes(form_words(spark, sf_dir), _LABELS, _GROUP).drop("last")


@query(f"""
WITH {_WORDS}, c AS (SELECT *, sum(CASE WHEN gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_no ORDER BY n) AS cell FROM (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page, line_no ORDER BY n) AS gap FROM w)),
cells AS (SELECT doc_id, page, line_no, cell, string_agg(word, ' ' ORDER BY n) AS text, min(x0) AS c0, max(x1) AS c1 FROM c GROUP BY 1, 2, 3, 4),
sizes AS (SELECT doc_id, page, line_no, max(cell) + 1 AS m FROM cells GROUP BY 1, 2, 3),
widest AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, page, line_no) = 1),
columns AS (SELECT doc_id, cell, c0, c1, m FROM widest JOIN cells USING (doc_id, page, line_no)),
aligned AS (SELECT s.doc_id, s.page, s.line_no, k.cell, CASE WHEN s.m = k.m THEN max(CASE WHEN x.cell = k.cell THEN x.text END) ELSE coalesce(arg_min(x.text, x.cell) FILTER ((x.c0 <= k.c0 AND x.c1 >= k.c0) OR (k.c0 <= x.c0 AND k.c1 >= x.c0)), '') END AS text
  FROM sizes s JOIN columns k USING (doc_id) JOIN cells x USING (doc_id, page, line_no) GROUP BY s.doc_id, s.page, s.line_no, k.cell, s.m, k.m),
rows_ AS (SELECT doc_id, min((page, line_no)) AS pos, texts FROM (SELECT doc_id, page, line_no, list(text ORDER BY cell) AS texts FROM aligned GROUP BY 1, 2, 3) GROUP BY doc_id, texts),
numbered AS (SELECT doc_id, texts, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS row_no FROM rows_)
SELECT doc_id, row_no, unnest(range(1, len(texts) + 1)) AS column_no, unnest(texts) AS text FROM numbered WHERE row_no > 0""")
def q_table_cells(spark, sf_dir):
    return forms.table_cells(form_words(spark, sf_dir), ["doc_id"], 10.0, header_rows=1)


_CHARS = rf"""
{_WORDS}, c AS (SELECT doc_id, page, n * 100 + unnest(range(length(word)))::INT AS seq, x0, y0 + (n % 3) * 1.5::DOUBLE AS y0, n, word, unnest(range(length(word)))::INT AS k FROM w),
chars AS (SELECT doc_id, page, seq, x0 + k * 5.0::DOUBLE AS x0, y0, x0 + k * 5.0::DOUBLE + CASE WHEN k % 4 = 3 THEN 4.5 ELSE 5.0 END::DOUBLE AS x1, y0 + 9.0::DOUBLE AS y1, substr(word, k + 1, 1) AS char, CASE WHEN n % 5 = 0 THEN 'b' ELSE 'r' END AS font, 9 AS size, y0 - (n % 3) * 1.5 AS line_y FROM c)"""


def form_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of the form words, in two fonts; words of a line are not quite level."""
    words = form_words(spark, sf_dir)
    of = words.select("doc_id", "page", "n", "x0", (F.col("y0") + F.col("n") % 3 * 1.5).alias("y0"), F.when(F.col("n") % 5 == 0, "b").otherwise("r").alias("font"), F.posexplode(F.split("word", "")).alias("k", "char"))
    x = F.col("x0") + F.col("k") * 5.0
    return of.select("doc_id", "page", (F.col("n") * 100 + F.col("k")).alias("seq"), x.alias("x0"), "y0", (x + F.when(F.col("k") % 4 == 3, 4.5).otherwise(5.0)).alias("x1"), (F.col("y0") + 9.0).alias("y1"), "char", "font", F.lit(9).alias("size"))


@query(f"""
WITH {_CHARS}, l AS (SELECT *, row_number() OVER o AS place, x0 - lag(x1) OVER o AS gap, lag(font) OVER o IS DISTINCT FROM font AS other FROM chars WHERE trim(char) <> '' WINDOW o AS (PARTITION BY doc_id, page, line_y ORDER BY x0, y0, x1, y1, seq)),
m AS (SELECT doc_id, page, line_y, arg_max(gap, (n, -first)) AS mode FROM (SELECT doc_id, page, line_y, greatest(gap, 0) AS gap, count(*) AS n, min(place) AS first FROM l WHERE gap IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
b AS (SELECT l.*, sum(CASE WHEN place > 1 AND (coalesce(floor(gap) > mode, false) OR other) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_y ORDER BY place ROWS UNBOUNDED PRECEDING) AS word_no FROM l LEFT JOIN m USING (doc_id, page, line_y)),
words AS (SELECT doc_id, page, line_y, word_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS top, max(y1) AS bottom, string_agg(char, '' ORDER BY place) AS word, arg_min(font, place) AS font FROM b GROUP BY 1, 2, 3, 4),
lines AS (SELECT doc_id, page, line_y, max(bottom) - min(top) AS h, min(top) AS top FROM words GROUP BY 1, 2, 3),
laid AS (SELECT *, 20 + sum(h + 1) OVER (PARTITION BY doc_id, page ORDER BY top ROWS UNBOUNDED PRECEDING) - 1 AS bottom FROM lines)
SELECT doc_id, page, word_no, x0, x1, word, font, round(laid.bottom - h, 3) AS y0, round(laid.bottom, 3) AS y1 FROM words JOIN laid USING (doc_id, page, line_y)""")
def q_words_from_boxes(spark, sf_dir):
    return forms.laid_words(form_characters(spark, sf_dir)).select("doc_id", "page", "word_no", "x0", "x1", "word", "font", "y0", "y1")


@query(f"""
WITH {_WORDS}, e AS (SELECT doc_id, page, n, word, x0, y0, x1, y1, CASE n WHEN 3 THEN 'passage' ELSE 'column' END AS name FROM w WHERE page = 1 AND n IN (3, 4)),
once AS (SELECT e.doc_id, e.name, e.x0, e.y0, e.x1, e.y1 FROM e JOIN w ON w.doc_id = e.doc_id AND w.page = 1 AND contains(w.word, e.word) GROUP BY ALL HAVING count(*) = 1)
SELECT name, max(ceil(greatest(0, 170.25 - x0, x1 - 190)))::BIGINT AS x_margin, max(ceil(greatest(0, 1.5 - y0, y1 - 8)))::BIGINT AS y_margin, count(*) AS n FROM once GROUP BY 1""")
def q_margin_fit(spark, sf_dir):
    words = form_words(spark, sf_dir)
    mine = words.filter("page = 1 AND n IN (3, 4)").select("doc_id", "page", F.when(F.col("n") == 3, "passage").otherwise("column").alias("name"), F.col("word").alias("text"))
    found = mine.select("doc_id", "page", "name", F.lit(170.25).alias("min_x"), F.lit(1.5).alias("min_y"), F.lit(190.0).alias("max_x"), F.lit(8.0).alias("max_y"))
    return forms.margin_fit(words, found, mine.drop("page"))
