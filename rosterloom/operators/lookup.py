"""Lookup of texts in reference grids: exact, within edits, or by words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda w: w != "")


def normal(value: Column) -> Column:
    return F.array_join(words(value), " ")


def variants(word: Column, edits: int) -> Column:
    """``word`` and what is left of it without up to ``edits`` letters: words within ``edits`` have one in common."""
    found = F.array(word)
    for _ in range(edits):
        fewer = F.transform(found, lambda w: F.transform(F.sequence(F.lit(0), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w)))))
        found = F.array_distinct(F.concat(found, F.flatten(fewer)))
    return found


def near_keys(word: Column, edits: int, asked: bool) -> Column:
    """Keys by which an ``asked`` word meets a grid word (not ``asked``): of any two within ``edits`` one is the same.

    Within one edit two words are equal, or one is the other without a letter, or both are equal without the
    letter at the same place. These have keys of their own, so that no other words meet; more edits go by ``variants``.
    """
    if edits != 1:
        return variants(word, edits)
    fewer = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    placed = F.transform(fewer, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w))
    other = F.transform(fewer, lambda w: F.concat(F.lit("-"), w)) if asked else F.concat(fewer, F.array(F.concat(F.lit("-"), word)))
    return F.concat(F.array(word), F.array_distinct(other), placed)


def lookup_exact(frame: DataFrame, column: str, grid: DataFrame, grid_column: str) -> DataFrame:
    """The grid row with the same words in the same order: an equi-join on normalised text, the first row of equals. A text without words has none."""
    first = Window.partitionBy("_normal").orderBy("grid_no")
    small = grid.withColumn("_normal", normal(F.col(grid_column))).filter("_normal != ''").withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
    return frame.withColumn("_normal", normal(F.col(column))).join(small, "_normal", "left").drop("_normal")


def stem(word: Column) -> Column:
    """A word without its plural or verb ending: a light English stem of three letters or more."""
    out = F.regexp_replace(word, "ies$", "y")
    for ending in ("(?<=(?:ss|sh|ch|x|z))es$", "(?<![s])s$", "(?<=[a-z]{3})ing$", "(?<=[a-z]{3})ed$"):
        out = F.regexp_replace(out, ending, "")
    return out


def _rarest_keys(asked: DataFrame, grid_keys: DataFrame, edits: int, least: float) -> DataFrame:
    """_asked and _key: the keys of so many of a text's words, by the grid rows they would meet, that a match has one of them."""
    words_ = asked.select("_asked", F.size("_q").alias("_n"), F.posexplode("_q").alias("_place", "_word"))
    variants_ = words_.select("_asked", "_n", "_place", F.explode(near_keys(F.col("_word"), edits, True)).alias("_key"))
    # A short grid has many variants, which Spark's estimate of its size doesn't know: no side is broadcast.
    counted = variants_.join(grid_keys.groupBy("_key").agg(F.count("*").alias("_rows")).hint("merge"), "_key", "left")
    weighed = counted.groupBy("_asked", "_n", "_place").agg(F.sum(F.coalesce("_rows", F.lit(0))).alias("_rows"), F.collect_list("_key").alias("_keys"))
    needed = F.greatest(F.ceil(F.col("_n") * least - 1e-9), F.lit(1))
    rarest = F.row_number().over(Window.partitionBy("_asked").orderBy("_rows", "_place")) <= F.col("_n") - needed + 1
    return weighed.withColumn("_kept", rarest).filter("_kept").select("_asked", F.explode("_keys").alias("_key")).distinct()


#: So many words that a grid and the asked texts may have in common are named in the plan; more are joined.
NAMED = 1000


def _seen_words(asked: DataFrame, held: DataFrame, edits: int) -> DataFrame:
    """``held`` (grid_no, _g) with _seen and _size: the words of a grid row that share a key with an asked word, and how many it has; rows without such a word go.

    Rows that look alike to all asked texts are alike in both, so that they are scored once.
    """
    cut = lambda frame, column, own: frame.select(F.explode(column).alias("_word")).distinct().select("_word", F.explode(near_keys(F.col("_word"), edits, own)).alias("_key"))
    known = cut(held, "_g", False).join(cut(asked, "_q", True).select("_key").distinct().hint("merge"), "_key", "left_semi").select("_word").distinct()
    few = [r["_word"] for r in known.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        seen = held.withColumn("_seen", F.array_sort(F.array_distinct(F.filter("_g", lambda w: w.isin(few))))).filter(F.size("_seen") > 0)
    else:
        rows = held.select("grid_no", "_g", F.explode(F.array_distinct("_g")).alias("_word")).join(known.hint("merge"), "_word")
        seen = rows.groupBy("grid_no", "_g").agg(F.array_sort(F.collect_set("_word")).alias("_seen"))
    return seen.withColumn("_size", F.size("_g"))


def _scored(asked: DataFrame, grid: DataFrame, grid_column: str, edits: int, every: bool, restrict: bool, least: float, stemmed: bool) -> tuple[DataFrame, DataFrame]:
    """Scores of asked texts with what they see of grid rows (_asked, _q, _seen, _size, score), and the grid rows behind that (grid_no, _g, _seen, _size)."""
    cut = lambda c: F.transform(words(c), stem) if stemmed else words(c)
    asked = asked.withColumn("_q", cut(F.col("_text"))).filter(F.size("_q") > 0)
    held = grid.select("grid_no", cut(F.col(grid_column)).alias("_g")).filter(F.size("_g") > 0)
    near = lambda q, g: F.levenshtein(q, g) <= edits
    keys = lambda found, own: F.explode(F.array_distinct(F.flatten(F.transform(found, lambda w: near_keys(w, edits, own))))).alias("_key")
    # Spark's estimates don't know how many words and variants a short table has: none of these is broadcast.
    seen = _seen_words(asked, held, edits)
    grid_keys = seen.select("_seen", "_size").distinct().select("_seen", "_size", keys("_seen", False))
    asked_keys = _rarest_keys(asked, grid_keys, edits, 1.0 if every else least) if every or least else asked.select("_asked", keys("_q", True))
    # Dealt out by text once: what follows, to the best of a text, stays there. The number keeps many narrow pairs from being merged into a few tasks.
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = asked_keys.join(grid_keys.hint("merge"), "_key").select("_asked", "_seen", "_size").repartition(parts, "_asked").distinct()
    pairs = shared.join(asked.select("_asked", "_q").hint("merge"), "_asked")
    size, hit = F.size("_q"), F.size(F.filter("_q", lambda q: F.exists("_seen", lambda g: near(q, g))))
    # One condition, and with ``every`` no count besides: each mention of ``hit`` compares all words again.
    wanted = size if every else F.greatest(F.lit(1), size * least) if least else F.lit(1)
    pairs = pairs.filter(hit >= wanted).withColumn("_hit", size if every else hit)
    pairs = pairs.withColumn("score", F.col("_hit") * 1.0 + F.when(F.col("_size") == size, size + 1).otherwise(0))
    if restrict:
        pairs = pairs.filter(F.col("_size") == size)
    return pairs.select("_asked", "_q", "_seen", "_size", "score"), seen


def _with_rows(scores: DataFrame, seen: DataFrame) -> DataFrame:
    """_asked, grid_no, score and edits of ``scores`` with each grid row behind them."""
    pairs = scores.join(seen.hint("merge"), ["_seen", "_size"])
    return pairs.select("_asked", "grid_no", "score", F.levenshtein(F.array_join("_q", " "), F.array_join("_g", " ")).alias("edits"))


def scored_pairs(asked: DataFrame, grid: DataFrame, grid_column: str, edits: int = 1, every: bool = False, restrict: bool = False, least: float = 0.0, stemmed: bool = False) -> DataFrame:
    """_asked, grid_no, score and edits of all pairs of ``asked`` (_asked, _text) and grid rows with a word in common, within ``edits``.

    ``every`` word must be found, or a share of ``least`` (else any); ``restrict`` also wants as many words. The score
    is how many words are found, and one more than their number if the grid row has as many
    words. Candidates share a variant of a word, by an equi-join at any size. Where more than one
    word must be found, a text asks only by its rarest words, of which one must be among those: a
    word that all texts and grid rows have brings no candidates then.
    """
    return _with_rows(*_scored(asked, grid, grid_column, edits, every, restrict, least, stemmed))


def _best_pairs(frame: DataFrame, column: str, grid: DataFrame, grid_column: str, edits: int, every: bool = False, restrict: bool = False, least: float = 0.0, stemmed: bool = False) -> DataFrame:
    """``scored_pairs`` of the distinct texts of a column, with only the best score of each: other grid rows are not met."""
    asked = frame.select(F.col(column).alias("_asked")).distinct().withColumn("_text", F.col("_asked"))
    scores, seen = _scored(asked, grid, grid_column, edits, every, restrict, least, stemmed)
    rank = F.rank().over(Window.partitionBy("_asked").orderBy(F.desc("score")))
    return _with_rows(scores.withColumn("_rank", rank).filter("_rank = 1").drop("_rank"), seen)


def lookup_fuzzy(frame: DataFrame, column: str, grid: DataFrame, grid_column: str, edits: int = 1, every: bool = False, restrict: bool = False, least: float = 0.0, stemmed: bool = False) -> DataFrame:
    """The best grid row for each text by ``scored_pairs``; ties go to fewer edits in all, then to the lower grid_no.

    Distinct texts are looked up once; a text without a match has nulls.
    """
    pairs = _best_pairs(frame, column, grid, grid_column, edits, every, restrict, least, stemmed)
    best = pairs.groupBy("_asked").agg(F.min(F.struct("edits", "grid_no")).alias("_best"), F.max("score").alias("score"))
    best = best.select("_asked", "_best.grid_no", "score").join(grid.hint("merge"), "grid_no")
    return frame.join(best, F.col(column) == F.col("_asked"), "left").drop("_asked")


def leading_hits(frame: DataFrame, column: str, grid: DataFrame, grid_column: str, edits: int = 0) -> DataFrame:
    """All grid rows of the best score for each text, not one of them; a text without a match has one row of nulls."""
    rank = F.rank().over(Window.partitionBy("_asked").orderBy("edits"))
    best = _best_pairs(frame, column, grid, grid_column, edits).withColumn("_rank", rank).filter("_rank = 1")
    return frame.join(best.select("_asked", "grid_no", "score").join(grid.hint("merge"), "grid_no"), F.col(column) == F.col("_asked"), "left").drop("_asked")


@dataclass(frozen=True)
class FieldQuery:
    """One field of a composite lookup: a column against a grid column. A field that is not ``must`` only adds to the score."""

    column: str
    grid_column: str
    edits: int = 1
    must: bool = True
    every: bool = False
    restrict: bool = False


def lookup_composite(frame: DataFrame, grid: DataFrame, fields: list[FieldQuery]) -> DataFrame:
    """The best grid row by several fields at once: all that ``must`` match, by the sum of scores, then edits, then grid_no."""
    if not any(f.must for f in fields):
        raise ValueError("one field must match")
    columns = list(dict.fromkeys(f.column for f in fields))
    key = F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns))))
    asked = frame.withColumn("_asked", key)
    distinct = asked.select("_asked", *columns).dropDuplicates(["_asked"])
    found = None
    for i, f in enumerate(sorted(fields, key=lambda f: not f.must)):
        pairs = scored_pairs(distinct.select("_asked", F.col(f.column).cast("string").alias("_text")), grid, f.grid_column, f.edits, f.every, f.restrict)
        pairs = pairs.withColumnsRenamed({"score": f"score{i}", "edits": f"edits{i}"})
        found = pairs if found is None else found.join(pairs, ["_asked", "grid_no"], "inner" if f.must else "left")
    total = lambda name: sum((F.coalesce(F.col(f"{name}{i}"), F.lit(0)) for i in range(len(fields))), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("_asked").orderBy(F.desc("score"), "edits", "grid_no"))
    best = found.select("_asked", "grid_no", total("score").alias("score"), total("edits").alias("edits")).withColumn("_rank", rank).filter("_rank = 1")
    return asked.join(best.select("_asked", "grid_no", "score").join(grid, "grid_no"), "_asked", "left").drop("_asked")


def all_rows(grid: DataFrame, most: int = 10_000) -> DataFrame:
    """The grid as it is: its first ``most`` rows by number, which is what a lookup of everything returns."""
    return grid.orderBy("grid_no").limit(most)


def lookup_ladder(frame: DataFrame, column: str, grid: DataFrame, grid_column: str) -> DataFrame:
    """Exact, else all words within one edit, else any word: each rung looks up what the one above left."""
    given = [c for c in frame.columns]
    exact = lookup_exact(frame, column, grid, grid_column)
    found = exact.filter(F.col("grid_no").isNotNull()).withColumn("rung", F.lit("exact"))
    rest = exact.filter(F.col("grid_no").isNull()).select(*given)
    fuzzy = lookup_fuzzy(rest, column, grid, grid_column, 1, every=True, restrict=True).drop("score")
    near = fuzzy.filter(F.col("grid_no").isNotNull()).withColumn("rung", F.lit("fuzzy"))
    rest = fuzzy.filter(F.col("grid_no").isNull()).select(*given)
    loose = lookup_fuzzy(rest, column, grid, grid_column, 0).drop("score")
    last = loose.withColumn("rung", F.when(F.col("grid_no").isNotNull(), "words").otherwise("none"))
    return found.unionByName(near).unionByName(last)
