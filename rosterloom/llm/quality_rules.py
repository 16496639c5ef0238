"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Fixed rules come first. Then, for each language and source, a minimum-covariance-determinant
estimate of transformed statistics is reached by concentration steps: keep the nearer ``CORE``
of the rows, take their mean and covariance, and repeat until the determinant stops falling.
Several fixed starts run side by side, keyed by group and start; the least determinant wins.
A text whose Mahalanobis distance is beyond the cutoff is rejected. Every step is one grouped
aggregation with partial sums or quantile sketches, so a hot source costs no single task more
than its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.shared import cut, let, with_row_id

SPACE = r"\x20\x09-\x0D"
#: Symbols that are counted.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Share of a group's rows that a concentration step keeps. A start is done when a step lowers
#: the logarithm of its determinant by less than ``SETTLED``; ``STEPS`` only bounds the loop.
CORE, SETTLED, STEPS = 0.75, 1e-3, 100
#: Starts: diagonal of quartile ranges; covariance of all rows, of their hyperbolic tangents and
#: of their directions from the median.
STARTS = ["diagonal", "all", "tanh", "sign"]
#: 0.9999 quantile of chi-square with as many degrees as there are statistics (5), and the
#: factor that makes the covariance of the nearer 0.75 consistent at the normal distribution.
CUTOFF, CONSISTENT = 25.745, 1.41
#: Groups of fewer rows are held against all rows of their language, those of a rare language
#: against the whole table.
GROUP_ROWS = 200
#: Up to so many groups (some 30 numbers each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 50_000

#: The statistics, each with the standard deviation that it has at least: where most texts have
#: none of a thing, one repeated line or a few symbols must not put a text far away. Each is
#: low enough for its statistic alone to pass the cutoff (a share of 0.26 at 0.1).
FLOORS = {"word_size": 0.1, "symbol_share": 0.05, "repeat_share": 0.1, "capital_share": 0.1, "line_share": 0.1}
STATISTICS = list(FLOORS)


#: Columns of a group's estimate: centre, and lower Cholesky factor of the scatter.
FACTOR = [*(f"m_{i}" for i in range(len(STATISTICS))), *(f"l_{i}_{j}" for i in range(len(STATISTICS)) for j in range(i + 1))]


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more."""
    def covered(codes):
        ordered = F.sort_array(F.transform(codes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s):
            twin = lambda j: ((j > 0) & (F.get(s, j - 1)["x"] == F.get(s, j)["x"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["x"] == F.get(s, j)["x"]))
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(twin(j), F.lit(False))), lambda j: F.get(s, j)["i"]))

        total = F.aggregate(
            let(ordered, places),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
        )
        return F.when(F.size(F.array_distinct(codes)) < F.size(codes), total["n"]).otherwise(0)

    codes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, let(codes, covered)).otherwise(0)


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and the transformed statistics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = " \t\n\x0b\f\r"
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, spaces, "")) > 0)
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    rows = with_row_id(documents.select("doc_id", "lang", "source", "text")).select(
        "_row", "doc_id", "lang", "source",
        F.length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("capitals"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))).alias("words"),
    ).select(
        "_row", "doc_id", "lang", "source", "word_chars", "n_symbols", "capitals", F.col("lines.n").alias("n_lines"),
        F.col("words.n").cast("long").alias("n_words"), F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.repeated").cast("long").alias("n_repeat_words"),
    )
    some = lambda c: F.greatest(F.col(c), F.lit(1))
    return rows.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        "word_size": F.log1p(F.col("word_chars") / some("n_words")),
        "symbol_share": F.sqrt(F.col("n_symbols") / some("word_chars")),
        "repeat_share": F.sqrt(F.col("n_repeat_words") / some("n_words")),
        "capital_share": F.sqrt(F.col("capitals") / some("word_chars")),
        "line_share": F.sqrt(F.col("n_dup_lines") / some("n_lines")),
    }).drop("capitals", "n_lines")


def _with(rows: DataFrame, groups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, keys or "_group")


def _factor(groups: DataFrame) -> DataFrame:
    """The lower Cholesky factor (l_i_j) of every group's covariance (c_i_j)."""
    p = len(STATISTICS)
    for j in range(p):
        own = reduce(lambda a, k: a - F.col(f"l_{j}_{k}") ** 2, range(j), F.col(f"c_{j}_{j}"))
        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(FLOORS[STATISTICS[j]] ** 2))))
        below = {f"l_{i}_{j}": reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}")) / F.col(f"l_{j}_{j}") for i in range(j + 1, p)}
        groups = groups.withColumns(below) if below else groups
    logarithm = reduce(lambda a, i: a + F.log(f"l_{i}_{i}"), range(1, p), F.log("l_0_0"))
    return groups.select("_group", "_start", *FACTOR, logarithm.alias("size"))


def _distance(rows: DataFrame) -> DataFrame:
    """Add ``distance``: the squared Mahalanobis distance, by forward substitution."""
    for i, name in enumerate(STATISTICS):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"z_{k}"), range(i), F.col(name) - F.col(f"m_{i}"))
        rows = rows.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    return rows.withColumn("distance", reduce(lambda a, i: a + F.col(f"z_{i}") ** 2, range(1, len(STATISTICS)), F.col("z_0") ** 2))


def _moments(rows: DataFrame, values: list[str]) -> DataFrame:
    """Centre and factor of every group and start, and ``size``, half the logarithm of its determinant."""
    p = len(STATISTICS)
    moments = rows.groupBy("_group", "_start").agg(
        *(F.avg(values[i]).alias(f"m_{i}") for i in range(p)),
        *(((CONSISTENT * F.covar_pop(values[i], values[j])) + (FLOORS[STATISTICS[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)),
    )
    return _factor(cut(moments))


def _starts(rows: DataFrame) -> DataFrame:
    """An estimate for every group and start."""
    p = len(STATISTICS)
    quartiles = rows.groupBy("_group").agg(*(F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, s in enumerate(STATISTICS)))
    spread = lambda i: F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FLOORS[STATISTICS[i]]))
    groups = cut(quartiles.select("_group", *(F.col(f"q_{i}")[1].alias(f"q_{i}") for i in range(p)), *(spread(i).alias(f"s_{i}") for i in range(p))))
    diagonal = groups.select("_group", F.lit(0).alias("_start"), *(F.col(f"q_{i}").alias(f"m_{i}") for i in range(p)), *((F.col(f"s_{i}") if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)))
    scaled = _with(rows, groups).withColumns({f"u_{i}": (F.col(s) - F.col(f"q_{i}")) / F.col(f"s_{i}") for i, s in enumerate(STATISTICS)})
    norm = F.greatest(F.sqrt(reduce(lambda a, i: a + F.col(f"u_{i}") ** 2, range(1, p), F.col("u_0") ** 2)), F.lit(1e-9))
    scaled = scaled.withColumn("norm", norm).withColumn("_start", F.explode(F.array(*map(F.lit, range(1, len(STARTS))))))
    bent = lambda u: F.when(F.col("_start") == STARTS.index("all"), u).when(F.col("_start") == STARTS.index("tanh"), F.tanh(u)).otherwise(u / F.col("norm"))
    bent = scaled.select("_group", "_start", *((F.col(f"q_{i}") + F.col(f"s_{i}") * bent(F.col(f"u_{i}"))).alias(f"b_{i}") for i in range(p)))
    others = _moments(bent, [f"b_{i}" for i in range(p)])
    return cut(diagonal.unionByName(others.drop("size")).withColumn("size", F.lit(None).cast("double")))


def robust_groups(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre (m_i) and Cholesky factor of the scatter (l_i_j) of every group of ``rows``, of the least determinant of all starts."""
    active, done = _starts(rows), None
    for _ in range(steps):
        near = _distance(_with(rows, active.select("_group", "_start", *FACTOR)))
        reach = cut(near.groupBy("_group", "_start").agg(F.percentile_approx("distance", CORE, 1000).alias("reach")))
        near = _with(near, reach, ["_group", "_start"]).filter(F.col("distance") <= F.col("reach"))
        moved = _moments(near, STATISTICS).join(active.select("_group", "_start", F.col("size").alias("was")), ["_group", "_start"])
        # size is half of the logarithm
        moved = cut(moved.withColumn("falls", F.col("was").isNull() | (2 * (F.col("was") - F.col("size")) >= SETTLED)))
        settled = moved.filter(~F.col("falls")).drop("was", "falls")
        done = settled if done is None else done.unionByName(settled)
        active = cut(moved.filter("falls").drop("was", "falls"))
        if active.isEmpty():
            break
    all_starts = active if done is None else done.unionByName(active.select(done.columns))
    best = all_starts.groupBy("_group").agg(F.min(F.struct("size", "_start", *FACTOR)).alias("best"))
    return cut(best.select("_group", *(F.col("best")[c].alias(c) for c in FACTOR)))


def judge(documents: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null and empty texts have no words and fail the base rules; a null lang or source is
    a group value of its own; rows with equal or null doc_id stay apart; other columns are
    ignored. Rows that fail the base rules take no part in the estimates. Only rows that
    fail the base rules have no distance.
    """
    rows = cut(text_statistics(documents))
    passed = rows.filter(~F.col("base_failed"))
    pair = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    lang = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")), F.lit("*"))
    sizes = cut(passed.groupBy(pair.alias("_pair"), lang.alias("_lang")).count())
    langs = sizes.groupBy("_lang").agg(F.sum("count").alias("lang_count"))
    chosen = cut(sizes.join(langs, "_lang").select(
        "_pair", "_lang",
        F.when(F.col("count") >= GROUP_ROWS, F.col("_pair")).when(F.col("lang_count") >= GROUP_ROWS, F.col("_lang")).otherwise("*").alias("_group"),
    ))
    # A row counts in every group that any pair is held against: its own, its language's, the table's.
    wanted = chosen.select("_group").distinct()
    mine = chosen.select("_pair", F.explode(F.array("_pair", "_lang", F.lit("*"))).alias("_group")).join(wanted, "_group").groupBy("_pair").agg(F.collect_list("_group").alias("_groups"))
    chosen = cut(chosen.select("_pair", "_group").join(mine, "_pair"))
    few = chosen.count() <= BROADCAST_GROUPS
    grouped = passed.withColumn("_pair", pair).join(F.broadcast(chosen) if few else chosen, "_pair").drop("_pair")
    grouped = cut(grouped.select("_group", "_groups", "_row", "doc_id", *STATISTICS, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    members = grouped.select(F.explode("_groups").alias("_group"), *STATISTICS)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measured = _distance(_with(grouped, robust_groups(members))).select(*columns, (F.col("distance") <= cutoff).alias("kept"), "distance")
    failed = rows.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return measured.unionByName(failed)
