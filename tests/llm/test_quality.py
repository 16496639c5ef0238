import collections
import re
import zlib

import pytest

from rosterloom.llm import quality_model, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(again)
    return *out, out[0] < 50 or 100 * out[4] > 50 * out[0]


def test_base_counts(spark, prose):
    texts = ["", None, " \n\t", "a", "a b", "a b c a b c", "x y z x y z x", "#*$%&|<> é漢 😀", "l\nl\n\n \nl \nm", "a a a a", prose(1, 60) + "\n" + prose(1, 60), "w\x0bv\x0cu\rt", prose(2, 200), "a b c d a b c d " * 40, "no break space"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'l' AS lang", "'s' AS source").repartition(3)
    rows = sorted(quality_rules.judge(frame).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:7] for r in rows] == [base(t) for t in texts]
    assert all(not r.kept for r in rows if r.base_failed)


def test_outliers_of_a_source_are_rejected(spark, prose):
    rows = [(i, prose(i, 60 + i % 50).capitalize() + ".", "en", f"s{i % 2}") for i in range(500)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(i, 80).split()), "en", "s0") for i in range(20)]
    rows += [(2000 + i, prose(i, 80).upper(), "en", "s1") for i in range(20)]
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert not {i for i in range(1000, 3000)} & kept and len(kept & set(range(500))) >= 495


def test_odd_rows(odd_rows, no_rows):
    rows = quality_rules.judge(odd_rows).collect()
    assert len(rows) == 16 and all(tuple(r)[1:7] == base(None) for r in rows if r.doc_id in (3, 4, None) and r.n_words == 0)
    assert quality_rules.judge(no_rows).count() == 0


def judged(spark, rows):
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    return {r.doc_id for r in found if r.kept}, {r.doc_id for r in found if r.base_failed}


def test_small_sources_are_held_against_their_language(spark, prose):
    """Beside one hot source: sources of one and of five rows, and a rare language."""
    rows = [(i, prose(i, 60 + i % 50).capitalize() + ".", "en", "hot") for i in range(400)]
    odd = lambda i: " ".join(w.upper() + "###" for w in prose(i, 80).split())
    rows += [(1000, odd(1), "en", "lone"), (1001, odd(2), "fr", "rare")]
    rows += [(1100 + i, odd(i), "en", "few") for i in range(5)]
    rows += [(2000 + i, prose(i + 900, 70).capitalize() + ".", "en", "small") for i in range(5)] + [(2010, prose(950, 70).capitalize() + ".", "fr", "rare")]
    kept, _ = judged(spark, rows)
    assert not kept & set(range(1000, 2000)) and {*range(2000, 2005), 2010} <= kept and len(kept & set(range(400))) >= 396


def test_one_statistic_alone_rejects(spark, prose):
    import random

    rows = [(i, prose(i, 60 + i % 50).capitalize() + ".", "en", "s") for i in range(300)]
    pick = random.Random(1)
    rows += [(1000, "\n".join(pick.choice(prose(7, 20).split()) for _ in range(300)), "en", "s")]
    passage = prose(8, 24)
    rows += [(1001, f"{prose(9, 27)} {passage} {prose(10, 27)} {passage}", "en", "s")]
    kept, failed = judged(spark, rows)
    assert not failed and not kept & {1000, 1001} and len(kept) >= 297


def test_concentration_steps_reach_the_least_determinant(spark):
    """No further step lowers the determinant, and rows that lie together apart from the others are left out of the estimate."""
    import numpy as np

    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 1)) * np.ones((1, 5)) + 0.15 * rng.normal(size=(300, 5))
    apart = 0.15 * rng.normal(size=(70, 5)) + 1.5 * np.array([1, -1, 1, -1, 1])
    values = np.vstack([good, apart])
    frame = spark.createDataFrame([("g", *map(float, v)) for v in values], ["_group", *quality_rules.STATISTICS]).repartition(3)
    found = quality_rules.robust_groups(frame).collect()
    assert len(found) == 1
    centre = np.array([found[0][f"m_{i}"] for i in range(5)])
    lower = np.array([[found[0][f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    floors = np.diag([quality_rules.FLOORS[s] ** 2 for s in quality_rules.STATISTICS])

    def step(centre, lower):
        away = (np.linalg.solve(lower, (values - centre).T) ** 2).sum(0)
        near = values[np.argsort(away)[: int(np.ceil(quality_rules.CORE * len(values)))]]
        return near.mean(0), np.linalg.cholesky(quality_rules.CONSISTENT * np.cov(near.T, bias=True) + floors), away

    size = lambda x: 2 * np.log(np.diag(x)).sum()
    _, next_lower, away = step(centre, lower)
    assert size(lower) - size(next_lower) < 0.01
    best = np.inf
    for seed in range(20):
        some = values[np.random.default_rng(seed).choice(len(values), 12, replace=False)]
        m, x = some.mean(0), np.linalg.cholesky(np.cov(some.T) + floors)
        for _ in range(60):
            m, x, _ = step(m, x)
        best = min(best, size(x))
    assert size(lower) <= best + 0.05 and (away[300:] > quality_rules.CUTOFF).all()


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rows = [(i, prose(i, 40 + i % 60), 1) for i in range(300)] + [(1000 + i, " | ".join(prose(i, 40).split()) + " !!", 0) for i in range(100)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], None) for r in rows], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(labelled):
    docs, labels = labelled
    rows = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all((r.score >= quality_model.THRESHOLD) == (r.doc_id < 1000) and 0 <= r.score <= 1 for r in held)


def test_dual_descent_separates():
    import numpy as np

    rows = [np.array([k % 2, 2]) for k in range(40)]
    positive = np.array([k % 2 == 1 for k in range(40)])
    weights, bias = quality_model.dual_descent(rows, np.array([-1.0, 1.0, 0.1]), positive)
    margins = quality_model._margins(rows, weights, np.array([-1.0, 1.0, 0.1]), bias)
    assert ((margins > 0) == positive).all()


def naive_features(text):
    """The hashed n-grams of one text, gram by gram."""
    import numpy as np

    from rosterloom.llm.words import grams, hashes, mix

    m, data, out = quality_model, text.encode(), set()
    kinds = [list(data), [int(m.CLASS[b]) for b in data]]
    for family, sizes in enumerate((m.BYTE_GRAMS, m.CLASS_GRAMS)):
        for n in sizes:
            for i in range(len(data) - n + 1):
                code = 0
                for b in kinds[family][i : i + n]:
                    code = (code * 257 + b) % 2**64
                with np.errstate(over="ignore"):
                    out.add(int(mix(np.array([(code + (n << 56)) % 2**64], np.uint64))[0]) % m.BUCKETS + family * m.BUCKETS)
    spans = [w.span() for w in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    words = np.array([int(hashes(np.frombuffer(data, np.uint8), np.array([a]), np.array([b]))[0]) for a, b in spans], np.uint64)
    for n in m.WORD_GRAMS:
        out |= {int(c) % m.BUCKETS + 2 * m.BUCKETS for c in grams(words, np.zeros(len(words), np.int64), n)[0]}
    return sorted(out)


def test_scores_are_those_of_a_dense_model(spark, prose):
    """Log-count ratios, dual descent and margins over a dense matrix of naive features."""
    import math

    import numpy as np

    m = quality_model
    texts = {i: prose(i, 25) if i % 3 else " | ".join(prose(i, 12).split()) + " é #" for i in range(60)} | {100: "", 101: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    fitted = m.fit(docs, labels)
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    found = {i: naive_features(t) for i, t in texts.items()}
    used = sorted({f for row in found.values() for f in row})
    place = {f: k for k, f in enumerate(used)}
    have = {i: np.array([f in set(row) for f in used]) for i, row in found.items()}
    order = sorted(learned, key=lambda i: (m.packed(np.array(found[i])), int(i % 3 > 0)))
    positive = np.array([i % 3 > 0 for i in order])
    matrix = np.array([have[i] for i in order], float)
    counts = [m.SMOOTH + matrix[positive == y].sum(0) for y in (False, True)]
    totals = [c.sum() + m.SMOOTH * (3 * m.BUCKETS - len(used)) for c in counts]
    ratios = np.log((counts[1] / totals[1]) / (counts[0] / totals[0]))
    assert np.allclose(fitted.values[used], ratios)
    x = matrix * ratios
    x /= np.maximum(1e-9, np.sqrt((x**2).sum(1, keepdims=True)))
    sign, weights, bias, dual = np.where(positive, 1.0, -1.0), np.zeros(len(used)), 0.0, np.zeros(len(order))
    cost = m.COST * 10 * np.where(positive, 0.5 / positive.mean(), 0.5 / (1 - positive.mean()))
    rng = np.random.default_rng(7)
    for _ in range(m.PASSES):
        for i in rng.permutation(len(order)):
            new = min(cost[i], max(0.0, dual[i] - (sign[i] * (weights @ x[i] + bias) - 1) / ((x[i] ** 2).sum() + 1)))
            weights, bias, dual[i] = weights + (new - dual[i]) * sign[i] * x[i], bias + (new - dual[i]) * sign[i], new
    assert np.allclose(fitted.weights[used], weights * ratios) and abs(fitted.model.bias - bias) < 1e-9
    primal = 0.5 * (weights @ weights + bias**2) + (cost * np.maximum(0, 1 - sign * (x @ weights + bias))).sum()
    assert primal - (dual.sum() - 0.5 * (weights @ weights + bias**2)) < 0.1 * primal  # near the least hinge loss
    for r in m.score(docs, fitted).collect():
        row = [place[f] for f in found[r.doc_id]]
        margin = (weights * ratios)[row].sum() / max(1e-9, math.sqrt((ratios[row] ** 2).sum())) + bias
        assert abs(r.score - fitted.model.score(margin)) < 1e-9


def test_packed_features(spark):
    import numpy as np

    for found in (np.array([], int), np.arange(5), np.arange(0, 3 * quality_model.BUCKETS, 2)):
        data = quality_model.packed(found)
        assert len(data) <= quality_model.SET_BYTES and quality_model.unpacked(data).tolist() == found.tolist()


def test_repeated_doc_ids_count_once(labelled):
    docs, labels = labelled
    import numpy as np

    one, twice = quality_model.fit(docs, labels), quality_model.fit(docs.unionAll(docs), labels.unionAll(labels))
    assert np.array_equal(one.weights, twice.weights)


def test_odd_rows_are_scored(odd_rows, no_rows, labelled, spark):
    docs, labels = labelled
    fitted = quality_model.fit(docs, labels)
    rows = quality_model.score(odd_rows, fitted).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.score(no_rows, fitted).count() == 0
    nothing = quality_model.fit(docs, labels.filter("false"))
    assert {r.score for r in quality_model.score(odd_rows, nothing).collect()} == {0.5}
    one_class = quality_model.fit(docs, labels.filter("quality = 1"))
    assert all(r.score > 0.9 for r in quality_model.score(docs, one_class).collect())
