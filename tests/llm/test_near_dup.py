import random
import re

import numpy as np

from rosterloom.llm import near_dup

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, similar=0.8):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= similar * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(map(str, v)) for v in out.values())


def grouped(found):
    out = {}
    for r in found:
        out.setdefault(str(r.class_id), []).append(str(r.doc_id))
    return sorted(sorted(v) for v in out.values())


def test_registers_estimate_the_probability_jaccard():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**40, 400).astype(np.uint64)
    ones = np.ones(300, np.int64)
    a, b = codes[:300], codes[100:]
    got = near_dup.signatures(np.repeat([0, 1], 300), np.concatenate([a, b]), np.concatenate([ones, ones]), 2)
    assert abs((got[0] == got[1]).mean() - 0.5) < 0.15
    assert (near_dup.signatures(np.zeros(1, np.int64), codes[:1], ones[:1], 1) == codes[0]).all()
    heavy = np.where(np.arange(300) == 7, 10**12, 1)
    share = (near_dup.signatures(np.zeros(300, np.int64), a, heavy, 1)[0] == a[7]).mean()
    assert share < 0.2


def test_classes_are_those_of_all_pairs(spark, prose):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = prose(g, 120).split()
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(120)] = prose(rng.randrange(10**6), 1)
            rows.append((100 * g + k, " ".join(copy)))
    rows += [(5000 + i, prose(7000 + i, 80)) for i in range(60)] + [(6000 + i, t) for i, t in enumerate(["a b c", "A, b; c", "a b", "", None, "...", "..."])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = near_dup.near_duplicates(frame).collect()
    assert grouped(found) == brute(rows)
    assert sum(r.kept for r in found) == len(brute(rows)) and all(r.doc_id == r.class_id for r in found if r.kept)
    assert near_dup.without_near_duplicates(frame).count() == len(brute(rows))


def test_texts_that_share_boilerplate(spark, prose):
    """Half or most of each text is common to all; a few pairs are similar, and links cross the classes of a bucket."""
    rng, boiler, rows = random.Random(8), prose(1, 150), []
    for g in range(50):
        own = prose(100 + g, 20 + 4 * (g % 9)).split()
        for k in range(3):
            copy = list(own)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = prose(rng.randrange(10**6), 1)
            rows.append((10 * g + k, f"{boiler} {' '.join(copy)}"))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert grouped(found) == brute(rows) and 1 < len(brute(rows)) < 150


def test_similar_sets_share_a_rare_shingle(spark):
    rng = random.Random(2)
    rows = [(i, sorted(rng.sample(range(40), rng.randint(1, 30)))) for i in range(60)]
    rows += [(100 + i, sorted({*rng.sample(s, max(1, len(s) - rng.randint(0, 3))), *rng.sample(range(40), rng.randint(0, 2))})) for i, s in rows]
    rare = {}
    for r in near_dup.rarest(spark.createDataFrame(rows, "node long, shingles array<long>"), 0.8).collect():
        rare.setdefault(r.node, set()).add(r.shingle)
    similar = [(a, b) for a, s in rows for b, t in rows if a < b and len(set(s) & set(t)) >= 0.8 * len(set(s) | set(t))]
    assert len(similar) > 40 and all(rare.get(a, set()) & rare.get(b, set()) for a, b in similar)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(200, 201), (201, 200), (300, 300)], "a long, b long")
    labels = {r.node: r.label for r in near_dup.components(edges).collect()}
    assert {labels[i] for i in range(61)} == {0} and labels[201] == 200 and labels[300] == 300


def test_odd_rows(odd_rows, no_rows):
    rows = near_dup.near_duplicates(odd_rows).collect()
    assert len(rows) == 16
    assert sum(r.kept for r in rows if r.doc_id == 1) == 1 and len({r.class_id for r in rows if r.doc_id in (2, 12)}) == 1
    kept = near_dup.without_near_duplicates(odd_rows)
    assert kept.columns == odd_rows.columns and {r._row for r in kept.collect()} == {5} and kept.count() == sum(r.kept for r in rows)
    assert near_dup.near_duplicates(no_rows).count() == 0
