import collections
import os
import random
import re

import numpy as np
import pytest

from rosterloom.llm import count_tree, shared

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, percent=80):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def found(frame, percent=80):
    return sorted(map(tuple, count_tree.linked(frame, percent).collect()), key=str)


@pytest.fixture(scope="module")
def rows(prose):
    """Groups of near copies with few to many changes, texts that share a passage, and short and odd ones."""
    rng, out = random.Random(6), []
    boiler = prose(1, 90)
    for g in range(14):
        base = prose(10 + g, 30 + 15 * g).split()
        for k in range(11):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = prose(rng.randrange(10**6), 1)
            out.append((100 * g + k, " ".join(copy)))
    for g in range(40):
        own = prose(500 + g, 5 + g % 30).split()
        for k in range(2):
            own[rng.randrange(len(own))] = prose(rng.randrange(10**6), 1)
            out.append((3000 + 10 * g + k, f"{boiler} {' '.join(own)}"))
    out += [(5000 + i, t) for i, t in enumerate(["a b c", "A  b\nC", "a b", "", None, " \t", "a, b c", "x y z w v", "x y z w v u"])]
    return out + [(7, out[0][1]), (7, out[0][1]), (None, boiler), (None, None)]


@pytest.mark.parametrize("page", [512, 8])
def test_components_are_those_of_all_pairs(spark, rows, page, monkeypatch):
    monkeypatch.setattr(count_tree, "PAGE", page)
    wanted = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == wanted
    assert 20 < len({r[2] for r in wanted}) < len(rows) - 60


def test_other_thresholds(spark, rows):
    for percent in (60, 100):
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent) == brute(rows, percent)


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(2)
    size = rng.integers(5, 400, 700)
    counts = np.stack([np.bincount(rng.integers(0, count_tree.GROUPS, n), minlength=count_tree.GROUPS) for n in size]).astype(np.int32)
    counts[350:] = np.maximum(counts[:350] - (rng.random((350, count_tree.GROUPS)) < 0.05), 0)
    size = counts.sum(axis=1)
    points = count_tree.Points([c.astype(np.uint8).tobytes() for c in counts], size)
    tree = count_tree.Tree(points)
    assert len(tree.levels) == 3 and sorted(tree.order) == list(range(700))
    query, point = tree.near(points, 80)
    common = np.minimum(counts[:, None], counts[None]).sum(axis=2)
    want = (180 * common >= 80 * (size[:, None] + size[None])) & (100 * np.minimum.outer(size, size) >= 80 * np.maximum.outer(size, size))
    assert set(zip(query.tolist(), point.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)))) and len(query) < 20_000


def test_pages_of_a_large_bucket(spark, monkeypatch):
    """Every pair of one bucket that can be similar meets once, over pages and ranges of sizes."""
    monkeypatch.setattr(count_tree, "PAGE", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 5, count_tree.GROUPS)
    points = [(1, i, i, (np.maximum(base + rng.integers(-1, 2, count_tree.GROUPS) * (rng.random(count_tree.GROUPS) < rng.random() / 2), 0) * rng.choice([1, 1, 2])).astype(np.uint8)) for i in range(200)]
    frame = spark.createDataFrame([(b, n, l, int(c.sum()), bytearray(c.tobytes())) for b, n, l, c in points], "bucket long, node long, label long, size long, counts binary").repartition(4)
    got = [tuple(sorted(r)) for r in count_tree.candidates(frame).collect()]
    c = np.stack([p[3] for p in points]).astype(int)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if 180 * np.minimum(c[i], c[j]).sum() >= 80 * (c[i].sum() + c[j].sum())}
    assert len(want) > 100 and want <= set(got)


def test_large_sets_have_finer_groups():
    """Bounds by finer groups lose no similar pair, and tell unrelated large sets apart."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (900, 1500, 3000, 3200, 5000, 9000, 40)]
    sets += [np.union1d(s[len(s) // 12 :], rng.integers(0, 2**63, len(s) // 13).astype(np.uint64)) for s in sets]
    size = np.array([len(s) for s in sets])
    points = count_tree.Points(count_tree._counts(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), size), size)
    assert set(points.groups) == {128, 256, 512, 1024, 2048} and (points.counts.sum(axis=1) == size).all()
    query, point = count_tree.Tree(points).near(points, 80)
    got = set(zip(query.tolist(), point.tolist()))
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if 180 * len(np.intersect1d(s, t)) >= 80 * (len(s) + len(t))}
    assert want == got and len(want) == 28


def test_counts_at_the_end_of_their_type_bound_nothing():
    most = np.full((1, count_tree.GROUPS), 255, np.int32)
    assert count_tree.able(most, most, np.array([10**9]), np.array([10**9]), 80).all()


def test_odd_rows(odd_rows, no_rows):
    got = found(odd_rows)
    assert got == brute([(r.doc_id, r.text) for r in odd_rows.collect()]) and len(got) == 16
    assert found(no_rows) == []


def test_similar_texts_of_several_classes_meet_about_once(spark, prose, monkeypatch):
    """Texts that share many shingles, and so many buckets, without a link are not paired anew in each of these buckets."""
    rng, rows, met = random.Random(8), [], []
    for g in range(3):
        base = prose(900 + g, 150).split()
        for k in range(24):
            copy = list(base)
            for at in rng.sample(range(0, 150, 10), 3):
                copy[at] = prose(rng.randrange(10**6), 1)
            rows.append((100 * g + k, " ".join(copy)))
    searched = count_tree.candidates

    def seen(*args, **named):
        out = searched(*args, **named).cache()
        if out.columns == ["x", "y"]:
            met.extend(tuple(sorted(r)) for r in out.collect())
        return out

    monkeypatch.setattr(count_tree, "candidates", seen)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    assert len(set(met)) > 20 and len(met) <= 4 * len(set(met))


def test_merged_buckets_keep_every_pair(spark):
    rng, entries = random.Random(9), set()
    for g in range(6):
        for b in range(30):
            entries |= {(100 * g + b, 50 * g + k) for k in range(12) if rng.random() < 0.8}
    entries |= {(1000 + b, rng.randrange(300)) for b in range(60) for _ in range(3)} | {(2000, n) for n in range(0, 300, 3)}
    pairs = lambda rows: {(x, y) for b, x in rows for c, y in rows if b == c and x < y}
    got = [tuple(r) for r in count_tree.merged(spark.createDataFrame(sorted(entries), "bucket long, node long")).collect()]
    assert len(got) == len(set(got)) and pairs(entries) <= pairs(got)
    squares = lambda rows: sum(n * n for n in collections.Counter(b for b, _ in rows).values())
    assert len(got) < len(entries) / 3 and squares(got) < squares(entries) / 2


def written(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


def test_no_copy_of_the_texts_is_written(spark, tmp_path, monkeypatch):
    """What is put away for texts without a link is much smaller than they are."""
    rng = random.Random(10)
    rows = [(i, " ".join(rng.randbytes(4).hex() for _ in range(400))) for i in range(300)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(path)
    kept = tmp_path / "kept"
    kept.mkdir()
    monkeypatch.setattr(shared, "shared_dir", lambda session: str(kept))
    assert found(spark.read.parquet(path)) == sorted(((i, 396, i) for i in range(300)), key=str)
    assert 0 < written(kept) < 0.6 * written(path)


def test_the_same_components_if_nothing_is_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(count_tree, "few", lambda df: df)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_rows_among_ids(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 700, f"r{i}") for i in range(1400)], "id long, name string")
    ids = spark.createDataFrame([(i,) for i in range(0, 900, 7)], "id long")
    want = sorted((i % 700, f"r{i}") for i in range(1400) if i % 700 % 7 == 0)
    for most in (10, 1000):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, shared.among(rows, ids, "id").collect())) == want
        other = shared.among(rows, ids, "id", False)
        assert other.columns == rows.columns and sorted(map(tuple, other.collect())) == sorted(set(map(tuple, rows.collect())) - set(want))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 100)
    assert shared.perhaps(rows, ids, "id").filter("perhaps").count() < 2 * len(want)
