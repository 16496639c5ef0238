import re

from rosterloom.llm import license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    found = [(i, label) for label, p in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_base_and_labels(spark, prose):
    mit = next(t for _, t in license_scan.NOTICES if t.startswith("permission is hereby"))
    edited = mit.split()
    edited[9:9] = ["and", "gladly"]
    texts = [
        "under the MIT License", "Under\nthe-mit license, under the mit license.", "apache license, version 2.0 and CC BY-NC 4.0", "apache version 2 license", "cc by sa 4.0", prose(1, 50) + " " + " ".join(edited) + " " + prose(2, 50),
        "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu general public license version", "cc by nc " * 500, "", None, "under the mit",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(license_scan.scan_licenses(frame).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:6] for r in rows] == [base(t) for t in texts]
    labels = [r.labels for r in rows]
    assert labels[:8] == ["mit", "mit", "apache-2,cc-by-nc", "", "", "mit", "gpl-3", ""]
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in rows)
    assert rows[5].base_labels == "" and rows[8].n_base == 500


def brute_labels(text):
    """Labels of templates that stand in the text word by word, at most NEIGHBOUR words put in or left out between matches."""
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    doc, out = words(text), set()
    for label, template, kind in license_scan.TEMPLATES:
        want = words(template)
        if kind == "phrase" or len(want) - 2 < license_scan.SHORT:
            if any(doc[i : i + len(want)] == want for i in range(len(doc) - len(want) + 1)):
                out.add(label)
            continue
        by_diagonal = {}
        for i in range(len(doc) - 2):
            for j in range(len(want) - 2):
                if doc[i : i + 3] == want[j : j + 3]:
                    by_diagonal.setdefault(i - j, set()).add((i, j))
        for start in by_diagonal:
            merged, at = set(), start
            while True:
                merged |= by_diagonal[at]
                near = [d for d in by_diagonal if at < d <= at + license_scan.NEIGHBOUR]
                if not near:
                    break
                at = min(near)
            places = {j for _, j in merged}
            held = {k for j in places for k in range(j, j + 3)}
            spread = max(i for i, _ in merged) - min(i for i, _ in merged)
            if len(places) >= license_scan.COVER * (len(want) - 2) and len(held) >= license_scan.COVER * len(want) and spread < 2 * (len(want) - 2) + license_scan.NEIGHBOUR:
                out.add(label)
    return ",".join(sorted(out))


def test_labels_are_those_of_brute_force(spark, prose):
    import random

    rng, texts = random.Random(4), []
    for k, (_, template, _) in enumerate(license_scan.TEMPLATES):
        for keep in (1.0, 0.97, 0.7):
            words = [w for w in template.split() if rng.random() < keep]
            for _ in range(0 if keep == 1.0 else 1 + len(words) // 60):
                words.insert(rng.randrange(len(words) + 1), "extra")
            texts.append(f"{prose(k, 30)} {' '.join(words)} {prose(k + 500, 30)}")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.labels for r in license_scan.scan_licenses(frame).collect()}
    assert found == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert {"bsd-3", "zlib", "agpl-3", "0bsd"} <= {x for labels in found.values() for x in labels.split(",")}


def test_odd_rows(odd_rows, no_rows):
    rows = license_scan.scan_licenses(odd_rows).collect()
    assert len(rows) == 16 and {r.n_base for r in rows} == {0}
    assert license_scan.scan_licenses(no_rows).count() == 0
