import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rosterloom.llm import langid
from rosterloom.llm.shared import held_out

SYLLABLES = {"aa": "ba be bi do du fa", "bb": "xu xo qui zee vrr tch", "cc": "ñe lló ção rra üb"}


def corpus(spark, prose, n=120):
    rows = [(i, prose(i, 30, SYLLABLES[lang]), lang) for i, lang in ((i, list(SYLLABLES)[i % 3]) for i in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_rows_are_told_apart(spark, prose):
    docs = corpus(spark, prose)
    rows = langid.learn_and_identify(docs).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(rows) == 120
    assert all(r.lang == r.lang_pred and 0.5 < r.lang_score <= 1 for r in rows)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark, prose):
    docs = corpus(spark, prose, 60)
    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    said = lambda d: sorted((r.doc_id, r.lang_pred, r.lang_score) for r in langid.learn_and_identify(d).collect())
    assert said(docs) == said(wrong)


def test_unseen_words_back_off():
    rows = [(0, "dog", "en", 5), (0, "chien", "fr", 5), (3, "dog", "en", 5), (3, "ien", "fr", 5), (1, "d", "en", 5), (1, "c", "fr", 5)]
    model = langid.Model(["en", "fr"], rows, {(lang, n): 5 for lang in ("en", "fr") for n in (0, 1, 3)})
    assert model.word("dog").argmax() == 0 and model.word("lien").argmax() == 1 and model.word("doggy").argmax() == 0
    assert not model.word("ß").any()


def brute(rows, share):
    """lang_pred and score of every row, counted and scored one gram at a time."""
    words_of = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    grams_of = lambda word, n: [f"<{word}>"[i : i + n] for i in range(len(word) + 3 - n)]
    counts = [collections.defaultdict(collections.Counter) for _ in range(5)]
    for doc, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc).encode()) % 5:
            for word in words_of(text):
                counts[0][word][lang] += 1
                for n in range(1, 5):
                    for gram in grams_of(word, n):
                        counts[n][gram][lang] += 1
    langs = sorted({lang for by in counts for c in by.values() for lang in c})
    totals = [{lang: sum(c[lang] for c in by.values()) for lang in langs} for by in counts]
    logs = []
    for n, by in enumerate(counts):
        kept = {g: c for g, c in by.items() if any(c[lang] >= max(1, math.ceil(share * totals[n][lang])) for lang in langs if c[lang])}
        rows_of = {g: [math.log((c[lang] + 0.5) / (totals[n][lang] + 0.5 * len(kept) + 1)) for lang in langs] for g, c in kept.items()}
        logs.append({g: [x - sum(r) / len(r) for x in r] for g, r in rows_of.items()})
    out = {}
    for doc, text, _ in rows:
        total, words = [0.0] * len(langs), words_of(text)
        for word in words:
            found = [logs[0][word]] if word in logs[0] else []
            for i in range(len(word) + 2 if not found else 0):
                n = next((n for n in range(4, 0, -1) if i + n <= len(word) + 2 and f"<{word}>"[i : i + n] in logs[n]), None)
                found += [logs[n][f"<{word}>"[i : i + n]]] if n else []
            for k in range(len(langs)):
                total[k] += sum(r[k] for r in found) / max(1, len(found))
        best = max(range(len(langs)), key=lambda k: total[k])
        out[doc] = (langs[best], 1 / sum(math.exp(t - total[best]) for t in total)) if words else ("und", 0.0)
    return out


@pytest.mark.parametrize(("share", "letters"), [(0.002, 55_000), (0.02, 55_000), (0.002, 9)])
def test_scores_are_those_of_brute_force(spark, prose, monkeypatch, share, letters):
    """Also for an alphabet whose letters don't fit one number."""
    monkeypatch.setattr(langid, "MOST_LETTERS", letters)
    mixed = "ba be xu xo ñe lló qui do"
    rows = [(i, prose(i, 3 + i % 20, f"{SYLLABLES[lang]} {mixed}"), lang) for i, lang in ((i, list(SYLLABLES)[i % 3]) for i in range(90))]
    rows += [(200, "xuxoxu" * 40, "bb"), (201, None, "aa"), (202, "", "aa"), (203, "12 !!", "cc"), (204, "bafa", None), (205, "zz", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn(docs.filter(~held_out(F.col("doc_id"))), share)
    wanted = brute(rows, share)
    for r in langid.identify(docs, model).collect():
        assert r.lang_pred == wanted[r.doc_id][0] and abs(r.lang_score - wanted[r.doc_id][1]) < 1e-4, r


def test_counts_of_ngrams(monkeypatch):
    """All at once, and word by word where an alphabet is too large."""
    import pyarrow as pa

    words = [("aa", "bab", 3), ("aa", "abcdé", 1), ("bb", "漢字漢", 2), ("aa", "", 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*words)], names=["lang", "gram", "count"])
    wanted = collections.Counter()
    for lang, word, count in words:
        marked = f"<{word}>"
        for n in range(1, 5):
            for i in range(len(marked) - n + 1):
                wanted[lang, n, marked[i : i + n]] += count
    for most in (55_000, 3):
        monkeypatch.setattr(langid, "MOST_LETTERS", most)
        found = collections.Counter()
        for rows in langid._count_grams([batch]):
            for lang, n, gram, count in zip(*(c.to_pylist() for c in rows.columns)):
                found[lang, n, gram] += count
        assert found == wanted


def test_long_words_teach_their_ngrams(spark):
    """Text without blanks comes as one long word, whose n-grams count as any other's."""
    rows = [(1, "xo" * 5000, "aa"), (2, "ba " * 20, "bb")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb"] and model.word("xo" * 30).argmax() == 0


def test_clashing_columns_are_kept(spark, prose):
    docs = corpus(spark, prose, 30).selectExpr("*", "7 AS _said", "8 AS said", "9 AS held")
    rows = langid.learn_and_identify(docs).collect()
    assert {(r["_said"], r.said, r.held) for r in rows} == {(7, 8, 9)} and all(r.lang_pred == r.lang for r in rows)


def test_odd_rows(odd_rows, no_rows):
    rows = langid.learn_and_identify(odd_rows).collect()
    assert len(rows) == 16
    assert all((r.lang_pred, r.lang_score) == ("und", 0.0) for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred in ("en", "fr") for r in rows if any(c.isalpha() for c in r.text or ""))
    assert {r._row for r in rows} == {5}
    assert langid.learn_and_identify(no_rows).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_rows, langid.learn(no_rows)).collect()} == {"und"}
