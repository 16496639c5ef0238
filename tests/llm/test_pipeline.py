import re
from array import array

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    passage = prose(999, 40)
    rows = [(i, prose(i, 90), "aa", "s", 0) for i in range(30)] + [(100 + i, prose(500 + i, 90, "xu xo qui zee vrr tch"), "bb", "s", 0) for i in range(30)]
    rows += [(200, prose(3, 90) + " end", "aa", "s", 0), (201, prose(3, 90), "aa", "s", 0), (202, prose(77, 60) + " " + passage, None, "s", 0), (203, "12 34", "aa", "s", 0), (204, None, "aa", "s", 0)]
    rows += [(205, prose(205, 50) + " call me.you@mail.example.com soon", "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_decide(spark, folder):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    copies = {3, 200, 201} & set(rows)
    assert len(copies) == 1
    assert set(rows) == set(range(30)) - {3} | set(range(100, 130)) | copies | {205}
    assert rows[205].text.endswith("call [email] soon")
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows.values())


def test_stages_are_those_of_brute_force(spark, folder):
    """What is kept, its masked text and its ids, from all pairs, all windows, the contract's patterns and the library."""
    from test_bpe import LIBRARY
    from test_decontam import brute as hits
    from test_near_dup import brute as classes
    from test_personal_data import brute as spans

    kinds = ["email", "ip", "card", "phone"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    groups = [set(map(int, g)) for g in classes(kept)]
    assert all(len(g & set(rows)) <= 1 for g in groups)
    hit = {doc for doc, _, n, _ in hits(kept, items) if n}
    assert {min(g) for g in groups if not g & hit} == {min(g) for g in groups if g & set(rows)}
    for i, row in rows.items():
        text, at, out = dict(docs)[i], 0, []
        for start, kind, end in spans(text):
            if start >= at:
                out += [text[at:start], f"[{kinds[kind]}]"]
            at = max(at, end)
        masked = "".join([*out, text[at:]])
        assert row.text == masked and row.n_chars == len(masked)
        assert array("I", row.ids).tolist() == LIBRARY.encode(masked, add_special_tokens=False).ids


def test_stages_keep_the_columns(spark, folder):
    names = ["_row", "_said", "said", "lang_pred", "lang_score", "ids", "decoded", "n_tokens", "hash", "node", "bucket", "label", "spans", "base", "_text", "_places", "tokens", "start", "word", "digest", "doc id", "a.b"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns + (["n_tokens_", "ids_"] if name == "bpe_codec" else []), name
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}, name
    plain = docs.drop(*names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, folder).columns == plain.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, plain, folder).columns == [*plain.columns, "n_tokens", "ids"]
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
