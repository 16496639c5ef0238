import hashlib
from array import array

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterloom.llm import bpe, pretokens
from rosterloom.llm.pretokens import Vocabulary

FILE = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = Vocabulary(open(FILE, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    path = tmp_path_factory.mktemp("lexicon") / "lexicon.bin"
    words = [w.encode() for w in ("the", " the", " there", "here", " hereof", " of", "\n", "é", " é")]
    path.write_bytes(bpe.compile_lexicon({w: bpe.merge(w, VOCABULARY) for w in words}))
    return bpe.encoder(VOCABULARY, bpe.Lexicon(str(path)))


def encoded(encoder, texts):
    return [array("I", x).tolist() for x in encoder.texts(pa.array(texts, pa.string()))]


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60) | st.text(alphabet="the rofñ'sdlm\n\t ½²٣漢字😀\x1c\x85 <|endoftext|>", max_size=60))
def test_ids_are_the_librarys(encoder, text):
    assert encoded(encoder, [text]) == [LIBRARY.encode(text, add_special_tokens=False).ids]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.none() | st.text(alphabet="'restlmdv \n\u3000\xa01½é漢😀-<|endoftext|>", max_size=30), max_size=12))
def test_many_texts_are_encoded_each(encoder, texts):
    assert encoded(encoder, texts) == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_where_pretokens_begin(encoder, prose, monkeypatch):
    monkeypatch.setattr(pretokens, "BLOCK_BYTES", 300)
    texts = ["", prose(1, 2000), None, "x" * 5000 + " y", prose(2, 30), ("don't  stop\n 1 <|endoftext|>é'll " * 200), "漢字 " * 700]
    column = pa.array(texts, pa.string())
    assert len(list(pretokens.blocks(column))) > 30
    assert encoded(encoder, texts) == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded_by_bytes(encoder, prose, monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO_BYTES", 20_000)
    for k in range(30):
        text = prose(k, 60)
        assert encoded(encoder, [text]) == [LIBRARY.encode(text, add_special_tokens=False).ids]
        assert encoder._held < 20_000 + 60 * 400


def test_a_worker_holds_one_object(monkeypatch):
    made = []
    for key in ("a", "a", "b", "a"):
        pretokens.held(key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "a"] and pretokens._held == ("a", "a")


def test_long_words_are_merged_exactly(encoder):
    import random

    for text in ("x" * 50_000, "".join(random.Random(1).choice("abcdefé") for _ in range(30_000)), " " * 5000 + "a"):
        assert encoded(encoder, [text]) == [LIBRARY.encode(text, add_special_tokens=False).ids]


def test_merge_many_is_merge(prose):
    words = [w.encode()[: bpe.WORD_BYTES] for w in prose(3, 500).split()] + [b"a", b"\xff\xfe"]
    assert bpe.merge_many(words, bpe.PairRanks(VOCABULARY)) == [array("I", bpe.merge(w, VOCABULARY)).tobytes() for w in words]


@given(st.dictionaries(st.binary(min_size=1, max_size=8), st.lists(st.integers(0, 50_000), max_size=4), max_size=40), st.lists(st.binary(max_size=8)))
@settings(deadline=None, max_examples=60)
def test_lexicon_is_the_dictionary(tmp_path_factory, words, others):
    path = tmp_path_factory.mktemp("l") / "l.bin"
    path.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    asked = [*words, *others]
    assert lexicon.get(asked) == [array("I", words[w]).tobytes() if w in words else None for w in asked]


def test_columns_of_a_codec_round_trip(spark):
    texts = [(1, "Hello  there\n é漢字"), (2, None), (3, "")]
    frame = spark.createDataFrame(texts, "i int, text string")
    codec = bpe.Codec(frame, FILE)
    rows = {r.i: r for r in frame.withColumn("ids", codec.encode(F.col("text"))).withColumn("back", codec.decode(F.col("ids"))).collect()}
    assert all(rows[i].back == (t or "") and array("I", rows[i].ids).tolist() == LIBRARY.encode(t or "", add_special_tokens=False).ids for i, t in texts)


def test_suffixes_are_shared():
    few = bpe.compile_lexicon({w: [] for w in (b"walking", b"talking")})
    more = bpe.compile_lexicon({w: [] for w in (b"walking", b"zalkxyz")})
    assert len(few) < len(more)


def test_odd_rows(odd_rows, no_rows):
    rows = bpe.encode_decode(odd_rows, FILE).withColumn("sha", F.sha2("ids", 256)).collect()
    assert len(rows) == 16
    for r in rows:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == array("I", ids).tobytes() and r.decoded == (r.text or "")
        assert r.sha == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
    assert bpe.encode_decode(no_rows, FILE).count() == 0
