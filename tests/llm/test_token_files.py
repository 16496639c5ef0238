import io
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rosterloom.llm import token_files
from rosterloom.llm.token_files import Reader, Writer, pack_block, unpack_block

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_round_trip():
    for n, most in ((1, 1), (7, 2), (1000, 50_257), (4096, 2**32 - 1), (65_536, 1)):
        ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint32, endpoint=True)
        assert np.array_equal(unpack_block(pack_block(ids), n), ids)


def test_files_round_trip_and_blocks_read_alone():
    rng, out = np.random.default_rng(1), io.BytesIO()
    writer = Writer(out, block=100)
    docs = [(None if k == 3 else k, rng.integers(0, 60_000, rng.integers(0, 350), dtype=np.uint32)) for k in range(40)]
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    reader = Reader(out)
    flat = np.concatenate([ids for _, ids in docs])
    assert reader.tokens == len(flat) and np.array_equal(reader.block(5), flat[500:600])
    read = list(reader.documents())
    assert [r[0] for r in read] == [d[0] for d in docs]
    assert all(np.array_equal(r[2], d[1]) for r, d in zip(read, docs))
    assert [r[1] for r in read] == np.cumsum([0, *(len(i) for _, i in docs)])[:-1].tolist()


def test_odd_rows(odd_rows, no_rows):
    library = Tokenizer.from_file(FILE)
    folder = token_files.token_folder(odd_rows)
    rows = token_files.read_token_files(token_files.write_token_files(odd_rows, FILE, folder, block=1000), folder).collect()
    want = []
    for r in odd_rows.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in rows)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and ordered[0].doc_id is None
    folder = token_files.token_folder(no_rows)
    assert token_files.read_token_files(token_files.write_token_files(no_rows, FILE, folder), folder).count() == 0
