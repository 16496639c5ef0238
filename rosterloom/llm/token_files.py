"""Token-id files of bit planes.

Ids are cut into blocks of fixed size. Each block is transposed into bit planes (bit 0 of
all its ids, bit 1, ...), each plane is compressed with zstandard, and an index at the
end of the file names every block's planes, so that one block can be read alone:

    magic | planes of block 0, 1, ... | zstd(document table) | zstd(block index) | footer

The document table has the doc_id, a null flag and the token count of each document.
Tasks write files under names of their own; only those in the manifest count, so that a
repeated task leaves nothing behind that is read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.llm.pretokens import Encoder, byte_letters, held
from rosterloom.llm.shared import cut, open_folder, shared_dir, with_row_id

MAGIC = b"BPLANES1"
#: Ids of a block.
BLOCK = 1 << 16
_FOOTER = struct.Struct("<QQQQQ")


def pack_block(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """The compressed bit planes of a block, lowest bit first."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    bits = int(ids.max()).bit_length() if len(ids) else 0
    size = -(-bits // 8)
    loose = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size], axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(loose.T[:bits]), axis=1)
    return [squeeze(plane.tobytes()) for plane in planes]


def unpack_block(planes: list[bytes], n: int) -> np.ndarray:
    loose, out = zstandard.ZstdDecompressor().decompress, np.zeros(n, np.uint16 if len(planes) <= 16 else np.uint32)
    for b, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(loose(plane), np.uint8), count=n).astype(out.dtype) << out.dtype.type(b)
    return out.astype("<u4")


class Writer:
    """Writes one file of id blocks, document by document."""

    def __init__(self, stream, block: int = BLOCK):
        self._stream, self._block = stream, block
        self._waiting: list[bytes] = []
        self._held = self.tokens = 0
        self._at = stream.write(MAGIC) and len(MAGIC)
        self._blocks: list[int] = []  # ids, planes, then the size of each plane
        self._docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._waiting.append(ids)
        self._held += len(ids) // 4
        self.tokens += len(ids) // 4
        self._docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        if self._held >= self._block:
            self._flush(self._held // self._block * self._block)

    def _flush(self, n: int) -> None:
        data = b"".join(self._waiting)
        ids = np.frombuffer(data, "<u4", n)
        self._waiting, self._held = [data[4 * n :]], self._held - n
        for i in range(0, n, self._block):
            planes = pack_block(ids[i : i + self._block])
            self._blocks += [min(self._block, n - i), len(planes), *map(len, planes)]
            for plane in planes:
                self._put(plane)

    def _put(self, data: bytes) -> None:
        self._stream.write(data)
        self._at += len(data)

    def close(self) -> None:
        if self._held:
            self._flush(self._held)
        table = np.array(self._docs, "<i8").reshape(-1, 3)
        start = self._at
        squeeze = zstandard.ZstdCompressor().compress
        self._put(docs := squeeze(table.tobytes()))
        self._put(index := squeeze(np.array(self._blocks, "<i8").tobytes()))
        self._put(_FOOTER.pack(start, len(docs), len(index), len(table), self.tokens))


class Reader:
    """Reads a file's document table and its blocks, each on its own."""

    def __init__(self, stream):
        self._stream = stream
        size = stream.seek(0, 2) or stream.tell()
        if self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of bit planes")
        start, docs, index, _, self.tokens = _FOOTER.unpack(self._bytes(size - _FOOTER.size, _FOOTER.size))
        loose = zstandard.ZstdDecompressor().decompress
        self.docs = np.frombuffer(loose(self._bytes(start, docs)), "<i8").reshape(-1, 3)
        flat = np.frombuffer(loose(self._bytes(start + docs, index)), "<i8").tolist()
        self.blocks, at, i = [], len(MAGIC), 0
        while i < len(flat):
            sizes = flat[i + 2 : i + 2 + flat[i + 1]]
            self.blocks.append((flat[i], at, sizes))
            at, i = at + sum(sizes), i + 2 + flat[i + 1]

    def _bytes(self, at: int, n: int) -> bytes:
        self._stream.seek(at)
        return self._stream.read(n)

    def block(self, i: int) -> np.ndarray:
        n, at, sizes = self.blocks[i]
        data, planes = self._bytes(at, sum(sizes)), []
        for size in sizes:
            planes.append(data[:size])
            data = data[size:]
        return unpack_block(planes, n)

    def documents(self):
        """(doc_id or None, place of its first id in the file, ids) of each document, with a block or one document in memory."""
        ids, next_block, start = np.zeros(0, np.uint32), 0, 0
        for doc_id, missing, n in self.docs.tolist():
            parts, have = [ids], len(ids)
            while have < n:
                parts.append(self.block(next_block))
                have, next_block = have + len(parts[-1]), next_block + 1
            ids = np.concatenate(parts) if len(parts) > 1 else ids
            yield (None if missing else doc_id), start, ids[:n]
            ids, start = ids[n:], start + n


def _encoder(text: str) -> Encoder:
    """Whole texts to ids: the tokenizers library's model encodes each distinct pre-token once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_str(text).model.tokenize
    letters = np.zeros(256, "<u4")
    for letter, byte in byte_letters().items():
        letters[byte] = ord(letter)

    def learn(words: list[bytes]) -> list[bytes]:
        spelled = letters[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-32-le")
        ends = list(accumulate(map(len, words)))
        return [array("I", [t.id for t in tokenize(spelled[a:b])]).tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    return Encoder({t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}, learn)


def _write(folder: str, file, key: str, end_id: int, block: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        system, base = open_folder(folder)
        part, writer, stream, name = TaskContext.get().partitionId(), None, None, f"{uuid.uuid4().hex}.bpl"
        encode = held(key, lambda: _encoder(file.value)).texts
        for batch in batches:
            if writer is None and batch.num_rows:
                stream = system.open_output_stream(f"{base}/{name}")
                writer = Writer(stream, block)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "tokens": pa.array([writer.tokens], pa.int64())})

    return run


def write_token_files(documents: DataFrame, tokenizer_file: str, folder: str, end_id: int = 2, block: int = BLOCK) -> DataFrame:
    """Write the ids of all texts to bit-plane files in ascending doc_id order (null first); return the manifest.

    The manifest has part, file, tokens and start (ids in all earlier files). A null text is
    empty and has the end id only; very long texts are encoded piece by piece; repeated rows are
    written each, equal doc_ids in the order of the rows read; an empty table gives no file;
    other columns are ignored, whatever their names.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        text = file.read()
    spark = documents.sparkSession
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    key = uuid.uuid4().hex
    # By row too, so that many rows of one doc_id, or without one, are dealt to several files.
    ordered = with_row_id(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    files = cut(ordered.select("doc_id", "text").mapInArrow(_write(folder, spark.sparkContext.broadcast(text), key, end_id, block), "part long, file string, tokens long"))
    # Running totals in two steps: within runs of 4096 files, then over the runs.
    runs = files.withColumn("run", F.floor(F.col("part") / 4096))
    totals = runs.groupBy("run").agg(F.sum("tokens").alias("run_tokens"))
    totals = totals.withColumn("run_start", F.sum("run_tokens").over(Window.orderBy("run")) - F.col("run_tokens")).drop("run_tokens")
    start = F.sum("tokens").over(Window.partitionBy("run").orderBy("part")) - F.col("tokens")
    return runs.withColumn("start", start).join(totals, "run").select("part", "file", "tokens", (F.col("start") + F.col("run_start")).alias("start"))


def _read(folder: str):
    def run(batches):
        system, base = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{base}/{name}") as stream:
                    rows = []
                    for doc_id, at, ids in Reader(stream).documents():
                        rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _table(rows)
                            rows = []
                    if rows:
                        yield _table(rows)

    return run


def _table(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files, a task for each file."""
    files = manifest.select("file", "start")
    return files.repartition(max(1, files.count())).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(documents: DataFrame) -> str:
    return f"{shared_dir(documents.sparkSession)}/token-files-{uuid.uuid4().hex}"
