"""Token-id files: blocks of range-coded ids in document order.

``write`` sorts the documents by id (one shuffle of the texts, by ranges of id),
encodes each text in the task that holds its place, ends it with ``end_id`` and
cuts the ids into blocks of ``range_coder.BLOCK_IDS``.  A block is one row
of a Parquet folder -- part and block number, its first and last document, how
many documents and ids it has, and its bytes -- so Spark's own committer and
filesystem layer do the writing: a task that fails or runs twice leaves each
block once, and the files can be in any store that Spark reaches.

Block bytes (little-endian): ``MAGIC``, documents u32, directory length u32,
the directory (zstd: ids of the documents i64, how many ids of each are in this
block u32, flags u8: 1 null id, 2 begun in the block before, 4 goes on in the
next), the coded ids (``range_coder``, with its own checksums) and the CRC-32 of
everything before it.  A block needs no other block; a wrong checksum is an error.

``read`` streams the blocks of each part in order and returns the documents
with their ids and with the number of ids before them in all files.

Defined results: null and empty texts are documents of the end id alone; null
document ids come first; documents that share an id are ordered by a hash of
their text (equal rows are interchangeable); an empty table gives an empty folder
and no rows; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from resalelens.llm.range_coder import BLOCK_IDS, decode_block, encode_block
from resalelens.llm.token_ids import byte_bpe, strings

MAGIC = b"TKB1"
END_ID = 2
#: Of each generation of a worker's cache, and of the texts whose pieces are looked up together: most pieces
#: of a large corpus are rare, and a worker has no other large state.
CACHE_BYTES, PART_BYTES = 110_000_000, 8_000_000
NULL_ID, BEGUN, GOES_ON = 1, 2, 4
_HEAD = struct.Struct("<4s2I")
_FIELDS = "part int, block int, first_doc long, last_doc long, n_docs long, n_ids long, bytes binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = ["part", "block", "first_doc", "last_doc", "n_docs", "n_ids", "bytes"]


def pack_block(ids: np.ndarray, doc_ids: list[int | None], counts: list[int], begun: bool, goes_on: bool, vocab: int) -> bytes:
    """Bytes of a block that holds ``counts[i]`` ids of document ``doc_ids[i]``."""
    flags = np.array([NULL_ID if d is None else 0 for d in doc_ids], np.uint8)
    flags[0] |= BEGUN * begun
    flags[-1] |= GOES_ON * goes_on
    directory = zstandard.ZstdCompressor(level=3).compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(counts, "<u4").tobytes() + flags.tobytes())
    body = _HEAD.pack(MAGIC, len(doc_ids), len(directory)) + directory + encode_block(ids, vocab)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(block: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray, bool, bool]:
    """(ids, document ids, ids of each document, begun before, goes on) of a block."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("token file: checksum of a block differs")
    magic, n, size = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("token file: unknown block format")
    directory = zstandard.ZstdDecompressor().decompress(block[_HEAD.size:_HEAD.size + size])
    doc_ids = np.frombuffer(directory, "<i8", n)
    counts = np.frombuffer(directory, "<u4", n, 8 * n)
    flags = np.frombuffer(directory, np.uint8, n, 12 * n)
    ids = decode_block(block[_HEAD.size + size:-4])
    if int(counts.sum()) != len(ids):
        raise ValueError("token file: directory and ids differ")
    names = [None if f & NULL_ID else d for d, f in zip(doc_ids.tolist(), flags.tolist())]
    return ids, names, counts, bool(flags[0] & BEGUN), bool(flags[-1] & GOES_ON)


class _Blocks:
    """Collects the ids of documents and cuts them into blocks."""

    def __init__(self, part: int, vocab: int, block_ids: int):
        self.part, self.vocab, self.block_ids = part, vocab, block_ids
        self.block = 0
        self.begun = False
        self._clear()

    def _clear(self) -> None:
        self.ids: list[bytes] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[pa.RecordBatch]:
        while ids:
            now = ids[:4 * (self.block_ids - self.n)]
            ids = ids[len(now):]
            self.ids.append(now)
            self.docs.append(doc_id)
            self.counts.append(len(now) // 4)
            self.n += len(now) // 4
            if self.n == self.block_ids:
                yield self.flush(goes_on=bool(ids))

    def flush(self, goes_on: bool = False) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(self.ids), "<u4")
        row = [self.part, self.block, self.docs[0], self.docs[-1], len(self.docs), self.n,
               pack_block(flat, self.docs, self.counts, self.begun, goes_on, self.vocab)]
        self.block, self.begun = self.block + 1, goes_on
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], _NAMES)


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the documents' ids to the folder ``path``; ``tokenizer`` is a vocabulary file that every executor has."""
    text = F.col(text_col).cast("string")
    # Rows of one id are spread by their text, equal rows by their place.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("i"))
    keys = ["doc_id", "h", "i"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = byte_bpe(tokenizer, cache_bytes=CACHE_BYTES)
        vocab = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        out = _Blocks(TaskContext.get().partitionId(), vocab, block_ids)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.each(strings(b.column(1)), PART_BYTES)):
                yield from out.add(doc_id, ids + end)
        if out.n:
            yield out.flush()

    placed.mapInArrow(run, _FIELDS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, ids as little-endian unsigned 32-bit."""
    blocks = spark.read.schema(_FIELDS).parquet(path)
    # One row a part: as many as the write had tasks.
    before = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = (blocks.select("part", "block", "bytes").join(before, "part").repartition("part")
              .sortWithinPartitions("part", "block").select("part", "before", "bytes"))

    def run(batches):
        part, at, held = None, 0, []
        for b in batches:
            for p, first, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if p != part:
                    part, at = p, first
                ids, names, counts, begun, goes_on = unpack_block(block.as_py())
                if begun != bool(held):
                    raise ValueError("token file: a block is missing")
                raw, upto = ids.tobytes(), 0
                out_start, out_n, out_ids, out_id = [], [], [], []
                for k, (name, n) in enumerate(zip(names, counts.tolist())):
                    held.append(raw[4 * upto:4 * (upto + n)])
                    upto += n
                    if goes_on and k == len(names) - 1:
                        break
                    whole = b"".join(held)
                    held.clear()
                    out_id.append(name)
                    out_start.append(at)
                    out_n.append(len(whole) // 4)
                    out_ids.append(whole)
                    at += len(whole) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_id, pa.int64()), pa.array(out_start, pa.int64()), pa.array(out_n, pa.int64()),
                     pa.array(out_ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
