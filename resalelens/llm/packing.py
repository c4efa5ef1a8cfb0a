"""Packing tokenised documents into sequences: first-fit decreasing per random group.

Documents are tokenised inside Arrow batches (``token_ids``: by distinct words,
through a bounded cache) and cut into full sequences plus a remainder.  The
pieces are dealt into randomised groups of about ``group_docs`` documents and
each group is packed on its own by first-fit decreasing.

A group is never collected: its pieces arrive sorted by length, longest first,
and stream through the packer, which holds only the free room of the group's
bins in a tournament tree (the first bin with enough room is found by walking
down from the root).  What is kept of a piece -- its ids, or just a digest --
rides along as payload.

The group of a piece is a hash of the document, its ids, the piece's start, the
task and a repeat counter: copies of one document are dealt like any others
(no group grows with them) and a task that runs again deals the same way.

Defined results: null and blank texts are documents of the end id alone;
repeated rows are packed one by one; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.token_ids import strings, word_bpe

MAX_TOKENS = 4096
END_ID = 2
GROUP_DOCS = 8192
SEED = 23
PART_BYTES = 8_000_000  # text whose words are looked up together


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, deal, ids) per piece of at most ``max_tokens``.

    ``ids`` are little-endian unsigned 32-bit, with ``end_id`` after the text;
    ``deal`` is the hash that groups the piece.  ``tokenizer`` is the path of
    the vocabulary file, which every executor has.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * max_tokens

    def run(batches):
        encoder = word_bpe(tokenizer)
        task = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for b in batches:
            out = [[], [], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.each(strings(b.column(1)), PART_BYTES)):
                ids += end
                who = (doc_id, zlib.crc32(ids), len(ids))
                seen[who] += 1
                for k in range(0, len(ids), step):
                    piece = ids[k:k + step]
                    deal = xxhash.xxh64_intdigest(f"{who} {seen[who]} {task} {k}", SEED) >> 2
                    for col, v in zip(out, (doc_id, k // 4, len(piece) // 4, len(ids) // 4, deal, piece)):
                        col.append(v)
                if len(out[0]) >= 2000:
                    yield _batch(out)
                    out = [[], [], [], [], [], []]
            yield _batch(out)

    return src.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, deal long, ids binary")


def _batch(out) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                      ["doc_id", "start", "length", "doc_tokens", "deal", "ids"])


class FirstFit:
    """Bins of one group: a max-tree over their free room, grown by doubling."""

    def __init__(self, capacity: int):
        self.capacity, self.size, self.bins = capacity, 1, 0
        self.tree = [0, 0]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece in the first bin with room, or in a new one."""
        tree = self.tree
        if length == self.capacity or tree[1] < length:
            if length < self.capacity and self.bins == self.size or self.bins >= self.size:
                self._grow()
                tree = self.tree
            at = self.bins
            self.bins += 1
            free = self.capacity
        else:
            node = 1
            while node < self.size:
                node *= 2
                if tree[node] < length:
                    node += 1
            at, free = node - self.size, tree[node]
        node = at + self.size
        tree[node] = free - length
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
        return at, self.capacity - free

    def _grow(self) -> None:
        leaves = self.tree[self.size:] + [0] * self.size
        self.size *= 2
        self.tree = [0] * self.size + leaves
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])


def pack(pieces: DataFrame, groups: int, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of ``deal``.

    Needs the columns ``length`` and ``deal`` (non-negative hash); all others
    are payload.  A sequence id is group * 2^40 + bin.
    """
    payload = [c for c in pieces.columns if c != "deal"]
    dealt = pieces.select(F.col("deal") % F.lit(groups), *[F.col(c) for c in payload], "deal").toDF("g", *payload, "deal")
    sort = [F.col("g"), F.col("length").desc(), F.col("deal")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "deal")
    at = payload.index("length") + 1

    def run(batches):
        group, bins = None, None
        for b in batches:
            seq, off = [], []
            for g, n in zip(b.column(0).to_pylist(), b.column(at).to_pylist()):
                if g != group:
                    group, bins = g, FirstFit(max_tokens)
                k, o = bins.place(n)
                seq.append((g << 40) + k)
                off.append(o)
            yield pa.RecordBatch.from_arrays([*[b.column(i + 1) for i in range(len(payload))],
                                              pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                                             [*payload, "sequence_id", "offset"])

    return (dealt.repartition("g").sortWithinPartitions(*sort)
            .mapInArrow(run, f"{schema}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = MAX_TOKENS, end_id: int = END_ID, group_docs: int = GROUP_DOCS,
                   payload: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, payload, sequence_id, offset.

    ``payload`` names what to keep of a piece's ids (a function of the binary
    column); the default keeps the ids themselves as ``ids``.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))
    pieces = token_pieces(docs, tokenizer, id_col, text_col, max_tokens, end_id)
    kept = payload if payload is not None else {"ids": lambda ids: ids}
    pieces = pieces.select("doc_id", "start", "length", "doc_tokens", "deal",
                           *[make(F.col("ids")).alias(name) for name, make in kept.items()])
    return pack(pieces, groups, max_tokens)
