"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, and how often.

A text with a space before it is encoded by a byte-level BPE (A) and a piece BPE
(B).  Where tokens of both end at one byte, the text is cut into groups; all
A-B pairs of token occurrences in a group are links.  A pair of ids counts the documents
that hold it linked.  Every document then gets, over its links, the sum of their
counts and how many are their A id's best (ties included).

Counting is external, by runs:

1. A task links its documents and collects one record for each pair and document
   (with the number of such links).  A full run -- ``RUN_RECORDS`` records or 2^13
   documents -- is sorted side-major (A id first) within ``2**RADIX_BITS`` radix
   partitions, the low bits of the A id, and goes out as zstd chunks: the pairs
   with their document counts, and the records.
2. Runs meet by radix partition, at most about ``FAN_IN`` in a task.  Their count
   chunks are opened as the merge reaches them; a heap holds the next A id of each
   and an A id's counts are added at once.  Further passes merge what the first made, until
   one list a radix partition is left.  As an A id is complete before the next begins,
   its highest count is known when its pairs are written.
3. The counts stream back the same way, pass by pass: chunks of a run's records meet
   the counts of their radix partition and are summed by document.

No task holds more than a run, a heap of open chunks, or the pairs of a radix partition
(at most 786 A ids of 32,000 each; here, some thousand in all).  A frequent id has one entry for each
run, not for each document.

Defined results: texts that are null or empty, or whose joined tokens differ from the text
with its space (``U+2581`` in a text, say), have no tokens: zeros and empty groups.
Repeated rows are documents of their own; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import stored
from resalelens.llm.token_ids import byte_bpe, byte_values, parts, strings

RADIX_BITS = 6
RUN_RECORDS = 1 << 20
FAN_IN = 128
CHUNK_PAIRS = 1 << 16
PART_BYTES = 2_000_000
#: Links of a group that are listed one by one; larger groups go by their distinct ids.
LISTED_LINKS = 64

_DOC_BITS, _MULT_BITS, _B_BITS = 13, 20, 15
_RUN_DOCS = 1 << _DOC_BITS
_MOST = (1 << _MULT_BITS) - 1
_HIGH = 16 - RADIX_BITS
_DOC_FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
_FIELDS = f"run long, radix int, idx int, {_DOC_FIELDS}, first long, counts binary, records binary"


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """31-bit key of a pair: radix (low bits of A), the rest of A, B."""
    a = a.astype(np.uint64)
    return ((a & np.uint64((1 << RADIX_BITS) - 1)) << np.uint64(_HIGH + _B_BITS)
            | (a >> np.uint64(RADIX_BITS)) << np.uint64(_B_BITS) | b.astype(np.uint64))


class _Bytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.all[np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Linker:
    """Both tokenizers, and the links of texts."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        self.a = byte_bpe(byte_path, space=True, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        value = byte_values()
        vocab = self.a.tokenizer.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes([value[c] for c in t]) if all(c in value for c in t) else t.encode()
        self.a_bytes = _Bytes(tokens)
        self.b_bytes = _Bytes([bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                               else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())])
        if len(tokens) > 1 << 16 or self.b.vocab_size() > 1 << _B_BITS:
            raise ValueError("vocabularies of at most 65536 (A) and 32768 (B) ids")
        digits = np.arange(1 << 16).astype("S5")
        self.digits = np.frombuffer(digits.tobytes(), np.uint8).reshape(-1, 5)
        self.n_digits = np.char.str_len(digits).astype(np.int64)

    def _same(self, ids: np.ndarray, n: np.ndarray, vocab: _Bytes, want: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each text, whether its tokens' bytes are its own."""
        upto = np.concatenate([[0], np.cumsum(vocab.size[ids])])
        last = np.cumsum(n)
        fits = upto[last] - upto[last - n] == size
        got = vocab.joined(ids[np.repeat(fits, n)])
        wrong = np.concatenate([[0], np.cumsum(got != want[np.repeat(fits, size)])])
        end = np.cumsum(size[fits])
        same = np.zeros(len(n), bool)
        same[fits] = wrong[end] == wrong[end - size[fits]]
        return same

    def link(self, texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """Numbers and groups of each text, and the records (text, pair, links) in that order."""
        ids_a, n_a = self.a.encode(texts)
        plain = texts.to_pylist()
        lists = self.b.encode(plain, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n_b.sum()))
        size = np.fromiter((len(t.encode()) + 1 for t in plain), np.int64, len(plain))
        want = np.frombuffer("".join([" " + t for t in plain]).encode(), np.uint8)
        good = (size > 1) & self._same(ids_a, n_a, self.a_bytes, want, size) & self._same(ids_b, n_b, self.b_bytes, want, size)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)].astype(np.int64), ids_b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        end_a, end_b = np.cumsum(self.a_bytes.size[ids_a]), np.cumsum(self.b_bytes.size[ids_b])
        ends = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.int8)
        ends[end_a] = 1
        ends[end_b] += 2
        close_a, close_b = ends[end_a] == 3, ends[end_b] == 3
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        groups = int(close_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        links = in_a * in_b
        n_groups = _per_text(close_a, n_a)
        doc = np.repeat(np.arange(len(plain)), n_groups)
        n_links = np.zeros(len(plain), np.int64)
        np.add.at(n_links, doc, links)
        key, times = self._records(ids_a, ids_b, in_a, in_b, first_a, first_b, links, doc)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "key": key, "times": times,
                "groups": self._written(ids_a, ids_b, n_a, n_b, close_a, close_b, group_a, group_b, in_a, first_a, first_b)}

    @staticmethod
    def _records(ids_a, ids_b, in_a, in_b, first_a, first_b, links, doc) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (text << 31 | pair) and the links of each."""
        few = np.flatnonzero(links <= LISTED_LINKS)
        n = links[few]
        group = np.repeat(few, n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        a, b = ids_a[first_a[group] + k // in_b[group]], ids_b[first_b[group] + k % in_b[group]]
        keys = [doc[group].astype(np.uint64) << np.uint64(31) | pair_key(a, b)]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(links > LISTED_LINKS).tolist():
            ua, ca = np.unique(ids_a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(ids_b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            keys.append(np.uint64(doc[g]) << np.uint64(31) | pair_key(np.repeat(ua, len(ub)), np.tile(ub, len(ua))))
            times.append(np.outer(ca, cb).reshape(-1))
        if len(keys) == 1:
            return np.unique(keys[0], return_counts=True)
        key, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[new], np.add.reduceat(times[order], new)

    def _written(self, ids_a, ids_b, n_a, n_b, close_a, close_b, group_a, group_b, in_a, first_a, first_b) -> pa.Array:
        """The groups of each text: ``a1,a2|b1;a3|b2,b3``."""
        n = len(ids_a) + len(ids_b)
        at_a = np.arange(len(ids_a)) + first_b[group_a]
        at_b = np.arange(len(ids_b)) + first_a[group_b] + in_a[group_b]
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        mark[at_a[close_a]] = ord("|")
        mark[at_b[close_b]] = ord(";")
        last = np.cumsum(n_a + n_b)
        ended = last[(n_a + n_b) > 0] - 1
        wide = self.n_digits[ids]
        out = np.zeros((n, 6), np.uint8)
        out[:, :5] = self.digits[ids]
        out[np.arange(n), wide] = mark
        wide = wide + 1
        wide[ended] -= 1
        flat = out[np.arange(6) < wide[:, None]]
        upto = np.concatenate([[0], np.cumsum(wide)])
        offsets = np.concatenate([[0], upto[last]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(n_a), pa.py_buffer(offsets), pa.py_buffer(flat))


def _per_text(flag: np.ndarray, n: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flag)])
    last = np.cumsum(n)
    return upto[last] - upto[last - n]


@functools.lru_cache(maxsize=1)
def _linker(byte_path: str, piece_path: str) -> Linker:
    return Linker(byte_path, piece_path)


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([a.tobytes() for a in arrays]))


def pack_counts(keys: np.ndarray, n: np.ndarray, best: np.ndarray | None = None) -> bytes:
    """Chunk of sorted pair keys, their counts and whether each is its A id's best."""
    best = np.zeros(len(keys), np.uint8) if best is None else best.astype(np.uint8)
    return _zip(np.diff(keys, prepend=0).astype("<u4"), n.astype("<u8"), best)


def unpack_counts(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(chunk)
    n = len(raw) // 13
    return (np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64),
            np.frombuffer(raw, np.uint8, n, 12 * n).astype(bool))


def pack_records(keys: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Chunk of records sorted by pair and document; ``times`` are below 2^20."""
    step = np.diff(doc, prepend=0).astype("<i2").view(np.uint16)
    return _zip(np.diff(keys, prepend=0).astype("<u4"), (step & 255).astype(np.uint8), (step >> 8).astype(np.uint8),
                (times & 255).astype(np.uint8), (times >> 8).astype("<u2"))


def unpack_records(chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(chunk)
    n = len(raw) // 9
    keys = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)
    step = np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint16) | np.frombuffer(raw, np.uint8, n, 5 * n).astype(np.uint16) << 8
    times = np.frombuffer(raw, np.uint8, n, 6 * n).astype(np.int64) + (np.frombuffer(raw, "<u2", n, 7 * n).astype(np.int64) << 8)
    return keys, np.cumsum(step.view(np.int16).astype(np.int64)), times


class _Run:
    """Records of up to 2^13 documents."""

    def __init__(self, task: int, run_records: int):
        self.task, self.run_records, self.no = task, run_records, 0
        self._clear()

    def _clear(self) -> None:
        self.docs = self.records = 0
        self.held: list[np.ndarray] = []

    @property
    def id(self) -> int:
        return self.task << 24 | self.no

    @property
    def full(self) -> bool:
        return self.docs >= _RUN_DOCS or self.records >= self.run_records

    def add(self, keys: np.ndarray, times: np.ndarray, docs: int) -> None:
        """Records of the next ``docs`` texts; keys are text << 31 | pair."""
        more = -(-times // _MOST)
        keys = np.repeat(keys, more)
        rest = np.repeat(times - (more - 1) * _MOST, more)
        rest[np.arange(len(rest)) - np.repeat(np.cumsum(more) - more, more) > 0] = _MOST
        doc = (keys >> np.uint64(31)) + np.uint64(self.docs)
        pair = keys & np.uint64((1 << 31) - 1)
        self.held.append(pair << np.uint64(33) | doc << np.uint64(_MULT_BITS) | rest.astype(np.uint64))
        self.docs += docs
        self.records += len(keys)

    def chunks(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(radix, first key, counts, records) of the run's radix partitions; the run ends."""
        rec = np.sort(np.concatenate(self.held)) if self.held else np.empty(0, np.uint64)
        key = (rec >> np.uint64(33)).astype(np.int64)
        doc = (rec >> np.uint64(_MULT_BITS)).astype(np.int64) & (_RUN_DOCS - 1)
        times = rec.astype(np.int64) & _MOST
        cut = np.searchsorted(key, np.arange((1 << RADIX_BITS) + 1) << (31 - RADIX_BITS))
        for radix, (i, j) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            if i < j:
                k, d = key[i:j], doc[i:j]
                one = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))  # documents, not records
                pairs, n = np.unique(k[one], return_counts=True)
                yield radix, int(k[0]), pack_counts(pairs, n), pack_records(k, d, times[i:j])
        self._clear()
        self.no += 1


def linked_runs(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str, run_records: int) -> DataFrame:
    """A row for each document (``radix`` null) and for each radix partition of each run."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def chunk_rows(run: _Run) -> pa.RecordBatch:
        name, rows = run.id, list(run.chunks())
        radix, first, counts, records = zip(*rows) if rows else ([], [], [], [])
        return _rows(len(rows), run=[name] * len(rows), radix=radix, first=first, counts=counts, records=records)

    def linked(batches):
        link = _linker(byte_path, piece_path).link
        run = _Run(TaskContext.get().partitionId(), run_records)
        for b in batches:
            at = 0
            for part in parts(strings(b.column(1)), PART_BYTES):
                got = link(part)
                text = (got["key"] >> np.uint64(31)).astype(np.int64)
                done = 0
                while done < len(part):
                    # As many of the part's texts as the run takes.
                    to = min(len(part), done + _RUN_DOCS - run.docs)
                    i, j = np.searchsorted(text, [done, to])
                    n = to - done
                    yield _rows(n, run=[run.id] * n, idx=range(run.docs, run.docs + n), doc_id=b.column(0).slice(at + done, n),
                                groups=got["groups"].slice(done, n).cast(pa.string()),
                                **{c: got[c][done:to] for c in ("n_a", "n_b", "n_groups", "n_links")})
                    run.add(got["key"][i:j] - (np.uint64(done) << np.uint64(31)), got["times"][i:j], n)
                    if run.full:
                        yield chunk_rows(run)
                    done = to
                at += len(part)
        if run.docs:
            yield chunk_rows(run)

    return src.mapInArrow(linked, _FIELDS)


_KINDS = {"run": pa.int64(), "radix": pa.int32(), "idx": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
          "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "first": pa.int64(), "counts": pa.binary(),
          "records": pa.binary()}


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], k)) if c in columns else pa.nulls(n, k)
         for c, k in _KINDS.items()], list(_KINDS))


def _by_partition(batches) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """Rows (parent, radix, ...) that are sorted by these two, one such partition after the other."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    return itertools.groupby(rows, key=lambda r: (r[0], r[1]))


def merged(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, counts, best) of each A id, from (first key, chunk) rows sorted by first key.

    A heap holds the next A id of every chunk that the merge has reached.
    """
    heap: list[tuple[int, int]] = []
    open_: dict[int, Iterator] = {}
    names = itertools.count()
    rows = iter(rows)
    row = next(rows, None)

    def segments(chunk: bytes):
        keys, n, _ = unpack_counts(chunk)
        a = keys >> _B_BITS
        cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])).tolist()
        for i, j in zip(cut, [*cut[1:], len(keys)]):
            yield int(a[i]), keys[i:j], n[i:j]

    def advance(name: int, segs: Iterator) -> None:
        seg = next(segs, None)
        if seg is None:
            open_.pop(name, None)
        else:
            open_[name] = (segs, seg)
            heapq.heappush(heap, (seg[0], name))

    while heap or row is not None:
        while row is not None and (not heap or row[0] >> _B_BITS <= heap[0][0]):
            advance(next(names), segments(row[1]))
            row = next(rows, None)
        a, found = heap[0][0], []
        while heap and heap[0][0] == a:
            _, name = heapq.heappop(heap)
            segs, seg = open_[name]
            found.append(seg)
            advance(name, segs)
        if len(found) == 1:
            _, keys, n = found[0]
        else:
            every = np.concatenate([f[1] for f in found])
            order = np.argsort(every, kind="stable")
            every = every[order]
            new = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            keys, n = every[new], np.add.reduceat(np.concatenate([f[2] for f in found])[order], new)
        yield keys, n, n == n.max()


def _merge(nodes: DataFrame, parents: int) -> DataFrame:
    """(node, radix, first, counts) of ``parents`` nodes from (node, radix, first, counts)."""
    parent = F.pmod(F.xxhash64("node"), F.lit(parents))
    placed = (nodes.select(parent.alias("parent"), "radix", "first", "counts").repartition("parent", "radix")
              .sortWithinPartitions("parent", "radix", "first"))

    def run(batches):
        for (parent, radix), rows in _by_partition(batches):
            held, size = [], 0
            for found in merged((r[2], r[3]) for r in rows):
                held.append(found)
                size += len(found[0])
                if size >= CHUNK_PAIRS:
                    yield _chunk(parent, radix, held)
                    held, size = [], 0
            if held:
                yield _chunk(parent, radix, held)

    return placed.mapInArrow(run, "node long, radix int, first long, counts binary")


def _chunk(node: int, radix: int, held: list[tuple]) -> pa.RecordBatch:
    keys, n, best = (np.concatenate(c) for c in zip(*held))
    return pa.RecordBatch.from_arrays(
        [pa.array([node], pa.int64()), pa.array([radix], pa.int32()), pa.array([int(keys[0])], pa.int64()),
         pa.array([pack_counts(keys, n, best)], pa.binary())], ["node", "radix", "first", "counts"])


def _met(counts: DataFrame, nodes: DataFrame, parents: int, body: str) -> DataFrame:
    """(parent, radix, kind, first, node, body): counts (kind 0), then the chunks of the nodes below them."""
    return (counts.select(F.col("node").alias("parent"), "radix", F.lit(0).alias("kind"), "first", "node", F.col("counts").alias("body"))
            .unionByName(nodes.select(F.pmod(F.xxhash64("node"), F.lit(parents)).alias("parent"), "radix", F.lit(1).alias("kind"),
                                      "first", "node", F.col(body).alias("body")))
            .repartition("parent", "radix").sortWithinPartitions("parent", "radix", "kind", "first"))


def _answered(rows: Iterator[tuple]) -> Iterator[tuple[int, int, bytes, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(node, first, body, counts) of each chunk, after the counts of its radix partition."""
    held, counts = [], None
    for _, _, kind, first, node, body in rows:
        if kind == 0:
            held.append(unpack_counts(body))
        else:
            if counts is None:
                counts = tuple(np.concatenate(c) for c in zip(*held))
            yield node, first, body, counts


def _handed_down(counts: DataFrame, nodes: DataFrame, parents: int) -> DataFrame:
    """``nodes`` with the final counts of their pairs, from those of their parents."""
    def run(batches):
        for (_, radix), rows in _by_partition(batches):
            for node, first, body, (keys, n, best) in _answered(rows):
                mine = unpack_counts(body)[0]
                at = np.searchsorted(keys, mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node], pa.int64()), pa.array([radix], pa.int32()), pa.array([first], pa.int64()),
                     pa.array([pack_counts(mine, n[at], best[at])], pa.binary())], ["node", "radix", "first", "counts"])

    return _met(counts, nodes, parents, "counts").mapInArrow(run, "node long, radix int, first long, counts binary")


def _summed(counts: DataFrame, runs: DataFrame, parents: int) -> DataFrame:
    """(run, idx, n_best, count_sum) of every document with links."""
    def sums(batches):
        for _, rows in _by_partition(batches):
            for node, _, body, (keys, n, best) in _answered(rows):
                mine, doc, times = unpack_records(body)
                at = np.searchsorted(keys, mine)
                total, top = np.zeros(_RUN_DOCS, np.int64), np.zeros(_RUN_DOCS, np.int64)
                np.add.at(total, doc, times * n[at])
                np.add.at(top, doc, times * best[at])
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node], pa.int64()), pa.array([_zip(hit.astype("<u2"), top[hit].astype("<i8"), total[hit].astype("<i8"))],
                                                            pa.binary())], ["run", "sums"])

    def added(batches):
        rows = ((r, s) for b in batches for r, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for run, chunks in itertools.groupby(rows, key=lambda r: r[0]):
            total, top = np.zeros(_RUN_DOCS, np.int64), np.zeros(_RUN_DOCS, np.int64)
            for _, chunk in chunks:
                raw = zstandard.ZstdDecompressor().decompress(chunk)
                n = len(raw) // 18
                doc = np.frombuffer(raw, "<u2", n)
                top[doc] += np.frombuffer(raw, "<i8", n, 2 * n)
                total[doc] += np.frombuffer(raw, "<i8", n, 10 * n)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(hit), pa.int64()), pa.array(hit, pa.int32()), pa.array(top[hit]),
                                              pa.array(total[hit])], ["run", "idx", "n_best", "count_sum"])

    parts_ = _met(counts, runs, parents, "records").mapInArrow(sums, "run long, sums binary")
    return (parts_.repartition("run").sortWithinPartitions("run")
            .mapInArrow(added, "run long, idx int, n_best long, count_sum long"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
          payload: dict[str, Callable[[Column], Column]] | None = None, run_records: int = RUN_RECORDS,
          fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, payload, n_best, count_sum.

    ``payload`` names what to keep of a document's groups (a function of the text
    ``a1,a2|b1;a3|b2,b3``); the default keeps the text itself as ``groups``.
    """
    kept = payload if payload is not None else {"groups": lambda g: g}
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    all_rows = stored(linked_runs(docs, byte_path, piece_path, id_col, text_col, run_records).select(
        "run", "radix", "idx", *numbers, *[make(F.col("groups")).alias(f"p_{name}") for name, make in kept.items()],
        "first", "counts", "records"), "linked")
    runs = all_rows.where("radix is not null").withColumnRenamed("run", "node")
    nodes, left = runs, runs.select("node").distinct().count()
    passes = []
    while True:
        parents = max(1, math.ceil(left / fan_in))
        counts = stored(_merge(nodes, parents), "counts")
        passes.append((nodes, parents))
        if parents == 1:
            break
        nodes, left = counts, parents
    for nodes, parents in reversed(passes[1:]):
        counts = stored(_handed_down(counts, nodes, parents), "counts")
    sums = _summed(counts, runs, passes[0][1])
    documents = all_rows.where("radix is null").select(
        "run", "idx", *numbers, *[F.col(f"p_{name}").alias(name) for name in kept])
    return documents.join(sums, ["run", "idx"], "left").select(
        *numbers, *kept, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
