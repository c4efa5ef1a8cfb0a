"""Blocks of token ids under an adaptive context-mixing range coder.

A block is coded on its own: every model starts afresh, so any block can be
decoded without the others.  Its ids are cut into ``lanes`` equal runs that are
coded side by side, one numpy operation for the next id of every lane; the
lanes share one model, which learns from all of them after each step.

Model of the next id, after the two ids before it in the lane:

* order 2 and order 1 each keep, for their context, the id they predict and a
  confidence from 0 to 7 (a hit raises it, a miss halves it, a miss at 1 or 0
  replaces the id); order-2 contexts are hashed into ``2**HASH_BITS`` slots;
* order 0 keeps a count for every id of the vocabulary;
* the three are mixed with adaptive weights, which are learned for each pair of
  confidences (and for whether both orders predict the same id): the interval
  of the range coder is shared out between "the id of order 2", "the id of
  order 1" and order 0's distribution over all ids.

The coder is carry-less: 64-bit ``low`` and ``range``; a range below 2^32 is cut
at the next multiple of 2^32 if it straddles one, and a 32-bit word goes out.
All arithmetic is on integers, so every machine decodes the same ids.

Layout (little-endian): ``MAGIC``, ids u32, lanes u32, vocabulary u32, CRC-32 of
the ids u32, words per lane u32 each, the words of lane 0, 1, ..., and the CRC-32
of everything before it.  A wrong checksum raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR1"
LANES = 4096
STEPS = 128  # ids of a full lane
BLOCK_IDS = LANES * STEPS
HASH_BITS = 18
#: Steps between two sums over the order-0 counts.
REFRESH = 4

_U = np.uint64
_32 = _U(32)
_LOW32 = _U(0xFFFFFFFF)
_FULL = _U(0xFFFFFFFFFFFFFFFF)
_WEIGHT_BITS = 16
_HEAD = struct.Struct("<4s4I")


def lanes_for(n: int) -> int:
    """Lanes of a block of ``n`` ids: runs of 64 ids or more, up to LANES."""
    lanes = 1
    while lanes < LANES and n >= 128 * lanes:
        lanes *= 2
    return max(lanes, -(-n // STEPS))


class _Model:
    """Predictions, mixing weights and order-0 counts of one block."""

    def __init__(self, vocab: int, lanes: int):
        # Predicted id * 8 + confidence.
        self.table1 = np.full(vocab, -8, np.int32)
        self.table2 = np.full(1 << HASH_BITS, -8, np.int32)
        self.hits = np.tile(np.array([4, 4, 8], np.int64), (128, 1))  # weights by confidences: order 2, 1, 0
        self.bounds = np.zeros((128, 4), _U)
        self.bounds[:, 3] = 1 << _WEIGHT_BITS
        self.seen = np.ones(vocab, np.int32)
        # Counts of all smaller ids.
        self.upto = np.zeros(vocab + 1, np.int32)
        self.step = 0
        self.last = np.zeros(lanes, np.int64)
        self.place = np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        """Guesses and confidences for the next id of the first ``n`` lanes; where their share of the interval begins."""
        self.last, self.place = self.last[:n], self.place[:n]
        self.t1, self.t2 = self.table1[self.last], self.table2[self.place]
        self.g1, self.g2 = self.t1 >> 3, self.t2 >> 3
        self.mix = (((self.t2 & 7) << 4) + ((self.t1 & 7) << 1) + (self.g1 == self.g2)).astype(np.int64) << 2
        share = self.hits * ((1 << _WEIGHT_BITS) - 3) // self.hits.sum(axis=1)[:, None] + 1
        self.bounds[:, 1] = share[:, 0]
        self.bounds[:, 2] = share[:, 0] + share[:, 1]
        self.flat = self.bounds.reshape(-1)
        if self.step % REFRESH == 0:
            np.cumsum(self.seen, out=self.upto[1:])
            self.total = _U(int(self.upto[-1]))
        self.step += 1

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose share of the order-0 counts holds each value; in order of value, which is looked up faster."""
        order = np.argsort(value)
        at = np.empty(len(value), np.int64)
        at[order] = np.searchsorted(self.upto, value[order], "right") - 1
        return at

    def learn(self, ids: np.ndarray, small: np.ndarray, at: np.ndarray, rare: np.ndarray) -> None:
        """The ids (64-bit and ``small``, 32-bit), mix + slot of every lane, and the ids that order 0 coded."""
        self.hits += 24 * np.bincount(at, minlength=512).reshape(128, 4)[:, :3]
        if self.step % 16 == 0:
            self.hits = (self.hits + 1) >> 1
        np.add.at(self.seen, rare, np.int32(32))
        fresh = (small << 3) + 1
        for at, table, now, guess in ((self.last, self.table1, self.t1, self.g1), (self.place, self.table2, self.t2, self.g2)):
            sure = now & 7
            # A hit: one surer, 7 at most; a miss: half as sure, and a new guess from 1 or 0 on.
            table[at] = np.where(guess == small, now + (sure < 7), np.where(sure <= 1, fresh, now - sure + (sure >> 1)))
        self.place = _context(self.last, ids)
        self.last = ids


def _context(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Slot of an order-2 context."""
    mixed = before.astype(np.uint32) * np.uint32(0x9E3779B1) + ids.astype(np.uint32) * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """The block's bytes; ``ids`` are integers below ``vocab``, at least one."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if not n or int(ids.max()) >= vocab:
        raise ValueError("a block needs ids, all below the vocabulary's size")
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    by_step = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    # The last lane with ids may be short, the ones after it empty.
    full, rest = divmod(n, steps)
    model = _Model(vocab, lanes)
    low, rng = np.zeros(lanes, _U), np.full(lanes, _FULL)
    out_lane: list[np.ndarray] = []
    out_word: list[np.ndarray] = []

    def narrow(at, start, size):
        lo, r = low[at] + start, size
        short = np.flatnonzero(r <= _LOW32)
        if len(short):
            lo_s, r_s = lo[short], r[short]
            split = ((lo_s ^ (lo_s + r_s)) >> _32) != 0
            r_s = np.where(split, -lo_s & _LOW32, r_s)
            out_lane.append(at[short] if isinstance(at, np.ndarray) else short)
            out_word.append((lo_s >> _32).astype("<u4"))
            lo[short], r[short] = lo_s << _32, r_s << _32
        low[at], rng[at] = lo, r

    for t in range(steps):
        active = full + (t < rest)
        small = by_step[t, :active]
        now = small.astype(np.int64)
        model.predict(active)
        miss2 = small != model.g2
        slot = miss2.astype(np.int64) + (miss2 & (small != model.g1))
        where = model.mix + slot
        start = model.flat[where]
        part = rng[:active] >> _U(_WEIGHT_BITS)
        narrow(slice(0, active), part * start, part * (model.flat[where + 1] - start))
        rare = np.flatnonzero(slot == 2)
        sym = now[rare]
        part = rng[rare] // model.total
        begin = model.upto[sym].astype(_U)
        narrow(rare, part * begin, part * (model.upto[sym + 1].astype(_U) - begin))
        model.learn(now, small, where, sym)
    # One more word: the smallest multiple of 2^32 in the interval.
    used = full + (rest > 0)
    out_lane.append(np.arange(used))
    out_word.append(((low[:used] + _LOW32) >> _32).astype("<u4"))
    lane = np.concatenate(out_lane)
    words = np.concatenate(out_word)[np.argsort(lane, kind="stable")]
    per_lane = np.bincount(lane, minlength=lanes).astype("<u4")
    body = _HEAD.pack(MAGIC, n, lanes, vocab, zlib.crc32(ids.tobytes())) + per_lane.tobytes() + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes) -> np.ndarray:
    """The ids (unsigned 32-bit) of a block."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("token block: checksum of the bytes differs")
    magic, n, lanes, vocab, crc = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("token block: unknown format")
    steps = -(-n // lanes)
    full, rest = divmod(n, steps)
    per_lane = np.frombuffer(block, "<u4", lanes, _HEAD.size).astype(np.int64)
    words = np.frombuffer(block, "<u4", offset=_HEAD.size + 4 * lanes, count=int(per_lane.sum()))
    # Beyond a lane's last word all bits are zero.
    first = np.cumsum(per_lane + 2) - (per_lane + 2)
    stream = np.zeros(len(words) + 2 * lanes, _U)
    stream[np.arange(len(words)) + 2 * np.repeat(np.arange(lanes), per_lane)] = words
    code = (stream[first] << _32) | stream[first + 1]
    at = first + 2
    end = first + per_lane + 1
    low, rng = np.zeros(lanes, _U), np.full(lanes, _FULL)
    grid = np.zeros((steps, lanes), np.int32)
    model = _Model(vocab, lanes)

    def narrow(pick, start, size):
        lo, r = low[pick] + start, size
        short = np.flatnonzero(r <= _LOW32)
        if len(short):
            lo_s, r_s = lo[short], r[short]
            split = ((lo_s ^ (lo_s + r_s)) >> _32) != 0
            r_s = np.where(split, -lo_s & _LOW32, r_s)
            lane = pick[short] if isinstance(pick, np.ndarray) else short
            code[lane] = (code[lane] << _32) | stream[np.minimum(at[lane], end[lane])]
            at[lane] += 1
            lo[short], r[short] = lo_s << _32, r_s << _32
        low[pick], rng[pick] = lo, r

    for t in range(steps):
        active = full + (t < rest)
        model.predict(active)
        part = rng[:active] >> _U(_WEIGHT_BITS)
        value = code[:active] - low[:active]
        # Where the second and the third share begin; compared without a division.
        second, third = part * model.flat[model.mix + 1], part * model.flat[model.mix + 2]
        in2, in3 = value >= second, value >= third
        slot = in2.astype(np.int64) + in3
        where = model.mix + slot
        start = np.where(in3, third, second * in2)
        narrow(slice(0, active), start, np.where(in3, part << _U(_WEIGHT_BITS), np.where(in2, third, second)) - start)
        small = np.where(slot == 0, model.g2, model.g1)
        rare = np.flatnonzero(slot == 2)
        part = rng[rare] // model.total
        value = ((code[rare] - low[rare]) // part).astype(np.int32)
        sym = model.find(value)
        begin = model.upto[sym].astype(_U)
        narrow(rare, part * begin, part * (model.upto[sym + 1].astype(_U) - begin))
        small[rare] = sym
        grid[t, :active] = small
        model.learn(small.astype(np.int64), small, where, sym)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("token block: checksum of the ids differs")
    return ids
