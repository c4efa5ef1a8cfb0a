"""SimHash near-duplicates by multi-index hashing.

*Fingerprints.*  A-Z lower-cased words, shingles of ``shingle`` words joined by
a space (repeats count; fewer words: the whole sequence; none: fingerprint 0);
each shingle is hashed with XXH64 (seed 42) and a fingerprint bit is 1 where
more than half of the hashes have it.

*Links* join distinct fingerprints at most ``max_bits`` bits apart.  The 64 bits
are cut into segments with radii r_i, where sum(r_i + 1) = max_bits + 1: two
linked fingerprints are within r_i in at least one segment.  For each segment
the small Hamming ball around a fingerprint's value is enumerated and joined
with the table of segment values; matches are verified on all 64 bits.  Balls
only go up (0 -> 1 flips of the lower side for radius 1): a pair is found from
one of its sides, which halves the probes and loses nothing.

*Plan.*  More and shorter segments mean fewer probes but larger buckets;
``segment_plan`` takes the number of distinct fingerprints and picks the cut
with the least expected work.  Every cut finds the same links.

*Crowded buckets.*  A large group of near copies fills a bucket with many
distinct fingerprints, whose pairs would grow with the square of the group.
Buckets of more than ``bucket_limit`` rows are therefore not paired: their
fingerprints meet through midpoints.  Two fingerprints are at most 4 bits apart
exactly if some value is within 2 bits of both, and any two that share such a
value are at most 4 apart; so each crowded fingerprint emits its ball of radius
max_bits // 2 (and for odd max_bits one of them one bit more), and all sharing
a midpoint are chained to the smallest one: the same components from a number
of rows proportional to the fingerprints.

Defined results: null and blank texts have fingerprint 0 and are linked like
any other; equal fingerprints are one node, so repeated rows share a component;
the component id is the smallest non-null id reachable (null if all are null);
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import stored
from resalelens.llm.components import components

SHINGLE = 4
MAX_BITS = 4
BUCKET_LIMIT = 256
_SEED = 42
_CHUNK = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    h = xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return h(b" ".join(tokens), _SEED)
    joined = b" ".join(tokens)
    start = [0, *itertools.accumulate(len(t) + 1 for t in tokens)]
    n = len(tokens) - shingle + 1
    total = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        m = min(n, k + _CHUNK)
        values = [h(joined[i:j - 1], _SEED) for i, j in zip(start[k:m], start[k + shingle:m + shingle])]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fingerprint as signed long and the text's hash, one row per document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.xxhash64(F.col(text_col)).alias("text_hash"))

    def run(batches):
        for b in batches:
            out = [fingerprint(t, shingle) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            fp = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp], ["doc_id", "text_hash", "fp"])

    return src.mapInArrow(run, "doc_id long, text_hash long, fp long")


def segment_plan(n: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """[(first bit, width, radius)] covering 64 bits with sum(radius + 1) = max_bits + 1.

    Chosen for ``n`` fingerprints: least probes plus expected candidates of
    one fingerprint, over 1 to max_bits + 1 segments.  Radii above 2 are not used,
    nor cuts without any ball (all radii 0) where another one fits.
    """
    best = bare = None
    for m in range(1, max_bits + 2):
        base, extra = divmod(max_bits + 1, m)
        radii = [base + (i < extra) - 1 for i in range(m)]
        if max(radii) > 2:
            continue
        for give in range(0, 12):  # bits moved from the segments of small radius to those of large radius
            low = [i for i in range(m) if radii[i] < radii[0]]
            high = m - len(low)
            widths = [64 // m + (i < 64 % m) for i in range(m)]
            if low:
                for j in range(give * len(low)):
                    widths[low[j % len(low)]] -= 1
                    widths[j % high] += 1
            if min(widths) < 8 or max(widths) > 62:
                continue
            balls = [sum(math.comb(w, r) for r in range(radius + 1)) for w, radius in zip(widths, radii)]
            cost = sum(balls) + n * sum(b / 2.0 ** w for b, w in zip(balls, widths))
            starts = list(itertools.accumulate([0, *widths[:-1]]))
            cut = (cost, list(zip(starts, widths, radii)))
            if max(radii) == 0:
                bare = cut if bare is None else min(bare, cut)
            elif best is None or cost < best[0]:
                best = cut
    if best is None and bare is None:
        raise ValueError("max_bits is too large for 64-bit fingerprints")
    return (best or bare)[1]


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def _keys(fp: Column, plan: list[tuple[int, int, int]]) -> tuple[Column, Column]:
    """Table keys and probe keys of a fingerprint: arrays of (seg, value) structs.

    The probes are the table value and, for radius 1, its upward neighbours;
    for radius 2 the whole ball.
    """
    def key(seg: int, value: Column) -> Column:
        return F.struct(F.lit(seg).alias("seg"), value.alias("value"))

    table, probes = [], []
    for seg, (start, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        table.append(key(seg, value))
        probes.append(key(seg, value))
        if radius == 1:
            probes += [F.when(value.bitwiseAND(F.lit(1 << i)) == 0, key(seg, value.bitwiseOR(F.lit(1 << i))))
                       for i in range(width)]
        elif radius == 2:
            probes += [key(seg, value.bitwiseXOR(F.lit(1 << i))) for i in range(width)]
            probes += [key(seg, value.bitwiseXOR(F.lit((1 << i) | (1 << j))))
                       for i, j in itertools.combinations(range(width), 2)]
    return F.array(*table), F.array(*probes)


def _ball(fp: Column, radius: int) -> Column:
    """Array of all values within ``radius`` (0..3) bits of ``fp``."""
    one = F.array(*[F.lit(_bit(i)) for i in range(64)])
    out = F.array(fp)
    level = [F.array(F.lit(0).cast("long"))]
    if radius >= 1:
        level.append(one)
    masks = level[0] if radius == 0 else F.concat(*level)
    for _ in range(radius - 1):  # sums of sets of flips: xor of a smaller mask with one more bit
        masks = F.array_distinct(F.flatten(F.transform(masks, lambda m: F.transform(one, lambda b: m.bitwiseXOR(b)))))
        masks = F.array_distinct(F.concat(masks, one, level[0]))
    return F.transform(masks, lambda m: fp.bitwiseXOR(m)) if radius else out


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: every pair within
    ``max_bits`` is joined directly or, in crowded buckets, through others
    that are themselves within ``max_bits`` of both."""
    if max_bits == 0:  # equal fingerprints are one node already
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    plan = segment_plan(fps.count(), max_bits)
    table, probes = _keys(F.col("fp"), plan)
    t = fps.select("fp", F.explode(table).alias("k")).select(F.col("fp").alias("t_fp"), F.col("k.seg").alias("t_seg"), F.col("k.value").alias("t_value"))
    p = (fps.select("fp", F.explode(probes).alias("k")).where("k is not null")
         .select("fp", F.col("k.seg").alias("seg"), F.col("k.value").alias("value")))
    # A probe that meets no table row is gone after this join; the rest carry the bucket's size.
    sizes = t.groupBy("t_seg", "t_value").agg(F.count(F.lit(1)).alias("n"), F.min("t_fp").alias("only"))
    met = (p.join(sizes, (p.seg == sizes.t_seg) & (p.value == sizes.t_value))
           .where((F.col("n") > 1) | (F.col("only") != F.col("fp")))
           .select("fp", "seg", "value", "n"))
    met = stored(met, "probes")
    busy = met.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    busy = stored(busy.where(F.col("m") + F.col("n") > bucket_limit).select("seg", "value"), "busy")

    quiet = met.join(busy, ["seg", "value"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("t_fp"))) <= max_bits
    pairs = (quiet.join(t, (F.col("seg") == F.col("t_seg")) & (F.col("value") == F.col("t_value")))
             .where((F.col("fp") != F.col("t_fp")) & near)
             .select(F.greatest("fp", "t_fp").alias("a"), F.least("fp", "t_fp").alias("b")).distinct())

    crowd = (met.join(busy, ["seg", "value"], "left_semi").select("fp")
             .unionByName(t.join(busy, (F.col("t_seg") == F.col("seg")) & (F.col("t_value") == F.col("value")), "left_semi")
                          .select(F.col("t_fp").alias("fp")))
             .distinct())
    if max_bits % 2 == 0:
        mid = crowd.select("fp", F.explode(_ball(F.col("fp"), max_bits // 2)).alias("mid"))
        low = mid.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = mid.join(low, "mid").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    else:
        # Odd distance: the midpoint is max_bits // 2 from one side and one bit more from the other.
        near_mid = crowd.select("fp", F.explode(_ball(F.col("fp"), max_bits // 2)).alias("mid"))
        low = near_mid.groupBy("mid").agg(F.min("fp").alias("low"))
        far_mid = crowd.select("fp", F.explode(_ball(F.col("fp"), max_bits // 2 + 1)).alias("mid"))
        chained = (far_mid.join(low, "mid").where("fp <> low")
                   .select(F.greatest("fp", "low").alias("a"), F.least("fp", "low").alias("b"))
                   .unionByName(near_mid.join(low, "mid").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")))
                   .distinct())
    return pairs.unionByName(chained)


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp, root) for the fingerprints that have a link."""
    return components(links(fps, max_bits, bucket_limit)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    roots = fingerprint_components(fps.select("fp"), max_bits, bucket_limit)
    root = F.coalesce("root", "fp")
    by_fp = fps.join(roots, "fp", "left").select("fp", root.alias("root"), "first_id")
    ids = by_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = stored(by_fp.join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null last),
    of rows with that id the smallest text hash, of repeats of both the smallest row."""
    found = stored(near_duplicates(docs, id_col, text_col, shingle, max_bits, bucket_limit), "near")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # All rows of a component without any id share the null component id; the
    # fingerprint tells such components apart.
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("lone_fp")]
    keep = found.groupBy(*group).agg(F.min(first).alias("k")).select(
        F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash")).distinct()
    times = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("keep_n"))
    keep = stored(keep.join(times, F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_hash") == F.col("text_hash")))
                  .select("keep_id", "keep_hash", "keep_n"), "keepers")
    renamed = docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"d{i}") for i, c in enumerate(docs.columns)}
    same = at[id_col].cast("long").eqNullSafe(F.col("keep_id")) & (F.xxhash64(at[text_col]) == F.col("keep_hash"))
    once = renamed.join(keep.where("keep_n = 1"), same, "left_semi")
    if not keep.where("keep_n > 1").isEmpty():
        # Repeats of one (id, text): the smallest row, found by partial minima.
        more = renamed.join(keep.where("keep_n > 1"), same)
        once = once.unionByName(more.groupBy("keep_id", "keep_hash").agg(F.min(F.struct(*renamed.columns)).alias("r")).select("r.*"))
    return once.toDF(*docs.columns)
