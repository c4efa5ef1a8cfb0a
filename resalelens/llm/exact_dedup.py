"""Exact duplicates with a heavy-hitter split.

1. Each text is normalised (A-Z lower-cased, null as empty) and digested with
   SHA-256 inside Arrow batches; only ``(id, digest)`` rows leave that stage
   and are written once to the shared folder.
2. A Misra-Gries summary with ``counters`` counters per task, summed over the
   tasks, undercounts a digest by at most ``rows / (counters + 1)``.  Every
   digest on more than ``rows / heavy_share`` rows therefore keeps an estimate
   of at least ``rows / heavy_share - rows / (counters + 1)``, and as all
   estimates together are at most ``rows``, no more than
   ``1 / (1/heavy_share - 1/(counters+1))`` digests can reach that bound: with
   the defaults at most 512 candidates, whatever the input.
3. The candidates are counted exactly (partial counts per task, at most 512
   groups), which also gives the row that stays: the verified winners, a
   table of at most 512 rows, are broadcast and their rows are settled on the
   map side without any shuffle.
4. The remaining digests, none on more than ``rows / heavy_share`` rows, are
   grouped by an ordinary shuffle.

Of equal texts the row with the largest id stays.  Defined results: null
texts are empty texts; a null id never stays while another id has the text;
rows that repeat an id are copies like any other: exactly one row of a group is marked
kept, and ``keep_id`` names its id.  Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import stored

COUNTERS = 511
HEAVY_SHARE = 256


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest): SHA-256 of each normalised text, one row per document; ``row`` tells equal rows apart."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            out = [hashlib.sha256((t or b"").lower()).digest()
                   for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "row", "digest"])

    return src.mapInArrow(run, "doc_id long, row long, digest binary")


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, estimate): the summaries of all tasks, added up."""
    def run(batches):
        count: dict[bytes, int] = {}
        for b in batches:
            for d in b.column(0).to_pylist():
                if d in count:
                    count[d] += 1
                elif len(count) < counters:
                    count[d] = 1
                else:
                    for k in list(count):
                        count[k] -= 1
                        if not count[k]:
                            del count[k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["digest", "part"])

    return (digests.select("digest").mapInArrow(run, "digest binary, part long")
            .groupBy("digest").agg(F.sum("part").alias("estimate")))


def heavy_digests(digests: DataFrame, rows: int, counters: int = COUNTERS,
                  heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Digests that may be on more than ``rows / heavy_share`` rows (a bounded few)."""
    least = rows / heavy_share - rows / (counters + 1)
    return misra_gries(digests, counters).where(F.col("estimate") >= F.lit(float(max(least, 1.0)))).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 counters: int = COUNTERS, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    if counters < 2 * heavy_share - 1:
        raise ValueError("counters must be at least 2 * heavy_share - 1 for the broadcast bound to hold")
    digests = stored(text_digests(docs, id_col, text_col), "digests")
    rows = digests.count()
    size = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")]
    candidates = heavy_digests(digests, rows, counters, heavy_share)
    winners = stored(digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*size), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(*size), "digest")
    return (heavy.unionByName(light)
            .select("doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("keep.row")).alias("kept")))
