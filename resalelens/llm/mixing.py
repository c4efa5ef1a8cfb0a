"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) take the weights 3, 1, 2, repeating,
and share ``share`` times all words; a target stops at ``cap`` times its
source's words, the excess going to the others by weight.

Within a source every document expects target / source size copies.  The
documents are ordered by size, the expected copies are summed up along that
order, one random offset per source is added, and a document is emitted once
for every integer boundary its interval crosses.  Ordering by size spreads the
boundaries evenly over short and long documents, so the words taken are near
the target (within about one long document), and no document gets more than
``ceil(target / source size)`` <= ``cap`` copies.

The place of a document is its count-prefix over (size class, hash bucket,
row within the bucket): the first two come from grouped counts -- windows over
the distinct sizes of a source and the buckets of one size -- so no task ever
sorts a whole source, and copies of one text are dealt over ``BUCKETS`` buckets.

Order and offsets are digests of ids, seed and source: reruns agree.

Defined results: null text has size 0; a null source is a source of its own;
a document of size 0 may be emitted but takes no words; repeated rows count
and are drawn one by one; sources without words have target 0 and give none;
an empty table gives no rows; the other columns are returned untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resalelens.llm.common import stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKETS = 256
SEED = 17


def _digest(c: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))))


def _fraction(hex32: Column) -> Column:
    """First 32 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(hex32, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP,
            seed: int = SEED) -> DataFrame:
    """(source, source_size, target, rate, start) from (source, source_size), one row per source.

    The fixed point of capping and resharing: with sources by cap / weight
    ascending, those before some place stop at their cap, the others share
    the rest by weight.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * float(cap))
    order = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = (t.withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("all", F.sum("source_size").over(W.partitionBy()) * float(share)))
    # The level of the sources from this place on, if all before it are at their cap.
    t = t.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open_w"))
    t = t.withColumn("place", F.row_number().over(order))
    first_open = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct("place", "level"))).over(W.partitionBy())
    open_level = first_open["level"]
    target = F.when(open_level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), open_level * F.col("w")))
    return (t.withColumn("target", target)
            .select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
                    _fraction(_digest(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), seed)).alias("start")))


def _named(source: str, prefix: str) -> dict[str, Column]:
    """A source as two columns that are never null."""
    return {f"{prefix}name": F.coalesce(source, F.lit("")), f"{prefix}none": F.col(source).isNull()}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED,
        carry: Sequence[str] | None = None) -> DataFrame:
    """Each document with its number of copies in the mix.

    Columns: ``c0 ...`` (the ``carry`` columns, default all of ``docs``, in
    order), ``size, source_size, target, copies``.
    """
    carry = list(docs.columns if carry is None else carry)
    key = _digest(F.col(id_col), seed)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], word_count(F.col(text_col)).alias("size"),
                       F.col(source_col).cast("string").alias("m_source"), key.alias("m_key"),
                       F.xxhash64(F.col(text_col)).alias("m_hash"))
    rows = rows.withColumn("m_bucket", F.conv(F.substring("m_key", 9, 4), 16, 10).cast("int") % BUCKETS)
    counts = stored(rows.groupBy("m_source", "size", "m_bucket").agg(F.count(F.lit(1)).alias("n")), "counts")

    by_size = counts.groupBy("m_source", "size").agg(F.sum("n").alias("n"))
    before = (W.unboundedPreceding, -1)
    size_start = F.coalesce(F.sum("n").over(W.partitionBy("m_source").orderBy("size").rowsBetween(*before)), F.lit(0))
    bucket_start = F.coalesce(F.sum("n").over(W.partitionBy("m_source", "size").orderBy("m_bucket").rowsBetween(*before)), F.lit(0))
    of_size = by_size.select(F.col("m_source").alias("z_source"), F.col("size").alias("z_size"), size_start.alias("size_start"))
    sums = by_size.groupBy("m_source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    t = targets(sums.withColumnRenamed("m_source", "source"), weights, share, cap, seed)
    place = (counts.withColumn("bucket_start", bucket_start)
             .join(of_size, F.col("m_source").eqNullSafe(F.col("z_source")) & (F.col("size") == F.col("z_size")))
             .join(t, F.col("m_source").eqNullSafe(F.col("source")))
             .select(F.col("m_source").alias("p_source"), F.col("size").alias("p_size"), F.col("m_bucket").alias("p_bucket"),
                     (F.col("size_start") + F.col("bucket_start")).alias("before"), "source_size", "target", "rate", "start"))
    # Keys without nulls, the same for the window and the join: the rows are shuffled once for both.
    keys = ["p_name", "p_none", "p_size", "p_bucket"]
    place = place.withColumns(_named("p_source", "p_")).drop("p_source")
    within = F.row_number().over(W.partitionBy("m_name", "m_none", "size", "m_bucket").orderBy("m_key", "m_hash"))
    placed = (rows.withColumns(_named("m_source", "m_")).drop("m_source").withColumn("k", within)
              .join(place, [F.col(m) == F.col(p) for m, p in zip(("m_name", "m_none", "size", "m_bucket"), keys)]))
    upto = (F.col("before") + F.col("k")).cast("double")
    copies = F.floor(F.col("start") + F.col("rate") * upto) - F.floor(F.col("start") + F.col("rate") * (upto - 1))
    return placed.select(*[f"c{i}" for i in range(len(carry))], "size", "source_size", "target",
                         copies.cast("long").alias("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    mixed = mix(docs, id_col, text_col, source_col, **options).where("copies > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]
    return (mixed.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select(*names).toDF(*docs.columns))


#: DuckDB text for ``(doc_id, size, source_size, target, taken)`` with the default parameters.
SQL = f"""
with d as (select doc_id, source, text, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)]::double as w,
    source_size * 2.0::double as lim from s),
o as (select *, coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as capped,
    sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) as open_w,
    cast(sum(source_size) over () as double) * 1.5::double as total from w),
l as (select *, (total - capped) / open_w as level, row_number() over (order by lim / w, source nulls last) as place from o),
m as (select *, (select arg_min(level, place) from l where level * w <= lim) as open_level from l),
t as (select source, source_size, case when open_level is null then lim else least(lim, open_level * w) end as target from m),
u as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate,
    cast(('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'n')), 1, 8))::bigint as double) / 4294967296.0::double as start from t),
p as (select d.doc_id, d.size, u.source_size, u.target, u.rate, u.start, cast(row_number() over (partition by d.source
    order by d.size, ('0x' || substr(k, 9, 4))::bigint % {BUCKETS}, k) as double) as n
    from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target,
    cast(size * (floor(start + rate * n) - floor(start + rate * (n - 1))) as bigint) as taken from p
"""
