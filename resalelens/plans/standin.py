"""Stand-in data over the test tables.

The source application reads monthly resale records from a web API; the
test tables are a TPC-H-like star schema.  This module maps those tables to
the raw record shape, once as DataFrame code (what the queries run) and
once as SQL text (what the DuckDB oracle runs).  Both give the same rows.

Mapping (fixed values of the test fixture):

* month         = ship date as ``YYYY-MM``
* town          = supplier nation name
* flat_type     = part type: ECONOMY -> EXECUTIVE, PROMO -> MULTI-GENERATION,
                  SMALL -> 3 ROOM, MEDIUM -> 4 ROOM, anything else -> 5 ROOM
* block         = part key as text
* street_name   = part name upper-cased
* storey_range  = ``lpad(3n-2) TO lpad(3n)`` with n = line number
* floor_area_sqm= quantity + 30
* remaining_lease = ``<p_size+45> years[ MM month(s)]`` by order key mod 12
* resale_price  = extended price * 10
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resalelens.sources.tables import read_table

# Fixed mapping of part types to flat types.
FLAT_OF_TYPE = [("ECONOMY", "EXECUTIVE"), ("PROMO", "MULTI-GENERATION"),
                ("SMALL", "3 ROOM"), ("MEDIUM", "4 ROOM")]
FLAT_OTHER = "5 ROOM"


# Tables the transaction stand-in reads.
STANDIN_TABLES = ["lineitem", "part", "supplier", "nation"]


def _flat_type(p_type):
    expr = F.lit(FLAT_OTHER)
    for src, dst in reversed(FLAT_OF_TYPE):
        expr = F.when(p_type == F.lit(src), F.lit(dst)).otherwise(expr)
    return expr


def _pad2(c):
    return F.lpad(c.cast("string"), 2, "0")


def _month(c):
    """``date_format(c, 'yyyy-MM')``, without a formatter for years of four digits."""
    year = F.year(c)
    digits = F.concat(year.cast("string"), F.lit("-"), _pad2(F.month(c)))
    return F.when(year.between(1000, 9999), digits).otherwise(F.date_format(c, "yyyy-MM"))


def _lease_text(orderkey, p_size):
    years = (p_size + 45).cast("string")
    m = orderkey % 12
    return (F.when(m == 0, F.concat(years, F.lit(" years")))
            .when(m == 1, F.concat(years, F.lit(" years 01 month")))
            .otherwise(F.concat(years, F.lit(" years "), _pad2(m), F.lit(" months"))))


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw search records (``month, block, town, flat_type, street_name,
    storey_range, floor_area_sqm, remaining_lease, resale_price``).

    Joins are declared plainly; Catalyst prunes the scans to the eleven
    columns used, and the planner picks the strategy from table sizes:
    ``nation`` (25 rows by definition) and, at small scale, ``supplier`` and
    ``part`` are broadcast by the size-checked ``autoBroadcastJoinThreshold``;
    at scale ``part`` and ``supplier`` fall back to shuffled sort-merge joins
    and AQE splits skewed partitions.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (li.join(part, li.l_partkey == part.p_partkey)
              .join(supp, li.l_suppkey == supp.s_suppkey)
              .join(F.broadcast(nation), supp.s_nationkey == nation.n_nationkey))
    n = F.col("l_linenumber")
    return joined.select(
        _month("l_shipdate").alias("month"),
        F.col("n_name").alias("town"),
        _flat_type(F.col("p_type")).alias("flat_type"),
        F.col("p_partkey").cast("string").alias("block"),
        F.upper("p_name").alias("street_name"),
        F.concat(_pad2(n * 3 - 2), F.lit(" TO "), _pad2(n * 3)).alias("storey_range"),
        (F.col("l_quantity") + 30).alias("floor_area_sqm"),
        _lease_text(F.col("l_orderkey"), F.col("p_size")).alias("remaining_lease"),
        (F.col("l_extendedprice") * 10).alias("resale_price"),
    )


def raw_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend feed records (``month, town, resale_price``)."""
    return raw_transactions(spark, sf_dir).select("month", "town", "resale_price")


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend records as a document store holds them, a JSON line each: by whole price mod 5 the price
    is a number, number text, other text, a number without a town, or null beside a nested note."""
    r = raw_trend(spark, sf_dir).withColumn("p", F.col("resale_price").cast("decimal(18,2)"))
    r = r.withColumn("k", F.floor("resale_price") % 5).withColumn("id", F.uuid())
    number = F.concat(F.lit(', "resale_price": '), F.col("p").cast("string"))
    text = F.concat(F.lit(', "resale_price": "'), F.col("p").cast("string"), F.lit('"'))
    other = F.concat(F.lit(', "resale_price": "S$'), F.col("p").cast("string"), F.lit('"'))
    nothing = F.concat(F.lit(', "resale_price": null, "note": {"asked": '), F.floor("resale_price").cast("string"), F.lit("}"))
    price = F.when(F.col("k").isin(0, 3), number).when(F.col("k") == 1, text).when(F.col("k") == 2, other).otherwise(nothing)
    town = F.when(F.col("k") == 3, "").otherwise(F.concat(F.lit(', "town": "'), F.col("town"), F.lit('"')))
    return r.select(F.concat(F.lit('{"_id": "'), "id", F.lit('", "month": "'), "month", F.lit('"'), town, price, F.lit("}")).alias("value"))


def ratio_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item unit value by return flag: the fixture that has box-plot outliers."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("grp"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("value"),
    )


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest derived from suppliers: loc_info, LATITUDE, LONGITUDE."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("poi_id"),
        F.col("s_name").alias("loc_info"),
        (F.lit(1.2) + (F.col("s_suppkey") % 100).cast("double") * F.lit(0.003)).alias("LATITUDE"),
        (F.lit(103.6) + (F.col("s_suppkey") * 7 % 100).cast("double") * F.lit(0.004)).alias("LONGITUDE"),
    )


def opposite_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of interest and, under negative ids, the points opposite them on the globe."""
    p = supplier_points(spark, sf_dir)
    return p.unionByName(p.select((-1 - F.col("poi_id")).alias("poi_id"), "loc_info", (-F.col("LATITUDE")).alias("LATITUDE"),
                                  (F.col("LONGITUDE") - 180).alias("LONGITUDE")))


def private_sales(txn: DataFrame) -> DataFrame:
    """Private-sale records from clean transactions: month, property_type
    (the flat type), nettPrice, noOfUnit (7 for the 19-21 storeys, a bulk
    sale, else 1)."""
    units = F.when(F.col("floor") == F.lit("19-21"), F.lit(7)).otherwise(F.lit(1))
    return txn.select(
        "month",
        F.col("flat").alias("property_type"),
        F.col("price").alias("nettPrice"),
        units.alias("noOfUnit"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post records derived from parts: post_id, date, published, title, tags."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("post_id"),
        F.date_format(F.date_add(F.lit("2015-01-01").cast("date"),
                                 (F.col("p_partkey") % 3650).cast("int")), "yyyy-MM-dd").alias("date"),
        (F.col("p_size") % 4 != 0).alias("published"),
        F.col("p_name").alias("title"),
        F.split(F.col("p_name"), " ").alias("tags"),
    )


# ---------------------------------------------------------------------------
# SQL text for the DuckDB oracle (same rows as above)
# ---------------------------------------------------------------------------

RAW_TXN_SQL = """
select strftime(l_shipdate, '%Y-%m') as month, n_name as town,
  case when p_type='ECONOMY' then 'EXECUTIVE' when p_type='PROMO' then 'MULTI-GENERATION'
       when p_type='SMALL' then '3 ROOM' when p_type='MEDIUM' then '4 ROOM' else '5 ROOM' end as flat_type,
  cast(p_partkey as varchar) as block, upper(p_name) as street_name,
  concat(lpad(cast(l_linenumber*3-2 as varchar),2,'0'),' TO ',lpad(cast(l_linenumber*3 as varchar),2,'0')) as storey_range,
  l_quantity+30 as floor_area_sqm,
  case when l_orderkey % 12=0 then concat(cast(p_size+45 as varchar),' years')
       when l_orderkey % 12=1 then concat(cast(p_size+45 as varchar),' years 01 month')
       else concat(cast(p_size+45 as varchar),' years ',lpad(cast(l_orderkey % 12 as varchar),2,'0'),' months') end as remaining_lease,
  l_extendedprice*10 as resale_price
from lineitem join part on l_partkey=p_partkey
  join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey
"""

# Clean transactions in SQL (first-match rewrites: DuckDB's regexp_replace
# replaces only the first match unless given the 'g' option).
TXN_SQL = f"""
select month, town,
  regexp_replace(regexp_replace(regexp_replace(flat_type, ' ROOM', 'RM'), 'EXECUTIVE', 'EC'), 'MULTI-GENERATION', 'MG') as flat,
  concat('BLK ', block, ' ', street_name) as street,
  regexp_replace(storey_range, ' TO ', '-') as floor,
  regexp_replace(regexp_replace(regexp_replace(remaining_lease, 's', ''), ' year', 'y'), ' month', 'm') as lease,
  cast(floor_area_sqm as double) as area_sqm,
  cast(floor_area_sqm as double) * 10.7639 as area_sqft,
  cast(resale_price as double) / cast(floor_area_sqm as double) as price_sqm,
  cast(resale_price as double) / (cast(floor_area_sqm as double) * 10.7639) as price_sqft,
  cast(resale_price as double) as price
from ({RAW_TXN_SQL}) r
"""

# What ``stored_documents`` holds: the price as text and the class of each record.
DOCUMENTS_SQL = f"""
select month, town, cast(cast(resale_price as decimal(18, 2)) as double) as resale_price, cast(cast(resale_price as decimal(18, 2)) as varchar) as p,
  cast(floor(resale_price) as bigint) as whole, cast(floor(resale_price) as bigint) % 5 as k
from ({RAW_TXN_SQL}) r
"""

TREND_SQL = f"""
select month, town, cast(resale_price as double) as price, cast(1 as integer) as count,
  case when resale_price is null then null
       when resale_price < 300000 then '0-300k' when resale_price < 500000 then '300-500k'
       when resale_price < 800000 then '500-800k' when resale_price < 1000000 then '800k-1m'
       else '>=1m' end as price_grp,
  case when resale_price is null then null
       when resale_price < 300000 then 0 when resale_price < 500000 then 1
       when resale_price < 800000 then 2 when resale_price < 1000000 then 3
       else 4 end as price_grp_id
from ({RAW_TXN_SQL}) r
"""

RATIO_SQL = """
select l_returnflag as grp, l_extendedprice / l_quantity as value from lineitem
"""

POINTS_SQL = """
select s_suppkey as poi_id, s_name as loc_info,
  cast(1.2 as double) + cast(s_suppkey % 100 as double) * cast(0.003 as double) as LATITUDE,
  cast(103.6 as double) + cast(s_suppkey * 7 % 100 as double) * cast(0.004 as double) as LONGITUDE
from supplier
"""

# The points of interest and, under negative ids, the points opposite them on the globe.
OPPOSITE_SQL = f"""
select * from ({POINTS_SQL}) p
union all select -1 - poi_id, loc_info, -LATITUDE, LONGITUDE - 180 from ({POINTS_SQL}) p
"""

PRIVATE_SQL = f"""
select month, flat as property_type, price as nettPrice,
  case when floor = '19-21' then 7 else 1 end as noOfUnit
from ({TXN_SQL}) t
"""

POSTS_SQL = """
select p_partkey as post_id,
  strftime(date '2015-01-01' + cast(p_partkey % 3650 as integer), '%Y-%m-%d') as date,
  (p_size % 4 <> 0) as published, p_name as title, string_split(p_name, ' ') as tags
from part
"""


class Outage:
    """A fetch that fails for some months, after the first of their records."""

    def __init__(self, fetch, months):
        self.fetch, self.months = fetch, set(months)

    def __call__(self, month, fields, header):
        for record in self.fetch(month, fields, header):
            yield record
            if month in self.months:
                raise ConnectionError(f"lost the answer for {month}")


class Undated:
    """A fetch that gives every record a second time without its month."""

    def __init__(self, fetch):
        self.fetch = fetch

    def __call__(self, month, fields, header):
        for record in self.fetch(month, fields, header):
            yield record
            yield {**record, "month": None}
