"""Query catalogue: every operator run over the stand-in tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` plus, where SQL can say
the same, the DuckDB text that computes the same rows (the oracle).  The
computed columns carry the same names on both sides.  Every query reads the
whole tables; the only limits are the ones that are the feature (a page, a
top-k report, the three most recent posts).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resalelens.functions.numeric import round_half_away
from resalelens.operators import analyses as N
from resalelens.operators import boxstats, clean, facets, geo, robust, search, trends
from resalelens.plans import standin as S
from resalelens.plans.materialize import materialized, table_location, written
from resalelens.schemas import TXN as TXN_SCHEMA
from resalelens.session import scratch_path, ship_package
from resalelens.sources import documents, envelope, history, month_source, months, record_files
from resalelens.sources.tables import read_table, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its oracle SQL (``None``: rows only)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------

def _clean_table(spark: SparkSession, sf_dir: str) -> dict:
    return dict(spark=spark, name="clean_txn", inputs=[table_path(sf_dir, t) for t in S.STANDIN_TABLES],
                build=lambda: S.raw_transactions(spark, sf_dir), finish=clean.clean_transactions,
                schema=TXN_SCHEMA, cluster_by=["town"])


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean transactions, written once per input state as a month-partitioned
    table in the checkpoint folder (see ``plans.materialize``) and read back."""
    return materialized(**_clean_table(spark, sf_dir))


def txn_location(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the month-partitioned clean table (written if needed)."""
    return table_location(**_clean_table(spark, sf_dir))


def trend(spark: SparkSession, sf_dir: str, with_ordinal: bool = False) -> DataFrame:
    """Trend rows from the trend feed (month, town, price as double), a table of its own: written
    once per input state like the clean table, without the texts that no trend reads."""
    feed = materialized(spark, "trend_feed", [table_path(sf_dir, t) for t in S.STANDIN_TABLES],
                        lambda: history.conform(S.raw_trend(spark, sf_dir), history.HISTORY), history.HISTORY)
    return clean.trend_frame(feed, with_ordinal=with_ordinal)


RAW = f"raw as ({S.RAW_TXN_SQL})"
TXN = f"txn as ({S.TXN_SQL})"
TREND = f"trend as ({S.TREND_SQL})"
YEAR = "try_cast(substr(month, 1, 4) as integer)"
LEASE_YEARS = "try_cast(split_part(lease, 'y', 1) as integer)"
MIL = "coalesce(price >= 1000000, false)"


def pct(num: str, den: str, digits: int) -> str:
    """SQL twin of ``functions.numeric.percent``."""
    return f"round(cast(100.0 as double) * ({num}) / nullif(({den}), 0), {digits})"


# Search parameter sets used by the catalogue.
SP1 = search.SearchParams(town="All", flats=["3RM", "4RM", "EC"], area_type="area_sqft",
                          min_area=400, price_type="price", max_price=800000,
                          min_lease=55, max_lease=90, street="bolt|gear")
SP2 = search.SearchParams(town="NATION_7", flats=["5RM", "MG", "3RM"], area_type="area_sqm",
                          max_area=70, price_type="price_area", min_price=5000, max_price=15000,
                          min_lease=60)

SEARCH1 = f"""{TXN},
s0 as (select *, {LEASE_YEARS} as year_count from txn),
s as (select month, town, flat, street, floor, lease,
    round(area_sqft, 2) as area_sqft, round(price_sqft, 2) as price_sqft, round(price, 2) as price,
    year_count,
    coalesce(year_count >= 55, false) as min_lease_flag,
    coalesce(year_count <= 90, false) as max_lease_flag,
    coalesce(flat in ('3RM', '4RM', 'EC'), false) as flat_flag,
    coalesce(regexp_matches(street, 'BOLT|GEAR'), false) as street_flag,
    coalesce(s0.price <= 800000.0, false) as max_price_flag,
    coalesce(s0.area_sqft >= 400.0, false) as min_area_flag
  from s0)"""
ALL1 = "(min_lease_flag and max_lease_flag and flat_flag and street_flag and max_price_flag and min_area_flag)"
COLS1 = "month, town, flat, street, floor, lease, area_sqft, price_sqft, price, year_count"
FLAGS1 = ["min_lease_flag", "max_lease_flag", "flat_flag", "street_flag", "max_price_flag", "min_area_flag"]

SEARCH2 = f"""{TXN},
s0 as (select *, {LEASE_YEARS} as year_count from txn),
s as (select month, town, flat, street, floor, lease,
    round(area_sqm, 2) as area_sqm, round(price_sqm, 2) as price_sqm, round(price, 2) as price,
    year_count,
    coalesce(year_count >= 60, false) as min_lease_flag,
    coalesce(flat in ('5RM', 'MG', '3RM'), false) as flat_flag,
    coalesce(town = 'NATION_7', false) as town_flag,
    coalesce(s0.price_sqm <= 15000.0, false) as max_price_flag,
    coalesce(s0.price_sqm >= 5000.0, false) as min_price_flag,
    coalesce(s0.area_sqm <= 70.0, false) as max_area_flag
  from s0)"""
ALL2 = "(min_lease_flag and flat_flag and town_flag and max_price_flag and min_price_flag and max_area_flag)"
FLAGS2 = ["min_lease_flag", "flat_flag", "town_flag", "max_price_flag", "min_price_flag", "max_area_flag"]


def _bag_sql(cols: str, flags: list[str], extra: str = "") -> str:
    parts = [f"select {cols}{extra}, '{f}' as failed_flag from s where not {f}" for f in flags]
    return "\nunion all\n".join(parts)


# ---------------------------------------------------------------------------
# Clean, months, projections
# ---------------------------------------------------------------------------

@query("clean_transactions", f"with {TXN} select * from txn")
def q_clean_transactions(spark, d):
    # The cleaning pipeline itself, end to end from the source tables.
    return clean.clean_transactions(S.raw_transactions(spark, d))


@query("clean_lease_all_matches", f"""with {RAW}
select regexp_replace(regexp_replace(regexp_replace(remaining_lease, 's', '', 'g'), ' year', 'y', 'g'),
                      ' month', 'm', 'g') as lease, count(*) as n
from raw group by 1""")
def q_clean_lease_all_matches(spark, d):
    t = clean.clean_transactions(S.raw_transactions(spark, d), strict_lease=False)
    return t.groupBy("lease").agg(F.count(F.lit(1)).alias("n"))


@query("month_range", f"""with {TXN},
b as (select cast(min(month) || '-01' as date) as s, cast(max(month) || '-01' as date) as e from txn)
select strftime(m, '%Y-%m') as month from b, unnest(generate_series(s, e, interval 1 month)) as t(m)""")
def q_month_range(spark, d):
    t = txn(spark, d)
    bounds = t.agg(F.to_date(F.concat(F.min("month"), F.lit("-01"))).alias("start"),
                   F.to_date(F.concat(F.max("month"), F.lit("-01"))).alias("end"))
    return months.month_range(bounds)


RECENT_SQL = """recent as (
  select strftime(date_trunc('month', as_of) - to_months(cast(i as integer)), '%Y-%m') as month
  from (select as_of, case when day(as_of) <= 10 then 7 else 6 end as k
        from (select max(l_shipdate) as as_of from lineitem) a) b, range(0, k) t(i))"""


def _recent(spark, d):
    anchor = read_table(spark, d, "lineitem").agg(F.max("l_shipdate").alias("as_of"))
    return months.recent_months(anchor)


@query("recent_months", f"with {RECENT_SQL} select month from recent")
def q_recent_months(spark, d):
    return _recent(spark, d)


@query("month_filter", f"""with {TXN}, {RECENT_SQL}
select * from txn where month in (select month from recent) and month >= '2001-06'""")
def q_month_filter(spark, d):
    t = months.semi_filter_months(txn(spark, d), _recent(spark, d))
    return months.filter_months(t, from_month="2001-06")


@query("literal_rename_drop", f"""with {RAW}
select month, resale_price as price, cast(1 as integer) as count from raw""")
def q_literal_rename_drop(spark, d):
    raw = S.raw_trend(spark, d)
    return (raw.withColumnsRenamed({"resale_price": "price"})
            .withColumn("count", F.lit(1)).drop("town"))


@query("positional_rename", f"""with {RAW}
select month, block, town, flat_type as flat, street_name as street, storey_range as floor,
  floor_area_sqm as area_sqm, remaining_lease as lease_mths, resale_price as price from raw""")
def q_positional_rename(spark, d):
    raw = S.raw_transactions(spark, d).select(
        "month", "block", "town", "flat_type", "street_name", "storey_range",
        "floor_area_sqm", "remaining_lease", "resale_price")
    return clean.rename_positional(raw, ["month", "block", "town", "flat", "street", "floor",
                                         "area_sqm", "lease_mths", "price"])


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------

@query("search_flags", f"with {SEARCH1} select * from s")
def q_search_flags(spark, d):
    return search.search(txn(spark, d), SP1)


@query("search_selected", f"with {SEARCH1} select {COLS1} from s where {ALL1}")
def q_search_selected(spark, d):
    return search.select_rows(txn(spark, d), SP1)


@query("search_selected_unit", f"""with {SEARCH2}
select month, town, flat, street, floor, lease, area_sqm, price_sqm, price, year_count from s where {ALL2}""")
def q_search_selected_unit(spark, d):
    # the flag route (search -> selected), checked against the same SQL
    return search.selected(search.search(txn(spark, d), SP2))


@query("rest_of_market_bag", f"with {SEARCH1}\n" + _bag_sql(COLS1, FLAGS1))
def q_rest_of_market_bag(spark, d):
    return search.rest_bag(search.search(txn(spark, d), SP1))


@query("rest_of_market_set", f"with {SEARCH1} select {COLS1} from s where not {ALL1}")
def q_rest_of_market_set(spark, d):
    return search.rest_set(search.search(txn(spark, d), SP1))


@query("scatter_price_unit", f"""with {SEARCH1}
select 'selected' as series, price, price_sqft, year_count, town, street, area_sqft from s where {ALL1}
union all
""" + "\nunion all\n".join(
    f"select 'rest' as series, price, price_sqft, year_count, town, street, area_sqft from s where not {f}"
    for f in FLAGS1))
def q_scatter_price_unit(spark, d):
    return search.scatter_price_unit(search.search(txn(spark, d), SP1), SP1)


@query("scatter_price_lease", f"""with {SEARCH2}
select 'selected' as series, price_sqm as measure, year_count, price, price_sqm as unit_price, town, street,
  area_sqm as area from s where {ALL2}
union all
""" + "\nunion all\n".join(
    f"select 'rest' as series, price_sqm as measure, year_count, price, price_sqm as unit_price, town, street, "
    f"area_sqm as area from s where not {f}" for f in FLAGS2))
def q_scatter_price_lease(spark, d):
    return search.scatter_price_lease(search.search(txn(spark, d), SP2), SP2)


@query("search_summary", f"""with {SEARCH1}
select count(*) as records, min(price) as price_min, max(price) as price_max,
  min(area_sqft) as area_min, max(area_sqft) as area_max from s where {ALL1}""")
def q_search_summary(spark, d):
    return search.summary(search.select_rows(txn(spark, d), SP1), SP1)


def _grouped(c: str) -> str:
    """SQL twin of ``functions.text.grouped_number``."""
    return "regexp_replace(format('{:,.2f}', " + c + "), '0$', '')"


@query("summary_text", f"""with {SEARCH2},
a as (select count(*) as records, min(price_sqm) as pmin, max(price_sqm) as pmax,
        min(area_sqm) as amin, max(area_sqm) as amax from s where {ALL2})
select records, case when records > 0 then
  'You searched : Town: NATION_7 | Price / sqm: $' || {_grouped('pmin')} || ' - $' || {_grouped('pmax')}
  || ' | area_sqm: ' || {_grouped('amin')} || ' - ' || {_grouped('amax')}
  || ' | Lease >= 60 | Total records: ' || format('{{:,}}', records)
  else '<< YOUR SEARCH HAS NO RESULTS >>' end as text from a""")
def q_summary_text(spark, d):
    return search.summary_text(search.select_rows(txn(spark, d), SP2), SP2)


@query("page_of_results", f"""with {SEARCH1}
select {COLS1} from s where {ALL1}
order by price desc nulls last, month, town, flat, street, floor, lease, area_sqft, price_sqft, year_count
limit 20 offset 20""")
def q_page_of_results(spark, d):
    return search.page(search.select_rows(txn(spark, d), SP1), "price",
                       ascending=False, offset=20, size=20)


@query("deep_page_of_results", f"""with {TXN}
select * from txn order by price desc nulls last, month nulls first, town nulls first, flat nulls first, street nulls first, floor nulls first,
  lease nulls first, area_sqm nulls first, area_sqft nulls first, price_sqm nulls first, price_sqft nulls first
limit 20 offset (select 7 * count(*) // 10 from txn)""")
def q_deep_page_of_results(spark, d):
    t = txn(spark, d).select("month", "town", "flat", "street", "floor", "lease", "area_sqm", "area_sqft", "price_sqm", "price_sqft", "price")
    return search.page(t, "price", ascending=False, offset=7 * t.count() // 10, size=20)


@query("global_min_max", f"""with {TXN}
select min(price) as price_min, max(price) as price_max, min(area_sqft) as area_min,
  max(area_sqft) as area_max from txn""")
def q_global_min_max(spark, d):
    return search.global_min_max(txn(spark, d))


# ---------------------------------------------------------------------------
# Trends
# ---------------------------------------------------------------------------

@query("price_bins", f"with {TREND} select month, town, price, count, price_grp from trend")
def q_price_bins(spark, d):
    return trend(spark, d)


@query("median_by_month", f"""with {TREND}
select month, quantile_cont(price, 0.5) as median_price from trend group by month""")
def q_median_by_month(spark, d):
    return trends.median_by_month(trend(spark, d))


@query("high_median_months", f"""with {TREND}
select month, median_price from (select month, quantile_cont(price, 0.5) as median_price
  from trend group by month) m where median_price >= 500000""")
def q_high_median_months(spark, d):
    return trends.high_median_months(trend(spark, d))


@query("month_rows_flagged", f"""with {TREND},
m as (select month, case when quantile_cont(price, 0.5) >= 500000 then 1 else 0 end as price_bar
      from trend group by month)
select t.month, town, price, count, price_grp, price_bar from trend t left join m on t.month = m.month""")
def q_month_rows_flagged(spark, d):
    return trends.rows_with_median_mark(trend(spark, d))


@query("million_table", f"""with {TREND},
a as (select month, count(town) filter (where not {MIL}) as "0",
        count(town) filter (where {MIL}) as "million $ Trans" from trend group by month)
select month, "0", "million $ Trans", "0" + "million $ Trans" as "Total Trans",
  {pct('"million $ Trans"', '"0" + "million $ Trans"', 2)} as "% million Trans" from a""")
def q_million_table(spark, d):
    return trends.million_table(trend(spark, d))


@query("million_share", f"""with {TREND}
select month, town, mil, {pct('mil', 'town', 2)} as p_mil from (
  select month, count(town) as town,
    cast(sum(case when price >= 1000000 then 1 else 0 end) as bigint) as mil
  from trend where month >= '1996-01' group by month) a""")
def q_million_share(spark, d):
    return trends.million_share(trend(spark, d), from_month="1996-01")


@query("group_counts", f"""with {TREND}
select month, price_grp, cast(sum(count) as bigint) as count from trend group by month, price_grp""")
def q_group_counts(spark, d):
    return trends.group_counts(trend(spark, d))


@query("month_counts", f"""with {TREND}
select month, cast(sum(count) as bigint) as count from trend group by month""")
def q_month_counts(spark, d):
    return trends.month_counts(trend(spark, d))


GROUP_SHARE_SQL = f"""with {TREND}
select month, price_grp, count, total, {pct('count', 'total', 1)} as pct
from (select month, price_grp, cast(sum(count) as bigint) as count,
             cast(sum(sum(count)) over (partition by month) as bigint) as total
      from trend where month is not null group by month, price_grp) g"""


@query("group_share", GROUP_SHARE_SQL)
def q_group_share(spark, d):
    return trends.group_share(trend(spark, d))


@query("group_share_join", GROUP_SHARE_SQL)
def q_group_share_join(spark, d):
    return trends.group_share_join(trend(spark, d))


@query("below_above_500k", f"""with {TREND}
select month, below, at_or_above, {pct('below', 'below + at_or_above', 1)} as pct_below from (
  select month, count(*) filter (where price < 500000) as below,
    count(*) filter (where not (price < 500000)) as at_or_above from trend group by month) a""")
def q_below_above_500k(spark, d):
    return trends.counts_below_from(trend(spark, d))


@query("million_count", f"""with {TREND}
select count(*) filter (where price >= 1000000) as million_count from trend""")
def q_million_count(spark, d):
    return trends.million_count(trend(spark, d))


@query("global_median", f"with {TREND} select quantile_cont(price, 0.5) as median_price from trend")
def q_global_median(spark, d):
    return trends.global_median(trend(spark, d))


# ---------------------------------------------------------------------------
# Facets
# ---------------------------------------------------------------------------

@query("facets_town", f"""with {TXN}
select 'All' as town, cast(0 as integer) as pos
union all
select town, cast(row_number() over (order by town) as integer) as pos
from (select distinct town from txn where town is not null) t""")
def q_facets_town(spark, d):
    return facets.town_facets(txn(spark, d))


@query("facets_month", f"""with {TXN}
select month, cast(row_number() over (order by month) as integer) as pos
from (select distinct month from txn where month is not null) t""")
def q_facets_month(spark, d):
    return facets.month_facets(txn(spark, d))


@query("facets_bin", f"""with {TREND}
select distinct price_grp_id, price_grp from trend where price_grp is not null""")
def q_facets_bin(spark, d):
    return facets.bin_facets(trend(spark, d, with_ordinal=True))


# ---------------------------------------------------------------------------
# Box statistics and percentile cutoffs
# ---------------------------------------------------------------------------

def box_sql(src: str, value: str, groups: list[str], digits: int = 4) -> str:
    g = ", ".join(groups)
    on = " and ".join(f"r.{c} = f.{c}" for c in groups)
    rg = ", ".join(f"r.{c}" for c in groups)
    rd = [f"round({c}, {digits}) as {c}" for c in
          ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "lower_whisker", "upper_whisker"]]
    return f"""r as ({src}),
q as (select {g}, count({value}) as n, quantile_cont({value}, 0.25) as q1,
        quantile_cont({value}, 0.5) as median, quantile_cont({value}, 0.75) as q3
      from r group by {g}),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from q),
w as (select {rg},
        min(r.{value}) filter (where r.{value} between lower_fence and upper_fence) as lower_whisker,
        max(r.{value}) filter (where r.{value} between lower_fence and upper_fence) as upper_whisker,
        count(*) filter (where not (r.{value} between lower_fence and upper_fence)) as n_outliers
      from r join f on {on} where r.{value} is not null group by {rg}),
b as (select f.*, w.lower_whisker, w.upper_whisker, coalesce(w.n_outliers, 0) as n_outliers
      from f left join w using ({g}))
select {g}, n, {", ".join(rd)}, n_outliers from b"""


@query("box_stats", "with " + box_sql(S.RATIO_SQL, "value", ["grp"]))
def q_box_stats(spark, d):
    return boxstats.box_stats(S.ratio_values(spark, d), "value", ["grp"], digits=4)


def _hazen(p: float) -> str:
    at = f"greatest(1, least(len(l), len(l) * {p} + 0.5))"
    return f"l[floor({at})::int] + ({at} - floor({at})) * (l[ceil({at})::int] - l[floor({at})::int])"


@query("quartiles_hazen", f"""with r as ({S.RATIO_SQL}), a as (select grp, list(value order by value) as l from r where value is not null group by grp)
select grp, round({_hazen(0.25)}, 4) as q1, round({_hazen(0.5)}, 4) as median, round({_hazen(0.75)}, 4) as q3 from a""")
def q_quartiles_hazen(spark, d):
    box = boxstats.box_stats(S.ratio_values(spark, d), "value", ["grp"], digits=4, definition="hazen")
    return box.select("grp", "q1", "median", "q3")


#: Group N has only null values: it is kept, with n = 0 and no quartiles.
_GAPS_SQL = """select l_returnflag as grp, case when l_returnflag <> 'N' and l_linenumber > 2 then l_quantity end as value from lineitem"""


@query("box_stats_null_groups", "with " + box_sql(_GAPS_SQL, "value", ["grp"]))
def q_box_stats_null_groups(spark, d):
    gaps = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.when(
        (F.col("l_returnflag") != "N") & (F.col("l_linenumber") > 2), F.col("l_quantity")).alias("value"))
    return boxstats.box_stats(gaps, "value", ["grp"], digits=4)


@query("box_outliers", f"""with r as ({S.RATIO_SQL}),
q as (select grp, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from r group by grp)
select r.grp, r.value from r join q on r.grp = q.grp
where r.value < q1 - 1.5 * (q3 - q1) or r.value > q3 + 1.5 * (q3 - q1)""")
def q_box_outliers(spark, d):
    return boxstats.outliers(S.ratio_values(spark, d), "value", ["grp"])


@query("p10_cutoff", f"""with {TREND}
select month, round(quantile_cont(price, 0.1), 4) as cutoff from trend group by month""")
def q_p10_cutoff(spark, d):
    c = boxstats.cutoff(trend(spark, d), "price", ["month"], 0.1)
    return c.select("month", round_half_away("cutoff", 4).alias("cutoff"))


P10_ROWS = f"""{TREND},
c as (select month, quantile_cont(price, 0.1) as cutoff from trend group by month),
p as (select t.month, town, price, count, price_grp, cutoff from trend t join c on t.month = c.month
      where price <= cutoff)"""


@query("p10_rows", f"with {P10_ROWS} select month, town, price, round(cutoff, 4) as cutoff from p")
def q_p10_rows(spark, d):
    rows = N.lowest_decile_rows(trend(spark, d))
    return rows.select("month", "town", "price", round_half_away("cutoff", 4).alias("cutoff"))


@query("p10_box", f"with {P10_ROWS}, " + box_sql("select month, price from p", "price", ["month"]))
def q_p10_box(spark, d):
    return N.lowest_decile_box(trend(spark, d), digits=4)


@query("lease_box_by_town", f"with {TXN}, " + box_sql(
    f"select town, cast({LEASE_YEARS} as double) as year_count from txn where {MIL}", "year_count", ["town"]))
def q_lease_box_by_town(spark, d):
    return N.lease_box_by_town(txn(spark, d), digits=4)


@query("type_month_box", "with " + box_sql(S.PRIVATE_SQL, "nettPrice", ["property_type", "month"]))
def q_type_month_box(spark, d):
    return N.type_month_box(S.private_sales(txn(spark, d)), digits=4)


# ---------------------------------------------------------------------------
# Published analyses
# ---------------------------------------------------------------------------

MIL_BY_MONTH = f"""{TREND},
pm as (select month, count(*) filter (where {MIL}) as million,
         count(*) filter (where not {MIL}) as rest from trend group by month)"""


@query("monthly_million_periods", f"""with {MIL_BY_MONTH}
select month, 'before' as period, million from pm where month <= '1998-06'
union all
select month, 'after' as period, million from pm where month >= '1998-06'""")
def q_monthly_million_periods(spark, d):
    return N.monthly_million_periods(trend(spark, d), "1998-06")


@query("million_percent_rest", f"""with {MIL_BY_MONTH}
select month, million, rest, {pct('million', 'million + rest', 2)} as pct from pm""")
def q_million_percent_rest(spark, d):
    return N.million_percent_rest(trend(spark, d))


@query("record_months", f"""with {MIL_BY_MONTH}
select month, million, prev_max, (prev_max is null or million > prev_max) as is_record from (
  select month, million, max(million) over (order by month rows between unbounded preceding and 1 preceding)
    as prev_max from pm) a""")
def q_record_months(spark, d):
    return N.record_months(trend(spark, d))


@query("half_year_share", f"""with {TREND}
select year, half, count, million, {pct('million', 'count', 2)} as pct from (
  select {YEAR} as year, case when substr(month, 6, 2) <= '06' then 'H1' else 'H2' end as half,
    count(*) as count, count(*) filter (where {MIL}) as million
  from trend where month is not null group by 1, 2) a""")
def q_half_year_share(spark, d):
    return N.half_year_share(trend(spark, d))


@query("town_year_crosstab", f"""with {TREND},
m as (select town, cast({YEAR} as varchar) as year from trend where {MIL}),
c as (select case when grouping(town) = 1 then 'All' else town end as town,
        case when grouping(year) = 1 then 'All' else year end as year,
        count(*) as count, grouping(year) as gy
      from m group by cube(town, year))
select town, year, count, max(case when gy = 1 then count end) over (partition by town) as town_total from c""")
def q_town_year_crosstab(spark, d):
    return N.town_year_crosstab(trend(spark, d))


YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


@query("town_year_crosstab_wide", f"""with {TREND},
m as (select town, cast({YEAR} as varchar) as year from trend where {MIL}),
c as (select case when grouping(town) = 1 then 'All' else town end as town,
        case when grouping(year) = 1 then 'All' else year end as year,
        count(*) as count, grouping(year) as gy
      from m group by cube(town, year)),
l as (select town, year, count, max(case when gy = 1 then count end) over (partition by town) as town_total from c)
select town, town_total,
""" + ",\n".join(f"  max(count) filter (where year = '{y}') as \"{y}\"" for y in YEARS) + """,
  max(count) filter (where year = 'All') as "All"
from l group by town, town_total""")
def q_town_year_crosstab_wide(spark, d):
    # The published table: towns x years with margins, explicit year columns.
    return N.crosstab_wide(N.town_year_crosstab(trend(spark, d)), [str(y) for y in YEARS])


@query("town_year_crosstab_by_data", f"""with {TREND},
m as (select town, cast({YEAR} as varchar) as year from trend where {MIL}),
l as (select coalesce(town, '-') as town, year, count(*) as n from m group by town, year)
select town, max(n) as most, count(*) as years, sum(n)::bigint as town_total from l group by town""")
def q_town_year_crosstab_by_data(spark, d):
    # Read from the wide table: its year columns come from the data.
    wide = N.crosstab_wide(N.town_year_crosstab(trend(spark, d)))
    years = [F.col(c) for c in wide.columns if c not in ("town", "town_total", "All")]
    return wide.where("town != 'All'").select(
        "town", F.greatest(*years).alias("most"), F.size(F.array_compact(F.array(*years))).cast("long").alias("years"),
        F.col("All").alias("town_total"))


TOWN_YEAR = f"""{TREND},
ty as (select town, {YEAR} as year, count(*) as count from trend where {MIL} group by 1, 2)"""


@query("town_year_change", f"""with {TOWN_YEAR}
select town, year, count, lag(count) over (partition by town order by year) as prev_count,
  count - lag(count) over (partition by town order by year) as change from ty""")
def q_town_year_change(spark, d):
    return N.town_year_change(trend(spark, d))


@query("first_million_year", f"""with {TREND}
select town, min({YEAR}) as first_year from trend where {MIL} group by town""")
def q_first_million_year(spark, d):
    return N.first_million_year(trend(spark, d))


@query("lease_price_years", f"""with {TXN}
select {YEAR} as year, month, {LEASE_YEARS} as year_count, price from txn
where {YEAR} in (1995, 1998, 2001)""")
def q_lease_price_years(spark, d):
    return N.lease_price_years(txn(spark, d), [1995, 1998, 2001])


@query("lease_budget_grid", f"""with {TXN},
t as (select {YEAR} as year, {LEASE_YEARS} as year_count, price from txn),
g as (select * from (values (35, cast(300000 as double)), (35, cast(350000 as double)),
                            (40, cast(300000 as double)), (40, cast(350000 as double))) v(age, budget))
select year, age, budget, 95 - age as min_lease, matches, total, {pct('matches', 'total', 2)} as pct from (
  select year, age, budget, count(*) filter (where year_count >= 95 - age and price <= budget) as matches,
    count(*) as total from t, g group by year, age, budget) a""")
def q_lease_budget_grid(spark, d):
    return N.lease_budget_grid(txn(spark, d), [35, 40], [300000, 350000])


@query("lease_unit_corr", f"""with {TXN}, t as (select *, {LEASE_YEARS} as year_count from txn)
select round(corr(area_sqft, price), 6) as corr_area_price,
  round(corr(year_count, price_sqft), 6) as corr_lease_psf,
  round(regr_slope(price_sqft, year_count), 6) as slope_psf_lease,
  round(regr_intercept(price_sqft, year_count), 6) as intercept_psf_lease from t""")
def q_lease_unit_corr(spark, d):
    return N.lease_unit_corr(txn(spark, d))


@query("unit_price_range", f"""with {TXN}, t as (select *, {LEASE_YEARS} as year_count from txn where {MIL})
select round(min(price_sqft), 2) as psf_min, round(max(price_sqft), 2) as psf_max,
  round(min(price_sqft) filter (where year_count >= 85), 2) as psf_min_newer,
  round(max(price_sqft) filter (where year_count >= 85), 2) as psf_max_newer from t""")
def q_unit_price_range(spark, d):
    return N.unit_price_range(txn(spark, d))


@query("storey_share", f"""with {TXN},
a as (select floor, count(*) as n from txn where {MIL} group by floor)
select floor, try_cast(split_part(floor, '-', 1) as integer) as storey_low, n,
  {pct('n', 'sum(n) over ()', 2)} as pct,
  coalesce(try_cast(split_part(floor, '-', 1) as integer) >= 10, false) as high_floor from a""")
def q_storey_share(spark, d):
    return N.storey_share(txn(spark, d))


@query("high_storey_share", f"""with {TXN},
a as (select count(*) as n, count(*) filter (where try_cast(split_part(floor, '-', 1) as integer) > 10) as n_high
  from txn where {MIL})
select n, n_high, {pct('n_high', 'n', 2)} as pct from a""")
def q_high_storey_share(spark, d):
    return N.high_storey_share(txn(spark, d))


@query("min_area_million", f"""with {TXN}
select round(min(area_sqft), 2) as min_area_sqft from txn where {MIL}""")
def q_min_area_million(spark, d):
    return N.min_area_million(txn(spark, d))


@query("top_price_extremes", f"""with {TXN}, t as (select *, {LEASE_YEARS} as year_count from txn)
select price, month, town, street, flat, floor, lease, year_count, area_sqft, price_sqft from t
where price >= 1000000
order by price desc, month, town, street, flat, floor, lease, year_count, area_sqft, price_sqft""")
def q_top_price_extremes(spark, d):
    return N.top_sales(txn(spark, d), 1000000)


@query("price_extremes", f"""with {TXN}, t as (select *, {LEASE_YEARS} as year_count from txn where price >= 1000000),
a as (select min({{'k': price_sqft, 's': street}}) as a, max({{'k': area_sqft, 's': street}}) as b,
        min({{'k': year_count, 's': street}}) as c, count(*) as n from t)
select n, round(a.k, 2) as min_psf, a.s as min_psf_street, round(b.k, 2) as max_area,
  b.s as max_area_street, c.k as min_lease, c.s as min_lease_street from a""")
def q_price_extremes(spark, d):
    return N.price_extremes(txn(spark, d), 1000000)


@query("same_street", f"with {TXN} select * from txn where regexp_matches(street, 'RED BOLT')")
def q_same_street(spark, d):
    return N.same_street(txn(spark, d), "red bolt")


@query("trend_residual_outliers", f"""with {TXN},
t as (select * from txn where price_sqft is not null and price is not null),
c as (select regr_slope(price, price_sqft) as b, regr_intercept(price, price_sqft) as a from t),
r as (select t.*, c.a + c.b * price_sqft as fit, price - (c.a + c.b * price_sqft) as res from t, c),
m as (select avg(res) as mu, stddev_samp(res) as sd from r)
select month, town, street, price, price_sqft, round(fit, 2) as fitted, round(res, 2) as residual,
  round((res - mu) / sd, 4) as z from r, m where abs((res - mu) / sd) >= 2.5""")
def q_trend_residual_outliers(spark, d):
    return N.residual_outliers(txn(spark, d), z_min=2.5)


def _robust_sql() -> str:
    cut, to_scale = robust.CUT, robust.MEDIAN_TO_SCALE
    return f"""recursive {TXN},
t as (select price_sqft as x, price as y from txn where price_sqft is not null and price is not null),
c as (select quantile_cont(x, 1 / 3.0::double) as lo, quantile_cont(x, 2 / 3.0::double) as hi, avg(x) as mx from t),
s as (select median(x) filter (x <= lo) as x0, median(y) filter (x <= lo) as y0,
    median(x) filter (x >= hi) as x2, median(y) filter (x >= hi) as y2 from t, c),
b as (select (y2 - y0) / (x2 - x0) as b0 from s),
a as (select median(y - b0 * x) as a0 from t, b),
sc as (select {to_scale!r}::double * median(abs(y - a0 - b0 * x)) as s0 from t, a, b),
z as (select x - mx as x, y from t, c),
it as (select 0 as i, a0 + b0 * mx as a, b0 as b, false as done from a, b, c
  union all
  select i + 1, (sy - nb * sx) / sw, nb, abs((sy - nb * sx) / sw - a) <= {robust.STOP!r} * abs((sy - nb * sx) / sw) and abs(nb - b) <= {robust.STOP!r} * abs(nb)
  from (select i, a, b, sw, sx, sy, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) as nb from (
    select i, a, b, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from (
      select i, a, b, x, y, case when abs(y - a - b * x) < {cut!r} * s0 then pow(1 - pow((y - a - b * x) / ({cut!r} * s0), 2), 2) else 0 end as w
      from z, it, sc where i < {robust.ROUNDS} and not done) group by i, a, b))),
f as (select a - b * mx as a, b from it, c where i = (select max(i) from it)),
fs as (select a, b, {to_scale!r}::double * (select median(abs(y - a - b * x)) from t) as sd from f)"""


@query("trend_robust_outliers", f"""with {_robust_sql()}
select month, town, street, price, price_sqft, round(a + b * price_sqft, 2) as fitted,
  round(price - (a + b * price_sqft), 2) as residual, round((price - (a + b * price_sqft)) / sd, 4) as z
from txn, fs where abs((price - (a + b * price_sqft)) / sd) >= 2.5""")
def q_trend_robust_outliers(spark, d):
    return robust.robust_outliers(txn(spark, d), z_min=2.5).select("month", "town", "street", "price", "price_sqft", "fitted", "residual", "z")


@query("bulk_sales", f"""with p as ({S.PRIVATE_SQL})
select month, property_type, nettPrice, noOfUnit, noOfUnit > 1 as is_bulk,
  nettPrice / cast(noOfUnit as double) as unit_price from p""")
def q_bulk_sales(spark, d):
    return N.bulk_sales(S.private_sales(txn(spark, d)))


@query("single_unit_sales", f"""with p as ({S.PRIVATE_SQL})
select month, property_type, nettPrice, noOfUnit from p where noOfUnit <= 1""")
def q_single_unit_sales(spark, d):
    return N.drop_bulk(S.private_sales(txn(spark, d)))


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

@query("union_history_recent", f"""with {RAW}
select month, town, resale_price from raw where month <= '1998-12'
union all
select month, town, resale_price from raw where month >= '1998-10'""")
def q_union_history_recent(spark, d):
    raw = S.raw_trend(spark, d)
    hist = raw.where(F.col("month") <= "1998-12")
    recent = raw.where(F.col("month") >= "1998-10").withColumn(
        "resale_price", F.col("resale_price").cast("string"))
    return history.union_history_recent(hist, recent)


@query("history_scan", f"""with {RAW}
select month, town, cast(resale_price as double) as resale_price from raw""")
def q_history_scan(spark, d):
    # Stored documents carry the store's _id; the freshly asked month has no records.
    path = written(spark, "history", [table_path(d, t) for t in S.STANDIN_TABLES],
                   lambda p: S.raw_trend(spark, d).withColumn("_id", F.uuid()).write.parquet(p))
    return history.union_history_recent(history.read_history(spark, path),
                                        history.empty_frame(spark, history.HISTORY))


#: A compressed file is read by one task.
DOCUMENTS_A_FILE = 500_000


def document_files(spark: SparkSession, d: str) -> str:
    """Stored documents of mixed types as JSON lines, written once per input state."""
    return written(spark, "documents", [table_path(d, t) for t in S.STANDIN_TABLES],
                   lambda path: S.stored_documents(spark, d).write.option("compression", "gzip")
                   .option("maxRecordsPerFile", DOCUMENTS_A_FILE).text(path))


@query("history_documents", f"""with r as ({S.DOCUMENTS_SQL})
select month, case when k <> 3 then town end as town, case when k in (0, 1, 3) then resale_price end as resale_price,
  case when k = 2 then '"S$' || p || '"' end as unparsed from r""")
def q_history_documents(spark, d):
    docs = documents.read_documents(spark, document_files(spark, d))
    return documents.typed(docs, history.HISTORY).select(
        "month", "town", "resale_price", F.col("rest")["resale_price"].alias("unparsed"))


@query("history_document_types", f"""with r as ({S.DOCUMENTS_SQL}),
t as (select 'month' as field, 'text' as type from r
  union all select 'town', 'text' from r where k <> 3
  union all select 'note', 'object' from r where k = 4
  union all select 'resale_price', case when k in (0, 3) then 'double' when k = 4 then 'null' else 'text' end from r)
select field, type, count(*) as n from t group by field, type""")
def q_history_document_types(spark, d):
    return documents.observed_types(documents.read_documents(spark, document_files(spark, d)))


@query("history_documents_relaxed", f"""with r as ({S.DOCUMENTS_SQL}),
e as (select month, town, cast(floor(resale_price) as bigint) as whole, resale_price from r where month >= '1998-10')
select month, case when k <> 3 then town end as town,
  case when k in (0, 3) then regexp_replace(regexp_replace(p, '0+$', ''), '[.]$', '') when k = 1 then p
    when k = 2 then 'S$' || p end as resale_price,
  case when k = 4 then '{{"asked":' || whole || '}}' end as note from r
union all select month, town, cast(whole as varchar), null from e""")
def q_history_documents_relaxed(spark, d):
    # History with the types found in it, and recent months whose price is a whole number.
    docs = documents.read_documents(spark, document_files(spark, d))
    hist = documents.typed(docs, documents.widened_schema(docs), rest=None)
    recent = S.raw_trend(spark, d).where(F.col("month") >= "1998-10").withColumn("resale_price", F.floor("resale_price"))
    return documents.relaxed_union(hist, recent)


@query("records_json", """
select cast(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) as varchar) as record from events""")
def q_records_json(spark, d):
    return envelope.records_json(read_table(spark, d, "events").select("event_id", "user_id", "event_type"))


@query("json_field_exists", """
select event_id, json_extract_string(props, '$.k') as k from events
where list_contains(json_keys(props), 'k')""")
def q_json_field_exists(spark, d):
    return history.json_fields_exist(read_table(spark, d, "events"), "props", "k", keep=["event_id"])


@query("project_spec", "select event_id, user_id, event_type from events")
def q_project_spec(spark, d):
    return history.select_spec(read_table(spark, d, "events"), "event_id, user_id ,event_type")


def envelope_files(spark: SparkSession, d: str) -> str:
    """Raw records as month-partitioned JSON envelopes (the API-style input
    of the S1/S2 readers), written once per input state."""
    return written(spark, "envelopes", [table_path(d, t) for t in S.STANDIN_TABLES],
                   lambda path: envelope.write_envelopes(S.raw_transactions(spark, d), path))


@query("envelope_scan", f"with {TXN} select * from txn")
def q_envelope_scan(spark, d):
    return clean.clean_transactions(envelope.read_envelopes(spark, envelope_files(spark, d)))


def _pages(spark: SparkSession, d: str, required: dict | None = None) -> month_source.StoredPages:
    return month_source.StoredPages(spark, envelope_files(spark, d), required)


@query("month_source", f"with {TXN} select * from txn")
def q_month_source(spark, d):
    pages = _pages(spark, d)
    return clean.clean_transactions(month_source.read_month_source(spark, pages, pages.months()))


@query("month_source_pruned", f"""with {TXN}
select * from txn where month in ('1995-03', '1998-07', '2001-11')""")
def q_month_source_pruned(spark, d):
    # Three requests; a month the store does not know has no records.
    asked = ["1995-03", "1998-07", "2001-11", "1900-01"]
    return clean.clean_transactions(month_source.read_month_source(spark, _pages(spark, d), asked))


@query("month_source_in_filter", f"""with {TXN}
select * from txn where month in ('1995-03', '1998-07', '2001-11')""")
def q_month_source_in_filter(spark, d):
    # Every record comes a second time without a month: null is not IN the list.
    pages = _pages(spark, d)
    src = month_source.read_month_source(spark, S.Undated(pages), pages.months())
    return clean.clean_transactions(src.where(F.col("month").isin("1995-03", "1998-07", "2001-11")))


@query("month_source_limit", f"""with {RAW}
select month, least(count(*), 5) as n from raw group by month""")
def q_month_source_limit(spark, d):
    pages = _pages(spark, d)
    return (month_source.read_month_source(spark, pages, pages.months(), fields=["month", "town"], limit=5)
            .groupBy("month").agg(F.count("*").alias("n")))


@query("month_source_header", f"""with {RAW}
select month, town, count(*) as n from raw group by month, town""")
def q_month_source_header(spark, d):
    # The store refuses requests without the key.
    pages = _pages(spark, d, required={"x-api-key": "k1"})
    return (month_source.read_month_source(spark, pages, pages.months(), fields=["month", "town"], header={"x-api-key": "k1"})
            .groupBy("month", "town").agg(F.count("*").alias("n")))


@query("month_source_skip", f"""with {TXN}
select * from txn where month not in ('1995-03', '1998-07', '2001-11')""")
def q_month_source_skip(spark, d):
    pages = _pages(spark, d)
    lost = S.Outage(pages, ["1995-03", "1998-07", "2001-11"])
    return clean.clean_transactions(month_source.read_month_source(spark, lost, pages.months(), on_error="skip"))


@query("month_source_paged", f"with {TXN} select * from txn")
def q_month_source_paged(spark, d):
    # The store answers at most 100 records a call and names the next page.
    pages = _pages(spark, d)
    return clean.clean_transactions(month_source.read_month_source(spark, month_source.CursorPages(pages.page), pages.months()))


@query("month_source_report", f"""with {RAW}
select month, count(*) as n, month in ('1995-03', '1998-07', '2001-11') as failed from raw group by month""")
def q_month_source_report(spark, d):
    # The report of a load that leaves three months out, beside the counts of the others.
    pages = _pages(spark, d)
    lost = ["1995-03", "1998-07", "2001-11"]
    rows, failed = month_source.request_months(spark, S.Outage(pages, lost), pages.months(), fields=["month"])
    whole = month_source.read_month_source(spark, pages, lost, fields=["month"])
    marks = failed.select("month").distinct().withColumn("failed", F.lit(True))
    return (rows.unionByName(whole).groupBy("month").agg(F.count("*").alias("n")).join(marks, "month", "left")
            .select("month", "n", F.coalesce("failed", F.lit(False)).alias("failed")))


@query("stored_months_pruned", f"""with {TXN}
select * from txn where month in ('1995-03', '1998-07', '2001-11')""")
def q_stored_months_pruned(spark, d):
    # S2's stored-data form: a month-partitioned parquet table; the month
    # list becomes a partition filter, only three folders are read.
    df = month_source.read_months(spark, txn_location(spark, d),
                                  months=["1995-03", "1998-07", "2001-11"])
    return df.select(*TXN_SCHEMA.fieldNames())


@query("records_sink", f"with {TXN} select * from txn")
def q_records_sink(spark, d):
    path = scratch_path(spark, "records")
    envelope.write_records(txn(spark, d), path)
    return spark.read.schema(TXN_SCHEMA).json(path)


@query("records_committed", f"with {TXN} select * from txn")
def q_records_committed(spark, d):
    # Two commits of a job each: the second replaces the first.
    path = scratch_path(spark, "committed")
    rows = txn(spark, d)
    record_files.write_committed(rows.where("month < '1994-01'"), path)
    record_files.write_committed(rows, path, "overwrite")
    return record_files.read_committed(spark, path, TXN_SCHEMA)


# ---------------------------------------------------------------------------
# Geo
# ---------------------------------------------------------------------------

POINT = (1.3521, 103.8198)
RADIUS = 10000.0


def _hav_sql() -> str:
    from resalelens.functions.geodesy import haversine_sql
    return haversine_sql("LATITUDE", "LONGITUDE", repr(POINT[0]), repr(POINT[1]))


@query("within_radius_sphere", f"""with p as ({S.POINTS_SQL}), d as (select *, {_hav_sql()} as dist from p)
select poi_id, loc_info, LATITUDE, LONGITUDE, round(dist, 3) as dist from d where dist <= {RADIUS!r}""")
def q_within_radius_sphere(spark, d):
    w = geo.within_radius(S.supplier_points(spark, d), POINT, RADIUS, method="sphere")
    return w.withColumn("dist", round_half_away("dist", 3))


@query("outside_radius_sphere", f"""with p as ({S.POINTS_SQL}), d as (select *, {_hav_sql()} as dist from p)
select poi_id, loc_info, LATITUDE, LONGITUDE, round(dist, 3) as dist from d where dist > {RADIUS!r}""")
def q_outside_radius_sphere(spark, d):
    w = geo.outside_radius(S.supplier_points(spark, d), POINT, RADIUS, method="sphere")
    return w.withColumn("dist", round_half_away("dist", 3))


@query("proximity_list", f"""with p as ({S.POINTS_SQL}), d as (select *, {_hav_sql()} as dist from p)
select loc_info, round(dist, 0) as dist_m, 'To ' || loc_info || ' - ' || format('{{:,.0f}}', round(dist, 0)) || 'm'
  as text from d where dist <= {RADIUS!r}""")
def q_proximity_list(spark, d):
    return geo.proximity_list(S.supplier_points(spark, d), POINT, RADIUS, method="sphere")


def _ell_sql() -> str:
    from resalelens.functions.geodesy import ellipsoid_sql
    return f"recursive p as ({S.POINTS_SQL}), " + ellipsoid_sql("p", "poi_id", "LATITUDE", "LONGITUDE", *POINT)


@query("within_radius_ellipsoid", f"""with {_ell_sql()}
select poi_id, loc_info, LATITUDE, LONGITUDE, round(dist, 3) as dist from p join geo_dist using (poi_id)
where dist <= {RADIUS!r}""")
def q_within_radius_ellipsoid(spark, d):
    w = geo.within_radius(S.supplier_points(spark, d), POINT, RADIUS)
    return w.withColumn("dist", round_half_away("dist", 3))


@query("outside_radius_ellipsoid", f"""with {_ell_sql()}
select poi_id, loc_info, LATITUDE, LONGITUDE, round(dist, 3) as dist from p join geo_dist using (poi_id)
where dist > {RADIUS!r}""")
def q_outside_radius_ellipsoid(spark, d):
    w = geo.outside_radius(S.supplier_points(spark, d), POINT, RADIUS)
    return w.withColumn("dist", round_half_away("dist", 3))


@query("proximity_list_ellipsoid", f"""with {_ell_sql()}
select loc_info, round(dist, 0) as dist_m, 'To ' || loc_info || ' - ' || format('{{:,.0f}}', round(dist, 0)) || 'm' as text
from p join geo_dist using (poi_id) where dist <= {RADIUS!r}""")
def q_proximity_list_ellipsoid(spark, d):
    return geo.proximity_list(S.supplier_points(spark, d), POINT, RADIUS)


def _far_sql() -> str:
    from resalelens.functions.antipodal import geodesic_sql
    return f"recursive p as ({S.OPPOSITE_SQL}), " + geodesic_sql("p", "poi_id", "LATITUDE", "LONGITUDE", *POINT)


#: Metres; the farthest point on the globe is about four kilometres beyond.
FAR_RADIUS = 20_000_000.0


@query("within_radius_geodesic", f"""with {_far_sql()}
select poi_id, loc_info, LATITUDE, LONGITUDE, round(dist, 3) as dist from p join far_dist using (poi_id)
where dist <= {FAR_RADIUS!r}""")
def q_within_radius_geodesic(spark, d):
    w = geo.within_radius(S.opposite_points(spark, d), POINT, FAR_RADIUS, method="geodesic")
    return w.withColumn("dist", round_half_away("dist", 3))


@query("outside_radius_geodesic", f"""with {_far_sql()}
select poi_id, loc_info, LATITUDE, LONGITUDE, round(dist, 3) as dist from p join far_dist using (poi_id)
where dist > {FAR_RADIUS!r}""")
def q_outside_radius_geodesic(spark, d):
    w = geo.outside_radius(S.opposite_points(spark, d), POINT, FAR_RADIUS, method="geodesic")
    return w.withColumn("dist", round_half_away("dist", 3))


# ---------------------------------------------------------------------------
# Tag facets
# ---------------------------------------------------------------------------

@query("tag_counts", f"""with p as ({S.POSTS_SQL})
select tag, count(*) as n from (select distinct post_id, unnest(tags) as tag from p) t group by tag""")
def q_tag_counts(spark, d):
    return facets.tag_counts(S.posts(spark, d))


@query("tag_rows", f"""with p as ({S.POSTS_SQL}), r as (select * from p where list_contains(tags, 'red'))
select post_id, date, published, title, (select count(*) from r) as n from r""")
def q_tag_rows(spark, d):
    return facets.tag_rows(S.posts(spark, d), "red").drop("tags")


@query("recent_rows", f"""with p as ({S.POSTS_SQL})
select post_id, date, published, title from p where published order by date desc, post_id desc limit 3""")
def q_recent_rows(spark, d):
    return facets.recent(S.posts(spark, d), 3).drop("tags")
