import json
import os

from resalelens.session import scratch_path
from resalelens.streaming import start_clean_ingest, start_month_group_counts


def _land(folder, name, month, prices):
    os.makedirs(folder, exist_ok=True)
    recs = [{"month": month, "block": "1", "town": "T", "flat_type": "3 ROOM", "street_name": "S",
             "storey_range": "01 TO 03", "floor_area_sqm": "60", "remaining_lease": "90 years",
             "resale_price": p} for p in prices]
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(json.dumps({"result": {"records": recs}}) + "\n")


def test_incremental_ingest_counts_each_file_once(spark):
    landing = scratch_path(spark, "landing")
    table = scratch_path(spark, "clean-table")
    counts = scratch_path(spark, "counts-table")
    ck1, ck2 = scratch_path(spark, "ck1"), scratch_path(spark, "ck2")
    _land(landing, "a.json", "2024-01", ["250000", "600000"])
    _land(landing, "b.json", "2024-02", ["1200000"])
    q = start_clean_ingest(spark, landing, table, ck1)
    q.awaitTermination(120)
    c = start_month_group_counts(spark, landing, counts, ck2)
    c.awaitTermination(120)
    assert spark.read.parquet(table).count() == 3
    _land(landing, "c.json", "2024-02", ["300000"])
    q = start_clean_ingest(spark, landing, table, ck1)
    q.awaitTermination(120)
    c = start_month_group_counts(spark, landing, counts, ck2)
    c.awaitTermination(120)
    t = spark.read.parquet(table)
    assert t.count() == 4  # the first two files are not read again
    assert {r.lease for r in t.collect()} == {"90y"}
    got = {(r.month, r.price_grp): r["count"] for r in spark.read.parquet(counts).collect()}
    assert got == {("2024-01", "0-300k"): 1, ("2024-01", "500-800k"): 1,
                   ("2024-02", ">=1m"): 1, ("2024-02", "300-500k"): 1}
