from pyspark.sql import types as T

from resalelens.operators import clean
from resalelens.schemas import RAW_TXN


def raw_frame(spark, records):
    full = [tuple(r.get(c) for c in RAW_TXN.fieldNames()) for r in records]
    return spark.createDataFrame(full, RAW_TXN)


BASE = dict(month="2020-01", block="123", town="BISHAN", flat_type="3 ROOM", street_name="BISHAN ST 11",
            storey_range="10 TO 12", floor_area_sqm="67", remaining_lease="61 years 04 months",
            resale_price="500000")


def test_lease_first_match_rewrites(spark):
    leases = ["61 years 04 months", "61 years", "60 years 01 month", "1 year 05 months", "", None]
    df = raw_frame(spark, [dict(BASE, remaining_lease=v) for v in leases])
    got = [r.lease for r in clean.clean_transactions(df).collect()]
    assert got == ["61y 04ms", "61y", "60y 01m", "1y 05m", "", None]


def test_lease_all_matches_option(spark):
    df = raw_frame(spark, [dict(BASE, remaining_lease="61 years 04 months")])
    assert clean.clean_transactions(df, strict_lease=False).first().lease == "61y 04m"


def test_flat_and_floor_rewrites(spark):
    flats = ["3 ROOM", "EXECUTIVE", "MULTI-GENERATION", "1 ROOM", None]
    df = raw_frame(spark, [dict(BASE, flat_type=f) for f in flats])
    got = [r.flat for r in clean.clean_transactions(df).collect()]
    assert got == ["3RM", "EC", "MG", "1RM", None]
    df = raw_frame(spark, [dict(BASE, storey_range=v) for v in ["10 TO 12", "01 TO 03"]])
    assert [r.floor for r in clean.clean_transactions(df).collect()] == ["10-12", "01-03"]


def test_measures_and_casts(spark):
    recs = [dict(BASE, resale_price=p) for p in ["299999.99", "1000000", None, "n/a"]]
    recs += [dict(BASE, floor_area_sqm="0"), dict(BASE, floor_area_sqm=None)]
    out = clean.clean_transactions(raw_frame(spark, recs)).collect()
    assert [r.price for r in out[:4]] == [299999.99, 1000000.0, None, None]
    r = out[0]
    assert r.area_sqft == 67 * 10.7639
    assert r.price_sqm == 299999.99 / 67
    assert r.price_sqft == 299999.99 / (67 * 10.7639)
    # zero or missing area: unit prices are null, not an error or infinity
    assert out[4].price_sqm is None and out[4].price_sqft is None
    assert out[5].area_sqm is None and out[5].price_sqm is None


def test_street_concat_null_propagates(spark):
    df = raw_frame(spark, [BASE, dict(BASE, block=None)])
    got = [r.street for r in clean.clean_transactions(df).collect()]
    assert got == ["BLK 123 BISHAN ST 11", None]


def test_output_schema(spark):
    out = clean.clean_transactions(raw_frame(spark, [BASE]))
    assert out.columns == ["month", "town", "flat", "street", "floor", "lease",
                           "area_sqm", "area_sqft", "price_sqm", "price_sqft", "price"]
    assert all(isinstance(out.schema[c].dataType, T.DoubleType) for c in out.columns[6:])


def test_numeric_inputs_accepted(spark):
    schema = T.StructType([f if f.name not in ("floor_area_sqm", "resale_price")
                           else T.StructField(f.name, T.DoubleType()) for f in RAW_TXN.fields])
    rec = tuple(float(BASE[c]) if c in ("floor_area_sqm", "resale_price") else BASE[c]
                for c in RAW_TXN.fieldNames())
    out = clean.clean_transactions(spark.createDataFrame([rec], schema)).first()
    assert out.price == 500000.0 and out.area_sqm == 67.0


def test_positional_rename(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.rename_positional(df, ["x", "y"]).columns == ["x", "y"]
