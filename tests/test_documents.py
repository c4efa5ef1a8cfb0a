import json

import pytest
from pyspark.sql import types as T

from conftest import rows
from resalelens.sources import documents as D

LINES = [
    '{"_id": 1, "month": "2024-01", "price": 450000.50, "flag": true}',
    '{"_id": 2, "month": "2024-01", "price": "450000", "flag": null}',
    '{"_id": 3, "month": "2024-02", "price": "S$1,000", "tags": ["a", 1]}',
    '{"_id": 4, "month": 202403, "price": 7, "a b": {"k": 1}}',
    '{"price": 4.5e5, "price": 1}',
    '[1, 2]',
    'no json {',
    '   ',
    '{}',
]
SCHEMA = T.StructType([T.StructField("month", T.StringType()), T.StructField("price", T.DoubleType())])


@pytest.fixture()
def docs(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES))
    return D.read_documents(spark, str(tmp_path))


def test_typed_keeps_what_a_type_cannot_hold(docs):
    got = sorted(rows(D.typed(docs, SCHEMA)), key=repr)
    want = [("2024-01", 450000.5, None), ("2024-01", 450000.0, None), ("2024-02", None, {"price": '"S$1,000"'}),
            ("202403", 7.0, None), (None, None, None)]
    want += [(None, None, {"": line}) for line in LINES[4:7]]
    assert got == sorted(want, key=repr)
    assert D.typed(docs, SCHEMA, rest=None).columns == ["month", "price"]


def test_observed_and_widened_types(docs):
    seen = {(f, t): n for f, t, n in rows(D.observed_types(docs))}
    assert seen == {("month", "text"): 3, ("month", "integer"): 1, ("price", "double"): 1, ("price", "text"): 2,
                    ("price", "integer"): 1, ("flag", "boolean"): 1, ("flag", "null"): 1, ("tags", "array"): 1,
                    ("a b", "object"): 1}
    schema = D.widened_schema(docs)
    assert schema.simpleString() == "struct<a b:string,flag:boolean,month:string,price:string,tags:string>"
    wide = {r["month"]: r for r in D.typed(docs, schema).where("month is not null").collect()}
    assert json.loads(wide["2024-02"]["tags"]) == ["a", 1] and json.loads(wide["202403"]["a b"]) == {"k": 1}
    assert wide["202403"]["price"] == "7" and wide["2024-02"]["price"] == "S$1,000"
    assert all(r["rest"] is None for r in wide.values())


def test_numbers_widen_to_double_and_null_only_to_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1, "z": null}\n{"n": 2.5}\n')
    found = D.widened_schema(D.read_documents(spark, str(tmp_path)))
    assert found.simpleString() == "struct<n:double,z:string>"


def test_no_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n\n")
    empty = D.read_documents(spark, str(tmp_path))
    assert rows(D.typed(empty, SCHEMA)) == [] and D.widened_schema(empty) == T.StructType([])


def test_too_many_fields_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "MAX_FIELDS", 2)
    (tmp_path / "a.json").write_text('{"a": 1, "b": 2, "c": 3}')
    with pytest.raises(ValueError, match="more than 2 fields"):
        D.widened_schema(D.read_documents(spark, str(tmp_path)))


def test_relaxed_union_widens_to_text(spark):
    a = spark.createDataFrame([("2024-01", "S$5")], "month string, price string")
    b = spark.createDataFrame([(7, 202402, "x")], "price bigint, month int, town string")
    assert sorted(rows(D.relaxed_union(a, b), "month", "price", "town"), key=repr) == [
        ("2024-01", "S$5", None), ("202402", "7", "x")]
    c = spark.createDataFrame([(1.5,)], "n double")
    d = spark.createDataFrame([(2,)], "n int")
    assert sorted(x for (x,) in rows(D.relaxed_union(c, d))) == [1.5, 2.0]
