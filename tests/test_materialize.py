import os
import threading

from pyspark.sql import types as T

from resalelens.plans.materialize import fingerprint, materialized, table_location, written
from resalelens.session import scratch_path

SCHEMA = T.StructType([T.StructField("month", T.StringType()), T.StructField("x", T.LongType())])


def test_written_once_and_rekeyed_on_input_change(spark, tmp_path):
    src = tmp_path / "input.txt"
    src.write_text("a")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], SCHEMA)

    a = materialized(spark, "t", [str(src)], build, SCHEMA)
    b = materialized(spark, "t", [str(src)], build, SCHEMA)
    assert len(calls) == 1 and a.columns == ["month", "x"] and b.count() == 2
    assert dict(a.dtypes)["month"] == "string"
    key1 = fingerprint(spark, [str(src)])
    src.write_text("changed")
    os.utime(src, (1, 1))
    assert fingerprint(spark, [str(src)]) != key1
    materialized(spark, "t", [str(src)], build, SCHEMA)
    assert len(calls) == 2


def test_concurrent_callers_write_once(spark, tmp_path):
    src = tmp_path / "in.txt"
    src.write_text("z")
    calls = []

    def write(path):
        calls.append(1)
        spark.createDataFrame([("2024-01", 1)], SCHEMA).write.parquet(path)

    paths = []
    ts = [threading.Thread(target=lambda: paths.append(written(spark, "w", [str(src)], write)))
          for _ in range(4)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert len(set(paths)) == 1 and len(calls) == 1
    assert os.path.exists(os.path.join(paths[0], "_SUCCESS"))
    assert os.listdir(os.path.dirname(paths[0])) == [os.path.basename(paths[0])]


def test_new_file_in_a_sub_folder_gives_a_new_key(spark, tmp_path):
    (tmp_path / "month=2024-01").mkdir()
    (tmp_path / "month=2024-01" / "a").write_text("x")
    before = fingerprint(spark, [str(tmp_path)])
    assert fingerprint(spark, [str(tmp_path)]) == before
    (tmp_path / "month=2024-01" / "b").write_text("x")
    assert fingerprint(spark, [str(tmp_path)]) != before


def test_schemed_folders_crashed_and_second_writers(spark, tmp_path, monkeypatch):
    """A folder with a scheme, a folder without a marker, and a copy finished later are all handled."""
    monkeypatch.setattr("resalelens.plans.materialize.checkpoint_dir", lambda s: f"file://{tmp_path}/ckpt")
    src = tmp_path / "in.txt"
    src.write_text("q")
    uri = f"file://{src}"
    build = lambda: spark.createDataFrame([("2024-01", 1)], SCHEMA)
    first = table_location(spark, "t", [uri], build, SCHEMA)
    assert first.startswith("file:") and os.listdir(tmp_path / "ckpt" / "tables")
    table = tmp_path / "ckpt" / "tables" / os.listdir(tmp_path / "ckpt" / "tables")[0]
    (table / "000crashed").mkdir()
    (table / "000later").mkdir()
    (table / "000later" / "_SUCCESS").write_text("")
    assert table_location(spark, "t", [uri], build, SCHEMA) == first
    assert materialized(spark, "t", [uri], build, SCHEMA).count() == 1
    assert (table / "000crashed").exists()


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
