import os

from resalelens.session import checkpoint_dir, scratch_path, ship_package


def test_checkpoint_dir_comes_from_the_session(spark):
    path = checkpoint_dir(spark)
    assert path == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(path)


def test_package_is_shipped_once(spark):
    ship_package(spark)
    ship_package(spark)
    assert spark.sparkContext.listFiles and sum("resalelens.zip" in f for f in spark.sparkContext.listFiles) == 1
    assert not [f for f in os.listdir(checkpoint_dir(spark)) if f.endswith(".zip")]
