"""Session construction and shared-folder lookup."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job in the library relies on.  AQE re-plans joins and
# coalesces shuffle partitions at runtime; skew-join splits hot keys.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "resalelens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    pass ``local[N]`` and a small ``shuffle_partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there).  Only when it is unset and the master is local --
    tests and local runs -- a scratch folder is created and registered; on a
    cluster an unset folder is an error, since a machine-local folder is not
    visible to the executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="resalelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
        sc = _context(spark)
        if sc is not None:
            sc.setCheckpointDir(path)
    return path


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect has no SparkContext
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", "8"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI on the filesystem Spark resolves it on."""
    sc = _context(spark)
    if sc is not None:
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        path = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(hpath).toString()
    return "file://" + path.removeprefix("file:") if path.startswith(("file:/", "/")) and "://" not in path else path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def temporary_path(spark: SparkSession, name: str) -> str:
    """``scratch_path`` that Spark's filesystem layer deletes when the application ends."""
    path = scratch_path(spark, name)
    sc = _context(spark)
    if sc is not None:
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``resalelens`` importable in Python workers (pandas UDFs and the
    Python data source are pickled by reference).

    On a cluster the usual way is ``spark-submit --py-files``; this does the
    same from a running session: the package is zipped once per application
    on the driver and distributed with ``addPyFile``.
    """
    sc = _context(spark)
    app = sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "connect")
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    # Built on the driver's own disk: Spark's file server (or the Connect
    # artifact upload) hands it to the executors, so no shared folder is
    # opened with local file calls.
    target = os.path.join(tempfile.mkdtemp(prefix="resalelens-pkg-"), "resalelens.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(target)
    else:
        spark.addArtifacts(target, pyfile=True)
    _SHIPPED.add(app)
