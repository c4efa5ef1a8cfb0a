"""Written intermediate tables in the shared checkpoint folder.

The dashboards run many queries over one cleaned table.  Recomputing the
source joins and text cleaning for each of them is wasted work at scale,
and a long lineage is fragile when executors are lost.  ``materialized``
writes a DataFrame once as a month-partitioned parquet table under
``spark.checkpoint.dir`` and returns a DataFrame reading it back:

* reads get partition pruning on ``month`` and row-group skipping on the
  other columns (filters reach the scan as ``PushedFilters``);
* the lineage is cut: a lost executor re-reads files instead of re-running
  the joins;
* the table is keyed by a fingerprint of its inputs (paths, sizes, modify
  times), so changed inputs give a new table and a finished table is reused.

Paths are resolved by Spark alone -- listing by its binary-file reader,
look-up by its Hadoop configuration -- so a path without a scheme means the
same folder here as in ``spark.read``.  Each writer writes to a folder of its
own under the table's folder and Spark's ``_SUCCESS`` file commits it: nothing
is renamed (no atomic rename on object stores) or deleted (another reader may
hold it), and a folder a crashed run left behind is never read.  If two
drivers write the same table, the copy that was finished first is read.

Rows are rebalanced on the partition column before the write (AQE's
``rebalance``: a month larger than the advisory partition size is split
over several tasks, small months share a task -- no hot writer task and no
long tail of tiny files, and unlike range partitioning no sampling pass
re-runs the input), then sorted within each task by (month, cluster
columns) so parquet row-group statistics can skip on those columns.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resalelens.session import checkpoint_dir


def fingerprint(spark: SparkSession, paths: Sequence[str], salt: str = "") -> str:
    """Hash of the input files' names, sizes and modify times.

    The files are listed on every call: a new file anywhere below an input
    gives a new hash, also within one process.  Only the listing is read, never
    the contents, and it is reduced to one row by Spark.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(sorted(paths)).select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length"))
    state = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor("h").alias("h")).first()
    return hashlib.sha256(f"{salt}|{state.n}|{state.bytes}|{state.h}".encode()).hexdigest()[:20]


_CODE: list[str] = []


def code_version() -> str:
    """Hash of the library's source: a changed operator never reuses a table
    written by an older one."""
    if not _CODE:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        h = hashlib.sha256()
        for d, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(d, f), "rb") as fh:
                        h.update(f.encode() + fh.read())
        _CODE.append(h.hexdigest()[:12])
    return _CODE[0]


_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)
_WRITTEN: dict[str, str] = {}


def _finished(spark: SparkSession, path: str) -> str | None:
    """The committed folder under ``path`` that was finished first; None without any."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: no file look-up, what this process wrote counts
        return _WRITTEN.get(path)
    glob = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = glob.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(glob) or []
    done = sorted((f.getModificationTime(), f.getPath().getParent().getName()) for f in found)
    return f"{path}/{done[0][1]}" if done else None


def _publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """The finished folder under ``path``; ``write`` makes one where there is none.

    Concurrent callers in this process wait for the first.
    """
    with _LOCKS[path]:
        done = _finished(spark, path)
        if done is None:
            target = f"{path}/{uuid.uuid4().hex[:12]}"
            write(target)
            _WRITTEN[path] = target
            done = _finished(spark, path) or target
    return done


def materialized(spark: SparkSession, name: str, inputs: Sequence[str],
                 build: Callable[[], DataFrame], schema: T.StructType,
                 partition_by: str | None = "month", cluster_by: Sequence[str] = (),
                 version: str = "1", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Return ``build()`` written once under the checkpoint folder.

    ``inputs`` are the files the result depends on (for the fingerprint),
    ``schema`` the declared schema of ``build()`` (read back with it, so the
    partition column keeps its declared type); ``version`` must change when
    ``build`` changes meaning.  ``finish`` is the part of the work on single
    rows that keeps the partition column: it runs after the shuffle, so that
    the columns it derives are not shuffled.
    """
    path = table_location(spark, name, inputs, build, schema, partition_by, cluster_by, version, finish)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def table_location(spark: SparkSession, name: str, inputs: Sequence[str],
                   build: Callable[[], DataFrame], schema: T.StructType,
                   partition_by: str | None = "month", cluster_by: Sequence[str] = (),
                   version: str = "1", finish: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Folder of the table ``materialized`` reads for these arguments (written if needed)."""
    def write(target: str) -> None:
        df = build()
        if partition_by:
            df = df.hint("rebalance", partition_by)
        df = (finish(df) if finish else df).select(*schema.fieldNames())
        if partition_by:
            df.sortWithinPartitions(partition_by, *cluster_by).write.partitionBy(partition_by).parquet(target)
        else:
            df.write.parquet(target)

    key = fingerprint(spark, inputs, salt=f"{name}|{version}|{code_version()}|{partition_by}|{schema.simpleString()}")
    return _publish(spark, f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{key}", write)


def written(spark: SparkSession, name: str, inputs: Sequence[str],
            write: Callable[[str], None], version: str = "1") -> str:
    """Path of files produced once by ``write(path)`` for this input state
    (same keying and completion rule as ``materialized``)."""
    key = fingerprint(spark, inputs, salt=f"{name}|{version}|{code_version()}")
    return _publish(spark, f"{checkpoint_dir(spark).rstrip('/')}/files/{name}-{key}", write)
