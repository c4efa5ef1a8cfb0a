"""A record sink with a commit, as a Python data source.

``df.write.format("record_files").mode("append").save(path)`` writes rows as JSON
Lines to any filesystem that Arrow reaches, with the guarantees of a commit
protocol:

* each task writes a file of its own, under a name no other attempt has, and
  reports its name and number of records to the driver;
* when all tasks are done the driver commits: one manifest names the files.  A file
  no manifest names -- of an attempt that failed, ran twice, or whose job was
  lost -- is not part of the table;
* a job that fails is aborted: the files that were reported are deleted.

``mode("overwrite")`` commits a manifest that takes the place of all before it.
``read_records`` reads the rows of the committed files, in Spark: the manifests and
``_metadata.file_name`` decide, no list of files goes through the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from resalelens.session import qualified

FORMAT = "record_files"
_DATA, _MANIFESTS = "data", "manifests"
_MANIFEST = "replaces boolean, files array<struct<name: string, records: long>>"


@dataclass
class WrittenFile(WriterCommitMessage):
    name: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    """Writes one file a task; the driver's ``commit`` makes them visible at once."""

    def __init__(self, path: str, overwrite: bool, lines: bool = False):
        self.path, self.overwrite, self.lines = path, overwrite, lines

    def _folder(self, name: str):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/{name}", recursive=True)
        return fs, f"{root}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        fs, folder = self._folder(_DATA)
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.jsonl"
        records = 0
        try:
            with fs.open_output_stream(f"{folder}/{name}") as out:
                for batch in iterator:
                    records += batch.num_rows
                    out.write(_joined(batch.column(0)) if self.lines else _records(batch))
        except BaseException:
            fs.delete_file(f"{folder}/{name}")
            raise
        return WrittenFile(name, records)

    def commit(self, messages: list[WrittenFile | None]) -> None:
        fs, folder = self._folder(_MANIFESTS)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        files = [{"name": m.name, "records": m.records} for m in messages if m is not None]
        # Hidden until it is whole.
        with fs.open_output_stream(f"{folder}/_{name}") as out:
            out.write((json.dumps({"replaces": self.overwrite, "files": files}) + "\n").encode())
        fs.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[WrittenFile | None]) -> None:
        fs, folder = self._folder(_DATA)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.name}")


def _records(batch: pa.RecordBatch) -> bytes:
    return "".join([json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()]).encode()


def _joined(lines: pa.Array) -> pa.Buffer | bytes:
    """The lines, each with its line end, joined by Arrow."""
    if not len(lines):
        return b""
    whole = pa.ListArray.from_arrays(pa.array([0, len(lines) + 1], pa.int32()), pa.concat_arrays([lines.cast(pa.binary()), pa.array([b""], pa.binary())]))
    return pc.binary_join(whole, b"\n")[0].as_buffer()


class RecordFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool):
        return RecordWriter(self.options["path"], overwrite, self.options.get("lines") == "true")


def write_committed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Appends the rows of ``df`` to the table at ``path`` in one commit (``overwrite``: replaces it)."""
    spark = df.sparkSession
    spark.dataSource.register(RecordFiles)
    # Spark makes the JSON text; the writer's tasks only join the lines.
    record = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    lines = df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format(FORMAT).option("lines", "true").mode(mode).save(qualified(spark, path))


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed files; none where nothing was committed."""
    rows = spark.read.schema(schema)
    path = qualified(spark, path)
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{root}/{_MANIFESTS}").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    manifests = spark.read.schema(_MANIFEST).json(f"{path}/{_MANIFESTS}").select("*", F.col("_metadata.file_name").alias("at"))
    # Names begin with the time of the commit.
    since = F.coalesce(F.max(F.when(F.col("replaces"), F.col("at"))), F.lit("")).alias("since")
    named = (manifests.join(F.broadcast(manifests.agg(since)), F.col("at") >= F.col("since"))  # one row
             .select(F.explode("files").alias("file")).select(F.col("file.name").alias("__file")))
    if fs.get_file_info(f"{root}/{_DATA}").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    found = rows.json(f"{path}/{_DATA}")
    return (found.select("*", F.col("_metadata.file_name").alias("__file")).join(named, "__file", "left_semi").drop("__file"))
