"""A month-partitioned request source, one request (input partition) per month.

The source application asks a remote store for one month at a time, with the
month, the field list and a request header, a few months in parallel.  Here
that is a Python Data Source over ``fetch(month, fields, header)``, which
returns the records (dicts) of one month:

* ``partitions()`` gives one partition per month asked for; nothing has to
  exist beforehand, and an empty answer gives no rows;
* ``month = 'YYYY-MM'`` / ``month IN (...)`` predicates take requests away
  where the session has ``spark.sql.python.filterPushdown.enabled`` (the
  defaults of ``session.get_session`` have); Spark still filters the rows;
* answers stream into Arrow batches of ``BATCH`` records with the declared
  fields as text; a missing field is null;
* ``limit`` (O4, off by default) keeps the first records of each month;
* ``on_error`` = ``fail`` (default) or ``skip`` (D15): a month whose request
  fails gives none of its rows, every other month all of them;
* a request has failed where ``fetch`` raises ``FetchError`` or an ``OSError``
  (connection errors, refusals), or where a record of another month than asked
  for is in the answer.  Anything else (memory, a fault in ``fetch``) ends the
  query, also with ``skip``;
* a fetch with ``parts(month)`` answers a month in parts, ``fetch.part(name,
  fields, header)`` each; every part is a partition of its own.

*Group commit.*  ``limit`` and ``skip`` are about whole months, a task is about one
part.  With either of them, all parts are asked for once and written, by Spark, to the
shared folder, each row with its month, part and place, and a part that fails leaves
a row that says so.  Afterwards a month is read only if none of its parts failed, and
the parts' row counts, added up in their order, tell how much of each part a limit
leaves.  No part waits for another, nothing is held in a worker, and
``request_months`` reports the parts that failed.

*Paged answers.*  A service that answers at most so many records a call is read through
``CursorPages`` (every page names the next) or ``OffsetPages`` (records and their total;
pages are parts, asked for in parallel).  Each page is asked for again if its call fails,
and given on only when it is whole, so a retry neither loses nor repeats records.

``StoredPages`` answers from JSON envelope files, one part each.  Data that is already stored
is better read by Spark's own readers (``envelope.read_envelopes``,
``read_months``).
"""

from __future__ import annotations

import base64
import functools
import io
import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from resalelens.operators.common import stored
from resalelens.schemas import RAW_FIELDS
from resalelens.session import qualified

FORMAT = "monthly_requests"
#: Records in one Arrow batch.
BATCH = 10_000
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

Fetch = Callable[[str, Sequence[str], dict | None], Iterable[dict]]


class FetchError(Exception):
    """A request failed; ``on_error="skip"`` leaves its month out."""


class WrongMonthError(ValueError):
    """The answer for a month has records of another one."""


class StoredPages:
    """A fetch over stored pages: JSON Lines envelopes under ``path/month=YYYY-MM/``.

    One page is in memory at a time.  An unknown month has no records.
    ``required`` names header entries without which a request is refused.
    """

    def __init__(self, spark: SparkSession, path: str, required: dict | None = None):
        self.path = qualified(spark, path).rstrip("/")
        self.required = required or {}

    def _list(self, folder: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        return fs, sorted(fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path)

    def months(self) -> list[str]:
        names = [i.base_name for i in self._list(self.path)[1] if i.type == pafs.FileType.Directory]
        return [n.split("=", 1)[1] for n in names if n.startswith("month=")]

    def parts(self, month: str) -> list[str]:
        files = self._list(f"{self.path}/month={month}")[1]
        return [f"month={month}/{i.base_name}" for i in files
                if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))]

    def part(self, name: str, fields: Sequence[str], header: dict | None) -> Iterator[dict]:
        if any((header or {}).get(k) != v for k, v in self.required.items()):
            raise PermissionError(f"request for {name} refused")
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/{name}") as raw, io.TextIOWrapper(raw, encoding="utf-8") as lines:
            for page in filter(str.strip, lines):
                try:
                    records = (json.loads(page).get("result") or {}).get("records") or []
                except ValueError as e:
                    raise FetchError(f"a page of {name} cannot be read: {e}") from e
                for record in records:
                    yield {f: record.get(f) for f in fields}

    def __call__(self, month: str, fields: Sequence[str], header: dict | None) -> Iterator[dict]:
        if any((header or {}).get(k) != v for k, v in self.required.items()):
            raise PermissionError(f"request for {month} refused")
        for name in self.parts(month):
            yield from self.part(name, fields, header)


    def page(self, month: str, fields: Sequence[str], header: dict | None, cursor: str | None,
             size: int = 100) -> tuple[list[dict], str | None]:
        """At most ``size`` records from ``cursor`` on (None: from the first) and the cursor of the next page.

        A cursor is a place in the stored pages -- file, line and record -- so the same
        cursor always gives the same records.
        """
        if any((header or {}).get(k) != v for k, v in self.required.items()):
            raise PermissionError(f"request for {month} refused")
        files = [i for i in self._list(f"{self.path}/month={month}")[1]
                 if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))]
        file, line, at = map(int, cursor.split(":")) if cursor else (0, 0, 0)
        out: list[dict] = []
        while file < len(files):
            info = files[file]
            records, after = _envelope(self.path, f"month={month}/{info.base_name}", line, (info.size, info.mtime_ns))
            if records is None:  # the file has ended
                file, line, at = file + 1, 0, 0
                continue
            take = records[at:at + size - len(out)]
            out += [{f: r.get(f) for f in fields} for r in take]
            at += len(take)
            if at == len(records):
                line, at = after, 0
            if len(out) == size:
                return out, f"{file}:{line}:{at}"
        return out, None


#: Endings of the files that Arrow decompresses.
_COMPRESSED = (".gz", ".bz2", ".lz4", ".zst")
#: The compressed file that was read last: ((file, state), reader, place in its text).
_READING: list[tuple] = []


def _forward(fs, file: str, at: int, state: tuple) -> bytes:
    """The line at byte ``at`` of the text of a compressed file; empty at its end.

    A compressed file is read forward only: pages that follow one another go on where the
    last one ended, any other place is reached from the start.
    """
    key, reader, place = _READING.pop() if _READING else (None, None, 0)
    if key != (file, state) or place > at:
        if reader is not None:
            reader.close()
        reader, place = io.BufferedReader(fs.open_input_stream(file), 1 << 16), 0
    while place < at:
        skipped = len(reader.read(min(at - place, 1 << 20)))
        if not skipped:
            break
        place += skipped
    line = reader.readline()
    _READING.append(((file, state), reader, place + len(line)))
    return line


@functools.lru_cache(maxsize=4)
def _envelope(path: str, name: str, at: int, state: tuple) -> tuple[list[dict] | None, int]:
    """(records of the envelope at byte ``at`` of a file's text, place of the next); (None, at) at its end.

    Kept for the next page of the same envelope, as long as the file is in the same ``state``.
    """
    fs, root = pafs.FileSystem.from_uri(path)
    if name.endswith(_COMPRESSED):
        line = _forward(fs, f"{root}/{name}", at, state)
    else:
        with fs.open_input_file(f"{root}/{name}") as raw:
            raw.seek(at)
            line = io.BufferedReader(raw, 1 << 16).readline()
    if not line:
        return None, at
    try:
        records = (json.loads(line).get("result") or {}).get("records") or [] if line.strip() else []
    except ValueError as e:
        raise FetchError(f"a page of {name} cannot be read: {e}") from e
    return records, at + len(line)


def _asked(call: Callable, retries: int):
    """The answer of ``call``, which is asked again up to ``retries`` times if the request fails."""
    for left in range(retries, -1, -1):
        try:
            return call()
        except (FetchError, OSError):
            if not left:
                raise


class CursorPages:
    """A fetch over ``page(month, fields, header, cursor) -> (records, next cursor or None)``.

    The pages of a month follow one another in one partition; one page is in memory.
    """

    def __init__(self, page: Callable[..., tuple[list[dict], str | None]], retries: int = 2):
        self.page, self.retries = page, retries

    def __call__(self, month: str, fields: Sequence[str], header: dict | None) -> Iterator[dict]:
        cursor, seen = None, set()
        while True:
            records, cursor = _asked(functools.partial(self.page, month, fields, header, cursor), self.retries)
            yield from records
            if cursor is None:
                return
            if cursor in seen:
                raise FetchError(f"the pages of {month} go in a circle at {cursor}")
            seen.add(cursor)


class OffsetPages:
    """A fetch over ``call(month, fields, header, offset, limit) -> {"records": [...], "total": n}``.

    A call answers at most ``size`` records, whatever is asked for; ``total`` is the number of
    records of the month.  Every page is a part.  A page that is shorter than its part is
    followed up until the part is whole; a total that has changed, or a part that stays
    short, is a failed request, since the pages would no longer fit together.
    """

    def __init__(self, call: Callable[..., dict], size: int = 10_000, retries: int = 2):
        self.call, self.size, self.retries = call, size, retries

    def parts(self, month: str, header: dict | None = None) -> list[str]:
        answer = _asked(functools.partial(self.call, month, ["month"], header, 0, 1), self.retries)
        total = int(answer["total"])
        return [f"{month}/{at}/{total}" for at in range(0, total, self.size)]

    def part(self, name: str, fields: Sequence[str], header: dict | None) -> Iterator[dict]:
        month, at, total = name.rsplit("/", 2)
        at, total = int(at), int(total)
        end = min(at + self.size, total)
        while at < end:
            answer = _asked(functools.partial(self.call, month, fields, header, at, end - at), self.retries)
            records = answer["records"][:end - at]
            if int(answer["total"]) != total or not records:
                raise FetchError(f"the records of {month} changed between two pages")
            yield from records
            at += len(records)

    def __call__(self, month: str, fields: Sequence[str], header: dict | None) -> Iterator[dict]:
        for name in self.parts(month, header):
            yield from self.part(name, fields, header)


class MonthRequest(InputPartition):
    """The request of one month, or of one part of it: (month, number of the part, part or None)."""


#: What a row of a group commit has beside its fields.
_TAGS = {"_asked": pa.string(), "_part": pa.int32(), "_row": pa.int64(), "_error": pa.string()}


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.names = json.loads(options["fields"]) if "fields" in options else schema.fieldNames()
        self.months = json.loads(options["months"])
        self.limit = int(options["limit"]) if "limit" in options else None
        self.skip = options.get("on_error", "fail") == "skip"
        self.tagged = self.skip or self.limit is not None
        self.header = json.loads(options["header"]) if "header" in options else None
        self.fetch: Fetch = cloudpickle.loads(base64.b64decode(options["fetch"]))

    def _parts(self, month: str) -> list:
        if not hasattr(self.fetch, "parts"):
            return [None]
        try:
            return self.fetch.parts(month)
        except (FetchError, OSError):
            if not self.skip:
                raise
            return [None]  # the month fails again where it is read

    def partitions(self):
        return [MonthRequest((m, i, part)) for m in self.months for i, part in enumerate(self._parts(m) or [None])]

    def read(self, partition: MonthRequest):
        if partition is None or partition.value is None:  # no month is left to ask for
            return iter(())
        month, no, part = partition.value
        if not self.tagged:
            return self._batches(month, self._records(month, part))
        return self._tagged(month, no, part)

    def _records(self, month: str, part: str | None) -> Iterator[dict]:
        records = self.fetch(month, self.names, self.header) if part is None else self.fetch.part(part, self.names, self.header)
        return itertools.islice(iter(records), self.limit)

    def _tagged(self, month: str, no: int, part: str | None) -> Iterator[pa.RecordBatch]:
        """The batches of a part with its tags; if the request fails, a last row that says so."""
        schema = pa.schema([*self._schema(), *_TAGS.items()])
        failed: list[Exception] = []

        def records():
            # Only what the request itself raises is a failed request.
            try:
                yield from self._records(month, part)
            except (FetchError, OSError) as e:
                failed.append(e)

        at = 0
        try:
            for batch in self._batches(month, records()):
                n = batch.num_rows
                tags = [pa.array([month] * n), pa.array([no] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.nulls(n, pa.string())]
                at += n
                yield pa.RecordBatch.from_arrays([*batch.columns, *tags], schema=schema)
        except WrongMonthError as e:
            failed.append(e)
        if failed and not self.skip:
            raise failed[0]
        if failed:
            row = {n: [None] for n in self.names} | {"_asked": [month], "_part": [no], "_row": [at], "_error": [repr(failed[0])]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    def _schema(self) -> pa.Schema:
        return pa.schema([(n, pa.string()) for n in self.names])

    def _batches(self, month: str, records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        while block := list(itertools.islice(records, BATCH)):
            if any(r.get("month", month) not in (month, None) for r in block):
                raise WrongMonthError(f"records of another month in the answer for {month}")
            yield pa.RecordBatch.from_pydict({n: [_text(r.get(n)) for r in block] for n in self.names}, schema=self._schema())


class _PruningReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("month",):
                wanted = [f.value] if isinstance(f, EqualTo) else f.value
                self.months = [m for m in self.months if m in wanted]
            yield f  # months only prune the requests; Spark still filters the rows


def _text(v) -> str | None:
    """A value as the text it has in JSON (numbers keep their digits)."""
    return v if v is None or isinstance(v, str) else json.dumps(v)


class MonthlyRequestSource(DataSource):
    """``spark.read.format("monthly_requests")``; see ``read_month_source`` for the options."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        fields = [T.StructField(n, T.StringType()) for n in json.loads(self.options["fields"])]
        if "limit" in self.options or self.options.get("on_error") == "skip":
            fields += [T.StructField("_asked", T.StringType()), T.StructField("_part", T.IntegerType()),
                       T.StructField("_row", T.LongType()), T.StructField("_error", T.StringType())]
        return T.StructType(fields)

    def reader(self, schema):
        return (_PruningReader if self.options.get("pushdown") == "true" else _Reader)(schema, self.options)


def _requested(spark: SparkSession, fetch: Fetch, months: Iterable[str], fields: Sequence[str], limit: int | None,
               header: dict | None, on_error: str) -> DataFrame:
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")
    spark.dataSource.register(MonthlyRequestSource)
    options = {"fetch": base64.b64encode(cloudpickle.dumps(fetch)).decode(), "months": json.dumps(list(dict.fromkeys(months))),
               "fields": json.dumps(list(fields)), "on_error": on_error,
               "pushdown": str(spark.conf.get(_PUSHDOWN, "false")).lower()}
    if limit is not None:
        options["limit"] = str(limit)
    if header is not None:
        options["header"] = json.dumps(header)
    return spark.read.format(FORMAT).options(**options).load()


def request_months(spark: SparkSession, fetch: Fetch, months: Iterable[str], fields: Sequence[str] = tuple(RAW_FIELDS),
                   limit: int | None = None, header: dict | None = None, on_error: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(rows, failed): the records of the months whose requests all succeeded, and the parts
    that failed as (month, part, error).

    Asks for every part now, once, and writes what it answers to the shared folder.
    """
    asked = _requested(spark, fetch, months, fields, limit, header, on_error)
    if "_asked" not in asked.columns:
        return asked, spark.createDataFrame([], "month string, part int, error string")
    asked = stored(asked, "requests")
    failed = asked.where("_error is not null").select(F.col("_asked").alias("month"), F.col("_part").alias("part"), F.col("_error").alias("error"))
    rows = asked.where("_error is null").join(failed.select(F.col("month").alias("_asked")).distinct(), "_asked", "left_anti")
    if limit is not None:
        sizes = rows.groupBy("_asked", "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("_asked").orderBy("_part")) - F.col("_n")
        left = sizes.select("_asked", "_part", (F.lit(limit) - before).alias("_left"))
        rows = rows.join(left, ["_asked", "_part"]).where(F.col("_row") < F.col("_left"))
    return rows.select(*fields), failed


def read_month_source(spark: SparkSession, fetch: Fetch, months: Iterable[str], fields: Sequence[str] = tuple(RAW_FIELDS),
                      limit: int | None = None, header: dict | None = None, on_error: str = "fail") -> DataFrame:
    """The records ``fetch(month, fields, header)`` gives for each of ``months`` (see module docstring).

    A month named twice is asked for once.  ``fetch`` is pickled into the tasks.  With ``limit``
    or ``on_error="skip"`` the requests are made by this call (``request_months``), else whenever
    the rows are read.
    """
    if limit is not None or on_error == "skip":
        return request_months(spark, fetch, months, fields, limit, header, on_error)[0]
    return _requested(spark, fetch, months, fields, limit, header, on_error)


def write_months(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store rows month-partitioned (``path/month=YYYY-MM/``)."""
    df.write.mode("overwrite").partitionBy("month").format(fmt).save(path)


def read_months(spark: SparkSession, path: str, months=None, fmt: str = "parquet") -> DataFrame:
    """Read a month-partitioned table; ``months`` becomes a partition filter
    (only those folders are listed and read)."""
    df = spark.read.format(fmt).load(path)
    if months is not None:
        df = df.where(F.col("month").isin(list(months)))
    return df
