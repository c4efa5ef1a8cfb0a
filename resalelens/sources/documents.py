"""Stored documents without a schema (S3, S4, U1): JSON lines as VARIANT.

A document store gives each document the fields it was saved with: a price may
be a number in one year and text in the next, or missing.  ``read_documents``
keeps a document whole as a VARIANT; ``observed_types`` finds by one grouped
aggregate which types each field takes, ``widened_schema`` picks a type that
holds them all, and ``typed`` reads the documents by a schema.  No value is
lost: what a declared type cannot hold stays as JSON text in a map column.

Defined results: blank lines are no documents; a line that is not a JSON object
(or names a field twice) is a row of nulls whose map holds the line under the
empty name; a missing field and a JSON null are both null; an empty folder of
files gives no rows and no fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields a widened schema has at most; more is an error, none is dropped.
MAX_FIELDS = 2000

REST = T.MapType(T.StringType(), T.StringType())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a line: ``line`` as stored and ``doc``, null where the line is no JSON object."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    doc = F.try_parse_json("line")
    return lines.select("line", F.when(F.schema_of_variant(doc).startswith("OBJECT<"), doc).alias("doc"))


def _kind(schema: Column) -> Column:
    """Type of a value as its SQL text names it -> null, boolean, integer, double, text, object or array."""
    kinds = [("VOID", "null"), ("BOOLEAN", "boolean"), ("BIGINT", "integer"), ("DECIMAL", "double"),
             ("DOUBLE", "double"), ("STRING", "text"), ("OBJECT", "object"), ("ARRAY", "array")]
    kind = F.lit("other")
    for start, name in kinds:
        kind = F.when(schema.startswith(start), name).otherwise(kind)
    return kind


def observed_types(docs: DataFrame, drop: Sequence[str] = ("_id",)) -> DataFrame:
    """``field, type, n``: how many documents hold the field with a value of that type."""
    fields = docs.where(F.col("doc").isNotNull()).select("doc").lateralJoin(
        docs.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    return (fields.where(~F.col("key").isin(list(drop)) if drop else F.lit(True))
            .groupBy(F.col("key").alias("field"), _kind(F.schema_of_variant("value")).alias("type"))
            .agg(F.count(F.lit(1)).alias("n")))


def widened_types(docs: DataFrame, drop: Sequence[str] = ("_id",)) -> DataFrame:
    """``field, type, n``: the SQL type that holds every value of a field, and its non-null values.

    Integers and doubles give double; equal kinds stay; text with anything else,
    objects and arrays give string (their JSON text), and so does a field of nulls only.
    """
    seen = (observed_types(docs, drop).groupBy("field")
            .agg(F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type")))).alias("kinds"),
                 F.sum(F.when(F.col("type") != "null", F.col("n")).otherwise(0)).alias("n")))
    kinds = F.array_join("kinds", ",")
    sql_type = (F.when(kinds == "integer", "bigint").when(kinds == "boolean", "boolean")
                .when(kinds.isin("double", "double,integer"), "double").otherwise("string"))
    return seen.select("field", sql_type.alias("type"), "n")


def widened_schema(docs: DataFrame, drop: Sequence[str] = ("_id",)) -> T.StructType:
    """The widened types as a schema, fields by name.  Runs one job; its result is a row a field."""
    found = widened_types(docs, drop).orderBy("field").limit(MAX_FIELDS + 1).collect()
    if len(found) > MAX_FIELDS:
        raise ValueError(f"documents have more than {MAX_FIELDS} fields")
    return T.StructType([T.StructField(r["field"], T.DataType.fromDDL(r["type"])) for r in found])


def _path(name: str) -> str:
    quote = '"' if '"' not in name else "'"
    if quote in name or "\\" in name:
        raise ValueError(f"field name cannot be addressed: {name}")
    return f"$[{quote}{name}{quote}]"


def typed(docs: DataFrame, schema: T.StructType, rest: str | None = "rest") -> DataFrame:
    """Documents as columns of ``schema``; text numbers are parsed.

    ``rest`` maps each field whose value its type cannot hold to that value's JSON
    text, and the empty name to a line that is no document; null where there is nothing.
    """
    cols, kept = [], []
    for f in schema.fields:
        value = F.try_variant_get("doc", _path(f.name), f.dataType.simpleString())
        stored = F.try_variant_get("doc", _path(f.name), "variant")
        lost = value.isNull() & stored.isNotNull() & ~F.is_variant_null(stored)
        cols.append(value.alias(f.name))
        kept.append(F.when(lost, F.struct(F.lit(f.name).alias("key"), F.to_json(stored).alias("value"))))
    if rest is None:
        return docs.select(*cols)
    kept.append(F.when(F.col("doc").isNull(), F.struct(F.lit("").alias("key"), F.col("line").alias("value"))))
    held = F.array_compact(F.array(*kept))
    return docs.select(*cols, F.when(F.size(held) > 0, F.map_from_entries(held)).cast(REST).alias(rest))


def relaxed_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """U1 by name with relaxed types: where one side's column is text and the other's is not,
    both become text (Spark itself would cast the text to a number and fail on other text);
    other types are widened by Spark.  Columns of one side only are null on the other."""
    def text(df: DataFrame, other: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in other.schema.fields}
        as_text = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields
                   if isinstance(types.get(f.name), T.StringType) and not isinstance(f.dataType, T.StringType)}
        return df.withColumns(as_text) if as_text else df

    return text(left, right).unionByName(text(right, left), allowMissingColumns=True)
