"""Corpus pipeline: documents -> packed training sequences.

``STAGES`` lists (name, function) in order; each function takes
``(spark, docs, sf_dir)``, where ``docs`` is what the stage before it kept, and
returns a DataFrame.  ``run`` applies them to ``documents``, writing each
stage's rows to the shared checkpoint folder and reading them again.  All but
the last stage return the columns of ``documents``.

1. ``quality``     documents that the weakly supervised rules reject go;
2. ``line_dedup``  repeated chunks of two lines or more, or of one long line,
                   are cut out of the texts (``n_chars`` follows); documents
                   stay, if need be empty;
3. ``simhash``     one document of each near-duplicate group stays;
4. ``mixing``      sources are drawn to their target weights: a document is
                   returned once per copy;
5. ``packing``     the token ids of the documents, packed into sequences: one
                   row per piece with its ids.

Nulls, empty texts, repeated rows, empty tables and extra columns are handled
as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resalelens.llm import line_dedup, mixing, packing, quality, simhash
from resalelens.llm.common import stored, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_chunks(docs, n_chars_col="n_chars")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, SimHash and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stored(stage(spark, rows, sf_dir), name)
    return rows
