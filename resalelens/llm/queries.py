"""Registered queries of the training-data operators (one per operator) and the pipeline."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from resalelens.llm import (chat, cross_tokens, exact_dedup, language_id, line_dedup, mixing, packing, pii, quality,
                            simhash, spelling, token_files, url_filter)
from resalelens.llm.common import table, temporary_path
from resalelens.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@query("op1_url_filter", """
with u as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
r(v, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
d as (select distinct host, path from u),
b as (select d.host, d.path, arg_max(r.h || r.p, length(r.h || r.p)) as rule, arg_max(r.v, length(r.h || r.p)) as v
    from d join r on ('.' || d.host) like ('%.' || r.h) and starts_with(d.path, r.p) group by d.host, d.path)
select u.page_id, u.host, u.path, b.rule, coalesce(b.v, 'allow') as verdict
from u left join b on u.host = b.host and u.path = b.path
""")
def op1_url_filter(spark, d):
    pages = table(spark, d, "pages")
    return (url_filter.filter_pages(pages, url_filter.rules_frame(spark, URL_RULES))
            .select("page_id", "host", "path", "rule", "verdict"))


@query("op2_packing")
def op2_packing(spark, d):
    packed = packing.pack_documents(table(spark, d, "documents"), corpus_pipeline.tokenizer_path(),
                                    payload={"ids_crc32": F.crc32})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op3_simhash")
def op3_simhash(spark, d):
    near = simhash.near_duplicates(table(spark, d, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_line_dedup", line_dedup.SQL.format(docs="documents"))
def op4_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_chunks(docs, counts=True)


@query("op4_passage_dedup", line_dedup.PASSAGE_SQL.format(docs="documents"))
def op4_passage_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_passages(docs, counts=True)


@query("op5_pii")
def op5_pii(spark, d):
    return pii.replace_pii(table(spark, d, "documents"))


@query("op6_chat", chat.SQL)
def op6_chat(spark, d):
    return chat.render(table(spark, d, "conversations"))


@query("op7_exact_dedup", """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
    from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
    row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from t window w as (partition by text_sha256)
""")
def op7_exact_dedup(spark, d):
    groups = exact_dedup.exact_groups(table(spark, d, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op8_quality")
def op8_quality(spark, d):
    return quality.assess(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op9_mixing", mixing.SQL)
def op9_mixing(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"), carry=["doc_id"])
    return mixed.select(F.col("c0").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_language_id")
def op10_language_id(spark, d):
    docs = table(spark, d, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark, d):
    path = corpus_pipeline.tokenizer_path
    aligned = cross_tokens.align(
        table(spark, d, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"),
        payload={"groups_sha256": lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))})
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_token_files")
def op12_token_files(spark, d):
    path = temporary_path(spark, "token-files")
    token_files.write(table(spark, d, "documents"), path, corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark, d):
    return spelling.variants(table(spark, d, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, d):
    return corpus_pipeline.run(spark, os.fspath(d))
