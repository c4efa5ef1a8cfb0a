"""URL filter: host-suffix / path-prefix expressions joined on short hash prefixes.

Every URL is expanded into ``host suffix + path up to a slash`` expressions, as deep as
the rules go (most labels of a host, most slashes of a path: a one-row aggregate);
every rule has one such key (its path up to the last slash).  Both sides meet
in an equi-join on the first 32 bits of the SHA-256 of the expression; a match
counts only if the full digests are equal and the URL's path starts with the
whole rule path.  Of several matches the longest rule wins (host + path in
characters; at equal length ``block`` before ``allow``).

The work is done once per distinct URL (a popular URL collapses before the
shuffle); the size of the rule set decides the join: small rule tables are
broadcast by Spark's own size check, large ones are shuffled on the prefix,
where adaptive execution splits a prefix that most URLs carry (``net/``).

Defined results: a null URL, or one without ``://``, has empty host and path
and matches no rule; an empty page table gives no rows; repeated rows each
keep their row; extra columns are not read.  A rule with an empty host or a
null part fits nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import lower_ascii

PREFIX_HEX = 8  # hash prefix length in hex digits (32 bits)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(after)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _host_suffixes(host: Column, labels: int) -> Column:
    """The host's suffixes of at most ``labels`` labels."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)]))


def _path_prefixes(path: Column, slashes: int) -> Column:
    """The empty prefix of the path, and those that end in one of its first ``slashes`` slashes."""
    has = F.size(F.split(path, "/", slashes + 1)) - 1
    ends = [F.when(has >= k, F.concat(F.substring_index(path, "/", k), F.lit("/"))) for k in range(1, slashes + 1)]
    return F.filter(F.array(F.lit(""), *ends), lambda p: p.isNotNull())


def _depth(rules: DataFrame) -> tuple[int, int]:
    """Most labels of a rule's host and most slashes of a rule's path: no URL needs to be expanded further."""
    r = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")) - 1)).first()
    return r[0] or 1, r[1] or 0


def rules_frame(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as (verdict, host, path) rows."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Distinct URLs with ``host``, ``path``, winning ``rule`` and ``verdict``.

    ``rules`` has ``verdict, host, path``.  URLs no rule fits get a null rule
    and the ``default`` verdict.
    """
    u = urls.select(F.col(url_col).alias("url")).distinct().select(
        "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    r = (rules.where("verdict is not null and host is not null and host != '' and path is not null")
         .select("verdict", lower_ascii(F.col("host")).alias("host"), "path").distinct()
         .select(F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"),
                 F.concat("host", "path").alias("rule"),
                 F.sha2(F.concat("host", F.regexp_extract("path", r"(?s)^(.*/)?", 0)), 256).alias("r_digest"))
         .withColumn("r_short", F.substring("r_digest", 1, PREFIX_HEX)))
    labels, slashes = _depth(r)
    expr = (u.where(F.col("host") != "")
            .select("url", "host", "path", F.explode(_host_suffixes(F.col("host"), labels)).alias("suffix"))
            .select("url", "path", "suffix", F.explode(_path_prefixes(F.col("path"), slashes)).alias("prefix"))
            .select("url", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
            .withColumn("short", F.substring("digest", 1, PREFIX_HEX)))
    fits = (expr.join(r, F.col("short") == F.col("r_short"))
            .where((F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path"))))
    rank = F.struct(F.length("rule"), F.col("r_verdict") == "block", F.col("rule"))
    won = fits.groupBy("url").agg(
        F.max(F.struct(rank.alias("rank"), F.col("rule").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("w"))
    hit = won.select(F.col("url").alias("hit_url"), F.col("w.rule").alias("rule"), F.col("w.verdict").alias("verdict"))
    return (u.join(hit, F.col("url") == F.col("hit_url"), "left")
            .select("url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def filter_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 default: str = "allow") -> DataFrame:
    """One row per page: id, url, host, path, rule, verdict."""
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("page_url"))
    judged = judge_urls(pages, rules, url_col, default).where("rule is not null").select("url", "rule", "verdict")
    return (p.join(judged, F.col("page_url") == F.col("url"), "left")
            .select(F.col("id").alias(id_col), F.col("page_url").alias(url_col),
                    url_host(F.col("page_url")).alias("host"), url_path(F.col("page_url")).alias("path"),
                    "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
