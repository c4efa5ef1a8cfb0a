"""Line dedup with content-defined chunks.

The lines of a text are cut where the *content* says so: a line is a boundary if
its own hash, or a rolling hash over it and the line before, falls into a dense
class (all but ``SPARSE`` of 256 values); the first and the last line of a text are
boundaries too.  A chunk runs from a boundary to the next one, both included,
so it has two lines or more and shares an end line with its neighbours.  Whether a
line is a boundary depends on two lines at most, so a passage is cut at the same places
wherever it is inserted; and as chunks reach up to the next boundary, a passage of two lines
is a whole chunk if its first line is a boundary by its own hash (15 in 16) and its
second by either hash.  A line of more than ``LONG_LINE`` words is a chunk by itself.

Chunks that hold a word are counted by SHA-256 digest over the whole corpus
(partial counts per task, digests only).  Of a repeated chunk the first
occurrence -- smallest (id, text hash, line) -- stays; the lines of every other one
are removed after its text has been compared, byte for byte, with the text of
the first.  (So the first occurrence of a line in the corpus always stays.)  Only
rows with a repeated digest meet in that comparison, and only documents that may lose
a line are shuffled to be rewritten: bitmaps of bounded size (``common.KeyFilter``)
hold all others back.

Everything is built-in DataFrame expressions.

Defined results: a null text stays null and has no lines; rows that repeat an
(id, text) get the same result, as one document; a null id sorts first; short texts
of one line never change, a text of one long line that occurred before becomes empty;
an empty table gives no rows; the other columns of the documents are returned
untouched by ``drop_repeated_chunks``.

``drop_repeated_passages`` is the limit of that rule: every line is a boundary, so every
two adjacent lines are a chunk, and digests alone are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import KeyFilter, discard, let, stored

#: Of 256 hash values, those that are no boundary.
SPARSE = 16
#: A line of more words is a passage by itself.
LONG_LINE = 50
_WORD = r"[^\x20\x09-\x0D]"
#: More than LONG_LINE words, in one pass without going back.
_LONG = rf"^[\x20\x09-\x0D]*+(?:{_WORD}++[\x20\x09-\x0D]++){{{LONG_LINE}}}{_WORD}"


def _is_long(line: Column) -> Column:
    return F.when(F.length(line) > 2 * LONG_LINE, F.rlike(line, F.lit(_LONG))).otherwise(F.lit(False))


def _hex_limit(sparse: int) -> str:
    """Two hex digits; a hash is in the dense class from there on."""
    return f"{sparse:02x}"


def chunks(text: Column, sparse: int = SPARSE, with_text: bool = True) -> Column:
    """Array of the chunks of a text in order, as (no, size, digest, chunk): ``size`` lines from line ``no`` on.

    ``chunk`` is their text (not there without ``with_text``).  Chunks without a word are left out.
    """
    found = _cuts(text, sparse)
    return _with_text(text, found) if with_text else found


def _with_text(text: Column, found: Column) -> Column:
    """The chunks ``found`` of a text with their own texts."""
    return let(F.split(text, "\n"), lambda lines: F.transform(found, lambda u: F.struct(
        u["no"].alias("no"), u["size"].alias("size"), u["digest"].alias("digest"),
        F.array_join(F.slice(lines, u["no"] + 1, u["size"]), "\n").alias("chunk"))))


def _cuts(text: Column, sparse: int) -> Column:
    def dense(sha: Column) -> Column:
        return F.substring(sha, 1, 2) >= _hex_limit(sparse)

    def cut(lines: Column) -> Column:
        def hashed(x: Column) -> Column:
            return F.struct(F.sha2(x, 256).alias("sha"), F.rlike(x, F.lit(_WORD)).alias("word"), _is_long(x).alias("long"))

        def pieces(h: Column) -> Column:
            last = F.size(h) - 1

            def boundary(i: Column) -> Column:
                return (i == 0) | (i == last) | dense(F.get(h, i)["sha"]) | dense(F.sha2(F.concat(F.get(h, i - 1)["sha"], F.get(h, i)["sha"]), 256))

            def of(at: Column) -> Column:
                def one(i: Column, k: Column) -> Column:
                    size = F.get(at, k + 1) - i + 1
                    part = F.slice(h, i + 1, size)
                    return F.when(size > 1, F.struct(
                        i.alias("no"), size.alias("size"), F.unhex(F.sha2(F.array_join(part["sha"], ""), 256)).alias("digest"),
                        F.exists(part, lambda x: x["word"]).alias("word")))

                # Each long line, wherever the cuts are.
                longs = F.filter(F.transform(h, lambda x, i: F.when(x["long"], F.struct(
                    i.alias("no"), F.lit(1).alias("size"), F.unhex(x["sha"]).alias("digest"), F.lit(True).alias("word")))), lambda u: u.isNotNull())
                return F.concat(F.filter(F.transform(at, one), lambda u: u.isNotNull() & u["word"]), longs)

            return let(F.filter(F.sequence(F.lit(0), last), boundary), of)

        return let(F.transform(lines, hashed), pieces)

    return let(F.split(text, "\n"), cut)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, gone, chunks): the lines to remove from each document that has any, and how many chunks they are.

    Written once; the copy of the texts that it is made from is deleted then."""
    text = F.col(text_col).cast("string")
    # Lines are hashed once; the texts lie beside their cuts for the passes that need a chunk's text.
    cut = stored(docs.where(text.isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"),
        chunks(text, with_text=False).alias("cuts")), "cuts")
    rows = cut.select("doc_id", "text_hash", F.inline(_with_text(F.col("text"), F.col("cuts"))))
    at = F.struct("doc_id", "text_hash", "no", "size")
    # One document repeated as a row is one occurrence: first == last then.
    often = stored(cut.select("doc_id", "text_hash", F.inline("cuts")).groupBy("digest")
                   .agg(F.min(at).alias("first"), F.max(at).alias("last"))
                   .where(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first"), "digests")
    n = often.count()
    # The text of each first occurrence, fetched by its place, one a digest.
    place = F.xxhash64("doc_id", "text_hash", "no", "size")
    some = KeyFilter(often.select("first.*"), place, n).maybe(rows, place)
    firsts = stored(some.join(often.hint("merge"), "digest").where(at.eqNullSafe(F.col("first")))
                    .groupBy("digest").agg(F.first("first").alias("first"), F.first("chunk").alias("first_chunk")), "firsts")
    # Texts of chunks that occur once stay where they are: a bitmap of the
    # repeated digests holds them back before the one shuffle of texts.
    key = F.xxhash64("digest")
    met = KeyFilter(often, key, n).maybe(rows, key).join(firsts.hint("merge"), "digest")
    gone = met.where(~at.eqNullSafe(F.col("first")) & (F.col("chunk") == F.col("first_chunk")))
    spans = gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("no", "size")).alias("spans"))
    lost = stored(spans.select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["no"], s["no"] + s["size"] - 1)))).alias("gone"), F.size("spans").alias("chunks")), "gone")
    discard(cut, firsts)
    return lost


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         n_chars_col: str | None = None, counts: bool = False) -> DataFrame:
    """``docs`` with repeated chunks removed from the texts.

    ``n_chars_col`` names a character count to bring up to date where a text
    changed.  ``counts`` adds the numbers of removed chunks and lines
    (``n_chunks_gone``, ``n_lines_gone``) as last columns.
    """
    gone = repeated_chunks(docs, id_col, text_col).select(
        "doc_id", "text_hash", F.struct("gone", "chunks").alias("gone"))

    def left(text: Column) -> Column:
        return let(F.split(text, "\n"), lambda lines: let(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone.gone")),
            lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
                                  F.col("gone.chunks").alias("chunks"), (F.size(lines) - F.size(kept)).alias("lines"))))

    return _rewritten(docs, gone, left, id_col, text_col, n_chars_col, ["chunks", "lines"] if counts else [])


def _rewritten(docs: DataFrame, gone: DataFrame, left: Callable[[Column], Column], id_col: str, text_col: str,
               n_chars_col: str | None, counts: list[str]) -> DataFrame:
    """``docs`` with ``left(text)["text"]`` for the texts in ``gone`` (doc_id, text_hash, gone); its
    fields ``counts`` are added as ``n_<field>_gone``."""
    kind = gone.schema["gone"].dataType
    n = gone.count()
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "gone")
    names = [f"d{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    text = F.col(at[text_col]).cast("string")
    # Only texts that may lose lines are shuffled; the others pass as they are.
    rows = docs.toDF(*names).withColumn("t_hash", F.xxhash64(text))
    changed = KeyFilter(gone, F.col("g_hash"), n)
    joined = (changed.maybe(rows, F.col("t_hash"))
              .join(gone, F.col(at[id_col]).eqNullSafe(F.col("g_id")) & (F.col("t_hash") == F.col("g_hash")), "left")
              .drop("g_id", "g_hash")
              .unionByName(changed.surely_not(rows, F.col("t_hash")).withColumn("gone", F.lit(None).cast(kind))))
    joined = joined.withColumn("new", F.when(F.col("gone").isNotNull(), left(text)))
    out = [F.coalesce("new.text", text).alias(c) if c == text_col
           else F.when(F.col("new").isNotNull(), F.length("new.text").cast(docs.schema[c].dataType)).otherwise(F.col(n)).alias(c)
           if c == n_chars_col else F.col(n).alias(c) for c, n in at.items()]
    out += [F.coalesce(f"new.{c}", F.lit(0)).cast("long").alias(f"n_{c}_gone") for c in counts]
    return joined.select(*out)


def _units(text: Column) -> Column:
    """Array of (no, size, digest) of a text: its units, ``size`` lines from line ``no`` on."""
    def unit(no: Column, size: int, digest: Column, wanted: Column) -> Column:
        return F.when(wanted, F.struct(no.alias("no"), F.lit(size).alias("size"), F.unhex(digest).alias("digest")))

    def of(lines: Column) -> Column:
        h = F.transform(lines, lambda x: F.struct(F.sha2(x, 256).alias("sha"), F.rlike(x, F.lit(_WORD)).alias("word"),
                                                  _is_long(x).alias("long")))

        def units(h: Column) -> Column:
            # Digests have one length, so a pair's digest stands for both lines in order.
            def here(x: Column, i: Column) -> Column:
                y = F.get(h, i + 1)
                return F.array(unit(i, 2, F.sha2(F.concat(x["sha"], y["sha"]), 256), y.isNotNull() & (x["word"] | y["word"])),
                               unit(i, 1, x["sha"], x["long"]))

            return F.filter(F.flatten(F.transform(h, here)), lambda u: u.isNotNull())

        return let(h, units)

    return let(F.split(text, "\n"), of)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, gone): the lines (numbered from 0) to remove from each document that has any."""
    text = F.col(text_col).cast("string")
    rows = (docs.where(text.isNotNull())
            .select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.inline(_units(text))))
    at = F.struct("doc_id", "text_hash", "no")
    often = stored(rows.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("last"))
                   .where(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "first"), "units")
    key = F.xxhash64("digest")
    later = (KeyFilter(often, key, often.count()).maybe(rows, key).join(often, "digest")
             .where(~at.eqNullSafe(F.col("first"))))
    spans = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("no", "size")).alias("spans"))
    return spans.select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["no"], s["no"] + s["size"] - 1)))).alias("gone"))


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           n_chars_col: str | None = None, counts: bool = False) -> DataFrame:
    """``docs`` without the lines of repeated passages; parameters as ``drop_repeated_chunks``
    (``counts`` adds ``n_lines_gone``)."""
    gone = stored(repeated_passages(docs, id_col, text_col), "gone")

    def left(text: Column) -> Column:
        return let(F.split(text, "\n"), lambda lines: let(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")),
            lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
                                  (F.size(lines) - F.size(kept)).alias("lines"))))

    return _rewritten(docs, gone, left, id_col, text_col, n_chars_col, ["lines"] if counts else [])


#: DuckDB text for ``(doc_id, text, n_chunks_gone, n_lines_gone)`` of table ``{docs}``.
#: Needs distinct ids (the hash that orders equal ids is Spark's).
SQL = """
with l as (select doc_id, u.i as i, u.line as line, sha256(u.line) as s from (
    select doc_id, unnest([{{'i': k, 'line': string_split(text, chr(10))[k]}} for k in range(1, len(string_split(text, chr(10))) + 1)]) as u
    from {docs} where text is not null)),
b as (select doc_id, i, lead(i) over w as j from (
    select *, substr(s, 1, 2) >= '10' or coalesce(substr(sha256(lag(s) over w || s), 1, 2) >= '10', false)
        or lag(i) over w is null or lead(i) over w is null as cut from l window w as (partition by doc_id order by i)) where cut
    window w as (partition by doc_id order by i)),
p as (select b.doc_id, b.i, b.j - b.i + 1 as size, string_agg(l.line, chr(10) order by l.i) as unit
    from b join l on b.doc_id = l.doc_id and l.i between b.i and b.j group by b.doc_id, b.i, b.j
    union all select doc_id, i, 1, line from l where len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50),
k as (select *, row_number() over (partition by unit order by doc_id, i) as rn from p where regexp_matches(unit, '[^\\x20\\x09-\\x0D]')),
c as (select doc_id, count(*) as n from k where rn > 1 group by doc_id),
g as (select distinct doc_id, unnest(range(i, i + size)) as i from k where rn > 1),
x as (select l.doc_id, string_agg(line, chr(10) order by l.i) filter (g.i is null) as text, count(g.i) as n
    from l left join g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(x.text, '') end as text,
    cast(coalesce(c.n, 0) as bigint) as n_chunks_gone, cast(coalesce(x.n, 0) as bigint) as n_lines_gone
from {docs} d left join x on d.doc_id = x.doc_id left join c on d.doc_id = c.doc_id
"""

#: DuckDB text for ``(doc_id, text, n_lines_gone)`` of table ``{docs}`` by repeated passages; needs distinct ids.
PASSAGE_SQL = """
with l as (select doc_id, u.i as i, u.line as line from (
    select doc_id, unnest([{{'i': k, 'line': string_split(text, chr(10))[k]}} for k in range(1, len(string_split(text, chr(10))) + 1)]) as u
    from {docs} where text is not null)),
p as (select doc_id, i, 2 as size, line || chr(10) || lead(line) over (partition by doc_id order by i) as unit from l
    union all select doc_id, i, 1, line from l where len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50),
k as (select *, row_number() over (partition by unit order by doc_id, i) as rn from p where regexp_matches(unit, '[^\\x20\\x09-\\x0D]')),
g as (select distinct doc_id, unnest(range(i, i + size)) as i from k where rn > 1),
x as (select l.doc_id, string_agg(line, chr(10) order by l.i) filter (g.i is null) as text, count(g.i) as n
    from l left join g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(x.text, '') end as text, cast(coalesce(x.n, 0) as bigint) as n_lines_gone
from {docs} d left join x on d.doc_id = x.doc_id
"""
