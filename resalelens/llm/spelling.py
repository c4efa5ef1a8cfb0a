"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into
the other, that is if their common prefix and common suffix together reach the
longer length minus one.  Which words meet is decided without loss:

* a word of ``m`` code points is cut into segments of ``SEGMENT`` (at most
  ``MOST_SEGMENTS`` segments, longer ones in long words).  If a word is one edit
  from one of its length or one longer, the edit falls into one segment:
  everything before it is a common prefix, everything after it a common suffix;
* so a word belongs, for ``m`` its length and its length minus one, to one block
  for each segment: the words that agree in ``m``, the segment's number and all
  code points before and after it (128-bit hash).  What is left of a word in a
  block -- its tile -- has the segment's length, or one more;
* a block's tiles are rows of a padded code-point matrix.  Dense comparisons of
  the matrix with itself give the common prefixes and suffixes of all its pairs: at
  growing row distance, many blocks at once, where blocks are small, and tile
  against tile where they are large.  A pair counts only in the block whose segment
  holds the end of its common prefix, hence once.

A block of tiles of two letters has at most as many words as there are pairs, and for
the words one longer triples, of letters, however large the vocabulary.  No
pair leaves the comparison: each word takes its number of near words and the best
of them, which are added up by word.

Defined results: null and empty texts have no words; repeated rows count as often as
they occur; a null document id is hashed as an empty text; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import lower_ascii, stored

LETTERS = "[A-Za-zÀ-ÿ]+"
SLIP = 97  # one word in so many loses a code point
MIN_LENGTH = 5
MIN_COUNT = 3
SEGMENT = 2
MOST_SEGMENTS = 16
SMALL_BLOCK = 48
TILE = 256


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, slip: int = SLIP,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of the texts, A-Z lower-cased.

    A run of letters whose hash with the document's id ``slip`` divides loses one
    code point (``slip=0``: none does).
    """
    run, h, k = F.col("run"), F.col("h"), F.col("k")
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(letters), F.lit(0))).alias("run"))
    # Letters beyond ASCII keep their case.
    low = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(lower_ascii(run))
    found = found.where(F.length(run) >= min_length).select("id", low.alias("run"))
    if slip:
        found = found.withColumn("h", F.crc32(F.concat("id", F.lit(":"), run).cast("binary")))
        found = found.withColumn("k", F.when(h % slip == 0, (h % F.length(run)).cast("int")))
        found = found.select(F.when(k.isNull(), run).otherwise(
            F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).alias("run"))
    return (found.where(F.length(run) >= min_length).groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def blocks(words: DataFrame) -> DataFrame:
    """(h1, h2, m, last, width, tile, word, n): every word once for each of its blocks.

    ``last`` marks a word's last segment, ``width`` is the segment's length.
    """
    word, length = F.col("word"), F.length("word")

    def of(m: Column) -> Column:
        wide = F.greatest(F.lit(SEGMENT), F.ceil(m / MOST_SEGMENTS)).cast("int")

        def one(j: Column) -> Column:
            begin, end = j * wide, F.least((j + 1) * wide, m)
            before = F.substring(word, F.lit(1), begin)
            after = F.substring(word, length - (m - end) + 1, length)
            return F.struct(F.xxhash64(m, j, before, after).alias("h1"), F.xxhash64(after, F.lit("block"), j, before, m).alias("h2"),
                            m.alias("m"), (end == m).alias("last"), (end - begin).alias("width"),
                            F.substring(word, begin + 1, end - begin + length - m).alias("tile"))

        return F.transform(F.sequence(F.lit(0), F.ceil(m / wide).cast("int") - 1), one)

    lengths = F.filter(F.array(length, length - 1), lambda m: m > 0)
    return words.select("word", "n", F.inline(F.flatten(F.transform(lengths, of)))).select(
        "h1", "h2", "m", "last", "width", "tile", "word", "n")


def _matrix(tiles: list[str], back: bool) -> np.ndarray:
    """Code points of the tiles, one row each (last first with ``back``), padded with zeros.

    There is a column of zeros at the end, and no tile has a code point zero.
    """
    size = np.fromiter(map(len, tiles), np.int64, len(tiles))
    flat = np.frombuffer("".join([t[::-1] for t in tiles] if back else tiles).encode("utf-32-le"), "<u4")
    out = np.zeros((len(tiles), int(size.max()) + 1), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


class _Rows:
    """Rows of whole blocks; numbers of near words and the best of them (the first in the block)."""

    def __init__(self, block: np.ndarray, m: np.ndarray, last: np.ndarray, width: np.ndarray, tiles: list[str]):
        self.size = np.fromiter(map(len, tiles), np.int64, len(tiles))
        self.longer = self.size > width
        self.last, self.width, self.block = last, width, block
        self.front, self.back = _matrix(tiles, False), _matrix(tiles, True)
        self.near = np.zeros(len(tiles), np.int64)
        self.best = np.full(len(tiles), len(tiles), np.int64)
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        count = np.diff(np.append(begin, len(block)))
        small = np.repeat(count <= SMALL_BLOCK, count)
        for d in range(1, min(SMALL_BLOCK, len(tiles))):
            a = np.flatnonzero(small[:-d] & (block[:-d] == block[d:]))
            if not len(a):
                break
            self._meet(a, a + d, self._hits(a, a + d))
        for at, n in zip(begin[count > SMALL_BLOCK].tolist(), count[count > SMALL_BLOCK].tolist()):
            rows = np.arange(at, at + n)
            for i in range(0, n, TILE):
                for j in range(i, n, TILE):
                    a, b = rows[i:i + TILE, None], rows[None, j:j + TILE]
                    x, y = np.nonzero(self._hits(a, b) & (a < b))
                    self._meet(x + at + i, y + at + j, np.ones(len(x), bool))

    def _hits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows ``a`` and ``b`` (arrays that broadcast) of a block are near, and the pair counts here."""
        prefix = (self.front[a] != self.front[b]).argmax(-1)
        suffix = (self.back[a] != self.back[b]).argmax(-1)
        return ((prefix + suffix >= np.maximum(self.size[a], self.size[b]) - 1)
                & ~(self.longer[a] & self.longer[b]) & (self.last[a] | (prefix < self.width[a])))

    def _meet(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> None:
        a, b = a[hit], b[hit]
        np.add.at(self.near, a, 1)
        np.add.at(self.near, b, 1)
        np.minimum.at(self.best, a, b)
        np.minimum.at(self.best, b, a)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): the number of near words and the one that occurs most
    (ties: the smallest) of each word of (word, n) that has any."""
    placed = blocks(words).repartition("h1", "h2").sortWithinPartitions("h1", "h2", "m", F.desc("n"), "word")

    def run(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            # The last block may go on in the next batch.
            h1, h2 = (rows.column(i).to_numpy() for i in (0, 1))
            mine = (h1 == h1[-1]) & (h2 == h2[-1])
            at = int(len(mine) - mine.sum())
            held = rows.slice(at)
            if at:
                yield _compared(rows.slice(0, at))
        if held is not None and len(held):
            yield _compared(held)

    best = F.min(F.struct(-F.col("form_n"), F.col("form").alias("form")))
    found = placed.mapInArrow(run, "word string, n_near long, form string, form_n long")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.col1")).alias("form_n")))


def _compared(rows: pa.Table) -> pa.RecordBatch:
    h1, h2, m, last, width = (rows.column(i).to_numpy() for i in range(5))
    # Equal hashes are one block; the lengths in it agree.
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    block = np.cumsum(new)
    alone = np.append(new[1:], True) & new
    keep = np.flatnonzero(~alone)
    if not len(keep):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.string(), pa.int64(), pa.string(), pa.int64())],
                                          ["word", "n_near", "form", "form_n"])
    rows = rows.take(pa.array(keep))
    got = _Rows(block[keep], m[keep], last[keep], width[keep], rows.column(5).to_pylist())
    hit = np.flatnonzero(got.near)
    word, n = rows.column(6).combine_chunks(), rows.column(7).to_numpy()
    if isinstance(word, pa.ChunkedArray):
        word = pa.concat_arrays(word.chunks)
    best = got.best[hit]
    return pa.RecordBatch.from_arrays(
        [word.take(pa.array(hit)).cast(pa.string()), pa.array(got.near[hit]), word.take(pa.array(best)).cast(pa.string()), pa.array(n[best])],
        ["word", "n_near", "form", "form_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead in the end.

    Forms must not lead in a circle.  Each round doubles the steps that are followed.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("s_word"), F.col("root").alias("s_root"))
        now = stored(now.join(step, F.col("root") == F.col("s_word"), "left")
                     .select("word", F.coalesce("s_root", "root").alias("root"), F.col("s_root").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    ``form`` is the near word that occurs most, if it occurs at least twice as often;
    ``root`` is where forms lead in the end, the word itself where it has none.
    """
    words = stored(word_counts(docs, id_col, text_col, slip=slip), "words")
    near = near_words(words).select(F.col("word").alias("v_word"), "n_near", F.col("form").alias("v_form"), F.col("form_n").alias("v_n"))
    leads = F.col("v_n") >= 2 * F.col("n")
    joined = stored(words.join(near, F.col("word") == F.col("v_word"), "left").select(
        "word", F.when(leads, F.col("v_form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("v_n")).alias("form_n")), "forms")
    root = roots(joined.where("form is not null").select("word", "form")).select(F.col("word").alias("r_word"), "root")
    return (joined.join(root, F.col("word") == F.col("r_word"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
