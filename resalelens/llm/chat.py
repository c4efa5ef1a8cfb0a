"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, once after every turn.  A rolling
hash over the turns of each conversation (position, role and text go into
every turn's hash; the prefix hash is the running combination of two
independent 64-bit hashes and the prefix length) identifies its prefixes.  A
conversation whose full hash is a *proper prefix* hash of another one is a
snapshot of it and is dropped by an anti-join; of identical conversations the
smallest id stays.  Only the maximal conversations are rendered.

Turns are hashed where they lie: repeats are dropped and prefixes compared on
fixed-size hashes, and equal prefixes (one very common first turn) collapse in partial
aggregates.  Texts move once, from the turns of conversations that a bitmap of
the maximal ones lets pass to the place where they are rendered.  Everything is built-in
DataFrame expressions.

Rendering: turns in turn order, ``<|role|>\\n`` + text + ``\\n<|end|>``, joined
by a line feed.  A role marker inside a text is defused (``<|`` becomes
``< |``), so a turn cannot forge another.

Defined results: a null role is rendered as ``user``, a null text as empty
(both hash as such); rows repeating a turn number are ordered by role and text,
and exact repeats of a turn row count once; a null turn sorts first; a turn with
a null conversation id is a conversation of its own, whose id is null and sorts last
among identical ones; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resalelens.llm.common import KeyFilter, stored


#: A conversation: whether its id is null, its id, and what tells turns without one apart.
KEY = ["no_id", "id", "own"]


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(KEY, turn, role, text, a, b): the turns with two independent hashes."""
    conv, turn = F.col(id_col).cast("long"), F.col(turn_col).cast("long")
    role = F.coalesce(F.col(role_col).cast("string"), F.lit("user"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return conversations.select(
        conv.isNull().alias("no_id"), F.coalesce(conv, F.lit(0)).cast("long").alias("id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), text, role).alias("b")).withColumn(
        "own", F.when(F.col("no_id"), F.xxhash64("turn", "a", "b")).otherwise(0))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(KEY, n, h1, h2, total): the rolling hash after each of the conversation's turns."""
    # One exchange by conversation serves the repeats and both windows.
    body = turns.select(*KEY, "turn", "a", "b").repartition(*KEY).distinct()
    each = W.partitionBy(*KEY).orderBy("turn", "a", "b")
    numbered = body.withColumn("n", F.row_number().over(each)).select(
        *KEY, "n", F.xxhash64("n", "a", F.lit(1)).alias("x"), F.xxhash64(F.lit(2), "b", "n").alias("y"))
    so_far = W.partitionBy(*KEY).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return numbered.select(*KEY, "n", F.bit_xor("x").over(so_far).alias("h1"), F.bit_xor("y").over(so_far).alias("h2"),
                           F.count(F.lit(1)).over(W.partitionBy(*KEY)).alias("total"))


def maximal(turns: DataFrame) -> DataFrame:
    """(KEY, n_turns) of the conversations that are no prefix of a longer one, one per content."""
    p = stored(prefix_hashes(turns), "prefixes")
    key = ["n", "h1", "h2"]
    full = p.where("n = total").groupBy(*key).agg(F.min(F.struct(*KEY)).alias("k"))
    longer = p.where("n < total").select(*key).distinct()
    return full.join(longer, key, "left_anti").select("k.*", F.col("n").cast("long").alias("n_turns"))


def render(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, chat) of the maximal conversations."""
    turns = _turns(conversations, id_col, turn_col, role_col, text_col)
    keep = stored(maximal(turns), "maximal")
    place = F.xxhash64(*KEY)
    kept = KeyFilter(keep, place, keep.count()).maybe(turns, place).join(keep, KEY)
    safe = F.replace("text", F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|"), F.replace("role", F.lit("|>"), F.lit("| >")), F.lit("|>\n"), safe, F.lit("\n<|end|>"))
    return (kept.groupBy(*KEY).agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_set(F.struct("turn", "a", "b", line.alias("line")))).alias("t"))
            .select(F.when(~F.col("no_id"), F.col("id")).alias("conv_id"), "n_turns", F.array_join("t.line", "\n").alias("chat")))


#: DuckDB text for the same rows (ids and turns present, one row per turn).
SQL = """
with t as (select distinct conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations),
c as (select conv_id, count(*) as n_turns,
    list({'role': role, 'text': text} order by turn) as turns,
    string_agg('<|' || replace(role, '|>', '| >') || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>', chr(10) order by turn) as chat
    from t group by conv_id),
p as (select c.conv_id, c.n_turns, c.turns[1:k.n] as head, k.n as n from c, unnest(range(1, c.n_turns + 1)) as k(n)),
longer as (select distinct head from p where n < n_turns),
one as (select turns, min(conv_id) as conv_id from c group by turns)
select c.conv_id, c.n_turns, c.chat from c join one using (conv_id)
where c.turns not in (select head from longer)
"""
