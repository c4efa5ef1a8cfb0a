"""Quality rules combined by weak supervision.

Each rule of ``RULES`` looks at the measures of a text and votes good (1), bad
(0) or abstains (null).  No rule decides alone: expectation-maximisation over
the votes of all documents estimates the prior and, for each rule, how often
it votes good on good and on bad documents; the posterior probability of being
good then replaces the usual all-must-pass filter.

All measures are built-in column expressions of one row.  The votes of all
documents are reduced to counts per vote pattern -- at most 3 ** len(RULES)
rows (2187), whatever the corpus -- and the EM rounds run on that small table.

``base_failed`` is a fixed floor beside the votes: fewer than 20 words, or more
than 30 % of the words inside 8-word windows that occur at least twice.

Defined results: null and blank texts have no words, fail the base and are not
kept; repeated rows get equal results; an empty table gives no rows (and the
starting model); extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.llm.common import let, stored, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_AT = 0.5
EM_ROUNDS = 25


@dataclass(frozen=True)
class Rule:
    """Votes good below ``good``, bad from ``bad`` on, abstains between (of ``num`` / ``den``)."""

    name: str
    num: str
    den: str
    good: float
    bad: float

    def vote(self, m: Column) -> Column:
        ratio = m[self.num] / F.greatest(m[self.den], F.lit(1))
        return F.when(m["n_words"] == 0, F.lit(None)).when(ratio < self.good, 1).when(ratio >= self.bad, 0)


#: Ratios of the measures; thresholds follow common web-text heuristics.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.03, 0.10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.15, 0.30),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.10, 0.20),
    Rule("long_words", "word_chars", "n_words", 10.0, 14.0),
    Rule("shouting", "n_upper", "word_chars", 0.15, 0.40),
    Rule("exclamations", "n_bangs", "n_words", 0.05, 0.20),
    Rule("other_characters", "n_other", "word_chars", 0.08, 0.13),
)


def _paired(h: Column, step: int) -> Column:
    """Hash of the windows of twice the width: h[i] with h[i + step]."""
    return F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - step, F.lit(0))),
                      F.slice(h, F.lit(1 + step), F.greatest(F.size(h) - step, F.lit(0))),
                      lambda a, b: F.xxhash64(a, b))


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: one sort by (hash,
    position), then the gaps between repeated positions, at most a window each."""
    def hits(at: Column) -> Column:
        def repeated(x: Column, j: Column) -> Column:
            same = F.coalesce(F.get(at, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(at, j + 1)["h"] == x["h"], F.lit(False))
            return F.when(same, x["i"])

        return F.sort_array(F.filter(F.transform(at, repeated), lambda i: i.isNotNull()))

    def total(found: Column) -> Column:
        gaps = F.transform(found, lambda p, j: F.least(F.coalesce(F.get(found, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(at, hits), total)


def measure(text: Column) -> Column:
    """Struct of the measures of one text (all long)."""
    def of_words(t: Column, w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
                lambda l: F.struct(F.size(l).cast("long").alias("all"),
                                   (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("dup"))).alias("lines"),
            let(_window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .otherwise(_covered(h))).alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit("!")).cast("long").alias("n_bangs"),
            F.length(F.regexp_replace(t, r"[\p{L}\p{M}\s]+", "")).cast("long").alias("n_other"))

    def flat(m: Column) -> Column:
        return F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
                        m["lines"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
                        m["lines"]["all"].alias("n_lines"), *[m[c].alias(c) for c in ("n_upper", "n_bangs", "n_other")])

    return let(F.coalesce(text.cast("string"), F.lit("")),
               lambda t: let(let(words(t), lambda w: of_words(t, w)), flat))


def _window_hashes(w: Column) -> Column:
    """Hash of every ``WINDOW``-word window, built by doubling (1, 2, 4, 8 words)."""
    h = F.transform(w, lambda x: F.xxhash64(x))
    for step in (1, 2, 4):
        h = let(h, lambda x, step=step: _paired(x, step))
    return h


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def votes(m: Column) -> Column:
    """The votes as one struct column."""
    return F.struct(*[r.vote(m).alias(r.name) for r in RULES])


@dataclass
class VoteModel:
    """P(good) and, per rule, P(votes good | good) and P(votes good | bad)."""

    prior: float
    good: list[float]
    bad: list[float]

    def posterior(self, votes: Column) -> Column:
        """Probability of being good given the votes (abstentions carry none)."""
        on_good, on_bad = F.lit(self.prior), F.lit(1.0 - self.prior)
        for r, g, b in zip(RULES, self.good, self.bad):
            x = votes[r.name]
            on_good = on_good * F.when(x == 1, g).when(x == 0, 1.0 - g).otherwise(1.0)
            on_bad = on_bad * F.when(x == 1, b).when(x == 0, 1.0 - b).otherwise(1.0)
        return on_good / (on_good + on_bad)

    def weigh(self, votes: tuple) -> float:
        """The same probability for one vote pattern."""
        on_good, on_bad = self.prior, 1.0 - self.prior
        for x, g, b in zip(votes, self.good, self.bad):
            if x is not None:
                on_good *= g if x == 1 else 1.0 - g
                on_bad *= b if x == 1 else 1.0 - b
        return on_good / (on_good + on_bad)


def start_model() -> VoteModel:
    return VoteModel(0.85, [0.98] * len(RULES), [0.5] * len(RULES))


def fit(patterns: DataFrame, rounds: int = EM_ROUNDS) -> VoteModel:
    """EM over (votes, n): counts of at most 3 ** len(RULES) vote patterns.

    The corpus is already summed up in those counts; the few hundred of them
    are read to the driver, where the rounds are plain arithmetic.  Estimates
    carry one pseudo-vote each way and stay within 0.01 and 0.99; a rule never
    counts as worse than chance (good votes no likelier on bad documents),
    which fixes which class is the good one.
    """
    rows = sorted(((tuple(r["votes"]), r["n"]) for r in patterns.collect()), key=repr)
    total = sum(n for _, n in rows)
    model = start_model()
    if not total:
        return model

    def share(part: float, whole: float) -> float:
        return min(0.99, max(0.01, (part + 1.0) / (whole + 2.0)))

    for _ in range(rounds):
        weighed = [(v, n, model.weigh(v)) for v, n in rows]
        good, bad = [], []
        for k in range(len(RULES)):
            cast = [(v[k], n, p) for v, n, p in weighed if v[k] is not None]
            good.append(share(sum(p * n for x, n, p in cast if x == 1), sum(p * n for _, n, p in cast)))
            bad.append(min(good[-1], share(sum((1 - p) * n for x, n, p in cast if x == 1), sum((1 - p) * n for _, n, p in cast))))
        model = VoteModel(min(0.99, max(0.01, sum(p * n for _, n, p in weighed) / total)), good, bad)
    return model


def vote_patterns(measured: DataFrame) -> DataFrame:
    """Counts of the vote patterns of rows with a ``votes`` column."""
    return measured.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, votes, posterior and kept."""
    found = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias("m"))
    rows = stored(found.select("doc_id", "m", votes(F.col("m")).alias("votes"), base_failed(F.col("m")).alias("base_failed")),
                  "measures")
    model = fit(vote_patterns(rows))
    return (rows.withColumn("posterior", model.posterior(F.col("votes")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
            .select("doc_id", "m.*", "votes", "base_failed", "posterior", "kept"))


def keep_good(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with the columns of ``docs``.

    The rows are written once beside their votes; the model comes from the
    votes, and the filter reads the written rows.  Measuring costs far more
    than writing, so nothing is measured twice, and no text is shuffled.
    """
    names = [f"d{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = F.col(names[docs.columns.index(text_col)])
    judged = stored(renamed.select("*", let(measure(text), lambda m: F.struct(
        votes(m).alias("votes"), base_failed(m).alias("failed"))).alias("j")), "judged")
    model = fit(vote_patterns(judged.select("j.votes")))
    return (judged.where(~F.col("j.failed") & (model.posterior(F.col("j.votes")) >= keep_at))
            .select(*names).toDF(*docs.columns))
