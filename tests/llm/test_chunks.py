"""Content-defined chunks against brute force, and how much of a passage they find."""

import hashlib
import os
import random
import re

import pytest

from resalelens.llm import chat, exact_dedup, line_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def chunk_places(lines):
    s = [sha(x) for x in lines]
    last = len(lines) - 1
    cuts = [i for i in range(len(lines)) if i in (0, last) or s[i][:2] >= "10" or sha(s[i - 1] + s[i])[:2] >= "10"]
    out = [(i, j - i + 1) for i, j in zip(cuts, cuts[1:])]
    return out + [(i, 1) for i, x in enumerate(lines) if len(WORD.findall(x)) > line_dedup.LONG_LINE]


def without_chunks(docs):
    """id -> text, for documents in order of id."""
    seen, out = set(), {}
    for i, text in docs:
        lines = text.split("\n")
        gone = set()
        for no, size in sorted(chunk_places(lines)):
            unit = "\n".join(lines[no:no + size])
            if WORD.search(unit):
                if (size == 1, unit) in seen or (size > 1, unit) in seen:
                    gone.update(range(no, no + size))
                seen.add((size == 1, unit))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def _shared(rng, sizes, times):
    rows, own = [], {}
    for size in sizes:
        for k in range(times):
            passage = [f"shared {size} {k} {j} {rng.random()}" for j in range(size)]
            for _ in range(2):
                i = len(rows)
                mine = [f"own line {i} {j} {rng.random()}" for j in range(8)]
                rows.append((i, "\n".join([*mine[:4], *passage, *mine[4:]])))
                own[i] = size
    return rows, own


def test_chunks_match_brute_force_and_find_most_of_every_passage(spark):
    rng = random.Random(4)
    rows, size = _shared(rng, (2, 3, 4, 6, 12), 40)
    rows += [(10_000, "a\nb\nc\nd"), (10_001, "x\na\nb\nc\nd\ny"), (10_002, "r\nr\nr\nr"), (10_003, "\n\n\n"), (10_004, "\n\n\n"),
             (10_005, "w " * 60), (10_006, "top\n" + "w " * 60 + "\nend"), (10_007, ""), (10_008, "alone"), (10_009, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines_gone) for r in line_dedup.drop_repeated_chunks(df, counts=True).collect()}
    want = without_chunks(rows)
    assert {i: t for i, (t, _) in got.items()} == want
    for s in (2, 3, 4, 6, 12):
        later = [i for i in size if size[i] == s and i % 2]
        assert all(got[i][1] <= s for i in later)
        assert sum(got[i][1] for i in later) >= 0.9 * s * len(later), s
    assert all(got[i][1] == 0 for i in size if i % 2 == 0)


def test_chunks_of_the_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.where("text is not null").collect())
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_chunks(docs).collect()}
    assert {i: got[i] for i, _ in rows} == without_chunks(rows)


def test_exact_dedup_keeps_one_row_of_a_repeated_id(spark):
    d = spark.createDataFrame([(7, "t"), (7, "T"), (3, "t"), (None, "t"), (None, "n"), (None, "n")], "doc_id long, text string")
    rows = exact_dedup.exact_groups(d).collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in rows if r.kept] in ([(7, 7, 4), (None, None, 2)], [(None, None, 2), (7, 7, 4)])
    assert len(rows) == 6


def test_deep_urls_cost_as_little_as_shallow_ones(spark):
    rules = url_filter.rules_frame(spark, [("block", "net", "/"), ("allow", "b.net", "/a/a/"), ("block", "x.b.net", "/a/a/a")])
    urls = ["http://a.b.net/" + "a/" * 100_000, "http://a.b.net/" + "a/" * 5, "http://x.b.net/a/a/ab", "http://" + "l." * 50_000 + "net/q",
            "http://b.net/a/", "http://q.org/a/a/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_pages(pages, rules).collect()}
    assert got == {0: ("b.net/a/a/", "allow"), 1: ("b.net/a/a/", "allow"), 2: ("x.b.net/a/a/a", "block"), 3: ("net/", "block"),
                   4: ("net/", "block"), 5: (None, "allow")}
    assert url_filter.filter_pages(pages, rules.where("false")).where("rule is not null").count() == 0


def test_turns_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 0, "user", "hello"), (None, 1, "user", "hello"), (1, 0, "user", "hi"),
            (1, 1, "assistant", "yo"), (0, 0, "user", "zero")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(((r.conv_id, r.n_turns, r.chat) for r in chat.render(c).collect()), key=repr)
    assert out == sorted([(None, 1, "<|user|>\nhello\n<|end|>"), (0, 1, "<|user|>\nzero\n<|end|>"),
                          (1, 2, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>")], key=repr)


@pytest.mark.parametrize("sparse", [0, 255])
def test_the_dense_class_can_be_set(spark, sparse):
    from pyspark.sql import functions as F
    d = spark.createDataFrame([("\n".join(str(k) for k in range(40)),)], "t string")
    got = d.select(line_dedup.chunks(F.col("t"), sparse).alias("c")).first().c
    assert all(c.size == 2 for c in got) if sparse == 0 else max(c.size for c in got) > 2


def test_pii_long_domains_and_digits_that_run_out(spark):
    from resalelens.llm import pii
    text = "x@" + "a." * 500_000 + "org and b.c@d.org"
    d = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace_pii(d).collect()}
    assert out[1].n_entities == 1 and out[1].text.startswith(text[:1_000_000]) and "b.c@d.org" not in out[1].text and out[2].text == "plain"
    from pyspark.sql import functions as F
    e = spark.createDataFrame([(f"1{k}",) for k in range(10)], "canon string").select(F.lit("phone").alias("kind"), "canon")
    got = [r.surrogate for r in pii.assign(e).collect()]
    assert len(set(got)) == 10 and not set(got) & {f"1{k}" for k in range(10)} and all(g.startswith("1") for g in got)


def test_lines_are_hashed_by_one_pass_over_the_texts(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", noted)
    docs = spark.createDataFrame([(1, "a b\nc d\ne"), (2, "x\na b\nc d\ny"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_chunks(docs).collect()}
    assert got == without_chunks([(1, "a b\nc d\ne"), (2, "x\na b\nc d\ny")]) | {3: None}
    assert sum("sha2(" in p for p in plans) == 1


def test_long_lines_have_more_words_than_the_limit(spark):
    n = line_dedup.LONG_LINE
    lines = [sep.join(["woé \U0001f600"] * k) for k in (n - 1, n, n + 1, 3 * n) for sep in (" ", "\t \x0b", "\r\x0c", " ")]
    lines += [f" \t{x}" for x in lines] + [f"{x}\r " for x in lines] + ["a" * 500, " " * 500, "", "\x85".join("a" * 200), " ".join("a" * (n + 1))]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select("line", line_dedup._is_long(df.line).alias("long")).collect()
    assert {r["line"]: r["long"] for r in got} == {x: len(WORD.findall(x)) > n for x in lines}


def test_the_copy_of_the_texts_is_deleted_once_the_lines_are_found(spark):
    top = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(top))
    out = line_dedup.drop_repeated_chunks(spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None)], "doc_id long, text string"))
    made = {x.split("-")[1] for x in set(os.listdir(top)) - before}
    assert "gone" in made and not made & {"cuts", "firsts"}
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a\nb\nc", 2: "d", 3: None}
