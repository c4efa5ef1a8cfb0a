"""Operators against brute force and on awkward rows: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import json
import os
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resalelens.llm import chat, exact_dedup, language_id, line_dedup, mixing, packing, pii, quality, queries, simhash, url_filter

SF = "/root/testdata/sf0.001"
TOK = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, size string"
LONG = "many words here. " * 3000
TEXTS = [None, "", " \n\t ", "One two three four five", "ONE two three four five", "one two three four five",
         "a b", LONG, LONG, "Zürich ÄÖ ß\nline two is here\nline three too\nthe last line"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], 0, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "one two three four five", "en", "a", 0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        if sql is None:
            continue
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in cols]
        want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want, name
        assert want


def test_url_filter_edges(spark):
    urls = ["http://A.Example.NET/en/x?y", "http://example.net/enx", "http://net", "http://x.net/", None, "no scheme", "",
            "http://badexample.com/de/", "http://example.com/de/1#f", "https://u@h.org/fr/?://", "http://x.net/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, rule string")
    out = url_filter.filter_pages(pages, url_filter.rules_frame(spark, queries.URL_RULES))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(urls) + 1
    assert (0, "a.example.net", "/en/x", "example.net/en/", "allow") in got
    assert (1, "example.net", "/enx", "net/", "block") in got
    assert (2, "net", "", None, "allow") in got and (4, "", "", None, "allow") in got and (5, "", "", None, "allow") in got
    assert (7, "badexample.com", "/de/", None, "allow") in got and (8, "example.com", "/de/1", "example.com/de/", "block") in got
    # A rule path that ends inside a path part fits every path it starts.
    mid = url_filter.rules_frame(spark, [("block", "net", "/e"), ("block", None, "/")])
    assert {r.page_id for r in url_filter.filter_pages(pages, mid).where("verdict = 'block'").collect()} == {0, 1}
    assert url_filter.filter_pages(pages.where("false"), mid).count() == 0


TOKENIZER = Tokenizer.from_file(TOK)


def _ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_round_trip(docs, empty, real):
    odd = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(
        [(100, "<|endoftext|> it's DON'T 12.5, éa b İX a\x1cb ... x.,"), (101, "###*** abc!!! can't.,")], "doc_id long, text string"))
    for d, m in ((odd, 64), (real.select("doc_id", "text"), 4096)):
        rows = packing.pack_documents(d, TOK, max_tokens=m, group_docs=50).collect()
        want = collections.Counter((r.doc_id, tuple(_ids(r.text))) for r in d.collect())
        pieces = collections.defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens))
        total = collections.Counter()
        for doc_id, ps in pieces.items():
            assert all(len(ids) <= m and s + len(ids) <= n for s, ids, n in ps)
            total[doc_id] = sum(len(ids) for _, ids, _ in ps)
        assert total == collections.Counter({k: sum(len(i) * n for (d2, i), n in want.items() if d2 == k) for k in total})
        for doc_id, ids in want:
            if sum(1 for w in want if w[0] == doc_id) == 1:
                assert all(ids[s:s + len(p)] == p for s, p, _ in pieces[doc_id])
        seqs = collections.defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append((r.offset, r.length))
        for s in seqs.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(s)) and sum(s[-1]) <= m
    assert sum(n for s in seqs.values() for _, n in s) / (4096 * len(seqs)) > 0.9
    assert packing.pack_documents(empty, TOK).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    fit, room = packing.FirstFit(100), []
    for n in sorted(rng.integers(1, 101, 500).tolist(), reverse=True):
        at = next((k for k, free in enumerate(room) if free >= n), len(room))
        if at == len(room):
            room.append(100)
        assert fit.place(n) == (at, 100 - room[at])
        room[at] -= n


def _simhash(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [0, 256])
def test_simhash_components(spark, docs, real, limit):
    # Chains and a crowd of near fingerprints beside real ones.
    d = docs.select("doc_id", "text").unionByName(real.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = simhash.near_duplicates(d, bucket_limit=limit).collect()
    texts = [(r.doc_id, _simhash(r.text)) for r in d.collect()]
    assert collections.Counter(texts) == collections.Counter((r.doc_id, r.fp % (1 << 64)) for r in rows)
    fps = sorted({f for _, f in texts})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    first = {}
    for i, f in texts:
        if i is not None:
            first[find(f)] = min(i, first.get(find(f), i))
    assert all(first[find(r.fp % (1 << 64))] == r.component_id for r in rows)


@pytest.mark.parametrize("bits,limit", [(4, 0), (4, 4), (4, 10000), (3, 0), (3, 10000), (1, 10000), (0, 1)])
def test_links_connect_like_brute_force(spark, bits, limit):
    rng = np.random.default_rng(bits)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 30)}
    for c in list(fps)[:4]:
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    got = {r.fp: r.root for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, limit).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert all(got.get(f, f) == find(f) for f in fps)


def test_segment_plan_has_a_ball_at_every_size():
    for bits in (2, 3, 4, 5):
        for n in (0, 1, 100, 10_000, 25_000, 40_000, 10**6, 10**9):
            plan = simhash.segment_plan(n, bits)
            assert max(r for _, _, r in plan) >= 1 and sum(r + 1 for _, _, r in plan) == bits + 1, (n, bits)
            assert [s for s, _, _ in plan] == [sum(w for _, w, _ in plan[:k]) for k in range(len(plan))] and sum(w for _, w, _ in plan) == 64
    assert sum(r + 1 for _, _, r in simhash.segment_plan(100, 1)) == 2  # one bit: two bare halves


def test_simhash_keeps_one_row_each(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [0, 3, 6, 7, 9]  # null, blank; case; repeats
    assert simhash.keep_one(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(12))
    rows = [(1, f"intro one\n{passage}\nend one", 5, 9), (2, f"other\nwords\n{passage}\nclose", 5, 9), (3, "single line", 5, 9), (4, None, None, 9),
            (5, "", 0, 9), (6, "\n\n\n\n", 4, 9)]
    d = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, n_chars long, gone int")
    out = {r.doc_id: r for r in line_dedup.drop_repeated_chunks(d, n_chars_col="n_chars").collect()}
    assert out[1].text == rows[0][1] and out[3].text == "single line" and out[4].text is None and out[5].text == "" and out[6].text == "\n\n\n\n"
    lines = out[2].text.split("\n")
    assert len(lines) < 12 and lines[:2] == ["other", "words"] and lines[-1] == "close"
    assert out[2].n_chars == len(out[2].text) and out[1].n_chars == 5 and out[2].gone == 9
    assert line_dedup.drop_repeated_chunks(d).count() == 7
    assert line_dedup.drop_repeated_chunks(docs).count() == docs.count() and line_dedup.drop_repeated_chunks(empty).count() == 0
    cut = docs.where("doc_id = 9").select(line_dedup.chunks(F.col("text")).alias("c")).first().c
    lines = TEXTS[9].split("\n")
    # Chunks reach from the first line to the last, each from where the one before it ends.
    assert cut[0].no == 0 and [c.no + c.size - 1 for c in cut] == [c.no for c in cut[1:]] + [len(lines) - 1]
    assert all(c.size > 1 and c.chunk == "\n".join(lines[c.no:c.no + c.size]) for c in cut)


def _without_passages(docs):
    """(id, text) of distinct ids, in order of id, without the lines of units that occurred before."""
    seen, out = set(), []
    for i, text in sorted(docs):
        lines = text.split("\n")
        gone = set()
        for k, x in enumerate(lines):
            for size, unit in ((2, tuple(lines[k:k + 2])), (1, (x,))):
                if len(unit) != size or not re.search(r"[^\x20\x09-\x0D]", "".join(unit)) \
                        or size == 1 and len(re.findall(r"[^\x20\x09-\x0D]+", x)) <= line_dedup.LONG_LINE:
                    continue
                gone.update(range(k, k + size) if unit in seen else ())
                seen.add(unit)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_repeated_passages_go_whole(spark, docs, empty):
    # Passages of 2 to 6 lines (and one long line) shared mid-text, 12 of each length.
    rows, want, i = [], {}, 0
    for size in range(1, 7):
        for k in range(12):
            passage = [f"shared {size} {k} {j}" + (" word" * 60 if size == 1 else "") for j in range(size)]
            for _ in range(2):
                own = [f"own line {i} {j}" for j in range(6)]
                rows.append((i, "\n".join([*own[:3], *passage, *own[3:]]), 0, "x"))
                want[i] = "\n".join(own) if i % 2 else rows[-1][1]
                i += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone string")
    out = line_dedup.drop_repeated_passages(d.unionByName(d.where("doc_id < 3")), n_chars_col="n_chars", counts=True)
    assert out.columns == [*d.columns, "n_lines_gone"] and out.count() == len(rows) + 3
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == want == dict(_without_passages([r[:2] for r in rows]))
    assert all(r.n_chars == (len(r.text) if r.doc_id % 2 else 0) and r.gone == "x" for r in got)
    assert all(r.n_lines_gone == (r.doc_id // 24 + 1 if r.doc_id % 2 else 0) for r in got)


def test_repeated_passages_edges(spark, docs, empty):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb"), (3, "b\nc\nx\na"), (4, "\n\n\n"), (5, "\n\n\n"), (6, ""), (7, "a"), (8, "a"), (9, "r\nr\nr\nr")]
    d = spark.createDataFrame(rows + [(10, None), (None, "a\nb")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_passages(d).collect()}
    assert out.pop(10) is None and out.pop(None) == "a\nb"  # the null id is first
    assert out == {i: t for i, t in _without_passages([(0, "a\nb"), *rows]) if i}
    assert line_dedup.drop_repeated_passages(docs).count() == docs.count() and line_dedup.drop_repeated_passages(empty).count() == 0


def test_pii(spark, empty):
    texts = ["Mail A.B7@x.example.org or a.b7@X.example.org, call +1 (017) 555-7713.", "call 1-017-555-7713? no: 017-555-7713",
             "ip 10.0.0.1 and 4111 1111 1111 1111 x", "Mr John Smith met Mrs Anna Smith. Mr Smith left. Господин Иванов", None, "", "nothing here",
             'key "a1b2c3d4e5f6a7b8c9d0e1f2" end', "c.d8@x.example.org " * 500]
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    rows = pii.replace_pii(d).collect()
    out = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(texts) + 1 and out[4] is None and out[5] == "" and out[6] == texts[6]
    a, b = re.findall(r"\S+@\S+[a-z]", out[0])
    assert a != "A.B7@x.example.org" and a.lower() == b.lower() and re.fullmatch(r"[A-Z]\.[A-Z]\d@[a-z]\.[a-z]{7}\.org", a)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0]) and "555-7713" not in out[0] + out[1]
    number = re.search(r"\d{4} \d{4} \d{4} \d{4}", out[2])[0].replace(" ", "")
    assert number[0] == "4" and sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(number)) % 10 == 0
    m, f, s = re.search(r"Mr (\w+ \w+) met Mrs (\w+ \w+)\. Mr (\w+) left", out[3]).groups()
    assert m.split()[1] == f.split()[1] == s != "Smith" and f.split()[0].endswith("a") and not m.split()[0].endswith("a")
    assert re.search("Господин [А-Я][а-я]+$", out[3]) and "Иванов" not in out[3]
    assert re.search(r'"[0-9a-f]{24}"', out[7]) and "a1b2" not in out[7]
    assert len(set(out[8].split())) == 1
    assert pii.replace_pii(empty).count() == 0


def test_pii_surrogates_stay_distinct(spark):
    # 100 two-character local parts under one-letter hosts: collisions are certain.
    mails = [(f"{a}{b}@q.org",) for a in "abcdefghij" for b in range(10)]
    e = spark.createDataFrame(mails, "canon string").select(F.lit("email").alias("kind"), "canon")
    got = [r.surrogate for r in pii.assign(e).collect()]
    assert len(set(got)) == 100 and not set(got) & {m for m, in mails}


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
            (4, 0, None, None), (5, None, "user", "<|system|>"), (5, None, "user", "<|system|>"), (None, 0, "user", "x"),
            (6, 0, "user", "hi"), (6, 1, "assistant", "other")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: (r.n_turns, r.chat) for r in chat.render(c).collect()}
    assert set(out) == {1, 4, 5, 6, None}
    assert out[1] == (2, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>")
    assert out[4] == (1, "<|user|>\n\n<|end|>") and out[5] == (1, "<|user|>\n< |system|>\n<|end|>")
    assert chat.render(c.where("false")).count() == 0


@pytest.mark.parametrize("share,counters", [(256, 511), (2, 3)])
def test_exact_groups(docs, empty, share, counters):
    rows = exact_dedup.exact_groups(docs, heavy_share=share, counters=counters).collect()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        t = (r.text or "").encode().lower()
        groups[hashlib.sha256(t).digest()].append(r.doc_id)
    want = [(i, g, max(x for x in ids if x is not None), len(ids)) for g, ids in groups.items() for i in ids]
    assert sorted(((r.doc_id, bytes(r.digest), r.keep_id, r.group_size) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact_dedup.exact_groups(empty).count() == 0


def _measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(win)
    covered = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(spark, docs, empty, real):
    for d in (docs, real):
        rows = quality.assess(d).collect()
        want = collections.Counter((r.doc_id, *_measures(r.text)) for r in d.collect())
        assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    kept = {r.doc_id for r in rows if r.kept}
    assert sorted(r.doc_id for r in quality.keep_good(real).collect()) == sorted(r.doc_id for r in rows if r.kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(real.select("doc_id"), "doc_id").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.2
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(empty).count() == 0 and quality.assess(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs, carry=["doc_id", "size"]).collect()
    assert len(rows) == docs.count() and all(r.copies <= 2 and r.c1 in ("z", None) for r in rows)
    sizes = {}
    for r in rows:
        sizes[(r.source_size, r.target)] = r.source_size
    assert abs(sum(t for _, t in sizes) - 1.5 * sum(sizes.values())) < 1e-6 and all(t <= 2 * s for s, t in sizes)
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    assert sorted(map(repr, mixing.emit(docs).collect())) == sorted(map(repr, out.collect()))


def test_mixing_shuffles_the_texts_once(spark):
    rows = [(i, "word " * (i % 7), [None, "", "a", "b"][i % 4], i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept long")
    plan = mixing.emit(df)._jdf.queryExecution().executedPlan().toString()
    by_bucket = re.findall(r"Exchange hashpartitioning\([^)]*m_bucket#", plan)
    assert len(by_bucket) == 1 and not re.search(r"Exchange hashpartitioning\(coalesce\(m_source", plan)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.sql(mixing.SQL).fetchall()
    got = [(r.c0, r.size, r.source_size, r.target, r.size * r.copies) for r in mixing.mix(df, carry=["doc_id"]).collect()]
    assert sorted(got) == sorted(want) and len(got) == 400


def test_mixing_targets(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 0), ("c", 1000)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    assert t["a"] == 20 and t[None] == 0 and abs(sum(t.values()) - 3015) < 1e-6 and abs(t["c"] - 2995 * 2 / 3) < 1e-6


def test_gru_gradients(monkeypatch):
    monkeypatch.setattr(language_id, "_F", np.float64)
    rng = np.random.default_rng(0)
    m = language_id.BiGRU.fresh(["a", "b", "c"], hidden=3)
    data = rng.integers(0, 256, (6, 4)).astype(np.uint8)
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5])[None, :]
    label = np.array([0, 1, 2, 1])
    _, grads = m.loss_and_grads(data, mask, label)
    for p, g in zip(m.params(), grads):
        for at in np.argsort(-np.abs(g), axis=None)[:4]:
            ix = np.unravel_index(at, g.shape)
            keep, step = p[ix], 1e-5
            p[ix] = keep + step
            up, _ = m.loss_and_grads(data, mask, label)
            p[ix] = keep - step
            down, _ = m.loss_and_grads(data, mask, label)
            p[ix] = keep
            assert abs((up - down) / (2 * step) - g[ix]) < 1e-6


def test_language_id(spark, docs, empty):
    rows = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    model = language_id.fit(docs)
    out = language_id.predict(docs, model).collect()
    assert len(out) == docs.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (0, 1, 2))
    assert all(r.lang_pred == "en" for r in out if r.doc_id in (3, 7))
    none = language_id.predict(docs, language_id.fit(empty))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and language_id.predict(empty, model).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline
    rows = corpus_pipeline.run(spark, SF).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= known and all(len(r.ids) == 4 * r.length for r in rows)
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        if name != "packing":
            assert out.columns == d.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["quality", "line_dedup", "simhash", "mixing", "packing"]'
    assert os.path.isdir(SF)
