"""The pipeline stage by stage, and the two fitted models, against plain Python."""

import collections
import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_chunks import without_chunks
from test_operators import _ids, _simhash

import corpus_pipeline
from resalelens.llm import language_id, mixing, quality
from resalelens.llm.common import stored

SF = "/root/testdata/sf0.001"


def plain_em(votes, rounds=quality.EM_ROUNDS):
    """EM document by document: (prior, good, bad) and each document's probability."""
    v = np.array([[np.nan if x is None else float(x) for x in row] for row in votes])
    cast, yes = ~np.isnan(v), v == 1
    rules = v.shape[1]
    prior, good, bad = 0.85, np.full(rules, 0.98), np.full(rules, 0.5)

    def weigh():
        def side(p):
            return np.where(cast, np.where(yes, p, 1 - p), 1.0).prod(1)

        g, b = prior * side(good), (1 - prior) * side(bad)
        return g / (g + b)

    def share(part, whole):
        return np.clip((part + 1) / (whole + 2), 0.01, 0.99)

    for _ in range(rounds):
        p = weigh()[:, None]
        good = share((p * yes).sum(0), (p * cast).sum(0))
        bad = np.minimum(good, share(((1 - p) * yes).sum(0), ((1 - p) * cast).sum(0)))
        prior = float(np.clip(p.mean(), 0.01, 0.99))
    return prior, good, bad, weigh()


@pytest.fixture(scope="module")
def judged(spark):
    return quality.assess(spark.read.parquet(f"{SF}/documents.parquet")).collect()


def test_em_equals_plain_em(spark, judged):
    prior, good, bad, p = plain_em([tuple(r.votes) for r in judged])
    counts = collections.Counter(tuple(r.votes) for r in judged)
    schema = "votes struct<" + ",".join(f"{r.name}:int" for r in quality.RULES) + ">, n long"
    model = quality.fit(spark.createDataFrame([(v, n) for v, n in counts.items()], schema))
    assert model.prior == pytest.approx(prior, abs=1e-9)
    assert model.good == pytest.approx(list(good), abs=1e-9) and model.bad == pytest.approx(list(bad), abs=1e-9)
    assert [r.posterior for r in judged] == pytest.approx(list(p), abs=1e-9)
    assert len(counts) > 5 and 0 < sum(x is None for v in counts for x in v)


def test_probabilities_equal_a_pass_byte_by_byte():
    model = language_id.BiGRU.fresh(["a", "b", "c"], hidden=5, seed=9)
    model.c += np.array([[0.1], [-0.2], [0.3]], np.float32)

    def squash(x):
        return x / (1 + abs(x))

    def states(piece, d):
        h, out, n = np.zeros(5), [], 5
        for byte in piece if d == 0 else reversed(piece):
            a, g = model.x[d][:, byte].astype(float), model.u[d].astype(float) @ h
            z, r = (0.5 + 0.5 * squash(a[k:k + n] + g[k:k + n]) for k in (0, n))
            new = squash(a[2 * n:] + r * g[2 * n:])
            h = (1 - z) * new + z * h
            out.append(h)
        return out if d == 0 else out[::-1]

    def pooled(text, segment):
        rows = []
        for at in range(0, len(text), segment):
            piece = text[at:at + segment]
            for f, b in zip(states(piece, 0), states(piece, 1)):
                e = np.exp(model.v @ np.concatenate([f, b]) + model.c[:, 0])
                rows.append(e / e.sum())
        return np.mean(rows, axis=0) if rows else np.zeros(3)

    texts = [b"", b"x", "Grüße aus Zürich".encode(), bytes(range(256)) * 2, b"seven by"]
    got = model.probabilities(texts, segment=7, lanes=3)
    assert got == pytest.approx(np.array([pooled(t, 7) for t in texts]), abs=1e-4)


def test_pipeline_stages_against_brute_force(spark, judged):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    assert len(ids) == docs.count()

    # Quality: the documents that plain EM over the votes keeps.
    p = plain_em([tuple(r.votes) for r in judged])[3]
    good = stored(stages["quality"](spark, docs, SF), "good")
    want = {r.doc_id for r, x in zip(judged, p) if not r.base_failed and x >= quality.KEEP_AT}
    assert sorted(r.doc_id for r in good.collect()) == sorted(want) and 0 < len(want) < len(ids)

    # Line dedup: every document stays, with the lines that the chunk rule leaves.
    cut = stored(stages["line_dedup"](spark, good, SF), "cut")
    lines = without_chunks(sorted((r.doc_id, r.text) for r in good.where("text is not null").collect()))
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == want and {i: after[i].text for i in lines} == lines
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
    assert any(len(after[r.doc_id].text) < len(r.text) for r in good.collect() if r.text)

    # SimHash: the smallest id of every component of fingerprints at 4 bits or fewer.
    one = stored(stages["simhash"](spark, cut, SF), "one")
    fp = {i: _simhash(r.text) for i, r in after.items()}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    kept = {i for i in fp if find(i) == i}
    assert sorted(r.doc_id for r in one.collect()) == sorted(kept) and len(kept) < len(fp)

    # Mixing: the copies of the SQL's systematic sample of what is left.
    mixed = stored(stages["mixing"](spark, one, SF), "mixed")
    con = duckdb.connect()
    con.register("documents", one.toArrow())
    words = {i: (size, taken) for i, size, taken in con.sql(f"select doc_id, size, taken from ({mixing.SQL})").fetchall()}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(words) == kept and set(copies) <= kept and max(copies.values()) == 2
    assert all(copies[i] * size == taken for i, (size, taken) in words.items())

    # Packing: the ids of every copy, each exactly once, in sequences without gaps.
    rows = stages["packing"](spark, mixed, SF).collect()
    text = {i: tuple(_ids(after[i].text)) for i in copies}
    seen, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        part = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert text[r.doc_id][r.start:r.start + r.length] == part and r.doc_tokens == len(text[r.doc_id])
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == collections.Counter({(i, k): n for i, n in copies.items() for k in range(len(text[i]))})
    for s in places.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(s)) and sum(s[-1]) <= 4096
    assert mixed.where(F.col("doc_id").isNull()).count() == 0
