"""Cross-tokenizer alignment, token files and spelling variants against brute force and on awkward rows."""

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from resalelens.llm import cross_tokens, queries, range_coder, spelling, token_files, token_ids

SF = "/root/testdata/sf0.001"
BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, part string, run long, word string, n long, first string"
POOL = [" ", "  ", "\n", " \n", "\t", " ", "　 ", "a", "foo", "Foo's", "don't", "'s", "é", "ß.", "İ.", "ﬁ", "語", "12", "3.5", "###", "...", "…",
        "<|endoftext|>", "<|startoftext|>", "the", "über,", "\x1c", "\x85", "е́", "ͅ", "²", "__", "🙂", "'ll", "ǅ", "▁", "<0x41>", "Ⅷ"]


def odd_texts(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


TEXTS = [None, "", " ", "  two  spaces ", "One two one two", "One two one two", "▁ is a mark", "<|endoftext|> special", "語" * 50,
         "long " * 40_000, "=" * 5_000, "\n\n\n", "x" * 3_000, *odd_texts(150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "p", 1, "w", 2, "f") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "a null id", None, None, None, None, None)], SCHEMA)


@pytest.mark.parametrize("make,path,before,plain", [
    (lambda: token_ids.WordBpe(WORD), WORD, "", False), (lambda: token_ids.ByteBpe(BYTE), BYTE, "", False),
    (lambda: token_ids.ByteBpe(BYTE, True, True), BYTE, " ", True), (lambda: token_ids.ByteBpe(BYTE, cache_bytes=2000), BYTE, "", False),
    (lambda: token_ids.WordBpe(WORD, cache_bytes=2000), WORD, "", False)])
def test_ids_by_words_are_the_tokenizers_ids(make, path, before, plain):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = plain
    texts = odd_texts(4000) + [t for t in TEXTS if t]
    encoder = make()
    for _ in range(2):  # the second time from the cache
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.each(token_ids.strings(pa.array([*texts, None])))]
        assert got == [e.ids for e in whole.encode_batch([before + t for t in texts], add_special_tokens=False)] + [
            whole.encode(before, add_special_tokens=False).ids]


@pytest.mark.parametrize("space", [False, True])
def test_latin_texts_are_cut_into_pieces_without_the_whole_tokenizer(space):
    whole = Tokenizer.from_file(BYTE)
    whole.encode_special_tokens = space
    pool = [" ", "  ", "\n", "\t", "\r\n", "\v", "'", "'s", "'S", "'ll", "'re", "'l", "'ve", "''", "a", "Été", "ǅ", "ɏ", "don", "st", "12", "3.5", "...", "\"", "$", "_"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(6000)] + ["", " ", "'", "x'", "'s", "x 's", "x\n's", "a" * 9000]
    encoder = token_ids.ByteBpe(BYTE, space, space)
    encoder._each = None  # nothing goes through it
    want = [e.ids for e in whole.encode_batch([" " * space + t for t in texts], add_special_tokens=False)]
    for _ in range(2):
        array = token_ids.strings(pa.array(["cut off", *texts, "cut off"])).slice(1, len(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.each(array)] == want
    odd = ["5 × 5", "÷", "no-break space", "x\x1cy", "語 and é", "<|endoftext|>", "e\u0301"]
    mixed = [t for pair in zip(texts, odd * 1000) for t in pair]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_ids.ByteBpe(BYTE, space, space).each(token_ids.strings(pa.array(mixed)))]
    assert got == [e.ids for e in whole.encode_batch([" " * space + t for t in mixed], add_special_tokens=False)]


def test_latin_words_are_cut_into_pieces_without_the_whole_tokenizer():
    whole = Tokenizer.from_file(WORD)
    pool = [" ", "  ", "\n", "\t", "\r\n", "\v", "'", "'s", "'S", "'ll", "'re", "'l", "'ve", "''", "a", "Été", "ǅ", "ɏ", "don", "st", "12", "3.5", "...", "\"", "$", "_"]
    rnd = random.Random(4)
    letters = [chr(c) for c in range(0xC0, 0x280) if c not in (0xD7, 0xF7, 0x130)]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(6000)] + [
        "", " ", "'", "x'", "'s", "'", "s", "x 's", "x'", "s", "'s't", "a" * 9000, *letters, "".join(letters), *map(chr, range(0x20, 0x7F))]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    encoder = token_ids.WordBpe(WORD)
    encoder._each = None  # nothing goes through it
    for _ in range(2):
        array = token_ids.strings(pa.array(["cut off", *texts, "cut off"])).slice(1, len(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.each(array)] == want


def test_words_of_other_characters_stand_among_latin_ones():
    whole = Tokenizer.from_file(WORD)
    pool = [" ", " ", "\n", "don't", "don\u2019t,", "5\u00d75", "\u00f7", "no\u00a0break", "x\x1cy", "\x00", "語", "слово.", "e\u0301", "\u0301", "İ", "İs'S",
            "\u2028", "\x85", "🙂's", "é", "'S", "Δς", "K", "ſ", "ﬁ", "12", "\u0661", "<|endoftext|>", "<|EndOfText|>", "ʰa", "a\u0327\u0301"]
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))) for _ in range(8000)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for encoder in (token_ids.WordBpe(WORD), token_ids.WordBpe(WORD, cache_bytes=2000)):
        for size in (token_ids.PART_BYTES, 300):
            got = [np.frombuffer(x, "<u4").tolist() for x in encoder.each(token_ids.strings(pa.array(texts)), size)]
            assert got == want


def test_blocks_are_the_same_bytes_as_in_files_written_before():
    rng = np.random.default_rng(4)
    ids = np.concatenate([(50257 * rng.random(30_000) ** 6).astype(int), np.arange(5000) % 7])
    block = range_coder.encode_block(ids, 50257)
    assert hashlib.sha256(block).hexdigest()[:16] == "e056828938f438c2" and (range_coder.decode_block(block) == ids).all()


@pytest.mark.parametrize("n", [1, 2, 63, 127, 128, 129, 5000, 70_001])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.zeros(n, int), np.full(n, 50256), (50257 * rng.random(n) ** 6).astype(int), np.arange(n) % 7):
        block = range_coder.encode_block(ids, 50257)
        assert (range_coder.decode_block(block) == ids).all()
    assert len(range_coder.encode_block(np.arange(n) % 7, 50257)) < 2 * n + 64  # repeats cost little
    for bad in (block[:-1], block[:20] + bytes([block[20] ^ 1]) + block[21:], b""):
        with pytest.raises(ValueError, match="checksum"):
            range_coder.decode_block(bad)


def test_token_files(spark, docs, tmp_path):
    whole = Tokenizer.from_file(BYTE)
    for block_ids in (range_coder.BLOCK_IDS, 1000):  # documents begin, go on and end in blocks
        path = str(tmp_path / f"b{block_ids}")
        token_files.write(docs, path, BYTE, block_ids=block_ids)
        rows = token_files.read(spark, path).collect()
        got = collections.defaultdict(list)
        for r in rows:
            assert len(r.ids) == 4 * r.n_tokens
            got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        at = 0
        for i, text in [(None, "a null id"), *enumerate(TEXTS)]:
            ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
            want = [(at + k * len(ids), ids) for k in range(2 if i == 4 else 1)]
            assert sorted(got[i]) == want, i
            at += len(ids) * len(want)
        assert len(rows) == len(TEXTS) + 2
    blocks = spark.read.parquet(path).orderBy("part", "block").collect()
    assert sum(b.n_ids for b in blocks) == at and max(b.n_ids for b in blocks) == 1000
    ids, names, counts, _, _ = token_files.unpack_block(blocks[3].bytes)
    assert len(ids) == blocks[3].n_ids == counts.sum() and len(names) == blocks[3].n_docs
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpack_block(blocks[3].bytes[:-9] + b"123456789")
    token_files.write(docs.where("false"), str(tmp_path / "none"), BYTE)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def aligned(rows):
    """Brute force: (doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of (doc_id, text) rows."""
    a_tok, b_tok = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_tok.encode_special_tokens = True
    value = token_ids.byte_values()
    a_bytes = {i: bytes([value[c] for c in t]) if i != 50256 else t.encode() for t, i in a_tok.get_vocab().items()}
    found, count = [], collections.Counter()
    for i, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        ab = [a_bytes[k] for k in a]
        bb = [bytes([int(b_tok.id_to_piece(k)[3:5], 16)]) if b_tok.is_byte(k) else b_tok.id_to_piece(k).replace("▁", " ").encode() for k in b]
        groups = []
        if text and b"".join(ab) == b"".join(bb) == (" " + text).encode():
            ga, gb, pa_, pb, x, y = [], [], 0, 0, 0, 0
            while x < len(a) or y < len(b):
                if pa_ <= pb and x < len(a):
                    pa_ += len(ab[x])
                    ga.append(a[x])
                    x += 1
                else:
                    pb += len(bb[y])
                    gb.append(b[y])
                    y += 1
                if pa_ == pb:
                    groups.append((ga, gb))
                    ga, gb = [], []
        links = collections.Counter()
        for u, v in groups:
            for (p, m), (q, k) in ((s, t) for s in collections.Counter(u).items() for t in collections.Counter(v).items()):
                links[p, q] += m * k
        count.update(links.keys())
        found.append((i, len(a) if groups else 0, len(b) if groups else 0, groups, links))
    best = {}
    for (p, _), n in count.items():
        best[p] = max(n, best.get(p, 0))
    return [(i, na, nb, len(g), sum(li.values()), ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g),
             sum(m for (p, q), m in li.items() if count[p, q] == best[p]), sum(m * count[k] for k, m in li.items())) for i, na, nb, g, li in found]


def test_alignment_of_awkward_rows(spark, docs):
    want = collections.Counter(aligned([*enumerate(TEXTS), (4, TEXTS[4]), (None, "a null id")]))
    for run_records, fan_in in ((1 << 20, 128), (300, 3)):  # small runs: several merge passes, counts handed down
        got = cross_tokens.align(docs, BYTE, PIECE, run_records=run_records, fan_in=fan_in)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
        assert collections.Counter(map(tuple, got.collect())) == want
    assert {r[0] for r in want if r[3] == 0} >= {0, 1, 6}  # null, empty, a mark that stands for a space
    assert cross_tokens.align(docs.where("false"), BYTE, PIECE).count() == 0


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, na, nb, g, li, b, c, hashlib.sha256(t.encode()).hexdigest() if t else "") for i, na, nb, g, li, t, b, c in aligned(rows)}
    assert set(map(tuple, queries.QUERIES["op11_cross_tokenizer_alignment"](spark, SF).collect())) == want


def test_merge_streams_its_chunks():
    rng = np.random.default_rng(1)
    total, rows = collections.Counter(), []
    for _ in range(9):
        keys = np.unique(rng.integers(0, 1 << 20, 500))
        n = rng.integers(1, 9, len(keys))
        total.update(dict(zip(keys.tolist(), n.tolist())))
        for at in range(0, len(keys), 100):
            rows.append((int(keys[at]), cross_tokens.pack_counts(keys[at:at + 100], n[at:at + 100])))
    out = list(cross_tokens.merged(iter(sorted(rows))))
    keys, n = (np.concatenate(c).tolist() for c in list(zip(*out))[:2])
    assert keys == sorted(total) and dict(zip(keys, n)) == total
    assert all(len({k >> 15 for k in ks.tolist()}) == 1 and (best == (c == c.max())).all() for ks, c, best in out)


def variants(rows, slip=97):
    count = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    shared = collections.defaultdict(set)
    for w in n:
        for k in [w, *(w[:j] + w[j + 1:] for j in range(len(w)))]:
            shared[k].add(w)

    def near(x, y):
        x, y = sorted((x, y), key=len)
        return x != y and len(y) - len(x) <= 1 and any(x[:k] == y[:k] and x[k + len(x) - len(y) + 1:] == y[k + 1:] for k in range(len(y)))

    nears = {w: set() for w in n}
    for group in shared.values():
        for x in group:
            nears[x].update(y for y in group if near(x, y))
    form = {}
    for w, around in nears.items():
        best = min(around, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(nears[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("small,tile", [(48, 256), (2, 3)])
def test_spelling_variants_of_awkward_words(spark, monkeypatch, small, tile):
    monkeypatch.setattr(spelling, "SMALL_BLOCK", small)
    monkeypatch.setattr(spelling, "TILE", tile)
    rnd = random.Random(8)
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "ababa", "babab", "ÀÉîöü", "Àéîöü", "words", "word's", "swords", "wordss", "x" * 700, "x" * 701, "x" * 699 + "y"]
    words += ["".join(rnd.choice("ab") for _ in range(rnd.randint(4, 9))) for _ in range(150)]
    rows = [(i, " ".join(rnd.choice(words).title() if i % 3 else rnd.choice(words) for _ in range(40))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "words words words"), rows[0], (102, "chain " * 40 + "chainn " * 12 + "chainnn " * 4 + "chaimnnn " * 3)]
    df = spark.createDataFrame([(i, t, "p", 1, "w", 2, "f") for i, t in rows], SCHEMA)
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(rows)
    assert spelling.variants(df.where("false")).count() == 0


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {tuple(r) for r in queries.QUERIES["op13_spelling_variants"](spark, SF).collect()}
    assert got == variants(rows) and len(got) > 1000


_HELD = r"""
import random, re
import pyarrow as pa
import public_tokenizers
from resalelens.llm.token_ids import WordBpe, strings
rng = random.Random(7)
texts = pa.array([" ".join("".join(rng.choices("aeinorst", k=9)) for _ in range(400)) for _ in range(3000)])
held = lambda: sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
encoder, before = WordBpe(str(public_tokenizers.path("word_bpe_49k.json")), cache_bytes=1 << 20), held()
for ids in encoder.each(strings(texts)):
    pass
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux' figures")
def test_a_worker_gives_the_memory_of_its_parts_back():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", _HELD], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
    assert int(out) < 300, f"{out} MB beside a cache of 1 MB"
