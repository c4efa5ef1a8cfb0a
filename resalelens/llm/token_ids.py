"""Token ids of whole texts, in Arrow batches, through the words they are made of.

Both BPE vocabularies cut a text into pieces before any merge, and no piece
reaches over a word's edge, so the ids of a text are the ids of its words in
order.  Words of ASCII and Latin letters are cut into the vocabulary's pieces byte
by byte, since pieces repeat far more often than words; others stay whole.  The
distinct pieces of a part of a batch are looked up in a bounded cache of the
worker; new pieces go to the model, and only words left whole and not there go
through the whole tokenizer.

The cache has two generations: a full young one becomes the old one, words found
in the old one move to the young one, and the rest of the old one goes.  Words in
use stay, whatever the size of the vocabulary of the corpus.

Ids are little-endian unsigned 32-bit.  Null texts have no ids.
"""

from __future__ import annotations

import ctypes
import functools
import json
import operator
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE_BYTES = 45_000_000  # each of the two generations of a cache
PART_BYTES = 4_000_000  # text whose words are looked up together
_ENTRY = 150  # bytes of an entry beside key and ids
_LONG = 4096  # keys and ids beyond this size are not kept

# Fixed value: the piece pattern of the vocabulary with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space of any kind, then a space (RE2).
_BEFORE_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Letters in every version of Unicode tables.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ωА-я]+")
#: Letters of the classes below, whose lower case is one letter.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɿ]+")
_AFTER_WORD = re.compile(r"(?<=\S) ")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: glibc's; other C libraries may not have it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters are themselves, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(own)]
    return {**{chr(x): x for x in own}, **{chr(0x100 + k): x for k, x in enumerate(others)}}


_ID = operator.attrgetter("id")
_WRITTEN = {byte: char for char, byte in byte_values().items()}

#: Classes of a byte of a text: in a letter, digit, other mark, space, other white space, not known here.
_LETTER, _DIGIT, _MARK, _SPACE, _BLANK, _ODD = range(6)


def _classes() -> np.ndarray:
    """Class of each byte: ASCII, and U+00C0 to U+027F, whose code points are letters but for two."""
    out = np.full(256, _ODD, np.uint8)
    out[0x21:0x7F] = _MARK
    out[ord("0"):ord("9") + 1] = _DIGIT
    for first, last in (("A", "Z"), ("a", "z")):
        out[ord(first):ord(last) + 1] = _LETTER
    out[ord(" ")] = _SPACE
    out[0x09:0x0E] = _BLANK
    out[0x80:0xC0] = _LETTER  # the second byte of what follows; that of others stands after an odd byte
    out[0xC3:0xCA] = _LETTER
    return out


_CLASS = _classes()
#: Signs of multiplication and division; then also the capital I with a dot, whose lower case is two characters.
_SIGNS = (b"\xc3\x97", b"\xc3\xb7")
_SIGNS_LOWER = (*_SIGNS, b"\xc4\xb0")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of 64-bit strings or binary values without nulls, where each begins and the last ends)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    n = int(offsets[-1] - offsets[0])
    return (np.frombuffer(data, np.uint8, n, int(offsets[0])) if n else np.zeros(0, np.uint8)), offsets - offsets[0]


def _odd_at(data: np.ndarray, kind: np.ndarray, signs: tuple[bytes, ...]) -> np.ndarray:
    """Where characters stand whose class is not known here, ``signs`` among them."""
    found = [np.flatnonzero(kind == _ODD)]
    for lead in {s[0] for s in signs}:
        pair = np.flatnonzero(data[:-1] == lead)
        found.append(pair[np.isin(data[pair + 1], [s[1] for s in signs if s[0] == lead])])
    return np.concatenate(found)


def _odd(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has characters whose class is not known here."""
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, _odd_at(data, _CLASS[data], _SIGNS), "right") - 1] = True
    return out


def _after_marks(data: np.ndarray, first: np.ndarray, begin: np.ndarray) -> None:
    """Makes pieces of the contractions among the pieces that ``begin``; texts begin at ``first``."""
    mark = np.flatnonzero(data == ord("'"))
    mark = mark[begin[mark] & ~first[mark + 1]]
    for after in ("s", "t", "re", "ve", "m", "ll", "d"):
        n = len(after) + 1
        hit = mark[mark + n <= len(data)]
        for k, c in enumerate(after.encode(), 1):
            hit = hit[(data[hit + k] == c) & ~first[hit + k]]
        begin[hit + 1] = False
        begin[hit[hit + n < len(data)] + n] = True


def _byte_pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level vocabulary begin in texts without odd characters.

    Runs of one class; a space goes with the run after it; white space before that is a piece, and so is its
    last character if it is no space; white space that ends a text is one piece; contractions.
    """
    kind = _CLASS[data]
    blank = kind >= _SPACE
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begin = first[:-1].copy()
    last = np.zeros(len(data), bool)  # of white space with something after it
    last[:-1] = ~blank[1:] & ~first[1:-1]
    change = kind[1:] != kind[:-1]
    begin[1:] |= np.where(blank[1:], ~blank[:-1] | last[1:], change & (kind[:-1] != _SPACE))
    _after_marks(data, first, begin)
    return np.flatnonzero(begin)


def _solid_pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where bytes are no white space, where the pieces of the vocabulary with word ends begin) in lower-case texts.

    Runs of letters or marks, digits, contractions.  A word with odd characters is left whole.
    """
    kind = _CLASS[data]
    solid = (kind < _SPACE) | (kind == _ODD)
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    word = first[:-1].copy()
    word[1:] |= ~solid[:-1]
    word &= solid
    begin = word | (kind == _DIGIT)
    begin[1:] |= kind[1:] != kind[:-1]
    _after_marks(data, first, begin)
    odd = _odd_at(data, kind, _SIGNS_LOWER)
    if len(odd):
        number = np.cumsum(word, dtype=np.int32)
        whole = np.zeros(int(number[-1]) + 1, bool)
        whole[number[odd]] = True
        begin &= ~whole[number]
        begin |= word
    return solid, begin & solid


class Cache:
    """Bounded map of words to ids with two generations."""

    def __init__(self, limit: int):
        self.limit = self.room = limit
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        got = list(map(self.young.get, keys))
        if self.old:
            missing = [k for k, g in zip(keys, got) if g is None]
            again = {k: v for k, v in zip(missing, map(self.old.get, missing)) if v is not None}
            if again:
                got = [again.get(k) if g is None else g for k, g in zip(keys, got)]
                self.add(again)
        return got

    def add(self, entries: dict[bytes, bytes]) -> None:
        if self.room < 0:
            self.old, self.young, self.room = self.young, {}, self.limit
        size = list(map(int.__add__, map(len, entries), map(len, entries.values())))
        if max(size, default=0) > _LONG:
            entries = {k: v for (k, v), n in zip(entries.items(), size) if n <= _LONG}
            size = [n for n in size if n <= _LONG]
        self.young.update(entries)
        self.room -= sum(size) + _ENTRY * len(size)


def _looked_up(cache: Cache, keys: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
    """The ids of each of the distinct ``keys``."""
    got = cache.find(keys)
    new = [k for k, v in zip(keys, got) if v is None]
    if not new:
        return got
    fresh = dict(zip(new, learn(new)))
    cache.add(fresh)
    return [fresh[k] if v is None else v for k, v in zip(keys, got)]


def _joined(codes: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the words ``codes``, one after the other; how many each has)."""
    length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    first = np.cumsum(length) - length
    n = length[codes]
    begin = np.cumsum(n) - n
    # Fewer than 2^31 ids in a part: its texts are shorter than that.
    at = np.repeat((first[codes] - begin).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return np.frombuffer(b"".join(ids), "<u4")[at], n


def _distinct(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(code of each piece, the distinct pieces) of bytes cut where pieces ``begin``."""
    pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [
        None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]).dictionary_encode()
    raw, cut = _bytes_of(pieces.dictionary)
    raw, cut = raw.tobytes(), cut.tolist()
    return pieces.indices.to_numpy(), [raw[a:b] for a, b in zip(cut, cut[1:])]


def parts(texts: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``part_bytes``, without copying."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + part_bytes, "right")))
        yield texts.slice(at, to - at)
        at = to


def _give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library keep what a part took at most."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def strings(column: pa.Array) -> pa.Array:
    """A text column as 64-bit strings, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


class _Encoder:
    def __init__(self, path: str, cache_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.specials = [t["content"] for t in self.spec.get("added_tokens", [])]
        self.words = Cache(cache_bytes)

    def _starting(self, wanted: Callable[[str], bool]) -> np.ndarray:
        vocab = self.tokenizer.get_vocab()
        hit = np.zeros(max(vocab.values()) + 1, bool)
        hit[[i for t, i in vocab.items() if wanted(t)]] = True
        return hit

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _special(self, texts: pa.Array) -> pa.Array:
        hit = pa.array(np.zeros(len(texts), bool))
        for s in self.specials:
            hit = pc.or_(hit, pc.match_substring(texts, s))
        return hit

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each has)."""
        whole = self._not_by_word(texts)
        if not pc.any(whole).as_py():
            return self._by_word(texts)
        mine: Iterator[np.ndarray] = iter([])
        if not pc.all(whole).as_py():
            flat, n = self._by_word(texts.filter(pc.invert(whole)))
            mine = iter(np.split(flat, np.cumsum(n)[:-1]))
        out = [np.frombuffer(self._whole(texts[i].as_py()), "<u4") if w else next(mine) for i, w in enumerate(whole.to_pylist())]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def each(self, texts: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        for part in parts(texts, part_bytes):
            flat, n = self.encode(part)
            raw, at = flat.tobytes(), 0
            del flat
            _give_back()
            for k in (4 * n).tolist():
                yield raw[at:at + k]
                at += k


def _counts(lists: pa.Array, n: np.ndarray) -> np.ndarray:
    """Ids of each list of words, from the ids of each word."""
    offsets = lists.offsets.to_numpy()
    upto = np.concatenate([[0], np.cumsum(n)])
    return upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]


class WordBpe(_Encoder):
    """Vocabulary with word ends: lower-cased, white space dropped.

    Words of ASCII and Latin letters are cut into the vocabulary's pieces, byte by byte; other words are cut at
    punctuation at their end only.  Tokenizers of another kind get whole texts.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        super().__init__(path, cache_bytes)
        split = (self.spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        suffix = self.spec["model"].get("end_of_word_suffix")
        self.by_word = (split.get("type") == "Split" and bool(split.get("invert")) and bool(suffix)
                        and (split.get("pattern") or {}).get("Regex") == WORD_PATTERN
                        and '"Lowercase"' in json.dumps(self.spec.get("normalizer")))
        self.specials = [pc.ascii_lower(pa.scalar(t)).as_py() for t in self.specials]
        self.ends = self._starting(lambda t: bool(suffix) and t.endswith(suffix))
        del self.spec  # the vocabulary in Python objects

    def _not_by_word(self, texts: pa.Array) -> pa.Array:
        # Special tokens are found in the raw text, before lower-casing: the strings of other case are none,
        # but words are looked up in lower case.
        return self._special(pc.ascii_lower(texts)) if self.by_word else pa.array(np.ones(len(texts), bool))

    def _whole(self, text: str) -> bytes:
        return self._each([text])[0]

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = _bytes_of(pc.ascii_lower(texts))
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        solid, begin = _solid_pieces(data, at)
        of_text = np.searchsorted(np.flatnonzero(begin), at)
        codes, known = _distinct(data[solid], np.flatnonzero(begin[solid]))
        flat, n = _joined(codes, _looked_up(self.words, known, self._learn))
        return flat, np.diff(np.concatenate([[0], np.cumsum(n)])[of_text])

    def _learn(self, keys: list[bytes]) -> list[bytes]:
        """A piece goes to the model as the vocabulary writes its bytes; words with odd characters go elsewhere."""
        one, out, odd = self.tokenizer.model.tokenize, [], []
        for k in keys:
            text = k.decode()
            if not text.isascii():
                text = text.lower().encode().decode("latin-1").translate(_WRITTEN) if _LATIN.fullmatch(text) else None
            elif not text.isprintable():
                text = None
            if text is None:
                odd.append(k)
            out.append(None if text is None else array("I", map(_ID, one(text))).tobytes())
        if odd:
            rest = iter(self._odd_words(odd))
            out = [next(rest) if ids is None else ids for ids in out]
        return out

    def _odd_words(self, words: list[bytes]) -> list[bytes]:
        cut = list(map(_word_pieces, words))
        pieces = list(dict.fromkeys(p for ps in cut for p in ps))
        known = dict(zip(pieces, self.words.find(pieces)))
        new = [p for p, ids in known.items() if ids is None]
        known.update(zip(new, self._learn_whole(new)))
        whole = set(words)
        self.words.add({p: known[p] for p in new if p not in whole})
        return [b"".join([known[p] for p in ps]) for ps in cut]

    def _learn_whole(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone are one piece each: they are encoded as one
        text and cut after every id that ends a word; the rest one by one."""
        texts = [w.decode() for w in words]
        plain = [t.isalpha() and t.lower().isalpha() for t in texts]
        joined = [t for t, p in zip(texts, plain) if p]
        ids = np.frombuffer(self._each([" ".join(joined)])[0], "<u4")
        cut = _cut_after(ids, self.ends[ids], len(joined))
        if cut is None:
            return self._each(texts)
        mine, rest = iter(cut), iter(self._each([t for t, p in zip(texts, plain) if not p]))
        return [next(mine if p else rest) for p in plain]


def _word_pieces(word: bytes) -> list[bytes]:
    """Pieces of a lower-case word: all of them if it is ASCII, else the word without an ASCII
    mark of punctuation after a letter, and that."""
    if word.isascii():
        return _ASCII_PIECE.findall(word)
    stem = word.rstrip(_MARKS)
    if len(stem) < len(word) and stem.decode().lower()[-1:].isalnum():
        return [stem, word[len(stem):]]
    return [word]


def _cut_after(ids: np.ndarray, last: np.ndarray, n: int) -> list[bytes] | None:
    """``ids`` cut after the ``last`` ids of ``n`` words; None if there are not as many."""
    at = (np.flatnonzero(last) + 1).tolist()
    if len(at) != n:
        return None
    raw = ids.tobytes()
    return [raw[4 * a:4 * b] for a, b in zip([0, *at], at)]


class ByteBpe(_Encoder):
    """Byte-level vocabulary.

    Texts of ASCII and Latin letters are cut into the vocabulary's pieces, byte by byte; the model gets the
    pieces that are new.  Another text is cut at every space that follows something else than white space: pieces
    begin there, whatever stands around.  ``space`` puts a space before each text;
    ``plain`` takes the special tokens' strings for ordinary text.
    """

    def __init__(self, path: str, space: bool = False, plain: bool = False, cache_bytes: int = CACHE_BYTES):
        super().__init__(path, cache_bytes)
        self.tokenizer.encode_special_tokens = plain
        if plain:
            self.specials = []
        before = self.spec.get("pre_tokenizer") or {}
        self.by_word = (before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")
                        and not self.spec.get("normalizer"))
        self.space = space
        self.bare = Cache(cache_bytes // 4)
        self.starts = self._starting(lambda t: t.startswith("Ġ"))
        del self.spec  # the vocabulary in Python objects

    def _not_by_word(self, texts: pa.Array) -> pa.Array:
        if not self.by_word:
            return pa.array(np.ones(len(texts), bool))
        odd = pc.or_(pc.match_substring_regex(texts, _BEFORE_SPACE), self._special(texts))
        return pc.or_(odd, pc.starts_with(texts, " ")) if self.space else odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return super().encode(texts)
        other = _odd(*_bytes_of(texts))
        if self.specials:
            other |= self._special(texts).to_numpy(zero_copy_only=False)
        if not other.any():
            return self._by_piece(texts)
        if other.all():
            return super().encode(texts)
        got = [(self._by_piece(texts.filter(pa.array(~other))), np.flatnonzero(~other)),
               (super().encode(texts.filter(pa.array(other))), np.flatnonzero(other))]
        out, n = [b""] * len(texts), np.zeros(len(texts), np.int64)
        for (flat, length), places in got:
            n[places] = length
            for i, ids in zip(places.tolist(), np.split(flat, np.cumsum(length)[:-1])):
                out[i] = ids
        return np.concatenate(out), n

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.space:
            texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        data, at = _bytes_of(texts)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        begin = _byte_pieces(data, at)
        codes, known = _distinct(data, begin)
        flat, n = _joined(codes, _looked_up(self.words, known, self._learn_pieces))
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, at)]
        return flat, np.diff(upto)

    def _learn_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """A piece goes to the model as the vocabulary writes its bytes."""
        one, out = self.tokenizer.model.tokenize, []
        for p in pieces:
            led = p[:1] == b" "
            word = p[1:] if led else p
            text = (("Ġ" if led else "") + word.decode()) if word.isalpha() else p.decode("latin-1").translate(_WRITTEN)
            out.append(array("I", map(_ID, one(text))).tobytes())
        return out

    def _whole(self, text: str) -> bytes:
        text = " " + text if self.space else text
        if not self.by_word or any(s in text for s in self.specials):
            return self._each([text])[0]
        first, *rest = _AFTER_WORD.split(text)
        return b"".join(self._bare([first.encode()]) + self._led([w.encode() for w in rest]))

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().cast(pa.binary()).dictionary_encode()
        codes, known = words.indices.to_numpy(), words.dictionary.to_pylist()
        if self.space:
            ids = self._led(known)
        else:
            first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            begin = codes[first]
            alone = np.unique(begin)
            codes = codes.astype(np.int64)
            codes[first] = len(known) + np.searchsorted(alone, begin)
            # Words that only ever begin a text are looked up for nothing; they are few.
            ids = self._led(known) + self._bare([known[i] for i in alone])
        flat, n = _joined(codes, ids)
        return flat, _counts(lists, n)

    def _led(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word with a space before it."""
        # The cache holds the ids of whole keys, pieces with their space among them.
        return _looked_up(self.words, [b" " + w for w in words], lambda new: self._learn([k[1:] for k in new]))

    def _bare(self, texts: list[bytes]) -> list[bytes]:
        return _looked_up(self.bare, texts, lambda new: self._each([t.decode() for t in new]))

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone are one piece: its bytes, as the vocabulary writes them, go to the
        model (marks after ASCII letters are another piece).  Other words with no space in them and none of any kind at their start are encoded
        as one text and cut before every id that begins with a space; the rest one by one."""
        one, out, other, rest = self.tokenizer.model.tokenize, {}, [], []
        stems: dict[bytes, bytes] = {}
        marks: dict[bytes, bytes] = {}
        for w in words:
            stem = w if w.isalpha() else w.rstrip(_MARKS)
            if stem.isalpha():
                ids = stems.get(stem)
                if ids is None:
                    stems[stem] = ids = array("I", [t.id for t in one("Ġ" + stem.decode())]).tobytes()
                if len(stem) < len(w):
                    after = w[len(stem):]
                    if after not in marks:
                        marks[after] = self._bare([after])[0]
                    ids += marks[after]
                out[w] = ids
            elif not w.isascii() and _LETTERS.fullmatch(w.decode()):
                out[w] = array("I", [t.id for t in one("Ġ" + w.decode("latin-1").translate(_WRITTEN))]).tobytes()
            elif b" " in w or not w or w.decode()[0].isspace() or any(s.encode() in w for s in self.specials):
                rest.append(w)
            else:
                other.append(w)
        ids = np.frombuffer(self._each([b"".join([b" " + w for w in other]).decode()])[0], "<u4")
        cut = _cut_after(ids, np.append(self.starts[ids[1:]], True)[:len(ids)], len(other))
        if cut is None:
            rest, cut = rest + other, []
        out.update(zip(other, cut))
        out.update(zip(rest, self._each([" " + w.decode() for w in rest])))
        return [out[w] for w in words]


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str, space: bool = False, plain: bool = False, cache_bytes: int = CACHE_BYTES) -> ByteBpe:
    return ByteBpe(path, space, plain, cache_bytes)
