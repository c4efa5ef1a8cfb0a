"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions, labels every
byte position with language probabilities, and a document's probabilities are
the mean over all its positions.  It is written and trained in numpy, by
backpropagation through time with Adam.

Whole texts are read: each is cut into segments of ``SEGMENT`` bytes (a
segment starts with a fresh state), and thousands of segments advance together
through the same small matrix products, so the state of a task is bounded by
``LANES`` segments whatever the length of a text.

Training reads labelled documents only, a bounded sample of them: about
``TRAIN_DOCS`` documents of each language, chosen by a hash of the id, and
``TRAIN_WINDOWS`` windows from hashed places of each text.  The bound is a
parameter; prediction covers every document.

Defined results: a null text, or one without any letter, gets ``und`` and score
0; so does everything if no labelled document can be learned from; with one
language only, that language and score 1.  Repeated rows get equal results;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = 8
SEGMENT = 256
LANES = 4096
TRAIN_DOCS = 400
TRAIN_WINDOWS = 2
TRAIN_BYTES = 64
TRAIN_STEPS = 240
BATCH = 256
MAX_LANGUAGES = 256
SEED = 5
_LETTER = r"\p{L}"
_F = np.float32


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign x / (1 + |x|): the network's tanh, an order of magnitude cheaper in numpy."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of the softsign, from its value."""
    return (1 - np.abs(y)) ** 2


@dataclass
class BiGRU:
    """Weights of both directions, stacked on the first axis, and of the labelling layer.

    ``x``: (2, 3H, 256) input weights of each byte value (update, reset, new
    gate) with the bias in them; ``u``: (2, 3H, H) recurrent weights; ``v``:
    (C, 2H) and ``c``: (C, 1) labels.
    """

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> BiGRU:
        rng = np.random.default_rng(seed)
        n = len(languages)
        return cls(languages, rng.normal(0, 0.3, (2, 3 * hidden, 256)).astype(_F),
                   rng.normal(0, 0.5 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(_F),
                   rng.normal(0, 0.3, (n, 2 * hidden)).astype(_F), np.zeros((n, 1), _F))

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.c]

    def loss_and_grads(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions of ``data`` (T, N) where ``mask``, and its gradients."""
        t_max, n = data.shape
        h_dim = self.u.shape[2]
        order = [range(t_max), range(t_max - 1, -1, -1)]
        steps: list[list] = [[None] * t_max, [None] * t_max]
        hs = np.zeros((t_max, 2 * h_dim, n), _F)
        for d in range(2):
            h = np.zeros((h_dim, n), _F)
            for t in order[d]:
                a, g = self.x[d][:, data[t]], self.u[d] @ h
                zr = 0.5 + 0.5 * _squash(a[:2 * h_dim] + g[:2 * h_dim])
                z, r = zr[:h_dim], zr[h_dim:]
                new = _squash(a[2 * h_dim:] + r * g[2 * h_dim:])
                steps[d][t] = (h, z, r, new, g[2 * h_dim:])
                h = np.where(mask[t], new + z * (h - new), h)
                hs[t, d * h_dim:(d + 1) * h_dim] = h
        logits = np.einsum("ck,tkn->tcn", self.v, hs) + self.c
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        total = max(1, int(mask.sum()))
        hit = p[np.arange(t_max)[:, None], label[None, :], np.arange(n)[None, :]]
        loss = float(-(np.log(hit + 1e-9) * mask).sum() / total)
        dl = p
        dl[np.arange(t_max)[:, None], label[None, :], np.arange(n)[None, :]] -= 1
        dl *= mask[:, None, :] / _F(total)
        gv, gc = np.einsum("tcn,tkn->ck", dl, hs), dl.sum((0, 2))[:, None]
        dhs = np.einsum("ck,tcn->tkn", self.v, dl)
        gx, gu = np.zeros_like(self.x), np.zeros_like(self.u)
        for d in range(2):
            dh = np.zeros((h_dim, n), _F)
            for t in reversed(order[d]):
                dh = dh + dhs[t, d * h_dim:(d + 1) * h_dim]
                h, z, r, new, gn = steps[d][t]
                m = mask[t]
                live = dh * m
                dn = live * (1 - z) * _slope(new)
                dz = live * (h - new) * 0.5 * _slope(2 * z - 1)
                dr = dn * gn * 0.5 * _slope(2 * r - 1)
                da = np.concatenate([dz, dr, dn])
                dg = np.concatenate([dz, dr, dn * r])
                one = np.zeros((256, n), _F)
                one[data[t], np.arange(n)] = 1
                gx[d] += da @ one.T
                gu[d] += dg @ h.T
                dh = dh * ~m + live * z + self.u[d].T @ dg
        return loss, [gx, gu, gv, gc]

    def train(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray, steps: int = TRAIN_STEPS,
              batch: int = BATCH, rate: float = 0.02, seed: int = SEED) -> list[float]:
        """Adam over class-balanced batches of columns of ``data`` (T, windows); the losses."""
        rng = np.random.default_rng(seed)
        members = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        first = [np.zeros_like(p) for p in self.params()]
        second = [np.zeros_like(p) for p in self.params()]
        losses = []
        for s in range(1, steps + 1):
            pick = np.concatenate([rng.choice(m, max(1, batch // len(members))) for m in members if len(m)])
            loss, grads = self.loss_and_grads(data[:, pick], mask[:, pick], label[pick])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            now = rate * (1 - 0.9 * s / steps)
            for p, g, a, b in zip(self.params(), grads, first, second):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (now * (a / (1 - 0.9 ** s)) / (np.sqrt(b / (1 - 0.999 ** s)) + 1e-8)).astype(_F)
            losses.append(loss)
        return losses

    def pooled(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sums over positions of the label probabilities of each lane: (C, N) for ``data`` (T, N)."""
        def squash(x: np.ndarray, room: np.ndarray) -> None:
            np.abs(x, out=room)
            room += 1
            x /= room

        t_max, n = data.shape
        h_dim = self.u.shape[2]
        a, g, w = (np.empty((3 * h_dim, n), _F) for _ in range(3))
        keep = np.empty((t_max, len(self.c), n), _F)
        total = np.zeros((len(self.c), n), _F)
        for d in range(2):
            x, u = np.ascontiguousarray(self.x[d]), np.ascontiguousarray(self.u[d])
            v = np.ascontiguousarray(self.v[:, d * h_dim:(d + 1) * h_dim])
            zr, new, room, fresh = a[:2 * h_dim], a[2 * h_dim:], g[:h_dim], g[2 * h_dim:]
            h = np.zeros((h_dim, n), _F)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                np.take(x, data[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=g)
                zr += g[:2 * h_dim]
                squash(zr, w[:2 * h_dim])
                zr += 1
                zr *= 0.5
                fresh *= zr[h_dim:]
                new += fresh
                squash(new, w[2 * h_dim:])
                np.subtract(h, new, out=room)
                room *= zr[:h_dim]
                np.add(new, room, out=h)
                if not mask[t].all():  # past a segment's end the state stays fresh
                    h *= mask[t]
                if d == 0:
                    np.matmul(v, h, out=keep[t])
                else:
                    p = keep[t]
                    p += v @ h
                    p += self.c
                    p -= p.max(0)
                    np.exp(p, out=p)
                    p *= mask[t] / p.sum(0)
                    total += p
        return total

    def probabilities(self, texts: list[bytes], segment: int = SEGMENT, lanes: int = LANES) -> np.ndarray:
        """(texts, C): mean label probabilities over all positions of each text (0 for empty ones)."""
        sums = np.zeros((len(texts), len(self.c)))
        owner, parts = [], []

        def flush():
            # Segments of like length share a run, so little of it is padding.
            by_length = sorted(range(len(parts)), key=lambda k: len(parts[k]))
            for at in range(0, len(by_length), 1024):
                lane = by_length[at:at + 1024]
                t_max = len(parts[lane[-1]])
                data = np.frombuffer(b"".join(parts[k].ljust(t_max, b"\0") for k in lane), np.uint8).reshape(len(lane), t_max)
                size = np.array([len(parts[k]) for k in lane])
                mask = np.arange(t_max)[:, None] < size[None, :]
                np.add.at(sums, [owner[k] for k in lane], self.pooled(np.ascontiguousarray(data.T), mask).T)
            owner.clear()
            parts.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), segment):
                owner.append(i)
                parts.append(text[at:at + segment])
                if len(parts) >= lanes:
                    flush()
        if parts:
            flush()
        return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def training_windows(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     per_language: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS, size: int = TRAIN_BYTES) -> list[tuple[str, str]]:
    """(language, window) pairs: a bounded sample for training.

    About ``per_language`` documents of each language by a hash threshold (no
    sort, no language in one task), ``windows`` windows of ``size`` characters
    at hashed places anywhere in the text.  At most MAX_LANGUAGES languages
    (an error otherwise) and twice the expected rows are ever fetched.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.rlike(F.col(text_col).cast("string"), F.lit(_LETTER)) & F.col(lang_col).isNotNull()
                          ).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return []
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = F.pmod(F.xxhash64("i", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_language / n)]), F.col("l"))
    room = F.greatest(F.length("t") - size, F.lit(0)) + 1
    taken = (rows.where(place < share)
             .select("i", "l", F.posexplode(F.array(*[F.substring("t", 1 + F.pmod(F.xxhash64("i", F.lit(k)), room), F.lit(size))
                                                      for k in range(windows)])).alias("k", "w"))
             .where("w != ''").orderBy(F.xxhash64("i", F.lit(SEED)), "i", "k", "w").limit(2 * per_language * windows * len(counts)))
    return [(r["l"], r["w"]) for r in taken.collect()]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> BiGRU | None:
    """A network trained on the sample; None if there is nothing to learn from."""
    sample = training_windows(labelled, id_col, text_col, lang_col, **options)
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    model = BiGRU.fresh(languages)
    if len(languages) > 1:
        raw = [w.encode()[:TRAIN_BYTES] for _, w in sample]
        data = np.zeros((TRAIN_BYTES, len(raw)), np.uint8)
        for k, w in enumerate(raw):
            data[:len(w), k] = np.frombuffer(w, np.uint8)
        mask = np.arange(TRAIN_BYTES)[:, None] < np.array([len(w) for w in raw])[None, :]
        model.train(data, mask, np.array([languages.index(lang) for lang, _ in sample]))
    return model


def predict(docs: DataFrame, model: BiGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its text alone."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.coalesce(F.rlike(F.col(text_col).cast("string"), F.lit(_LETTER)), F.lit(False)).alias("letters"))
    if model is None:
        return src.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        for b in batches:
            usable = b.column(2).to_pylist()
            texts = [t if ok else b"" for t, ok in zip(b.column(1).cast(pa.large_binary()).to_pylist(), usable)]
            p = model.probabilities(texts)
            best = p.argmax(1)
            lang = [model.languages[k] if ok else "und" for k, ok in zip(best, usable)]
            score = np.where(usable, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")
