"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two trained embeddings: its own, if the training texts hold it often enough, and the mean of its
character n-grams'. The network reads windows of WINDOW words that overlap by the rest of STRIDE; attention pools
the states of a window, and a logit tells how toxic it is. A text is clean if all its windows are, so its score is
1 - prod(1 - sigmoid(logit)) over all windows of the whole text, in training as in scoring: a toxic document's
label goes to its windows in proportion to what they say. All parameters are learned together from the documents'
labels; every word is projected once, so scoring works on rows of a table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.quality import sampled, scorer

#: Documented bound of the labelled sample that the network is trained on.
SAMPLE = 6_000
WINDOW, STRIDE, HIDDEN = 48, 36, 8
#: Sizes of a word's own embedding and of its characters'; buckets of character n-grams.
WORD_DIM, CHAR_DIM, BUCKETS = 8, 8, 1 << 13
INPUTS = WORD_DIM + CHAR_DIM
#: Training documents that must hold a word that gets an embedding of its own; the share of words read without theirs.
MIN_DOCS, DROP = 3, 0.5
#: Steps of the training, and windows of a step, whatever the sample's size.
STEPS, BATCH_WINDOWS, RATE, DECAY = 600, 384, 0.01, 0.1
_WORD = re.compile(r"[^\W_]+")
_BATCH, _CACHE = 2048, 300_000


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(word: str) -> list[int]:
    """Buckets of the runs of three and of five bytes of the marked word, and of the whole."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    return [zlib.crc32(w) % BUCKETS, *[zlib.crc32(w[i : i + n]) % BUCKETS for n in (3, 5) for i in range(len(w) - n + 1)]]


def windows(n: int) -> list[tuple[int, int]]:
    """The windows of a text of n words: none is left out; an empty text has one, empty, window."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softplus(x):
    return np.logaddexp(0, x)


def _summed(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of x added up by their number."""
    return np.stack([np.bincount(at, weights=c, minlength=n) for c in x.T], axis=1).astype(np.float32)


class Network:
    """Two gated recurrent layers, one in each direction; attention over their states; a logit a window."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 3):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.vocabulary = vocabulary  # words from 1; row 0 is for all others
        p = {
            "word": r.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)), "char": r.normal(0, 0.3, (BUCKETS, CHAR_DIM)),
            "W": r.normal(0, 0.4, (2, INPUTS, 3 * h)), "U": r.normal(0, 0.3, (2, h, 3 * h)), "b": np.zeros((2, 1, 3 * h)),
            "a": r.normal(0, 0.3, 2 * h), "o": r.normal(0, 0.3, 2 * h), "c": np.full(1, -4.0),
        }
        p["word"][0] = 0
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.forget()

    # words as rows of a table

    def forget(self):
        self.row: dict[str, int] = {}
        self.known: list[int] = []
        self.grams: list[list[int]] = []
        self.table = np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "p": self.p}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of words; new words get new ones."""
        row, out = self.row, []
        for w in words:
            k = row.get(w)
            if k is None:
                k = row[w] = len(self.known)
                self.known.append(self.vocabulary.get(w, 0))
                self.grams.append(_grams(w))
            out.append(k)
        return np.array(out, np.int64)

    def inputs(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs of rows, whose own embeddings are `own`; their n-grams, and the rows these belong to)."""
        grams = [self.grams[k] for k in rows.tolist()]
        sizes = np.array([len(g) for g in grams], np.int64)
        flat = np.array([x for g in grams for x in g], np.int64)
        at = np.repeat(np.arange(len(rows)), sizes)
        mean = np.add.reduceat(self.p["char"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None] if len(rows) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][own], mean], axis=1).astype(np.float32), flat, at

    def projected(self) -> np.ndarray:
        """The projections of all rows so far; those of new rows are computed."""
        done = self.table.shape[1]
        if done < len(self.known):
            rows = np.arange(done, len(self.known))
            x, _, _ = self.inputs(rows, np.array(self.known[done:], np.int64))
            self.table = np.concatenate([self.table, x @ self.p["W"] + self.p["b"]], axis=1)
        return self.table

    # the network over projected words

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; g is (time, direction, batch, gates), mask (batch, time) marks the words."""
        p, h = self.p, HIDDEN
        t, _, n, _ = g.shape
        m = np.stack([mask, mask[:, ::-1]])[..., None]
        s = np.zeros((2, n, h), g.dtype)
        states = np.empty((t, 2, n, h), g.dtype)
        kept = []
        for k in range(t):
            u = s @ p["U"]
            zr = _sigmoid(g[k, :, :, : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            cand = np.tanh(g[k, :, :, 2 * h :] + r * u[..., 2 * h :])
            new = (cand + z * (s - cand)) * m[:, :, k]
            if keep:
                kept.append((s, z, r, u[..., 2 * h :], cand))
            s = new
            states[k] = s
        full = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # time, batch, 2h
        e = full @ p["a"] + (mask.T - 1) * 30
        e -= e.max(0)
        a = np.exp(e)
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, full)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (m, kept, full, a, pooled)) if keep else logit

    def _projected(self, x: np.ndarray) -> np.ndarray:
        n, t, _ = x.shape
        both = np.stack([x, x[:, ::-1]]).reshape(2, n * t, -1)
        return (both @ self.p["W"] + self.p["b"]).reshape(2, n, t, -1).transpose(2, 0, 1, 3), both

    def gradients(self, x: np.ndarray, mask: np.ndarray, doc: np.ndarray, y: np.ndarray):
        """(gradients of the parameters, of x) of the documents' mean loss; doc numbers the windows' documents."""
        p, h = self.p, HIDDEN
        n, t, _ = x.shape
        g, both = self._projected(x)
        logit, (m, kept, full, a, pooled) = self.forward(g, mask, keep=True)
        s = np.bincount(doc, weights=_softplus(logit), minlength=len(y))
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(s), 1e-6), 1.0)
        d = (pull[doc] * _sigmoid(logit) / len(y)).astype(x.dtype)
        out = {"o": pooled.T @ d, "c": np.array([d.sum()])}
        dp = d[:, None] * p["o"]
        da = np.einsum("nh,tnh->tn", dp, full)
        de = a * (da - (a * da).sum(0))
        out["a"] = np.einsum("tn,tnh->h", de, full)
        dfull = a[..., None] * dp[None] + de[..., None] * p["a"]
        ds = np.stack([dfull[:, :, :h], dfull[::-1, :, h:]], axis=1)
        dg = np.empty((2, n, t, 3 * h), x.dtype)
        du_w = np.zeros_like(p["U"])
        nxt = np.zeros((2, n, h), x.dtype)
        for k in range(t - 1, -1, -1):
            s0, z, r, un, cand = kept[k]
            dn = (ds[k] + nxt) * m[:, :, k]
            dc = dn * (1 - z) * (1 - cand**2)
            dz = dn * (s0 - cand) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            dg[:, :, k] = np.concatenate([dz, dr, dc], axis=2)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            du_w += s0.transpose(0, 2, 1) @ du
            nxt = dn * z + du @ p["U"].transpose(0, 2, 1)
        out["U"] = du_w
        flat = dg.reshape(2, n * t, 3 * h)
        out["W"] = both.transpose(0, 2, 1) @ flat
        out["b"] = flat.sum(1, keepdims=True)
        dx = (flat @ p["W"].transpose(0, 2, 1)).reshape(2, n, t, -1)
        return out, dx[0] + dx[1][:, ::-1]

    def loss(self, x: np.ndarray, mask: np.ndarray, doc: np.ndarray, y: np.ndarray) -> float:
        s = np.bincount(doc, weights=_softplus(self.forward(self._projected(x)[0], mask)), minlength=len(y))
        return float(np.where(y > 0, -np.log(-np.expm1(-s)), s).mean())

    def train(self, ids: list[np.ndarray], y: np.ndarray, seed: int = 5):
        """Adam steps over groups of whole documents, given as rows of words."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        known = np.array(self.known, np.int64)
        step, counts = 0, np.array([len(windows(len(i))) for i in ids])
        while step < STEPS:
            order = r.permutation(len(ids))
            group = np.cumsum(counts[order]) // BATCH_WINDOWS
            for part in np.split(order, np.nonzero(np.diff(group))[0] + 1):
                step += 1
                grads = self._step(ids, part, y, known, r)
                rate = RATE * max(0.05, 1 - step / STEPS)
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    move = (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
                    self.p[k] = (self.p[k] * (1 - (rate * DECAY if k in ("word", "char") else 0)) - rate * move).astype(np.float32)
                self.p["word"][0] = 0

    def _step(self, ids, part, y, known, r) -> dict[str, np.ndarray]:
        flat, mask, doc = _batched([ids[k] for k in part])
        rows, at = np.unique(flat, return_inverse=True)
        own = np.where(r.random(len(rows)) < DROP, 0, known[rows])
        x, grams, of = self.inputs(rows, own)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        total = {k: grads[k] for k in ("word", "char")}
        at = at.reshape(flat.shape)
        got, dx = self.gradients(x[at], mask, doc, y[part])
        grads.update(got)
        dx = _summed((dx * mask[..., None]).reshape(-1, INPUTS), at.ravel(), len(rows))
        total["word"] += _summed(dx[:, :WORD_DIM], own, len(self.p["word"]))
        sizes = np.bincount(of, minlength=len(rows))[:, None]
        total["char"] += _summed((dx[:, WORD_DIM:] / sizes)[of], grams, BUCKETS)
        return grads


def _batched(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of words, mask, document) of all windows of some documents."""
    spans = [(k, lo, hi) for k, i in enumerate(ids) for lo, hi in windows(len(i))]
    flat, mask = np.zeros((len(spans), WINDOW), np.int64), np.zeros((len(spans), WINDOW), np.float32)
    for r, (k, lo, hi) in enumerate(spans):
        flat[r, : hi - lo] = ids[k][lo:hi]
        mask[r, : hi - lo] = 1
    return flat, mask, np.array([k for k, _, _ in spans], np.int64)


class ToxicityModel:
    """Scores in [0, 1]; higher means that label 1 is likelier."""

    def __init__(self, net: Network | None, prior: float):
        self.net, self.prior = net, prior

    def _group(self, texts: list[list[str]]) -> np.ndarray:
        net = self.net
        if len(net.known) > _CACHE:
            net.forget()
        ids = [net.ids(w) for w in texts]
        table = net.projected()
        pad = table.shape[1]
        table = np.concatenate([table, np.zeros((2, 1, table.shape[2]), np.float32)], axis=1)
        flat = np.concatenate([*ids, np.full(WINDOW, pad)])
        heads = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        spans = np.array([(heads[k] + lo, hi - lo, k) for k, i in enumerate(ids) for lo, hi in windows(len(i))], np.int64)
        steps, total = np.arange(WINDOW), np.zeros(len(ids))
        for lo in range(0, len(spans), _BATCH):
            part = spans[lo : lo + _BATCH]
            width = max(1, int(part[:, 1].max()))
            mask = steps[None, :width] < part[:, 1:2]
            idx = np.where(mask, flat[part[:, :1] + steps[:width]], pad)
            along = np.ascontiguousarray(idx.T)
            g = np.stack([table[0][along], table[1][along[::-1]]], axis=1)
            total += np.bincount(part[:, 2], weights=_softplus(net.forward(g, mask.astype(np.float32)).astype(float)), minlength=len(ids))
        return -np.expm1(-total)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), self.prior)
        got, group, size = [], [], 0
        for t in texts:
            group.append(_words(t))
            size += len(group[-1])
            if size > 200_000:
                got.append(self._group(group))
                group, size = [], 0
        if group:
            got.append(self._group(group))
        return np.concatenate(got)


def train(texts: list[str | None], y: np.ndarray) -> ToxicityModel:
    """The network learned from whole texts; one class alone, or none, gives that class's share as every score."""
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(None, float(y.mean()) if len(y) else 0.0)
    words = [_words(t) for t in texts]
    held = Counter(w for ws in words for w in set(ws))
    net = Network({w: k + 1 for k, w in enumerate(sorted(w for w, n in held.items() if n >= MIN_DOCS))})
    net.ids([""])  # padding
    net.train([net.ids(w) for w in words], np.asarray(y))
    net.forget()
    return ToxicityModel(net, float(np.mean(y)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicityModel:
    """Trains on a bounded sample of labels(doc_id, toxic) of docs(doc_id, text).

    Without labelled rows, or with one class alone, every score is that class's share (0 without rows). Labels of
    one id that differ count as their majority, ties as 1.
    """
    rows = sampled(docs, labels, "toxic", bound).orderBy(F.xxhash64("text"), "y").collect()
    return train([r.text for r in rows], np.array([r.y for r in rows], np.int64))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs(doc_id, text); null and empty texts get a score, too."""
    out = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
