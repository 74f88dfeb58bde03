"""Document quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

fit() reads the statistics of a bounded sample of labelled documents; partitions sum their normal
equations, the driver solves them (their size depends on the number of features alone), and a pool of
sampled documents that the fit did not see calibrates the raw scores by isotonic regression.
score() is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Documented bound of the labelled sample that the classifier is fitted on.
SAMPLE = 24_000
#: Random Fourier features, and the ridge penalty per sampled row.
FEATURES, PENALTY = 192, 1e-3
#: Byte classes: lower, upper, digit, space, line end, sentence marks, other ASCII marks, control, beyond ASCII.
_CLASS = np.array(
    [
        0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in (32, 9) else 4 if c in (10, 13)
        else 5 if c in b".,;:!?'\"()-" else 6 if 33 <= c <= 126 else 8 if c >= 128 else 7
        for c in range(256)
    ],
    np.uint8,
)
_NAMES = 26


def statistics(text: str | None) -> np.ndarray:
    """A text's statistics; null counts as empty, and an empty text has finite ones too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)[:9] / n
    words = raw.lower().split()
    w = max(1, len(words))
    counts = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_n = max(1, len(lines))
    top = counts.most_common(5)
    bare = raw.translate(_PLAIN).split()
    squeezed = len(zlib.compress(raw, 1)) / n
    marks = raw.count(b"!") + raw.count(b"?")
    return np.array(
        [
            math.log1p(len(raw)), math.log1p(len(words)), *share,
            lens.mean() / 8, lens.std() / 8, (lens > 18).mean(),
            len(counts) / w, pairs / w, top[0][1] / w if top else 0.0, sum(c for _, c in top) / w,
            len(set(lines)) / line_n, math.log1p(w / line_n),
            len(bare) / w, squeezed, marks / w, counts.get(b"|", 0) / w,
            sum(len(x) for x in lines if x.rstrip()[-1:] in b".!?") / n if lines else 0.0,
            (raw.count(b"http") + raw.count(b"www.") + raw.count(b"@")) / w,
        ],
        np.float64,
    )


#: Letters and bytes beyond ASCII stay, all else splits.
_PLAIN = bytes(c if 97 <= c <= 122 or 65 <= c <= 90 or c >= 128 else 32 for c in range(256))


class QualityModel:
    """Scores in [0, 1]; higher means that label 1 is likelier."""

    def __init__(self, mean, scale, omega, phase, weights, xs, ys, prior: float):
        self.mean, self.scale, self.omega, self.phase, self.weights = mean, scale, omega, phase, weights
        self.xs, self.ys, self.prior = xs, ys, prior

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        rff = np.sqrt(2 / self.omega.shape[1]) * np.cos(z @ self.omega + self.phase)
        return np.concatenate([rff, z / 6, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.zeros(0)
        r = self.raw(np.stack([statistics(t) for t in texts]))
        # the raw score keeps the order within a step of the calibration
        return np.clip(0.995 * np.interp(r, self.xs, self.ys) + 0.005 * np.clip(r, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: the mean place and height of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools.pop()
            n = n1 + n2
            pools.append([(a1 * n1 + a2 * n2) / n, (b1 * n1 + b2 * n2) / n, n])
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def sampled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y, part) of about `bound` labelled documents at most, chosen by a hash of doc_id.

    Rows with a null id or label are left out; an id with several labels takes their majority (a tie: 1).
    The chosen ids are few (the bound) and joined by broadcast, so the documents are not shuffled.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.avg(label).alias("y"))
    n = known.count()
    u = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = known.where(u < min(1.0, bound / max(1, n))).select("_id", (F.col("y") >= 0.5).cast("int").alias("y"), F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(4)).alias("part"))
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "y", "part")


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, seed: int = 7) -> QualityModel:
    """Fits the classifier on labels(doc_id, quality) of docs(doc_id, text).

    Without labelled rows, or with one class alone, every score is that class's share (0.5 without rows).
    """

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([statistics(t) for t in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1).cast(pa.int32()), b.column(2).cast(pa.int32())], names=["x", "y", "part"])

    rows = sampled(docs, labels, "quality", bound).mapInArrow(stats, "x array<double>, y int, part int")
    # the sample's statistics are small; a few partitions keep the sums that the driver gets few, whatever the input
    rows = rows.repartition(8).persist()
    try:
        moments = rows.mapInArrow(_moments, "n long, ones long, s array<double>, q array<double>").collect()
        n, ones = sum(r.n for r in moments), sum(r.ones for r in moments)
        if n == 0 or ones in (0, n):
            return QualityModel(None, None, None, None, None, None, None, ones / n if n else 0.5)
        mean = np.sum([r.s for r in moments], axis=0) / n
        scale = np.sqrt(np.maximum(np.sum([r.q for r in moments], axis=0) / n - mean**2, 1e-9))
        rng = np.random.default_rng(seed)
        d = len(mean)
        model = QualityModel(mean, scale, rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES), None, None, None, ones / n)
        sums = rows.where("part <> 0").mapInArrow(_equations(model), "g binary").collect()
        size = FEATURES + d + 1
        g = np.sum([np.frombuffer(r.g, np.float64).reshape(size, size + 1) for r in sums], axis=0)
        model.weights = np.linalg.solve(g[:, :size] + PENALTY * n * np.eye(size) / size, g[:, size])
        held = rows.where("part = 0").mapInArrow(_raw(model), "r double, y int").collect() or [(0.0, 0), (1.0, 1)]
        model.xs, model.ys = isotonic(np.array([r[0] for r in held]), np.array([r[1] for r in held], float))
        return model
    finally:
        rows.unpersist()


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = np.array(b.column(0).to_pylist())
            y = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "ones": [int(y.sum())], "s": [x.sum(0).tolist()], "q": [(x**2).sum(0).tolist()]})


def _equations(model: QualityModel):
    """Sums a partition's normal equations into one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                f = model.features(np.array(b.column(0).to_pylist()))
                g = f.T @ np.concatenate([f, b.column(1).to_numpy(zero_copy_only=False)[:, None]], axis=1)
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return run


def _raw(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(np.array(b.column(0).to_pylist()))), b.column(1)], names=["r", "y"])

    return run


def scorer(model):
    """A column function: the model's score of a text column (null counts as empty)."""

    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score([None if t is None or t is pd.NA else t for t in text.tolist()]), dtype="float64")

    return score


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs(doc_id, text); repeated rows and null ids keep their rows."""
    out = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score the threshold or more; columns unchanged."""
    return docs.where(scorer(model)(F.col("text")) >= threshold)
