"""The fitted models against plain numpy."""

import struct

import numpy as np
import xxhash

from lattica.llm import licenses, quality


def test_partition_sums_give_the_ridge_solution(spark):
    """Summed normal equations solve to what all rows at once give; the calibration is monotone and keeps the mean."""
    r = np.random.default_rng(3)
    texts = [" ".join("w" * int(k) for k in r.integers(1, 9, 40)) if y else " ".join("X!" * int(k) for k in r.integers(1, 5, 40)) for y in (1, 0) * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.sampled(docs, labels, "quality", quality.SAMPLE).collect()
    stats = np.stack([quality.statistics(x.text) for x in rows])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(stats.var(0), 1e-9)))
    fit = [k for k, x in enumerate(rows) if x.part != 0]
    f, y = model.features(stats[fit]), np.array([rows[k].y for k in fit], float)
    assert np.allclose(model.weights, np.linalg.solve(f.T @ f + quality.PENALTY * len(rows) * np.eye(f.shape[1]) / f.shape[1], f.T @ y), atol=1e-6)
    x, y = r.normal(size=200), r.integers(0, 2, 200).astype(float)
    at, height = quality.isotonic(x, y)
    assert (np.diff(height) >= 0).all() and (np.diff(at) > 0).all()
    best = [max(min(y[np.argsort(x)][i : j + 1].mean() for j in range(k, 200)) for i in range(k + 1)) for k in range(0, 200, 20)]
    assert all(min(abs(height - b)) < 1e-9 for b in best)  # the max-min form of the same fit


def test_licence_lines_by_plain_sums(spark):
    """Probabilities from buckets and weights by hand; the bound keeps every line that is accepted."""
    model = licenses.fit(spark)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chained = lambda seed, s: xxhash.xxh64_intdigest(s.encode() if isinstance(s, str) else struct.pack("<q", signed(s)), seed)
    lines = [" ".join(w) for _, w, _ in licenses.examples()][::40] + ["the red fox ran over the hill", "license", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    read = licenses.paragraphs(docs)
    got = {r.doc_id: (r.p, r.w) for r in read.withColumn("p", model.probabilities(licenses.F.col("w"), every=True)).collect()}
    accepted = set()
    for k, (p, w) in got.items():
        grams = spark.createDataFrame([(w,)], "w array<string>").select(licenses._grams(licenses.F.col("w"))).first()[0]
        assert {signed(chained(42, x)) for x in w} <= set(grams) and len(grams) == len({*w, *zip(w, w[1:]), *zip(w, w[1:], w[2:])})
        grams = {h % licenses.BUCKETS for h in grams if model.table[h % licenses.BUCKETS] == h}
        e = np.exp(np.concatenate([[0.0], model.weights[1:][:, sorted(grams)].sum(1) + model.intercepts[1:]]))
        assert np.allclose(p, e / e.sum(), atol=1e-6), lines[k]
        if 1 - p[0] >= model.threshold:
            accepted.add(k)
    likely = {r.doc_id for r in read.where(model.probabilities(licenses.F.col("w")).isNotNull()).collect()}
    assert accepted <= likely < set(got) and accepted
