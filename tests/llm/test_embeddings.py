"""Embedding near-duplicates against brute force, with planted links and dense groups."""

import numpy as np
import pytest
from tests_support import roots

from lattica.llm import embedding_dedup


def near(r, v, cosine):
    """A vector at the given cosine from v."""
    v = np.asarray(v) / np.linalg.norm(v)
    z = r.normal(size=len(v))
    z -= (z @ v) * v
    return (cosine * v + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)).tolist()


def brute(rows, threshold=0.93):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab, ids = np.array([z for _, _, z in rows]), [i for i, _, _ in rows]
    link = (x @ x.T >= threshold) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    return ids, link, roots([(ids[i], ids[j]) for i, j in zip(*np.nonzero(link))], ids)


@pytest.mark.parametrize("dim", [16, 64])
def test_planted_links(spark, dim):
    """Pairs just above and below the threshold, chains, copies, scaled copies, and a group longer than a list."""
    r = np.random.default_rng(3)
    rows = [(int(k), r.normal(size=dim).tolist(), int(k % 3)) for k in range(300)]
    rows += [(300 + k, near(r, rows[k][1], 0.932), rows[k][2]) for k in range(150)]  # links at the threshold
    rows += [(450 + k, near(r, rows[k][1], 0.928), rows[k][2]) for k in range(50)]  # no links
    rows += [(500 + k, near(r, rows[300 + k][1], 0.95), rows[k][2]) for k in range(50)]  # chains
    rows += [(600 + k, near(r, rows[0][1], 0.94 + 0.06 * r.random()), 0) for k in range(embedding_dedup.SHORT + 120)]  # a dense group
    rows += [(1000 + k, rows[1][1], 1) for k in range(40)] + [(1100 + k, (3 * np.array(rows[2][1])).tolist(), 2) for k in range(3)]
    odd = [(9000, None, 0), (9001, [0.0] * dim, 0), (9002, [float("nan")] * dim, 0), (9003, [None] * dim, 0), (9004, rows[0][1], None), (9005, [], 0), (9006, [1e200] * dim, 1), (9007, [1.0] * 4, 0), (None, rows[0][1], 0)]
    repeated = [rows[0], rows[0], rows[5]]
    df = spark.createDataFrame([*rows, *odd, *repeated], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS raw", "2 AS key")
    block, embedding_dedup.BLOCK = embedding_dedup.BLOCK, 64
    got = embedding_dedup.near_duplicates(df).collect()
    embedding_dedup.BLOCK = block
    assert len(got) == len(rows) + len(odd) + len(repeated)
    ids, link, want = brute(rows)
    found = {g.vec_id: g for g in got}
    count = link.sum(1)
    assert link.sum() > 2000 and all(found[i].n_links <= n for i, n in zip(ids, count))
    assert sum(found[i].n_links for i in ids) >= 0.998 * link.sum()
    assert np.mean([found[i].n_links == n for i, n in zip(ids, count)]) > 0.98
    assert np.mean([found[i].component_id == want[i] for i in ids]) > 0.98
    assert all(found[i].kept == (found[i].component_id == i) for i in ids)
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in (9000, 9001, 9002, 9003, 9004, 9005, 9006, 9007))
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_labels_of_text(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "b"), (3, [5.0, -2.0], "a")], "vec_id long, embedding array<float>, label string")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_recall_and_candidates():
    """At the data's dimension: recall at the threshold, and few of the other pairs to verify."""
    dim, n = 64, 3000
    r = np.random.default_rng(17)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([near(r, v, 0.93) for v in x])
    shares = []
    for rows in (n, 100 * n):
        k, t = embedding_dedup.shape(rows)
        need = embedding_dedup.calibrated(dim, k, t, 0.93)
        a, b = embedding_dedup.strongest(x, k, t), embedding_dedup.strongest(y, k, t)
        assert np.mean(embedding_dedup._tally(*a, *b, embedding_dedup.window(0.93)) >= need) >= 0.995
        i, j = r.integers(0, n, (2, 100_000))
        i, j = i[i != j], j[i != j]
        shares.append(np.mean(embedding_dedup._tally(a[0][i], a[1][i], a[0][j], a[1][j], embedding_dedup.window(0.93)) >= need))
    assert shares[0] < 0.005 and shares[1] < 0.0005
