"""Near-duplicate embeddings by collision counting over many one-dimensional projections.

A line is the sum of one of K base lines and one of K others, with their signs, so 2K random projections
make (2K)^2 lines. A line tells near from far only at its ends: each vector is posted on the T lines along
which it lies farthest. A line's posts are sorted, and a window centred on each vector's own place yields its
collisions; collisions are counted for each pair, and pairs that reach the count which pairs at the threshold
reach with a share of RECALL (calibrated by simulation for the vectors' dimension) are verified in double
precision. K grows with the square root of the rows that may meet, so lists stay as short as they were.

A list longer than SHORT holds a dense group. Its pairs are never emitted: blocks of it meet in tasks that count
and verify, and return link counts and local minima. A pair belongs to the smallest long list that both share.
Equal vectors are one class, a row with a size, throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import components, cut

#: The share of simulated pairs at the threshold that reach the collision count.
RECALL = 0.999
#: Half-width of a window in distances of a pair at the threshold.
HALF_WIDTH = 2.0
#: Base lines for the square root of the rows that may meet, and the fewest.
LINES, LEAST_LINES = 6, 32
#: Members up to which a list's collisions are paired, and rows of a block of a longer one.
SHORT, BLOCK = 128, 1024
#: Pairs compared at once.
_PAIRS = 1 << 15


def shape(rows: int) -> tuple[int, int]:
    """(K, T) for so many rows that may meet."""
    k = max(LEAST_LINES, 1 << math.ceil(math.log2(max(1.0, LINES * math.sqrt(rows)))))
    return k, 48 + 16 * max(0, int(math.log2(k)) - 9)


@lru_cache(maxsize=4)
def _base(dim: int, k: int) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(2, dim, k))


def strongest(x: np.ndarray, k: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, places), each (rows, t): the lines along which unit vectors lie farthest, in ascending order."""
    lines, places = [], []
    keep = min(k, max(8, t // 5))
    t = min(t, keep * keep)
    for lo in range(0, len(x), 2048):
        tops, sizes = [], []
        for g in _base(x.shape[1], k):
            y = x[lo : lo + 2048] @ g
            i = np.argpartition(-np.abs(y), keep - 1, axis=1)[:, :keep]
            v = np.take_along_axis(y, i, 1)
            tops.append(2 * i + (v < 0))
            sizes.append(np.abs(v))
        n = len(tops[0])
        line = (tops[0][:, :, None] * (2 * k) + tops[1][:, None, :]).reshape(n, -1)
        place = ((sizes[0][:, :, None] + sizes[1][:, None, :]) / math.sqrt(2)).reshape(n, -1)
        i = np.argpartition(-place, t - 1, axis=1)[:, :t]
        line, place = np.take_along_axis(line, i, 1), np.take_along_axis(place, i, 1)
        order = np.argsort(line, axis=1)
        lines.append(np.take_along_axis(line, order, 1))
        places.append(np.take_along_axis(place, order, 1))
    if not lines:
        return np.zeros((0, t), np.int64), np.zeros((0, t), np.float32)
    return np.concatenate(lines), np.concatenate(places).astype(np.float32)


def _tally(la: np.ndarray, pa_: np.ndarray, lb: np.ndarray, pb: np.ndarray, width: float) -> np.ndarray:
    """For pairs of rows, the lines on which both stand in one window."""
    out = np.zeros(len(la), np.int64)
    for lo in range(0, len(la), 2048):
        s = slice(lo, lo + 2048)
        same = la[s][:, :, None] == lb[s][:, None, :]
        r, i, j = np.nonzero(same)
        near = np.abs(pa_[s][r, i] - pb[s][r, j]) <= width
        out[s] = np.bincount(r[near], minlength=len(la[s]))
    return out


@lru_cache(maxsize=16)
def calibrated(dim: int, k: int, t: int, threshold: float, recall: float = RECALL, pairs: int = 4000) -> int:
    """The largest collision count (1 at least) that a share `recall` of random pairs at the threshold reaches."""
    if dim < 2:
        return 1
    r = np.random.default_rng(11)
    x, z = r.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
    counts = np.sort(_tally(*strongest(x, k, t), *strongest(y, k, t), window(threshold)))
    return max(1, int(counts[int((1 - recall) * pairs)]))


def window(threshold: float) -> float:
    return HALF_WIDTH * math.sqrt(max(1e-9, 2 - 2 * threshold))


def _unit(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.float64)
    a = a / np.abs(a).max()
    return a / np.sqrt((a * a).sum())


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, digest, raw) of the vectors that can link."""
    for b in batches:
        at, dims, digests, raws = [], [], [], []
        for k, v in enumerate(b.column(2).to_pylist()):
            if not v or any(x is None for x in v):
                continue
            a = np.asarray(v, np.float64) + 0.0  # no negative zeros
            if np.isfinite(a).all() and a.any():
                at.append(k)
                dims.append(len(a))
                raws.append(a.tobytes())
                digests.append(hashlib.blake2b(raws[-1], digest_size=16).digest())
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())],
            names=["vec_id", "label", "dim", "digest", "raw"],
        )


def _listed(shapes: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dim):
                at = np.nonzero(dim == d)[0]
                part = b.take(pa.array(at))
                x = np.stack([_unit(r) for r in part.column(2).to_pylist()])
                lines, places = strongest(x, *shapes[int(d)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(lines), pa.list_(pa.int64())), pa.array(list(places), pa.list_(pa.float32()))], names=["vid", "lines", "places"]
                )

    return run


def _paired(width: float):
    """Rows (key, vid, place) sorted by key: (a, b) for the pairs of a list that stand in one window."""

    def pairs(key, vid, place):
        order = np.lexsort((place, key))
        key, vid, place = key[order], vid[order], place[order]
        left, right = [], []
        live = np.arange(len(key))
        for step in range(1, len(key)):
            live = live[live + step < len(key)]
            live = live[(key[live] == key[live + step]) & (place[live + step] - place[live] <= width)]
            if not len(live):
                break
            left.append(vid[live])
            right.append(vid[live + step])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        for b in batches:
            if not b.num_rows:
                continue
            now = [np.concatenate([r, b.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest)]
            done = np.searchsorted(now[0], now[0][-1], "left")  # the last list may go on
            rest = [x[done:] for x in now]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(*[x[:done] for x in now])], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(*rest)], names=["a", "b"])

    return run


def _verified(threshold: float):
    """Rows (a, b, raw and long lists of both): the pairs at the threshold that no long list holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cols = [], [b.column(k).to_pylist() for k in range(8)]
            for a, c, ra, rb, la, lb, sa, sb in zip(*cols):
                if len(ra) == len(rb) and (_unit(ra) * _unit(rb)).sum() >= threshold and not (la and lb and set(la) & set(lb)):
                    ids.append((a, c, sa, sb))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in ids], pa.int64()) for k in range(4)], names=["a", "b", "size_a", "size_b"])

    return run


def _local_roots(n: int, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The smallest row number that each row reaches over the links (i, k)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[k])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, k, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _bits(owned: list[list[int]], own: int) -> np.ndarray:
    """Per row, a bit for each long list below `own` that it stands on."""
    every = sorted({k for x in owned for k in x if k < own})
    at = {k: j for j, k in enumerate(every)}
    out = np.zeros((len(owned), max(1, -(-len(every) // 64))), np.uint64)
    for r, x in enumerate(owned):
        for k in x:
            if k < own:
                out[r, at[k] // 64] |= np.uint64(1) << np.uint64(at[k] % 64)
    return out


def _dense(threshold: float, shapes: dict[int, tuple[int, int]]):
    """One pair of blocks of a long list: (vid, degree, root) of the vectors with links."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vid")
        ids, size, side = (t.column(c).to_numpy() for c in ("vid", "size", "side"))
        raw = t.column("raw").to_pylist()
        x = np.stack([_unit(r) for r in raw])
        lines, places = (np.array(t.column(c).to_pylist()) for c in ("lines", "places"))
        bits = _bits(t.column("held").to_pylist(), t.column("key")[0].as_py())
        need, width = calibrated(x.shape[1], *shapes[x.shape[1]], threshold), window(threshold)
        one = side.max() == 0
        a_rows = np.nonzero(side == 0)[0]
        b_rows = a_rows if one else np.nonzero(side == 1)[0]
        degree, found = np.zeros(len(ids), np.int64), []
        step = max(1, _PAIRS // max(1, len(b_rows)))
        for lo in range(0, len(a_rows), step):
            rows = a_rows[lo : lo + step]
            free = np.ones((len(rows), len(b_rows)), bool)
            for w in range(bits.shape[1]):  # pairs of a smaller long list belong there
                free &= (bits[rows, w][:, None] & bits[b_rows, w][None]) == 0
            i, k = np.nonzero(free)
            i, k = rows[i], b_rows[k]
            if one:
                i, k = i[i < k], k[i < k]
            enough = _tally(lines[i], places[i], lines[k], places[k], width) >= need
            i, k = i[enough], k[enough]
            linked = (x[i] * x[k]).sum(1) >= threshold
            i, k = i[linked], k[linked]
            degree += (np.bincount(i, weights=size[k], minlength=len(ids)) + np.bincount(k, weights=size[i], minlength=len(ids))).astype(np.int64)
            found.append((i, k))
        i, k = (np.concatenate([f[z] for f in found]) if found else np.zeros(0, np.int64) for z in (0, 1))
        root, some = ids[_local_roots(len(ids), i, k)], degree > 0
        return pa.table({"vid": ids[some], "degree": degree[some], "root": root[some]}, schema=pa.schema([("vid", pa.int64()), ("degree", pa.int64()), ("root", pa.int64())]))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine is the threshold or more. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different dimensions. n_links counts other vec_ids, component_id is the smallest vec_id reachable. A vec_id
    names one vector: its repeated rows repeat its result, and if they differ, the row with the smallest label
    and digest is its vector. A null id links with nothing. No rows give no rows. Other columns are ignored.
    """
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = src.where("vec_id is not null and label is not null")
    rows = cut(good.mapInArrow(_usable, "vec_id long, label string, dim int, digest binary, raw binary"))
    if not rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = cut(rows.groupBy("vec_id").agg(F.min(F.struct("label", "digest", "dim", "raw")).alias("r")).select("vec_id", "r.label", "r.dim", "r.digest", "r.raw"))
    classes = cut(rows.groupBy("label", "digest").agg(F.min("vec_id").alias("vid"), F.count("*").alias("size"), F.first("dim").alias("dim"), F.first("raw").alias("raw")))
    # a row for each dimension: what may meet decides on the lines
    most = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    shapes = {r.dim: shape(r.n) for r in most}
    width = window(threshold)
    lists = cut(classes.select("vid", "dim", "raw").mapInArrow(_listed(shapes), "vid long, lines array<long>, places array<float>"))
    named = classes.select("vid", "label", "dim").join(lists, "vid")
    posts = named.select("vid", F.explode(F.arrays_zip("lines", "places")).alias("p"), "label", "dim")
    posts = cut(posts.select(F.xxhash64("label", "dim", "p.lines").alias("key"), "vid", F.col("p.places").alias("place")))
    sizes = cut(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))

    # short lists: pairs in a window, counted for each pair, then verified
    short = posts.join(sizes.where(f"n <= {SHORT}").select("key"), "key", "left_semi")
    events = short.repartition("key").sortWithinPartitions("key").mapInArrow(_paired(width), "a long, b long")
    needs = {d: calibrated(d, k, t, threshold) for d, (k, t) in shapes.items()}
    counted = events.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min(needs.values(), default=1))
    long = posts.join(sizes.where(f"n > {SHORT}"), "key")
    held = cut(long.groupBy("vid").agg(F.array_sort(F.collect_list("key")).alias("held")))
    own = classes.select("vid", "dim", "raw", "size").join(held, "vid", "left")
    need = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in needs.items()], F.lit(1))
    a = own.select(F.col("vid").alias("a"), F.col("raw").alias("raw_a"), F.col("held").alias("held_a"), F.col("size").alias("size_a"), need.alias("need"))
    b = own.select(F.col("vid").alias("b"), F.col("raw").alias("raw_b"), F.col("held").alias("held_b"), F.col("size").alias("size_b"))
    both = counted.join(a, "a").where("n >= need").join(b, "b").select("a", "b", "raw_a", "raw_b", "held_a", "held_b", "size_a", "size_b")
    links = cut(both.mapInArrow(_verified(threshold), "a long, b long, size_a long, size_b long"))

    # long lists: blocks meet blocks; side tells which of the two a row is in
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    each = long.select("key", "vid", blocks.alias("blocks"), F.pmod(F.xxhash64("vid"), blocks).cast("int").alias("block"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("key", "vid", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    each = each.join(own.drop("dim"), "vid").join(lists, "vid")
    dense = cut(each.groupBy("key", "lo", "hi").applyInArrow(_dense(threshold, shapes), "vid long, degree long, root long"))

    degrees = dense.select("vid", "degree").union(links.select("a", "size_b")).union(links.select("b", "size_a")).groupBy("vid").agg(F.sum("degree").alias("degree"))
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(dense.select("vid", "root"))
    roots = components(edges).withColumnRenamed("node", "vid")
    # classes of one vector without links are as they were
    said = classes.select("label", "digest", "vid", "size").join(degrees, "vid", "left").join(roots, "vid", "left").where("size > 1 or degree is not null")
    zero = F.lit(0).cast("long")
    said = said.select("label", "digest", (F.coalesce("degree", zero) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "vid").alias("root"))
    result = rows.select("vec_id", "label", "digest").join(said, ["label", "digest"]).select("vec_id", "n_links", "root")
    out = src.select("vec_id").join(result, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
