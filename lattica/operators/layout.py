"""Positions (id, x, y). Closed-form layouts are expressions over the order; spectral ones are small kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import SizeLimitError
from lattica.operators.model import Graph
from lattica.sources.generators import coin


def _numbered(g: Graph) -> DataFrame:
    """(id, k, n): a drawing places nodes by their number, so it is made for graphs that can be looked at."""
    k = F.row_number().over(Window.orderBy("ord")) - 1
    return g.nodes.select("id", k.alias("k")).crossJoin(F.broadcast(g.nodes.agg(F.count("*").alias("n"))))


def circular(g: Graph, start_angle: float = -90.0) -> DataFrame:
    a = F.lit(math.radians(start_angle)) + 2 * math.pi * F.col("k") / F.col("n")
    return _numbered(g).select("id", F.cos(a).alias("x"), F.sin(a).alias("y"))


def arc(g: Graph) -> DataFrame:
    return _numbered(g).select("id", F.col("k").cast("double").alias("x"), F.lit(0.0).alias("y"))


def grid(g: Graph, columns: int | None = None) -> DataFrame:
    c = F.lit(columns) if columns else F.ceil(F.sqrt("n"))
    return _numbered(g).select("id", (F.col("k") % c).cast("double").alias("x"), F.floor(F.col("k") / c).cast("double").alias("y"))


def spiral(g: Graph, turns: float = 3.0) -> DataFrame:
    """Archimedean, at even distances along it."""
    t = 2 * math.pi * turns * F.sqrt(F.col("k") / F.greatest(F.col("n") - 1, F.lit(1)))
    return _numbered(g).select("id", (t * F.cos(t)).alias("x"), (t * F.sin(t)).alias("y"))


def random(g: Graph, seed: int = 0) -> DataFrame:
    return g.nodes.select("id", coin(seed, F.lit("x"), "id").alias("x"), coin(seed, F.lit("y"), "id").alias("y"))


def layered(g: Graph) -> DataFrame:
    """Acyclic graphs: the level, and the place in it by graph order."""
    from lattica.plans.iterate import dag_levels

    place = F.row_number().over(Window.partitionBy("level").orderBy("ord")) - 1
    return dag_levels(g).select("id", place.cast("double").alias("x"), F.col("level").cast("double").alias("y"))


def bipartite(g: Graph) -> DataFrame:
    from lattica.plans.iterate import bipartite_sets

    place = F.row_number().over(Window.partitionBy("side").orderBy("id")) - 1
    return bipartite_sets(g).select("id", F.col("side").cast("double").alias("x"), place.cast("double").alias("y"))


def spectral(g: Graph, limit: int = 1500) -> DataFrame:
    """The second and third eigenvectors of the normalised Laplacian."""
    from lattica.operators.local import laplacian_coo

    ids = [r[0] for r in g.nodes.orderBy("ord").select("id").collect()]
    if len(ids) > limit:
        raise SizeLimitError(f"{len(ids)} nodes; the limit is {limit}")
    at, a = {k: i for i, k in enumerate(ids)}, np.zeros((len(ids), len(ids)))
    for i, j, v in laplacian_coo(g, None, normalized=True).collect():
        a[at[i], at[j]] += v
    _, vec = np.linalg.eigh(a)
    pad = np.concatenate([vec, np.zeros((len(ids), 3))], axis=1)
    return g.nodes.sparkSession.createDataFrame([(k, float(pad[i, 1]), float(pad[i, 2])) for k, i in at.items()], "id long, x double, y double")


def force(g: Graph, iterations: int = 100, seed: int = 0) -> DataFrame:
    """Fruchterman-Reingold steps: springs are a join with the arcs, repulsion acts between cells' centres, so
    a step costs arcs plus nodes times occupied cells."""
    from lattica.plans.lineage import cut

    n = max(1, g.count_nodes())
    k, a = math.sqrt(1 / n), cut(g.arcs().where("src <> dst").select("src", "dst"))
    p = cut(random(g, seed))
    side = max(1, int(math.sqrt(math.sqrt(n))))
    for step in range(iterations):
        heat = 0.1 * (1 - step / iterations)
        ends = a.join(p.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1")), "src").join(p.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst")
        gap = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
        pull = ends.groupBy(F.col("src").alias("id")).agg(F.sum((F.col("x2") - F.col("x1")) * gap / k).alias("px"), F.sum((F.col("y2") - F.col("y1")) * gap / k).alias("py"))
        cells = p.groupBy(F.floor(F.col("x") * side).alias("cx"), F.floor(F.col("y") * side).alias("cy")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("m"))
        # the occupied cells are at most the square root of the nodes within the unit square
        d2 = F.greatest((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2, F.lit(1e-6))
        push = p.crossJoin(F.broadcast(cells)).groupBy("id").agg(F.sum(F.col("m") * (F.col("x") - F.col("mx")) * k * k / d2).alias("qx"), F.sum(F.col("m") * (F.col("y") - F.col("my")) * k * k / d2).alias("qy"))
        j = p.join(pull, "id", "left").join(push, "id")
        fx, fy = F.coalesce("px", F.lit(0.0)) + F.col("qx"), F.coalesce("py", F.lit(0.0)) + F.col("qy")
        size = F.greatest(F.sqrt(fx * fx + fy * fy), F.lit(1e-9))
        move = F.least(size, F.lit(heat)) / size
        inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        p = cut(j.select("id", inside(F.col("x") + fx * move).alias("x"), inside(F.col("y") + fy * move).alias("y")))
    return p


def to_svg(g: Graph, positions: DataFrame, size: int = 600) -> str:
    """A plain drawing of a graph that the driver can hold."""
    at = {r["id"]: (r["x"], r["y"]) for r in positions.collect()}
    xs, ys = [p[0] for p in at.values()] or [0], [p[1] for p in at.values()] or [0]
    span = max(max(xs) - min(xs), max(ys) - min(ys)) or 1
    place = {k: (20 + (x - min(xs)) / span * (size - 40), 20 + (y - min(ys)) / span * (size - 40)) for k, (x, y) in at.items()}
    lines = [f'<line x1="{place[e.src][0]:.1f}" y1="{place[e.src][1]:.1f}" x2="{place[e.dst][0]:.1f}" y2="{place[e.dst][1]:.1f}" stroke="#999"/>' for e in g.edges.select("src", "dst").collect()]
    dots = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4"><title>{k}</title></circle>' for k, (x, y) in place.items()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">' + "".join(lines + dots) + "</svg>"


# layouts of graphs that a driver can look at


def _held(g: Graph, limit: int = 5000) -> tuple[list, np.ndarray, list]:
    """(ids in graph order, matrix of hops, pairs of rows that are linked)."""
    ids = [r[0] for r in g.nodes.orderBy("ord").select("id").limit(limit + 1).collect()]
    if len(ids) > limit:
        raise SizeLimitError(f"more than {limit} nodes")
    at = {k: i for i, k in enumerate(ids)}
    pairs = [(at[s], at[d]) for s, d in g.edges.where("src <> dst").select("src", "dst").collect()]
    near: list = [[] for _ in ids]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    hops = np.full((len(ids), len(ids)), np.inf)
    for s in range(len(ids)):
        hops[s, s], front, depth = 0, [s], 0
        while front:
            depth += 1
            front = [v for v in {v for u in front for v in near[u]} if np.isinf(hops[s, v])]
            hops[s, front] = depth
    return ids, hops, pairs


def _placed(g: Graph, ids: list, xy: np.ndarray) -> DataFrame:
    kind = g.nodes.schema["id"].dataType.simpleString()
    return g.nodes.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in zip(ids, xy)], f"id {kind}, x double, y double")


def graph_distances(g: Graph) -> DataFrame:
    """(src, dst, dist) in hops, directions aside; pairs that no path joins are one hop beyond the longest."""
    ids, hops, _ = _held(g)
    far = (hops[np.isfinite(hops)].max() if len(ids) else 0) + 1
    kind = g.nodes.schema["id"].dataType.simpleString()
    rows = [(a, b, float(min(hops[i, j], far))) for i, a in enumerate(ids) for j, b in enumerate(ids)]
    return g.nodes.sparkSession.createDataFrame(rows, f"src {kind}, dst {kind}, dist double")


def shell(g: Graph, shells: list[list] | None = None) -> DataFrame:
    """Rings around the centre, by default one for each distance from the first node; a first ring of one is the centre."""
    ids, hops, _ = _held(g)
    if shells is None:
        own = np.where(np.isfinite(hops[0]), hops[0], hops[0][np.isfinite(hops[0])].max() + 1).astype(int) if ids else np.zeros(0, int)
        shells = [[ids[i] for i in np.nonzero(own == k)[0]] for k in range(own.max() + 1)] if ids else []
    place, radius = {}, 0.0 if shells and len(shells[0]) == 1 else 1.0
    for ring in shells:
        for k, n in enumerate(ring):
            place[n] = (radius * math.cos(2 * math.pi * k / len(ring)), radius * math.sin(2 * math.pi * k / len(ring)))
        radius += 1
    return _placed(g, list(place), np.array(list(place.values())).reshape(-1, 2))


def tree(g: Graph, root=None) -> DataFrame:
    """A tidy tree: leaves stand side by side, parents above the middle of their children; y is the depth.

    The tree is the one of a breadth-first search from the root (the first node); every component adds its own.
    """
    ids, hops, pairs = _held(g)
    near: list = [[] for _ in ids]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    at, xy, seen, right = {k: i for i, k in enumerate(ids)}, np.zeros((len(ids), 2)), set(), 0
    for start in ([at[root]] if root is not None else []) + list(range(len(ids))):
        if start in seen:
            continue
        order, kids = [start], {start: []}
        seen.add(start)
        for u in order:
            for v in sorted(near[u]):
                if v not in seen:
                    seen.add(v)
                    kids[u].append(v)
                    kids[v] = []
                    xy[v, 1] = xy[u, 1] + 1
                    order.append(v)
        stack = [(start, False)]
        while stack:
            u, done = stack.pop()
            if not kids[u]:
                xy[u, 0], right = right, right + 1
            elif done:
                xy[u, 0] = (xy[kids[u][0], 0] + xy[kids[u][-1], 0]) / 2
            else:
                stack += [(u, True), *((v, False) for v in reversed(kids[u]))]
    return _placed(g, ids, xy)


def radial(g: Graph, root=None) -> DataFrame:
    """tree(), its rows bent into rings around the root."""
    t = tree(g, root)
    width = t.agg(F.max("x").alias("w"))
    a = 2 * math.pi * F.col("x") / (F.col("w") + 1)
    return t.crossJoin(F.broadcast(width)).select("id", (F.col("y") * F.cos(a)).alias("x"), (F.col("y") * F.sin(a)).alias("y"))


def stress(g: Graph, iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Positions whose distances come close to the hops, by majorisation from a circle."""
    ids, hops, _ = _held(g, 2000)
    n = len(ids)
    if n < 2:
        return _placed(g, ids, np.zeros((n, 2)))
    d = np.where(np.isfinite(hops), hops, hops[np.isfinite(hops)].max() + 1)
    np.fill_diagonal(d, 1)
    w = d**-2.0
    np.fill_diagonal(w, 0)
    a = 2 * np.pi * np.arange(n) / n
    x = np.stack([np.cos(a), np.sin(a)], 1) * d.max() / 2
    lap = np.linalg.pinv(np.diag(w.sum(1)) - w)
    last = np.inf
    for _ in range(iterations):
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        now = (w * (gap - d) ** 2).sum() / 2
        if last - now <= tolerance * max(now, 1e-12):
            break
        last = now
        b = -np.where(gap > 1e-12, w * d / np.maximum(gap, 1e-12), 0)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        x = lap @ (b @ x)
    return _placed(g, ids, x)


def force_atlas2(g: Graph, iterations: int = 100, scaling: float = 2.0, gravity: float = 1.0, seed: int = 0) -> DataFrame:
    """Linear springs, repulsion by degree, and a pull to the centre; a node's speed falls as it swings."""
    ids, _, pairs = _held(g, 2000)
    n = len(ids)
    x, e = np.random.default_rng(seed).uniform(-1, 1, (n, 2)), np.array(pairs, np.int64).reshape(-1, 2)
    mass = np.bincount(e.ravel(), minlength=n) + 1.0
    old = np.zeros((n, 2))
    for _ in range(iterations):
        gap = x[:, None] - x[None]
        d2 = np.maximum((gap**2).sum(2), 1e-4)
        f = (scaling * (mass[:, None] * mass[None] / d2)[..., None] * gap).sum(1) - gravity * mass[:, None] * x / np.maximum(np.sqrt((x**2).sum(1)), 1e-9)[:, None]
        pull = x[e[:, 1]] - x[e[:, 0]]
        np.add.at(f, e[:, 0], pull)
        np.add.at(f, e[:, 1], -pull)
        swing, size = np.sqrt(((f - old) ** 2).sum(1)), np.sqrt((f**2).sum(1))
        speed = 0.1 / (1 + np.sqrt(swing))
        x = x + f * np.minimum(speed, 10 / np.maximum(size, 1e-9))[:, None]
        old = f
    return _placed(g, ids, x)


def remove_overlaps(positions: DataFrame, distance: float, iterations: int = 200) -> DataFrame:
    """Positions (id, x, y) moved apart until no two are closer than the distance, or the iterations are over."""
    rows = positions.orderBy("id").collect()
    ids, x = [r["id"] for r in rows], np.array([(r["x"], r["y"]) for r in rows], float).reshape(-1, 2)
    x = x + 1e-9 * np.arange(len(ids))[:, None] * np.array([1.0, 0.5])  # equal places part
    for _ in range(iterations):
        gap = x[:, None] - x[None]
        d = np.sqrt((gap**2).sum(2))
        np.fill_diagonal(d, np.inf)
        short = np.maximum(0, distance - d)
        if not (short > 1e-9).any():
            break
        x = x + (gap / np.maximum(d, 1e-12)[..., None] * (short / 2 * 1.01)[..., None]).sum(1)
    kind = positions.schema["id"].dataType.simpleString()
    return positions.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in zip(ids, x)], f"id {kind}, x double, y double")


def pack_components(g: Graph, positions: DataFrame, gap: float = 1.0) -> DataFrame:
    """Each component's drawing moved into rows of a near square, the largest first."""
    from lattica.plans.iterate import weak_components

    p = positions.join(weak_components(g), "id")
    box = p.groupBy("root").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count("*").alias("n"))
    boxes = box.orderBy(F.desc("n"), "root").collect()
    wide = math.sqrt(sum((b["w"] + gap) * (b["h"] + gap) for b in boxes))
    x = y = high = 0.0
    moves = []
    for b in boxes:
        if x > 0 and x + b["w"] > wide:
            x, y, high = 0.0, y + high + gap, 0.0
        moves.append((b["root"], x - b["x0"], y - b["y0"]))
        x, high = x + b["w"] + gap, max(high, b["h"])
    kind = g.nodes.schema["id"].dataType.simpleString()
    m = g.nodes.sparkSession.createDataFrame(moves, f"root {kind}, dx double, dy double")
    return p.join(F.broadcast(m), "root").select("id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))


LAYOUTS = {
    "circular": circular, "arc": arc, "grid": grid, "spiral": spiral, "random": random, "hierarchical": layered, "bipartite": bipartite, "spectral": spectral,
    "force": force, "shell": shell, "tree": tree, "radial": radial, "stress": stress, "force_atlas2": force_atlas2,
}


def auto_method(g: Graph) -> str:
    """What suits a graph: levels for acyclic ones, a tree for forests, stress for small ones, force for the rest."""
    from lattica.plans.iterate import is_dag, is_forest

    if g.directed:
        return "hierarchical" if is_dag(g) else "force"
    n = g.count_nodes()
    return "grid" if g.count_edges() == 0 else "tree" if is_forest(g) else "stress" if n <= 500 else "force"


def compute(g: Graph, method: str = "auto", **options) -> DataFrame:
    """Positions by a method's name, or by the one that suits the graph."""
    return LAYOUTS[auto_method(g) if method == "auto" else method](g, **options)
