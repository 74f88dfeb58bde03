"""Graph families. Deterministic ones are ranges and joins; random ones draw from hashes of seed and ends,
so that a seed gives one graph whatever the partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import GraphError
from lattica.operators.model import Graph


def _graph(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> Graph:
    n = nodes if "ord" in nodes.columns else nodes.withColumn("ord", F.col("id"))
    return Graph(n, edges.withColumn("ord", F.struct("src", "dst")), directed)


def _nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def _none(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))


def empty_graph(spark, n: int, directed: bool = False) -> Graph:
    return _graph(_nodes(spark, n), _none(spark), directed)


def _path(spark, n: int, at: int = 0) -> DataFrame:
    return spark.range(at, at + max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def path_graph(spark, n: int, directed: bool = False) -> Graph:
    return _graph(_nodes(spark, n), _path(spark, n), directed)


def cycle_graph(spark, n: int, directed: bool = False) -> Graph:
    """A cycle of n nodes; one node has a loop, and two undirected ones a single edge."""
    e = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return _graph(_nodes(spark, n), e, directed)


def _complete(spark, n: int, at: int = 0, directed: bool = False) -> DataFrame:
    # the result is quadratic by definition: every row makes its own partners
    e = spark.range(at, at + n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(at), F.lit(at + n - 1))).alias("dst")) if n > 0 else _none(spark)
    return e.where("src <> dst" if directed else "src < dst").select("src", F.col("dst").cast("long").alias("dst"))


def complete_graph(spark, n: int, directed: bool = False) -> Graph:
    return _graph(_nodes(spark, n), _complete(spark, n, 0, directed), directed)


def complete_multipartite_graph(spark, *sizes: int, directed: bool = False) -> Graph:
    """Parts in turn, all linked to the others; nodes carry their part as subset."""
    bounds = np.cumsum([0, *sizes]).tolist()
    part = sum(((F.col("id") >= b).cast("int") for b in bounds[1:-1]), F.lit(0))
    n = spark.range(bounds[-1]).withColumn("subset", part)
    nxt = F.get(F.array(*[F.lit(b) for b in bounds[1:]]), F.col("subset"))
    e = n.where(nxt < bounds[-1]).select(F.col("id").alias("src"), F.explode(F.sequence(nxt.cast("long"), F.lit(bounds[-1] - 1).cast("long"))).alias("dst"))
    if directed:
        e = e.union(e.select("dst", "src"))
    return _graph(n, e, directed)


def complete_bipartite_graph(spark, n1: int, n2: int, directed: bool = False) -> Graph:
    g = complete_multipartite_graph(spark, n1, n2)
    return Graph(g.nodes.withColumnRenamed("subset", "bipartite"), g.edges, directed)


def turan_graph(spark, n: int, r: int) -> Graph:
    """r parts of n nodes as even as can be, the larger ones last."""
    return complete_multipartite_graph(spark, *[n // r] * (r - n % r), *[n // r + 1] * (n % r))


def star_graph(spark, n: int, directed: bool = False) -> Graph:
    return _graph(_nodes(spark, n + 1), spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")), directed)


def wheel_graph(spark, n: int) -> Graph:
    """A hub, 0, and a cycle of n - 1 nodes around it."""
    rim = cycle_graph(spark, n - 1).edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    return _graph(_nodes(spark, n), star_graph(spark, n - 1).edges.select("src", "dst").union(rim))


def grid_graph(spark, rows: int, cols: int, periodic: bool = False) -> Graph:
    """rows x cols nodes, id row * cols + column; an axis of two or fewer never wraps."""
    n = spark.range(rows * cols).select("id", (F.col("id") / cols).cast("long").alias("r"), (F.col("id") % cols).alias("c"))
    right = n.where(F.col("c") + 1 < cols).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = n.where(F.col("r") + 1 < rows).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    e = right.union(down)
    if periodic and cols > 2:
        e = e.union(n.where("c = 0").select(F.col("id").alias("src"), (F.col("id") + cols - 1).alias("dst")))
    if periodic and rows > 2:
        e = e.union(n.where("r = 0").select(F.col("id").alias("src"), (F.col("id") + (rows - 1) * cols).alias("dst")))
    return _graph(n, e)


def hypercube_graph(spark, d: int, directed: bool = False) -> Graph:
    bit = F.explode(F.sequence(F.lit(0), F.lit(d - 1))) if d else F.explode(F.array().cast("array<int>"))
    e = spark.range(1 << d).select("id", bit.alias("k")).select("id", F.expr("shiftleft(1L, k)").alias("b")).where(F.col("id").bitwiseAND(F.col("b")) == 0)
    return _graph(_nodes(spark, 1 << d), e.select(F.col("id").alias("src"), F.col("id").bitwiseOR(F.col("b")).alias("dst")), directed)


def balanced_tree(spark, r: int, h: int, directed: bool = False) -> Graph:
    n = h + 1 if r == 1 else 1 if r == 0 else (r ** (h + 1) - 1) // (r - 1)
    return _graph(_nodes(spark, n), spark.range(1, n).select(((F.col("id") - 1) / max(1, r)).cast("long").alias("src"), F.col("id").alias("dst")), directed)


def binomial_tree(spark, k: int, directed: bool = False) -> Graph:
    """2^k nodes; a node's parent lacks its lowest set bit."""
    return _graph(_nodes(spark, 1 << k), spark.range(1, 1 << k).select(F.col("id").bitwiseAND(F.col("id") - 1).alias("src"), F.col("id").alias("dst")), directed)


def ladder_graph(spark, n: int) -> Graph:
    rungs = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"))
    return _graph(_nodes(spark, 2 * n), _path(spark, n).union(_path(spark, n, n)).union(rungs))


def circular_ladder_graph(spark, n: int) -> Graph:
    if n < 2:
        raise GraphError("two rungs at least")
    g = ladder_graph(spark, n)
    ends = spark.createDataFrame([(0, n - 1), (n, 2 * n - 1)], "src long, dst long")
    return _graph(g.nodes, g.edges.select("src", "dst").union(ends).distinct())


def lollipop_graph(spark, m: int, n: int) -> Graph:
    return _graph(_nodes(spark, m + n), _complete(spark, m).union(_path(spark, n + 1, m - 1)))


def barbell_graph(spark, m1: int, m2: int) -> Graph:
    return _graph(_nodes(spark, 2 * m1 + m2), _complete(spark, m1).union(_path(spark, m2 + 2, m1 - 1)).union(_complete(spark, m1, m1 + m2)))


def petersen_graph(spark) -> Graph:
    """An outer five-cycle, its spokes, and an inner pentagram."""
    k = spark.range(5)
    outer = k.select(F.least("id", (F.col("id") + 1) % 5).alias("src"), F.greatest("id", (F.col("id") + 1) % 5).alias("dst"))
    inner = k.select((F.least("id", (F.col("id") + 2) % 5) + 5).alias("src"), (F.greatest("id", (F.col("id") + 2) % 5) + 5).alias("dst"))
    return _graph(_nodes(spark, 10), outer.union(k.select(F.col("id").alias("src"), (F.col("id") + 5).alias("dst"))).union(inner))


# random families


def coin(seed: int, *cols: str | Column) -> Column:
    """A uniform number in [0, 1) for a seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / float(1 << 52)


def erdos_renyi(spark, n: int, p: float, directed: bool = False, seed: int = 0) -> Graph:
    """Each pair by its own chance: rows skip over their partners geometrically, so the work follows the edges."""
    def skip(batches):
        import pandas as pd

        for b in batches:
            out = []
            for u in b["id"]:
                rng = np.random.default_rng([seed, int(u)])
                lo, hi = (0, n) if directed else (int(u) + 1, n)
                at = lo - 1
                while p > 0:
                    step = 1 if p >= 1 else int(math.log(1 - rng.random()) / math.log(1 - p)) + 1
                    at += step
                    if at >= hi:
                        break
                    if at != u:
                        out.append((u, at))
            yield pd.DataFrame(out, columns=["src", "dst"])

    return _graph(_nodes(spark, n), spark.range(n).mapInPandas(skip, "src long, dst long"), directed)


def gnm_random_graph(spark, n: int, m: int, seed: int = 0) -> Graph:
    """Exactly m edges (all if there are fewer): distinct pairs drawn with some to spare, the smallest hashes kept."""
    total = n * (n - 1) // 2
    if m >= total:
        return complete_graph(spark, n)
    if 4 * m >= total:
        pairs = _complete(spark, n)
    else:
        draws = spark.range(2 * m + 100).select((coin(seed, F.lit("u"), "id") * n).cast("long").alias("a"), (coin(seed, F.lit("v"), "id") * n).cast("long").alias("b"))
        pairs = draws.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return _graph(_nodes(spark, n), pairs.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(m))


def stochastic_block_model(spark, sizes: list[int], p: list[list[float]], seed: int = 0) -> Graph:
    """Undirected; nodes carry their block. Each node skips through each block by its chance."""
    bounds = np.cumsum([0, *sizes]).tolist()

    def skip(batches):
        import pandas as pd

        for b in batches:
            out = []
            for u in b["id"]:
                a = int(np.searchsorted(bounds, u, "right")) - 1
                for c in range(a, len(sizes)):
                    rng = np.random.default_rng([seed, int(u), c])
                    at, chance = max(int(u), bounds[c] - 1), p[a][c]
                    while chance > 0:
                        at += 1 if chance >= 1 else int(math.log(1 - rng.random()) / math.log(1 - chance)) + 1
                        if at >= bounds[c + 1]:
                            break
                        out.append((u, at))
            yield pd.DataFrame(out, columns=["src", "dst"])

    block = sum(((F.col("id") >= b).cast("int") for b in bounds[1:-1]), F.lit(0))
    return _graph(spark.range(bounds[-1]).withColumn("block", block), spark.range(bounds[-1]).mapInPandas(skip, "src long, dst long"))


def planted_partition(spark, blocks: int, size: int, p_in: float, p_out: float, seed: int = 0) -> Graph:
    return stochastic_block_model(spark, [size] * blocks, [[p_in if a == b else p_out for b in range(blocks)] for a in range(blocks)], seed)


def random_geometric(spark, n: int, radius: float, seed: int = 0) -> Graph:
    """Points of the unit square within the radius: an equality join on cells and their neighbours, then the distance."""
    pts = spark.range(n).select("id", coin(seed, F.lit("x"), "id").alias("x"), coin(seed, F.lit("y"), "id").alias("y"))
    cell = pts.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    near = F.sequence(F.lit(-1), F.lit(1))
    wide = cell.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), "cx", "cy")
    wide = wide.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})
    e = wide.join(cell.withColumnRenamed("id", "dst"), ["cx", "cy"]).where("src < dst").where((F.col("x") - F.col("x1")) ** 2 + (F.col("y") - F.col("y1")) ** 2 <= radius * radius)
    return _graph(pts, e.select("src", "dst"))


def configuration_model(spark, degrees: list[int], seed: int = 0) -> Graph:
    """Random pairs of stubs; loops and repeated edges are dropped."""
    if sum(degrees) % 2:
        raise GraphError("an odd sum of degrees")
    order = np.random.default_rng(seed).permutation(np.repeat(np.arange(len(degrees)), degrees))
    rows = [(int(min(a, b)), int(max(a, b))) for a, b in order.reshape(-1, 2)]
    return _graph(_nodes(spark, len(degrees)), spark.createDataFrame(rows, "src long, dst long").where("src <> dst").distinct())


def _driver(spark, n: int, edges: list[tuple[int, int]], directed: bool = False) -> Graph:
    return _graph(_nodes(spark, n), spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long"), directed)


def barabasi_albert(spark, n: int, m: int, seed: int = 0) -> Graph:
    """Growth by preferential attachment from a star of m leaves; a sequence by nature, made on the driver."""
    rng = np.random.default_rng(seed)
    edges = [(0, k) for k in range(1, m + 1)]
    ends = [x for e in edges for x in e]
    for v in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(ends[int(rng.integers(len(ends)))])
        for u in sorted(chosen):
            edges.append((u, v))
            ends += [u, v]
    return _driver(spark, n, edges)


def watts_strogatz(spark, n: int, k: int, p: float, seed: int = 0) -> Graph:
    """A ring of k neighbours whose far ends move at random with chance p."""
    rng = np.random.default_rng(seed)
    have = {(u, (u + j) % n) if u < (u + j) % n else ((u + j) % n, u) for j in range(1, k // 2 + 1) for u in range(n)}
    degree = np.bincount(np.array(sorted(have), np.int64).ravel(), minlength=n) if have else np.zeros(n, np.int64)
    for j in range(1, k // 2 + 1):
        for u in range(n):
            e = tuple(sorted((u, (u + j) % n)))
            if rng.random() < p and e in have and degree[u] < n - 1:
                w = int(rng.integers(n))
                while w == u or tuple(sorted((u, w))) in have:
                    w = int(rng.integers(n))
                have.remove(e)
                have.add(tuple(sorted((u, w))))
                degree[(u + j) % n] -= 1
                degree[w] += 1
    return _driver(spark, n, sorted(have))


def random_tree(spark, n: int, seed: int = 0) -> Graph:
    """Uniform among labelled trees, from a Pruefer sequence."""
    if n < 2:
        return empty_graph(spark, n)
    import heapq

    seq = np.random.default_rng(seed).integers(0, n, n - 2).tolist()
    left = np.bincount(np.array(seq, np.int64), minlength=n) + 1
    leaves = [k for k in range(n) if left[k] == 1]
    heapq.heapify(leaves)
    edges = []
    for v in seq:
        u = heapq.heappop(leaves)
        edges.append((min(u, v), max(u, v)))
        left[v] -= 1
        if left[v] == 1:
            heapq.heappush(leaves, v)
    a, b = heapq.heappop(leaves), heapq.heappop(leaves)
    return _driver(spark, n, [*edges, (min(a, b), max(a, b))])


def random_dag(spark, n: int, p: float | None = None, seed: int = 0) -> Graph:
    """Arcs forward in a hidden random order."""
    g = erdos_renyi(spark, n, min(1.0, 3 / max(1, n - 1)) if p is None else p, seed=seed)
    rank = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    fwd = rank("src") < rank("dst")
    return _graph(g.nodes, g.edges.select(F.when(fwd, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(fwd, F.col("dst")).otherwise(F.col("src")).alias("dst")), True)


def layered_dag(spark, layers: list[int], p: float = 0.4, seed: int = 0) -> Graph:
    """Arcs between consecutive layers by chance; a node without one before gets one."""
    bounds = np.cumsum([0, *layers]).tolist()
    layer = sum(((F.col("id") >= b).cast("int") for b in bounds[1:-1]), F.lit(0))
    n = spark.range(bounds[-1]).withColumn("layer", layer)
    lo = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("layer") - 1)
    hi = F.get(F.array(*[F.lit(b) for b in bounds]), F.col("layer"))
    cand = n.where("layer > 0").select(F.col("id").alias("dst"), F.explode(F.sequence(lo.cast("long"), (hi - 1).cast("long"))).alias("src"))
    drawn = cand.where(coin(seed, "src", "dst") < p)
    first = cand.groupBy("dst").agg(F.min_by("src", coin(seed, F.lit("first"), "src", "dst")).alias("src"))
    return _graph(n, drawn.select("src", "dst").union(first.join(drawn, "dst", "left_anti").select("src", "dst")), True)


def powerlaw_cluster(spark, n: int, m: int, p: float, seed: int = 0) -> Graph:
    """Growth by preferential attachment; after each such edge, with chance p, one to a neighbour of its end."""
    if not 1 <= m < n or not 0 <= p <= 1:
        raise GraphError("needs 1 <= m < n and a chance p")
    rng = np.random.default_rng(seed)
    near: list[set[int]] = [set() for _ in range(n)]
    ends = list(range(m))
    for v in range(m, n):
        last = None
        while len(near[v]) < m:
            close = sorted(near[last] - near[v] - {v}) if last is not None and rng.random() < p else []
            u = close[int(rng.integers(len(close)))] if close else ends[int(rng.integers(len(ends)))]
            last = u if not close else last
            if u not in near[v]:
                near[v].add(u)
                near[u].add(v)
                ends.append(u)
        ends += [v] * m
    return _driver(spark, n, [(u, v) for u in range(n) for v in near[u] if u < v])


def random_regular(spark, d: int, n: int, seed: int = 0, max_tries: int = 1000) -> Graph:
    """Every node has d neighbours: stubs pair at random where that makes no loop or repeat; a dead end starts again."""
    if d * n % 2 or not 0 <= d < max(n, 1):
        raise GraphError("d n must be even, and d below n")
    rng = np.random.default_rng(seed)
    for _ in range(max_tries):
        have: set[tuple[int, int]] = set()
        stubs = np.repeat(np.arange(n), d)
        while len(stubs):
            pairs = rng.permutation(stubs).reshape(-1, 2)
            rest = []
            for a, b in pairs.tolist():
                e = (min(a, b), max(a, b))
                if a == b or e in have:
                    rest += [a, b]
                else:
                    have.add(e)
            left = set(rest)
            if len(rest) == len(stubs) and not any((min(a, b), max(a, b)) not in have for a in left for b in left if a != b):
                break
            stubs = np.array(rest, np.int64)
        if not len(stubs):
            return _driver(spark, n, sorted(have))
    raise GraphError(f"no regular graph in {max_tries} tries")


def random_task_dag(spark, n: int, seed: int = 0) -> Graph:
    """A project network: each task but the first waits for one to three of the eight before it.

    Tasks carry three-point estimates (min, mode, max) and the mode as duration.
    """
    rng = np.random.default_rng(seed)
    edges = [(int(u), v) for v in range(1, n) for u in rng.choice(np.arange(max(0, v - 8), v), min(v, int(rng.integers(1, 4))), replace=False)]
    mode = rng.integers(1, 11, n)
    rows = [(k, float(mode[k]), float(mode[k]) * (0.5 + 0.4 * rng.random()), float(mode[k]), float(mode[k]) * (1.2 + 1.3 * rng.random())) for k in range(n)]
    nodes = spark.createDataFrame(rows, "id long, duration double, min double, mode double, max double")
    return _graph(nodes, _driver(spark, n, edges, True).edges.select("src", "dst"), True)


# fixed values: marriages among Florentine families (Padgett, 1994)
FLORENTINE = [
    ("Acciaiuoli", "Medici"), ("Castellani", "Peruzzi"), ("Castellani", "Strozzi"), ("Castellani", "Barbadori"), ("Medici", "Barbadori"),
    ("Medici", "Ridolfi"), ("Medici", "Tornabuoni"), ("Medici", "Albizzi"), ("Medici", "Salviati"), ("Salviati", "Pazzi"),
    ("Peruzzi", "Strozzi"), ("Peruzzi", "Bischeri"), ("Strozzi", "Ridolfi"), ("Strozzi", "Bischeri"), ("Ridolfi", "Tornabuoni"),
    ("Tornabuoni", "Guadagni"), ("Albizzi", "Ginori"), ("Albizzi", "Guadagni"), ("Bischeri", "Guadagni"), ("Guadagni", "Lamberteschi"),
]


def florentine_families(spark) -> Graph:
    """Fifteen families joined by marriages; ids are names."""
    e = spark.createDataFrame(FLORENTINE, "src string, dst string")
    return Graph.from_edges(e)
