"""Supersteps: driver loops of joins and aggregations whose state is a checkpointed DataFrame.

A step touches the frontier or the state alone, and a look at the checkpointed state tells whether it was the
last. Loops end at a fix-point; a stated limit that is reached first is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import ConvergenceError, GraphError, NegativeCycleError, NegativeWeightError, NoPathError, SizeLimitError
from lattica.operators.model import Graph, weight_of
from lattica.plans.lineage import cut, numbered

# reachability


def bfs(g: Graph, sources: DataFrame, *, reverse: bool = False, undirected: bool = False, cutoff: int | None = None) -> DataFrame:
    """(id, depth, parent): hops from the nearest of sources(id); a source's parent is null.

    The parent is the smallest of the first discoverers.
    """
    a = g.arcs().select("src", "dst")
    if undirected and g.directed:
        a = a.union(a.select(F.col("dst"), F.col("src"))).distinct()
    elif reverse and g.directed:
        a = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = cut(sources.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi").select("id", F.lit(0).alias("depth"), F.lit(None).cast(g.nodes.schema["id"].dataType).alias("parent")))
    front, depth = seen, 0
    while cutoff is None or depth < cutoff:
        depth += 1
        step = front.select(F.col("id").alias("src")).join(a, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = cut(step.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def bfs_order(g: Graph, sources: DataFrame) -> DataFrame:
    """(id, position): by depth, then the parent's place of the first discoverer's id, then graph order."""
    found = bfs(g, sources).join(g.nodes.select("id", "ord"), "id")
    return numbered(found, "depth", F.asc_nulls_first("parent"), "ord").select("id", "position")


def bfs_layers(g: Graph, sources: DataFrame) -> DataFrame:
    return bfs(g, sources).groupBy("depth").agg(F.array_sort(F.collect_list("id")).alias("nodes"))


def bfs_tree(g: Graph, source: DataFrame, **kw) -> DataFrame:
    """(src, dst, depth) of the tree's arcs."""
    return bfs(g, source, **kw).where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"), "depth")


def _single(g: Graph, node) -> DataFrame:
    g._known(node)
    return g.nodes.where(F.col("id") == node).select("id")


def descendants(g: Graph, node) -> DataFrame:
    return bfs(g, _single(g, node)).where("depth > 0").select("id")


def ancestors(g: Graph, node) -> DataFrame:
    return bfs(g, _single(g, node), reverse=True).where("depth > 0").select("id")


def has_path(g: Graph, source, target) -> bool:
    g._known(source, target)
    return not bfs(g, _single(g, source)).where(F.col("id") == target).isEmpty()


# components


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, root): the smallest id each node of edges(src, dst) reaches; nodes without edges are their own.

    Large-star and small-star rounds (logarithmically many), each two aggregations and two joins.
    """
    cur = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(new.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        cur, state = new, now
    found = new.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    if nodes is None:
        return found.union(new.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def weak_components(g: Graph) -> DataFrame:
    return components(g.edges.select("src", "dst"), g.nodes)


def connected_components(g: Graph) -> DataFrame:
    """(root, size): the largest first, ties by the first node."""
    return weak_components(g.need(False)).groupBy("root").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "root")


def number_connected_components(g: Graph) -> int:
    return weak_components(g.need(False)).select("root").distinct().count()


def number_weakly_connected_components(g: Graph) -> int:
    return weak_components(g.need(True)).select("root").distinct().count()


def number_strongly_connected_components(g: Graph) -> int:
    return strong_components(g).select("root").distinct().count()


def node_connected_component(g: Graph, node) -> DataFrame:
    """(id) of the nodes that a node's component holds, itself included; only they are walked."""
    return bfs(g.need(False), _single(g, node)).select("id")


def is_strongly_connected(g: Graph) -> bool:
    """Whether the first node reaches all others, and all reach it; an empty graph is an error."""
    n = g.need(True).count_nodes()
    first = g.nodes.agg(F.min("id").alias("id"))
    if n == 0:
        raise GraphError("an empty graph is neither connected nor not")
    return bfs(g, first).count() == n and bfs(g, first, reverse=True).count() == n


def is_weakly_connected(g: Graph) -> bool:
    return is_connected(g.need(True))


def is_connected(g: Graph) -> bool:
    return weak_components(g).select("root").distinct().limit(2).count() == 1


def is_forest(g: Graph) -> bool:
    parts = weak_components(g).select("root").distinct().count()
    return g.count_edges() == g.count_nodes() - parts


def is_tree(g: Graph) -> bool:
    return is_connected(g) and is_forest(g)


def strong_components(g: Graph) -> DataFrame:
    """(id, root): nodes that reach each other, root their smallest.

    Rounds of trimming and colouring: every node learns the smallest id that reaches it; the nodes that a
    colour's root is reached from within the colour are its component.
    """
    rest_e = cut(g.need(True).edges.where("src <> dst").select("src", "dst"))
    rest_n = cut(g.nodes.select("id"))
    done = []
    while not rest_n.isEmpty():
        # nodes without arcs in or out are components of their own
        while True:
            both = rest_e.select(F.col("src").alias("id")).intersect(rest_e.select("dst"))
            single = cut(rest_n.join(both, "id", "left_anti"))
            if single.isEmpty():
                break
            done.append(single.select("id", F.col("id").alias("root")))
            rest_n = cut(rest_n.join(single, "id", "left_anti"))
            rest_e = cut(rest_e.join(rest_n.select(F.col("id").alias("src")), "src", "left_semi").join(rest_n.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if rest_n.isEmpty():
            break
        colour = cut(rest_n.select("id", F.col("id").alias("c")))
        while True:
            heard = rest_e.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(heard, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("changed")))
            if new.where("changed").isEmpty():
                break
            colour = new.select("id", "c")
        same = rest_e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = bfs(Graph(rest_n.withColumn("ord", F.col("id")), cut(same), True), colour.where("id = c").select("id"))
        found = cut(back.join(colour, "id").select("id", F.col("c").alias("root")))
        done.append(found)
        rest_n = cut(rest_n.join(found, "id", "left_anti"))
        rest_e = cut(rest_e.join(rest_n.select(F.col("id").alias("src")), "src", "left_semi").join(rest_n.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    out = done[0] if done else g.nodes.select("id", F.col("id").alias("root"))
    for d in done[1:]:
        out = out.union(d)
    least = out.groupBy("root").agg(F.min("id").alias("least"))
    return out.join(least, "root").select("id", F.col("least").alias("root"))


def condensation(g: Graph) -> Graph:
    """Nodes: strong components by their root, with their size; arcs between different ones."""
    c = cut(strong_components(g))
    e = g.edges.join(c.select(F.col("id").alias("src"), F.col("root").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    n = c.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("size")).withColumn("ord", F.col("id"))
    return Graph(n, e.withColumn("ord", F.struct("src", "dst")), True)


def bipartite_sets(g: Graph) -> DataFrame:
    """(id, side): 0 for the first node of each component; an odd cycle or a loop is an error.

    Up to sources.ARC_LIMIT arcs, one task walks compressed rows; beyond it, components and searches are distributed.
    """
    from lattica.operators.kernels import _sides
    from lattica.plans.sources import Rows, one_task

    def walk(rows) -> pd.DataFrame:
        try:
            return pd.DataFrame({"id": rows.ids, "side": _sides(rows).astype(np.int32), "odd": None})
        except GraphError as e:
            return pd.DataFrame({"id": rows.ids[:1], "side": np.int32(-1), "odd": str(e)})

    g = g.to_undirected()
    try:
        rows = Rows(Graph(g.nodes.select("id", F.col("id").alias("ord")), g.edges, False))
    except SizeLimitError:
        rows = None
    if rows is not None:
        found = cut(one_task(g, rows, walk, "id ID, side int, odd string"))
        bad = found.where("odd is not null").first()
        if bad is not None:
            raise GraphError(bad["odd"])
        return found.select("id", "side")
    depth = bfs(g, components(g.edges.select("src", "dst"), g.nodes).select(F.col("root").alias("id")).distinct())
    side = cut(depth.select("id", (F.col("depth") % 2).alias("side")))
    e = g.edges.join(side.select(F.col("id").alias("src"), F.col("side").alias("a")), "src").join(side.select(F.col("id").alias("dst"), F.col("side").alias("b")), "dst")
    bad = e.where("a = b").first()
    if bad is not None:
        raise GraphError(f"an odd cycle passes {bad['src']} - {bad['dst']}")
    return side


def is_bipartite(g: Graph) -> bool:
    try:
        bipartite_sets(g)
    except GraphError:
        return False
    return True


# shortest paths


def sssp(g: Graph, sources: DataFrame, weight=None, *, reverse: bool = False, cutoff: float | None = None, negative: bool = False) -> DataFrame:
    """(source, id, dist) by relaxation of the nodes whose distance fell; any number of sources at once.

    Without `negative` a negative weight is an error; with it, a negative cycle in reach is one.
    """
    a = g.arcs(weight)
    if reverse and g.directed:
        a = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    if not negative and not a.where("w < 0").isEmpty():
        raise NegativeWeightError("a weight is negative")
    a = cut(a.groupBy("src", "dst").agg(F.min("w").alias("w")))
    n = g.count_nodes()
    dist = cut(sources.select(F.col("id").alias("source")).distinct().select("source", F.col("source").alias("id"), F.lit(0.0).alias("dist")))
    front, rounds = dist, 0
    while not front.isEmpty():
        rounds += 1
        if rounds > n + 1:
            raise NegativeCycleError("a cycle of negative weight is in reach")
        step = front.select("source", F.col("id").alias("src"), "dist").join(a, "src").select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("new"))
        if cutoff is not None:
            step = step.where(F.col("new") <= cutoff)
        step = step.groupBy("source", "id").agg(F.min("new").alias("new"))
        both = cut(dist.join(step, ["source", "id"], "full").select("source", "id", F.least("dist", "new").alias("d"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("fell")))
        front = both.where("fell").select("source", "id", F.col("d").alias("dist"))
        dist = both.select("source", "id", F.col("d").alias("dist"))
    return dist


def tight_arcs(g: Graph, dist: DataFrame, weight=None) -> DataFrame:
    """(source, src, dst) of the arcs on shortest paths of sssp()'s dist: all predecessors of each node."""
    a = g.arcs(weight).where("src <> dst")
    j = dist.select("source", F.col("id").alias("src"), F.col("dist").alias("a")).join(a, "src").join(dist.select("source", F.col("id").alias("dst"), F.col("dist").alias("b")), ["source", "dst"])
    return j.where("a + w = b and dst <> source").select("source", "src", "dst")


def shortest_path(g: Graph, source, target, weight=None) -> list:
    """Node list; ties by the smallest predecessor."""
    g._known(source, target)
    dist = sssp(g, _single(g, source), weight, negative=True)
    if dist.where(F.col("id") == target).isEmpty():
        raise NoPathError(f"{source} to {target}")
    parent = cut(tight_arcs(g, dist, weight).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("p")))
    path = [target]
    while path[-1] != source:  # as many steps as the result is long
        path.append(parent.where(F.col("id") == path[-1]).first()["p"])
    return path[::-1]


def simple_paths(g: Graph, source, target, cutoff: int) -> DataFrame:
    """(path): every path without a repeated node, of cutoff edges at most."""
    g._known(source, target)
    a = cut(g.arcs().select("src", "dst"))
    cur = _single(g, source).select(F.array("id").alias("path"))
    out = cur.where(F.get("path", F.size("path") - 1) == target)
    for _ in range(cutoff):
        cur = cut(cur.where(F.get("path", F.size("path") - 1) != target).withColumn("src", F.get("path", F.size("path") - 1)).join(a, "src").where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path")))
        if cur.isEmpty():
            break
        out = out.union(cur.where(F.get("path", F.size("path") - 1) == target))
    return out


def all_shortest_paths(g: Graph, source, target, weight=None) -> DataFrame:
    """(path) for each shortest path."""
    dist = cut(sssp(g, _single(g, source), weight))
    tight = cut(tight_arcs(g, dist, weight).select("src", "dst"))
    cur = g.nodes.where(F.col("id") == target).select(F.array("id").alias("path")).join(dist.where(F.col("id") == target).select(F.lit(1)), how="left_semi")
    out = cur.where(F.lit(source == target))
    while source != target:
        cur = cut(cur.withColumn("dst", F.get("path", F.lit(0))).where(F.col("dst") != source).join(tight, "dst").where(~F.array_contains("path", F.col("src"))).select(F.array_prepend("path", F.col("src")).alias("path")))
        if cur.isEmpty():
            break
        out = out.union(cur.where(F.get("path", F.lit(0)) == source))
    return out


def k_shortest_paths(g: Graph, source, target, k: int, weight=None) -> DataFrame:
    """(path, length): the k shortest simple paths, ties by the path; no path gives no rows. See operators.paths."""
    from lattica.operators.paths import k_shortest_paths as kernel

    return kernel(g, source, target, k, weight)


# spectral measures


def _normalised(x: DataFrame, how: str) -> DataFrame:
    s = x.agg((F.sqrt(F.sum(F.col("value") * F.col("value"))) if how == "l2" else F.sum("value") if how == "sum" else F.max("value")).alias("s"))
    return x.crossJoin(F.broadcast(s)).select("id", F.when(F.col("s") == 0, 0.0).otherwise(F.col("value") / F.col("s")).alias("value"))


def _pull(x: DataFrame, arcs: DataFrame, to: str = "dst", frm: str = "src") -> DataFrame:
    return x.withColumnRenamed("id", frm).join(arcs, frm).groupBy(F.col(to).alias("id")).agg(F.sum(F.col("value") * F.col("w")).alias("got"))


def _iterate(x: DataFrame, step, tol: float | None, max_iter: int, fail: bool = True) -> DataFrame:
    """Applies step until the L1 change is below tol; tol None runs max_iter steps exactly."""
    x = cut(x)
    for _ in range(max_iter):
        new = cut(step(x))
        if tol is not None:
            gap = new.join(x.withColumnRenamed("value", "old"), "id").agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
            if gap < tol:
                return new
        x = new
    if tol is not None and fail:
        raise ConvergenceError(f"no convergence in {max_iter} steps")
    return x


def pagerank(g: Graph, alpha: float = 0.85, weight: str | None = "w", max_iter: int = 100, tol: float | None = 1e-6, personalization: DataFrame | None = None) -> DataFrame:
    """(id, value). Dangling mass goes by personalization(id, value), uniform without one; stops at L1 < n tol."""
    n = g.count_nodes()
    if n == 0:
        return g.nodes.select("id", F.lit(0.0).alias("value"))
    a = g.arcs(weight if weight in g.edges.columns else None)
    out = a.groupBy("src").agg(F.sum("w").alias("s")).where("s <> 0")
    a = cut(a.join(out, "src").select("src", "dst", (F.col("w") / F.col("s")).alias("w")))
    hang = g.nodes.select("id").join(out.select(F.col("src").alias("id")), "id", "left_anti").withColumn("hang", F.lit(1.0))
    base = g.nodes.select("id").withColumn("p", F.lit(1.0 / n)) if personalization is None else g.nodes.select("id").join(_normalised(personalization.select("id", "value"), "sum").withColumnRenamed("value", "p"), "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
    base = cut(base.join(hang, "id", "left"))

    def step(x: DataFrame) -> DataFrame:
        lost = x.join(base.where("hang is not null").select("id"), "id", "left_semi").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("lost"))
        j = base.join(_pull(x, a), "id", "left").crossJoin(F.broadcast(lost))
        return j.select("id", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p")) + (1 - alpha) * F.col("p")).alias("value"))

    return _iterate(g.nodes.select("id", F.lit(1.0 / n).alias("value")), step, None if tol is None else n * tol, max_iter)


def eigenvector_centrality(g: Graph, weight: str | None = None, max_iter: int = 1000, tol: float | None = 1e-6) -> DataFrame:
    """Power iteration on A + I, L2-normalised each step."""
    n, a = g.count_nodes(), cut(g.arcs(weight))

    def step(x: DataFrame) -> DataFrame:
        return _normalised(x.join(_pull(x, a), "id", "left").select("id", (F.col("value") + F.coalesce("got", F.lit(0.0))).alias("value")), "l2")

    return _iterate(g.nodes.select("id", F.lit(1.0 / max(1, n)).alias("value")), step, None if tol is None else n * tol, max_iter)


def katz_centrality(g: Graph, alpha: float = 0.1, beta: float = 1.0, weight: str | None = None, normalized: bool = True, max_iter: int = 1000, tol: float | None = 1e-6) -> DataFrame:
    n, a = g.count_nodes(), cut(g.arcs(weight))

    def step(x: DataFrame) -> DataFrame:
        return x.join(_pull(x, a), "id", "left").select("id", (alpha * F.coalesce("got", F.lit(0.0)) + beta).alias("value"))

    x = _iterate(g.nodes.select("id", F.lit(0.0).alias("value")), step, None if tol is None else n * tol, max_iter)
    return _normalised(x, "l2") if normalized else x


def hits(g: Graph, weight: str | None = "w", max_iter: int = 100, tol: float | None = 1e-8) -> DataFrame:
    """(id, hub, authority), each summing to 1."""
    n = g.count_nodes()
    a = cut(g.arcs(weight if weight in g.edges.columns else None))
    auth: list[DataFrame] = []

    def step(x: DataFrame) -> DataFrame:
        up = _normalised(g.nodes.select("id").join(_pull(x, a), "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("value")), "max")
        auth[:] = [up]
        return _normalised(g.nodes.select("id").join(_pull(up, a, "src", "dst"), "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("value")), "max")

    h = _normalised(_iterate(g.nodes.select("id", F.lit(1.0 / max(1, n)).alias("value")), step, tol, max_iter), "sum")
    return h.withColumnRenamed("value", "hub").join(_normalised(auth[0], "sum").withColumnRenamed("value", "authority"), "id")


# peeling


def core_number(g: Graph) -> DataFrame:
    """(id, ord, value); in and out degrees together if directed; loops don't count.

    Rounds of h-indices: a node's value becomes the largest h of which h neighbours have h or more, starting from its
    degree, until no value falls. A round is one join and two aggregations over a histogram of the neighbours' values.
    """
    from pyspark.sql import Window

    e = g.edges.where("src <> dst").select("src", "dst")
    e = cut(e.union(e.select(F.col("dst"), F.col("src"))).groupBy("src", "dst").agg(F.count("*").alias("c")))
    x = cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("c").alias("value")))
    down = Window.partitionBy("id").orderBy(F.desc("v"))
    while True:
        near = e.join(x.select(F.col("id").alias("dst"), F.col("value").alias("v")), "dst").join(x.select(F.col("id").alias("src"), F.col("value").alias("own")), "src")
        # a neighbour's value beyond one's own counts as one's own
        steps = near.groupBy(F.col("src").alias("id"), "own", F.least("v", "own").alias("v")).agg(F.sum("c").alias("c"))
        steps = steps.withColumn("least", F.least("v", F.sum("c").over(down)))
        new = cut(steps.groupBy("id", "own").agg(F.max("least").alias("value")))
        x = new.select("id", "value")
        if new.where("value <> own").isEmpty():
            break
    return g.nodes.select("id", "ord").join(x, "id", "left").select("id", "ord", F.coalesce("value", F.lit(0).cast("long")).cast("long").alias("value"))


def k_core(g: Graph, k: int | None = None) -> Graph:
    c = cut(core_number(g))
    if k is None:
        k = c.agg(F.max("value")).first()[0] or 0
    return g.subgraph(c.where(F.col("value") >= k).select("id"))


def onion_layers(g: Graph) -> DataFrame:
    """(id, ord, value): the round in which peeling removes a node; isolated nodes share the first with the first peel.

    One state table holds the degrees that are left; a round only walks the edges of the nodes it removed.
    """
    e = g.need(False).edges.where("src <> dst").select("src", "dst")
    e = cut(e.union(e.select(F.col("dst"), F.col("src"))))
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    zero = F.lit(0).cast("long")
    state = cut(g.nodes.select("id", "ord").join(d, "id", "left").select("id", "ord", F.coalesce("d", zero).alias("d"), F.when(F.col("d").isNull(), F.lit(1).cast("long")).alias("value")))
    k, layer = 0, 0
    while (least := state.where("value is null").agg(F.min("d")).first()[0]) is not None:
        k, layer = max(k, least), layer + 1
        gone = state.where(F.col("value").isNull() & (F.col("d") <= k)).select(F.col("id").alias("src"))
        lost = e.join(gone, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("lost"))
        out = F.when(F.col("value").isNull() & (F.col("d") <= k), F.lit(layer).cast("long")).otherwise(F.col("value"))
        state = cut(state.join(lost, "id", "left").select("id", "ord", (F.col("d") - F.coalesce("lost", zero)).alias("d"), out.alias("value")))
    return state.select("id", "ord", "value")


# acyclic graphs


def dag_levels(g: Graph) -> DataFrame:
    """(id, ord, level): the longest path from a source, in edges; a cycle is an error.

    One state table holds the arcs that each node still waits for; a round only walks the arcs of the nodes it freed.
    """
    e = cut(g.need(True).edges.select("src", "dst"))
    waits = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("waits"))
    level = lambda free, k: F.when(free, F.lit(k).cast("long"))
    state = g.nodes.select("id", "ord").join(waits, "id", "left").select("id", "ord", F.coalesce("waits", F.lit(0).cast("long")).alias("waits"))
    state = cut(state.withColumn("level", level(F.col("waits") == 0, 0)))
    k = 0
    while not state.where(F.col("level") == k).isEmpty():
        gone = e.join(state.where(F.col("level") == k).select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("gone"))
        k += 1
        left = F.col("waits") - F.coalesce("gone", F.lit(0).cast("long"))
        state = cut(state.join(gone, "id", "left").select("id", "ord", left.alias("waits"), F.coalesce("level", level(F.col("gone").isNotNull() & (left == 0), k)).alias("level")))
    if not state.where("level is null").isEmpty():
        g.to_dag()  # raises, with the cycle
    return state.select("id", "ord", "level")


def is_dag(g: Graph) -> bool:
    if not g.directed:
        return False
    e, left = cut(g.edges.select("src", "dst")), None
    while not e.isEmpty():
        live = e.join(e.select(F.col("dst").alias("src")), "src", "left_semi").select("src", "dst")
        new = cut(live)
        if new.count() == e.count():
            return False
        e = new
    return left is None


def topological_order(g: Graph) -> DataFrame:
    """(id, position) by level, then graph order."""
    return numbered(dag_levels(g), "level", "ord").select("id", "position")


def _best(g: Graph, node_value, arc_value, levels: DataFrame, forward: bool = True, floor: bool = True) -> DataFrame:
    """Level by level, value = node_value + max over incoming arcs of (their tail's value + arc_value).

    A level hands its values on once, along its own arcs, to running maxima in the state table.
    """
    state = levels.select("id", "level").join(g.nodes.select("id", node_value.cast("double").alias("own")), "id")
    state = cut(state.withColumn("got", F.lit(None).cast("double")))
    top = state.agg(F.max("level")).first()[0]
    a, b = ("src", "dst") if forward else ("dst", "src")
    e = cut(g.edges.select(F.col(a).alias("frm"), F.col(b).alias("to"), arc_value.cast("double").alias("w")))
    gain = F.coalesce("got", F.lit(0.0))
    best = F.col("own") + (F.greatest(gain, F.lit(0.0)) if floor else gain)
    for k in [] if top is None else range(top) if forward else range(top, 0, -1):
        now = state.where(F.col("level") == k).select(F.col("id").alias("frm"), best.alias("best"))
        new = e.join(now, "frm").groupBy(F.col("to").alias("id")).agg(F.max(F.col("best") + F.col("w")).alias("new"))
        state = cut(state.join(new, "id", "left").select("id", "level", "own", F.greatest("got", "new").alias("got")))
    return state.select("id", best.alias("best"))


def longest_path_lengths(g: Graph, weight: str | None = None) -> DataFrame:
    """(id, best): the heaviest path that ends in each node; without a weight its edges count."""
    return _best(g, F.lit(0.0), weight_of(weight), dag_levels(g))


def critical_path(g: Graph, duration: str = "duration", default: float = 1.0) -> DataFrame:
    """(id, es, ef, ls, lf, slack, critical) of tasks whose durations are a node column."""
    lv = cut(dag_levels(g))
    d = F.coalesce(F.col(duration), F.lit(default))
    ef = _best(g, d, F.lit(0.0), lv).withColumnRenamed("best", "ef")
    tail = _best(g, d, F.lit(0.0), lv, forward=False).withColumnRenamed("best", "tail")
    span = ef.agg(F.coalesce(F.max("ef"), F.lit(0.0)).alias("span"))
    j = g.nodes.select("id", d.cast("double").alias("d")).join(ef, "id").join(tail, "id").crossJoin(F.broadcast(span))
    ls = F.col("span") - F.col("tail")
    es = F.col("ef") - F.col("d")
    slack = F.when(F.abs(ls - es) <= 1e-9 * F.greatest(F.lit(1.0), F.col("span")), 0.0).otherwise(ls - es)
    return j.select("id", es.alias("es"), "ef", ls.alias("ls"), (ls + F.col("d")).alias("lf"), slack.alias("slack")).withColumn("critical", F.col("slack") == 0)


def transitive_closure(g: Graph) -> DataFrame:
    """(src, dst) for every path of one edge or more: each round's new pairs take one more arc.

    The rows that are joined are the pairs times the arcs of their heads; doubling would need fewer rounds,
    but meet every pair at every node between its ends.
    """
    e = cut(g.need(True).edges.select("src", "dst").distinct())
    seen, delta, rounds = e, e, 0
    while not delta.isEmpty():
        step = delta.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        delta = cut(step.join(seen, ["src", "dst"], "left_anti"))
        rounds += 1
        seen = cut(seen.union(delta)) if rounds % 4 == 0 else seen.union(delta)
    return seen


def transitive_reduction(g: Graph) -> DataFrame:
    """(src, dst): the arcs that no longer path implies."""
    e = g.edges.select("src", "dst")
    c = transitive_closure(g)
    implied = e.select("src", F.col("dst").alias("mid")).join(c.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    return e.join(implied, ["src", "dst"], "left_anti")


def lowest_common_ancestors(g: Graph, a, b) -> DataFrame:
    up = [bfs(g, _single(g, x), reverse=True).select("id") for x in (a, b)]
    both = cut(up[0].intersect(up[1]))
    inner = g.edges.join(both.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return both.join(inner, "id", "left_anti")


# forests, matchings, colours


def spanning_edges(g: Graph, weight: str | None = "w", maximum: bool = False) -> DataFrame:
    """(src, dst, w) of a minimum (or maximum) spanning forest by Boruvka's rounds; ties by (src, dst).

    A round contracts the parts that its own edges join; the edges left carry the parts' names, so they shrink.
    """
    sign = -1 if maximum else 1
    e = g.need(False).edges.where("src <> dst").select("src", "dst", weight_of(weight).alias("w")).where("w is not null")
    e = cut(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", F.struct((F.col("w") * sign).alias("k"), "src", "dst").alias("key")))
    picked = e.select("key.src", "key.dst", "w").limit(0)
    while not e.isEmpty():
        best = e.select(F.explode(F.array("a", "b")).alias("c"), "a", "b", "key", "w").groupBy("c").agg(F.min(F.struct("key", "a", "b", "w")).alias("m"))
        best = cut(best.select("m.*").distinct())
        picked = cut(picked.union(best.select("key.src", "key.dst", "w")))
        name = cut(components(best.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        e = e.join(name.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(name.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        e = cut(e.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "w", "key"))
    return picked


def spanning_tree(g: Graph, weight: str | None = "w", maximum: bool = False) -> Graph:
    """A minimum (or maximum) spanning forest as a graph of all nodes, with the edges' columns."""
    kept = spanning_edges(g, weight, maximum).select("src", "dst")
    return Graph(g.nodes, g.edges.join(kept, ["src", "dst"], "left_semi").select(*g.edges.columns), False)


def maximal_matching(g: Graph) -> DataFrame:
    """(src, dst): the greedy matching in edge order, found by rounds of locally first edges."""
    e = cut(g.edges.where("src <> dst").select("src", "dst", F.struct("src", "dst").alias("key")))
    out = None
    while not e.isEmpty():
        first = e.select(F.explode(F.array("src", "dst")).alias("id"), "key").groupBy("id").agg(F.min("key").alias("first"))
        win = e.join(first.select(F.col("id").alias("src"), F.col("first").alias("f1")), "src").join(first.select(F.col("id").alias("dst"), F.col("first").alias("f2")), "dst").where("key = f1 and key = f2").select("src", "dst")
        win = cut(win)
        out = win if out is None else out.union(win)
        used = win.select(F.explode(F.array("src", "dst")).alias("id"))
        e = cut(e.join(used.select(F.col("id").alias("src")), "src", "left_anti").join(used.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "key"))
    return out if out is not None else g.edges.select("src", "dst").limit(0)


def greedy_color(g: Graph, strategy: str = "largest_first") -> DataFrame:
    """(id, color): what the greedy rule gives in a fixed order, by rounds of locally first nodes.

    largest_first: by degree, then order; insertion: by order.
    """
    d = g.degree()
    rank = F.struct((-F.col("value")).alias("a"), F.col("ord").alias("b")) if strategy == "largest_first" else F.struct(F.lit(0).alias("a"), F.col("ord").alias("b"))
    r = cut(d.select("id", rank.alias("rank")))
    a = g.arcs().where("src <> dst").select("src", "dst")
    if g.directed:
        a = a.union(a.select(F.col("dst"), F.col("src"))).distinct()
    a = a.join(r.select(F.col("id").alias("src"), F.col("rank").alias("r1")), "src").join(r.select(F.col("id").alias("dst"), F.col("rank").alias("r2")), "dst").where("r2 < r1").select("src", "dst")
    a = cut(a)  # each node waits for its neighbours of a lower rank
    left, color = cut(r.select("id")), None
    while not left.isEmpty():
        waits = a.join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        free = left.join(waits, "id", "left_anti")
        if color is None:
            new = free.select("id", F.lit(0).alias("color"))
        else:
            taken = free.withColumnRenamed("id", "src").join(a, "src").join(color.select(F.col("id").alias("dst"), "color"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("color").alias("used"))
            new = free.join(taken, "id", "left").select("id", F.when(F.col("used").isNull(), 0).otherwise(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))).alias("color"))
        new = cut(new)
        color = new if color is None else cut(color.union(new))
        left = cut(left.join(new, "id", "left_anti"))
    return color if color is not None else left.select("id", F.lit(0).alias("color"))


def label_propagation(g: Graph, weight: str | None = None, max_iter: int = 100) -> DataFrame:
    """(id, label) by rounds: the heaviest label among the neighbours, one's own if it ties, else the smallest.

    In a round about half the nodes, by a hash of id and round, take their label, so that neighbours don't swap labels
    for ever; it ends when no node at all would move. Labels are ids, of any type. Rounds that don't settle are a
    ConvergenceError.

    Up to sources.ARC_LIMIT arcs, one task walks the first rounds over compressed rows, as each distributed round costs the
    driver memory. Beyond it, with negative weights, and after those rounds, the rounds are distributed; labels are the same.
    """
    from lattica.plans.sources import Rows, one_task

    done, size = 0, _TURNS
    turns = {f"t{lo}": _turns(lo, min(lo + size, max_iter)) for lo in range(0, min(max_iter, 5 * size), size)}
    try:
        rows = Rows(Graph(g.nodes.select("id", F.col("id").alias("ord")), g.edges, g.directed), weight, **turns)
    except (SizeLimitError, NegativeWeightError):
        rows = None
    if rows is not None and turns:
        done = min(max_iter, size * len(turns))
        x = cut(one_task(g, rows, lambda r: _row_labels(r, done, size), "id ID, label ID, settled boolean"))
        if x.where("not settled").isEmpty():
            return x.select("id", "label")
    else:
        x = cut(g.nodes.select("id", F.col("id").alias("label")))
    a = cut(g.arcs(weight).where("src <> dst")) if done < max_iter else None
    for k in range(done, max_iter):
        votes = a.join(x.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("s"))
        j = cut(_heaviest(votes, x, "label").select("id", F.when(_turn(k), F.col("new")).otherwise(F.col("old")).alias("label"), (F.col("new") != F.col("old")).alias("moved")))
        if j.where("moved").isEmpty():
            return j.select("id", "label")
        x = j.select("id", "label")
    raise ConvergenceError(f"labels still change after {max_iter} rounds")


#: Rounds whose turns one exact double holds.
_TURNS = 48


def _turn(k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(2)) == 0


def _turns(lo: int, hi: int) -> Column:
    """A bit for each of the rounds: whether it is the node's turn."""
    out = F.lit(0).cast("long")
    for k in range(lo, hi):
        out = out + F.when(_turn(k), F.lit(1 << (k - lo)).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def _row_labels(rows, rounds: int, size: int) -> pd.DataFrame:
    """label_propagation()'s rounds over rows in the order of ids, whose places stand for the labels; size rounds share a column."""
    n, every = rows.n, np.arange(rows.n)
    x, settled = every.copy(), False
    for k in range(rounds):
        new = x.copy()
        for p, arcs in rows.spans(every):
            v = rows.dst[arcs]
            real = v != p
            key = p[real] * n + x[v[real]]
            if rows.weighted:
                key, at = np.unique(key, return_inverse=True)
                s = np.bincount(at, rows.w[arcs[real]])
            else:
                key, s = np.unique(key, return_counts=True)
            if not len(key):
                continue
            u, label = key // n, key % n
            first = np.concatenate([[0], np.nonzero(np.diff(u))[0] + 1])
            most = np.repeat(np.maximum.reduceat(s, first), np.diff(np.append(first, len(u))))
            u, label = u[s == most], label[s == most]
            least = np.concatenate([[0], np.nonzero(np.diff(u))[0] + 1])
            new[u[least]] = label[least]
            own = label == x[u]
            new[u[own]] = label[own]
        if np.array_equal(new, x):
            settled = True
            break
        turn = rows.node[f"t{k - k % size}"].astype(np.int64) >> (k % size) & 1
        x = np.where(turn == 1, new, x)
    return pd.DataFrame({"id": rows.ids, "label": rows.ids[x], "settled": settled})


def _heaviest(votes: DataFrame, x: DataFrame, what: str) -> DataFrame:
    """(id, old, new): the value with the most votes(id, what, s), one's own if it ties, else the smallest."""
    own = x.select("id", F.col(what).alias("old"))
    best = votes.join(own, "id").groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("s"), (F.col(what) != F.col("old")).alias("other"), F.col(what).alias("new"))).alias("best"))
    return own.join(best, "id", "left").select("id", "old", F.coalesce("best.new", "old").alias("new"))


# dynamics in steps


def heat_steps(g: Graph, initial: DataFrame, rate: float, steps: int, weight: str | None = None) -> DataFrame:
    """Explicit Euler steps of dx/dt = -rate L x, on initial(id, value)."""
    a = cut(g.arcs(weight).where("src <> dst"))
    d = a.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))

    def step(x: DataFrame) -> DataFrame:
        j = x.join(_pull(x, a), "id", "left").join(d, "id", "left")
        return j.select("id", (F.col("value") + rate * (F.coalesce("got", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)) * F.col("value"))).alias("value"))

    return _iterate(initial.select("id", "value"), step, None, steps)


def degroot(g: Graph, initial: DataFrame, steps: int, weight: str | None = None, self_weight: float = 1.0) -> DataFrame:
    """x <- W x: the weighted mean of one's own and the in-neighbours' opinions."""
    a = cut(g.arcs(weight).where("src <> dst"))
    d = a.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("d"))

    def step(x: DataFrame) -> DataFrame:
        j = x.join(_pull(x, a), "id", "left").join(d, "id", "left")
        return j.select("id", ((self_weight * F.col("value") + F.coalesce("got", F.lit(0.0))) / (self_weight + F.coalesce("d", F.lit(0.0)))).alias("value"))

    return _iterate(initial.select("id", "value"), step, None, steps)


def linear_threshold(g: Graph, seeds: DataFrame, thresholds: DataFrame, weight: str | None = None, max_steps: int | None = None) -> DataFrame:
    """(id, step): when nodes become active, by thresholds(id, theta) on the active share of their in-weight.

    Until nothing more becomes active, or for max_steps steps. Shares of newly active nodes are added to running sums.
    """
    a = g.arcs(weight).where("src <> dst")
    total = a.groupBy("dst").agg(F.sum("w").alias("s"))
    a = cut(a.join(total, "dst").select("src", "dst", (F.col("w") / F.col("s")).alias("w")))
    state = seeds.select("id", F.lit(0).cast("long").alias("step"))
    state = cut(thresholds.select("id", "theta").join(state, "id", "full").select("id", "theta", "step", F.lit(0.0).alias("got")))
    k = 0
    while max_steps is None or k < max_steps:
        k += 1
        gain = a.join(state.where(F.col("step") == k - 1).select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("gain"))
        got = F.col("got") + F.coalesce("gain", F.lit(0.0))
        now = F.col("step").isNull() & (F.col("gain") > 0) & (got >= F.col("theta") * (1 - 1e-12))
        state = cut(state.join(gain, "id", "left").select("id", "theta", F.when(now, F.lit(k).cast("long")).otherwise(F.col("step")).alias("step"), got.alias("got")))
        if state.where(F.col("step") == k).isEmpty():
            break
    return state.where("step is not null").select("id", "step")


def majority_rule(g: Graph, initial: DataFrame, steps: int, weight: str | None = None) -> DataFrame:
    """(id, state): synchronous steps to the neighbours' heaviest state, one's own if it leads, else the smallest leader."""
    a = cut(g.arcs(weight).where("src <> dst"))
    x = cut(initial.select("id", "state"))
    for _ in range(steps):
        votes = a.join(x.select(F.col("id").alias("src"), "state"), "src").groupBy(F.col("dst").alias("id"), "state").agg(F.sum("w").alias("s"))
        x = cut(_heaviest(votes, x, "state").select("id", F.col("new").alias("state")))
    return x


def independent_cascade(g: Graph, seeds: DataFrame, p: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, depth, parent): reach over arcs whose coin, a hash of seed and ends, falls below p."""
    coin = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 30)) / float(1 << 30)
    live = g.arcs().where(coin < p).select("src", "dst")
    return bfs(Graph(g.nodes, live, True), seeds)
