"""Measures that joins and aggregations give: structure, similarity, quality of partitions.

Triangles are found from edges oriented from the lower to the higher (degree, ord): a node has at most sqrt(2 m)
outgoing edges, so a hub's neighbours are not paired. Where the pairs themselves are wanted, as in link prediction
and square clustering, a hub's wedges are dealt over tasks in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import GraphError, NodeNotFound
from lattica.operators.model import Graph, weight_of
from lattica.plans.lineage import cut, numbered


def _simple(g: Graph) -> DataFrame:
    """Both directions of the edges that aren't loops."""
    return g.arcs().where("src <> dst").select("src", "dst")


#: Neighbours of a node that are paired with all its neighbours in one task.
BLOCK = 1024


def _wedges(a: DataFrame) -> DataFrame:
    """(u, v, w): neighbours u and v of w, by both directions a(src, dst) of the edges.

    A hub's neighbours are dealt over blocks, each of which meets all of them, so its wedges spread over tasks.
    """
    blocks = a.groupBy("src").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("src", "w")
    own = a.select(F.col("src").alias("w"), F.col("dst").alias("u")).join(blocks, "w")
    left = own.select("w", "u", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("block"))
    right = own.select("w", F.col("u").alias("v"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["w", "block"]).select("u", "v", "w")


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.cast("double").alias("value"))


def density(g: Graph) -> DataFrame:
    n, m = g.nodes.agg(F.count("*").cast("double").alias("n")), g.edges.agg(F.count("*").cast("double").alias("m"))
    return _one(n.crossJoin(m), F.when(F.col("n") > 1, F.col("m") * (1 if g.directed else 2) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))


def degree_centrality(g: Graph, degree: DataFrame | None = None) -> DataFrame:
    """degree / (n - 1); 1 for n <= 1."""
    n = g.nodes.agg(F.count("*").alias("n"))
    d = g.degree() if degree is None else degree
    return d.crossJoin(F.broadcast(n)).select("id", "ord", F.when(F.col("n") <= 1, 1.0).otherwise(F.col("value") / (F.col("n") - 1)).alias("value"))


def in_degree_centrality(g: Graph) -> DataFrame:
    return degree_centrality(g, g.in_degree())


def out_degree_centrality(g: Graph) -> DataFrame:
    return degree_centrality(g, g.out_degree())


def degree_distribution(g: Graph) -> DataFrame:
    return g.degree().groupBy(F.col("value").alias("degree")).agg(F.count("*").alias("count"))


def degree_histogram(g: Graph) -> DataFrame:
    """Every degree from 0 to the largest."""
    d = degree_distribution(g)
    every = d.agg(F.max("degree").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("degree"))
    return every.join(d, "degree", "left").select("degree", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def average_degree(g: Graph) -> DataFrame:
    return _one(g.degree().agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("v")), F.col("v"))


def is_regular(g: Graph) -> bool:
    degrees = [g.in_degree(), g.out_degree()] if g.directed else [g.degree()]
    return all(d.select("value").distinct().limit(2).count() <= 1 for d in degrees)


def s_metric(g: Graph) -> DataFrame:
    d = g.degree().select("id", "value")
    e = g.edges.join(d.select(F.col("id").alias("src"), F.col("value").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("value").alias("b")), "dst")
    return _one(e.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("v")), F.col("v"))


def reciprocity(g: Graph) -> DataFrame:
    e = g.need(True).edges.select("src", "dst")
    both = e.where("src <> dst").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    return _one(both.agg(F.count("*").alias("k")).crossJoin(e.agg(F.count("*").alias("m"))), F.when(F.col("m") > 0, F.col("k") / F.col("m")).otherwise(0.0))


# triangles


def _oriented(g: Graph, weight: str | Column | None = None) -> DataFrame:
    """(a, b, w): undirected edges without loops, from the lower (degree, id) to the higher."""
    e = g.edges.where("src <> dst").select("src", "dst", weight_of(weight).alias("w")).where("w is not null")
    d = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    j = e.join(d.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    low = F.struct("ds", "src") < F.struct(F.col("dd").alias("ds"), F.col("dst").alias("src"))
    return j.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("b"), "w")


def _triangle_list(g: Graph, weight=None) -> DataFrame:
    o = _oriented(g, weight)
    ab = o.select("a", "b", F.col("w").alias("w1"))
    ac = o.select("a", F.col("b").alias("c"), F.col("w").alias("w2"))
    wedge = ab.join(ac, "a").where("b <> c")
    bc = o.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w3"))
    return wedge.join(bc, ["b", "c"])


def triangles(g: Graph) -> DataFrame:
    """(id, ord, value): triangles through each node; loops don't count."""
    t = _triangle_list(g.need(False)).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("value"))
    return g.nodes.select("id", "ord").join(t, "id", "left").select("id", "ord", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def _simple_degree(g: Graph) -> DataFrame:
    return _simple(g).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))


def clustering(g: Graph, weight: str | None = None) -> DataFrame:
    """Undirected: 2T/(d(d-1)), or with weights the mean of cube roots of weight products over the largest
    weight. Directed: the share of the directed triangles that the degrees and mutual arcs allow."""
    if g.directed:
        return _clustering_directed(g)
    d = _simple_degree(g)
    if weight is None:
        t = triangles(g).withColumnRenamed("value", "t")
    else:
        top = g.edges.where("src <> dst").agg(F.max(F.abs(weight_of(weight))).alias("top"))
        tri = _triangle_list(g, weight).crossJoin(F.broadcast(top))
        part = F.cbrt(F.col("w1") / F.col("top") * (F.col("w2") / F.col("top")) * (F.col("w3") / F.col("top")))
        t = tri.select(F.explode(F.array("a", "b", "c")).alias("id"), part.alias("t")).groupBy("id").agg(F.sum("t").alias("t"))
        t = g.nodes.select("id", "ord").join(t, "id", "left")
    j = t.join(d, "id", "left")
    return j.select("id", "ord", F.when((F.col("d") > 1) & F.col("t").isNotNull(), 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("value"))


def _clustering_directed(g: Graph) -> DataFrame:
    e = g.edges.where("src <> dst").select("src", "dst")
    # s: one or two arcs between a pair, whatever their direction
    s = e.select("src", "dst").union(e.select(F.col("dst"), F.col("src"))).groupBy("src", "dst").agg(F.count("*").alias("m"))
    total = s.groupBy(F.col("src").alias("id")).agg(F.sum("m").alias("dt"), F.sum((F.col("m") == 2).cast("long")).alias("db"))
    pair = s.where("src < dst").select(F.col("src").alias("id"), F.col("dst").alias("id2"), "m")
    u = Graph(g.nodes, pair.select(F.col("id").alias("src"), F.col("id2").alias("dst"), F.struct("id", "id2").alias("ord"), F.col("m").cast("double").alias("w")), False)
    t = _triangle_list(u, "w").select(F.explode(F.array("a", "b", "c")).alias("id"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("t"))
    t = t.groupBy("id").agg(F.sum("t").alias("t"))
    j = g.nodes.select("id", "ord").join(total, "id", "left").join(t, "id", "left")
    possible = 2 * (F.col("dt") * (F.col("dt") - 1) - 2 * F.col("db"))
    # each unordered neighbour pair stands for both of its orders
    return j.select("id", "ord", F.when(F.col("t").isNotNull() & (possible > 0), 2 * F.col("t") / possible).otherwise(0.0).alias("value"))


def average_clustering(g: Graph, weight: str | None = None, count_zeros: bool = True) -> DataFrame:
    c = clustering(g, weight)
    return _one((c if count_zeros else c.where("value <> 0")).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("v")), F.col("v"))


def transitivity(g: Graph) -> DataFrame:
    d = _simple_degree(g.need(False)).agg(F.sum(F.col("d") * (F.col("d") - 1)).alias("triads"))
    t = _triangle_list(g).agg((F.count("*") * 6).alias("closed"))
    return _one(d.crossJoin(t), F.when(F.col("triads") > 0, F.col("closed") / F.col("triads")).otherwise(0.0))


def square_clustering(g: Graph) -> DataFrame:
    """The share of possible squares through each node that exist."""
    a = _simple(g)
    # p(v, x): common neighbours of v and x, v not x
    two = _wedges(a).select(F.col("u").alias("v"), F.col("w").alias("u"), F.col("v").alias("x")).where("v <> x")
    p = two.groupBy("v", "x").agg(F.count("*").alias("p"))
    squares = p.groupBy(F.col("v").alias("id")).agg(F.sum(F.col("p") * (F.col("p") - 1) / 2).alias("s"))
    d = a.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    # potential over neighbour pairs (u, w): (d_u - q - 1 - theta) + (d_w - q - 1 - theta) + q, q squares of the pair
    n = a.select(F.col("src").alias("v"), F.col("dst").alias("u")).join(d.select(F.col("id").alias("u"), "d"), "u")
    ends = n.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("k"), F.sum("d").alias("sd"))
    tri = two.select("v", F.col("u"), "x").join(a.select(F.col("src").alias("v"), F.col("dst").alias("x")), ["v", "x"], "left_semi").groupBy(F.col("v").alias("id")).agg((F.count("*") / 2).alias("theta"))
    j = g.nodes.select("id", "ord").join(ends, "id", "left").join(squares, "id", "left").join(tri, "id", "left")
    s, theta = F.coalesce("s", F.lit(0.0)), F.coalesce("theta", F.lit(0.0))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    potential = (F.col("k") - 1) * F.col("sd") - s - 2 * pairs - 2 * theta
    return j.select("id", "ord", F.when(F.col("k").isNotNull() & (potential > 0), s / potential).otherwise(0.0).alias("value"))


# mixing


def degree_assortativity(g: Graph, x: str = "out", y: str = "in", weight: str | None = None) -> DataFrame:
    """Pearson correlation of the degrees over edges, both directions of an undirected edge, a loop once."""
    def deg(kind: str) -> DataFrame:
        return g.degree(weight) if not g.directed else (g.out_degree(weight) if kind == "out" else g.in_degree(weight))
    a = g.arcs().join(deg(x).select(F.col("id").alias("src"), F.col("value").cast("double").alias("a")), "src").join(deg(y).select(F.col("id").alias("dst"), F.col("value").cast("double").alias("b")), "dst")
    return _one(a.agg(F.corr("a", "b").alias("r")), F.coalesce("r", F.lit(float("nan"))))


def numeric_assortativity(g: Graph, attribute: str) -> DataFrame:
    v = g.nodes.select("id", F.col(attribute).cast("double").alias("v"))
    a = g.arcs().join(v.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    if not a.where("a is null or b is null").isEmpty():
        raise GraphError(f"a node has no {attribute}")
    return _one(a.agg(F.corr("a", "b").alias("r")), F.coalesce("r", F.lit(float("nan"))))


def mixing_matrix(g: Graph, attribute: str) -> DataFrame:
    """(a, b, count) of the attribute over arcs; a missing value is a category."""
    v = g.nodes.select("id", F.col(attribute).alias("v"))
    a = g.arcs().join(v.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    return a.groupBy("a", "b").agg(F.count("*").alias("count"))


def attribute_assortativity(g: Graph, attribute: str) -> DataFrame:
    m = mixing_matrix(g, attribute)
    total = m.agg(F.sum("count").cast("double").alias("n"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("count")).otherwise(0)).alias("same"))
    rows, cols = m.groupBy(F.col("a").alias("k")).agg(F.sum("count").alias("r")), m.groupBy(F.col("b").alias("k")).agg(F.sum("count").alias("c"))
    ab = rows.alias("x").join(cols.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k"))).agg(F.sum(F.col("r") * F.col("c")).cast("double").alias("rc"))
    q = F.col("rc") / (F.col("n") * F.col("n"))
    return _one(total.crossJoin(ab), F.when(q == 1, float("nan")).otherwise((F.col("same") / F.col("n") - q) / (1 - q)))


def rich_club(g: Graph) -> DataFrame:
    """(degree, value): density among the nodes of more than each degree, where two or more are."""
    e = g.need(False).edges.where("src <> dst")
    d = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    d = g.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("d", F.lit(0).cast("long")).alias("d"))
    low = e.join(d.select(F.col("id").alias("src"), F.col("d").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("b")), "dst").select(F.least("a", "b").alias("k"))
    steps = d.groupBy(F.col("d").alias("k")).agg(F.count("*").alias("nodes"), F.lit(0).cast("long").alias("edges")).unionByName(low.groupBy("k").agg(F.lit(0).cast("long").alias("nodes"), F.count("*").alias("edges")))
    steps = steps.groupBy("k").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
    # the distinct degrees, at most sqrt(2 m) of them, make one small window
    top = d.agg(F.max("d").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("k"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    r = top.join(steps, "k", "left").select("k", F.sum(F.coalesce("nodes", F.lit(0))).over(above).alias("n"), F.sum(F.coalesce("edges", F.lit(0))).over(above).alias("m"))
    return r.where("n > 1").select(F.col("k").alias("degree"), (2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("value"))


# link prediction


def _two_hop(g: Graph) -> DataFrame:
    """(u, v, w): u < v with a common neighbour w that is neither."""
    return _wedges(_simple(g.need(False))).where("u < v")


def common_neighbor_counts(g: Graph, missing_only: bool = True) -> DataFrame:
    """(u, v, value) for pairs with common neighbours, those that aren't linked unless told otherwise."""
    c = _two_hop(g).groupBy("u", "v").agg(F.count("*").alias("value"))
    return _unlinked(g, c) if missing_only else c


def common_neighbors(g: Graph, u, v) -> DataFrame:
    g._known(u, v)
    a = _simple(g.need(False))
    return a.where(F.col("src") == u).select(F.col("dst").alias("id")).join(a.where(F.col("src") == v).select(F.col("dst").alias("id")), "id", "left_semi").where(~F.col("id").isin([u, v]))


def _unlinked(g: Graph, pairs: DataFrame) -> DataFrame:
    return pairs.join(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")


def jaccard(g: Graph) -> DataFrame:
    """Unlinked pairs with common neighbours: these over the union of both neighbourhoods."""
    d = _simple_degree(g)
    loops = g.selfloops().select(F.col("src").alias("id"), F.lit(1).alias("l"))
    d = d.join(loops, "id", "left").select("id", (F.col("d") + F.coalesce("l", F.lit(0))).alias("d"))
    c = common_neighbor_counts(g)
    c = c.join(d.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    return c.select("u", "v", (F.col("value") / (F.col("du") + F.col("dv") - F.col("value"))).alias("value"))


def _weighted_common(g: Graph, share) -> DataFrame:
    d = g.degree().select(F.col("id").alias("w"), F.col("value").alias("d"))
    return _unlinked(g, _two_hop(g).join(d, "w").groupBy("u", "v").agg(F.sum(share(F.col("d"))).alias("value")))


def adamic_adar(g: Graph) -> DataFrame:
    return _weighted_common(g, lambda d: 1 / F.log(d))


def resource_allocation(g: Graph) -> DataFrame:
    return _weighted_common(g, lambda d: 1 / d)


def preferential_attachment(g: Graph, pairs: DataFrame) -> DataFrame:
    """(u, v, value) for pairs(u, v); all unlinked pairs would be a quadratic result, so the caller names them."""
    d = g.need(False).degree().select("id", "value")
    return pairs.join(d.select(F.col("id").alias("u"), F.col("value").alias("a")), "u").join(d.select(F.col("id").alias("v"), F.col("value").alias("b")), "v").select("u", "v", (F.col("a") * F.col("b")).alias("value"))


def predict_links(g: Graph, method: str = "adamic_adar", k: int = 10) -> DataFrame:
    """(u, v, value): the k best unlinked pairs, ties by graph order.

    Pairs without a common neighbour score 0 and only fill a short list, in graph order; the list is as long as k or
    as the unlinked pairs are many. Scores are compared to nine places.
    """
    scored = {"adamic_adar": adamic_adar, "jaccard": jaccard, "resource_allocation": resource_allocation, "common_neighbors": common_neighbor_counts}[method](g)
    found = cut(scored.select("u", "v", F.col("value").cast("double").alias("value")).orderBy(F.desc(F.round("value", 9)), "u", "v").limit(k))
    missing = k - found.count()
    linked = g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(found.select("u", "v"))
    if missing > 0:
        # the first nodes in graph order, until their unlinked pairs are enough: as many nodes as are filled up at most
        n = g.count_nodes()
        free = linked.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("d"))
        free = g.nodes.select(F.col("id").alias("u"), "ord").join(free, "u", "left").where(F.coalesce("d", F.lit(0)) < n - 1)
        heads = F.broadcast(free.orderBy("ord").limit(2 * missing + 1).select("u"))
        pairs = heads.join(g.nodes.select(F.col("id").alias("v")), F.col("u") < F.col("v")).join(linked, ["u", "v"], "left_anti")
        found = found.union(pairs.orderBy("u", "v").limit(missing).select("u", "v", F.lit(0.0)))
    return found


# partitions


def _labelled(g: Graph, labels: DataFrame, weight) -> DataFrame:
    e = g.edges.select("src", "dst", weight_of(weight).alias("w"))
    lab = labels.select("id", "label")
    return e.join(lab.select(F.col("id").alias("src"), F.col("label").alias("a")), "src", "left").join(lab.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst", "left")


def check_partition(g: Graph, labels: DataFrame) -> None:
    """Every node in exactly one community."""
    if not labels.groupBy("id").count().where("count > 1").isEmpty() or not g.nodes.join(labels, "id", "left_anti").isEmpty():
        raise GraphError("not a partition of the nodes")
    lost = labels.join(g.nodes, "id", "left_anti").first()
    if lost is not None:
        raise NodeNotFound(str(lost["id"]))


def modularity(g: Graph, labels: DataFrame, weight: str | None = "w", resolution: float = 1.0) -> DataFrame:
    e = _labelled(g, labels, weight)
    inside = F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside")
    total = e.agg(inside, F.sum("w").alias("m"))
    out, into = e.groupBy(F.col("a").alias("label")).agg(F.sum("w").alias("ko")), e.groupBy(F.col("b").alias("label")).agg(F.sum("w").alias("ki"))
    both = out.join(into, "label", "full").select("label", F.coalesce("ko", F.lit(0.0)).alias("ko"), F.coalesce("ki", F.lit(0.0)).alias("ki"))
    k = F.sum(F.col("ko") * F.col("ki")) if g.directed else F.sum((F.col("ko") + F.col("ki")) * (F.col("ko") + F.col("ki"))) / 4
    return _one(total.crossJoin(both.agg(k.alias("kk"))), F.col("inside") / F.col("m") - resolution * F.col("kk") / (F.col("m") * F.col("m")))


def partition_quality(g: Graph, labels: DataFrame) -> DataFrame:
    """coverage: the share of edges inside; performance: the share of pairs told right, both unweighted."""
    e = _labelled(g, labels, None).where("src <> dst")
    c = e.agg(F.sum((F.col("a") == F.col("b")).cast("long")).alias("inside"), F.count("*").alias("m"))
    n = labels.groupBy("label").agg(F.count("*").alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("within"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    scale = 2 if g.directed else 1
    right = F.col("inside") + scale * (pairs - F.col("within")) - (F.col("m") - F.col("inside"))
    return c.crossJoin(n).select((F.col("inside") / F.col("m")).alias("coverage"), (right / (scale * pairs)).alias("performance"))


def community_labels(labels: DataFrame) -> DataFrame:
    """(id, label): communities numbered from 0, the largest first, ties by their first node."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return labels.join(numbered(sizes, F.desc("n"), "first"), "label").select("id", F.col("position").alias("label"))


# matchings


def is_matching(g: Graph, matching: DataFrame) -> bool:
    """matching(src, dst): edges of g, no loop, no node twice."""
    m = matching if g.directed else matching.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    if not m.join(g.edges, ["src", "dst"], "left_anti").isEmpty() or not m.where("src = dst").isEmpty():
        return False
    return m.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().where("count > 1").isEmpty()


def is_maximal_matching(g: Graph, matching: DataFrame) -> bool:
    if not is_matching(g, matching):
        return False
    used = matching.select(F.explode(F.array("src", "dst")).alias("id"))
    free = g.edges.where("src <> dst").join(used.select(F.col("id").alias("src")), "src", "left_anti").join(used.select(F.col("id").alias("dst")), "dst", "left_anti")
    return free.isEmpty()


def is_perfect_matching(g: Graph, matching: DataFrame) -> bool:
    return is_matching(g, matching) and 2 * matching.count() == g.count_nodes()


# matrices as (i, j, value)


def adjacency_coo(g: Graph, weight: str | None = "w") -> DataFrame:
    return g.arcs(weight).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("value"))


def _symmetric(g: Graph, weight) -> DataFrame:
    a = g.arcs(weight).where("src <> dst")
    return a.union(a.select(F.col("dst"), F.col("src"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w")) if g.directed else a


def degree_vector(g: Graph, weight: str | None = None) -> DataFrame:
    s = _symmetric(g, weight).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("value"))
    return g.nodes.select("id", "ord").join(s, "id", "left").select("id", "ord", F.coalesce("value", F.lit(0.0)).alias("value"))


def laplacian_coo(g: Graph, weight: str | None = None, normalized: bool = False) -> DataFrame:
    """D - A, or I - D^-1/2 A D^-1/2; loops don't count; zero entries are left out."""
    a, d = _symmetric(g, weight), degree_vector(g, weight).select("id", "value")
    if not normalized:
        return d.where("value <> 0").select(F.col("id").alias("i"), F.col("id").alias("j"), "value").union(a.select("src", "dst", -F.col("w")))
    j = a.join(d.select(F.col("id").alias("src"), F.col("value").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col("value").alias("y")), "dst")
    off = j.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w") / F.sqrt(F.col("x") * F.col("y"))).alias("value"))
    return d.where("value <> 0").select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value")).union(off)


def incidence_coo(g: Graph, oriented: bool = False) -> DataFrame:
    """(node, src, dst, value): a column for each edge, named by its ends; loops have empty columns."""
    e = g.edges.where("src <> dst").select("src", "dst")
    low = -1.0 if oriented else 1.0
    return e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(low).alias("value")), F.struct(F.col("dst").alias("node"), F.lit(1.0).alias("value")))).alias("x"), "src", "dst").select("x.node", "src", "dst", "x.value")


def transition_coo(g: Graph, weight: str | None = None) -> DataFrame:
    """Row-stochastic steps of a walk; a row without arcs is left out (a uniform jump)."""
    a = g.arcs(weight)
    s = a.groupBy("src").agg(F.sum("w").alias("s")).where("s > 0")
    return a.join(s, "src").select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("w") / F.col("s")).alias("value"))


def summary(g: Graph) -> DataFrame:
    """One row of headline numbers."""
    d = g.degree().agg(F.count("*").alias("nodes"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("average_degree"), F.coalesce(F.max("value"), F.lit(0)).alias("max_degree"), F.sum((F.col("value") == 0).cast("long")).alias("isolates"))
    e = g.edges.agg(F.count("*").alias("edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"))
    out = d.crossJoin(e).crossJoin(density(g).withColumnRenamed("value", "density"))
    if g.directed:
        return out.crossJoin(reciprocity(g).withColumnRenamed("value", "reciprocity"))
    return out.crossJoin(transitivity(g).withColumnRenamed("value", "transitivity"))
