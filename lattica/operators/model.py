"""Graphs as pairs of DataFrames: nodes(id, ord, ...) and edges(src, dst, ord, w, ...)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import CycleError, DirectionError, EdgeNotFound, GraphError, NodeNotFound


def weight_of(weight: str | Column | None) -> Column:
    """None: 1; a column's name: its value, null as 1; a Column: its value, null hides the edge."""
    if weight is None:
        return F.lit(1.0)
    return F.coalesce(F.col(weight), F.lit(1)).cast("double") if isinstance(weight, str) else weight.cast("double")


@dataclass(frozen=True)
class Graph:
    """A simple graph; undirected edges stand once, with ord(src) <= ord(dst).

    ord is the graph's order, which breaks all ties. It is a column of the source where there is one, and
    else the id itself, so that it needs no global numbering.
    """

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    # construction

    @classmethod
    def from_edges(cls, edges: DataFrame, *, directed: bool = False, nodes: DataFrame | None = None, order: str | None = None) -> Graph:
        """edges(src, dst, ...) and optional nodes(id, ...); repeated edges merge, per attribute the last value wins.

        Last is by `order`, a column of edges; without one repeated values are reduced by their maximum, which
        doesn't depend on the rows' places. Null ends are errors; ends that nodes lacks are added.
        """
        if not edges.where("src is null or dst is null").isEmpty():
            raise GraphError("an edge has no end")
        attrs = [c for c in edges.columns if c not in ("src", "dst", "ord")]
        e = edges if directed else edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        seq = F.col(order) if order else None
        merged = [
            (F.max_by(F.when(F.col(a).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), seq)) if order and a != order else F.max(a)).alias(a)
            for a in attrs
        ]
        rank = F.min(order).alias("ord") if order else F.struct("src", "dst").alias("ord")
        if order:
            e = e.groupBy("src", "dst").agg(rank, *merged)
        else:
            e = (e.groupBy("src", "dst").agg(*merged) if merged else e.select("src", "dst").distinct()).withColumn("ord", rank)
        ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        if nodes is None:
            n = ends.withColumn("ord", F.col("id"))
        else:
            if not nodes.where("id is null").isEmpty():
                raise GraphError("null is no node")
            given = nodes if "ord" in nodes.columns else nodes.withColumn("ord", F.col("id"))
            n = given.unionByName(ends.join(given, "id", "left_anti").withColumn("ord", F.col("id")), allowMissingColumns=True)
        return cls(n, e, directed)

    def need(self, directed: bool) -> Graph:
        if self.directed is not directed:
            raise DirectionError(f"needs a graph that is {'directed' if directed else 'undirected'}")
        return self

    # views

    def arcs(self, weight: str | Column | None = None) -> DataFrame:
        """(src, dst, w): every direction an edge can be walked; a loop stands once; hidden edges are left out."""
        e = self.edges.select("src", "dst", weight_of(weight).alias("w")).where("w is not null")
        if self.directed:
            return e
        return e.union(e.where("src <> dst").select(F.col("dst"), F.col("src"), "w"))

    def count_nodes(self) -> int:
        return self.nodes.count()

    def count_edges(self) -> int:
        return self.edges.count()

    def selfloops(self) -> DataFrame:
        return self.edges.where("src = dst")

    def has_edge(self, u, v) -> bool:
        pair = (F.col("src") == u) & (F.col("dst") == v)
        if not self.directed:
            pair = pair | ((F.col("src") == v) & (F.col("dst") == u))
        return not self.edges.where(pair).isEmpty()

    def edge(self, u, v):
        """The row of an edge, or EdgeNotFound."""
        pair = (F.col("src") == u) & (F.col("dst") == v)
        if not self.directed:
            pair = pair | ((F.col("src") == v) & (F.col("dst") == u))
        row = self.edges.where(pair).first()
        if row is None:
            raise EdgeNotFound(f"{u} - {v}")
        return row

    def _known(self, *ids) -> None:
        found = {r[0] for r in self.nodes.where(F.col("id").isin(list(ids))).select("id").collect()}
        for i in ids:
            if i not in found:
                raise NodeNotFound(str(i))

    def successors(self, node) -> DataFrame:
        self._known(node)
        return self.arcs().where(F.col("src") == node).select(F.col("dst").alias("id"))

    neighbors = successors

    def predecessors(self, node) -> DataFrame:
        self.need(True)._known(node)
        return self.edges.where(F.col("dst") == node).select(F.col("src").alias("id"))

    def all_neighbors(self, node) -> DataFrame:
        self._known(node)
        both = self.edges.where((F.col("src") == node) | (F.col("dst") == node))
        return both.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()

    def neighbor_lists(self) -> DataFrame:
        return self.arcs().groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbors")).withColumnRenamed("src", "id")

    # degrees

    def _sums(self, ends: DataFrame, weight) -> DataFrame:
        agg = F.sum("w") if weight is not None else F.count("*").cast("long")
        found = ends.groupBy("id").agg(agg.alias("value"))
        return self.nodes.select("id", "ord").join(found, "id", "left").select("id", "ord", F.coalesce("value", F.lit(0.0 if weight is not None else 0)).alias("value"))

    def degree(self, weight: str | Column | None = None) -> DataFrame:
        """(id, ord, value); a loop counts twice."""
        e = self.edges.select("src", "dst", weight_of(weight).alias("w")).where("w is not null")
        return self._sums(e.select(F.explode(F.array("src", "dst")).alias("id"), "w"), weight)

    def in_degree(self, weight: str | Column | None = None) -> DataFrame:
        e = self.need(True).edges.select(F.col("dst").alias("id"), weight_of(weight).alias("w")).where("w is not null")
        return self._sums(e, weight)

    def out_degree(self, weight: str | Column | None = None) -> DataFrame:
        e = self.need(True).edges.select(F.col("src").alias("id"), weight_of(weight).alias("w")).where("w is not null")
        return self._sums(e, weight)

    def sources(self) -> DataFrame:
        return self.need(True).nodes.join(self.edges.select(F.col("dst").alias("id")), "id", "left_anti")

    def sinks(self) -> DataFrame:
        return self.need(True).nodes.join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")

    # derivation

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Merges nodes(id, ...) in; values of the new rows win, nulls among them don't."""
        return replace(self, nodes=_merge(self.nodes, nodes if "ord" in nodes.columns else nodes.withColumn("ord", F.col("id")), ["id"]))

    def add_edges(self, edges: DataFrame) -> Graph:
        """Merges edges(src, dst, ...) in; their ends become nodes."""
        new = Graph.from_edges(edges, directed=self.directed)
        return self.compose(new)

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Without the nodes ids(id) and their edges; an unknown id is an error."""
        lost = ids.join(self.nodes, "id", "left_anti").first()
        if lost is not None:
            raise NodeNotFound(str(lost[0]))
        e = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
        return replace(self, nodes=self.nodes.join(ids, "id", "left_anti"), edges=e.select(*self.edges.columns))

    def remove_edges(self, pairs: DataFrame) -> Graph:
        """Without the edges pairs(src, dst); an unknown one is an error."""
        p = pairs.select("src", "dst") if self.directed else pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        lost = p.join(self.edges, ["src", "dst"], "left_anti").first()
        if lost is not None:
            raise EdgeNotFound(f"{lost[0]} - {lost[1]}")
        return replace(self, edges=self.edges.join(p, ["src", "dst"], "left_anti").select(*self.edges.columns))

    def subgraph(self, ids: DataFrame) -> Graph:
        """Induced by ids(id)."""
        e = self.edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
        return replace(self, nodes=self.nodes.join(ids, "id", "left_semi"), edges=e.select(*self.edges.columns))

    def edge_subgraph(self, pairs: DataFrame) -> Graph:
        """The edges pairs(src, dst) and their ends."""
        p = pairs.select("src", "dst") if self.directed else pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        lost = p.join(self.edges, ["src", "dst"], "left_anti").first()
        if lost is not None:
            raise EdgeNotFound(f"{lost[0]} - {lost[1]}")
        e = self.edges.join(p, ["src", "dst"], "left_semi").select(*self.edges.columns)
        ends = e.select(F.col("src").alias("id")).union(e.select("dst"))
        return replace(self, nodes=self.nodes.join(ends, "id", "left_semi"), edges=e)

    def to_undirected(self, reciprocal: bool = False) -> Graph:
        """Merges both directions; reciprocal keeps only pairs that have both (loops among them)."""
        if not self.directed:
            return self
        e = self.edges
        if reciprocal:
            e = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").select(*e.columns)
        return replace(Graph.from_edges(e.drop("ord"), nodes=self.nodes), directed=False)

    def to_directed(self) -> Graph:
        if self.directed:
            return self
        back = self.edges.where("src <> dst").select(*[F.col("dst").alias("src") if c == "src" else F.col("src").alias("dst") if c == "dst" else F.col(c) for c in self.edges.columns])
        return Graph(self.nodes, self.edges.unionByName(back), True)

    def reverse(self) -> Graph:
        self.need(True)
        return replace(self, edges=self.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))

    def relabel(self, mapping: DataFrame) -> Graph:
        """New ids by mapping(id, new); ids without one stay; two nodes with one new id are an error."""
        m = mapping.select("id", "new")
        n = self.nodes.join(m, "id", "left").withColumn("id", F.coalesce("new", "id")).drop("new")
        if not n.groupBy("id").count().where("count > 1").isEmpty():
            raise GraphError("two nodes get one id")
        e = self.edges.join(m.select(F.col("id").alias("src"), F.col("new").alias("s")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst", "left")
        e = e.withColumns({"src": F.coalesce("s", "src"), "dst": F.coalesce("d", "dst")}).drop("s", "d")
        if not self.directed:
            e = e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        return replace(self, nodes=n, edges=e.select(*self.edges.columns))

    def compose(self, other: Graph) -> Graph:
        """The union; per attribute other's values win."""
        if other.directed is not self.directed:
            raise DirectionError("the graphs differ in direction")
        return replace(self, nodes=_merge(self.nodes, other.nodes, ["id"]), edges=_merge(self.edges, other.edges, ["src", "dst"]))

    def copy(self) -> Graph:
        """Graphs are values: a copy shares the same immutable plans."""
        return replace(self)

    def in_edges(self, node=None) -> DataFrame:
        """The arcs into a node, or all."""
        e = self.need(True).edges
        if node is None:
            return e
        self._known(node)
        return e.where(F.col("dst") == node)

    def out_edges(self, node=None) -> DataFrame:
        """The arcs out of a node, or all."""
        e = self.need(True).edges
        if node is None:
            return e
        self._known(node)
        return e.where(F.col("src") == node)

    def node_data(self, attribute: str, default=None) -> DataFrame:
        """(id, value) of a node column in graph order's columns; default where it is null or there is no such column."""
        value = F.col(attribute) if attribute in self.nodes.columns else F.lit(None)
        return self.nodes.select("id", "ord", (value if default is None else F.coalesce(value, F.lit(default))).alias("value"))

    def edge_data(self, attribute: str, default=None) -> DataFrame:
        """(src, dst, value) of an edge column; default where it is null or there is no such column."""
        value = F.col(attribute) if attribute in self.edges.columns else F.lit(None)
        return self.edges.select("src", "dst", (value if default is None else F.coalesce(value, F.lit(default))).alias("value"))

    def adjacent(self, node) -> DataFrame:
        """(id, and the edge's columns) of the edges to a node's neighbours (its successors)."""
        self._known(node)
        rest = [c for c in self.edges.columns if c not in ("src", "dst", "ord")]
        out = self.edges.where(F.col("src") == node).select(F.col("dst").alias("id"), *rest)
        if self.directed:
            return out
        return out.union(self.edges.where((F.col("dst") == node) & (F.col("src") != node)).select(F.col("src").alias("id"), *rest))

    def clear(self) -> Graph:
        return replace(self, nodes=self.nodes.limit(0), edges=self.edges.limit(0))

    def to_dag(self) -> Graph:
        """This graph, or CycleError with a cycle of it."""
        from lattica.operators.kernels import find_cycle

        cycle = find_cycle(self)
        if cycle:
            raise CycleError(cycle)
        return self


def _merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a and b by keys; b's values win where they aren't null; ord stays a's where a has the key."""
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_s", "ord")]
    return both.groupBy(*keys).agg(
        F.min_by("ord", "_s").alias("ord"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_s"))).alias(c) for c in rest]
    )
