"""Acyclic graphs as a kind of their own, their longest path and all their orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import CycleError
from lattica.operators.kernels import Local, per_component
from lattica.operators.model import Graph, weight_of
from lattica.plans import iterate
from lattica.plans.lineage import cut


@dataclass(frozen=True)
class Dag(Graph):
    """A directed graph that is checked to have no cycle, when it is made and with every edge it is given."""

    directed: bool = True

    @classmethod
    def of(cls, g: Graph) -> Dag:
        g.need(True).to_dag()
        return cls(g.nodes, g.edges, True)

    def add_edge(self, u, v, **attributes) -> Dag:
        """With one more edge; a loop, or a path from v to u, is a CycleError and leaves this graph as it is."""
        kind = self.nodes.schema["id"].dataType.simpleString()
        row = self.nodes.sparkSession.createDataFrame([(u, v)], f"src {kind}, dst {kind}").withColumns({k: F.lit(x) for k, x in attributes.items()})
        return self.add_edges(row)

    def add_edges(self, edges: DataFrame) -> Dag:
        """With all of edges(src, dst, ...), or CycleError and none of them."""
        loop = edges.where("src = dst").first()
        if loop is not None:
            raise CycleError([loop["src"], loop["dst"]])
        return Dag.of(Graph(self.nodes, self.edges, True).add_edges(edges))

    def depth(self) -> int:
        """Edges of the longest path; an empty graph has none."""
        return iterate.dag_levels(self).agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]

    def longest_path(self, weight: str | None = None) -> list:
        return dag_longest_path(self, weight)


def dag_longest_path(g: Graph, weight: str | None = None) -> list:
    """The nodes of a heaviest path, without a weight of one with most edges; ties by the smallest ids.

    The predecessors on heaviest paths are found for all nodes at once; the path follows them, a join a step of it.
    """
    best = cut(iterate.longest_path_lengths(g, weight))
    arcs = g.edges.select("src", "dst", weight_of(weight).alias("w")).join(best.select(F.col("id").alias("src"), F.col("best").alias("a")), "src")
    tight = arcs.join(best.select(F.col("id").alias("dst"), F.col("best").alias("b")), "dst").where("abs(a + w - b) <= 1e-9 * greatest(1, abs(b)) and b > 0")
    parent = cut(tight.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("p")))
    end = best.orderBy(F.desc("best"), "id").first()
    path = [] if end is None else [end["id"]]
    while path and (row := parent.where(F.col("id") == path[-1]).first()) is not None:
        path.append(row["p"])
    return path[::-1]


def all_topological_sorts(g: Graph) -> DataFrame:
    """(nodes): every topological order, by graph order; their number may be the factorial of the nodes'.

    All orders interleave the components, so the graph is walked in one task, as the kernels' limit allows.
    """
    dag = Dag.of(g)
    # a mark that all nodes hang on makes one component of them
    kind = dag.nodes.schema["id"].dataType.simpleString()
    nodes = dag.nodes.select(F.col("id").cast("string").alias("id"), F.col("ord"))
    edges = dag.edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).union(nodes.select(F.lit(""), "id"))
    whole = Graph(nodes.unionByName(nodes.limit(1).select(F.lit("").alias("id"), F.lit(None).cast(nodes.schema["ord"].dataType).alias("ord"))), edges.withColumn("ord", F.struct("src", "dst")), True)

    def f(lo: Local):
        names = [n for n in lo.nodes if n]
        waits = {n: len([p for p in lo.pred[n] if p]) for n in names}
        order: list = []
        stack = [[n for n in names if not waits[n]]]
        while stack:
            if len(order) == len(names):
                yield (list(order),)
            elif stack[-1]:
                n = stack[-1].pop(0)
                order.append(n)
                for v in lo.succ[n]:
                    waits[v] -= 1
                placed = set(order)
                stack.append([m for m in names if m not in placed and not waits[m]])
                continue
            stack.pop()
            if order:
                for v in lo.succ[order.pop()]:
                    waits[v] += 1

    return per_component(whole, f, "nodes array<string>").select(F.transform("nodes", lambda x: x.cast(kind)).alias("nodes"))
