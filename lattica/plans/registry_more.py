"""More graph queries: small facts, derived graphs, files, families and simulations, each with SQL that tells it too.

Facts are rows (name, value). A family or simulation that draws at random is held to what every draw must keep.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import CycleError, EdgeNotFound
from lattica.functions import metrics
from lattica.operators import dag as acyclic
from lattica.operators import kernels, layout, local, matching, outcomes, paths, simulate
from lattica.operators.model import Graph
from lattica.plans import iterate, sources
from lattica.plans.lineage import cut
from lattica.plans.registry import _MAKE, BFS, CC, LV, PS_DEG, SP, TC, query
from lattica.sources import derived, files
from lattica.sources import generators as gen
from lattica.sources.derived import SQL


def facts(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double")


def _said(**values: str) -> str:
    """SQL of the same facts, each an expression."""
    return " UNION ALL ".join(f"SELECT '{k}' AS name, round(CAST({v} AS DOUBLE), 6) AS value" for k, v in values.items())


def _spark(g: Graph) -> SparkSession:
    return g.nodes.sparkSession


def _least(g: Graph):
    return g.nodes.agg(F.min("id")).first()[0]


# small graphs of whole tables


def nation_rings(spark, sf_dir) -> Graph:
    """Directed, weighted: in each region, nations in a ring by key, and arcs from the last to the second of it."""
    from pyspark.sql import Window

    n = derived._t(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    r = n.select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("n_regionkey")).alias("n"))
    b = r.select(F.col("id").alias("dst"), "n_regionkey", F.col("k").alias("j"))
    e = r.join(b, "n_regionkey").where("j = k % n + 1 or (k = n and j = 2 and n > 2)").select(F.col("id").alias("src"), "dst")
    e = e.withColumn("w", ((F.col("src") * 7 + F.col("dst") * 3) % 11 + 1).cast("long"))
    return Graph(r.select("id", F.col("id").alias("ord"), "n_regionkey"), e.withColumn("ord", F.struct("src", "dst")), True)


def nation_blocks(spark, sf_dir) -> Graph:
    """Undirected: supply_chain() down to the suppliers without its directions, and each nation's customers as leaves."""
    g = derived.supply_chain(spark, sf_dir)
    c = derived._t(spark, sf_dir, "customer").select((F.col("c_nationkey") + 1000).cast("long").alias("src"), (F.col("c_custkey") + 2000000000).cast("long").alias("dst"))
    e = g.edges.where("dst < 1000000000").select("src", "dst").union(c)
    n = g.nodes.where("id < 1000000000").select("id").union(c.select("dst"))
    return Graph(n.withColumn("ord", F.col("id")), e.withColumn("ord", F.struct("src", "dst")), False)


_MAKE |= {"nr": nation_rings, "nb": nation_blocks}
SQL["nr"] = """nr_r AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
nr_n AS (SELECT id, n_regionkey FROM nr_r), nr_e AS (SELECT a.id AS src, b.id AS dst, CAST((a.id * 7 + b.id * 3) % 11 + 1 AS BIGINT) AS w, a.n_regionkey FROM nr_r a JOIN nr_r b ON a.n_regionkey = b.n_regionkey WHERE b.k = a.k % a.n + 1 OR (a.k = a.n AND b.k = 2 AND a.n > 2))"""
SQL["nb"] = SQL["dag"] + """, nb_e AS (SELECT src, dst FROM dag_e WHERE dst < 1000000000 UNION ALL SELECT c_nationkey + 1000, c_custkey + 2000000000 FROM customer), nb_n AS (SELECT id FROM dag_n WHERE id < 1000000000 UNION ALL SELECT c_custkey + 2000000000 FROM customer)"""

# construction and change
query("from_edges", "pd", "SELECT src, dst FROM pd_e")(lambda g: g.edges.select("src", "dst"))
query("graph_counts", "co", _said(nodes="(SELECT count(*) FROM co_n)", edges="(SELECT count(*) FROM co_e)"))(lambda g: facts(_spark(g), nodes=g.count_nodes(), edges=g.count_edges()))
query("add_nodes", "co", "SELECT id FROM co_n UNION SELECT CAST(n_nationkey - 100 AS BIGINT) FROM nation")(lambda g: g.add_nodes(_spark(g).range(-100, -75)).nodes.select("id"))


@query("add_edges", None, f"WITH {SQL['co']}, n AS (SELECT src, dst, w FROM co_e WHERE NOT (src % 5 = 0 AND dst % 5 = 0)) SELECT src, dst, w FROM n UNION ALL SELECT src, dst, 1 FROM co_e WHERE src % 5 = 0 AND dst % 5 = 0 UNION ALL SELECT -1, 1, 1")
def _add_edges(spark, sf_dir):
    g = derived.customer_succession(spark, sf_dir)
    new = g.edges.where("src % 5 = 0 and dst % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("w"))
    return g.add_edges(new.union(spark.createDataFrame([(1, -1, 1)], "src long, dst long, w long"))).edges.select("src", "dst", "w")


query("remove_edges", "co", "SELECT src, dst FROM co_e WHERE src % 2 = 1")(lambda g: g.remove_edges(g.edges.where("src % 2 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).edges.select("src", "dst"))
query("edge_subgraph", "co", "SELECT DISTINCT unnest([src, dst]) AS id FROM co_e WHERE w > 8")(lambda g: g.edge_subgraph(g.edges.where("w > 8").select("src", "dst")).nodes.select("id"))
query("edge_lookup", "co", _said(there="(SELECT count(*) FROM co_e WHERE src = (SELECT min(src) FROM co_e) AND dst = (SELECT min(dst) FROM co_e WHERE src = (SELECT min(src) FROM co_e)))", loop="0", weight="(SELECT arg_min(w, (src, dst)) FROM co_e)"))(
    lambda g: (lambda e: facts(_spark(g), there=g.has_edge(e["dst"], e["src"]), loop=g.has_edge(e["src"], e["src"]), weight=g.edge(e["dst"], e["src"])["w"]))(g.edges.orderBy("src", "dst").first())
)
query("neighbors", "co", "SELECT dst AS id FROM co_a WHERE src = (SELECT min(id) FROM co_n)")(lambda g: g.neighbors(_least(g)))
query("successors", "ut", "SELECT dst AS id FROM ut_e WHERE src = (SELECT min(id) FROM ut_n)")(lambda g: g.successors(_least(g)))
query("predecessors", "ut", "SELECT src AS id FROM ut_e WHERE dst = (SELECT min(id) FROM ut_n)")(lambda g: g.predecessors(_least(g)))
query("all_neighbors", "ut", "SELECT dst AS id FROM ut_e WHERE src = (SELECT min(id) FROM ut_n) UNION SELECT src FROM ut_e WHERE dst = (SELECT min(id) FROM ut_n)")(lambda g: g.all_neighbors(_least(g)))
query("in_edges", "ut", "SELECT src, dst FROM ut_e WHERE dst = (SELECT min(id) FROM ut_n)")(lambda g: g.in_edges(_least(g)).select("src", "dst"))
query("out_edges", "ut", "SELECT src, dst FROM ut_e WHERE src = (SELECT min(id) FROM ut_n)")(lambda g: g.out_edges(_least(g)).select("src", "dst"))
query("adjacency_view", "co", "SELECT dst AS id, w FROM co_a WHERE src = (SELECT min(id) FROM co_n)")(lambda g: g.adjacent(_least(g)))
query("node_data", "co", "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS value FROM customer")(lambda g: g.copy().node_data("c_nationkey").select("id", F.col("value").cast("long").alias("value")))
query("edge_data", "co", "SELECT src, dst, w AS value FROM co_e")(lambda g: g.edge_data("w"))
query("edge_data_default", "co", "SELECT src, dst, CAST(7 AS BIGINT) AS value FROM co_e")(lambda g: g.edge_data("none", 7))
query("to_directed", "co", "SELECT src, dst, w FROM co_a")(lambda g: g.to_directed().edges.select("src", "dst", "w"))
query("clear", "co", "SELECT src, dst FROM co_e WHERE false")(lambda g: g.clear().edges.select("src", "dst"))
query("neighbor_lists", "co", "SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS neighbors FROM co_a GROUP BY src")(lambda g: g.neighbor_lists().select("id", F.array_join("neighbors", ",").alias("neighbors")))


@query("dag_add_edges", "dag", _said(edges="(SELECT count(*) + 1 FROM dag_e)", refused="1", loop="1"))
def _dag(g: Graph):
    d, target = acyclic.Dag.of(g), g.edges.agg(F.max("dst")).first()[0]
    tries = {"refused": [(target, 1)], "loop": [(1, 1)]}
    found = {"edges": d.add_edge(1, target).count_edges()}
    for name, rows in tries.items():
        try:
            d.add_edges(_spark(g).createDataFrame(rows, "src long, dst long"))
            found[name] = 0
        except CycleError:
            found[name] = 1
    return facts(_spark(g), **found)


# results
M = PS_DEG + ", m AS (SELECT id, value FROM d)"
query("metric_arg", "ps", M + " " + _said(first="(SELECT id FROM m ORDER BY value DESC, id LIMIT 1)", last="(SELECT id FROM m ORDER BY value, id LIMIT 1)"))(lambda g: facts(_spark(g), first=metrics.argmax(g.degree()), last=metrics.argmin(g.degree())))
query("metric_map", "ps", M + " SELECT id, value * 2 + 1 AS value FROM m")(lambda g: metrics.mapped(g.degree(), lambda v: v * 2 + 1).select("id", "value"))
query("metric_filter", "ps", M + " SELECT id, value FROM m WHERE value > 20")(lambda g: metrics.filtered(g.degree(), lambda v: v > 20).select("id", "value"))
query("metric_to_array", "ps", M + " " + _said(a="(SELECT value FROM m WHERE id = 1)", b="(SELECT value FROM m WHERE id = 2)", c="-1"))(lambda g: facts(_spark(g), **dict(zip("abc", metrics.to_array(g.degree(), [1, 2, -5], -1.0)))))
query("as_nodemap", "co", "SELECT id, CASE WHEN id = 1 THEN 2.5::DOUBLE WHEN id = 2 THEN 3.5 END AS value FROM co_n")(lambda g: metrics.as_nodemap(g, {1: 2.5, 2: 3.5}).select("id", "value"))
query("metric_to_pandas", "ps", M + " SELECT id, CAST(value AS BIGINT) AS value FROM m")(lambda g: _spark(g).createDataFrame(pa.Table.from_pandas(metrics.to_pandas(g.degree()).reset_index(), preserve_index=False)))

# traversal
query("bfs_order", "ut", BFS.format(g="ut", a="ut_e") + ", p AS (SELECT r.id, r.depth, (SELECT min(x.id) FROM r x JOIN ut_e e ON e.src = x.id WHERE e.dst = r.id AND x.depth = r.depth - 1) AS parent FROM r) SELECT id, row_number() OVER (ORDER BY depth, parent NULLS FIRST, id) - 1 AS position FROM p")(
    lambda g: iterate.bfs_order(g, g.nodes.agg(F.min("id").alias("id")))
)
query("dfs_tree", "co", CC.format(g="co", a="co_a") + " " + _said(arcs="(SELECT count(*) - count(DISTINCT root) FROM c)", heads="(SELECT count(*) - count(DISTINCT root) FROM c)", foreign="0"))(
    lambda g: (lambda t: facts(_spark(g), arcs=t.count(), heads=t.select("dst").distinct().count(), foreign=t.join(g.arcs(), ["src", "dst"], "left_anti").count()))(kernels.dfs_tree(g).persist())
)
query("has_path", "dag", _said(down="1", up="0"))(lambda g: (lambda t: facts(_spark(g), down=iterate.has_path(g, 1, t), up=iterate.has_path(g, t, 1)))(g.edges.agg(F.max("dst")).first()[0]))

# shortest paths
DIST = SP + ", one AS (SELECT max(id) AS t FROM r)"
query("shortest_path_length", "co", DIST + " SELECT dist AS value FROM r, one WHERE id = t")(
    lambda g: (lambda t: _spark(g).createDataFrame([(_length(g, iterate.shortest_path(g, _least(g), t, "w")),)], "value double"))(g.nodes.agg(F.max("id")).first()[0])
)


def _length(g: Graph, path: list) -> float:
    """A path's weight, all steps in one pass over the arcs; a step that is no edge is an error."""
    kind = g.nodes.schema["id"].dataType.simpleString()
    steps = _spark(g).createDataFrame(list(zip(path, path[1:])), f"src {kind}, dst {kind}")
    found = g.arcs("w").join(F.broadcast(steps), ["src", "dst"]).agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    if found["n"] < len(path) - 1:
        raise EdgeNotFound(f"a step of {path}")
    return float(found["w"] or 0)


query("astar_path", "co", DIST + " SELECT dist AS value FROM r, one WHERE id = t")(
    lambda g: (lambda t: _spark(g).createDataFrame([(_length(g, paths.astar_path(g, _least(g), t, g.nodes.select("id", F.lit(0.5).alias("value")).where(F.col("id") != t), "w")),)], "value double"))(g.nodes.agg(F.max("id")).first()[0])
)
query("bellman_ford", "co", SP + " SELECT id, dist FROM r")(lambda g: iterate.sssp(g, g.nodes.agg(F.min("id").alias("id")), "w", negative=True).select("id", "dist"))
query("floyd_warshall", "nr", ", p AS (SELECT id AS src, id AS dst, 0::DOUBLE AS d, 0 AS k FROM nr_n UNION SELECT src, dst, min(d), k FROM (SELECT p.src, e.dst, p.d + e.w AS d, k + 1 AS k FROM p JOIN nr_e e ON e.src = p.dst WHERE k < 8) GROUP BY 1, 2, k) SELECT src, dst, min(d) AS dist FROM p GROUP BY 1, 2")(lambda g: paths.floyd_warshall(g, "w"))
ALL = ", r AS (SELECT id AS head, id, [id] AS path, 0::DOUBLE AS length FROM nr_n UNION ALL SELECT r.head, e.dst, list_append(path, e.dst), length + e.w FROM r JOIN nr_e e ON e.src = r.id WHERE NOT list_contains(path, e.dst))"
query("k_shortest_paths", "nr", ALL + " SELECT array_to_string(path, ',') AS path, length FROM r WHERE head = (SELECT min(id) FROM nr_n) AND id = (SELECT max(id) FROM nr_n WHERE n_regionkey = (SELECT n_regionkey FROM nr_n WHERE id = (SELECT min(id) FROM nr_n))) ORDER BY length, path LIMIT 5")(
    lambda g: (lambda s: (lambda t: iterate.k_shortest_paths(g, s, t, 5, "w").select(F.array_join("path", ",").alias("path"), "length"))(g.nodes.where(F.col("n_regionkey") == g.nodes.where(F.col("id") == s).first()["n_regionkey"]).agg(F.max("id")).first()[0]))(_least(g))
)
query("all_shortest_paths", "uu", ", p AS (SELECT DISTINCT array_to_string([s.id, a.dst, t.id], ',') AS path FROM (SELECT min(id) AS id FROM uu_n) s, (SELECT min(id) AS id FROM uu_n WHERE id > (SELECT min(id) FROM uu_n) AND id NOT IN (SELECT dst FROM uu_a WHERE src = (SELECT min(id) FROM uu_n))) t, uu_a a, uu_a b WHERE a.src = s.id AND b.src = a.dst AND b.dst = t.id) SELECT path FROM p")(
    lambda g: (lambda s: (lambda t: iterate.all_shortest_paths(g, s, t).select(F.array_join("path", ",").alias("path")))(g.nodes.where(F.col("id") > s).join(g.arcs().where(F.col("src") == s).select(F.col("dst").alias("id")), "id", "left_anti").agg(F.min("id")).first()[0]))(_least(g))
)

# connectivity
query("component_counts", "nr", _said(weak="(SELECT count(DISTINCT n_regionkey) FROM nation)", strong="(SELECT count(DISTINCT n_regionkey) FROM nation)", connected="(SELECT CAST(count(DISTINCT n_regionkey) = 1 AS INT) FROM nation)"))(
    lambda g: facts(_spark(g), weak=iterate.number_weakly_connected_components(g), strong=iterate.number_strongly_connected_components(g), connected=iterate.is_strongly_connected(g))
)
query("number_connected_components", "co", CC.format(g="co", a="co_a") + " SELECT count(DISTINCT root) AS value FROM c")(lambda g: _spark(g).createDataFrame([(iterate.number_connected_components(g),)], "value long"))
query("node_connected_component", "nb", ", a AS (SELECT src, dst FROM nb_e UNION ALL SELECT dst, src FROM nb_e), r AS (SELECT min(id) AS id FROM nb_n UNION SELECT a.dst FROM r JOIN a ON a.src = r.id) SELECT id FROM r")(lambda g: iterate.node_connected_component(g, _least(g)))
query("is_weakly_connected", "nr", _said(value="(SELECT CAST(count(DISTINCT n_regionkey) = 1 AS INT) FROM nation)"))(lambda g: facts(_spark(g), value=iterate.is_weakly_connected(g)))
query("condensation", "dag", "SELECT src, dst FROM dag_e WHERE dst < 1000000000")(lambda g: iterate.condensation(g.subgraph(g.nodes.where("id < 1000000000").select("id"))).edges.select("src", "dst"))
query("condensed_rings", "nr", "SELECT min(id) AS id, count(*) AS size FROM nr_n GROUP BY n_regionkey")(lambda g: iterate.condensation(g).nodes.select("id", "size"))
query("block_bridges", "nb", "SELECT src, dst FROM nb_e WHERE dst >= 2000000000 UNION ALL SELECT src, dst FROM nb_e WHERE src < 1000 AND dst < 1000000 AND dst NOT IN (SELECT src FROM nb_e WHERE dst BETWEEN 1000000 AND 1999999999)")(kernels.bridges)
query("block_cuts", "nb", "SELECT DISTINCT src AS id FROM nb_e WHERE dst >= 2000000000 UNION SELECT src FROM nb_e WHERE src < 1000 AND dst < 1000000 GROUP BY src HAVING count(*) > 1")(kernels.articulation_points)
query("block_sizes", "nb", ", s AS (SELECT src, count(*) AS k FROM nb_e WHERE src BETWEEN 1000 AND 999999 AND dst BETWEEN 1000000 AND 1999999999 GROUP BY src), z AS (SELECT k + 2 AS size FROM s UNION ALL SELECT 2 FROM nb_e WHERE dst >= 2000000000 UNION ALL SELECT 2 FROM nb_e WHERE src < 1000 AND dst < 1000000 AND dst NOT IN (SELECT src FROM s)) SELECT CAST(size AS BIGINT) AS size, count(*) AS count FROM z GROUP BY size")(
    lambda g: kernels.biconnected_components(g).select(F.size("nodes").cast("long").alias("size")).groupBy("size").agg(F.count("*").alias("count"))
)

# acyclic graphs and cycles
query("dag_facts", "dag", LV + " " + _said(dag="1", depth="(SELECT max(level) FROM v)", path="(SELECT max(level) + 1 FROM v)"))(
    lambda g: facts(_spark(g), dag=iterate.is_dag(g), depth=acyclic.Dag.of(g).depth(), path=len(acyclic.dag_longest_path(g)))
)
query("cycle_facts", "nr", _said(dag="0", closed="1"))(lambda g: (lambda c: facts(_spark(g), dag=iterate.is_dag(g), closed=c[0] == c[-1] and all(g.has_edge(a, b) for a, b in zip(c, c[1:]))))(kernels.find_cycle(g)))
query("simple_cycles", "nr", ALL.replace("WHERE NOT list_contains(path, e.dst)", "WHERE NOT list_contains(path, e.dst) AND e.dst > r.head") + " SELECT array_to_string(list_append(path, head), ',') AS cycle FROM r JOIN nr_e e ON e.src = r.id AND e.dst = r.head")(lambda g: kernels.simple_cycles(g).select(F.array_join("cycle", ",").alias("cycle")))
query("weighted_longest_path", "dag", ", f AS (SELECT id, 0::DOUBLE AS d FROM dag_n UNION SELECT e.dst, f.d + e.src % 7 FROM f JOIN dag_e e ON e.src = f.id) SELECT max(d) AS length FROM f")(
    lambda g: iterate.longest_path_lengths(Graph(g.nodes, g.edges.withColumn("w", (F.col("src") % 7).cast("double")), True), "w").agg(F.max("best").alias("length"))
)
query("all_topological_sorts", None, "SELECT CAST(20 AS BIGINT) AS orders, CAST(1 AS BIGINT) AS first")(
    lambda spark, _: acyclic.all_topological_sorts(Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5)], "src long, dst long"), directed=True)).agg(F.count("*").alias("orders"), F.sum((F.array_join("nodes", "") == "012345").cast("long")).alias("first"))
)
query("maximum_antichain", "dag", TC + " " + _said(size="(SELECT count(*) FROM part)", related="0"))(
    lambda g: (lambda a: facts(_spark(g), size=a.count(), related=g.edges.join(a.select(F.col("id").alias("src")), "src").join(a.select(F.col("id").alias("dst")), "dst").count()))(kernels.maximum_antichain(g).persist())
)
query("minimum_chain_partition", "dag", _said(chains="(SELECT count(*) FROM part)", nodes="(SELECT count(*) FROM dag_n)"))(lambda g: (lambda c: facts(_spark(g), chains=c.select("chain").distinct().count(), nodes=c.count()))(kernels.minimum_chain_partition(g).persist()))
query("lowest_common_ancestors", "dag", ", u AS (SELECT (SELECT min(p_partkey) + 1000000000 FROM part) AS a, (SELECT max(p_partkey) + 1000000000 FROM part) AS b), x AS (SELECT a AS id FROM u UNION SELECT e.src FROM x JOIN dag_e e ON e.dst = x.id), y AS (SELECT b AS id FROM u UNION SELECT e.src FROM y JOIN dag_e e ON e.dst = y.id), c AS (SELECT id FROM x INTERSECT SELECT id FROM y) SELECT id FROM c WHERE id NOT IN (SELECT e.src FROM dag_e e JOIN c z ON z.id = e.dst)")(
    lambda g: (lambda r: iterate.lowest_common_ancestors(g, r["a"], r["b"]))(g.nodes.where("id >= 1000000000").agg(F.min("id").alias("a"), F.max("id").alias("b")).first())
)

# centrality and structure
query("in_degree_centrality", "ut", "SELECT n.id, round((SELECT count(*) FROM ut_e WHERE dst = n.id) / ((SELECT count(*) FROM ut_n) - 1.0), 6) AS value FROM ut_n n")(lambda g: local.in_degree_centrality(g).select("id", "value"))
query("out_degree_centrality", "ut", "SELECT n.id, round((SELECT count(*) FROM ut_e WHERE src = n.id) / ((SELECT count(*) FROM ut_n) - 1.0), 6) AS value FROM ut_n n")(lambda g: local.out_degree_centrality(g).select("id", "value"))
query("pagerank_converged", "nr", _said(sum="1", nodes="(SELECT count(*) FROM nation)"))(lambda g: (lambda p: facts(_spark(g), sum=p["s"], nodes=p["n"]))(iterate.pagerank(g, tol=1e-9, max_iter=500).agg(F.sum("value").alias("s"), F.count("*").alias("n")).first()))
query("diameter_radius", "uu", ", d AS (SELECT src AS id, count(*) AS k FROM uu_a GROUP BY src), p AS (SELECT DISTINCT a.src, b.dst FROM uu_a a JOIN uu_a b ON a.dst = b.src UNION SELECT src, dst FROM uu_a), e AS (SELECT n.id, CASE WHEN d.k = (SELECT count(*) - 1 FROM uu_n) THEN 1 ELSE 2 END AS ecc, (SELECT count(DISTINCT dst) FROM p WHERE p.src = n.id AND p.dst <> n.id) AS near FROM uu_n n JOIN d ON d.id = n.id) " + _said(diameter="(SELECT max(ecc) FROM e)", radius="(SELECT min(ecc) FROM e)"))(
    lambda g: facts(_spark(g), diameter=sources.diameter(g), radius=sources.radius(g))
)
query("betweenness_all_sources", "uu", None)(lambda g: sources.betweenness_centrality(g, k=10).select("id", "value"))
query("core_facts", "co", _said(short="0", long="0", missing="0"))(lambda g: _core_facts(g))


def _core_facts(g: Graph) -> DataFrame:
    """Every node has as many neighbours of its core or a higher one as its number says, and the next core is empty of it."""
    c = iterate.core_number(g).persist()
    near = g.arcs().join(c.select(F.col("id").alias("src"), F.col("value").alias("own")), "src").join(c.select(F.col("id").alias("dst"), "value"), "dst")
    short = c.join(near.where("value >= own").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "id", "left").where("coalesce(k, 0) < value").count()
    top = c.agg(F.max("value")).first()[0]
    # peeling the nodes of the highest core and above by one more neighbour leaves nothing
    left = cut(g.subgraph(c.where(F.col("value") >= top).select("id")).arcs().select("src", "dst"))
    while (n := left.count()) and not (drop := cut(left.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") <= top).select("src"))).isEmpty():
        left = cut(left.join(drop, "src", "left_anti").join(drop.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return facts(_spark(g), short=short, long=n, missing=g.count_nodes() - c.count())


query("k_core", "nr", "SELECT id FROM nr_n")(lambda g: iterate.k_core(g.to_undirected(), 2).nodes.select("id"))
query("forest_facts", "dag", _said(forest="0", tree="0", regular="0"))(lambda g: (lambda u: facts(_spark(g), forest=iterate.is_forest(u), tree=iterate.is_tree(u), regular=local.is_regular(u)))(g.to_undirected()))
query("summary", "co", "SELECT count(*) AS nodes, (SELECT count(*) FROM co_e) AS edges FROM co_n")(lambda g: local.summary(g).select(*[c for c in ("nodes", "edges") if c in local.summary(g).columns]))

# communities, matchings, colours, forests
MOD = "(SELECT {q})"


def _quality(g: Graph, labels: DataFrame) -> float:
    return local.modularity(g, labels, "w").first()["value"]


query("louvain_facts", "nr", _said(rings="(SELECT count(DISTINCT n_regionkey) FROM nation)", mixed="0", better="1"))(
    lambda g: (lambda u: (lambda c: facts(_spark(g), rings=c.join(g.nodes, "id").select("n_regionkey").distinct().count(), mixed=c.join(g.nodes, "id").groupBy("label").agg(F.count_distinct("n_regionkey").alias("k")).where("k > 1").count(), better=_quality(u, c) >= _quality(u, g.nodes.select("id", F.col("n_regionkey").alias("label"))) - 1e-9))(kernels.louvain_communities(u).persist()))(kernels._undirected(g, "w")[0])
)
query("louvain_hierarchy", "co", _said(nodes="(SELECT count(*) FROM co_n)", nested="1"))(lambda g: _hierarchy(g))


def _hierarchy(g: Graph) -> DataFrame:
    h = kernels.louvain_hierarchy(g, "w").persist()
    up = h.join(h.select((F.col("level") - 1).alias("level"), "id", F.col("label").alias("above")), ["level", "id"]).groupBy("level", "label").agg(F.count_distinct("above").alias("k"))
    return facts(_spark(g), nodes=h.where("level = 0").count(), nested=up.where("k > 1").isEmpty())


query("fluid_communities", "uu", _said(nodes="(SELECT count(*) FROM uu_n)", fluids="3"))(lambda g: (lambda c: facts(_spark(g), nodes=c.count(), fluids=c.select("label").distinct().count()))(kernels.asyn_fluid_communities(g, 3).persist()))
query("girvan_newman", "nr", ", r AS (SELECT min(id) AS root, count(*) AS n FROM nr_n GROUP BY n_regionkey) " + _said(parts="(SELECT count(*) + 1 FROM r)"))(lambda g: facts(_spark(g), parts=kernels.girvan_newman(g.to_undirected()).select("label").distinct().count()))
PAIR = ", u AS (SELECT n_regionkey AS r, least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM nr_e GROUP BY 1, 2, 3), m AS (SELECT r, max(w) AS w, 1 AS k FROM u GROUP BY r UNION ALL SELECT x.r, max(x.w + y.w), 2 FROM u x JOIN u y ON x.r = y.r AND x.a <> y.a AND x.a <> y.b AND x.b <> y.a AND x.b <> y.b GROUP BY x.r)"
query("max_weight_matching", "nr", PAIR + " SELECT sum(w)::DOUBLE AS weight FROM (SELECT r, max(w) AS w FROM m GROUP BY r)")(lambda g: (lambda u: matching.matching_weight(u, matching.max_weight_matching(u)).select("weight"))(g.to_undirected()))
query("min_weight_matching", "nr", PAIR.replace("max(w) AS w, 1", "min(w) AS w, 1").replace("max(x.w + y.w)", "min(x.w + y.w)") + " SELECT sum(w)::DOUBLE AS weight FROM (SELECT r, arg_max(w, k) AS w FROM m GROUP BY r)")(lambda g: (lambda u: matching.matching_weight(u, matching.min_weight_matching(u)).select("weight"))(g.to_undirected()))
query("matching_facts", "co", _said(matching="1", maximal="1"))(lambda g: (lambda m: facts(_spark(g), matching=local.is_matching(g, m), maximal=local.is_maximal_matching(g, m)))(iterate.maximal_matching(g).persist()))
query("greedy_color_facts", "co", ", d AS (SELECT src, count(*) AS k FROM co_a GROUP BY src) " + _said(clashes="0", nodes="(SELECT count(*) FROM co_n)", many="0"))(lambda g: _colours(g))


def _colours(g: Graph) -> DataFrame:
    c = iterate.greedy_color(g).persist()
    ends = g.edges.join(c.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst")
    top = g.degree().agg(F.max("value")).first()[0]
    return facts(_spark(g), clashes=ends.where("a = b").count(), nodes=c.count(), many=c.where(F.col("color") > top).count())


RING = ", u AS (SELECT n_regionkey AS r, least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM nr_e GROUP BY 1, 2, 3), p AS (SELECT a AS s, b AS t, w AS top, 0 AS k FROM u UNION SELECT b, a, w, 0 FROM u UNION SELECT s, x.b, min(greatest(top, x.w)), k + 1 FROM p JOIN (SELECT a, b, w FROM u UNION ALL SELECT b, a, w FROM u) x ON x.a = p.t WHERE k < 6 GROUP BY s, x.b, k), mm AS (SELECT s, t, min(top) AS top FROM p WHERE s < t GROUP BY 1, 2)"
query("minimum_spanning_tree", "nr", RING + " " + _said(edges="(SELECT (SELECT count(*) FROM nr_n) - count(DISTINCT n_regionkey) FROM nation)", heavier="0"))(lambda g: _tree_facts(g))


def _tree_facts(g: Graph) -> DataFrame:
    """A minimum spanning tree has no edge that a way of lighter edges could stand for, compared with the maximum one."""
    u = g.to_undirected()
    low, high = iterate.spanning_tree(u, "w"), iterate.spanning_tree(u, "w", maximum=True)
    weight = lambda t: t.edges.agg(F.sum("w")).first()[0]
    return facts(_spark(g), edges=low.count_edges(), heavier=weight(low) > weight(high))


query("min_cut", "dag", _said(value="(SELECT count(*) FROM dag_e a JOIN dag_e b ON b.src = a.dst WHERE a.src = 1 AND b.dst = (SELECT max(dst) FROM dag_e))"))(
    lambda g: facts(_spark(g), value=kernels.minimum_cut(Graph(g.nodes, g.edges.withColumn("capacity", F.lit(1.0)), True), 1, g.edges.agg(F.max("dst")).first()[0]).agg(F.sum("value")).first()[0])
)
query("spectra", None, "SELECT 'connectivity' AS name, round(2 - 2 * cos(2 * pi() / 12), 6) AS value UNION ALL SELECT 'top', 2.0")(
    lambda spark, _: facts(spark, connectivity=kernels.algebraic_connectivity(gen.cycle_graph(spark, 12)), top=kernels.spectrum(gen.cycle_graph(spark, 12)).agg(F.max("value")).first()[0])
)

# files: what is written is read again


def _folder(spark: SparkSession) -> str:
    cut(spark.range(1))  # names the shared folder
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/graphs-{uuid.uuid4().hex}"


def _back(kind: str):
    def f(g: Graph) -> DataFrame:
        path = f"{_folder(_spark(g))}/{kind}"
        kw = {"directed": True} if kind in ("edgelist", "adjacency") else {}
        files.write(g, path, kind)
        return files.read(_spark(g), path, kind, **kw).edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))

    return f


for _kind in ("edgelist", "adjacency", "json", "graphml", "gexf", "dot", "mermaid", "parquet"):
    query(f"file_{_kind}", "nr", "SELECT src, dst FROM nr_e")(_back(_kind))
query("file_pandas", "nr", "SELECT src, dst FROM nr_e")(lambda g: files.from_pandas(_spark(g), g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).toPandas(), directed=True).edges.select("src", "dst"))
query("file_numpy", "nr", ", k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nr_n) SELECT a.i AS src, b.i AS dst FROM nr_e e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst")(lambda g: files.from_numpy(_spark(g), files.to_numpy(g), directed=True).edges.select("src", "dst"))
query("file_dict", "nr", "SELECT src, dst, CAST(w AS DOUBLE) AS w FROM nr_e")(lambda g: files.from_dict(_spark(g), files.to_dict(g), directed=True).edges.select("src", "dst", F.col("w").cast("double").alias("w")))
query("file_sparse", "nr", ", k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nr_n) SELECT a.i, b.i AS j, CAST(w AS DOUBLE) AS value FROM nr_e e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst")(
    lambda g: _spark(g).createDataFrame(list(zip(*files.to_scipy_sparse(g)[:3])), "i long, j long, value double")
)

# families: exact ones by SQL, random ones by what every draw keeps
_EXACT = {
    "circular_ladder": (lambda s: gen.circular_ladder_graph(s, 7), 14, 21), "lollipop": (lambda s: gen.lollipop_graph(s, 5, 4), 9, 14), "barbell": (lambda s: gen.barbell_graph(s, 4, 3), 11, 16),
    "petersen": (gen.petersen_graph, 10, 15), "complete_multipartite": (lambda s: gen.complete_multipartite_graph(s, 2, 3, 4), 9, 26), "empty": (lambda s: gen.empty_graph(s, 6), 6, 0),
    "gnm": (lambda s: gen.gnm_random_graph(s, 60, 200, seed=3), 60, 200), "barabasi_albert": (lambda s: gen.barabasi_albert(s, 80, 3, seed=3), 80, 3 + 76 * 3),
    "powerlaw_cluster": (lambda s: gen.powerlaw_cluster(s, 80, 3, 0.5, seed=3), 80, 77 * 3), "watts_strogatz": (lambda s: gen.watts_strogatz(s, 60, 6, 0.2, seed=3), 60, 180),
    "random_tree": (lambda s: gen.random_tree(s, 70, seed=3), 70, 69), "random_regular": (lambda s: gen.random_regular(s, 4, 50, seed=3), 50, 100), "florentine": (gen.florentine_families, 15, 20),
}


def _exact(name: str, make, n: int, m: int) -> None:
    query(f"family_{name}", None, _said(nodes=str(n), edges=str(m), repeats="0"))(
        lambda spark, _: (lambda g: facts(spark, nodes=g.count_nodes(), edges=g.count_edges(), repeats=g.count_edges() - g.edges.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct().count()))(make(spark))
    )


for _name, (_family_maker, _n, _m) in _EXACT.items():
    _exact(_name, _family_maker, _n, _m)
query("family_regular", None, _said(regular="1", tree="1"))(lambda spark, _: facts(spark, regular=local.is_regular(gen.random_regular(spark, 4, 50, seed=3)), tree=iterate.is_tree(gen.random_tree(spark, 70, seed=3))))
query("family_dags", None, _said(random="1", layered="1", tasks="1", layers="3", estimates="0"))(lambda spark, _: _dags(spark))


def _dags(spark: SparkSession) -> DataFrame:
    tasks, layers = gen.random_task_dag(spark, 60, seed=3), gen.layered_dag(spark, [4, 6, 5], seed=3)
    return facts(
        spark, random=iterate.is_dag(gen.random_dag(spark, 80, seed=3)), layered=iterate.is_dag(layers), tasks=iterate.is_dag(tasks),
        layers=acyclic.Dag.of(layers).depth() + 1, estimates=tasks.nodes.where("not (min <= mode and mode <= max)").count(),
    )


query("family_blocks", None, _said(inside="60", across="0"))(
    lambda spark, _: (lambda g: facts(spark, inside=g.edges.where("floor(src / 5) = floor(dst / 5)").count(), across=g.edges.where("floor(src / 5) <> floor(dst / 5)").count()))(gen.stochastic_block_model(spark, [5] * 6, [[1.0 if i == j else 0.0 for j in range(6)] for i in range(6)], seed=1))
)
query("family_planted", None, _said(edges="60"))(lambda spark, _: facts(spark, edges=gen.planted_partition(spark, 6, 5, 1.0, 0.0, seed=1).count_edges()))
query("family_configuration", None, _said(loops="0", over="0"))(lambda spark, _: (lambda g: facts(spark, loops=g.selfloops().count(), over=g.degree().where("value > 3").count()))(gen.configuration_model(spark, [3] * 40, seed=1)))

# simulations: what holds in every run


def _epidemic(method: str):
    def f(g: Graph) -> DataFrame:
        n = g.count_nodes()
        log = simulate.simulate(g, "SIR", {"beta": 0.3, "gamma": 0.5}, {_least(g): "I"}, 40.0, method=method, runs=5, seed=2).persist()
        end, first = outcomes.final(log), outcomes.first_time(log, "I")
        back = log.where("state = 'S' and time > 0").count()
        total = outcomes.summary(log).groupBy("run").agg(F.sum("final").alias("n")).where(F.col("n") != n).count()
        top = outcomes.peak(outcomes.counts(log), "I").where(F.col("count") < 1).count()
        return facts(_spark(g), runs=log.select("run").distinct().count(), ends=end.count() / n, back=back, total=total, top=top, early=first.where("time < 0").count(), start=outcomes.frame(log, 0.0).where("state = 'I'").count())

    return f


_KEPT = _said(runs="5", ends="5", back="0", total="0", top="0", early="0", start="5")
query("epidemic_discrete", "uu", _KEPT)(_epidemic("discrete"))
query("epidemic_gillespie", "uu", _KEPT)(_epidemic("gillespie"))
query("epidemic_saturates", "nr", _said(infected="(SELECT count(*) FROM nr_n WHERE n_regionkey = (SELECT n_regionkey FROM nr_n WHERE id = (SELECT min(id) FROM nr_n)))"))(
    lambda g: facts(_spark(g), infected=outcomes.final(simulate.simulate(g.to_undirected(), "SI", {"beta": 50.0}, {_least(g): "I"}, 60.0, seed=1)).where("state = 'I'").count())
)
query("models_rest", None, _said(SI="1", SIS="0", SIR="1", SEIR="1", SIRS="0", SEIRD="1"))(lambda spark, _: facts(spark, **{k: simulate.model(k).terminates() for k in simulate.MODELS}))
query("linear_threshold", "nr", ", r AS (SELECT min(id) AS id FROM nr_n UNION SELECT e.dst FROM r JOIN nr_e e ON e.src = r.id) SELECT id FROM r")(
    lambda g: iterate.linear_threshold(g, g.nodes.agg(F.min("id").alias("id")), g.nodes.select("id", F.lit(0.01).alias("theta"))).select("id")
)
query("independent_cascade", "nr", ", r AS (SELECT min(id) AS id FROM nr_n UNION SELECT e.dst FROM r JOIN nr_e e ON e.src = r.id) SELECT id FROM r")(lambda g: iterate.independent_cascade(g, g.nodes.agg(F.min("id").alias("id")), 1.0).select("id"))
query("greedy_influence", "nr", ", s AS (SELECT n_regionkey, count(*) AS n, min(id) AS id FROM nr_n GROUP BY n_regionkey), o AS (SELECT id, n, row_number() OVER (ORDER BY n DESC, id) AS k FROM s) SELECT k - 1 AS place, id, CAST(sum(n) OVER (ORDER BY k) AS DOUBLE) AS spread FROM o WHERE k <= 3")(lambda g: simulate.greedy_influence(g, 3, p=1.0, runs=3))
query("voter_model", "uu", _said(lost="0", runs="3"))(
    lambda g: (lambda v: facts(_spark(g), lost=v.groupBy("run", "sweep").agg(F.sum("count").alias("n")).where(F.col("n") != g.count_nodes()).count(), runs=v.select("run").distinct().count()))(simulate.voter_model(g, 3, 5, runs=3).persist())
)
query("kuramoto", "nr", _said(outside="0"))(lambda g: facts(_spark(g), outside=simulate.kuramoto(g, 1.0, 2.0, runs=2).where("r < 0 or r > 1 + 1e-9").count()))
query("bounded_confidence", "nr", _said(outside="0", nodes="(SELECT count(*) FROM nation)", crossed="0"))(
    lambda g: (lambda b: facts(_spark(g), outside=b.where("value < 0 or value > 1").count(), nodes=b.count(), crossed=b.groupBy("cluster").agg((F.max("value") - F.min("value")).alias("w"), F.count("*").alias("n")).where("w >= 0.3 * n").count()))(simulate.bounded_confidence(g.to_undirected(), epsilon=0.3).persist())
)

# schedules
query("schedule_one_worker", "dag", "SELECT sum(duration) AS makespan FROM dag_n")(lambda g: outcomes.makespans(simulate.schedule(g, workers=1)).select("makespan"))
query("schedule_many_workers", "dag", ", f AS (SELECT id, duration AS ef FROM dag_n UNION SELECT e.dst, f.ef + n.duration FROM f JOIN dag_e e ON e.src = f.id JOIN dag_n n ON n.id = e.dst) SELECT max(ef) AS makespan FROM f")(
    lambda g: outcomes.makespans(simulate.schedule(g, workers=g.count_nodes())).select("makespan")
)
query("schedule_facts", "dag", _said(tasks="(SELECT count(*) FROM dag_n)", early="0", crowded="0", first="1", slow="0"))(lambda g: _schedule(g))


def _schedule(g: Graph) -> DataFrame:
    log = simulate.schedule(g, workers=4, policy="longest").persist()
    ends = g.edges.join(log.select(F.col("task").alias("src"), F.col("end").alias("before")), "src").join(log.select(F.col("task").alias("dst"), "start"), "dst")
    util = outcomes.utilization(log, 4).first()["value"]
    return facts(_spark(g), tasks=log.count(), early=ends.where("start < before - 1e-9").count(), crowded=util > 1 + 1e-9, first=outcomes.runs_of(log, 1).count(), slow=outcomes.task_runs(log).where("duration <= 0").count())


query("schedule_failures", "nr", _said(blocked="(SELECT count(*) FROM nr_n WHERE false)", attempts="75", fails="75"))(
    lambda g: (lambda log: facts(_spark(g), blocked=log.where("status = 'blocked'").count(), attempts=log.count(), fails=log.where("status = 'failed'").count()))(simulate.schedule(Graph(g.nodes.withColumn("duration", F.lit(1.0)), g.edges.limit(0), True), workers=3, failure_rate=1.0, max_retries=2).persist())
)
query("schedule_percentiles", "dag", ", f AS (SELECT id, duration AS ef FROM dag_n UNION SELECT e.dst, f.ef + n.duration FROM f JOIN dag_e e ON e.src = f.id JOIN dag_n n ON n.id = e.dst), s AS (SELECT max(ef) AS m FROM f) " + _said(p50="(SELECT m FROM s)", sure="1", mean="(SELECT m FROM s)", stderr="0"))(
    lambda g: (lambda m: facts(_spark(g), p50=outcomes.percentile(m, 50).first()["value"], sure=outcomes.probability(m, 1e9).first()["value"], mean=outcomes.monte_carlo(m).first()["mean"], stderr=outcomes.monte_carlo(m).first()["stderr"]))(
        simulate.monte_carlo_schedule(Graph(g.nodes.withColumns({"min": F.col("duration"), "mode": F.col("duration"), "max": F.col("duration")}), g.edges, True), runs=8).persist()
    )
)

# layouts: every node has a place, and the method's own rule holds
for _layout in ("circular", "arc", "grid", "spiral", "random", "spectral", "shell", "tree", "radial", "stress", "force_atlas2", "auto"):
    query(f"layout_{_layout}", "nr", "SELECT count(*) AS nodes, count(*) AS finite FROM nation")(
        lambda g, how=_layout: layout.compute(g.to_undirected(), how).agg(F.count("*").alias("nodes"), F.sum((~F.isnan("x") & ~F.isnan("y") & (F.abs("x") + F.abs("y") < 1e9)).cast("long")).alias("finite"))
    )
query("layout_hierarchical", "dag", LV + " SELECT CAST(level AS DOUBLE) AS y, count(*) AS nodes FROM v GROUP BY level")(lambda g: layout.compute(g).groupBy("y").agg(F.count("*").alias("nodes")))
query("layout_bipartite", "ps", "SELECT CASE WHEN id < 1000000 THEN 0.0::DOUBLE ELSE 1 END AS x, count(*) AS nodes FROM ps_n GROUP BY 1")(lambda g: layout.compute(g, "bipartite").groupBy("x").agg(F.count("*").alias("nodes")))
query("layout_apart", "nr", _said(close="0", boxes="0"))(lambda g: _apart(g.to_undirected()))


def _apart(g: Graph) -> DataFrame:
    p = layout.remove_overlaps(layout.compute(g, "random"), 0.5).persist()
    a, b = p.select(F.col("id").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1")), p.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    close = a.join(b, F.col("a") < F.col("b")).where("(x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) < 0.24").count()
    packed = layout.pack_components(g, layout.compute(g, "tree")).join(iterate.weak_components(g), "id")
    box = packed.groupBy("root").agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("d"))
    other = box.select(*[F.col(c).alias(f"{c}2") for c in box.columns])
    return facts(_spark(g), close=close, boxes=box.join(other, F.col("root") < F.col("root2")).where("l <= r2 and l2 <= r and t <= d2 and t2 <= d").count())


query("graph_distances", "nr", ", a AS (SELECT src, dst FROM nr_e UNION SELECT dst, src FROM nr_e), p AS (SELECT id AS src, id AS dst, 0 AS d FROM nr_n UNION SELECT p.src, a.dst, d + 1 FROM p JOIN a ON a.src = p.dst WHERE d < 6), m AS (SELECT src, dst, min(d) AS d FROM p GROUP BY 1, 2) SELECT x.id AS src, y.id AS dst, CAST(coalesce(m.d, (SELECT max(d) + 1 FROM m)) AS DOUBLE) AS dist FROM nr_n x CROSS JOIN nr_n y LEFT JOIN m ON m.src = x.id AND m.dst = y.id")(layout.graph_distances)
