"""The graph queries and their SQL for DuckDB. Both sides round floats to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import metrics
from lattica.operators import local
from lattica.operators.model import Graph
from lattica.plans import iterate
from lattica.sources import derived
from lattica.sources.derived import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MAKE = {
    "ps": derived.part_supplier, "cs": derived.customer_supplier, "ss": derived.supplier_pairs, "co": derived.customer_succession,
    "pd": derived.part_pairs, "dag": derived.supply_chain, "ut": derived.user_handover, "uu": derived.user_contacts,
}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros; NaN becomes null."""
    def fix(c: str, kind: str):
        if kind == "double":
            return F.when(F.isnan(c), None).otherwise(F.round(c, 6) + F.lit(0.0)).alias(c)
        return F.col(c).cast("long").alias(c) if kind == "int" else F.col(c)

    return df.select(*[fix(c, k) for c, k in df.dtypes])


def query(name: str, graph: str | None, sql: str | None):
    """Registers a function of a graph (or of spark and sf_dir) as a query, with its SQL after the graph's tables."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(_MAKE[graph](spark, sf_dir)) if graph else f(spark, sf_dir)
            return rounded(out)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {SQL[graph]} {sql}" if graph and sql.lstrip().startswith(",") else f"WITH {SQL[graph]} {sql}" if graph else sql
        return f

    return register


def _named(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


_DEG = ", d AS (SELECT id, count(*) AS value FROM (SELECT src AS id FROM {g}_e UNION ALL SELECT dst FROM {g}_e) GROUP BY id)"
PS_DEG = _DEG.format(g="ps")

# degrees and global numbers
query("degree_topk", "ps", PS_DEG + " SELECT id, value FROM d ORDER BY value DESC, id LIMIT 25")(lambda g: metrics.top(g.degree(), 25).select("id", "value"))
query("bottom_k", "ps", PS_DEG + " SELECT id, value FROM d ORDER BY value, id LIMIT 25")(lambda g: metrics.bottom(g.degree(), 25).select("id", "value"))
query("in_out_degree", "ut", "SELECT n.id, (SELECT count(*) FROM ut_e WHERE dst = n.id) AS n_in, (SELECT count(*) FROM ut_e WHERE src = n.id) AS n_out FROM ut_n n")(
    lambda g: g.in_degree().select("id", F.col("value").alias("n_in")).join(g.out_degree().select("id", F.col("value").alias("n_out")), "id")
)
query("weighted_degree", "ss", "SELECT id, round(CAST(sum(w) AS DOUBLE), 6) AS value FROM (SELECT src AS id, w FROM ss_e UNION ALL SELECT dst, w FROM ss_e) GROUP BY id")(lambda g: g.degree("w").where("value > 0").select("id", "value"))
query("degree_centrality", "ps", PS_DEG + " SELECT id, round(value / (SELECT count(*) - 1 FROM d), 6) AS value FROM d")(lambda g: local.degree_centrality(g).select("id", "value"))
query("degree_distribution", "ps", PS_DEG + " SELECT value AS degree, count(*) AS count FROM d GROUP BY value")(local.degree_distribution)
query("degree_histogram", "ps", PS_DEG + ", r AS (SELECT unnest(range(0, (SELECT max(value) + 1 FROM d))) AS degree) SELECT r.degree, (SELECT count(*) FROM d WHERE value = r.degree) AS count FROM r")(local.degree_histogram)
query("average_degree", "ps", "SELECT round(2.0 * (SELECT count(*) FROM ps_e) / (SELECT count(*) FROM ps_n), 6) AS value")(local.average_degree)
query("density", "ps", "SELECT round(2.0 * (SELECT count(*) FROM ps_e) / ((SELECT count(*) FROM ps_n) * ((SELECT count(*) FROM ps_n) - 1.0)), 6) AS value")(local.density)
query("s_metric", "ps", PS_DEG + " SELECT round(CAST(sum(a.value * b.value) AS DOUBLE), 6) AS value FROM ps_e e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst")(local.s_metric)
query("reciprocity", "ut", "SELECT round((SELECT count(*) FROM ut_e a JOIN ut_e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) / CAST((SELECT count(*) FROM ut_e) AS DOUBLE), 6) AS value")(local.reciprocity)
query("selfloops", "ut", "SELECT src, dst FROM ut_e WHERE src = dst")(lambda g: g.selfloops().select("src", "dst"))
query("to_undirected", "ut", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ut_e")(lambda g: g.to_undirected().edges.select("src", "dst"))
query("to_undirected_reciprocal", "ut", "SELECT DISTINCT a.src, a.dst FROM ut_e a JOIN ut_e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")(lambda g: g.to_undirected(reciprocal=True).edges.select("src", "dst"))
query("reverse", "ut", "SELECT dst AS src, src AS dst FROM ut_e")(lambda g: g.reverse().edges.select("src", "dst"))
query("sources_sinks", "dag", "SELECT id, CAST(id NOT IN (SELECT dst FROM dag_e) AS BIGINT) AS source, CAST(id NOT IN (SELECT src FROM dag_e) AS BIGINT) AS sink FROM dag_n WHERE id NOT IN (SELECT dst FROM dag_e) OR id NOT IN (SELECT src FROM dag_e)")(
    lambda g: g.sources().select("id", F.lit(1).cast("long").alias("source")).join(g.sinks().select("id", F.lit(1).cast("long").alias("sink")), "id", "full").select("id", F.coalesce("source", F.lit(0).cast("long")).alias("source"), F.coalesce("sink", F.lit(0).cast("long")).alias("sink"))
)
ORACLE_COMPOSE = f"WITH {SQL['ps']}, {SQL['cs']} SELECT src, dst FROM ps_e UNION SELECT src, dst FROM cs_e"


@query("compose", None, ORACLE_COMPOSE)
def _compose(spark, sf_dir):
    return derived.part_supplier(spark, sf_dir).compose(derived.customer_supplier(spark, sf_dir)).edges.select("src", "dst")


@query("subgraph", "ss", "SELECT src, dst, w FROM ss_e WHERE src % 3 = 0 AND dst % 3 = 0")
def _subgraph(g: Graph):
    return g.subgraph(g.nodes.where("id % 3 = 0").select("id")).edges.select("src", "dst", "w")


@query("remove_nodes", "ss", "SELECT src, dst, w FROM ss_e WHERE src % 3 <> 0 AND dst % 3 <> 0")
def _remove(g: Graph):
    return g.remove_nodes(g.nodes.where("id % 3 = 0").select("id")).edges.select("src", "dst", "w")


@query("relabel", "ut", "SELECT src + 5000 AS src, dst + 5000 AS dst FROM ut_e")
def _relabel(g: Graph):
    return g.relabel(g.nodes.select("id", (F.col("id") + 5000).alias("new"))).edges.select("src", "dst")


# triangles and clustering
TRI = ", t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z, a.w AS w1, b.w AS w2, c.w AS w3 FROM co_e a JOIN co_e b ON a.dst = b.src JOIN co_e c ON c.src = a.src AND c.dst = b.dst), tn AS (SELECT id, count(*) AS t, sum(g) AS g FROM (SELECT unnest([x, y, z]) AS id, cbrt(w1 / top * (w2 / top) * (w3 / top)) AS g FROM t, (SELECT CAST(max(w) AS DOUBLE) AS top FROM co_e)) GROUP BY id), dg AS (SELECT src AS id, count(*) AS d FROM co_a GROUP BY src), cl AS (SELECT n.id, coalesce(tn.t, 0) AS t, coalesce(d, 0) AS d, coalesce(g, 0) AS g FROM co_n n LEFT JOIN tn USING (id) LEFT JOIN dg USING (id))"
query("triangles", "co", TRI + " SELECT id, t AS value FROM cl")(lambda g: local.triangles(g).select("id", "value"))
query("clustering", "co", TRI + " SELECT id, round(CASE WHEN d > 1 THEN 2.0 * t / (d * (d - 1)) ELSE 0 END, 6) AS value FROM cl")(lambda g: local.clustering(g).select("id", "value"))
query("clustering_weighted", "co", TRI + " SELECT id, round(CASE WHEN d > 1 THEN 2.0 * g / (d * (d - 1)) ELSE 0 END, 6) AS value FROM cl")(lambda g: local.clustering(g, "w").select("id", "value"))
query("average_clustering", "co", TRI + " SELECT round(avg(CASE WHEN d > 1 THEN 2.0 * t / (d * (d - 1)) ELSE 0 END), 6) AS value FROM cl")(local.average_clustering)
query("transitivity", "co", TRI + " SELECT round(2.0 * sum(t) / sum(d * (d - 1)), 6) AS value FROM cl")(local.transitivity)
query("square_clustering", "co", """, sn AS (SELECT a.src AS v, b.dst AS x, count(*) AS p FROM co_a a JOIN co_a b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2),
dg AS (SELECT src AS id, count(*) AS d FROM co_a GROUP BY src),
pr AS (SELECT a.src AS v, a.dst AS u, b.dst AS w FROM co_a a JOIN co_a b ON a.src = b.src AND a.dst < b.dst),
q AS (SELECT pr.v, pr.u, pr.w, (SELECT p - 1 FROM sn WHERE sn.v = pr.u AND sn.x = pr.w) AS s,
  CASE WHEN EXISTS (SELECT 1 FROM co_a z WHERE z.src = pr.u AND z.dst = pr.w) THEN 1 ELSE 0 END AS theta FROM pr),
z AS (SELECT q.v AS id, sum(s) AS s, sum((du.d - 1 - s - theta) + (dw.d - 1 - s - theta) + s) AS pot FROM q JOIN dg du ON du.id = q.u JOIN dg dw ON dw.id = q.w GROUP BY q.v)
SELECT n.id, round(CASE WHEN pot > 0 THEN s / CAST(pot AS DOUBLE) ELSE 0 END, 6) AS value FROM co_n n LEFT JOIN z ON z.id = n.id""")(lambda g: local.square_clustering(g).select("id", "value"))
query("clustering_directed", "ut", """, s AS (SELECT src, dst, count(*) AS m FROM (SELECT src, dst FROM ut_e WHERE src <> dst UNION ALL SELECT dst, src FROM ut_e WHERE src <> dst) GROUP BY 1, 2),
k AS (SELECT src AS id, sum(m) AS dt, sum(CASE WHEN m = 2 THEN 1 ELSE 0 END) AS db FROM s GROUP BY src),
t AS (SELECT a.src AS id, sum(a.m * b.m * c.m) AS t FROM s a JOIN s b ON b.src = a.dst JOIN s c ON c.src = b.dst AND c.dst = a.src GROUP BY 1)
SELECT n.id, round(CASE WHEN t.t IS NOT NULL AND 2 * (dt * (dt - 1) - 2 * db) > 0 THEN CAST(t.t AS DOUBLE) / CAST(2 * (dt * (dt - 1) - 2 * db) AS DOUBLE) ELSE 0 END, 6) AS value
FROM ut_n n LEFT JOIN k USING (id) LEFT JOIN t USING (id)""")(lambda g: local.clustering(g).select("id", "value"))

# mixing
query("degree_assortativity", "ps", PS_DEG + " SELECT round(corr(x.value, y.value), 6) AS value FROM ps_a a JOIN d x ON x.id = a.src JOIN d y ON y.id = a.dst")(local.degree_assortativity)
query("numeric_assortativity", "dag", "SELECT round(corr(x.duration, y.duration), 6) AS value FROM dag_e e JOIN dag_n x ON x.id = e.src JOIN dag_n y ON y.id = e.dst")(lambda g: local.numeric_assortativity(g, "duration"))
query("attribute_assortativity", "co", """, m AS (SELECT x.c_nationkey AS a, y.c_nationkey AS b, CAST(count(*) AS DOUBLE) AS c FROM co_a e JOIN customer x ON x.c_custkey = e.src JOIN customer y ON y.c_custkey = e.dst GROUP BY 1, 2),
q AS (SELECT sum(r.s * k.s) / ((SELECT sum(c) FROM m) ** 2) AS q FROM (SELECT a AS v, sum(c) AS s FROM m GROUP BY 1) r JOIN (SELECT b AS v, sum(c) AS s FROM m GROUP BY 1) k ON r.v = k.v)
SELECT round(((SELECT sum(c) FROM m WHERE a = b) / (SELECT sum(c) FROM m) - q) / (1 - q), 6) AS value FROM q""")(lambda g: local.attribute_assortativity(g, "c_nationkey"))
query("mixing_matrix", "co", "SELECT CAST(x.c_nationkey AS BIGINT) AS a, CAST(y.c_nationkey AS BIGINT) AS b, count(*) AS count FROM co_a e JOIN customer x ON x.c_custkey = e.src JOIN customer y ON y.c_custkey = e.dst GROUP BY 1, 2")(lambda g: local.mixing_matrix(g, "c_nationkey"))
query("rich_club", "co", """, dg AS (SELECT n.id, count(a.src) AS d FROM co_n n LEFT JOIN co_a a ON a.src = n.id GROUP BY n.id), r AS (SELECT unnest(range(0, (SELECT max(d) + 1 FROM dg))) AS k),
v AS (SELECT k, (SELECT count(*) FROM dg WHERE d > k) AS n, (SELECT count(*) FROM co_e e JOIN dg x ON x.id = e.src JOIN dg y ON y.id = e.dst WHERE least(x.d, y.d) > k) AS m FROM r)
SELECT k AS degree, round(2.0 * m / (n * (n - 1)), 6) AS value FROM v WHERE n > 1""")(local.rich_club)

# link prediction
HOP = ", h AS (SELECT a.dst AS u, b.dst AS v, a.src AS w FROM co_a a JOIN co_a b ON a.src = b.src AND a.dst < b.dst WHERE NOT EXISTS (SELECT 1 FROM co_e e WHERE e.src = a.dst AND e.dst = b.dst)), dg AS (SELECT src AS id, count(*) AS d FROM co_a GROUP BY src)"
query("link_common_neighbors", "co", HOP + " SELECT u, v, count(*) AS value FROM h GROUP BY 1, 2")(local.common_neighbor_counts)
query("link_jaccard", "co", HOP + ", c AS (SELECT u, v, count(*) AS k FROM h GROUP BY 1, 2) SELECT u, v, round(k / CAST(x.d + y.d - k AS DOUBLE), 6) AS value FROM c JOIN dg x ON x.id = u JOIN dg y ON y.id = v")(local.jaccard)
query("link_adamic_adar", "co", HOP + " SELECT u, v, round(sum(1 / ln(d)), 6) AS value FROM h JOIN dg ON dg.id = w GROUP BY 1, 2")(local.adamic_adar)
query("link_resource_allocation", "co", HOP + " SELECT u, v, round(sum(1.0 / d), 6) AS value FROM h JOIN dg ON dg.id = w GROUP BY 1, 2")(local.resource_allocation)
query("link_preferential_attachment", "co", HOP + " SELECT u, v, x.d * y.d AS value FROM (SELECT DISTINCT u, v FROM h) JOIN dg x ON x.id = u JOIN dg y ON y.id = v")(lambda g: local.preferential_attachment(g, local.common_neighbor_counts(g).select("u", "v")))
query("predict_links", "co", HOP + ", s AS (SELECT u, v, sum(1.0 / d) AS value FROM h JOIN dg ON dg.id = w GROUP BY 1, 2) SELECT u, v, round(value, 6) AS value FROM s ORDER BY round(value, 9) DESC, u, v LIMIT 10")(
    lambda g: local.predict_links(g, "resource_allocation", 10)
)

# partitions, metrics
LAB = ", l AS (SELECT e.w, x.c_nationkey AS a, y.c_nationkey AS b FROM co_e e JOIN customer x ON x.c_custkey = e.src JOIN customer y ON y.c_custkey = e.dst)"


def _nations(g: Graph) -> DataFrame:
    return g.nodes.select("id", F.col("c_nationkey").alias("label"))


query("modularity", "co", LAB + ", k AS (SELECT v, CAST(sum(w) AS DOUBLE) AS k FROM (SELECT a AS v, w FROM l UNION ALL SELECT b, w FROM l) GROUP BY v), m AS (SELECT CAST(sum(w) AS DOUBLE) AS m FROM l) SELECT round((SELECT sum(w) FROM l WHERE a = b) / m - (SELECT sum(k * k) FROM k) / (4 * m * m), 6) AS value FROM m")(lambda g: local.modularity(g, _nations(g)))
query("partition_quality", "co", LAB + """, c AS (SELECT count(*) FILTER (a = b) AS inside, count(*) AS m FROM l), n AS (SELECT sum(k) AS n, sum(k * (k - 1) / 2) AS within FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey))
SELECT round(inside / CAST(m AS DOUBLE), 6) AS coverage, round(CAST(inside + n * (n - 1) / 2 - within - (m - inside) AS DOUBLE) / CAST(n * (n - 1) / 2 AS DOUBLE), 6) AS performance FROM c, n""")(lambda g: local.partition_quality(g, _nations(g)))
query("community_labels", "co", "SELECT c_custkey AS id, n AS label FROM customer JOIN (SELECT c_nationkey, row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)) - 1 AS n FROM customer GROUP BY c_nationkey) USING (c_nationkey)")(lambda g: local.community_labels(_nations(g)))
query("metric_rank", "ps", PS_DEG + " SELECT id, value, dense_rank() OVER (ORDER BY value DESC) AS rank FROM d")(lambda g: metrics.rank(g.degree()).select("id", "value", "rank"))
query("metric_describe", "ps", PS_DEG + " SELECT count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(CAST(min(value) AS DOUBLE), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(CAST(max(value) AS DOUBLE), 6) AS max FROM d")(lambda g: metrics.describe(g.degree()))
_NORM = {"max": "value / max(abs(value)) OVER ()", "sum": "value / sum(value) OVER ()", "minmax": "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())", "zscore": "(value - avg(value) OVER ()) / stddev_pop(value) OVER ()"}
for _how, _sql in _NORM.items():
    query(f"metric_normalize_{_how}", "ps", PS_DEG.replace("count(*) AS value", "CAST(count(*) AS DOUBLE) AS value") + f" SELECT id, round({_sql}, 6) AS value FROM d")(
        lambda g, how=_how: metrics.normalized(g.degree().withColumn("value", F.col("value").cast("double")), how).select("id", "value")
    )
query("histogram_bins", "ps", PS_DEG + ", s AS (SELECT CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM d), b AS (SELECT least(floor((value - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS count FROM d, s GROUP BY 1), r AS (SELECT unnest(range(0, 10)) AS bin) SELECT r.bin, round(lo + r.bin * ((hi - lo) / 10), 6) AS lo, round(lo + (r.bin + 1) * ((hi - lo) / 10), 6) AS hi, coalesce(b.count, 0) AS count FROM r, s LEFT JOIN b ON b.bin = r.bin")(
    lambda g: metrics.histogram(g.degree().withColumn("value", F.col("value").cast("double")))
)


@query("categorical_fold", None, "WITH c AS (SELECT p_brand AS category, count(*) AS count FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY count DESC, category) AS k FROM c) SELECT CASE WHEN k <= 7 THEN category ELSE 'Other' END AS category, CAST(sum(count) AS BIGINT) AS count FROM r GROUP BY 1")
def _fold(spark, sf_dir):
    return metrics.fold_categories(derived._t(spark, sf_dir, "part").select(F.col("p_brand").alias("category")))


# matrices
query("adjacency_coo", "co", "SELECT src AS i, dst AS j, CAST(w AS DOUBLE) AS value FROM co_a")(local.adjacency_coo)
DV = ", dv AS (SELECT src AS id, CAST(sum(w) AS DOUBLE) AS d FROM co_a GROUP BY src)"
query("laplacian_coo", "co", DV + " SELECT id AS i, id AS j, d AS value FROM dv UNION ALL SELECT src, dst, -CAST(w AS DOUBLE) FROM co_a")(lambda g: local.laplacian_coo(g, "w"))
query("normalized_laplacian_coo", "co", DV + " SELECT id AS i, id AS j, 1.0::DOUBLE AS value FROM dv UNION ALL SELECT src, dst, round(-w / sqrt(x.d * y.d), 6) FROM co_a JOIN dv x ON x.id = src JOIN dv y ON y.id = dst")(lambda g: local.laplacian_coo(g, "w", normalized=True))
query("incidence_coo", "co", "SELECT src AS node, src, dst, -1.0::DOUBLE AS value FROM co_e UNION ALL SELECT dst, src, dst, 1.0::DOUBLE FROM co_e")(lambda g: local.incidence_coo(g, oriented=True))
query("transition_coo", "co", DV + " SELECT src AS i, dst AS j, round(w / d, 6) AS value FROM co_a JOIN dv ON dv.id = src")(lambda g: local.transition_coo(g, "w"))
query("degree_vector", "co", DV + " SELECT n.id, coalesce(d, 0) AS value FROM co_n n LEFT JOIN dv ON dv.id = n.id")(lambda g: local.degree_vector(g, "w").select("id", "value"))


# traversal and components


def _first(g: Graph) -> DataFrame:
    return g.nodes.agg(F.min("id").alias("id"))


BFS = ", b AS (SELECT min(id) AS id, 0 AS depth FROM {g}_n UNION SELECT a.dst, b.depth + 1 FROM b JOIN {a} a ON a.src = b.id WHERE b.depth < 12), r AS (SELECT id, min(depth) AS depth FROM b GROUP BY id)"
query("bfs_distances", "ps", BFS.format(g="ps", a="ps_a") + " SELECT id, CAST(depth AS BIGINT) AS depth FROM r")(lambda g: iterate.bfs(g, _first(g)).select("id", "depth"))
query("bfs_layers", "ut", BFS.format(g="ut", a="ut_e") + " SELECT CAST(depth AS BIGINT) AS depth, count(*) AS nodes FROM r GROUP BY depth")(lambda g: iterate.bfs_layers(g, _first(g)).select("depth", F.size("nodes").alias("nodes")))
query("bfs_tree", "ut", BFS.format(g="ut", a="ut_e") + " SELECT min(p.id) AS src, r.id AS dst FROM r JOIN ut_e e ON e.dst = r.id JOIN r p ON p.id = e.src AND p.depth = r.depth - 1 GROUP BY r.id")(lambda g: iterate.bfs_tree(g, _first(g)).select("src", "dst"))
query("descendants", "dag", ", r AS (SELECT 1 AS id UNION SELECT e.dst FROM r JOIN dag_e e ON e.src = r.id) SELECT CAST(id AS BIGINT) AS id FROM r WHERE id <> 1")(lambda g: iterate.descendants(g, 1))
query("ancestors", "dag", ", r AS (SELECT max(id) AS id FROM dag_n UNION SELECT e.src FROM r JOIN dag_e e ON e.dst = r.id) SELECT id FROM r WHERE id <> (SELECT max(id) FROM dag_n)")(lambda g: iterate.ancestors(g, g.nodes.agg(F.max("id")).first()[0]))
CC = ", r AS (SELECT id AS src, id AS dst FROM {g}_n UNION SELECT r.src, a.dst FROM r JOIN {a} a ON a.src = r.dst), c AS (SELECT src AS id, min(dst) AS root FROM r GROUP BY src)"
query("weak_components", "co", CC.format(g="co", a="co_a") + " SELECT id, root FROM c")(iterate.weak_components)
query("component_sizes", "co", CC.format(g="co", a="co_a") + " SELECT root, count(*) AS size FROM c GROUP BY root")(iterate.connected_components)
query("strong_components", "ut", ", r AS (SELECT id AS src, id AS dst FROM ut_n UNION SELECT r.src, e.dst FROM r JOIN ut_e e ON e.src = r.dst) SELECT a.src AS id, min(a.dst) AS root FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")(iterate.strong_components)
query("bipartite_sets", "ps", "SELECT id, CAST(id >= 1000000 AS BIGINT) AS side FROM ps_n")(
    lambda g: iterate.bipartite_sets(derived.apart(g)).select(F.when(F.col("id") < 0, F.bitwise_not("id")).otherwise(F.col("id")).alias("id"), "side")
)

# shortest paths
SP = ", sp AS (SELECT min(id) AS id, 0::DOUBLE AS d, 0 AS k FROM co_n UNION SELECT id, min(d), k FROM (SELECT a.dst AS id, sp.d + a.w AS d, sp.k + 1 AS k FROM sp JOIN co_a a ON a.src = sp.id WHERE sp.k < 60) GROUP BY id, k), r AS (SELECT id, min(d) AS dist FROM sp GROUP BY id)"
query("sssp", "co", SP + " SELECT id, dist FROM r")(lambda g: iterate.sssp(g, _first(g), "w").select("id", "dist"))

# iterations of a fixed number, unrolled by recursion
N = "(SELECT count(*) FROM {g}_n)"
query("pagerank", "ut", """, o AS (SELECT src, count(*) AS s FROM ut_e GROUP BY src), m AS (SELECT e.src, e.dst, 1.0 / o.s AS w FROM ut_e e JOIN o USING (src) UNION ALL SELECT n.id, z.id, 1.0 / (SELECT count(*) FROM ut_n) FROM ut_n n, ut_n z WHERE n.id NOT IN (SELECT src FROM o)),
p AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ut_n) AS value, 0 AS k FROM ut_n UNION ALL SELECT m.dst, 0.85 * sum(p.value * m.w) + 0.15 / (SELECT count(*) FROM ut_n), k + 1 FROM p JOIN (SELECT * FROM m UNION ALL SELECT id, id, 0 FROM ut_n) m ON m.src = p.id WHERE k < 10 GROUP BY m.dst, k)
SELECT id, round(value, 6) AS value FROM p WHERE k = 10""")(lambda g: iterate.pagerank(g, max_iter=10, tol=None))
query("katz", "co", ", p AS (SELECT id, 0::DOUBLE AS value, 0 AS k FROM co_n UNION ALL SELECT m.dst, 0.01 * sum(p.value * m.w) + 1, k + 1 FROM p JOIN (SELECT src, dst, 1 AS w FROM co_a UNION ALL SELECT id, id, 0 FROM co_n) m ON m.src = p.id WHERE k < 8 GROUP BY m.dst, k) SELECT id, round(value / sqrt(sum(value * value) OVER ()), 6) AS value FROM p WHERE k = 8")(lambda g: iterate.katz_centrality(g, alpha=0.01, max_iter=8, tol=None))
query("eigenvector", "co", ", p AS (SELECT id, 1::DOUBLE AS value, 0 AS k FROM co_n UNION ALL SELECT m.dst, sum(p.value * m.w), k + 1 FROM p JOIN (SELECT src, dst, 1 AS w FROM co_a UNION ALL SELECT id, id, 1 FROM co_n) m ON m.src = p.id WHERE k < 12 GROUP BY m.dst, k) SELECT id, round(value / sqrt(sum(value * value) OVER ()), 6) AS value FROM p WHERE k = 12")(lambda g: iterate.eigenvector_centrality(g, max_iter=12, tol=None))
query("hits", "ut", """, p AS (SELECT id, 1::DOUBLE AS value, 0 AS k FROM ut_n UNION ALL SELECT m.dst, sum(p.value * m.w), k + 1 FROM p JOIN (
  SELECT 1 AS up, src, dst, 1 AS w FROM ut_e UNION ALL SELECT 1, id, id, 0 FROM ut_n UNION ALL SELECT 0, dst, src, 1 FROM ut_e UNION ALL SELECT 0, id, id, 0 FROM ut_n) m ON m.src = p.id AND m.up = (p.k + 1) % 2 WHERE k < 16 GROUP BY m.dst, k)
SELECT a.id, round(a.value / sum(a.value) OVER (), 6) AS hub, round(b.value / sum(b.value) OVER (), 6) AS authority FROM p a JOIN p b ON a.id = b.id AND a.k = 16 AND b.k = 15""")(lambda g: iterate.hits(g, max_iter=8, tol=None))

# acyclic graphs
LV = ", lv AS (SELECT id, 0 AS level FROM dag_n UNION SELECT e.dst, lv.level + 1 FROM lv JOIN dag_e e ON e.src = lv.id), v AS (SELECT id, max(level) AS level FROM lv GROUP BY id)"
query("dag_levels", "dag", LV + " SELECT id, CAST(level AS BIGINT) AS level FROM v")(lambda g: iterate.dag_levels(g).select("id", "level"))
query("dag_generations", "dag", LV + " SELECT CAST(level AS BIGINT) AS level, count(*) AS nodes FROM v GROUP BY level")(lambda g: iterate.dag_levels(g).groupBy("level").agg(F.count("*").alias("nodes")))
query("topological_order", "dag", LV + " SELECT id, row_number() OVER (ORDER BY level, id) - 1 AS position FROM v")(iterate.topological_order)
query("longest_path_length", "dag", LV + " SELECT CAST(max(level) AS DOUBLE) AS length FROM v")(lambda g: iterate.longest_path_lengths(g).agg(F.max("best").alias("length")))
query("critical_path", "dag", """, f AS (SELECT id, duration AS ef FROM dag_n UNION SELECT e.dst, f.ef + n.duration FROM f JOIN dag_e e ON e.src = f.id JOIN dag_n n ON n.id = e.dst), ef AS (SELECT id, max(ef) AS ef FROM f GROUP BY id),
t AS (SELECT id, duration AS tl FROM dag_n UNION SELECT e.src, t.tl + n.duration FROM t JOIN dag_e e ON e.dst = t.id JOIN dag_n n ON n.id = e.src), tl AS (SELECT id, max(tl) AS tl FROM t GROUP BY id), s AS (SELECT max(ef) AS span FROM ef)
SELECT n.id, ef - duration AS es, ef, span - tl AS ls, span - tl + duration AS lf, span - tl - ef + duration AS slack, span - tl - ef + duration = 0 AS critical FROM dag_n n JOIN ef USING (id) JOIN tl USING (id), s""")(iterate.critical_path)
TC = ", tc AS (SELECT src, dst FROM dag_e UNION SELECT tc.src, e.dst FROM tc JOIN dag_e e ON e.src = tc.dst)"
query("transitive_closure", "dag", TC + " SELECT src, dst FROM tc")(iterate.transitive_closure)
query("transitive_reduction", "dag", TC + " SELECT src, dst FROM dag_e e WHERE NOT EXISTS (SELECT 1 FROM dag_e x JOIN tc ON tc.src = x.dst WHERE x.src = e.src AND tc.dst = e.dst)")(iterate.transitive_reduction)

# peeling, forests, matchings, dynamics: SQL checks their defining property or replays their steps
query("mst_weight", "co", None)(lambda g: iterate.spanning_edges(g, "w").agg(F.count("*").alias("edges"), F.sum("w").alias("weight")))
query("maximum_spanning_weight", "co", None)(lambda g: iterate.spanning_edges(g, "w", maximum=True).agg(F.count("*").alias("edges"), F.sum("w").alias("weight")))
query("core_number", "co", None)(lambda g: iterate.core_number(g).select("id", "value"))
query("onion_layers", "co", None)(lambda g: iterate.onion_layers(g).select("id", "value"))
query("maximal_matching", "co", None)(iterate.maximal_matching)
query("greedy_color", "co", None)(iterate.greedy_color)
query("label_propagation", "uu", None)(iterate.label_propagation)
query("heat_steps", "co", ", x AS (SELECT id, CASE WHEN id = (SELECT min(id) FROM co_n) THEN 1.0::DOUBLE ELSE 0 END AS value, 0 AS k FROM co_n UNION ALL SELECT m.dst, sum(x.value * m.w), k + 1 FROM x JOIN (SELECT src, dst, 0.01 AS w FROM co_a UNION ALL SELECT n.id, n.id, 1 - 0.01 * (SELECT count(*) FROM co_a WHERE src = n.id) FROM co_n n) m ON m.src = x.id WHERE k < 6 GROUP BY m.dst, k) SELECT id, round(value, 6) AS value FROM x WHERE k = 6")(
    lambda g: iterate.heat_steps(g, g.nodes.crossJoin(_first(g).withColumnRenamed("id", "f")).select("id", (F.col("id") == F.col("f")).cast("double").alias("value")), 0.01, 6)
)
query("degroot_steps", "co", ", x AS (SELECT id, CAST(id % 10 AS DOUBLE) AS value, 0 AS k FROM co_n UNION ALL SELECT m.dst, sum(x.value * m.w) / sum(m.w), k + 1 FROM x JOIN (SELECT src, dst, 1::DOUBLE AS w FROM co_a UNION ALL SELECT id, id, 1 FROM co_n) m ON m.src = x.id WHERE k < 5 GROUP BY m.dst, k) SELECT id, round(value, 6) AS value FROM x WHERE k = 5")(
    lambda g: iterate.degroot(g, g.nodes.select("id", (F.col("id") % 10).cast("double").alias("value")), 5)
)

# searches from every source
from lattica.operators import kernels  # noqa: E402
from lattica.plans import sources  # noqa: E402

AP = ", ap AS (SELECT id AS s, id AS t, 0 AS d FROM uu_n UNION SELECT s, dst, d + 1 FROM ap JOIN uu_a ON t = src WHERE d < 9), p AS (SELECT s, t, min(d) AS d FROM ap GROUP BY 1, 2)"
query("all_pairs", "uu", AP + " SELECT s AS src, t AS dst, CAST(d AS DOUBLE) AS dist FROM p")(sources.all_pairs)
query("closeness", "uu", AP + " SELECT t AS id, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1.0) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM uu_n) - 1) ELSE 0 END, 6) AS value FROM p GROUP BY t")(lambda g: sources.closeness_centrality(g).select("id", "value"))
query("harmonic", "uu", AP + " SELECT t AS id, round(coalesce(sum(CASE WHEN d > 0 THEN 1.0 / d END), 0), 6) AS value FROM p GROUP BY t")(lambda g: sources.harmonic_centrality(g).select("id", "value"))
query("wiener", "uu", AP + " SELECT CAST(sum(d) AS DOUBLE) / 2 AS value FROM p")(sources.wiener_index)
query("average_path_length", "uu", AP + " SELECT round(sum(d) / CAST((SELECT count(*) * (count(*) - 1) FROM uu_n) AS DOUBLE), 6) AS value FROM p")(sources.average_shortest_path_length)
query("global_efficiency", "uu", AP + " SELECT round(sum(CASE WHEN d > 0 THEN 1.0 / d END) / (SELECT count(*) * (count(*) - 1) FROM uu_n), 6) AS value FROM p")(sources.global_efficiency)
query("eccentricity", "uu", AP + " SELECT s AS id, CAST(max(d) AS DOUBLE) AS value FROM p GROUP BY s")(lambda g: sources.eccentricity(g).select("id", "value"))
query("center", "uu", AP + ", e AS (SELECT s AS id, max(d) AS value FROM p GROUP BY s) SELECT id, CAST(value AS DOUBLE) AS value FROM e WHERE value = (SELECT min(value) FROM e)")(lambda g: sources.center(g).select("id", "value"))
query("periphery", "uu", AP + ", e AS (SELECT s AS id, max(d) AS value FROM p GROUP BY s) SELECT id, CAST(value AS DOUBLE) AS value FROM e WHERE value = (SELECT max(value) FROM e)")(lambda g: sources.periphery(g).select("id", "value"))
BC = AP + """, sg AS (SELECT id AS s, id AS t, 0 AS d, 1::DOUBLE AS c FROM uu_n UNION ALL SELECT x.s, x.t, x.d, sum(x.c) FROM (SELECT g.s, a.dst AS t, g.d + 1 AS d, g.c FROM sg g JOIN uu_a a ON a.src = g.t WHERE g.d < 9) x JOIN p ON p.s = x.s AND p.t = x.t AND p.d = x.d GROUP BY 1, 2, 3),
bw AS (SELECT a.t AS id, sum(a.c * b.c / z.c) AS v FROM sg a JOIN sg b ON b.s = a.t JOIN sg z ON z.s = a.s AND z.t = b.t AND z.d = a.d + b.d WHERE a.s <> a.t AND b.s <> b.t GROUP BY a.t)"""
query("betweenness", "uu", BC + " SELECT n.id, round(coalesce(v, 0) / (SELECT (count(*) - 1.0) * (count(*) - 2) FROM uu_n), 6) AS value FROM uu_n n LEFT JOIN bw USING (id)")(lambda g: sources.betweenness_centrality(g).select("id", "value"))
query("edge_betweenness", "uu", BC + ", eb AS (SELECT e.src, e.dst, sum(a.c * b.c / z.c) AS v FROM uu_e e JOIN uu_a q ON (q.src = e.src AND q.dst = e.dst) OR (q.src = e.dst AND q.dst = e.src) JOIN sg a ON a.t = q.src JOIN sg b ON b.s = q.dst JOIN sg z ON z.s = a.s AND z.t = b.t AND z.d = a.d + 1 + b.d GROUP BY 1, 2) SELECT src, dst, round(v / (SELECT count(*) * (count(*) - 1.0) FROM uu_n), 6) AS value FROM eb")(sources.edge_betweenness_centrality)
query("local_efficiency", "uu", None)(sources.local_efficiency)
query("simple_paths", "dag", ", r AS (SELECT CAST(1 AS BIGINT) AS id, [CAST(1 AS BIGINT)] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM r JOIN dag_e e ON e.src = r.id WHERE len(path) <= 3) SELECT array_to_string(path, ',') AS path FROM r WHERE id = (SELECT max(dst) FROM dag_e WHERE src = 1)")(
    lambda g: iterate.simple_paths(g, 1, g.edges.where("src = 1").agg(F.max("dst")).first()[0], 3).select(F.array_join("path", ",").alias("path"))
)

# walks in sequence, one component a task
query("dfs_orders", "ut", None)(kernels.dfs_orders)
query("bridges", "co", None)(kernels.bridges)
query("articulation_points", "co", None)(kernels.articulation_points)
query("biconnected_sizes", "co", None)(lambda g: kernels.biconnected_components(g).select(F.size("nodes").alias("size")).groupBy("size").agg(F.count("*").alias("count")))
query("hopcroft_karp_size", "ps", "SELECT least((SELECT count(DISTINCT src) FROM ps_e), (SELECT count(DISTINCT dst) FROM ps_e)) AS size")(lambda g: kernels.hopcroft_karp(derived.apart(g)).agg(F.count("*").alias("size")))
query("max_flow_value", "dag", "SELECT CAST(count(*) AS DOUBLE) AS value FROM dag_e a JOIN dag_e b ON b.src = a.dst WHERE a.src = 1 AND b.dst = (SELECT max(dst) FROM dag_e)")(
    lambda g: kernels.maximum_flow(Graph(g.nodes, g.edges.withColumn("capacity", F.lit(1.0)), True), 1, g.edges.agg(F.max("dst")).first()[0]).where("kind = 'value'").select("value")
)
query("dag_width", "dag", "SELECT count(*) AS width FROM part")(kernels.dag_width)
query("louvain", "co", None)(kernels.louvain_communities)
query("async_label_propagation", "co", None)(kernels.async_label_propagation)
query("greedy_modularity", "co", None)(kernels.greedy_modularity_communities)
query("laplacian_spectrum", "uu", None)(lambda g: kernels.spectrum(g, laplacian=True))

# generated families
from lattica.operators import simulate  # noqa: E402
from lattica.sources import generators as gen  # noqa: E402

_FAMILIES = {
    "path": (lambda s: gen.path_graph(s, 50), "SELECT i AS src, i + 1 AS dst FROM range(0, 49) t(i)"),
    "cycle": (lambda s: gen.cycle_graph(s, 50, directed=True), "SELECT i AS src, (i + 1) % 50 AS dst FROM range(0, 50) t(i)"),
    "complete": (lambda s: gen.complete_graph(s, 20), "SELECT a.i AS src, b.i AS dst FROM range(0, 20) a(i) JOIN range(0, 20) b(i) ON a.i < b.i"),
    "complete_bipartite": (lambda s: gen.complete_bipartite_graph(s, 4, 6), "SELECT a.i AS src, b.i AS dst FROM range(0, 4) a(i), range(4, 10) b(i)"),
    "star": (lambda s: gen.star_graph(s, 12), "SELECT 0::BIGINT AS src, i AS dst FROM range(1, 13) t(i)"),
    "wheel": (lambda s: gen.wheel_graph(s, 8), "SELECT 0::BIGINT AS src, i AS dst FROM range(1, 8) t(i) UNION ALL SELECT least(i, i % 7 + 1), greatest(i, i % 7 + 1) FROM range(1, 8) t(i)"),
    "grid": (lambda s: gen.grid_graph(s, 6, 7), "SELECT i AS src, i + 1 AS dst FROM range(0, 42) t(i) WHERE i % 7 < 6 UNION ALL SELECT i, i + 7 FROM range(0, 35) t(i)"),
    "hypercube": (lambda s: gen.hypercube_graph(s, 5), "SELECT i AS src, i | (1 << k) AS dst FROM range(0, 32) t(i), range(0, 5) b(k) WHERE (i & (1 << k)) = 0"),
    "balanced_tree": (lambda s: gen.balanced_tree(s, 3, 4), "SELECT (i - 1) // 3 AS src, i AS dst FROM range(1, 121) t(i)"),
    "binomial_tree": (lambda s: gen.binomial_tree(s, 6), "SELECT i & (i - 1) AS src, i AS dst FROM range(1, 64) t(i)"),
    "ladder": (lambda s: gen.ladder_graph(s, 9), "SELECT i AS src, i + 1 AS dst FROM range(0, 8) t(i) UNION ALL SELECT i + 9, i + 10 FROM range(0, 8) t(i) UNION ALL SELECT i, i + 9 FROM range(0, 9) t(i)"),
    "turan": (lambda s: gen.turan_graph(s, 11, 3), "WITH n AS (SELECT i, CASE WHEN i < 3 THEN 0 WHEN i < 7 THEN 1 ELSE 2 END AS p FROM range(0, 11) t(i)) SELECT a.i AS src, b.i AS dst FROM n a JOIN n b ON a.p < b.p"),
}


def _family(name: str, make, sql: str) -> None:
    query(f"generate_{name}", None, sql)(lambda spark, _: make(spark).edges.select("src", "dst"))


for _name, (_make_graph, _family_sql) in _FAMILIES.items():
    _family(_name, _make_graph, _family_sql)
query("generate_erdos_renyi", None, None)(lambda spark, _: gen.erdos_renyi(spark, 200, 0.05, seed=1).edges.select("src", "dst"))
query("generate_random_geometric", None, None)(lambda spark, _: gen.random_geometric(spark, 300, 0.1, seed=1).edges.select("src", "dst"))

# simulations
query("sir_ensemble", "co", None)(lambda g: simulate.ensemble(simulate.epidemic(g, "SIR", {"beta": 0.1, "gamma": 0.2}, [1], 20, runs=40)))
query("influence_spread", "co", None)(lambda g: simulate.influence_spread(g, [1, 2], runs=200))
query("random_walk_visits", "co", None)(lambda g: simulate.random_walks(g, 40, 200, restart=0.1))
query("stationary_distribution", "co", "SELECT src AS id, round(count(*) / CAST((SELECT count(*) FROM co_a) AS DOUBLE), 6) AS value FROM co_a GROUP BY src")(simulate.stationary_distribution)
query("majority_steps", "co", """, x AS (SELECT id, id % 2 AS state, 0 AS k FROM co_n UNION ALL SELECT v.id, CASE WHEN max(v.a) > max(v.b) THEN 0 WHEN max(v.b) > max(v.a) THEN 1 ELSE max(v.own) END, v.k + 1 FROM (
  SELECT m.dst AS id, x.k, sum(CASE WHEN m.e AND x.state = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN m.e AND x.state = 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN NOT m.e THEN x.state ELSE 0 END) AS own
  FROM x JOIN (SELECT src, dst, true AS e FROM co_a UNION ALL SELECT id, id, false FROM co_n) m ON m.src = x.id WHERE x.k < 4 GROUP BY m.dst, x.k) v GROUP BY v.id, v.k)
SELECT id, CAST(state AS BIGINT) AS state FROM x WHERE k = 4""")(lambda g: iterate.majority_rule(g, g.nodes.select("id", (F.col("id") % 2).alias("state")), 4))
query("monte_carlo_schedule", "dag", None)(lambda g: simulate.monte_carlo_schedule(Graph(g.nodes.withColumns({"min": F.col("duration") * 0.5, "mode": F.col("duration"), "max": F.col("duration") * 2}), g.edges, True), runs=100).agg(F.avg("makespan").alias("mean"), F.stddev_samp("makespan").alias("std")))
