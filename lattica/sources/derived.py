"""Graphs derived from the star schema's tables, by rules that hold at every scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.model import Graph


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def part_supplier(spark, sf_dir) -> Graph:
    """Undirected, bipartite: parts and the suppliers (their keys plus 1,000,000) that ship them.

    Part keys from 1,000,000 on share ids with suppliers. An edge therefore always leads from the part to the supplier, and
    is no other one's opposite; where ids are shared the graph has loops and odd cycles.
    """
    e = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct()
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return Graph(n.withColumn("ord", F.col("id")), e.withColumn("ord", F.struct("src", "dst")), False)


def apart(g: Graph) -> Graph:
    """part_supplier with ids that no part shares with a supplier: a part's is negative, -1 less its key; parts come first."""
    e = g.edges.select(F.bitwise_not("src").alias("src"), "dst")
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return Graph(n.withColumn("ord", F.col("id")), e.withColumn("ord", F.struct("src", "dst")), False)


def customer_supplier(spark, sf_dir) -> Graph:
    li, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    return Graph.from_edges(e)


def _pairs(spark, sf_dir, key: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col(key).alias("k"))
    return li.select("l_orderkey", F.col("k").alias("src")).join(li.select("l_orderkey", F.col("k").alias("dst")), "l_orderkey").where("src < dst")


def supplier_pairs(spark, sf_dir) -> Graph:
    """Undirected, weighted: suppliers in one order, by the pairs of lines."""
    e = _pairs(spark, sf_dir, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("w"))
    return Graph(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), "s_nationkey"), e.withColumn("ord", F.struct("src", "dst")), False)


def customer_succession(spark, sf_dir) -> Graph:
    """Undirected, weighted: customers whose orders follow each other on a day; all customers are nodes.

    A weight grows by one and by the ten thousands that the two orders' prices differ.
    """
    day = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("src"), F.lead("o_custkey").over(day).alias("dst"), (1 + F.floor(F.abs(F.col("o_totalprice") - F.lead("o_totalprice").over(day)) / 10000)).alias("w")
    )
    e = o.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
    n = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), "c_nationkey")
    return Graph(n, e.withColumn("ord", F.struct("src", "dst")), False)


def user_contacts(spark, sf_dir) -> Graph:
    """Undirected: user_handover without directions and loops."""
    g = user_handover(spark, sf_dir).to_undirected()
    return Graph(g.nodes, g.edges.where("src <> dst"), False)


def supply_chain(spark, sf_dir) -> Graph:
    """Directed, acyclic: regions, their nations, the nations' suppliers, the parts these ship; a region's suppliers, too.

    Keys are set apart by an offset for each table. A part lasts its size, a supplier one to ten, the others one.
    """
    region, nation = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    supplier, part = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "part")
    r, n = lambda c: (F.col(c) + 1).cast("long"), lambda c: (F.col(c) + 1000).cast("long")
    s, p = lambda c: (F.col(c) + 1000000).cast("long"), lambda c: (F.col(c) + 1000000000).cast("long")
    home = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    e = nation.select(r("n_regionkey").alias("src"), n("n_nationkey").alias("dst")).union(home.select(n("s_nationkey"), s("s_suppkey"))).union(home.select(r("n_regionkey"), s("s_suppkey")))
    e = e.union(_t(spark, sf_dir, "lineitem").select(s("l_suppkey"), p("l_partkey")).distinct())
    one = F.lit(1.0).alias("duration")
    v = region.select(r("r_regionkey").alias("id"), one).union(nation.select(n("n_nationkey"), one))
    v = v.union(supplier.select(s("s_suppkey"), (F.col("s_suppkey") % 10 + 1).cast("double"))).union(part.select(p("p_partkey"), F.col("p_size").cast("double")))
    return Graph(v.withColumn("ord", F.col("id")), e.withColumn("ord", F.struct("src", "dst")), True)


def part_pairs(spark, sf_dir) -> Graph:
    """Directed, acyclic: parts in one order, from the smaller key to the larger."""
    return Graph.from_edges(_pairs(spark, sf_dir, "l_partkey").select("src", "dst"), directed=True)


def user_handover(spark, sf_dir) -> Graph:
    """Directed, with loops and cycles: from an event's user to the next event's of the same day."""
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst")).where("dst is not null")
    return Graph.from_edges(e, directed=True)


#: The same graphs for DuckDB, as common table expressions; the names end in _e.
SQL = {
    "ps": "ps_e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem)",
    "cs": "cs_e AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 1000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "ss": "ss_e AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)",
    "pd": "pd_e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)",
    "ut": "ut_e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)",
}
SQL["co"] = """co_x AS (SELECT o_custkey AS src, lead(o_custkey) OVER d AS dst, 1 + CAST(floor(abs(o_totalprice - lead(o_totalprice) OVER d) / 10000) AS BIGINT) AS w FROM orders WINDOW d AS (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey)),
co_e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(w) AS BIGINT) AS w FROM co_x WHERE src <> dst GROUP BY 1, 2), co_n AS (SELECT c_custkey AS id FROM customer), co_a AS (SELECT src, dst, w FROM co_e UNION ALL SELECT dst, src, w FROM co_e)"""
SQL["dag"] = """dag_e AS (SELECT CAST(n_regionkey + 1 AS BIGINT) AS src, CAST(n_nationkey + 1000 AS BIGINT) AS dst FROM nation UNION ALL SELECT s_nationkey + 1000, s_suppkey + 1000000 FROM supplier UNION ALL SELECT n_regionkey + 1, s_suppkey + 1000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT DISTINCT l_suppkey + 1000000, l_partkey + 1000000000 FROM lineitem),
dag_n AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 1::DOUBLE AS duration FROM region UNION ALL SELECT n_nationkey + 1000, 1 FROM nation UNION ALL SELECT s_suppkey + 1000000, s_suppkey % 10 + 1 FROM supplier UNION ALL SELECT p_partkey + 1000000000, p_size FROM part)"""
SQL["ps"] += ", ps_n AS (SELECT src AS id FROM ps_e UNION SELECT dst FROM ps_e), ps_a AS (SELECT src, dst FROM ps_e UNION ALL SELECT dst, src FROM ps_e)"
SQL["ut"] += ", ut_n AS (SELECT src AS id FROM ut_e UNION SELECT dst FROM ut_e)"
SQL["uu"] = SQL["ut"] + ", uu_e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ut_e WHERE src <> dst), uu_n AS (SELECT id FROM ut_n), uu_a AS (SELECT src, dst FROM uu_e UNION ALL SELECT dst, src FROM uu_e)"
