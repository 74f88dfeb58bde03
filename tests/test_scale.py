"""Queries that once met a limit of the driver or of a task on larger tables."""

import pytest
from pyspark.sql import DataFrame

from lattica.plans import registry_more  # noqa: F401
from lattica.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
#: Every nation has suppliers, as the SQL of the widths takes for granted.
FULL = "/root/testdata/sf0.01"


@pytest.fixture
def lean(monkeypatch):
    """A driver that takes no table: toPandas() fails, and so does a collect() of more than 50 rows."""
    def few(df, take=DataFrame.collect):
        rows = take(df.limit(51))
        assert len(rows) <= 50, "rows in the driver"
        return rows

    def none(df):
        raise AssertionError("a table in the driver")

    from pyspark.sql.classic.dataframe import DataFrame as Classic

    monkeypatch.setattr(Classic, "collect", lambda df, take=Classic.collect: few(df, take))
    monkeypatch.setattr(Classic, "toPandas", none)


@pytest.fixture
def own_arcs(spark, monkeypatch):
    """As many arcs as supply_chain has: its closure, in both directions, is beyond the limit."""
    from lattica.sources import derived

    monkeypatch.setattr("lattica.plans.sources.ARC_LIMIT", derived.supply_chain(spark, FULL).count_edges())


@pytest.fixture
def shared_ids(spark, tmp_path):
    """Parts whose keys are ids of suppliers, too: a loop and a triangle if they were one node."""
    rows = [(5, 1), (5, 2), (1000001, 1), (1000001, 2), (1000002, 2)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def told(name, data=DATA):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return sorted(c.execute(ORACLE[name]).fetchall())


def test_monte_carlo_schedule_leaves_the_arcs_with_the_tasks(spark, lean):
    row = QUERIES["monte_carlo_schedule"](spark, DATA).first()
    assert row["mean"] > 0 and row["std"] > 0


def test_schedule_percentiles_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["schedule_percentiles"](spark, DATA).collect())) == told("schedule_percentiles")


def test_schedule_facts_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["schedule_facts"](spark, DATA).collect())) == told("schedule_facts")


def test_schedule_many_workers_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["schedule_many_workers"](spark, DATA).collect())) == told("schedule_many_workers")


def test_schedule_one_worker_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["schedule_one_worker"](spark, DATA).collect())) == told("schedule_one_worker")


def test_hopcroft_karp_size_needs_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    assert sorted(map(tuple, QUERIES["hopcroft_karp_size"](spark, DATA).collect())) == told("hopcroft_karp_size")


def test_hopcroft_karp_size_tells_parts_from_suppliers(spark, shared_ids):
    assert [tuple(r) for r in QUERIES["hopcroft_karp_size"](spark, shared_ids).collect()] == [(2,)]


def test_bipartite_sets_tells_parts_from_suppliers(spark, shared_ids):
    """A key that is a part's and a supplier's has a row on each side."""
    rows = sorted(map(tuple, QUERIES["bipartite_sets"](spark, shared_ids).collect()))
    assert rows == [(5, 0), (1000001, 0), (1000001, 1), (1000002, 0), (1000002, 1)]


def test_bipartite_sets_beyond_a_task(spark, monkeypatch):
    from lattica.errors import GraphError
    from lattica.plans import iterate
    from lattica.sources import generators as gen

    for limit in (100, 1):
        monkeypatch.setattr("lattica.plans.sources.ARC_LIMIT", limit)
        rows = {r.id: r.side for r in iterate.bipartite_sets(gen.cycle_graph(spark, 6)).collect()}
        assert rows == {n: n % 2 for n in range(6)}
        with pytest.raises(GraphError, match="an odd cycle passes [0-4] - [0-4]"):
            iterate.bipartite_sets(gen.cycle_graph(spark, 5))


def test_max_flow_value_needs_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 300)
    assert sorted(map(tuple, QUERIES["max_flow_value"](spark, DATA).collect())) == told("max_flow_value")


def test_dag_width_needs_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    assert sorted(map(tuple, QUERIES["dag_width"](spark, FULL).collect())) == told("dag_width", FULL)


def test_dag_width_needs_no_closure(spark, own_arcs):
    assert sorted(map(tuple, QUERIES["dag_width"](spark, FULL).collect())) == told("dag_width", FULL)


def test_maximum_antichain_needs_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    assert sorted(map(tuple, QUERIES["maximum_antichain"](spark, FULL).collect())) == told("maximum_antichain", FULL)


def test_maximum_antichain_needs_no_closure(spark, own_arcs):
    assert sorted(map(tuple, QUERIES["maximum_antichain"](spark, FULL).collect())) == told("maximum_antichain", FULL)


def test_minimum_chain_partition_needs_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    assert sorted(map(tuple, QUERIES["minimum_chain_partition"](spark, FULL).collect())) == told("minimum_chain_partition", FULL)


def test_minimum_chain_partition_needs_no_closure(spark, own_arcs):
    assert sorted(map(tuple, QUERIES["minimum_chain_partition"](spark, FULL).collect())) == told("minimum_chain_partition", FULL)


def test_dfs_tree_needs_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    assert sorted(map(tuple, QUERIES["dfs_tree"](spark, DATA).collect())) == told("dfs_tree")


def test_bridges_need_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    assert sorted(map(tuple, QUERIES["block_bridges"](spark, DATA).collect())) == told("block_bridges")


def test_astar_path_needs_no_component_in_a_task(spark, monkeypatch):
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    assert sorted(map(tuple, QUERIES["astar_path"](spark, DATA).collect())) == told("astar_path")


def test_shared_ids_of_parts_and_suppliers_keep_all_edges(spark, tmp_path):
    """Part 1,000,001 with supplier 2 and part 1,000,002 with supplier 1 are two edges, as in the SQL."""
    from lattica.sources import derived

    spark.createDataFrame([(1000001, 2), (1000002, 1), (1000001, 2)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = derived.part_supplier(spark, str(tmp_path))
    assert sorted((r["id"], r["value"]) for r in g.degree().collect()) == [(1000001, 2), (1000002, 2)]


def test_closeness_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["closeness"](spark, DATA).collect())) == told("closeness")


def test_eccentricity_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["eccentricity"](spark, DATA).collect())) == told("eccentricity")


def test_periphery_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["periphery"](spark, DATA).collect())) == told("periphery")


def test_average_path_length_without_arcs_in_the_driver(spark, lean):
    assert sorted(map(tuple, QUERIES["average_path_length"](spark, DATA).collect())) == told("average_path_length")


def test_betweenness_all_sources_without_arcs_in_the_driver(spark, lean):
    assert QUERIES["betweenness_all_sources"](spark, DATA).first() is not None


def test_influence_spread_without_arcs_in_the_driver(spark, lean):
    assert QUERIES["influence_spread"](spark, DATA).first() is not None


def test_random_walk_visits_without_arcs_in_the_driver(spark, lean):
    assert QUERIES["random_walk_visits"](spark, DATA).first() is not None


def test_sir_ensemble_without_arcs_in_the_driver(spark, lean):
    assert QUERIES["sir_ensemble"](spark, DATA).first() is not None


def test_louvain_hierarchy_needs_no_component_in_a_task(spark, monkeypatch):
    from lattica.operators import kernels
    from lattica.operators.model import Graph

    # rings of eight cliques of five, a loop, an edge without a weight and a node alone; both ways over the edges agree
    e = [(5 * c + i, 5 * c + j, 2.0) for c in range(8) for i in range(5) for j in range(i + 1, 5)] + [(5 * c, (5 * c + 5) % 40 + 1, 0.5) for c in range(8)]
    e += [(3, 3, 1.0), (40, 41, None)]
    edges = spark.createDataFrame(e, "src long, dst long, w double").withColumn("ord", kernels.F.struct("src", "dst"))
    g = Graph(spark.range(43).withColumn("ord", kernels.F.col("id")), edges, False)
    blocks = lambda h, k: {frozenset(r.id for r in h if r.level == k and r.label == c) for c in {r.label for r in h if r.level == k}}
    want = kernels.louvain_hierarchy(g).collect()
    monkeypatch.setattr("lattica.operators.kernels.GROUP_LIMIT", 1)
    got = kernels.louvain_hierarchy(g).collect()
    assert blocks(got, 0) == blocks(want, 0) and {40, 41} in blocks(got, 0) and len(blocks(got, 0)) == 10
    assert sorted(map(tuple, QUERIES["louvain_hierarchy"](spark, DATA).collect())) == told("louvain_hierarchy")


@pytest.fixture
def knots(spark):
    """Random groups with loops, weights, a pair and a node without edges, under text ids."""
    import random

    from lattica.operators.model import Graph

    r = random.Random(5)
    pairs = {tuple(sorted(r.sample(range(20 * (k % 6), 20 * (k % 6) + 22), 2))) for k in range(500)} | {(3, 3), (200, 201)}
    name = "n{:03d}".format
    e = spark.createDataFrame([(name(a), name(b), float(r.randint(1, 3))) for a, b in sorted(pairs)], "src string, dst string, w double")
    return Graph.from_edges(e, nodes=spark.createDataFrame([(name(k),) for k in (*range(122), 200, 201, 300)], "id string"))


@pytest.mark.parametrize("weight", [None, "w"])
def test_label_propagation_walks_rows_and_gives_the_distributed_labels(spark, knots, monkeypatch, weight):
    from lattica.plans import iterate, sources

    cuts = []
    monkeypatch.setattr(iterate, "cut", lambda df, real=iterate.cut: cuts.append(1) or real(df))
    short = sorted(iterate.label_propagation(knots, weight).collect())
    assert len(cuts) == 1  # no round of the driver's
    if weight is None:
        monkeypatch.setattr(iterate, "_TURNS", 1)  # five rounds of rows, then distributed ones
    else:
        monkeypatch.setattr(sources, "ARC_LIMIT", 0)
    assert sorted(iterate.label_propagation(knots, weight).collect()) == short
    assert len(cuts) > 3 and len({x["label"] for x in short}) > 4


def test_average_path_length_searches_once(spark):
    found = QUERIES["average_path_length"](spark, DATA)
    assert "MapIn" not in found._jdf.queryExecution().toString()  # what is returned holds the sum, not the searches
    assert sorted(map(tuple, found.collect())) == told("average_path_length")


@pytest.mark.parametrize("name", ["astar_path", "shortest_path_length"])
def test_a_path_is_measured_in_one_pass(spark, monkeypatch, name):
    """A look-up for each step would compute the graph as often as the path has steps."""
    def one(g, u, v):
        raise AssertionError("a look-up for a step")

    monkeypatch.setattr("lattica.operators.model.Graph.edge", one)
    assert sorted(map(tuple, QUERIES[name](spark, DATA).collect())) == told(name)


def test_a_step_that_is_no_edge_has_no_length(spark):
    from lattica.errors import EdgeNotFound
    from lattica.operators.model import Graph

    e = spark.createDataFrame([(1, 2, 2.0), (3, 2, 0.5)], "src long, dst long, w double")
    assert registry_more._length(Graph.from_edges(e), [1, 2, 3]) == 2.5 and registry_more._length(Graph.from_edges(e), [1]) == 0.0
    with pytest.raises(EdgeNotFound):
        registry_more._length(Graph.from_edges(e), [2, 1, 3])


def test_eccentricity_asks_all_searches_at_once(spark, monkeypatch):
    """isEmpty() runs one task, then a few, then the rest, so most executors wait."""
    asked = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.isEmpty", lambda df: asked.append(df.columns) or not df.limit(1).count())
    assert sorted(map(tuple, QUERIES["eccentricity"](spark, DATA).collect())) == told("eccentricity")
    assert ["id", "ord", "value"] not in asked


@pytest.mark.parametrize("pairs", [60, 700])
def test_dense_passes_read_the_arcs_as_they_lie(pairs):
    """Few and many arcs, rows without arcs, and nodes that aren't reached give the depths of single searches."""
    import numpy as np

    from lattica.plans.sources import Rows

    r = np.random.default_rng(pairs)
    s, d = np.sort(r.integers(0, 90, pairs)), r.integers(0, 100, pairs)
    rows, back = Rows.__new__(Rows), Rows.__new__(Rows)
    for x, tail, to in ((rows, s, d), (back, np.sort(d), s[np.argsort(d, kind="stable")])):
        x.n, x.count, x.weighted, x.path = 100, pairs, False, str(id(x))
        x.__dict__.update(head=np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=100))]), dst=to.astype(np.int32))
    gathered = []
    rows.__dict__["spans"] = lambda u, real=rows.spans: gathered.append(len(u)) or real(u)
    found = rows.depths(np.arange(64))
    for k in range(64):
        far = back.distances(k)
        assert found[:, k].tolist() == [int((far == x).sum()) for x in range(len(found))]
    assert 90 not in gathered and (pairs < 700 or len(gathered) < len(found))


def test_metric_to_pandas_takes_columns_not_rows(spark, lean):
    assert sorted(map(tuple, QUERIES["metric_to_pandas"](spark, DATA).toArrow().to_pandas().itertuples(index=False))) == told("metric_to_pandas")


def test_to_pandas_of_either_kind_of_ids_is_in_graph_order(spark):
    """Text ids go through Arrow, dates don't; a null value is NaN."""
    from lattica.functions import metrics

    for kind, ids in (("string", ["b", "a", "c"]), ("date", ["2024-01-02", "2024-01-01", "2024-01-03"])):
        m = spark.createDataFrame([(x, k, v) for x, k, v in zip(ids, (2, 0, 1), (1.5, None, 2.5))], "id string, ord long, value double")
        got = metrics.to_pandas(m.withColumn("id", m["id"].cast(kind)))
        assert [str(x) for x in got.index] == [ids[1], ids[2], ids[0]] and got.name == "value" and got.isna().tolist() == [True, False, False]
