"""Ids of any type, whole results without caps, and kernels against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.errors import CycleError, GraphError
from lattica.operators import dag, kernels, local, matching, outcomes, paths, simulate
from lattica.operators.model import Graph
from lattica.plans import iterate, sources
from lattica.plans.lineage import numbered
from lattica.sources import files
from lattica.sources import generators as gen


def graph(spark, edges, directed=False, w=None, nodes=()):
    kind = "string" if isinstance(edges[0][0], str) else "long"
    rows = [(u, v, float(x)) for (u, v), x in zip(edges, w or [1] * len(edges))]
    n = spark.createDataFrame([(x,) for x in nodes], f"id {kind}") if nodes else None
    return Graph.from_edges(spark.createDataFrame(rows, f"src {kind}, dst {kind}, w double"), directed=directed, nodes=n)


def test_text_ids(spark):
    g = files.from_dot(spark, "graph { a -- b; b -- c; c -- d; d -- b }")
    assert [tuple(r) for r in kernels.bridges(g).collect()] == [("a", "b")]
    assert [r.id for r in kernels.articulation_points(g).collect()] == ["b"]
    close = {r.id: r.value for r in sources.closeness_centrality(g).collect()}
    assert close["b"] == 1 and close["a"] == pytest.approx(3 / 5)
    assert len({r.label for r in iterate.label_propagation(g).collect()}) == 1
    assert {r.id for r in kernels.dfs_orders(g).collect()} == set("abcd")
    assert {r.id for r in kernels.louvain_communities(g).collect()} == set("abcd")
    assert sorted(len(r.nodes) for r in kernels.biconnected_components(g).collect()) == [2, 3]
    assert [r.path for r in iterate.k_shortest_paths(g, "a", "d", 5).collect()] == [["a", "b", "d"], ["a", "b", "c", "d"]]
    assert simulate.simulate(g, "SI", {"beta": 9.0}, {"a": "I"}, 30.0).select("node").distinct().count() == 4


def test_large_ids_survive(spark):
    big = 2**60 + 1
    g = graph(spark, [(big, big + 1), (big + 1, big + 2)])
    assert {r.src for r in kernels.bridges(g).collect()} == {big, big + 1}


def test_no_caps_on_paths_and_cycles(spark):
    line = graph(spark, [(k, k + 1) for k in range(9)])
    assert [r.path for r in iterate.k_shortest_paths(line, 0, 9, 3).collect()] == [list(range(10))]
    ring = graph(spark, [(k, (k + 1) % 8) for k in range(8)], directed=True)
    assert [r.cycle for r in kernels.simple_cycles(ring).collect()] == [[*range(8), 0]]
    assert kernels.simple_cycles(ring, 7).count() == 0


@pytest.mark.parametrize("directed", [True, False])
def test_cycles_and_paths_by_brute_force(spark, directed):
    r = np.random.default_rng(4)
    edges = sorted({(int(a), int(b)) for a, b in r.integers(0, 6, (12, 2)) if directed or a < b})
    w = r.integers(1, 9, len(edges)).tolist()
    g = graph(spark, edges, directed, w, nodes=range(6))
    cost = dict(zip(edges, w)) if directed else {**dict(zip(edges, w)), **{(b, a): x for (a, b), x in zip(edges, w)}}
    want = set()
    for n in range(1, 7):
        for p in itertools.permutations(range(6), n):
            if p[0] == min(p) and all(e in cost for e in zip(p, (*p[1:], p[0]))) and (directed or n == 1 or n > 2 and p[1] < p[-1]):
                want.add((*p, p[0]))
    assert {tuple(x.cycle) for x in kernels.simple_cycles(g).collect()} == want
    every = sorted((sum(cost[e] for e in zip(p, p[1:])), list(p)) for n in range(2, 7) for p in itertools.permutations(range(6), n) if p[0] == 0 and p[-1] == 5 and all(e in cost for e in zip(p, p[1:])))
    got = [(x.length, x.path) for x in iterate.k_shortest_paths(g, 0, 5, 6, "w").collect()]
    assert [x for x, _ in got] == [x for x, _ in every[:6]] and all([x, p] in [[a, b] for a, b in every] for x, p in got)
    if every:
        path = paths.astar_path(g, 0, 5, g.nodes.select("id", F.lit(0.0).alias("value")), "w")
        assert sum(cost[e] for e in zip(path, path[1:])) == every[0][0]


def test_modularity_of_the_whole_graph(spark):
    clique = list(itertools.combinations(range(10), 2))
    g = graph(spark, [*clique, (20, 21), (21, 22), (22, 23)])
    for f in (kernels.louvain_communities, kernels.greedy_modularity_communities):
        label = {x.id: x.label for x in f(g).collect()}
        assert len({label[k] for k in (20, 21, 22, 23)}) == 1 and len({label[k] for k in range(10)}) == 1, f.__name__
    h = kernels.louvain_hierarchy(g)
    assert h.where("level = 0").count() == 14


def test_peeling_and_forests_by_brute_force(spark):
    r = np.random.default_rng(5)
    edges = sorted({(int(min(p)), int(max(p))) for p in r.integers(0, 25, (70, 2)) if p[0] != p[1]})
    w = r.integers(1, 6, len(edges)).tolist()
    g = graph(spark, edges, w=w, nodes=range(27))
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in range(27)}
    core, left, k = {}, set(near), 0
    while left:
        low = [n for n in left if len(near[n] & left) <= k]
        if not low:
            k += 1
        for n in low:
            core[n] = k
        left -= set(low)
    assert {x.id: x.value for x in iterate.core_number(g).collect()} == core
    root = {n: n for n in near}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    picked = set()
    for x, a, b in sorted((x, a, b) for (a, b), x in zip(edges, w)):
        if find(a) != find(b):
            root[find(a)] = find(b)
            picked.add((a, b))
    assert {(x.src, x.dst) for x in iterate.spanning_edges(g, "w").collect()} == picked
    assert iterate.spanning_tree(g, "w").count_edges() == len(picked)


def test_matchings_by_brute_force():
    r = np.random.default_rng(6)
    for _ in range(150):
        n = int(r.integers(2, 8))
        edges = [(u, v, float(r.integers(1, 8))) for u in range(1, n + 1) for v in range(u + 1, n + 1) if r.random() < 0.6]
        weight = {(u, v): x for u, v, x in edges}
        best = max((sum(weight[e] for e in s) for k in range(n // 2 + 1) for s in itertools.combinations(weight, k) if len({x for e in s for x in e}) == 2 * k), default=0)
        found = matching.Blossoms(n, edges).run()
        assert len({x for e in found for x in e}) == 2 * len(found) and sum(weight[e] for e in found) == best


def test_matching_prefers_edges_or_weight(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)], w=[1, 5, 1])
    assert [tuple(x) for x in matching.max_weight_matching(g).collect()] == [(1, 2)]
    assert sorted(tuple(x) for x in matching.max_weight_matching(g, maxcardinality=True).collect()) == [(0, 1), (2, 3)]
    assert sorted(tuple(x) for x in matching.min_weight_matching(g).collect()) == [(0, 1), (2, 3)]


def test_predict_links_fills_up(spark):
    g = graph(spark, [(0, 1), (1, 2)], nodes=range(5))
    got = [(x.u, x.v, x.value) for x in local.predict_links(g, "common_neighbors", 10).collect()]
    assert got[0] == (0, 2, 1.0) and got[1:] == [(0, 3, 0.0), (0, 4, 0.0), (1, 3, 0.0), (1, 4, 0.0), (2, 3, 0.0), (2, 4, 0.0), (3, 4, 0.0)]


def test_dags(spark):
    d = dag.Dag.of(graph(spark, [(0, 1), (1, 2), (3, 2)], directed=True))
    assert d.depth() == 2 and d.longest_path() == [0, 1, 2] and d.add_edge(0, 3).count_edges() == 4
    for bad in ((2, 0), (1, 1)):
        with pytest.raises(CycleError):
            d.add_edge(*bad)
    with pytest.raises(CycleError):
        iterate.dag_levels(graph(spark, [(0, 1), (1, 0)], directed=True))
    assert dag.all_topological_sorts(d).count() == 3
    assert {r.id for r in kernels.maximum_antichain(d).collect()} in ({0, 3}, {1, 3})
    assert kernels.dag_width(d).first()[0] == 2


def test_links_may_pass_the_same_node(spark):
    import random

    rnd = random.Random(3)
    graphs = [[(0, 2), (1, 2), (2, 3), (2, 4)], [(0, 3), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (4, 7)], [(u, v) for u in range(12) for v in range(u + 1, 12) if rnd.random() < 0.2]]
    for edges in graphs:
        g = graph(spark, edges, directed=True)
        n = {x for e in edges for x in e}
        reach = {u: {v for a, v in edges if a == u} for u in n}
        for u in sorted(n, reverse=True):
            reach[u] |= {w for v in reach[u] for w in reach[v]}
        width = max(bin(s).count("1") for s in range(1 << 12) if all(s >> u & 1 == 0 or u in n and not any(s >> v & 1 for v in reach[u]) for u in range(12)))
        found = {r.id for r in kernels.maximum_antichain(g).collect()}
        assert len(found) == width == kernels.dag_width(g).first()[0] and not any(reach[u] & found for u in found)
        chains = {}
        for r in kernels.minimum_chain_partition(g).collect():
            chains.setdefault(r.chain, []).append(r.id)
        assert len(chains) == width and sorted(x for c in chains.values() for x in c) == sorted(n)
        assert all(b in reach[a] for c in chains.values() for a, b in zip(sorted(c), sorted(c)[1:]))


def test_schedules(spark):
    tasks = gen.random_task_dag(spark, 30, seed=1)
    total = tasks.nodes.agg(F.sum("duration")).first()[0]
    assert outcomes.makespans(simulate.schedule(tasks, workers=1)).first()["makespan"] == pytest.approx(total)
    critical = iterate.critical_path(tasks).agg(F.max("ef")).first()[0]
    assert outcomes.makespans(simulate.schedule(tasks, workers=30)).first()["makespan"] == pytest.approx(critical)
    log = simulate.schedule(tasks, workers=2, failure_rate=1.0, max_retries=1)
    assert log.where("status = 'failed'").count() == 2 * tasks.sources().count() and log.where("status = 'blocked'").count() == 30 - tasks.sources().count()
    with pytest.raises(GraphError):
        simulate.schedule(tasks, policy="none")


def test_event_logs(spark):
    log = spark.createDataFrame([(0, 1, 0.0, "S"), (0, 2, 0.0, "I"), (0, 1, 1.5, "I"), (0, 2, 2.0, "R")], "run long, node long, time double, state string")
    assert {(r.node, r.state) for r in outcomes.frame(log, 1.6).collect()} == {(1, "I"), (2, "I")}
    assert {(r.node, r.state) for r in outcomes.final(log).collect()} == {(1, "I"), (2, "R")}
    assert tuple(outcomes.peak(outcomes.counts(log), "I").first()) == (0, 1.5, 2)
    assert {(r.state, r.final, r.peak, r.ever) for r in outcomes.summary(log).collect()} == {("S", 0, 1, 1), ("I", 1, 2, 2), ("R", 1, 1, 1)}
    assert outcomes.first_time(log, "R").first()["time"] == 2.0


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r.v == r.position for r in numbered(df, "v").collect())
