"""Layouts, reports and simulations."""

import json
import math

from pyspark.sql import functions as F

from lattica.operators import layout, simulate
from lattica.plans import report
from lattica.sources import generators


def test_layouts(spark):
    g = generators.path_graph(spark, 6)
    for f in (layout.circular, layout.arc, layout.grid, layout.spiral, layout.random, layout.bipartite, layout.spectral, lambda g: layout.force(g, 2)):
        rows = f(g).collect()
        assert {r.id for r in rows} == set(range(6)) and all(math.isfinite(r.x) and math.isfinite(r.y) for r in rows)
    assert {(r.id, r.y) for r in layout.layered(generators.path_graph(spark, 3, directed=True)).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert layout.to_svg(g, layout.circular(g)).count("<circle") == 6


def test_report(spark):
    r = report.analyze(generators.barbell_graph(spark, 4, 1))
    assert json.loads(report.to_json(r))["summary"]["nodes"] == 9 and r["diameter"] == 4 and not r["notes"]


def test_simulations(spark):
    g = generators.complete_graph(spark, 12)
    s = simulate.epidemic(g, "SIR", {"beta": 0.5, "gamma": 0.3}, [0], 15, runs=8, seed=1)
    assert s.groupBy("run", "step").agg(F.sum("count").alias("n")).where("n <> 12").isEmpty()
    assert s.exceptAll(simulate.epidemic(g, "SIR", {"beta": 0.5, "gamma": 0.3}, [0], 15, runs=8, seed=1)).isEmpty()
    assert simulate.influence_spread(g, [0], p=1.0, runs=4).first()["mean"] == 12
    k = simulate.kuramoto(g, coupling=2.0, t_max=4.0).collect()
    assert all(0 <= r.r <= 1 + 1e-9 for r in k) and k[-1].r > 0.9
    frames = spark.createDataFrame([(0, 1, 0.0, "S"), (0, 1, 2.0, "I")], "run long, node long, time double, state string")
    got = {r.time: r.state for r in simulate.as_of(frames, spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "time double")).collect()}
    assert got == {1.0: "S", 2.0: "I", 9.0: "I"}
