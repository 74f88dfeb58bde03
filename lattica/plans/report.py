"""One-call reports and the command line."""

from __future__ import annotations

import json
import math
import sys
import time

from lattica.errors import GraphError
from lattica.operators import kernels, local
from lattica.operators.model import Graph
from lattica.plans import iterate, sources

#: Nodes up to which measures over all pairs are part of a report.
EXACT_LIMIT = 3000


def analyze(g: Graph, top: int = 10) -> dict:
    """Headline numbers, components, leading nodes and communities; a step that fails becomes a note."""
    out: dict = {"seconds": {}, "notes": []}

    def step(name: str, f):
        began = time.time()
        try:
            out[name] = f()
        except GraphError as e:
            out["notes"].append(f"{name}: {e}")
        out["seconds"][name] = round(time.time() - began, 3)

    lead = lambda df: [[r["id"], r["value"]] for r in df.orderBy("value", ascending=False).limit(top).collect()]
    step("summary", lambda: local.summary(g).first().asDict())
    step("components", lambda: [r["size"] for r in iterate.weak_components(g).groupBy("root").count().withColumnRenamed("count", "size").orderBy("size", ascending=False).limit(top).collect()])
    step("degree", lambda: lead(g.degree()))
    step("pagerank", lambda: lead(iterate.pagerank(g)))
    if not g.directed:
        step("communities", lambda: [r["count"] for r in kernels.louvain_communities(g).groupBy("label").count().orderBy("count", ascending=False).limit(top).collect()])
    elif iterate.is_dag(g):
        step("levels", lambda: iterate.dag_levels(g).groupBy("level").count().count())
    n = out.get("summary", {}).get("nodes", 0)
    if n <= EXACT_LIMIT:
        step("closeness", lambda: lead(sources.closeness_centrality(g)))
        step("betweenness", lambda: lead(sources.betweenness_centrality(g)))
        step("diameter", lambda: sources.diameter(g))
    else:
        out["notes"].append(f"{n} nodes: measures over all pairs are left out")
    return out


def to_json(report: dict) -> str:
    """JSON without NaN or infinities."""
    def safe(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: safe(v) for k, v in x.items()}
        return [safe(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(safe(report), indent=1, default=str)


def main(args: list[str]) -> int:
    """analyze FILE | info FILE | convert FILE FILE"""
    from pyspark.sql import SparkSession

    from lattica.sources import files

    if len(args) < 2 or args[0] not in ("analyze", "info", "convert"):
        print(main.__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    g = files.read(spark, args[1])
    if args[0] == "convert":
        files.write(g, args[2])
    else:
        print(to_json(analyze(g) if args[0] == "analyze" else local.summary(g).first().asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
