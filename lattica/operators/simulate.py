"""Monte-Carlo models: runs are spread over the tasks, draws come from a seed and the run's number."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import GraphError
from lattica.operators.model import Graph
from lattica.plans.sources import Rows

# fixed values: states, spontaneous changes (rate, from, to), contagion (rate, from, to, by)
MODELS = {
    "SI": ("SI", [], [("beta", "S", "I", "I")]),
    "SIS": ("SI", [("gamma", "I", "S")], [("beta", "S", "I", "I")]),
    "SIR": ("SIR", [("gamma", "I", "R")], [("beta", "S", "I", "I")]),
    "SEIR": ("SEIR", [("sigma", "E", "I"), ("gamma", "I", "R")], [("beta", "S", "E", "I")]),
    "SIRS": ("SIR", [("gamma", "I", "R"), ("xi", "R", "S")], [("beta", "S", "I", "I")]),
    "SEIRD": ("SEIRD", [("sigma", "E", "I"), ("gamma", "I", "R"), ("mu", "I", "D")], [("beta", "S", "E", "I")]),
}


@dataclass(frozen=True)
class Model:
    """States; spontaneous changes (rate's name, from, to); contagions (rate's name, from, to, by a neighbour's state)."""

    states: tuple
    alone: tuple = ()
    by: tuple = ()

    def ends(self) -> set:
        """States that are left by no change."""
        return set(self.states) - {a for _, a, *_ in (*self.alone, *self.by)}

    def terminates(self) -> bool:
        """Whether every run comes to rest: no change leads, over others, back to its own state."""
        after: dict = {}
        for _, a, b, *_ in (*self.alone, *self.by):
            after.setdefault(a, set()).add(b)
        for start in self.states:
            seen, todo = set(), [start]
            while todo:
                for y in after.get(todo.pop(), set()) - seen:
                    seen.add(y)
                    todo.append(y)
            if start in seen:
                return False
        return True


def model(name: str | Model) -> Model:
    if isinstance(name, Model):
        return name
    states, alone, by = MODELS[name]
    return Model(tuple(states), tuple(alone), tuple(by))


def _runs(g: Graph, runs: int, f, schema: str, weight=None, **columns) -> DataFrame:
    """f(rows, run) -> DataFrame for each run; columns are those that Rows keeps of the nodes."""
    spark = g.nodes.sparkSession
    rows = Rows(g, weight, **columns)
    kind = g.nodes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b["id"]:
                out = f(rows, int(r))
                for lo in range(0, len(out), 1 << 16):
                    yield out[lo : lo + (1 << 16)]

    return spark.range(0, runs, 1, max(1, min(runs, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, schema.replace("ID", kind))


def simulate(g: Graph, kind: str | Model, rates: dict[str, float], initial: dict, t_max: float, method: str = "discrete", runs: int = 1, dt: float = 1.0, weight=None, seed: int = 0) -> DataFrame:
    """(run, node, time, state): each node's state at 0 and its later changes up to t_max; see operators.outcomes.

    initial maps nodes to states, the others have the first state. discrete: synchronous steps of dt, as in epidemic().
    gillespie: one change at a time, after an exponential wait for all hazards together. A neighbour's contagion is its
    rate times the arc's weight. A run ends where no change is left.
    """
    m = model(kind)
    code = {s: k for k, s in enumerate(m.states)}
    if not set(initial.values()) <= set(code) or method not in ("discrete", "gillespie"):
        raise GraphError("an unknown state or method")
    g._known(*initial)

    def hazards(rows: Rows, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(code)))
        for name, a, b in m.alone:
            out[x == code[a], code[b]] += rates[name]
        for name, a, b, via in m.by:
            near = rows.near(np.nonzero(x == code[via])[0])
            own = x == code[a]
            out[own, code[b]] += rates[name] * near[own]
        return out

    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n = np.random.default_rng([seed, r]), len(rows.ids)
        x = np.array([code[initial.get(i, m.states[0])] for i in rows.ids.tolist()], np.int64)
        log, t = [(k, 0.0, x[k]) for k in range(n)], 0.0
        hazard = hazards(rows, x)
        while (total := hazard.sum()) > 0:
            if method == "discrete":
                t += dt
                if t > t_max + 1e-12:
                    break
                each = hazard.sum(1)
                leave = rng.random(n) < 1 - np.exp(-each * dt)
                pick = rng.random(n) * each
                to = (np.cumsum(hazard, axis=1) <= pick[:, None]).sum(1).clip(max=len(code) - 1)
                moved = np.nonzero(leave & (each > 0))[0]
                x[moved] = to[moved]
            else:
                t += rng.exponential(1 / total)
                if t > t_max:
                    break
                at = int(min(np.searchsorted(np.cumsum(hazard), rng.random() * total, "right"), hazard.size - 1))
                moved = np.array([at // len(code)])
                x[moved] = at % len(code)
            log += [(k, t, x[k]) for k in moved.tolist()]
            hazard = hazards(rows, x)
        return pd.DataFrame({"run": r, "node": rows.ids[[k for k, _, _ in log]], "time": [t for _, t, _ in log], "state": [m.states[s] for _, _, s in log]})

    return _runs(g, runs, f, "run long, node ID, time double, state string", weight)


def epidemic(g: Graph, model: str, rates: dict[str, float], initial: list, steps: int, runs: int = 1, dt: float = 1.0, seed: int = 0) -> DataFrame:
    """(run, step, state, count) of synchronous steps: a node leaves its state with chance 1 - exp(-hazard dt),
    by one of its competing changes in proportion to their rates. States without nodes have zeros."""
    states, alone, by = MODELS[model]
    code = {s: k for k, s in enumerate(states)}

    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n = np.random.default_rng([seed, r]), len(rows.ids)
        x = np.zeros(n, np.int64)
        x[np.isin(rows.ids, initial)] = code["I"]
        out = []
        for step in range(steps + 1):
            count = np.bincount(x, minlength=len(states))
            out += [(r, step, s, int(count[k])) for k, s in enumerate(states)]
            hazard = np.zeros((n, len(states)))
            for name, a, b in alone:
                hazard[x == code[a], code[b]] += rates[name]
            for name, a, b, via in by:
                near = rows.near(np.nonzero(x == code[via])[0])
                m = x == code[a]
                hazard[m, code[b]] += rates[name] * near[m]
            total = hazard.sum(1)
            leave = rng.random(n) < 1 - np.exp(-total * dt)
            pick = rng.random(n) * total
            to = (np.cumsum(hazard, axis=1) <= pick[:, None]).sum(1).clip(max=len(states) - 1)
            x = np.where(leave & (total > 0), to, x)
        return pd.DataFrame(out, columns=["run", "step", "state", "count"])

    return _runs(g, runs, f, "run long, step long, state string, count long")


def ensemble(samples: DataFrame, keys: tuple[str, ...] = ("step", "state"), value: str = "count") -> DataFrame:
    """Mean, deviation (sample) and quantiles over the runs for each key."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    s = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), q.alias("q"))
    return s.select(*keys, "mean", "std", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p5", "p25", "p50", "p75", "p95"))])


def as_of(frames: DataFrame, times: DataFrame) -> DataFrame:
    """(run, time, node, state): the state in force at times(time), of frames(run, node, time, state)."""
    stops = frames.select("run", "node").distinct().crossJoin(F.broadcast(times)).select("run", "node", "time", F.lit(None).cast(frames.schema["state"].dataType).alias("state"), F.lit(1).alias("ask"))
    from pyspark.sql import Window

    w = Window.partitionBy("run", "node").orderBy("time", "ask").rowsBetween(Window.unboundedPreceding, 0)
    both = frames.select("run", "node", "time", "state", F.lit(0).alias("ask")).union(stops)
    return both.withColumn("state", F.last("state", ignorenulls=True).over(w)).where("ask = 1").select("run", "time", "node", "state")


def influence_spread(g: Graph, seeds: list, p: float = 0.1, runs: int = 1000, seed: int = 0) -> DataFrame:
    """One row: the mean reach of independent cascades, its standard error, and the runs."""
    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng = np.random.default_rng([seed, r])
        live = np.concatenate([rng.random(min(1 << 20, rows.count - lo)) < p for lo in range(0, rows.count, 1 << 20)] or [np.zeros(0, bool)])
        on = np.isin(rows.ids, seeds)
        front = np.nonzero(on)[0]
        while len(front):
            nxt = rows.heads(front, live)
            front = nxt[~on[nxt]]
            on[front] = True
        return pd.DataFrame({"run": [r], "reach": [int(on.sum())]})

    s = _runs(g, runs, f, "run long, reach long")
    return s.agg(F.avg("reach").alias("mean"), (F.coalesce(F.stddev_samp("reach"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("stderr"), F.count("*").alias("runs"))


def random_walks(g: Graph, walkers: int, steps: int, restart: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, visits) over all walkers; a node without arcs, and a restart, jump to a uniform node."""
    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n = np.random.default_rng([seed, r]), len(rows.ids)
        at, seen = int(rng.integers(n)), np.zeros(n, np.int64)
        for _ in range(steps):
            lo, hi = rows.head[at], rows.head[at + 1]
            at = int(rng.integers(n)) if lo == hi or rng.random() < restart else int(rows.dst[rng.integers(lo, hi)])
            seen[at] += 1
        k = np.nonzero(seen)[0]
        return pd.DataFrame({"id": rows.ids[k], "visits": seen[k]})

    return _runs(g, walkers, f, "id ID, visits long").groupBy("id").agg(F.sum("visits").alias("visits"))


def stationary_distribution(g: Graph) -> DataFrame:
    """(id, value) of a walk on a connected undirected graph: degrees (a loop once) over their sum."""
    d = g.need(False).arcs().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    return d.crossJoin(F.broadcast(d.agg(F.sum("d").alias("s")))).select("id", (F.col("d") / F.col("s")).alias("value"))


def voter_model(g: Graph, opinions: int = 2, sweeps: int = 50, runs: int = 1, seed: int = 0) -> DataFrame:
    """(run, sweep, opinion, count): in turn random nodes copy a random neighbour."""
    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n = np.random.default_rng([seed, r]), len(rows.ids)
        x, out = rng.integers(0, opinions, n), []
        for sweep in range(sweeps + 1):
            c = np.bincount(x, minlength=opinions)
            out += [(r, sweep, k, int(c[k])) for k in range(opinions)]
            for u in rng.integers(0, n, n):
                if rows.head[u] < rows.head[u + 1]:
                    x[u] = x[rows.dst[rng.integers(rows.head[u], rows.head[u + 1])]]
        return pd.DataFrame(out, columns=["run", "sweep", "opinion", "count"])

    return _runs(g, runs, f, "run long, sweep long, opinion long, count long")


def kuramoto(g: Graph, coupling: float = 1.0, t_max: float = 10.0, dt: float = 0.05, runs: int = 1, seed: int = 0) -> DataFrame:
    """(run, time, r): the order parameter of phase oscillators, by fourth-order Runge-Kutta steps."""
    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n = np.random.default_rng([seed, r]), len(rows.ids)
        own, x = rng.normal(size=n), rng.uniform(0, 2 * np.pi, n)
        src, out = np.repeat(np.arange(n), np.diff(rows.head)), []

        def slope(y):
            return own + coupling * np.bincount(rows.dst, weights=np.sin(y[src] - y[rows.dst]), minlength=n)

        for k in range(int(round(t_max / dt)) + 1):
            out.append((r, k * dt, float(abs(np.exp(1j * x).mean()))))
            a = slope(x)
            b = slope(x + dt / 2 * a)
            c = slope(x + dt / 2 * b)
            x = x + dt / 6 * (a + 2 * b + 2 * c + slope(x + dt * c))
        return pd.DataFrame(out, columns=["run", "time", "r"])

    return _runs(g, runs, f, "run long, time double, r double")


def monte_carlo_schedule(g: Graph, runs: int = 1000, seed: int = 0, low: str = "min", mode: str = "mode", high: str = "max") -> DataFrame:
    """(run, makespan) of a task graph with unlimited workers and triangular durations from node columns."""
    if not g.nodes.where(F.col(low).isNull() | F.col(mode).isNull() | F.col(high).isNull()).isEmpty():
        raise GraphError("a task has no estimate")

    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n = np.random.default_rng([seed, r]), rows.n
        a, d, b = rows.node["low"], rows.node["mode"].copy(), rows.node["high"]
        varies = a < b
        d[varies] = rng.triangular(a[varies], d[varies], b[varies])
        start, end = np.zeros(n), 0.0
        for wave in rows.waves():
            done = start[wave] + d[wave]
            end = max(end, done.max())
            for p, k in rows.spans(wave):
                np.maximum.at(start, rows.dst[k], done[p])
        return pd.DataFrame({"run": [r], "makespan": [end]})

    return _runs(g.need(True), runs, f, "run long, makespan double", low=F.col(low), mode=F.col(mode), high=F.col(high))


def greedy_influence(g: Graph, k: int, p: float = 0.1, runs: int = 200, seed: int = 0, candidates: list | None = None) -> DataFrame:
    """(place, id, spread): the k seeds that greedily reach most over shared samples of live arcs, ties by graph order.

    A round counts every candidate's gain in every sample, spread over the tasks, and adds the counts up.
    """
    picked: list = []
    spread, out = 0.0, []
    for place in range(min(k, g.count_nodes())):
        seeds = list(picked)

        def f(rows: Rows, r: int) -> pd.DataFrame:
            live = np.random.default_rng([seed, r]).random(len(rows.dst)) < p

            def reach(starts, on):
                front, new = list(starts), set(starts)
                while front:
                    u = front.pop()
                    for v in rows.dst[rows.head[u] : rows.head[u + 1]][live[rows.head[u] : rows.head[u + 1]]].tolist():
                        if v not in new and v not in on:
                            new.add(v)
                            front.append(v)
                return new

            at = {i: j for j, i in enumerate(rows.ids.tolist())}
            on = reach({at[s] for s in seeds}, set())
            pool = range(len(rows.ids)) if candidates is None else [at[c] for c in candidates]
            gains = [0 if u in on else len(reach({u}, on)) for u in pool]
            return pd.DataFrame({"at": list(pool), "id": rows.ids[list(pool)], "gain": gains})

        rows = _runs(g, runs, f, "at long, id ID, gain long").groupBy("at", "id").agg(F.sum("gain").alias("gain")).where(~F.col("id").isin(seeds) if seeds else F.lit(True))
        best = rows.orderBy(F.desc("gain"), "at").first()
        if best is None:
            break
        picked.append(best["id"])
        spread += best["gain"] / runs
        out.append((place, best["id"], spread))
    kind = g.nodes.schema["id"].dataType.simpleString()
    return g.nodes.sparkSession.createDataFrame(out, f"place long, id {kind}, spread double")


def bounded_confidence(g: Graph, epsilon: float = 0.2, mu: float = 0.5, steps: int = 100, runs: int = 1, seed: int = 0, initial: dict | None = None) -> DataFrame:
    """(run, id, value, cluster): opinions after steps sweeps of pair updates along random edges.

    Two ends closer than epsilon move by mu of their gap towards each other. Clusters are numbered by value; a gap of
    epsilon or more parts two.
    """
    from pyspark.sql import Window

    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n = np.random.default_rng([seed, r]), len(rows.ids)
        x = rng.random(n) if initial is None else np.array([float(initial[i]) for i in rows.ids.tolist()])
        src = np.repeat(np.arange(n), np.diff(rows.head))
        for e in rng.integers(0, len(src), steps * len(src)).tolist() if len(src) else ():
            u, v = src[e], rows.dst[e]
            gap = x[v] - x[u]
            if u != v and abs(gap) < epsilon:
                x[u] += mu * gap
                x[v] -= mu * gap
        return pd.DataFrame({"run": r, "id": rows.ids, "value": x})

    w = Window.partitionBy("run").orderBy("value", "id")
    values = _runs(g, runs, f, "run long, id ID, value double")
    return values.withColumn("cut", (F.col("value") - F.lag("value").over(w) >= epsilon).cast("int")).select("run", "id", "value", F.sum(F.coalesce("cut", F.lit(0))).over(w).alias("cluster"))


#: How waiting tasks are ordered; equal ones by graph order.
POLICIES = ("critical_path", "fifo", "shortest", "longest", "successors")


def schedule(g: Graph, duration: str = "duration", workers: int = 2, policy: str = "critical_path", failure_rate: float = 0.0, max_retries: int = 0, jitter: float = 0.0, runs: int = 1, seed: int = 0) -> DataFrame:
    """(run, task, worker, start, end, attempt, status) of list scheduling on a number of equal workers.

    A free worker takes the waiting task that the policy puts first. A duration varies uniformly by the share `jitter`.
    An attempt fails with chance failure_rate and is tried again up to max_retries times; what waits for a task that
    failed for good is blocked, a row without worker and times.
    """
    if policy not in POLICIES or workers < 1 or not 0 <= failure_rate <= 1:
        raise GraphError("an unknown policy, no worker, or no such rate")
    def f(rows: Rows, r: int) -> pd.DataFrame:
        rng, n, own = np.random.default_rng([seed, r]), rows.n, rows.node["d"]
        size, need = np.diff(rows.head), np.bincount(rows.dst, minlength=n)
        tail = own.copy()
        for wave in reversed(rows.waves()) if policy == "critical_path" else ():
            most = np.zeros(len(wave))
            for p, k in rows.spans(wave):
                np.maximum.at(most, p, tail[rows.dst[k]])
            tail[wave] += most
        first = {"critical_path": -tail, "fifo": np.zeros(n), "shortest": own, "longest": -own, "successors": -size}[policy].tolist()
        waiting, busy, idle, arrived = [], [], list(range(workers)), 0
        tries, t = np.zeros(n, int), 0.0
        whole, real = array("q"), array("d")  # task, worker, attempt, failed; start, end

        def wait(u):
            nonlocal arrived
            heapq.heappush(waiting, (first[u], arrived if policy == "fifo" else u, u))
            arrived += 1

        for u in np.nonzero(need == 0)[0].tolist():
            wait(u)
        while waiting or busy:
            while waiting and idle:
                u, who = heapq.heappop(waiting)[2], heapq.heappop(idle)
                tries[u] += 1
                end = t + float(own[u]) * (1 + jitter * rng.uniform(-1, 1))
                fails = rng.random() < failure_rate
                heapq.heappush(busy, (end, who, u, fails))
                whole.extend((u, who, int(tries[u]), fails))
                real.extend((t, end))
            t, who, u, fails = heapq.heappop(busy)
            heapq.heappush(idle, who)
            if fails:
                if tries[u] <= max_retries:
                    wait(u)
                continue
            if size[u]:
                v = rows.dst[rows.head[u] : rows.head[u + 1]]
                np.subtract.at(need, v, 1)
                for x in np.unique(v[need[v] == 0]).tolist():
                    wait(x)
        a, b, left = np.array(whole).reshape(-1, 4), np.array(real).reshape(-1, 2), np.nonzero(tries == 0)[0]
        out = pd.DataFrame({
            "run": r, "task": rows.ids[np.concatenate([a[:, 0], left]).astype(np.int64)], "worker": pd.array(np.concatenate([a[:, 1], left]).astype(np.int64), "Int64"),
            "start": np.concatenate([b[:, 0], left]), "end": np.concatenate([b[:, 1], left]), "attempt": np.concatenate([a[:, 2], 0 * left]).astype(np.int64),
            "status": np.concatenate([np.where(a[:, 3] > 0, "failed", "done"), np.full(len(left), "blocked")]).astype(object),
        })
        out["worker"] = out["worker"].mask(out["status"] == "blocked")
        out.loc[out["status"] == "blocked", ["start", "end"]] = None
        return out

    return _runs(g.need(True), runs, f, "run long, task ID, worker long, start double, end double, attempt long, status string", d=F.coalesce(F.col(duration).cast("double"), F.lit(1.0)))
