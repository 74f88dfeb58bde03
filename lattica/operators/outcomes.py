"""What simulations tell: views of their event logs (run, node, time, state) and of schedules' task logs.

A log holds every node's state at time 0 and each later change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import GraphError
from lattica.operators.simulate import as_of


def frame(log: DataFrame, time: float) -> DataFrame:
    """(run, node, state) in force at a time."""
    at = log.sparkSession.createDataFrame([(float(time),)], "time double")
    return as_of(log, at).select("run", "node", "state")


def final(log: DataFrame) -> DataFrame:
    """(run, node, state) at the end."""
    return log.groupBy("run", "node").agg(F.max_by("state", "time").alias("state"))


def history(log: DataFrame, node) -> DataFrame:
    """(run, time, state) of a node's changes."""
    return log.where(F.col("node") == node).select("run", "time", "state")


def counts(log: DataFrame) -> DataFrame:
    """(run, time, state, count) after each moment at which a state's number of nodes changed."""
    own = Window.partitionBy("run", "node").orderBy("time")
    moves = log.withColumn("old", F.lag("state").over(own))
    steps = moves.select("run", "time", "state", F.lit(1).alias("d")).union(moves.where("old is not null").select("run", "time", "old", F.lit(-1)))
    steps = steps.groupBy("run", "time", "state").agg(F.sum("d").alias("d")).where("d <> 0")
    run = Window.partitionBy("run", "state").orderBy("time")
    return steps.select("run", "time", "state", F.sum("d").over(run).alias("count"))


def fractions(counted: DataFrame, nodes: int) -> DataFrame:
    """Counts over the number of nodes."""
    if nodes < 1:
        raise GraphError("no nodes")
    return counted.withColumn("fraction", F.col("count") / nodes)


def first_time(log: DataFrame, state: str) -> DataFrame:
    """(run, node, time) at which nodes first have a state; those that never do are left out."""
    return log.where(F.col("state") == state).groupBy("run", "node").agg(F.min("time").alias("time"))


def peak(counted: DataFrame, state: str) -> DataFrame:
    """(run, time, count): a state's largest count and when it was first reached."""
    own = counted.where(F.col("state") == state)
    return own.groupBy("run").agg(F.min(F.struct((-F.col("count")).alias("m"), "time")).alias("p")).select("run", "p.time", (-F.col("p.m")).alias("count"))


def summary(log: DataFrame) -> DataFrame:
    """(run, state, final, peak, peak_time, ever): per state its last and largest count, and the nodes that ever had it."""
    c = counts(log)
    top = c.groupBy("run", "state").agg(F.min(F.struct((-F.col("count")).alias("m"), "time")).alias("p"))
    end = final(log).groupBy("run", "state").agg(F.count("*").alias("final"))
    ever = log.groupBy("run", "state").agg(F.count_distinct("node").alias("ever"))
    out = top.join(end, ["run", "state"], "left").join(ever, ["run", "state"])
    return out.select("run", "state", F.coalesce("final", F.lit(0).cast("long")).alias("final"), (-F.col("p.m")).alias("peak"), F.col("p.time").alias("peak_time"), "ever")


def to_records(log: DataFrame) -> list[dict]:
    return [r.asDict() for r in log.orderBy("run", "time", "node").collect()]


def to_pandas(log: DataFrame):
    return log.orderBy("run", "time", "node").toPandas()


# schedules: (run, task, worker, start, end, attempt, status)


def runs_of(log: DataFrame, task) -> DataFrame:
    """The attempts of a task."""
    return log.where(F.col("task") == task)


def task_runs(log: DataFrame) -> DataFrame:
    """The log with each attempt's duration."""
    return log.withColumn("duration", F.col("end") - F.col("start"))


def makespans(log: DataFrame) -> DataFrame:
    """(run, makespan)."""
    return log.groupBy("run").agg(F.max("end").alias("makespan"))


def utilization(log: DataFrame, workers: int) -> DataFrame:
    """(run, value): the workers' busy time over all their time until the end."""
    return log.groupBy("run").agg(F.sum(F.col("end") - F.col("start")).alias("busy"), F.max("end").alias("span")).select("run", F.when(F.col("span") > 0, F.col("busy") / (F.col("span") * workers)).otherwise(0.0).alias("value"))


def percentile(spans: DataFrame, q: float) -> DataFrame:
    """The q-th percentile of (run, makespan), linear between runs."""
    return spans.agg(F.percentile("makespan", q / 100).alias("value"))


def probability(spans: DataFrame, deadline: float) -> DataFrame:
    """The share of runs that end by the deadline."""
    return spans.agg(F.avg((F.col("makespan") <= deadline).cast("double")).alias("value"))


def monte_carlo(spans: DataFrame, percentiles: tuple = (50, 80, 95)) -> DataFrame:
    """One row: mean, deviation, standard error and percentiles of (run, makespan)."""
    q = F.percentile("makespan", F.array(*[F.lit(p / 100) for p in percentiles]))
    s = spans.agg(F.avg("makespan").alias("mean"), F.coalesce(F.stddev_samp("makespan"), F.lit(0.0)).alias("std"), F.count("*").alias("runs"), q.alias("q"))
    return s.select("mean", "std", (F.col("std") / F.sqrt("runs")).alias("stderr"), "runs", *[F.get("q", F.lit(k)).alias(f"p{p}") for k, p in enumerate(percentiles)])
