"""Post-processing of (id, ord, value) metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import GraphError, NodeNotFound
from lattica.plans.lineage import numbered


def top(m: DataFrame, k: int = 10) -> DataFrame:
    """The k largest, ties by graph order."""
    return m.orderBy(F.desc("value"), "ord").limit(max(0, k))


def bottom(m: DataFrame, k: int = 10) -> DataFrame:
    return m.orderBy("value", "ord").limit(max(0, k))


def argmax(m: DataFrame):
    row = top(m, 1).first()
    if row is None:
        raise GraphError("no values")
    return row["id"]


def argmin(m: DataFrame):
    row = bottom(m, 1).first()
    if row is None:
        raise GraphError("no values")
    return row["id"]


def rank(m: DataFrame, descending: bool = True) -> DataFrame:
    """Dense ranks from 1: the distinct values' places, joined back."""
    order = F.desc("value") if descending else F.asc("value")
    ranks = numbered(m.select("value").distinct(), order).select("value", (F.col("position") + 1).alias("rank"))
    return m.join(ranks, "value").select("id", "ord", "value", "rank")


def mapped(m: DataFrame, f) -> DataFrame:
    """The metric with f(value), a column function, as its values."""
    return m.withColumn("value", f(F.col("value")))


def filtered(m: DataFrame, keep) -> DataFrame:
    """The nodes for whose value keep(value), a column function, holds."""
    return m.where(keep(F.col("value")))


def to_pandas(m: DataFrame):
    """A pandas series of the values by id, in graph order."""
    rows = m.orderBy("ord").select("id", "value")
    # Arrow's columns, where both ways give the same; rows of Python objects take a multiple of the memory
    plain = all(k in ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean") for _, k in rows.dtypes)
    pdf = rows.toArrow().to_pandas() if plain else rows.toPandas()
    return pdf.set_index("id")["value"]


def as_nodemap(g, values, name: str = "value") -> DataFrame:
    """(id, ord, value) over all nodes: of a metric, a dict, one number for all, or a node column's name; others are null."""
    base = g.nodes.select("id", "ord")
    if isinstance(values, DataFrame):
        return base.join(values.select("id", F.col(name).alias("value")), "id", "left").select("id", "ord", "value")
    if isinstance(values, dict):
        kind = g.nodes.schema["id"].dataType.simpleString()
        given = g.nodes.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], f"id {kind}, value double")
        lost = given.join(base, "id", "left_anti").first()
        if lost is not None:
            raise NodeNotFound(str(lost["id"]))
        return base.join(given, "id", "left").select("id", "ord", "value")
    if isinstance(values, str):
        return g.nodes.select("id", "ord", F.col(values).cast("double").alias("value"))
    return base.withColumn("value", F.lit(float(values)))


def normalized(m: DataFrame, method: str = "max") -> DataFrame:
    """By the largest magnitude, the sum, minmax or zscore (population deviation); a zero scale gives zeros."""
    real = m.where(~F.isnan("value"))
    s = real.agg(
        F.max(F.abs("value")).alias("top"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
    )
    shift, scale = {"max": (F.lit(0.0), F.col("top")), "sum": (F.lit(0.0), F.col("total")), "minmax": (F.col("lo"), F.col("hi") - F.col("lo")), "zscore": (F.col("mean"), F.col("sd"))}[method]
    value = F.when(scale == 0, F.lit(0.0)).otherwise((F.col("value") - shift) / scale)
    return m.crossJoin(F.broadcast(s)).select("id", "ord", value.alias("value"))


def describe(m: DataFrame) -> DataFrame:
    """count, mean, std (population), min, quartiles (linear) and max of the values that aren't NaN."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = m.where(~F.isnan(F.col("value").cast("double"))).agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").cast("double").alias("min"), q.alias("q"), F.max("value").cast("double").alias("max")
    )
    return s.select("count", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "max")


def histogram(m: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, lo, hi, count) over equal bins; the last one holds the maximum."""
    s = m.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counted = m.crossJoin(F.broadcast(s)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    every = s.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def fold_categories(categories: DataFrame, keep: int = 7, other: str = "Other") -> DataFrame:
    """(category, count): the largest categories, ties by name, and the rest folded into one."""
    counts = categories.groupBy("category").agg(F.count("*").alias("count"))
    big = counts.orderBy(F.desc("count"), "category").limit(keep).select("category", F.lit(True).alias("kept"))
    named = counts.join(big, "category", "left")
    return named.groupBy(F.when(F.col("kept"), F.col("category")).otherwise(F.lit(other)).alias("category")).agg(F.sum("count").alias("count"))


def to_array(m: DataFrame, keys: list, default: float = math.nan) -> list[float]:
    """The keys' values in their order."""
    found = {r["id"]: r["value"] for r in m.where(F.col("id").isin(keys)).select("id", "value").collect()}
    return [float(found.get(k, default)) for k in keys]
