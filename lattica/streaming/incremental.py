"""Streams of edges or events as growing graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """(id, value): running degrees of a stream of edges(src, dst); for complete or update output."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("value"))


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, id, value): events(ts, src) counted by tumbling windows; later rows than `late` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "src").agg(F.count("*").alias("value"))
    return w.select(F.col("window.start").alias("start"), F.col("src").alias("id"), "value")
