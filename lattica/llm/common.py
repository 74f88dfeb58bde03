"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one, in local mode alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(column: str, divisor: int):
    """crc32(doc_id as text) mod divisor; a null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(src, dst): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds: each round is two aggregations and two joins on the
    node, so no component is ever gathered in one task; the edge list is checkpointed every round and
    the loop ends when a round changes nothing. Nulls and loops are ignored; an empty input gives no rows.
    """
    cur = cut(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        new = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new = cut(new)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return new.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        cur, state = new, now
