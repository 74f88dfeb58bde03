"""Cutting the lineage of iterative plans, and numbering rows without gathering them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import GraphError


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder of spark.checkpoint.dir, which all executors share; a temporary one in local mode alone."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise GraphError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """df with its rows' places from 0 in the given order.

    Rows are sorted in range partitions; only the partitions' sizes, as many as partitions, meet in one task.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    heads = sizes.withColumn("_head", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(heads), "_part").withColumn(name, (F.col("_own") - 1 + F.coalesce("_head", F.lit(0))).cast("long")).drop("_part", "_own", "_head")
