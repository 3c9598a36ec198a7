"""Cutting lineage in the folder that driver and executors share, and ranks over whole tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on a local master, a temporary folder that goes with the session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def settled(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder; Spark deletes the files when nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_rank(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds the row's 0-based rank in a total order, without bringing the rows into one task.

    Rows are range-partitioned and sorted; the only data on the driver is a count for each partition.
    """
    keys = {f"_k{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(order)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(df.withColumns(keys).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    starts, total = [], 0
    for row in placed.groupBy("_part").count().orderBy("_part").collect():
        starts.append((row["_part"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return placed.withColumn("_row", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_part", "_row", "_start", *keys)
