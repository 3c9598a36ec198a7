"""Networks derived from the driver's tables: a road-like grid, trajectories and stacked levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import weights
from spanwright.plans.graph import Graph, Options, build
from spanwright.sources.geojson import features_from_segments

#: Vertices of a grid row; every so-manieth column is a street.
WIDTH, STREET = 50, 5
_built: dict[tuple[str, str, str], Graph] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_idx, id, ax, ay, bx, by, a, b, factor, direction, row_id of the grid's segments, one feature each.

    Part p lies at (p mod 50, p div 50); rows link p to p + 1, streets p to p + 50. The factor is p_size of the
    start; parts divisible by 7 are one-way, sizes divisible by 17 are blocked.
    """
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_size").alias("factor"))
    known = part.select(F.col("a").alias("b"))
    x, y = F.col("a") % WIDTH, F.floor(F.col("a") / WIDTH)
    row = part.filter(x < WIDTH - 1).withColumns({"b": F.col("a") + 1, "kind": F.lit(0)})
    street = part.filter(x % STREET == 0).withColumns({"b": F.col("a") + WIDTH, "kind": F.lit(1)})
    both = row.unionByName(street).join(known, "b", "left_semi")
    bx, by = F.col("b") % WIDTH, F.floor(F.col("b") / WIDTH)
    row_id = F.when(F.col("kind") == 0, F.concat(F.lit("r"), y.cast("string"), F.lit("_"), F.floor(x / 10).cast("string"))).otherwise(F.concat(F.lit("c"), x.cast("string")))
    direction = F.when(F.col("factor") % 17 == 0, "none").when(F.col("a") % 7 == 0, "forward").otherwise("both")
    return both.select((F.col("a") * 2 + F.col("kind")).alias("feature_idx"), F.concat(F.lit("s:"), row_id).alias("id"), x.cast("double").alias("ax"), y.cast("double").alias("ay"), bx.cast("double").alias("bx"), by.cast("double").alias("by"), "a", "b", "factor", direction.alias("direction"), row_id.alias("row_id"))


def grid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid_rows(spark, sf_dir)
    return features_from_segments(rows.withColumn("props", F.struct("factor", "direction", "row_id")))


def braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two short lines a part, which cross, touch and overlap those of its neighbours only: parts' lattice as in the grid.

    Feature 2p is a rising diagonal for even sizes, else a level line of one and a half that overlaps the next one's;
    2p + 1 is a falling diagonal for sizes that 3 does not divide, else an upright line.
    """
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), (F.col("p_partkey") % WIDTH).cast("double").alias("x"), F.floor(F.col("p_partkey") / WIDTH).cast("double").alias("y"), F.col("p_size").alias("size"))
    x, y, even, other = F.col("x"), F.col("y"), F.col("size") % 2 == 0, F.col("size") % 3 != 0

    def line(n: int, straight: F.Column, one: tuple, two: tuple) -> F.Column:
        at = [F.when(straight, a).otherwise(b) for a, b in zip(one, two, strict=True)]
        return F.struct((F.col("p") * 2 + n).alias("feature_idx"), *(c.alias(k) for c, k in zip(at, ("ax", "ay", "bx", "by"), strict=True)))

    both = F.array(line(0, even, (x, y, x + 1, y + 1), (x, y + 0.5, x + 1.5, y + 0.5)), line(1, other, (x + 1, y, x, y + 1), (x + 0.25, y, x + 0.25, y + 1)))
    return part.select(F.explode(both).alias("l")).select("l.*", F.concat(F.lit("s:"), F.col("l.feature_idx").cast("string")).alias("id"))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Graph]) -> Graph:
    """A network of that name, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def grid(spark: SparkSession, sf_dir: str, compact: bool = True) -> Graph:
    """The grid's network, with costs of factor times length."""
    cost = weights.directional(F.col("length") * F.col("props.factor"), F.col("props.direction"))
    return kept(spark, sf_dir, f"grid{compact}", lambda: build(grid_features(spark, sf_dir), Options(weight=cost, compact=compact)))
