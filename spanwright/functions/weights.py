"""Segment weights: normalisation and presets, all Column expressions over (forward, backward) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def normalised(weight: Column, free_zero: bool = False) -> Column:
    """A passable cost, or infinity: null, NaN, infinite and (unless ``free_zero``) zero are impassable; negative raises."""
    value = weight.cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (value < F.lit(INFINITE)) & ((value > 0) | (F.lit(free_zero) & (value == 0)))
    return F.when(value < 0, F.raise_error(F.concat(F.lit("negative weight "), value.cast("string"))).cast("double")).when(good, value).otherwise(F.lit(INFINITE))


def both(cost: Column) -> Column:
    return F.struct(cost.cast("double").alias("forward"), cost.cast("double").alias("backward"))


def directional(cost: Column, direction: Column) -> Column:
    """The cost on the sides that direction names: both, forward, backward or none."""
    value, nothing = cost.cast("double"), F.lit(None).cast("double")
    return F.struct(F.when(direction.isin("both", "forward"), value).otherwise(nothing).alias("forward"), F.when(direction.isin("both", "backward"), value).otherwise(nothing).alias("backward"))


def by_property(length: Column, factor: Column) -> Column:
    """Length times a factor; a null factor is impassable."""
    return both(length * factor)


def by_speed(length: Column, kmh: Column) -> Column:
    """Seconds at a speed in km/h; null or non-positive speed is impassable."""
    return both(F.when(kmh > 0, length / (kmh / 3.6)))


def osm_direction(oneway: Column, junction: Column) -> Column:
    """both, forward or backward from the tags oneway and junction (values are case-sensitive)."""
    tag = oneway.cast("string")
    return (
        F.when(tag.isin("-1", "reverse"), "backward")
        .when(tag.isin("yes", "true", "1"), "forward")
        .when(tag.isin("no", "false", "0"), "both")
        .when(junction.isin("roundabout", "circular"), "forward")
        .otherwise("both")
    )


def ride_cost(board: Column, per_level: Column, levels: Column, direction: Column, rising: Column) -> Column:
    """(forward, backward) costs of a connector ride between two stops; the forbidden direction is infinite."""
    cost = board + per_level * F.abs(levels)
    up = F.when(direction == "down", F.lit(INFINITE)).otherwise(cost)
    down = F.when(direction == "up", F.lit(INFINITE)).otherwise(cost)
    return F.struct(F.when(rising, up).otherwise(down).alias("forward"), F.when(rising, down).otherwise(up).alias("backward"))
