"""Levels: ride segments between the stops of vertical connectors, level bounds, and per-level results of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.geometry import Metric
from spanwright.functions.weights import INFINITE, ride_cost
from spanwright.plans.materialise import with_rank


def ride_pairs(stops: DataFrame) -> DataFrame:
    """Rides between all stops i < j of a connector on different groups, with costs.

    stops(connector_idx, stop_idx, grp, x, y, ordinal, board_cost, per_level_cost, direction). Ordinals are needed
    where a per-level cost or a direction is set, else the row raises. Equal ordinals do not rise.
    """
    keep = ["stop_idx", "grp", "x", "y", "ordinal"]
    one, two = (stops.select("connector_idx", *(F.col(c).alias(f"{c}_{k}") for c in keep), *(["board_cost", "per_level_cost", "direction"] if k == "a" else [])) for k in "ab")
    pairs = one.join(two, "connector_idx").filter("stop_idx_a < stop_idx_b and grp_a <> grp_b")
    needed = (F.col("per_level_cost") > 0) | (F.col("direction") != "both")
    missing = F.col("ordinal_a").isNull() | F.col("ordinal_b").isNull()
    levels = F.when(needed & missing, F.raise_error(F.lit("a ride with a direction or per-level cost needs ordinals")).cast("double")).otherwise(F.coalesce(F.col("ordinal_b") - F.col("ordinal_a"), F.lit(0.0)))
    pairs = pairs.withColumn("levels", levels)
    cost = ride_cost(F.col("board_cost"), F.col("per_level_cost"), F.col("levels"), F.col("direction"), F.col("levels") > 0)
    return pairs.withColumn("w", cost).select("connector_idx", "stop_idx_a", "stop_idx_b", "grp_a", "grp_b", F.col("x_a").alias("ax"), F.col("y_a").alias("ay"), F.col("x_b").alias("bx"), F.col("y_b").alias("by"), "levels", F.col("w.forward").alias("forward"), F.col("w.backward").alias("backward"))


def ride_features(stops: DataFrame, levels: DataFrame | None, first: int) -> DataFrame:
    """The rides between stops as line features, numbered from ``first``, with grp_a, grp_b, forward and backward.

    stops as in ride_pairs; ordinals come from levels(group_key, ordinal), or from stops where they have them.
    A stop's feature_idx, where there is one, is kept as of_feature.
    """
    told = stops.withColumns({"grp": F.col("grp").cast("string"), "of_feature": (F.col("feature_idx") if "feature_idx" in stops.columns else F.lit(None)).cast("long")})
    if "ordinal" not in stops.columns:
        told = told.withColumn("ordinal", F.lit(None).cast("double"))
    if levels is not None:
        known = levels.select(F.col("group_key").alias("grp"), F.col("ordinal").alias("known"))
        told = told.join(known, "grp", "left").withColumn("ordinal", F.coalesce("ordinal", "known")).drop("known")
    of = told.groupBy("connector_idx").agg(F.min("of_feature").alias("of_feature"))
    pairs = with_rank(ride_pairs(told).join(of, "connector_idx"), ["connector_idx", "stop_idx_a", "stop_idx_b"], "n")
    ends = [F.struct(F.col(f"{k}x").cast("double").alias("x"), F.col(f"{k}y").cast("double").alias("y"), F.lit(None).cast("double").alias("z")) for k in "ab"]
    return pairs.select((F.col("n") + first).alias("feature_idx"), "of_feature", F.array(F.array(*ends)).alias("parts"), "grp_a", "grp_b", "forward", "backward")


def point_stops(points: DataFrame) -> DataFrame:
    """Stops of point connectors(connector_idx, x, y, groups ARRAY, board_cost, per_level_cost, direction): one for each group, at least two or the row raises."""
    served = F.when(F.size(F.array_distinct("groups")) >= 2, F.array_distinct("groups")).otherwise(F.raise_error(F.lit("a connector serves at least two groups")).cast("array<string>"))
    return points.select("*", F.posexplode(served).alias("stop_idx", "grp")).drop("groups")


def per_level_bound(runs: DataFrame, scale: float) -> DataFrame:
    """One row, per_level: the least of (cost - scale * chord) / span over connector runs(cost, chord, span), at least 0."""
    return runs.filter("span > 0").agg(F.greatest(F.lit(0.0), F.coalesce(F.min((F.col("cost") - scale * F.col("chord")) / F.col("span")), F.lit(0.0))).alias("per_level"))


def connector_runs(segs: DataFrame, levels: DataFrame, metric: Metric | None = None) -> DataFrame:
    """feature_idx, part, cost, chord, span of connector parts: their cheaper direction, straight distance and difference of ordinals.

    The straight distance is an embedded one, which the metric never falls below.
    """
    ordinal = levels.select(F.col("group_key").alias("g"), "ordinal")
    line = Window.partitionBy("feature_idx", "part").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = segs.withColumns({"g0": F.first("a_grp").over(line), "g1": F.last("b_grp").over(line), "x0": F.first("ax").over(line), "y0": F.first("ay").over(line), "x1": F.last("bx").over(line), "y1": F.last("by").over(line)}).filter("g0 is not null and g1 is not null and g0 <> g1")
    runs = ends.groupBy("feature_idx", "part", "g0", "g1", "x0", "y0", "x1", "y1").agg(F.sum("forward").alias("f"), F.sum("backward").alias("b"))
    runs = runs.join(ordinal.select(F.col("g").alias("g0"), F.col("ordinal").alias("o0")), "g0").join(ordinal.select(F.col("g").alias("g1"), F.col("ordinal").alias("o1")), "g1")
    chord = (metric or Metric()).straight(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return runs.withColumn("cost", F.least("f", "b")).filter(F.col("cost") < F.lit(INFINITE)).select("feature_idx", "part", "cost", chord.alias("chord"), F.abs(F.col("o1") - F.col("o0")).alias("span"))


def elevations(segs: DataFrame, levels: DataFrame) -> DataFrame:
    """segs with elevation_a and elevation_b: a group's own height, inside a connector interpolated by length between its ends.

    A connector without length, such as a lift, has its ends' heights.
    """
    height = levels.select(F.col("group_key").alias("g"), "elevation")
    line = Window.partitionBy("feature_idx", "part").orderBy("seg_idx")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = segs.withColumns({"g0": F.first("a_grp").over(whole), "g1": F.last("b_grp").over(whole), "done": F.sum("length").over(line), "all": F.sum("length").over(whole)})
    run = run.join(height.select(F.col("g").alias("g0"), F.col("elevation").alias("e0")), "g0", "left").join(height.select(F.col("g").alias("g1"), F.col("elevation").alias("e1")), "g1", "left")

    def at(done: F.Column) -> F.Column:
        return F.when(F.col("g0") == F.col("g1"), F.col("e0")).otherwise(F.col("e0") + (F.col("e1") - F.col("e0")) * done / F.nullif(F.col("all"), F.lit(0.0)))

    own = [height.select(F.col("g").alias(f"{k}_grp"), F.col("elevation").alias(f"e_{k}")) for k in "ab"]
    run = run.join(own[0], "a_grp", "left").join(own[1], "b_grp", "left")
    run = run.withColumns({"elevation_a": F.coalesce("e_a", at(F.col("done") - F.col("length"))), "elevation_b": F.coalesce("e_b", at(F.col("done")))}).drop("e_a", "e_b")
    return run.drop("g0", "g1", "done", "all", "e0", "e1")


def transitions(steps: DataFrame) -> DataFrame:
    """Changes of group along paths: route_id, transition, from_grp, to_grp, start_seq, end_seq.

    steps(route_id, seq, grp) are path points in order; null grp is inside a connector. A transition goes from the
    last point of a group to the first of the next.
    """
    line = Window.partitionBy("route_id").orderBy("seq")
    known = steps.filter("grp is not null").select("route_id", "seq", "grp", F.lag("grp").over(line).alias("from_grp"), F.lag("seq").over(line).alias("start_seq")).filter("from_grp <> grp")
    return known.select("route_id", (F.row_number().over(line) - 1).alias("transition"), "from_grp", F.col("grp").alias("to_grp"), "start_seq", F.col("seq").alias("end_seq"))


def level_lines(steps: DataFrame) -> DataFrame:
    """The path cut by group: route_id, line, grp (null in a connector), points, n_points, in order.

    steps(route_id, seq, grp, x, y). A connector's line begins and ends at the points of the groups that it joins.
    """
    line = Window.partitionBy("route_id").orderBy("seq")
    changed = (~F.col("grp").eqNullSafe(F.lag("grp").over(line))) | (F.lag("seq").over(line).isNull())
    marked = steps.withColumn("line", F.sum(changed.cast("int")).over(line) - 1)
    return marked.groupBy("route_id", "line").agg(F.first("grp").alias("grp"), F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("points"), F.count("*").alias("n_points"))


def vertical_distance(steps: DataFrame) -> DataFrame:
    """route_id and the sum of |dz| between successive points of which both heights are known: steps(route_id, seq, z)."""
    line = Window.partitionBy("route_id").orderBy("seq")
    return steps.withColumn("dz", F.abs(F.col("z") - F.lag("z").over(line))).groupBy("route_id").agg(F.coalesce(F.sum("dz"), F.lit(0.0)).alias("vertical_distance"))
