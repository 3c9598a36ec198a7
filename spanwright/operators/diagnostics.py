"""Data quality of a network: loose ends, near misses, overlaps, crossings, components and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.geometry import Metric
from spanwright.operators.repair import _identified, cell_size, celled, loose_ends, near_segments
from spanwright.plans.graph import Graph


def dangles(segs: DataFrame) -> DataFrame:
    """vertex, x, y, feature_idx of vertices with exactly one segment end (a loop has two)."""
    return loose_ends(segs).select("vertex", "x", "y", "feature_idx")


def near_misses(segs: DataFrame, metric: Metric, distance: float = 1.0) -> DataFrame:
    """Loose ends within the distance of a segment that they do not touch: vertex, x, y, feature_a, feature_b, gap."""
    if distance < 0:
        raise ValueError("the distance is not negative")
    return near_segments(loose_ends(segs), segs, metric, distance).select("vertex", "x", "y", F.col("feature_idx").alias("feature_a"), F.col("seg_feature").alias("feature_b"), "gap")


def overlaps(segs: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Pairs of collinear segments of one group that share more than a point: feature_a, feature_b, length."""
    flat = segs.filter(F.col("a_grp").eqNullSafe(F.col("b_grp")) & F.col("a_grp").isNotNull())
    wide = celled(_identified(flat).select("sid", "feature_idx", "ax", "ay", "bx", "by", F.col("a_grp").alias("grp")), cell_size(segs), eps)
    names = ("sid", "feature_idx", "ax", "ay", "bx", "by")
    one, two = (wide.select("grp", "i", "j", *(F.col(n).alias(f"{n}{k}") for n in names)) for k in (1, 2))
    dx, dy = F.col("bx1") - F.col("ax1"), F.col("by1") - F.col("ay1")
    size = F.sqrt(dx * dx + dy * dy)

    def off(x: str, y: str) -> F.Column:
        return F.abs(dx * (F.col(y) - F.col("ay1")) - dy * (F.col(x) - F.col("ax1"))) / size

    def at(x: str, y: str) -> F.Column:
        return (dx * (F.col(x) - F.col("ax1")) + dy * (F.col(y) - F.col("ay1"))) / size

    s, e = at("ax2", "ay2"), at("bx2", "by2")
    shared = F.least(size, F.greatest(s, e)) - F.greatest(F.lit(0.0), F.least(s, e))
    # not broadcast, as in repair.intersections
    pairs = one.join(two.hint("merge"), ["grp", "i", "j"]).filter("sid1 < sid2").filter((off("ax2", "ay2") <= eps) & (off("bx2", "by2") <= eps))
    found = pairs.withColumn("length", shared).filter(F.col("length") > eps).dropDuplicates(["sid1", "sid2"])
    return found.select(F.col("feature_idx1").alias("feature_a"), F.col("feature_idx2").alias("feature_b"), F.col("sid1.seg_idx").alias("seg_a"), F.col("sid2.seg_idx").alias("seg_b"), "length")


def invalid_coordinates(coords: DataFrame) -> DataFrame:
    return coords.filter("not valid").select("feature_idx", "part", "idx")


def component_boxes(graph: Graph) -> DataFrame:
    """component, nodes, length, largest, and the bounding box of its segments."""
    label = graph.nodes.select(F.col("node").alias("from_node"), "component")
    box = graph.segments.join(label, "from_node").groupBy("component").agg(F.min(F.least("ux", "vx")).alias("min_x"), F.min(F.least("uy", "vy")).alias("min_y"), F.max(F.greatest("ux", "vx")).alias("max_x"), F.max(F.greatest("uy", "vy")).alias("max_y"))
    return graph.component_summary().join(box, "component", "left")


def limited(rows: DataFrame, order: list[str], limit: int = 1000) -> DataFrame:
    """The first rows of an order with the total and whether the list is cut; a report's limit, not a sample."""
    ranked = rows.withColumn("_n", F.lit(1))
    total = ranked.groupBy("_n").agg(F.count("*").alias("total"))
    return ranked.orderBy(*order).limit(limit).join(F.broadcast(total), "_n").drop("_n").withColumn("truncated", F.col("total") > limit)


def level_reachability(graph: Graph) -> DataFrame:
    """grp, reaches, isolated: the other groups with which a group shares a component."""
    label = graph.nodes.select(F.col("node").alias("from_node"), "component")
    labels = graph.segments.join(label, "from_node").select(F.explode(F.array("u_grp", "v_grp")).alias("grp"), "component").filter("grp is not null").distinct()
    pairs = labels.join(labels.withColumnRenamed("grp", "other"), "component").filter("grp <> other").groupBy("grp").agg(F.array_sort(F.collect_set("other")).alias("reaches"))
    out = labels.select("grp").distinct().join(pairs, "grp", "left")
    return out.select("grp", F.coalesce("reaches", F.array().cast("array<string>")).alias("reaches"), F.col("reaches").isNull().alias("isolated"))


def missing_ordinals(graph: Graph, levels: DataFrame) -> DataFrame:
    """Groups of alive segments without an ordinal in levels(group_key, ordinal)."""
    live = graph.vertices.filter("grp is not null").select("grp").distinct()
    known = levels.filter("ordinal is not null and not isnan(ordinal)").select(F.col("group_key").alias("grp"))
    return live.join(known, "grp", "left_anti")


def connector_ends(segs: DataFrame) -> DataFrame:
    """Ends of connector segments (two groups) that touch no segment of the end's own group: vertex, x, y, grp."""
    crossing = segs.filter(~F.col("a_grp").eqNullSafe(F.col("b_grp")))
    ends = crossing.select(F.explode(F.array(*(F.struct(F.col(k).alias("vertex"), F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y"), F.col(f"{k}_grp").alias("grp")) for k in "ab"))).alias("e")).select("e.*").filter("grp is not null").dropDuplicates(["vertex"])
    flat = segs.filter(F.col("a_grp").eqNullSafe(F.col("b_grp"))).select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    return ends.join(flat, "vertex", "left_anti")


def measure_gaps(segs: DataFrame) -> DataFrame:
    """Parts whose segments do not follow on each other: feature_idx, part, runs."""
    line = Window.partitionBy("feature_idx", "part").orderBy("seg_idx")
    return segs.withColumn("gap", (F.col("a") != F.lag("b").over(line)).cast("int")).groupBy("feature_idx", "part").agg((F.sum(F.coalesce("gap", F.lit(0))) + 1).alias("runs")).filter("runs > 1")
