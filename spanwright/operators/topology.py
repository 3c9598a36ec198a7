"""From features to vertices and segments: coordinates, groups, merging by position, tolerance or node id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.geometry import Metric, cell, ruler_scales
from spanwright.operators.components import components
from spanwright.plans.materialise import settled, with_rank


def _in_part():
    return Window.partitionBy("feature_idx", "part").orderBy("idx")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def coordinates(features: DataFrame, group: Column | None = None, end_group: Column | None = None, node_id: Column | None = None) -> DataFrame:
    """feature_idx, part, idx, x, y, z, valid, run, grp, node_key of every position of the line features.

    run counts the invalid positions before: they break a line and are never bridged. ``group`` and ``end_group``
    are expressions over a feature's columns. Where they differ the feature is a connector: its first position
    belongs to the one, its last valid one to the other, and grp of those between is null, which merges with
    nothing. ``node_id`` is an expression over x, y, idx, size (the part's positions) and the feature's columns.
    """
    start = (group if group is not None else F.lit("")).cast("string")
    end = end_group.cast("string") if end_group is not None else start
    rows = features.filter(F.col("parts").isNotNull()).withColumns({"_start": start, "_end": end})
    rows = rows.select("*", F.posexplode("parts").alias("part", "_line")).withColumn("size", F.size("_line"))
    rows = rows.select("*", F.posexplode("_line").alias("idx", "_at")).withColumns({"x": F.col("_at.x") + 0.0, "y": F.col("_at.y") + 0.0, "z": F.col("_at.z")})
    rows = rows.withColumn("valid", finite(F.col("x")) & finite(F.col("y")))
    rows = rows.withColumn("node_key", (node_id if node_id is not None else F.lit(None)).cast("string"))
    rows = rows.select("feature_idx", "part", "idx", "size", "x", "y", "z", "valid", "_start", "_end", "node_key")
    rows = rows.withColumn("run", F.coalesce(F.sum((~F.col("valid")).cast("int")).over(_in_part().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if end_group is None:
        return rows.withColumn("grp", F.col("_start")).drop("_start", "_end")
    whole = Window.partitionBy("feature_idx", "part")
    last = F.max(F.when(F.col("valid"), F.col("idx"))).over(whole)
    grp = F.when(F.col("_start").eqNullSafe(F.col("_end")) | (F.col("idx") == 0), F.col("_start")).when(F.col("idx") == last, F.col("_end"))
    return rows.withColumn("grp", grp).drop("_start", "_end")


def extent(coords: DataFrame) -> DataFrame:
    """One row: count and bounding box of the valid positions."""
    return coords.filter("valid").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def check_geographic(coords: DataFrame) -> None:
    """Raises ValueError beyond +-180/+-90 degrees, or where a part's successive valid longitudes differ by over 180, an invalid position between them or not."""
    box = extent(coords).first()
    if box["n"] and (box["min_x"] < -180 or box["max_x"] > 180 or box["min_y"] < -90 or box["max_y"] > 90):
        raise ValueError("coordinates lie outside longitude and latitude")
    jump = F.abs(F.col("x") - F.lag("x").over(_in_part())) > 180
    if coords.filter("valid").withColumn("jump", jump).filter("jump").limit(1).count():
        raise ValueError("a line crosses the antimeridian")


def exact_vertices(coords: DataFrame) -> DataFrame:
    """coords with vertex: positions of one group with equal x and y share it; the first seen gives its place and z.

    vertex is the rank of the first position's (feature_idx, part, idx). A connector's inner position stands alone
    except that an immediate repeat takes the vertex before it.
    """
    keyed, keys = _keyed(coords)
    firsts = keyed.groupBy(*keys).agg(F.min(F.struct("ord", "z")).alias("_first"))
    ranked = with_rank(firsts.select(*keys, F.col("_first.ord").alias("_ord"), F.col("_first.z").alias("vz")), ["_ord"], "vertex")
    return keyed.join(ranked, keys).select(*(c for c in coords.columns), "vertex", F.col("x").alias("vx"), F.col("y").alias("vy"), "vz", F.col("_ord").alias("vertex_ord"))


def keyed_vertices(coords: DataFrame) -> DataFrame:
    """coords with the vertices of ``exact_vertices``, named by their group and place in place of a number.

    For what only asks whether vertices are the same: nothing is ranked and no position leaves its line. The height
    is each position's own.
    """
    keyed, keys = _keyed(coords)
    return keyed.select(*(c for c in coords.columns), F.struct(*keys).alias("vertex"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))


def place_name(grp: Column, x: Column, y: Column) -> Column:
    """The name of ``keyed_vertices`` for a vertex of a group at a place."""
    return F.struct(grp.alias("_grp"), x.alias("x"), y.alias("y"), F.lit("").alias("_lone"))


def _keyed(coords: DataFrame) -> tuple[DataFrame, list[str]]:
    """The valid positions with ord, and the columns that are equal for those of one vertex."""
    valid = coords.filter("valid").withColumn("ord", F.struct("feature_idx", "part", "idx"))
    before = {k: F.lag(k).over(Window.partitionBy("feature_idx", "part", "run").orderBy("idx")) for k in ("x", "y")}
    fresh = F.coalesce((F.col("x") != before["x"]) | (F.col("y") != before["y"]), F.lit(True))
    lone = F.when(F.col("grp").isNull(), F.sum(fresh.cast("int")).over(Window.partitionBy("feature_idx", "part").orderBy("idx")))
    keyed = valid.withColumn("_lone", F.when(F.col("grp").isNull(), F.concat_ws("/", "feature_idx", "part", lone)).otherwise(F.lit("")))
    return keyed.withColumn("_grp", F.coalesce("grp", F.lit("\u0000connector"))), ["_grp", "x", "y", "_lone"]


def merged_vertices(coords: DataFrame, metric: Metric, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """coords with merged vertices, and the log of merges (x, y, gap).

    Positions are visited in order; each takes the nearest vertex of its group within the tolerance (ties: the
    earliest), else makes one; with node ids, equal keys of a group are one vertex wherever they lie, and a
    different key is never merged. That depends on the order, so only clusters of positions that can reach each
    other are replayed, each in one task; a cluster is a few neighbouring positions unless the tolerance is wrong
    for the data.
    """
    exact = settled(exact_vertices(coords))
    points = exact.groupBy("vertex", "grp", "vx", "vy").agg(F.min(F.struct("vertex_ord", "node_key")).alias("m"), F.collect_set("node_key").alias("keys"))
    points = settled(points.select("vertex", "grp", "vx", "vy", F.col("m.vertex_ord").alias("ord"), F.col("m.node_key").alias("node_key")).filter(F.col("grp").isNotNull()))
    links = points.groupBy("grp", "node_key").agg(F.min("vertex").alias("a")).filter("node_key is not null").join(points, ["grp", "node_key"]).select("a", F.col("vertex").alias("b"))
    if tolerance > 0:
        size = _cell_size(metric, tolerance)
        celled = points.withColumns({"i": cell(F.col("vx"), size), "j": cell(F.col("vy"), size)})
        # of two neighbouring cells one asks the other
        half = F.array(*(F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.lit(di == dj == 0).alias("same")) for di, dj in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
        around = celled.select("vertex", "grp", "vx", "vy", F.explode(half).alias("c")).select("vertex", "grp", "vx", "vy", "c.*")
        other = celled.select(F.col("vertex").alias("b"), "grp", F.col("vx").alias("bx"), F.col("vy").alias("by"), "i", "j")
        near = around.join(other, ["grp", "i", "j"]).filter("not same or vertex < b").filter(metric.distance(F.col("vx"), F.col("vy"), F.col("bx"), F.col("by")) <= tolerance)
        links = links.unionByName(near.select(F.col("vertex").alias("a"), "b"))
    clusters = components(links).withColumnRenamed("node", "vertex")
    clustered = points.join(clusters, "vertex").repartition("component").sortWithinPartitions("component", "ord")
    replayed = settled(clustered.select("component", "vertex", "grp", "vx", "vy", "node_key").mapInArrow(_replay(metric, tolerance), "vertex long, root long, rx double, ry double, gap double"))
    roots = exact.select(F.col("vertex").alias("root"), F.col("vz").alias("rz"), F.col("vertex_ord").alias("r_ord")).dropDuplicates(["root"])
    moved = exact.join(replayed, "vertex", "left").join(roots, "root", "left")
    out = moved.select(*coords.columns, F.coalesce("root", "vertex").alias("vertex"), F.coalesce("rx", "vx").alias("vx"), F.coalesce("ry", "vy").alias("vy"), F.when(F.col("root").isNotNull(), F.col("rz")).otherwise(F.col("vz")).alias("vz"), F.coalesce("r_ord", "vertex_ord").alias("vertex_ord"))
    log = replayed.filter("root <> vertex").join(points.select("vertex", F.col("vx").alias("x"), F.col("vy").alias("y")), "vertex").select("vertex", "root", "x", "y", "gap")
    return out, log


def _cell_size(metric: Metric, tolerance: float) -> float:
    """A cell that is at least as wide as the tolerance; in degrees, up to 85 degrees of latitude."""
    return tolerance / ruler_scales(85.0)[0] if metric.geographic else tolerance


def _replay(metric: Metric, tolerance: float):
    """Merges of clusters, which follow on each other with their positions in order."""

    def run(batches):
        import pyarrow as pa

        cluster, made = None, []
        for batch in batches:
            out = []
            for component, vertex, grp, x, y, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != cluster:
                    cluster, made = component, []
                root = next((m for m in made if key is not None and m["key"] == key and m["grp"] == grp), None)
                if root is None:
                    best = None
                    for m in made:
                        if m["grp"] == grp and (key is None or m["key"] is None):
                            d = metric.distance_py(x, y, m["x"], m["y"])
                            if d <= tolerance and (best is None or d < best[0]):
                                best = (d, m)
                    root = best[1] if best else None
                if root is None:
                    root = {"vertex": vertex, "x": x, "y": y, "grp": grp, "key": key}
                    made.append(root)
                elif key is not None and root["key"] is None:
                    root["key"] = key
                out.append((vertex, root["vertex"], root["x"], root["y"], metric.distance_py(x, y, root["x"], root["y"])))
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["vertex", "root", "rx", "ry", "gap"])

    return run


def segments(placed: DataFrame, metric: Metric) -> DataFrame:
    """feature_idx, part, seg_idx, run, a, b, their places and groups, and length, of coords with vertices.

    Successive valid positions of a part make a segment unless both are one vertex. length is between the merged
    vertices' places. seg_idx is the index of its first position.
    """
    line = _in_part()  # a run ends where an index is left out, so that runs need not be counted
    cols = {"a": "vertex", "ax": "vx", "ay": "vy", "az": "vz", "a_grp": "grp"}
    rows = placed.select("feature_idx", "part", F.col("idx").alias("seg_idx"), "run", *(F.col(v).alias(k) for k, v in cols.items()), *(F.lead(v).over(line).alias("b" + k[1:]) for k, v in cols.items()), F.lead("idx").over(line).alias("_next"))
    rows = rows.filter("_next = seg_idx + 1 and a <> b").drop("_next")
    return rows.withColumn("length", metric.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))


def with_measures(segs: DataFrame) -> DataFrame:
    """Adds measure_start and measure_end, the running length along a feature's part, across invalid positions too."""
    line = Window.partitionBy("feature_idx", "part").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segs.withColumn("measure_end", F.sum("length").over(line)).withColumn("measure_start", F.col("measure_end") - F.col("length"))


def with_runs(segs: DataFrame) -> DataFrame:
    """Adds part_run: it rises where a segment does not begin at the vertex where the one before ended."""
    line = Window.partitionBy("feature_idx", "part").orderBy("seg_idx")
    broken = F.coalesce(F.col("a") != F.lag("b").over(line), F.lit(True)).cast("int")
    return segs.withColumn("part_run", F.sum(broken).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def build_stats(features: DataFrame, coords: DataFrame, segs: DataFrame) -> DataFrame:
    """One row: features, line_features, skipped_features, invalid_coordinates, segments."""
    a = features.agg(F.count("*").alias("features"), F.count("parts").alias("line_features")).withColumn("skipped_features", F.col("features") - F.col("line_features"))
    b = coords.agg(F.coalesce(F.sum((~F.col("valid")).cast("long")), F.lit(0)).alias("invalid_coordinates"))
    c = segs.agg(F.count("*").alias("segments"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").join(c.select("*", one), "one").drop("one")
