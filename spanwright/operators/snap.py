"""Nearest places on a network: k-nearest segments, vertices or nodes by a grid join with growing cells.

Points and segments meet in equi-joins on grid cells. A point is finished when its k-th place is no farther than the
cells around it reach; the others go on to cells twice as wide, until one block covers the network. Points never
meet all segments, except where the network itself is that small against the distance. Points at one spot ask once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.geometry import along, cell, side
from spanwright.functions.weights import INFINITE
from spanwright.plans.graph import Graph
from spanwright.plans.materialise import settled

MODES = ("edge", "vertex", "node", "exact")
DISTINCT = ("chain", "feature", "component")
#: Points, and rows of places, that are sent to all tasks rather than shuffled.
FEW_POINTS, FEW_PLACES = 20_000, 1 << 16


@dataclass(frozen=True)
class Snap:
    """Which places count, and how many.

    group: an expression over the point's columns that a place's grp must equal. allowed: an expression over the
    candidate's and the point's columns. distinct_by: at most one place of each chain (and feature of it; of each
    node, at nodes), feature or component. search_limit: so many nearest segments or points are looked at, whether
    they count or not. candidates is 1 by default, 4 for optimal selection.
    """

    mode: str = "edge"
    candidates: int | None = None
    max_distance: float = INFINITE
    max_relocation: float = INFINITE
    group: Column | None = None
    feature_ids: list[int] | None = None
    allowed: Column | None = None
    distinct_by: str = "chain"
    search_limit: int = 64

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown snap mode {self.mode!r}")
        if self.candidates is not None and not 1 <= self.candidates <= 16:
            raise ValueError("candidates is between 1 and 16")
        if self.search_limit < 1:
            raise ValueError("search_limit is at least 1")
        if not self.max_distance >= 0 or not self.max_relocation >= 0:
            raise ValueError("distances are not negative")
        if self.distinct_by not in DISTINCT:
            raise ValueError(f"cannot tell candidates apart by {self.distinct_by!r}")


PLACE = ["chain_id", "pos", "seg_id", "feature_idx", "part", "grp", "component", "node", "x", "y", "distance", "side", "measure"]


def candidates(graph: Graph, points: DataFrame, snap: Snap | None = None) -> DataFrame:
    """points(point_id, x, y, ...) with their places: rank, distance, x/y on the network, chain_id and pos, and more.

    Rank 0 is the nearest; ties go by (distance, feature, part, segment). pos counts the chain's segments before
    the place, with a fraction; node is the node there, if it is one. measure and side are along and beside the
    feature as digitised. A point without a place within the limits has no row.
    """
    snap = snap or Snap()
    targets = _targets(graph, snap)
    asked = points.withColumnsRenamed({"x": "px", "y": "py"}).withColumn("want", snap.group.cast("string") if snap.group is not None else F.lit(None).cast("string"))
    if snap.group is not None:
        asked = asked.filter("want is not null")
    ranked = _exact(asked, targets) if snap.mode == "exact" else _nearest(graph, asked, targets, snap)
    return ranked


def _targets(graph: Graph, snap: Snap) -> DataFrame:
    """The segments, or points, that can be snapped to, in one shape."""
    label = graph.nodes.select(F.col("node").alias("from_node"), "component")
    segs = graph.segments.join(label, "from_node")
    if snap.feature_ids is not None:
        segs = segs.filter(F.col("feature_idx").isin(*snap.feature_ids))
    segs = segs.withColumn("grp", F.when(F.col("u_grp").eqNullSafe(F.col("v_grp")), F.col("u_grp")))
    if snap.mode == "edge":
        return segs
    ends = []
    for k, shift in (("u", 0), ("v", 1)):
        ends.append(segs.select(F.col(k).alias("vertex"), *(F.col(f"{k}{c}").alias(f"u{c}") for c in "xy"), *(F.col(f"{k}{c}").alias(f"v{c}") for c in "xy"), (F.col("pos") + shift).alias("pos"), F.col(f"{k}_grp").alias("grp"), F.col(f"{k}_measure").alias("u_measure"), F.col(f"{k}_measure").alias("v_measure"), "chain_id", "seg_id", "feature_idx", "part", "seg_idx", "component", "reversed"))
    both = ends[0].unionByName(ends[1])
    fields = [c for c in both.columns if c != "vertex"]
    places = both.groupBy("vertex").agg(F.min(F.struct("feature_idx", "part", "seg_idx", "pos", *(c for c in fields if c not in ("feature_idx", "part", "seg_idx", "pos")))).alias("p")).select("vertex", "p.*")
    if snap.mode == "node":
        places = places.join(graph.nodes.select(F.col("node").alias("vertex")), "vertex", "left_semi")
    return places


def _exact(asked: DataFrame, targets: DataFrame) -> DataFrame:
    at = targets.select(F.col("ux").alias("px"), F.col("uy").alias("py"), "vertex", "chain_id", "pos", "seg_id", "feature_idx", "part", "grp", "component", F.col("u_measure").alias("measure"))
    hit = asked.join(at, ["px", "py"]).filter(F.col("want").isNull() | (F.col("want") == F.col("grp")))
    first = Window.partitionBy("point_id").orderBy("vertex")
    return hit.withColumn("rank", F.row_number().over(first) - 1).filter("rank = 0").withColumns({"distance": F.lit(0.0), "x": F.col("px"), "y": F.col("py"), "side": F.lit("on"), "pos": F.col("pos").cast("double")})


def _nearest(graph: Graph, asked: DataFrame, targets: DataFrame, snap: Snap) -> DataFrame:
    """Places of points. What a point finds depends on its spot alone, unless ``allowed`` looks at its other columns."""
    targets = settled(targets)
    spot = ["px", "py", "want"]
    if not _by_spot(targets, snap):
        return _grown(graph, asked, targets, snap)
    spots = settled(asked.select(*spot).distinct().withColumn("point_id", F.monotonically_increasing_id()))
    found = settled(_grown(graph, spots, targets, snap).drop("point_id").withColumnsRenamed({c: f"_{c}" for c in spot}))
    few = F.broadcast(found) if found.count() <= FEW_PLACES else found
    same = (F.col("px") == F.col("_px")) & (F.col("py") == F.col("_py")) & F.col("want").eqNullSafe(F.col("_want"))
    return asked.join(few, same).drop(*(f"_{c}" for c in spot))


def _by_spot(targets: DataFrame, snap: Snap) -> bool:
    """Whether ``allowed`` is an expression over the candidate's columns and the point's spot."""
    if snap.allowed is None:
        return True
    seen = targets.withColumns({c: F.lit(0.0) for c in ("px", "py", "t", "x", "y", "measure", "distance")} | {c: F.lit("") for c in ("want", "side")})
    try:
        return len(seen.select(snap.allowed).columns) == 1
    except AnalysisException:
        return False


def _grown(graph: Graph, asked: DataFrame, targets: DataFrame, snap: Snap) -> DataFrame:
    """The places of each point, by cells that grow until they are known to hold them."""
    box = targets.agg(F.count("*").alias("n"), F.min(F.least("ux", "vx")).alias("x0"), F.max(F.greatest("ux", "vx")).alias("x1"), F.min(F.least("uy", "vy")).alias("y0"), F.max(F.greatest("uy", "vy")).alias("y1"), F.avg(F.greatest(F.abs(F.col("ux") - F.col("vx")), F.abs(F.col("uy") - F.col("vy")))).alias("w")).first()
    if not box["n"]:
        return _shaped(asked.limit(0), targets.limit(0), graph, snap).drop("counts", "scanned", "scan_distance")
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]
    span = max(wide, high, 1e-9)
    # cells of about one segment each; more places need more of them
    size = max(box["w"], (wide * high / box["n"]) ** 0.5, 1e-9) * (1 if (snap.candidates or 1) == 1 else 2 if snap.candidates <= 4 else 4)
    left, out = asked, None
    while True:
        last = size >= 2 * span
        around = _around(left, size, last)
        found = settled(_shaped(F.broadcast(around) if left.limit(FEW_POINTS + 1).count() <= FEW_POINTS else around, _covered(targets, size, last), graph, snap))
        if last:
            part = found
        else:
            # what lies outside the block of cells around a point is at least one cell away
            sx, sy = (c if graph.metric.geographic else F.lit(1.0) for c in graph.metric.scales(F.col("py")))
            reach = F.least(sx, sy) * size * (1 - 1e-9)
            far = found.groupBy("point_id").agg(F.count(F.when(F.col("counts"), 1)).alias("n"), F.max(F.when(F.col("counts"), F.col("distance"))).alias("d"), F.max("scanned").alias("scanned"), F.max("scan_distance").alias("scan_distance"))
            enough = (F.coalesce("n", F.lit(0)) >= (snap.candidates or 1)) & (F.col("d") <= reach)
            spent = (F.col("scanned") >= snap.search_limit) & (F.col("scan_distance") <= reach)
            done = settled(left.join(far, "point_id", "left").filter(enough | spent | (F.lit(float(snap.max_distance)) <= reach)).select("point_id"))
            part = found.join(done, "point_id", "left_semi")
        part = part.filter("counts").drop("counts", "scanned", "scan_distance")
        out = part if out is None else out.unionByName(part)
        left = left if last else settled(left.join(done, "point_id", "left_anti"))
        if last or left.isEmpty():
            return out
        size *= 2


def _around(points: DataFrame, size: float, last: bool) -> DataFrame:
    if last:  # one block holds the whole network
        return points.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    i, j = cell(F.col("px"), size), cell(F.col("py"), size)
    return points.withColumn("i", F.explode(F.sequence(i - 1, i + 1))).withColumn("j", F.explode(F.sequence(j - 1, j + 1)))


def _covered(targets: DataFrame, size: float, last: bool) -> DataFrame:
    if last:
        return targets.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    i = F.sequence(cell(F.least("ux", "vx"), size), cell(F.greatest("ux", "vx"), size))
    j = F.sequence(cell(F.least("uy", "vy"), size), cell(F.greatest("uy", "vy"), size))
    return targets.withColumn("i", F.explode(i)).withColumn("j", F.explode(j))


def _shaped(points: DataFrame, targets: DataFrame, graph: Graph, snap: Snap) -> DataFrame:
    """The accepted, deduplicated and ranked places of points among targets of the same cells."""
    keys = ["i", "j"] if "i" in points.columns else []
    if not keys:
        points, targets = (d.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}) for d in (points, targets))
    sx, sy = graph.metric.scales(F.col("py"))
    t = along(F.col("px"), F.col("py"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"), sx, sy)
    hit = points.join(targets, ["i", "j"]).drop("i", "j").withColumn("t", t)
    hit = hit.withColumns({"x": F.col("ux") + F.col("t") * (F.col("vx") - F.col("ux")), "y": F.col("uy") + F.col("t") * (F.col("vy") - F.col("uy")), "pos": F.col("pos") + F.col("t"), "measure": F.col("u_measure") + F.col("t") * (F.col("v_measure") - F.col("u_measure"))})
    hit = hit.withColumn("distance", graph.metric.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")))
    facing = side(F.col("px"), F.col("py"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    turned = F.when(facing == "left", "right").when(facing == "right", "left").otherwise("on")
    hit = hit.withColumn("side", F.when(F.col("distance") == 0, "on").when(F.col("reversed"), turned).otherwise(facing))
    hit = hit.filter(F.col("want").isNull() | (F.col("want") == F.col("grp")))
    order = ["distance", "feature_idx", "part", "seg_idx"]
    near = Window.partitionBy("point_id")
    if (snap.candidates or 1) == 1 and snap.allowed is None:  # the first look decides
        first = F.min_by(F.struct(*(c for c in hit.columns if c != "point_id")), F.struct(*order)).alias("m")
        hit = hit.groupBy("point_id").agg(first).select("point_id", "m.*").withColumns({"counts": F.col("distance") <= float(snap.max_distance), "scanned": F.lit(snap.search_limit), "scan_distance": F.col("distance"), "rank": F.lit(0), "relocation": F.lit(0.0)})
        return _kept(hit, points, snap)
    scan = F.row_number().over(near.orderBy(*order))
    hit = hit.withColumn("scan", scan).filter(F.col("scan") <= snap.search_limit).withColumns({"scanned": F.count("*").over(near), "scan_distance": F.max("distance").over(near)})
    fits = F.col("distance") <= float(snap.max_distance)
    if snap.allowed is not None:
        fits = fits & F.coalesce(snap.allowed, F.lit(False))
    hit = hit.withColumn("counts", fits)
    if snap.mode != "edge":
        key = [F.col("vertex")]
    elif snap.distinct_by == "chain":
        at = F.when((F.col("t") == 0) & F.col("u").isin(F.col("from_node"), F.col("to_node")), F.col("u")).when((F.col("t") == 1) & F.col("v").isin(F.col("from_node"), F.col("to_node")), F.col("v"))
        key = [at, F.when(at.isNull(), F.col("chain_id")), F.when(at.isNull(), F.col("feature_idx"))]
    else:
        key = [F.col({"feature": "feature_idx", "component": "component"}[snap.distinct_by])]
    first = F.row_number().over(Window.partitionBy("point_id", "counts", *key).orderBy(*order)) == 1
    hit = hit.withColumn("counts", F.col("counts") & first)
    hit = hit.withColumn("rank", F.row_number().over(Window.partitionBy("point_id", "counts").orderBy(*order)) - 1)
    hit = hit.withColumn("relocation", F.col("distance") - F.min(F.when(F.col("counts"), F.col("distance"))).over(near))
    hit = hit.withColumn("counts", F.col("counts") & (F.col("rank") < (snap.candidates or 1)) & (F.col("relocation") <= float(snap.max_relocation)))
    # a point without a place that counts keeps the row of its first look, which tells how far it looked
    hit = hit.filter(F.col("counts") | (F.col("scan") == 1))
    return _kept(hit, points, snap)


def _kept(hit: DataFrame, points: DataFrame, snap: Snap) -> DataFrame:
    keep = [c for c in points.columns if c not in ("i", "j")]
    extra = ["vertex"] if snap.mode != "edge" else []
    return hit.select(*keep, *extra, "counts", "scanned", "scan_distance", "rank", "distance", "relocation", "x", "y", "chain_id", "pos", "seg_id", "feature_idx", "part", "grp", "component", "side", "measure")
