"""Topology repair: loose ends snapped to near segments, and segments split where they cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanwright.functions.geometry import Metric, along, cell, crossing_terms, met
from spanwright.operators.cells import sendable
from spanwright.operators.components import components
from spanwright.plans.materialise import settled

END = ["vertex", "x", "y", "z", "grp"]
KEY = ("feature_idx", "part", "seg_idx")


def _identified(segs: DataFrame) -> DataFrame:
    """Adds sid, a key of the segment that survives recomputation."""
    return segs.withColumn("sid", F.struct(*KEY))


def cell_size(segs: DataFrame) -> float:
    """A grid cell on which most segments cover a few cells: twice their mean extent."""
    mean = segs.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
    return max(2 * (mean or 1.0), 1e-9)


def celled(segs: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """segs with one row for each grid cell (i, j) that the padded bounding box covers."""
    def span(a: str, b: str) -> F.Column:
        return F.sequence(cell(F.least(a, b) - pad, size), cell(F.greatest(a, b) + pad, size))

    return segs.withColumn("i", F.explode(span("ax", "bx"))).withColumn("j", F.explode(span("ay", "by")))


def loose_ends(segs: DataFrame) -> DataFrame:
    """vertex, x, y, z, grp, feature_idx, other: vertices with one segment end, and that segment's other vertex."""
    two = segs.withColumn("_one", F.explode(F.array(F.lit(True), F.lit(False))))
    of = {"vertex": ("a", "b"), "x": ("ax", "bx"), "y": ("ay", "by"), "z": ("az", "bz"), "grp": ("a_grp", "b_grp"), "other": ("b", "a")}
    ends = two.select("feature_idx", *(F.when(F.col("_one"), F.col(a)).otherwise(F.col(b)).alias(k) for k, (a, b) in of.items()))
    # of a vertex with one end each least value is that end's own; columns that nobody asks for are not aggregated
    told = ("x", "y", "z", "grp", "feature_idx", "other")
    alone = ends.groupBy("vertex").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in told)).filter("n = 1")
    return alone.select("vertex", *told)


def near_segments(ends: DataFrame, segs: DataFrame, metric: Metric, limit: float) -> DataFrame:
    """Each loose end with its nearest segment of the group within the limit that does not touch it or its neighbour."""
    from spanwright.operators.topology import _cell_size

    reach = _cell_size(metric, limit)
    size = max(cell_size(segs), reach)
    placed = ends.withColumns({"i": cell(F.col("x"), size), "j": cell(F.col("y"), size)})
    wide = celled(segs.filter(F.col("a_grp").eqNullSafe(F.col("b_grp")) & F.col("a_grp").isNotNull()).select("feature_idx", "part", "seg_idx", "a", "b", "ax", "ay", "bx", "by", "az", "bz", "length", "a_grp").withColumnsRenamed({"feature_idx": "seg_feature", "a_grp": "grp"}), size, reach)
    sx, sy = metric.scales(F.col("y"))
    t = along(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), sx, sy)
    pairs = placed.join(wide, ["grp", "i", "j"]).filter(~F.col("vertex").isin(F.col("a"), F.col("b")) & ~F.col("other").isin(F.col("a"), F.col("b")))
    pairs = pairs.withColumn("t", t).withColumns({"px": F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), "py": F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))})
    pairs = pairs.withColumn("gap", metric.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).filter(F.col("gap") <= limit)
    return pairs.groupBy("vertex").agg(F.min(F.struct("gap", "seg_feature", "part", "seg_idx", "x", "y", "z", "grp", "feature_idx", "a", "b", "t", "px", "py", "ax", "ay", "az", "bx", "by", "bz", "length")).alias("m")).select("vertex", "m.*")


def snap_dangles(segs: DataFrame, metric: Metric, limit: float, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """segs with loose ends moved onto their nearest segment within the limit, and the log of moves.

    Within the tolerance of an end of that segment (at least a billionth of its length) the loose end merges with it,
    else the segment is split at the foot point, which takes the loose end's vertex.
    """
    found = settled(near_segments(loose_ends(segs), segs, metric, limit))
    eps = F.greatest(F.lit(float(tolerance)), 1e-9 * F.col("length"))
    at_end = F.when(F.col("t") * F.col("length") <= eps, F.col("a")).when((1 - F.col("t")) * F.col("length") <= eps, F.col("b"))
    found = found.withColumn("into", at_end)
    # splits keep the loose end's own vertex at the foot point; merges follow chains of merges to one survivor
    merges = found.filter("into is not null").select(F.col("vertex").alias("b"), F.col("into").alias("a"))
    roots = components(merges).withColumnRenamed("node", "vertex").withColumnRenamed("component", "root")
    moved = found.filter("into is null").select("vertex", F.col("px").alias("mx"), F.col("py").alias("my"))
    cuts = found.filter("into is null").select(F.col("seg_feature").alias("feature_idx"), "part", "seg_idx", "t", F.col("vertex").alias("cut"), F.col("px").alias("cx"), F.col("py").alias("cy"), "z")
    out = settled(_applied(segs, cuts, roots, moved, metric))
    log = found.select(F.lit("dangle").alias("kind"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("feature_idx").alias("feature_a"), F.col("seg_feature").alias("feature_b"), "gap")
    return out, log


def intersections(segs: DataFrame) -> DataFrame:
    """Pairs of segments of one group that meet other than at a shared vertex: both fractions and the place.

    Candidates share a grid cell; a pair is looked at in the first cell of both boxes only and reported once, the
    earlier segment first. Collinear overlaps are not meetings.
    """
    size = cell_size(segs)
    flat = segs.filter(F.col("a_grp").eqNullSafe(F.col("b_grp")) & F.col("a_grp").isNotNull())
    flat = _identified(flat).withColumns({f"{n}0": cell(F.least(f"a{c}", f"b{c}"), size) for n, c in (("i", "x"), ("j", "y"))})
    names = ("sid", "feature_idx", "a", "b", "ax", "ay", "bx", "by", "i0", "j0")
    wide = celled(flat.select(*names, F.col("a_grp").alias("grp")), size)
    one, two = (wide.select("grp", "i", "j", *(F.col(n).alias(f"{n}_{k}" if n in ("i0", "j0") else f"{n}{k}") for n in names)) for k in (1, 2))
    # Spark takes the rows of cells for no more than the table's files and would send them to the driver and to every task
    pairs = one.join(two.hint("merge"), ["grp", "i", "j"]).filter("i = greatest(i0_1, i0_2) and j = greatest(j0_1, j0_2) and sid1 < sid2").drop("i", "j", "i0_1", "i0_2", "j0_1", "j0_2")
    # the terms are exploded, one row a pair, so that they are computed once and not copied into the join's condition:
    # its code would be too long to be compiled
    terms = crossing_terms(*(F.col(f"{c}{k}") for k in (1, 2) for c in ("ax", "ay", "bx", "by")))
    told = F.struct(F.expr("a1 <> a2 and a1 <> b2 and b1 <> a2 and b1 <> b2").alias("apart"), *(c.alias(n) for c, n in zip(terms, "pqds", strict=True)))
    pairs = pairs.withColumn("m", F.explode(F.array(told))).filter("m.apart")
    t, u = met(*(F.col(f"m.{n}") for n in "pqds"))
    hit = pairs.withColumns({"t": t, "u": u}).filter("t is not null and u is not null").drop("m")
    return hit.withColumns({"x": F.col("ax1") + F.col("t") * (F.col("bx1") - F.col("ax1")), "y": F.col("ay1") + F.col("t") * (F.col("by1") - F.col("ay1"))})


def split_intersections(segs: DataFrame, metric: Metric, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """segs split where they cross (X) or touch (T) another of their group, and the log of splits.

    Meeting places with equal coordinates are one vertex, and that of their group which lies there already, if one
    does; a place within the tolerance of a segment's end (at least a billionth of its length) is that end's vertex.
    New vertices are numbered on, or named by their places where those of segs are (``topology.keyed_vertices``).
    """
    segs = settled(segs)
    hits = intersections(segs)
    for k, f in ((1, "t"), (2, "u")):
        length = metric.distance(*(F.col(f"{c}{k}") for c in ("ax", "ay", "bx", "by")))
        eps = F.greatest(F.lit(float(tolerance)), 1e-9 * length) / length
        hits = hits.withColumn(f"end{k}", F.when(F.col(f) <= eps, F.struct(F.col(f"a{k}").alias("vertex"), F.col(f"ax{k}").alias("x"), F.col(f"ay{k}").alias("y"))).when(F.col(f) >= 1 - eps, F.struct(F.col(f"b{k}").alias("vertex"), F.col(f"bx{k}").alias("x"), F.col(f"by{k}").alias("y"))))
    hits = settled(hits.select("grp", "sid1", "sid2", "feature_idx1", "feature_idx2", "t", "u", "x", "y", "end1", "end2"))
    crossed = _crossed(hits.filter("end1 is null and end2 is null"), segs)
    cuts = crossed.select(F.explode(F.array(_cut(F.col("pair"), 1), _cut(F.col("pair"), 2))).alias("s"), "cut", "cx", "cy").select("s.*", "cut", "cx", "cy")
    # a T: the other segment's end lies inside this one
    tees = hits.filter(F.col("end1").isNull() != F.col("end2").isNull()).withColumns({"pair": F.struct("sid1", "sid2", "t", "u"), "end": F.coalesce("end1", "end2")})
    tees = tees.withColumn("s", F.when(F.col("end1").isNull(), _cut(F.col("pair"), 1)).otherwise(_cut(F.col("pair"), 2)))
    cuts = cuts.unionByName(tees.select("s.*", F.col("end.vertex").alias("cut"), F.col("end.x").alias("cx"), F.col("end.y").alias("cy")))
    merges = hits.filter("end1 is not null and end2 is not null").select(F.col("end1.vertex").alias("a"), F.col("end2.vertex").alias("b"))
    return _applied(segs, cuts.withColumn("z", F.lit(None).cast("double")), _merged(merges), None, metric), _splits(hits)


def _cut(pair: Column, k: int) -> Column:
    """The key of a pair's first or second segment, and the fraction along it."""
    return F.struct(*(pair[f"sid{k}"][c].alias(c) for c in KEY), pair["t" if k == 1 else "u"].alias("t"))


def _crossed(inner: DataFrame, segs: DataFrame) -> DataFrame:
    """pair (sid1, sid2, t, u), cut, cx, cy of each X: the vertex at its place and where that lies.

    Pairs and the segments' ends meet by place once; of a new place the first pair tells the coordinates.
    """
    from spanwright.operators.topology import place_name
    from spanwright.plans.materialise import with_rank

    spot = {"kx": F.round("x", 9), "ky": F.round("y", 9)}
    pairs = inner.select("grp", "x", "y", F.struct("sid1", "sid2", "t", "u").alias("pair")).withColumn("vertex", F.lit(None).cast(segs.schema["a"].dataType))
    there = _ends(segs, "grp").filter("grp is not null").withColumn("pair", F.lit(None).cast(pairs.schema["pair"].dataType))
    here = Window.partitionBy("grp", "kx", "ky")
    least = {n: F.min(F.when(F.col(c).isNotNull(), F.struct(c, "x", "y"))).over(here) for n, c in (("old", "vertex"), ("new", "pair"))}
    found = pairs.unionByName(there).withColumns(spot).withColumns(least).filter("pair is not null")
    if _named(segs):
        fresh = place_name(F.col("grp"), F.col("new.x"), F.col("new.y"))
    else:
        found = settled(found)
        top = segs.agg(F.max(F.greatest("a", "b"))).first()[0] or 0
        first = found.filter("old is null and pair.sid1 = new.pair.sid1 and pair.sid2 = new.pair.sid2").select("grp", "kx", "ky", "pair.sid1", "pair.sid2")
        found = found.join(with_rank(first, ["sid1", "sid2"], "rank").select("grp", "kx", "ky", "rank"), ["grp", "kx", "ky"], "left")
        fresh = F.col("rank") + top + 1
    return found.select("pair", F.coalesce("old.vertex", fresh).alias("cut"), F.coalesce("old.x", "new.x").alias("cx"), F.coalesce("old.y", "new.y").alias("cy"))


def _named(segs: DataFrame) -> bool:
    """Whether vertices are named by their places rather than numbered."""
    return isinstance(segs.schema["a"].dataType, StructType)


def _ends(segs: DataFrame, *told: str) -> DataFrame:
    """vertex, x, y and what else is told (z, grp) of both ends of each segment."""
    of = {"vertex": "{}", "x": "{}x", "y": "{}y", "z": "{}z", "grp": "{}_grp"}
    ends = F.array(*(F.struct(*(F.col(of[c].format(k)).alias(c) for c in ("vertex", "x", "y", *told))) for k in "ab"))
    return segs.select(F.explode(ends).alias("p")).select("p.*")


def _merged(merges: DataFrame) -> DataFrame | None:
    """(vertex, root) of merges(a, b) of numbered or named vertices, the least of a cluster being its root; None without any."""
    if merges.isEmpty():
        return None
    number = None
    if isinstance(merges.schema["a"].dataType, StructType):
        from spanwright.plans.materialise import with_rank

        number = settled(with_rank(merges.select(F.explode(F.array("a", "b")).alias("name")).distinct(), ["name"], "n"))
        for k in "ab":
            merges = merges.join(number.withColumnRenamed("name", k), k).drop(k).withColumnRenamed("n", k)
    roots = components(merges).withColumnsRenamed({"node": "vertex", "component": "root"})
    for k in ("vertex", "root") if number is not None else ():
        roots = roots.join(number.withColumnRenamed("n", k), k).drop(k).withColumnRenamed("name", k)
    return roots


def split_log(segs: DataFrame) -> DataFrame:
    """The log of ``split_intersections`` alone: nothing is cut for it, and segs may have vertices of any kind."""
    return _splits(intersections(segs))


def _splits(hits: DataFrame) -> DataFrame:
    return hits.select(F.lit("split").alias("kind"), "x", "y", F.col("feature_idx1").alias("feature_a"), F.col("feature_idx2").alias("feature_b"), F.lit(0.0).alias("gap"))


def _applied(segs: DataFrame, cuts: DataFrame, roots: DataFrame | None, moved: DataFrame | None, metric: Metric) -> DataFrame:
    """segs with ends moved and merged and segments cut at (t, vertex), in order along each; pieces without length go.

    Segments and cuts are laid in a row along each part: every one begins a piece, which goes to the next or to its
    segment's end.
    """
    out = segs
    if roots is not None and not (rooted := roots.filter("vertex <> root")).isEmpty():
        where = _ends(segs, "z").join(sendable(rooted.select(F.col("root").alias("vertex")).distinct()), "vertex", "left_semi").dropDuplicates(["vertex"])
        rooted = settled(rooted.join(where.withColumnRenamed("vertex", "root"), "root"))
        for k in "ab":
            place = rooted.select(F.col("vertex").alias(k), F.col("root").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
            out = out.join(sendable(place), k, "left").withColumns({k: F.coalesce("r", k), f"{k}x": F.coalesce("rx", f"{k}x"), f"{k}y": F.coalesce("ry", f"{k}y"), f"{k}z": F.when(F.col("r").isNotNull(), F.col("rz")).otherwise(F.col(f"{k}z"))}).drop("r", "rx", "ry", "rz")
    if moved is not None and not moved.isEmpty():
        for k in "ab":
            out = out.join(sendable(moved.withColumnRenamed("vertex", k)), k, "left").withColumns({f"{k}x": F.coalesce("mx", f"{k}x"), f"{k}y": F.coalesce("my", f"{k}y")}).drop("mx", "my")
    stop = {"v": "a", "x": "ax", "y": "ay", "z": "az"}
    rest = F.struct(*(c for c in segs.columns if c not in (*KEY, *stop.values())))
    rows = out.select(*KEY, F.lit(0.0).alias("t"), *(F.col(c).alias(k) for k, c in stop.items()), rest.alias("seg"))
    rows = rows.unionByName(cuts.select(*KEY, "t", F.col("cut").alias("v"), F.col("cx").alias("x"), F.col("cy").alias("y"), "z", F.lit(None).cast(rows.schema["seg"].dataType).alias("seg")))
    rows = rows.withColumn("inner", F.col("seg").isNull())
    line = Window.partitionBy("feature_idx", "part").orderBy("seg_idx", "inner", "t", "v")
    rows = rows.withColumns({"seg": F.last("seg", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "to": F.lead(F.struct("seg_idx", *stop)).over(line)})
    last = F.struct("seg_idx", *(F.col(f"seg.{c}").alias(k) for k, c in (("v", "b"), ("x", "bx"), ("y", "by"), ("z", "bz"))))
    rows = rows.withColumn("to", F.when(F.col("to.seg_idx") == F.col("seg_idx"), F.col("to")).otherwise(last)).filter("v <> to.v")
    rows = rows.withColumn("nth", F.row_number().over(line) - 1)
    cols = {c: F.col(f"seg.{c}") for c in segs.columns} | {"feature_idx": F.col("feature_idx"), "part": F.col("part"), "seg_idx": F.col("nth")}
    cols |= {c: F.col(k) for k, c in stop.items()} | {c: F.col(f"to.{k}") for k, c in (("v", "b"), ("x", "bx"), ("y", "by"), ("z", "bz"))}
    cols["length"] = metric.distance(F.col("x"), F.col("y"), F.col("to.x"), F.col("to.y"))
    return rows.select(*(cols[c].alias(c) for c in segs.columns))
