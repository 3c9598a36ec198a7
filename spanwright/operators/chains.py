"""Weights, chains and edges: segments contracted over vertices of degree two, by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.weights import INFINITE, normalised
from spanwright.operators.cells import bounds_of, cell_at
from spanwright.operators.components import components
from spanwright.plans.materialise import settled, with_rank


#: Segments that one task may walk (24 bytes each); longer tables are contracted by joins.
TASK_SEGMENTS = 1 << 20
#: Segments of a chain that are summed in one group.
RUN = 4096


def weighted(segs: DataFrame, weight: Column | None = None, free_zero: bool = False) -> DataFrame:
    """Adds seg_id (rank by feature, part and index), forward, backward and alive.

    ``weight`` is a (forward, backward) struct over a segment's columns, by default its length both ways.
    """
    ranked = with_rank(segs, ["feature_idx", "part", "seg_idx"], "seg_id")
    w = weight if weight is not None else F.struct(F.col("length").alias("forward"), F.col("length").alias("backward"))
    out = ranked.withColumn("_w", w).withColumns({k: normalised(F.col(f"_w.{k}"), free_zero) for k in ("forward", "backward")}).drop("_w")
    return out.withColumn("alive", (F.col("forward") < F.lit(INFINITE)) | (F.col("backward") < F.lit(INFINITE)))


def ends(segs: DataFrame) -> DataFrame:
    """vertex, seg_id of both ends of each segment."""
    return segs.select(F.explode(F.array("a", "b")).alias("vertex"), "seg_id")


def degrees(segs: DataFrame) -> DataFrame:
    """vertex, degree: the alive segment ends at each vertex."""
    return ends(segs.filter("alive")).groupBy("vertex").agg(F.count("*").alias("degree"))


def degree_histogram(segs: DataFrame) -> DataFrame:
    return degrees(segs).groupBy("degree").agg(F.count("*").alias("vertices"))


def chains(segs: DataFrame, compact: bool = True, task_segments: int | None = None) -> DataFrame:
    """seg_id, chain_id, pos, reversed, from_node, to_node of each alive segment.

    Segments that meet at a vertex of degree two belong to one chain; other vertices are nodes, and so is every
    vertex without ``compact``. chain_id is the chain's least seg_id. A chain runs from the end with the lesser
    (vertex, seg_id); reversed tells that a segment is digitised against it. A closed chain without a node gets one
    at the start of its least segment. At most ``task_segments`` segments are walked in one task. Beyond it they are
    walked in cells, ranges of vertices, and only the chains that leave their cell are walked again. If these are too
    many for a task, every step joins the table with itself and doubles the reach, so a chain of n segments takes about
    log2(n) steps and no chain is gathered into a task.
    """
    alive = settled(segs.filter("alive").select("seg_id", "a", "b"))
    if not compact:
        forward = F.col("a") <= F.col("b")
        return alive.select("seg_id", F.col("seg_id").alias("chain_id"), F.lit(0).cast("long").alias("pos"), (~forward).alias("reversed"), F.least("a", "b").alias("from_node"), F.greatest("a", "b").alias("to_node"))
    bound = TASK_SEGMENTS if task_segments is None else task_segments
    count, kind = alive.count(), "seg_id long, chain_id long, pos long, reversed boolean, from_node long, to_node long"
    if count <= bound:
        return alive.coalesce(1).mapInArrow(_in_one_task, kind)
    bounds = bounds_of(alive, "a", -(-4 * count // bound) if bound else 2)
    cells = F.array_distinct(F.array(*(cell_at(F.col(k), bounds) for k in "ab")))
    walked_ = settled(alive.withColumn("cell", F.explode(cells)).repartitionById(len(bounds) + 1, F.col("cell")).mapInArrow(_in_cell(bounds), f"{kind}, left boolean, from_via boolean, to_via boolean"))
    whole = walked_.filter("not left").select("seg_id", "chain_id", "pos", "reversed", "from_node", "to_node")
    # of both cells of a segment each knows one end
    alive = settled(walked_.filter("left").groupBy("seg_id", F.col("from_node").alias("a"), F.col("to_node").alias("b")).agg(F.max("from_via").alias("a_via"), F.max("to_via").alias("b_via")))
    if alive.count() <= bound:
        return whole.unionByName(alive.coalesce(1).mapInArrow(_in_one_task, kind))
    through = settled(alive.select(F.explode(F.array(F.struct(F.col("a").alias("vertex"), F.col("a_via").alias("via")), F.struct(F.col("b").alias("vertex"), F.col("b_via").alias("via")))).alias("e")).filter("e.via").select("e.vertex").distinct())
    return whole.unionByName(_by_joins(alive, through))


def _by_joins(alive: DataFrame, through: DataFrame) -> DataFrame:
    ordered = _walked(alive, through)
    closed = settled(ordered.filter("closed").groupBy("chain_id").agg(F.min("seg_id").alias("seg_id")))
    if closed.limit(1).count():
        opened = closed.join(alive, "seg_id").select(F.col("a").alias("vertex")).distinct()
        ordered = _walked(alive, through.join(opened, "vertex", "left_anti"))
    return ordered.drop("closed")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if held:
        seg, a, b = (held.column(k).to_numpy() for k in ("seg_id", "a", "b"))
        through = None
        if "a_via" in held.column_names:
            through = set(np.concatenate([x[held.column(f"{k}_via").to_numpy().astype(bool)] for k, x in (("a", a), ("b", b))]).tolist())
        order = np.argsort(seg)
        yield _batch(walked(*(x[order].tolist() for x in (seg, a, b)), through), _WALK)


_WALK = {"seg_id": pa.int64(), "chain_id": pa.int64(), "pos": pa.int64(), "reversed": pa.bool_(), "from_node": pa.int64(), "to_node": pa.int64()}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _in_cell(bounds: list[int]):
    """The chains of a cell's vertices; segments of those that leave it as they are, with what is known of their ends."""
    kinds = _WALK | {"left": pa.bool_(), "from_via": pa.bool_(), "to_via": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(k).to_numpy() for k in ("seg_id", "a", "b", "cell")] for b in batches if b.num_rows]
        if held:
            seg, a, b, cell = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(seg)
            seg, a, b, cell = seg[order], a[order], b[order], int(cell[0])
            low, high = (bounds[cell - 1] if cell else -np.inf), (bounds[cell] if cell < len(bounds) else np.inf)
            vertices, degree = np.unique(np.concatenate([a, b]), return_counts=True)
            own = (vertices >= low) & (vertices < high)
            through, beyond = set(vertices[own & (degree == 2)].tolist()), set(vertices[~own].tolist())
            ends = dict(zip(seg.tolist(), zip(a.tolist(), b.tolist(), strict=True), strict=True))
            rows = []
            for row in walked(seg.tolist(), a.tolist(), b.tolist(), through):
                if row[4] in beyond or row[5] in beyond:
                    one, two = ends[row[0]]
                    rows.append((row[0], None, None, None, one, two, True, one in through, two in through))
                else:
                    rows.append((*row, False, None, None))
            yield _batch(rows, kinds)

    return run


def walked(seg: list[int], a: list[int], b: list[int], through: set[int] | None = None) -> list[tuple[int, int, int, bool, int, int]]:
    """(seg_id, chain_id, pos, reversed, from_node, to_node) of segments a-b in ascending order of seg.

    Chains go on at these vertices; by default, at those of two ends.
    """
    at: dict[int, list[int]] = {}
    for i, two in enumerate(zip(a, b, strict=True)):
        for v in two:
            at.setdefault(v, []).append(i)
    if through is None:
        through = {v for v, here in at.items() if len(here) == 2}
    done, out = [False] * len(seg), []

    def follow(node: int, i: int) -> None:
        steps, v = [], node
        while True:
            done[i] = True
            against = a[i] != v
            steps.append((i, against))
            v = a[i] if against else b[i]
            if v == node or v not in through:
                break
            one, two = at[v]
            i = two if one == i else one
        start, end = node, v
        if (start, seg[steps[0][0]]) > (end, seg[steps[-1][0]]):
            steps, start, end = [(k, not against) for k, against in reversed(steps)], end, start
        least = min(seg[k] for k, _ in steps)
        out.extend((seg[k], least, pos, against, start, end) for pos, (k, against) in enumerate(steps))

    for node, here in at.items():
        if node not in through:
            for i in here:
                if not done[i]:
                    follow(node, i)
    for i in range(len(seg)):  # closed chains, the least segment of each first
        if not done[i]:
            follow(a[i], i)
    return out


def _walked(alive: DataFrame, through: DataFrame) -> DataFrame:
    """Chains over these pass-through vertices. A dart is a segment in a direction: 2 * seg_id, plus 1 against it."""
    darts = alive.select((F.col("seg_id") * 2).alias("dart"), F.col("a").alias("tail"), F.col("b").alias("head")).unionByName(alive.select((F.col("seg_id") * 2 + 1).alias("dart"), F.col("b").alias("tail"), F.col("a").alias("head")))
    leaving = darts.select(F.col("tail").alias("head"), F.col("dart").alias("next"))
    onward = darts.join(through.withColumnRenamed("vertex", "head"), "head").join(leaving, "head").filter(F.floor(F.col("dart") / 2) != F.floor(F.col("next") / 2)).select("dart", "next")
    state = darts.join(onward, "dart", "left").select("dart", "next", F.col("dart").alias("last"), F.lit(0).cast("long").alias("dist"), F.floor(F.col("dart") / 2).alias("least"))
    state = settled(state)
    open_before = None
    while True:
        beyond = state.select(F.col("dart").alias("next"), F.col("next").alias("next2"), F.col("last").alias("last2"), F.col("dist").alias("dist2"), F.col("least").alias("least2"))
        # a closed chain never ends; its least segment is known once it stops changing
        state = settled(
            state.join(beyond, "next", "left").select(
                "dart",
                F.col("next2").alias("next"),
                F.coalesce("last2", F.coalesce("next", "last")).alias("last"),
                F.when(F.col("next").isNull(), F.col("dist")).otherwise(F.col("dist") + F.coalesce("dist2", F.lit(0)) + F.lit(1)).alias("dist"),
                F.least("least", F.coalesce("least2", "least")).alias("least"),
                (F.coalesce("least2", "least") < F.col("least")).alias("moved"),
            )
        )
        still = state.agg(F.count("next").alias("open"), F.count(F.when(F.col("moved") & F.col("next").isNotNull(), 1)).alias("moved")).first()
        state = state.drop("moved")
        if not still["open"] or (still["open"] == open_before and not still["moved"]):
            break
        open_before = still["open"]
    heads = darts.select(F.col("dart").alias("last"), F.col("head").alias("end"))
    walked = state.join(heads, "last").select("dart", "last", "end", "dist", "least", F.col("next").isNotNull().alias("closed"))
    ahead = walked.filter("dart % 2 = 0").select(F.floor(F.col("dart") / 2).alias("seg_id"), F.col("last").alias("a_last"), F.col("end").alias("a_end"), F.col("dist").alias("a_dist"), F.col("least").alias("a_least"), "closed")
    back = walked.filter("dart % 2 = 1").select(F.floor(F.col("dart") / 2).alias("seg_id"), F.col("last").alias("b_last"), F.col("end").alias("b_end"), F.col("dist").alias("b_dist"), F.col("least").alias("b_least"))
    both = ahead.join(back, "seg_id")
    start = F.struct(F.col("b_end"), F.floor(F.col("b_last") / 2))
    finish = F.struct(F.col("a_end"), F.floor(F.col("a_last") / 2))
    along = start <= finish
    # a ring through its own node starts and ends there at the same vertex; by segment ids it is still oriented
    return both.select(
        "seg_id",
        F.least("a_least", "b_least").alias("chain_id"),
        F.when(along, F.col("b_dist")).otherwise(F.col("a_dist")).alias("pos"),
        (~along).alias("reversed"),
        F.when(along, F.col("b_end")).otherwise(F.col("a_end")).alias("from_node"),
        F.when(along, F.col("a_end")).otherwise(F.col("b_end")).alias("to_node"),
        "closed",
    )


def chain_segments(segs: DataFrame, chained: DataFrame) -> DataFrame:
    """The alive segments in chain terms: lengths, costs along and against the chain, places and measures by pos."""
    swap = F.col("reversed")

    def pick(one: str, other: str) -> Column:
        return F.when(swap, F.col(other)).otherwise(F.col(one))

    return segs.join(chained, "seg_id").select(
        "chain_id", "pos", "seg_id", "feature_idx", "part", "seg_idx", "reversed", "length", "from_node", "to_node",
        pick("forward", "backward").alias("cost_along"), pick("backward", "forward").alias("cost_against"),
        pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("ax", "bx").alias("ux"), pick("ay", "by").alias("uy"), pick("az", "bz").alias("uz"),
        pick("bx", "ax").alias("vx"), pick("by", "ay").alias("vy"), pick("bz", "az").alias("vz"), pick("a_grp", "b_grp").alias("u_grp"), pick("b_grp", "a_grp").alias("v_grp"),
        pick("measure_start", "measure_end").alias("u_measure"), pick("measure_end", "measure_start").alias("v_measure"),
        *([pick("elevation_a", "elevation_b").alias("u_elevation"), pick("elevation_b", "elevation_a").alias("v_elevation")] if "elevation_a" in segs.columns else []),
    )


def chain_totals(linked: DataFrame) -> DataFrame:
    """chain_id, from_node, to_node, n_segments, cost_fwd, cost_bwd, length; sums are taken in the chain's order."""
    fields = ("cost_along", "cost_against", "length")

    def total(field: str) -> Column:
        return F.aggregate("items", F.lit(0.0), lambda a, x: a + x[field])

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct("pos", *fields, "n"))).alias("items")
        count = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return rows.groupBy("chain_id", "from_node", "to_node", *keys).agg(items).select("chain_id", "from_node", "to_node", *keys, *(total(f).alias(f) for f in fields), count.alias("n"))

    # runs of bounded length first, so that no group holds a whole chain
    runs = summed(linked.withColumns({"n": F.lit(1).cast("long"), "run": F.floor(F.col("pos") / RUN)}), "run")
    whole = summed(runs.withColumnRenamed("run", "pos"))
    return whole.select("chain_id", "from_node", "to_node", F.col("n").alias("n_segments"), F.col("cost_along").alias("cost_fwd"), F.col("cost_against").alias("cost_bwd"), "length")


def directed_edges(totals: DataFrame) -> DataFrame:
    """src, dst, cost, chain_id, reversed: an edge for each passable direction of a chain; loops have none."""
    open_ = totals.filter("from_node <> to_node")
    out = open_.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.col("cost_fwd").alias("cost"), "chain_id", F.lit(False).alias("reversed"))
    back = open_.select(F.col("to_node").alias("src"), F.col("from_node").alias("dst"), F.col("cost_bwd").alias("cost"), "chain_id", F.lit(True).alias("reversed"))
    return out.unionByName(back).filter(F.col("cost") < F.lit(INFINITE))


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "chain_id", "reversed")


def weak_components(totals: DataFrame) -> DataFrame:
    """node, component over passable chains that are not loops; a node without such a chain is its own component."""
    nodes = totals.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    passable = totals.filter((F.col("cost_fwd") < F.lit(INFINITE)) | (F.col("cost_bwd") < F.lit(INFINITE)))
    linked = components(passable.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")))
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_summary(totals: DataFrame, labels: DataFrame) -> DataFrame:
    """component, nodes, length, largest (by length, then nodes, then the least component)."""
    nodes = labels.groupBy("component").agg(F.count("*").alias("nodes"))
    length = totals.join(labels.withColumnRenamed("node", "from_node"), "from_node").groupBy("component").agg(F.sum("length").alias("length"))
    out = nodes.join(length, "component", "left").withColumn("length", F.coalesce("length", F.lit(0.0)))
    top = out.agg(F.max(F.struct("length", "nodes", (-F.col("component")).alias("c"))).alias("top")).select((-F.col("top.c")).alias("component"), F.lit(True).alias("largest"))
    return out.join(F.broadcast(top), "component", "left").withColumn("largest", F.coalesce("largest", F.lit(False)))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: nodes that reach each other; component is the least of them.

    Trims nodes without edges one way, then colours the rest forward by the least node that reaches them and keeps
    those that reach that node back; what remains is coloured again. Meant for graphs beyond one machine; each
    colouring takes as many joins as its paths have edges.
    """
    found = None
    left_nodes, left_edges = settled(nodes.select("node").distinct()), settled(edges.select("src", "dst").filter("src <> dst").distinct())
    while True:
        while True:  # trim
            both = left_edges.select(F.col("src").alias("node")).distinct().join(left_edges.select(F.col("dst").alias("node")).distinct(), "node")
            alone = left_nodes.join(both, "node", "left_anti").select("node", F.col("node").alias("component"))
            found = settled(alone if found is None else found.unionByName(alone))
            left_nodes = settled(left_nodes.join(both, "node", "left_semi"))
            kept = settled(left_edges.join(left_nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(left_nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
            same = kept.count() == left_edges.count()
            left_edges = kept
            if same:
                break
        if not left_nodes.limit(1).count():
            return found
        colour = settled(left_nodes.withColumn("colour", F.col("node")))
        while True:
            seen = left_edges.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            colour = settled(colour.join(seen, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
            moved = colour.filter("moved").limit(1).count()
            colour = colour.select("node", "colour")
            if not moved:
                break
        inside = left_edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
        inside = settled(inside)
        reached = settled(colour.filter("node = colour").select("node"))
        while True:
            back = inside.join(reached.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(reached, "node", "left_anti")
            back = settled(back)
            if not back.limit(1).count():
                break
            reached = settled(reached.unionByName(back))
        done = reached.join(colour, "node").select("node", F.col("colour").alias("component"))
        found = settled(found.unionByName(done))
        left_nodes = settled(left_nodes.join(reached, "node", "left_anti"))
        left_edges = settled(left_edges.join(left_nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(left_nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))

