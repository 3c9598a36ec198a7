"""Connected components of link tables: hook to the least neighbour, jump pointers, contract, until one task can finish."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.cells import bounds_of, cell_at, sendable
from spanwright.plans.materialise import settled

#: Links that one task may finish (16 bytes each); more are contracted by joins first.
TASK_LINKS = 1 << 20


def components(links: DataFrame, task_links: int | None = None) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the least node reachable, direction ignored.

    A table of at most ``task_links`` distinct links is labelled in one task. A larger one is labelled in cells, ranges
    of ids, and the links between the cells' components are labelled in turn. Where most links lie between cells it is
    contracted: every round hooks each node to its least neighbour and joins the trees into their roots, which at least
    halves the nodes of a component, until what is left fits. Nodes without other nodes do not occur; an empty table
    gives an empty result.
    """
    bound = TASK_LINKS if task_links is None else task_links
    edges = settled(links.filter("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    labels = None
    if (count := edges.count()) > bound:
        bounds = bounds_of(edges, "a", -(-4 * count // bound))
        kind = "node long, component long, own boolean"
        told = settled(edges.withColumn("cell", cell_at(F.col("a"), bounds)).repartitionById(len(bounds) + 1, F.col("cell")).mapInArrow(_in_cell(bounds), kind))
        own, across = told.filter("own").drop("own"), told.filter("not own").drop("own")
        if across.count() < count / 2:
            # a node that only greater cells link with has no label in its own
            seen = settled(across.select("node", F.col("component").alias("by")).join(own, "node", "left"))
            alone = seen.filter("component is null").select("node", F.col("node").alias("component")).distinct()
            rest = components(seen.select(F.coalesce("component", "node").alias("a"), F.col("by").alias("b")), task_links)
            return settled(_relabelled(own.unionByName(alone), rest))
    while edges.count() > bound:
        tree = _rooted(edges)
        labels = tree if labels is None else settled(_relabelled(labels, tree))
        ends = [tree.select(F.col("node").alias(k), F.col("component").alias(f"{k}_up")) for k in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("a_up <> b_up")
        edges = settled(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
    rest = settled(edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
    return rest if labels is None else settled(_relabelled(labels, rest))


def _relabelled(labels: DataFrame, tree: DataFrame) -> DataFrame:
    up = tree.select(F.col("node").alias("component"), F.col("component").alias("up"))
    return labels.join(sendable(up), "component", "left").select("node", F.coalesce("up", "component").alias("component"))


def _rooted(edges: DataFrame) -> DataFrame:
    """(node, component): each node with the root of its tree, every node hooked to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tree = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up")))
    while True:
        one = tree.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        two = tree.select(F.col("node").alias("up2"), F.col("up").alias("up4"))
        # three hops a round: the parent's parent, and that one's
        tree = settled(tree.join(one, "up").join(two, "up2").select("node", F.col("up4").alias("up"), (F.col("up4") < F.col("up")).alias("moved")))
        if tree.filter("moved").isEmpty():
            return tree.select("node", F.col("up").alias("component"))
        tree = tree.select("node", "up")


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a-b, ascending, and the least node that each reaches."""
    nodes, spots = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = spots[: len(a)], spots[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return nodes, nodes[root]
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (onward := root[root]).tobytes() != root.tobytes():
            root = onward


def _in_cell(bounds: list[int]):
    """The labels of a cell's own nodes, and those of greater cells that it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(k).to_numpy() for k in ("a", "b", "cell")] for b in batches if b.num_rows]
        if held:
            a, b, cell = (np.concatenate(c) for c in zip(*held, strict=True))
            nodes, least = labelled(a, b)
            high = bounds[cell[0]] if cell[0] < len(bounds) else None
            own = np.ones(len(nodes), bool) if high is None else nodes < high
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least), pa.array(own)], ["node", "component", "own"])

    return run


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        nodes, least = labelled(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])
