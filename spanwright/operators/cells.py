"""Networks in cells that a task can hold each: costs and strong components of networks of any size.

A cell has the edges that leave the nodes of a range of ids, which follow the order of the features. Only what crosses
between cells is moved: a step of a search settles whole cells, and strong components need one look at each cell, a
reduced network over the crossings, and a second look.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.plans.materialise import settled

#: Edges of a cell, and of a network that one task finishes.
CELL_EDGES = 1 << 18
TASK_EDGES = 1 << 20
#: Rows that are sent to all tasks rather than shuffled.
FEW = 1 << 17


def sendable(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def bounds_of(rows: DataFrame, column: str, cells: int) -> list[int]:
    """The least id of each cell but the first, so that cells have about as many rows, and none is empty."""
    found = {int(b) for b in rows.approxQuantile(column, [i / cells for i in range(cells)], 0.1 / cells)} if cells > 1 else set()
    return sorted(found)[1:]


def cell_at(ids: Column, bounds: list[int], first: int = 0) -> Column:
    """The cell of an id, by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(ids < bounds[half], cell_at(ids, bounds[:half], first)).otherwise(cell_at(ids, bounds[half + 1 :], first + half + 1))


@dataclass
class Cells:
    bounds: list[int]
    blocks: DataFrame  # cell, and src, dst and cost as bytes; one row a cell
    edges: DataFrame

    def range_of(self, cell: int) -> tuple[float, float]:
        return (self.bounds[cell - 1] if cell else -math.inf), (self.bounds[cell] if cell < len(self.bounds) else math.inf)

    def joined(self, asked: DataFrame, how: str = "inner") -> DataFrame:
        """The blocks of asked(cell, ...), without a shuffle of blocks where the rows are few."""
        return self.blocks.join(sendable(asked), "cell", how)


def in_cells(edges: DataFrame, cell_edges: int | None = None) -> Cells:
    """edges(src, dst, cost) in cells of about ``cell_edges``."""
    edges = settled(edges.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("cost").cast("double").alias("cost")))
    bounds = bounds_of(edges, "src", -(-edges.count() // (CELL_EDGES if cell_edges is None else cell_edges)))
    count = len(bounds) + 1
    blocks = edges.withColumn("cell", cell_at(F.col("src"), bounds)).repartitionById(count, F.col("cell")).mapInArrow(_block, "cell int, src binary, dst binary, cost binary")
    return Cells(bounds, settled(blocks), edges)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(k).to_numpy() for k in ("cell", "src", "dst", "cost")] for b in batches if b.num_rows]
    if held:
        cell, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([int(cell[0])], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in rest)], ["cell", "src", "dst", "cost"])


# --- costs --------------------------------------------------------------------------------------------------------


class _Near:
    """A cell's edges as lists over positions in ``nodes``."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray) -> None:
        self.nodes, spots = np.unique(np.concatenate([src, dst]), return_inverse=True)
        order = np.argsort(spots[: len(src)], kind="stable")
        offset = np.searchsorted(spots[: len(src)][order], np.arange(len(self.nodes) + 1)).tolist()
        steps = list(zip(spots[len(src) :][order].tolist(), cost[order].tolist(), strict=True))
        self.near = [steps[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)]

    def costs(self, nodes: np.ndarray, costs: np.ndarray, max_cost: float) -> np.ndarray:
        """The least cost of each node from these nodes at these costs."""
        best, near = [math.inf] * len(self.nodes), self.near
        heap = []
        for node, cost in zip(np.searchsorted(self.nodes, nodes).tolist(), costs.tolist(), strict=True):
            if cost < best[node]:
                best[node] = cost
                heap.append((cost, node))
        heapq.heapify(heap)
        while heap:
            cost, node = heapq.heappop(heap)
            if cost > best[node]:
                continue
            for to, step in near[node]:
                reached = cost + step
                if reached < best[to] and reached <= max_cost:
                    best[to] = reached
                    heapq.heappush(heap, (reached, to))
        return np.array(best)


def _spread(bounds: list[int], inside: bool, max_cost: float):
    """source, node, cost beyond each cell, or of its own nodes, from what has entered it."""
    cells = Cells(bounds, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                cell = batch.column("cell")[k].as_py()
                if near is None or at != cell:
                    src, dst, cost = (batch.column(c)[k].as_buffer() for c in ("src", "dst", "cost"))
                    at, near = cell, _Near(np.frombuffer(src, np.int64), np.frombuffer(dst, np.int64), np.frombuffer(cost))
                low, high = cells.range_of(cell)
                own = ((near.nodes >= low) & (near.nodes < high)) == inside
                entered = batch.column("entries")[k].values
                source, node, reached = (entered.field(c).to_numpy() for c in ("source", "node", "cost"))
                known = near.nodes[np.minimum(np.searchsorted(near.nodes, node), len(near.nodes) - 1)] == node
                for one in np.unique(source):
                    mine = source == one
                    best = near.costs(node[mine & known], reached[mine & known], max_cost)
                    told = own & np.isfinite(best)
                    nodes, costs = near.nodes[told], best[told]
                    if inside:  # nodes that no edge touches here
                        nodes, costs = np.concatenate([nodes, node[mine & ~known]]), np.concatenate([costs, reached[mine & ~known]])
                    if len(nodes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), one)), pa.array(nodes), pa.array(costs)], ["source", "node", "cost"])

    return run


def costs_over(cells: Cells, sources: DataFrame, max_cost: float = math.inf) -> DataFrame:
    """source, node, cost of everything reachable from sources(source, node, cost) at no more than max_cost.

    A step settles the cells into which something cheaper has entered, and keeps the least costs of the nodes at which
    cells are entered; a last look has the costs of all nodes. Steps are as many as the cells that a cheapest path crosses.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, parts // (len(cells.bounds) + 1))
    kind = "source long, node long, cost double"

    def looked(front: DataFrame, inside: bool) -> DataFrame:
        entries = front.withColumns({"cell": cell_at(F.col("node"), cells.bounds), "chunk": F.pmod(F.hash("source"), F.lit(chunks))})
        asked = cells.joined(settled(entries.groupBy("cell", "chunk").agg(F.collect_list(F.struct("source", "node", "cost")).alias("entries"))))
        if chunks > 1:
            asked = asked.repartition(parts, "cell", "chunk")
        return asked.select("cell", "src", "dst", "cost", "entries").mapInArrow(_spread(cells.bounds, inside, max_cost), kind)

    least = sources.groupBy(F.col("source").cast("long").alias("source"), F.col("node").cast("long").alias("node")).agg(F.min(F.col("cost").cast("double")).alias("cost"))
    front = best = settled(least)
    while cells.bounds and not front.isEmpty():
        step = looked(front, False).groupBy("source", "node").agg(F.min("cost").alias("reached"))
        merged = settled(best.join(step, ["source", "node"], "full").select("source", "node", F.least("cost", "reached").alias("cost"), (F.col("reached") < F.coalesce("cost", F.lit(math.inf))).alias("fell")))
        front, best = merged.filter("fell").select("source", "node", "cost"), merged.select("source", "node", "cost")
    return best if cells.edges.isEmpty() else looked(best, True)


# --- strong components --------------------------------------------------------------------------------------------


def strong_of(near: list[list[int]]) -> list[int]:
    """For each node the least node of its strong component, by Tarjan's depth-first search."""
    n = len(near)
    order, low, label, stack, count = [-1] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if order[root] >= 0:
            continue
        work = [(root, iter(near[root]))]
        order[root] = low[root] = count
        count += 1
        stack.append(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if order[to] < 0:
                    order[to] = low[to] = count
                    count += 1
                    stack.append(to)
                    work.append((to, iter(near[to])))
                    break
                if label[to] < 0 and order[to] < low[node]:
                    low[node] = order[to]
            else:
                work.pop()
                if work and low[node] < low[work[-1][0]]:
                    low[work[-1][0]] = low[node]
                if low[node] == order[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        if members[-1] == node:
                            break
                    least = min(members)
                    for m in members:
                        label[m] = least
    return label


def _lists(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    order = np.argsort(src, kind="stable")
    offset = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    return [to[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)]


def _labelled(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, ascending, and for each the position of the least of its strong component."""
    nodes, spots = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return nodes, np.array(strong_of(_lists(len(nodes), spots[: len(src)], spots[len(src) :])), np.int64)


def crossings(src: np.ndarray, dst: np.ndarray, entries: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tell which nodes beyond [low, high) are reached from the entries.

    A pair for each entry and node beyond; or, where they would be more than the edges, the components between.
    """
    nodes, label = _labelled(src, dst)
    n = len(nodes)
    entered = np.searchsorted(nodes, entries[np.isin(entries, nodes)])
    u, v = label[np.searchsorted(nodes, src)], label[np.searchsorted(nodes, dst)]
    kept = u != v
    links = np.unique(np.stack([u[kept], v[kept]], 1), axis=0) if kept.any() else np.zeros((0, 2), np.int64)
    near, back = _lists(n, links[:, 0], links[:, 1]), _lists(n, links[:, 1], links[:, 0])
    beyond = np.flatnonzero((nodes < low) | (nodes >= high))

    def spread(start: list[int], over: list[list[int]]) -> np.ndarray:
        seen = np.zeros(n, bool)
        stack = list(set(start))
        seen[stack] = True
        while stack:
            for to in over[stack.pop()]:
                if not seen[to]:
                    seen[to] = True
                    stack.append(to)
        return seen

    # a node beyond has no edges here, so that it is its own component
    between = spread(label[entered].tolist(), near) & spread(beyond.tolist(), back)
    links = links[between[links[:, 0]] & between[links[:, 1]]]
    first = np.unique(label[entered])
    if len(first) * len(beyond) <= 4 * len(links) + 64:
        bit = {int(b): i for i, b in enumerate(beyond)}
        reach: dict[int, int] = {}
        for root in first.tolist():
            stack = [root]
            while stack:
                node = stack[-1]
                if node in reach:
                    stack.pop()
                    continue
                left = [to for to in near[node] if between[to] and to not in reach]
                if left:
                    stack.extend(left)
                    continue
                mask = 1 << bit[node] if node in bit else 0
                for to in near[node]:
                    if between[to]:
                        mask |= reach[to]
                reach[node] = mask
                stack.pop()
        seen = {r: beyond[[i for i in range(len(beyond)) if reach[r] >> i & 1]] for r in first.tolist()}
        pairs = [(e, seen[int(label[e])]) for e in entered.tolist() if len(seen[int(label[e])])]
        if sum(len(s) for _, s in pairs) <= len(links) + len(entered):
            return (np.concatenate([np.full(len(s), nodes[e]) for e, s in pairs]), np.concatenate([nodes[s] for _, s in pairs])) if pairs else (nodes[:0], nodes[:0])
    moved = entered[(label[entered] != entered) & between[label[entered]]]
    a = np.concatenate([nodes[links[:, 0]], nodes[moved], nodes[label[moved]]])
    return a, np.concatenate([nodes[links[:, 1]], nodes[label[moved]], nodes[moved]])


def strong_components(edges: DataFrame, cell_edges: int | None = None, task_edges: int | None = None) -> DataFrame:
    """node, component of all nodes of edges(src, dst): nodes that reach each other, named by the least of them.

    Each cell tells which nodes beyond it are reached from where it is entered. The components of that reduced network,
    in which a node at which cells are entered is linked with the next ones, are closed in each cell by a second look.
    """
    bound = TASK_EDGES if task_edges is None else task_edges
    edges = settled(edges.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    total = edges.count()
    if total <= min(bound, CELL_EDGES if cell_edges is None else cell_edges):
        return settled(edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
    cells = in_cells(edges.withColumn("cost", F.lit(0.0)), cell_edges)
    src_cell, dst_cell = (cell_at(F.col(c), cells.bounds) for c in ("src", "dst"))
    entries = settled(edges.withColumn("cell", dst_cell).filter(src_cell != dst_cell).groupBy("cell").agg(F.collect_set("dst").alias("entries")))
    reduced = settled(cells.joined(entries).select("cell", "src", "dst", "entries").mapInArrow(_crossed(cells.bounds), "src long, dst long").distinct())
    left = reduced.count()
    if left <= bound:
        met = settled(reduced.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
    elif left < 0.9 * total:
        met = strong_components(reduced, cell_edges, task_edges)
    else:
        from spanwright.operators.chains import strong_components as by_joins

        met = by_joins(reduced, reduced.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    met = settled(met.groupBy("component").agg(F.collect_list("node").alias("nodes")).filter("size(nodes) > 1").select("component", F.explode("nodes").alias("node")))
    # each cell needs the labels of its own nodes and of those just beyond it
    touched = edges.withColumn("cell", src_cell).filter(src_cell != dst_cell).select("cell", F.col("dst").alias("node")).distinct()
    owned = met.withColumn("cell", cell_at(F.col("node"), cells.bounds))
    rings = owned.select("cell", "node", "component").unionByName(touched.join(sendable(met), "node").select("cell", "node", "component"))
    rings = settled(rings.groupBy("cell").agg(F.collect_list(F.struct("node", "component")).alias("rings")))
    lone = settled(entries.join(rings, "cell", "full").select("cell", F.coalesce("entries", F.array().cast("array<bigint>")).alias("entries"), F.coalesce("rings", F.array().cast("array<struct<node:bigint,component:bigint>>")).alias("rings")))
    kind = "node long, component long, met boolean"
    labels = settled(cells.joined(lone, "left").select("cell", "src", "dst", "entries", "rings").mapInArrow(_closed(cells.bounds), kind))
    least = labels.filter("met").groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(sendable(settled(least)), "component", "left").select("node", F.when(F.col("met"), F.col("least")).otherwise(F.col("component")).alias("component"))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, label = _labelled(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _pair(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("src", "dst"))


def _crossed(bounds: list[int]):
    cells = Cells(bounds, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                entries = np.array(batch.column("entries")[k].as_py(), np.int64)
                pairs = crossings(*_pair(batch, k), entries, *cells.range_of(batch.column("cell")[k].as_py()))
                if len(pairs[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(p, np.int64)) for p in pairs], ["src", "dst"])

    return run


def _closed(bounds: list[int]):
    cells = Cells(bounds, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                src, dst = _pair(batch, k)
                low, high = cells.range_of(batch.column("cell")[k].as_py())
                rings = batch.column("rings")[k].as_py() or []
                entries = np.array(batch.column("entries")[k].as_py() or [], np.int64)
                node, of = (np.array([r[c] for r in rings], np.int64) for c in ("node", "component"))
                order = np.lexsort((node, of))
                node, of = node[order], of[order]
                # a ring through the nodes of a component: each to the next one, the last to the first
                last = np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else np.zeros(0, np.int64)
                onward = np.append(node[1:], node[:1])
                onward[last] = node[np.concatenate([[0], last[:-1] + 1])] if len(of) else onward[last]
                nodes, label = _labelled(np.concatenate([src, node]), np.concatenate([dst, onward]))
                named, known = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
                at = label[np.searchsorted(nodes, node)]
                named[at], known[at] = of, True
                own = (nodes >= low) & (nodes < high)
                least = np.full(len(nodes), np.iinfo(np.int64).max)
                np.minimum.at(least, label[own], nodes[own])
                met = known[label]
                component = np.where(met, named[label], least[label])
                lone = entries[~np.isin(entries, nodes)]
                columns = [np.concatenate([nodes[own], lone]), np.concatenate([component[own], lone]), np.concatenate([met[own], np.zeros(len(lone), bool)])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "component", "met"])

    return run
