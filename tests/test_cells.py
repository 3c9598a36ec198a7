"""Searches by cells against those over the compact form, on random networks cut into many cells."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import cells as ce
from spanwright.operators import search as se
from spanwright.operators.route import RouteOptions, routes
from spanwright.plans import graph as gr
from spanwright.plans.graph import Graph
from tests.test_size import _lattice


def links(seed, nodes=160, near=6):
    """Edges mostly between near ids, a third of them both ways."""
    rng, out = random.Random(seed), set()
    for a in range(nodes):
        for _ in range(2):
            b = a + rng.randint(-near, near) if rng.random() < 0.97 else rng.randrange(nodes)
            if 0 <= b < nodes and a != b:
                out |= {(a, b), (b, a)} if rng.random() < 0.3 else {(a, b)}
    return [(a, b, float(rng.randint(1, 9))) for a, b in sorted(out)]


def least(edges, source):
    near, best, heap = {}, {}, [(0.0, source)]
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for to, step in near.get(node, []):
                heapq.heappush(heap, (cost + step, to))
    return best


@pytest.mark.parametrize("limit", [float("inf"), 25.0])
def test_costs_by_cells(spark, limit):
    rows = links(3)
    edges = spark.createDataFrame(rows, "src long, dst long, cost double")
    sources = spark.createDataFrame([(7, 7, 0.0), (90, 90, 0.0), (5000, 5000, 0.0)], "source long, node long, cost double")
    cells = ce.in_cells(edges, 90)
    assert len(cells.bounds) > 1 and cells.blocks.count() == len(cells.bounds) + 1
    known = {(s, n): c for s in (7, 90, 5000) for n, c in least(rows, s).items() if c <= limit}
    assert {(r["source"], r["node"]): r["cost"] for r in ce.costs_over(cells, sources, limit).collect()} == known
    assert se.relax(edges.limit(0), sources).count() == 3


def test_steps_are_those_of_cells(spark, monkeypatch):
    """A way of 400 edges over five cells takes a step a cell, not one an edge."""
    edges = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("cost"))
    steps, inner = [], ce.Cells.joined
    monkeypatch.setattr(ce.Cells, "joined", lambda *a: steps.append(1) or inner(*a))
    found = se.relax(edges, spark.createDataFrame([(0, 0, 0.0)], "source long, node long, cost double"), cell_edges=80)
    assert found.count() == 401 and found.agg(F.max("cost")).first()[0] == 400 and len(steps) <= 7


@pytest.mark.parametrize(("seed", "near"), [(1, 4), (5, 300)])
def test_strong_components_by_cells(spark, seed, near):
    rows = links(seed, near=near)
    edges = spark.createDataFrame(rows, "src long, dst long, cost double")
    reach = {n: set(least(rows, n)) for n in {x for r in rows for x in r[:2]}}
    known = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    for cell, task in ((None, None), (60, 10_000), (60, 100)):
        assert dict(map(tuple, ce.strong_components(edges, cell, task).collect())) == known


def test_crossings_by_either_form():
    """Many entries and ways out over one middle node: edges, not pairs, are told."""
    n = 60
    src = np.concatenate([np.arange(n), np.full(n, n)])
    dst = np.concatenate([np.full(n, n), np.arange(1000, 1000 + n)])
    a, b = ce.crossings(src, dst, np.arange(n), -np.inf, 1000)
    assert len(a) == 2 * n
    a, b = ce.crossings(src[[0, -1]], dst[[0, -1]], np.arange(1), -np.inf, 1000)
    assert (a.tolist(), b.tolist()) == ([0], [1059])


def _no_net(monkeypatch):
    def fail(self):
        raise AssertionError("the whole network was fetched")

    monkeypatch.setattr(gr, "WHOLE_SEGMENTS", 10)
    monkeypatch.setattr(ce, "CELL_EDGES", 120)
    monkeypatch.setattr(Graph, "net", fail)


def test_whole_network_searches_fetch_nothing(spark, monkeypatch):
    g = _lattice(spark, 6, 15)
    some = [r["node"] for r in g.nodes.orderBy("node").limit(2).collect()]
    sources = spark.createDataFrame([(n,) for n in some], "source long")

    def ask(graph):
        return [sorted(map(tuple, d.collect())) for d in (se.costs_from(graph, sources), se.costs_from(graph, sources, 9.0), se.strong_labels(graph), *(se.landmarks(graph, 2, how).select("landmark", "node", "d_from", "d_to") for how in (some, "farthest", "planar")))]

    known = ask(gr.replace(g, _sent={}))
    _no_net(monkeypatch)
    assert ask(gr.replace(g, _sent={})) == known and len(known[2]) == g.nodes.count()


def test_landmarks_of_parts(spark, monkeypatch):
    g = _lattice(spark, 6, 15)
    stops = spark.createDataFrame([(0, 0, 0.3, 2.0), (0, 1, 4.2, 5.0), (1, 0, 1.0, 1.5), (1, 1, 1.0, 7.5)], "route_id long, wp_idx int, x double, y double")

    def ask(graph):
        return sorted(map(tuple, routes(se.with_landmarks(graph, 2), stops, RouteOptions()).select("route_id", "ok", "weight", "settled").collect()))

    known = ask(gr.replace(g, _sent={}))
    _no_net(monkeypatch)
    assert ask(gr.replace(g, _sent={})) == known and known[0][1]
