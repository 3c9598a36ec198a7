"""Work that must not grow with repeated points, routes or with the network beyond the places asked for."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.functions import weights
from spanwright.operators import route as rt
from spanwright.operators import snap as sn
from spanwright.operators.engine import Net, apart
from spanwright.operators.route import RouteOptions, routes
from spanwright.operators.snap import Snap, candidates
from spanwright.plans import graph as gr
from spanwright.plans.graph import Graph, Options, build
from tests.test_network import LADDER, features


@pytest.fixture(scope="module")
def ladder(spark):
    return build(features(spark, LADDER))


@pytest.mark.parametrize("make", [lambda: Snap(), lambda: Snap(candidates=3, max_distance=9.0), lambda: Snap("vertex"), lambda: Snap(candidates=2, allowed=F.col("feature_idx") != 0)])
def test_points_at_one_spot_ask_once(spark, ladder, monkeypatch, make):
    snap, asked, shaped = make(), [], sn._shaped

    def counting(points, *rest):
        asked.append(points.select("point_id").distinct().count())
        return shaped(points, *rest)

    spots = [(5.0, 1.0), (15.0, 9.0), (3.0, 4.0)]
    points = spark.createDataFrame([(i, *spots[i % 3]) for i in range(60)], "point_id long, x double, y double")
    alone = spark.createDataFrame([(i, *spots[i]) for i in range(3)], "point_id long, x double, y double")
    monkeypatch.setattr(sn, "_shaped", counting)
    told = ["rank", "feature_idx", "x", "y", "distance", "side", "measure"]
    known = {tuple(r) for r in candidates(ladder, alone, snap).select("point_id", *told).collect()}
    asked.clear()
    found = [tuple(r) for r in candidates(ladder, points, snap).select("point_id", *told).collect()]
    assert max(asked) == 3 and sorted(found) == sorted((i, *k[1:]) for i in range(60) for k in known if k[0] == i % 3)


def test_a_condition_on_points_is_asked_for_each(spark, ladder):
    points = spark.createDataFrame([(i, 5.0, 1.0, i) for i in range(3)], "point_id long, x double, y double, own long")
    found = candidates(ladder, points, Snap(allowed=F.col("feature_idx") == F.col("own"), search_limit=100))
    assert {(r["point_id"], r["feature_idx"]) for r in found.collect()} == {(0, 0), (1, 1), (2, 2)}


def _lattice(spark, wide, high):
    """Rows of one way up to the middle one, which leads back; every column is a street both ways."""
    lines, ways = [], {}
    for y in range(high):
        for x in range(wide):
            if x + 1 < wide:
                ways[len(lines)] = "both" if y % 3 == 0 else "forward"
                lines.append([(x, y), (x + 1, y)])
            if y + 1 < high and x != 1:
                ways[len(lines)] = "forward" if x == 2 else "both"
                lines.append([(x, y), (x, y + 1)])
    factors = {i: 1.0 + i * 7 % 5 for i in range(len(lines))}
    cost = weights.directional(F.col("length") * F.col("props.factor"), F.col("props.direction"))
    return build(features(spark, lines, factors, ways), Options(weight=cost))


@pytest.fixture(scope="module")
def lattice(spark):
    return _lattice(spark, 6, 60)


TRIPS = [(0.3, 2.0, 4.2, 5.0), (1.0, 1.5, 1.0, 7.5), (4.9, 3.0, 0.1, 4.0), (2.0, 8.5, 2.0, 2.5), (3.0, 0.0, 3.0, 58.0)]
TOLD = ["ok", "reason", "failed_leg", "weight", "distance", "settled", "path", "sections"]


def _ask(spark, graph, times, trips=TRIPS, **options):
    rows = [(k * times + n, i, *t[2 * i : 2 * i + 2]) for k, t in enumerate(trips) for n in range(times) for i in (0, 1)]
    out = routes(graph, spark.createDataFrame(rows, "route_id long, wp_idx int, x double, y double"), RouteOptions(**options))
    return {r["route_id"]: tuple(r[c] for c in TOLD) for r in out.collect()}


@pytest.mark.parametrize("options", [{}, {"algorithm": "bidijkstra"}, {"selection": "optimal", "cost_mode": "ends"}])
def test_routes_over_parts_are_those_of_the_whole(spark, lattice, monkeypatch, options):
    known = _ask(spark, lattice, 1, **options)
    monkeypatch.setattr(gr, "WHOLE_SEGMENTS", 10)
    sizes, part = [], Graph.part

    def counted(self, *rest):
        sizes.append(part(self, *rest))
        return sizes[-1]

    monkeypatch.setattr(Graph, "part", counted)
    assert _ask(spark, replace(lattice, _sent={}), 1, **options) == known
    sizes.clear()
    near = _ask(spark, replace(lattice, _sent={}), 1, trips=TRIPS[:4], **options)
    assert near == {k: v for k, v in known.items() if k < 4}
    assert sizes and len(sizes[0].node_ids) < lattice.nodes.count() / 2 and sizes[0].cut


def test_equal_routes_are_planned_once(spark, lattice, monkeypatch):
    planned, inner = [], rt._planned

    def counting(graph, points, *rest):
        planned.append(points.select("route_id").distinct().count())
        return inner(graph, points, *rest)

    once = _ask(spark, lattice, 1)
    monkeypatch.setattr(rt, "_planned", counting)
    assert _ask(spark, lattice, 4) == {k: once[k // 4] for k in range(4 * len(TRIPS))} and planned == [len(TRIPS)]


def test_totals_without_details(spark, lattice):
    full, lean = (_ask(spark, lattice, 1, details=d, on_failure="straight") for d in (True, False))
    assert {k: v[:6] for k, v in lean.items()} == {k: v[:6] for k, v in full.items()} and all(not v[6] for v in lean.values())


def test_costs_over_parts(spark, lattice, monkeypatch):
    def ask(graph):
        ends = [spark.createDataFrame([(k, *t[i : i + 2]) for k, t in enumerate(TRIPS[:4])], "point_id long, x double, y double") for i in (0, 2)]
        return sorted(map(tuple, rt.one_to_many(graph, *ends).collect()))

    known = ask(lattice)
    monkeypatch.setattr(gr, "WHOLE_SEGMENTS", 10)
    assert ask(replace(lattice, _sent={})) == known and any(w < float("inf") for _, _, w in known)


def test_the_smaller_side_tells_what_is_not_reached():
    """A chain of 1000 nodes leads to node 0; nothing leads to node 1001, whatever the source can reach."""
    n = 1002
    src = np.arange(n - 2, 0, -1)
    order = np.argsort(src)
    offset = np.searchsorted(src[order], np.arange(n + 1))
    net = Net(np.arange(n), offset, (src - 1)[order], np.ones(len(src)), np.zeros(len(src), int), np.zeros(n, int), np.zeros((n, 2)))
    assert 0 < apart(net, {1000}, {1001}) < 10 and not apart(net, {1000}, {0}) and apart(net, {0}, {5})
    assert not apart(replace(net, cut=frozenset({0, 1001, 5})), {0}, {5})


def test_the_sides_stay_near():
    """Two nodes side by side in a long strip: what lies far off is not looked at."""
    n, looked = 2000, set()
    links = sorted({(a, b) for i in range(n) for a, b in ((i, i + 2), (i + 2, i), (i, i ^ 1)) if max(a, b) < n})
    src, to = np.array(links).T
    net = Net(np.arange(n), np.searchsorted(src, np.arange(n + 1)), to, np.ones(len(src)), np.zeros(len(src), int), np.zeros(n, int), np.zeros((n, 2)))

    class Seen(frozenset):
        def __contains__(self, node):
            looked.add(node)
            return False

    assert not apart(replace(net, cut=Seen()), {1000}, {1007}) and len(looked) < 40
