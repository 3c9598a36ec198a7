"""Small hand-drawn networks with known answers, and random grids against a naive search."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from spanwright.functions import weights
from spanwright.functions.geometry import Metric, haversine, haversine_py
from spanwright.operators import repair, topology
from spanwright.operators.engine import register
from spanwright.operators.route import RouteOptions, routes
from spanwright.operators.search import strong
from spanwright.operators.snap import Snap, candidates
from spanwright.plans.graph import Graph, Options, build, tagged, untagged

SCHEMA = "feature_idx long, id string, geom_type string, parts array<array<struct<x:double,y:double,z:double>>>, props struct<factor:double,direction:string>"


def features(spark, lines, factors=None, directions=None):
    rows = []
    for i, line in enumerate(lines):
        pts = [(float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else None) for p in line]
        rows.append((i, f"s:{i}", "LineString", [pts], ((factors or {}).get(i, 1.0), (directions or {}).get(i, "both"))))
    return spark.createDataFrame(rows, SCHEMA)


LADDER = [[(0, 0), (10, 0), (20, 0)], [(0, 10), (10, 10), (20, 10)], [(0, 0), (0, 10)], [(10, 0), (10, 10)], [(20, 0), (20, 10)]]
COST = weights.directional


@pytest.fixture(scope="module")
def ladder(spark):
    return build(features(spark, LADDER))


def ask(spark, graph, *stops, **options):
    rows = [(r, i, float(x), float(y)) for r, route in enumerate(stops) for i, (x, y) in enumerate(route)]
    out = routes(graph, spark.createDataFrame(rows, "route_id long, wp_idx int, x double, y double"), RouteOptions(**options))
    return [r for r in out.orderBy("route_id").collect()]


def test_ladder(spark, ladder):
    one, two, three = ask(spark, ladder, [(5, 1), (15, 9)], [(0, 0), (20, 0), (20, 10), (0, 10)], [(0, 0), (20, 5)])
    assert one["weight"] == pytest.approx(20) and [(p["x"], p["y"]) for p in one["path"]] == [(5, 0), (10, 0), (10, 10), (15, 10)]
    assert [leg["weight"] for leg in two["legs"]] == [20, 10, 20] and two["weight"] == 50 and len(two["path"]) == 6
    assert three["weight"] == 25 and [(s["feature_idx"], s["start"], s["end"], s["distance"]) for s in three["sections"]] == [(0, 0, 2, 20), (4, 2, 3, 5)]


def test_one_way(spark):
    cost = COST(F.col("length") * F.col("props.factor"), F.col("props.direction"))
    g = build(features(spark, LADDER, directions={0: "forward"}), Options(weight=cost))
    assert [r["weight"] for r in ask(spark, g, [(2, 0), (8, 0)], [(8, 0), (2, 0)])] == pytest.approx([6, 34])


@pytest.mark.parametrize("algorithm", ["dijkstra", "bidijkstra"])
def test_algorithms_agree(spark, ladder, algorithm):
    stops = [[(1, 0), (19, 10)], [(0, 4), (20, 7)], [(3, 10), (3, 0)]]
    assert [r["weight"] for r in ask(spark, ladder, *stops, algorithm=algorithm)] == [r["weight"] for r in ask(spark, ladder, *stops)]


def test_elevation_is_interpolated(spark):
    g = build(features(spark, [[(0, 0, 5), (10, 0, 15)]]))
    (r,) = ask(spark, g, [(2, 0), (8, 0)])
    assert [tuple(p) for p in r["path"]] == [(2, 0, 7), (8, 0, 13)]


def test_stats_of_branches_and_rings(spark):
    branchy = [[(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)], [(4, 0), (4, 1), (4, 2)], [(4, 0), (5, 0), (6, 0)]]
    g = build(features(spark, branchy))
    assert g.stats() == {"nodes": 4, "chains": 3, "edges": 6, "alive_segments": 8, "components": 1} and g.vertices.count() == 9
    assert build(features(spark, branchy), Options(compact=False)).stats()["nodes"] == 9
    ring = build(features(spark, [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]))
    assert ring.stats() == {"nodes": 1, "chains": 1, "edges": 0, "alive_segments": 4, "components": 1}
    assert ask(spark, ring, [(1, 0), (1, 1)])[0]["weight"] == 1


def test_invalid_coordinates_break_lines(spark):
    coords = topology.coordinates(features(spark, [[(0, 5), (math.nan, 5), (10, 5)], [(0, 0), (1, 0)]]))
    assert topology.segments(topology.exact_vertices(coords), Metric()).count() == 1
    assert [tuple(r) for r in coords.filter("not valid").select("feature_idx", "part", "idx").collect()] == [(0, 0, 1)]


def test_tolerance_and_repairs(spark):
    assert build(features(spark, [[(0, 0), (10, 0)], [(10.2, 0), (20, 0)]]), Options(tolerance=0.5)).stats()["components"] == 1
    tee = features(spark, [[(0, 0), (20, 0)], [(10, 0.5), (10, 10)]])
    assert build(tee, Options(snap_dangles=0.3)).stats()["components"] == 2
    g = build(tee, Options(snap_dangles=1.0))
    assert g.stats()["components"] == 1 and ask(spark, g, [(0, 0), (10, 10)])[0]["weight"] == 20
    cross = build(features(spark, [[(0, 0), (10, 10)], [(0, 10), (10, 0)], [(2, 2), (2, 6)]]), Options(split_intersections=True))
    a, b = ask(spark, cross, [(0, 0), (0, 10)], [(2, 6), (0, 0)])
    assert cross.stats()["components"] == 1 and a["weight"] == pytest.approx(2 * 50**0.5) and b["weight"] == pytest.approx(4 + 2 * 2**0.5)


def test_policies(spark):
    g = build(features(spark, [LADDER[k] for k in (0, 1, 2, 4)] + [[(100, 0), (110, 0)]]))
    stops = [(0, 0), (105, 0), (20, 0)]
    (failed,) = ask(spark, g, stops, connectivity="nearest")
    assert not failed["ok"] and failed["reason"] == "UNREACHABLE" and failed["failed_leg"] == 0
    (skipped,) = ask(spark, g, stops, on_failure="skip", connectivity="nearest")
    assert skipped["ok"] and skipped["weight"] == 20 and [s["wp_idx"] for s in skipped["skipped"]] == [1]
    (straight,) = ask(spark, g, stops, on_failure="straight", connectivity="nearest")
    assert straight["straight_distance"] == 105 + 85
    assert ask(spark, g, [(0, 0)])[0]["reason"] == "INVALID_INPUT"


def test_connected_choice_and_optimal_selection(spark):
    g = build(features(spark, [[(0, 0), (5, 0), (10, 0), (20, 0)], [(10, 0), (10, 10)], [(0, 50), (5, 50)]]))
    (r,) = ask(spark, g, [(2, 45), (20, 1)])
    assert r["ok"] and (r["waypoints"][0]["x"], r["waypoints"][0]["y"]) == (10, 10) and r["weight"] == 20
    cost = COST(F.col("length") * F.col("props.factor"), F.col("props.direction"))
    corridor = features(spark, [[(0, 0), (100, 0)], [(0, 3.5), (100, 3.5)], [(0, 0), (0, 3.5)], [(100, 0), (100, 3.5)]], {1: 3.0})
    g = build(corridor, Options(weight=cost))
    ends = {"cost_mode": "ends", "include_snap_weight": True}
    (best,) = ask(spark, g, [(50, 2), (90, -1)], selection="optimal", **ends)
    first = best["waypoints"][0]
    assert best["weight"] == 43 and best["snap_weight"] == 3 and best["network_weight"] == 40 and first["rank"] == 1 and first["relocation"] == 0.5 and first["feature_idx"] == 0
    (back,) = ask(spark, g, [(90, -1), (50, 2)], selection="optimal", **ends)
    assert back["weight"] == pytest.approx(43) and back["waypoints"][1]["feature_idx"] == 0
    (near,) = ask(spark, g, [(50, 2), (90, -1)], **ends)
    assert near["snap_weight"] == 2.5 and near["weight"] == near["network_weight"] + 2.5 > 43 and near["waypoints"][0]["feature_idx"] == 1
    (plain,) = ask(spark, g, [(50, 2), (90, -1)], cost_mode="ends", connectors="ends", include_connector_distance=True)
    assert plain["weight"] == near["network_weight"] and plain["distance"] == pytest.approx(plain["network_distance"] + 2.5) and tuple(plain["path"][0])[:2] == (50, 2)
    (one,) = ask(spark, g, [(50, 2), (90, -1)], selection="optimal", snap=Snap(candidates=1))
    assert one["waypoints"][0]["rank"] == 0


def test_snap_connectivity_and_constraints(spark):
    from spanwright.operators.route import routes as run

    g = build(features(spark, [[(0, 0), (5, 0), (10, 0), (20, 0)], [(10, 0), (10, 10)], [(0, 50), (5, 50)]]))
    (r,) = ask(spark, g, [(2, 45), (20, 1)], connectivity="nearest")
    assert (r["ok"], r["reason"], r["failed_leg"]) == (False, "UNREACHABLE", 0)
    (r,) = ask(spark, g, [(2, 45), (20, 1)], snap=Snap(max_distance=10))
    assert (r["ok"], r["reason"]) == (False, "DISCONNECTED")
    stops = spark.createDataFrame([(1, 0, 2.0, 45.0, 1), (1, 1, 20.0, 1.0, 0)], "route_id long, wp_idx int, x double, y double, only long")
    (r,) = run(g, stops, RouteOptions(snap=Snap(allowed=F.col("feature_idx") == F.col("only")))).collect()
    assert r["ok"] and [w["feature_idx"] for w in r["waypoints"]] == [1, 0]
    places = stops.withColumn("point_id", F.col("wp_idx"))
    assert [candidates(g, places, Snap(candidates=16, search_limit=n)).count() for n in (1, 2)] == [2, 4]
    # the node (10, 0) is one place, whichever of its three segments is looked at
    node = spark.createDataFrame([(0, 9.0, -1.0)], "point_id long, x double, y double")
    assert sum((r["x"], r["y"]) == (10, 0) for r in candidates(g, node, Snap(candidates=16)).collect()) == 1


def test_an_own_search_reaches_the_workers(spark, ladder):
    from spanwright.operators.engine import dijkstra

    def twice(net, sources, targets, **options):
        found = dijkstra(net, sources, targets, **options)
        found.settled *= 1000
        return found

    register("own", twice, replace=True)
    (r,) = ask(spark, ladder, [(5, 1), (15, 9)], algorithm="own")
    assert r["weight"] == 20 and r["settled"] >= 1000


def floors(spark, lines):
    """lines: (points, group, end group, cost or null)."""
    rows = [(i, f"s:{i}", "LineString", [[(float(x), float(y), None) for x, y in pts]], (a, b, None if cost is None else float(cost))) for i, (pts, a, b, cost) in enumerate(lines)]
    return spark.createDataFrame(rows, "feature_idx long, id string, geom_type string, parts array<array<struct<x:double,y:double,z:double>>>, props struct<a:string,b:string,cost:double>")


def between(spark, graph, *stops):
    rows = [(0, i, float(x), float(y), grp) for i, (x, y, grp) in enumerate(stops)]
    waypoints = spark.createDataFrame(rows, "route_id long, wp_idx int, x double, y double, floor string")
    return routes(graph, waypoints, RouteOptions(snap=Snap(group=F.col("floor")))).first()


def test_tower(spark):
    lines = [part for f in "123" for part in (([(0, 10), (20, 10)], f, f, None), ([(10, 0), (10, 20)], f, f, None))]
    lines += [([(10, 10), (10, 10)], "1", "2", 4), ([(10, 10), (10, 10)], "2", "3", 4)]
    levels = spark.createDataFrame([(f, float(f), 4.0 * (int(f) - 1)) for f in "123"], "group_key string, ordinal double, elevation double")
    cost = F.coalesce(F.col("props.cost"), F.col("length"))
    o = {"split_intersections": True, "weight": F.struct(cost.alias("forward"), cost.alias("backward")), "group": F.col("props.a"), "end_group": F.col("props.b"), "zero_weight": "free"}
    g = build(floors(spark, lines), Options(**o, levels=levels))
    r = between(spark, g, (2, 10, "1"), (10, 18, "3"))
    assert r["weight"] == pytest.approx(24) and r["distance"] == pytest.approx(16) and r["level_changes"] == 2 and r["vertical_distance"] == pytest.approx(8)
    assert r["levels"] == ["1", "1", "2", "3", "3"] and len(r["path"]) == 5 and [s["grp"] for s in r["sections"]] == ["1", None, None, "3"]
    (t,) = r["transitions"]
    assert (t["from_level"], t["to_level"], t["level_change"], t["start"], t["end"], t["distance"], t["weight"], len(t["feature_idx"])) == ("1", "3", 2, 1, 3, 0, pytest.approx(8), 2)
    assert g.per_level == pytest.approx(4, rel=1e-5) and len(set(g.net().ordinals)) == 3
    assert r["settled"] <= between(spark, build(floors(spark, lines), Options(**o)), (2, 10, "1"), (10, 18, "3"))["settled"]


def test_rides_between_stops(spark):
    from spanwright.operators.diagnostics import connector_ends, level_reachability, missing_ordinals
    from spanwright.operators.levels import point_stops

    levels = spark.createDataFrame([(f, float(f), None) for f in "1234"], "group_key string, ordinal double, elevation double")
    lines = floors(spark, [([(0, 10), (10, 10), (20, 10)], f, f, None) for f in "1234"])
    stops = spark.createDataFrame([(0, i, f, 10.0, 10.0, 5.0, 1.0, "both") for i, f in enumerate("1234")], "connector_idx int, stop_idx int, grp string, x double, y double, board_cost double, per_level_cost double, direction string")
    express = build(lines, Options(group=F.col("props.a"), levels=levels, connectors=stops))
    r = between(spark, express, (2, 10, "1"), (18, 10, "4"))
    assert r["weight"] == pytest.approx(24) and r["level_changes"] == 3 and [s["grp"] for s in r["sections"]] == ["1", None, "4"]

    lines = floors(spark, [([(0, 0), (10, 0)], f, f, None) for f in "13"])
    lift = spark.createDataFrame([(0, 10.0, 0.0, ["1", "2", "3"], 30.0, 5.0, "both", 7)], "connector_idx int, x double, y double, groups array<string>, board_cost double, per_level_cost double, direction string, feature_idx long")
    g = build(lines, Options(group=F.col("props.a"), levels=levels, connectors=point_stops(lift)))
    r = between(spark, g, (0, 0, "1"), (0, 0, "3"))
    assert r["weight"] == pytest.approx(60) and [(t["from_level"], t["to_level"], t["level_change"]) for t in r["transitions"]] == [("1", "3", 2)]
    ends = connector_ends(g.segments.select(F.col("u").alias("a"), F.col("v").alias("b"), *(F.col(f"{n}{c}").alias(f"{k}{c}") for n, k in (("u", "a"), ("v", "b")) for c in ("x", "y", "_grp"))))
    assert [tuple(r)[1:] for r in ends.collect()] == [(10, 0, "2")]
    assert {r["grp"]: (r["reaches"], r["isolated"]) for r in level_reachability(g).collect()}["1"] == (["2", "3"], False)
    assert [r["grp"] for r in missing_ordinals(g, levels.filter("group_key <> '3'")).collect()] == ["3"]


def test_snapping(spark, ladder):
    pts = spark.createDataFrame([(0, 4.0, 3.0), (1, 12.0, 7.0), (2, 1000.0, 1000.0)], "point_id long, x double, y double")
    found = {r["point_id"]: r for r in candidates(ladder, pts).collect()}
    assert (found[0]["x"], found[0]["y"], found[0]["distance"]) == (4, 0, 3) and (found[1]["x"], found[1]["y"]) == (10, 7)
    assert found[2]["distance"] == pytest.approx(math.hypot(980, 990))
    with pytest.raises(ValueError):
        Snap(candidates=17)


def test_random_grid_against_naive_search(spark):
    rng = random.Random(5)
    lines, factors, directions = [], {}, {}
    for x in range(6):
        for y in range(6):
            for a, b in (((x, y), (x + 1, y)), ((x, y), (x, y + 1))):
                if max(b) < 6 and rng.random() < 0.85:
                    factors[len(lines)] = float(rng.randint(1, 9))
                    directions[len(lines)] = rng.choice(["both", "both", "both", "forward", "backward", "none"])
                    lines.append([a, b])
    near: dict = {}
    for i, (a, b) in enumerate(lines):
        if directions[i] in ("both", "forward"):
            near.setdefault(a, []).append((b, factors[i]))
        if directions[i] in ("both", "backward"):
            near.setdefault(b, []).append((a, factors[i]))

    def naive(a, b):
        done, heap = {}, [(0.0, a)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done[v] = d
            for w, c in near.get(v, []):
                heapq.heappush(heap, (d + c, w))
        return done.get(b)

    g = build(features(spark, lines, factors, directions), Options(weight=COST(F.col("length") * F.col("props.factor"), F.col("props.direction"))))
    live = sorted({p for i, line in enumerate(lines) if directions[i] != "none" for p in line})
    pairs = [(rng.choice(live), rng.choice(live)) for _ in range(40)]
    for r, (a, b) in zip(ask(spark, g, *([a, b] for a, b in pairs), connectivity="nearest"), pairs, strict=True):
        assert r["weight"] == naive(a, b), (a, b, r["reason"])
    labels = strong(g.net())
    assert len(labels) == g.nodes.count()


def test_weights_and_metrics(spark):
    one = spark.range(1)
    inf = float("inf")
    row = one.select(*(weights.normalised(F.lit(v).cast("double")).alias(f"c{i}") for i, v in enumerate((2.0, 0.0, None, float("nan"), inf)))).first()
    assert list(row) == [2.0, inf, inf, inf, inf]
    with pytest.raises(Exception, match="negative"):
        one.select(weights.normalised(F.lit(-1.0))).collect()
    d = one.select(haversine(F.lit(13.0), F.lit(52.0), F.lit(13.001), F.lit(52.0))).first()[0]
    assert d == pytest.approx(haversine_py(13.0, 52.0, 13.001, 52.0)) == pytest.approx(68.46, abs=0.01)


def test_saved_graphs_round_trip(spark, ladder, tmp_path):
    ladder.save(str(tmp_path / "g"), {"note": [1.5, float("inf")]})
    head = Graph.inspect(spark, str(tmp_path / "g"))
    assert head["meta"] == {"note": [1.5, float("inf")]} and head["stats"] == ladder.stats()
    assert ask(spark, Graph.load(spark, str(tmp_path / "g")), [(5, 1), (15, 9)])[0]["weight"] == 20
    assert math.isnan(untagged(tagged(float("nan"))))


def test_registry_and_options():
    with pytest.raises(ValueError, match="registered"):
        register("dijkstra", lambda *a, **k: None)
    with pytest.raises(ValueError, match="unknown algorithm"):
        RouteOptions(algorithm="nothing")
    with pytest.raises(ValueError):
        Options(tolerance=-1)


def test_overlaps_and_crossings(spark):
    from spanwright.operators.diagnostics import overlaps

    segs = topology.segments(topology.exact_vertices(topology.coordinates(features(spark, [[(30, 0), (40, 0)], [(35, 0), (45, 0)], [(37, -2), (37, 2)]]))), Metric())
    assert [(r["feature_a"], r["feature_b"], r["length"]) for r in overlaps(segs).collect()] == [(0, 1, 5.0)]
    assert {(r["feature_idx1"], r["feature_idx2"]) for r in repair.intersections(segs).collect()} == {(0, 2), (1, 2)}
