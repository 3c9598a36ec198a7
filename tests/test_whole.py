"""The driver's queries take all rows of their tables: small tables of which the former filters kept little or nothing."""

import math
import random
from fractions import Fraction
from itertools import combinations

import pytest

from spanwright.plans import queries as q

random.seed(5)
#: Orders with keys that neither 10 nor 100 nor 400 divides.
ORDERS = {key: random.sample(range(200), random.randint(2, 5)) for key in range(1, 10)} | {11: [0, 1, 2], 12: [1, 2, 3]}


@pytest.fixture(scope="module")
def trips(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trips"))
    rows = [(key, i + 1, part, 0, 0.0) for key, parts in ORDERS.items() for i, part in enumerate(parts)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    return path


def legs():
    """(feature, segment): the ends of each trip's segments."""
    return {(key, i): ((a % 50, a // 50), (b % 50, b // 50)) for key, parts in ORDERS.items() for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))}


def crossings():
    """(pair of segments): the fractions on both and the place, exactly."""
    out = {}
    for (m, ((ax, ay), (bx, by))), (n, ((cx, cy), (dx, dy))) in combinations(sorted(legs().items()), 2):
        det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if det and not {(ax, ay), (bx, by)} & {(cx, cy), (dx, dy)}:
            t = Fraction((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), det)
            u = Fraction((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), det)
            if 0 <= t <= 1 and 0 <= u <= 1:
                out[m, n] = (t, u, (ax + t * (bx - ax), ay + t * (by - ay)))
    return out


def test_trips_of_all_orders(spark, trips):
    items, segments = sum(map(len, ORDERS.values())), len(legs())
    assert q.extent(spark, trips).first()["n"] == items
    assert q.measures_running(spark, trips).count() == segments
    assert {(r["feature_idx"], r["segments"]) for r in q.part_runs(spark, trips).collect()} == {(k, len(p) - 1) for k, p in ORDERS.items()}
    assert sum(r["coordinates"] for r in q.vertices_exact(spark, trips).collect()) == items
    bad = {(k, 0, i) for k, p in ORDERS.items() for i in range(len(p)) if (k + i) % 4 == 3}
    assert set(map(tuple, q.invalid_coordinates(spark, trips).collect())) == bad
    stats = q.build_stats(spark, trips).first()
    assert stats["features"] == len(ORDERS) and stats["invalid_coordinates"] == len(bad)


def test_dangles_of_all_orders(spark, trips):
    ends = [(place, key) for (key, _), two in legs().items() for place in two]
    lone = {(float(x), float(y), key) for (x, y), key in ends if sum(p == (x, y) for p, _ in ends) == 1}
    assert set(map(tuple, q.dangles(spark, trips).collect())) == lone and lone


def test_crossings_of_all_orders(spark, trips):
    known = {(*m, *n): (float(x), float(y)) for (m, n), (_, _, (x, y)) in crossings().items()}
    found = {tuple(r)[:4]: tuple(r)[4:] for r in q._meetings(q._trip_segments(spark, trips)).collect()}
    assert found.keys() == known.keys() and len(known) > 20
    assert all(found[k] == pytest.approx(known[k], abs=1e-6) for k in known)


def test_pieces_of_all_orders(spark, trips):
    cuts = {s: set() for s in legs()}
    for (m, n), (t, u, place) in crossings().items():
        for s, at in ((m, t), (n, u)):
            cuts[s] |= {place} if 0 < at < 1 else set()
    found = {r["feature_idx"]: (r["pieces"], r["length"]) for r in q._pieces(q._trip_segments(spark, trips)).collect()}
    assert found.keys() == ORDERS.keys()
    for key in ORDERS:
        mine = {s: ends for s, ends in legs().items() if s[0] == key}
        assert found[key][0] == sum(1 + len(cuts[s]) for s in mine)
        assert found[key][1] == pytest.approx(sum(math.dist(*ends) for ends in mine.values()), abs=1e-5)


def test_overlaps_of_all_orders(spark, trips):
    known = {}
    for (m, (a, b)), (n, (c, d)) in combinations(sorted(legs().items()), 2):
        if all((b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) for p in (c, d)):
            s, e = sorted(((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / math.dist(a, b) for p in (c, d))
            if min(math.dist(a, b), e) - max(0.0, s) > 1e-9:
                known[*m, *n] = min(math.dist(a, b), e) - max(0.0, s)
    found = {tuple(r)[:4]: r["length"] for r in q._shared(q._trip_segments(spark, trips)).collect()}
    assert found.keys() == known.keys() and (11, 1, 12, 0) in known
    assert all(found[k] == pytest.approx(known[k], abs=1e-6) for k in known)


PARTS = range(150)
#: Events with ids that 20 does not divide, five of each of three users.
EVENTS = [(i, i % 3, 1000 - 7 * i) for i in range(1, 16)]


@pytest.fixture(scope="module")
def stops(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stops"))
    spark.createDataFrame([(p, 1 + p % 10) for p in PARTS], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame(EVENTS, "event_id long, user_id long, ts long").write.parquet(f"{path}/events.parquet")
    return path


def streets():
    """feature: the ends of each of the grid's segments."""
    out = {2 * p: ((p % 50, p // 50), (p % 50 + 1, p // 50)) for p in PARTS if p % 50 < 49}
    return out | {2 * p + 1: ((p % 50, p // 50), (p % 50, p // 50 + 1)) for p in PARTS if p % 5 == 0 and p + 50 in PARTS}


def spots():
    return {i: (user * 7 % 50 + 0.25, i % 40 + 0.375) for i, user, _ in EVENTS}


def snapped(k, allowed=lambda f: True, limit=math.inf):
    """(event, feature, rank, distance) of each event's nearest segments, all of them tried."""
    out = []
    for i, (x, y) in spots().items():
        feet = {f: (min(max(x, a[0]), b[0]), min(max(y, a[1]), b[1])) for f, (a, b) in streets().items() if allowed(f)}
        near, seen = [], set()
        for d, f in sorted((round(math.dist((x, y), p), 9), f) for f, p in feet.items()):
            at = feet[f] if feet[f] in streets()[f] else f  # at a node its segments give one place
            if at not in seen:
                seen.add(at)
                near.append((d, f))
        out += [(i, f, n, d) for n, (d, f) in enumerate([m for m in near if m[0] <= limit][:k])]
    return sorted(out)


@pytest.mark.parametrize(("name", "known"), [("nearest_edge", (1,)), ("candidates_k", (4,)), ("candidates_max_distance", (16, lambda f: True, 0.4)), ("candidates_feature_ids", (2, lambda f: f in (20, 40, 101, 200, 201, 310))), ("candidates_filter", (3, lambda f: f % 2 == 1))])
def test_places_of_all_events(spark, stops, name, known):
    found = q.QUERIES[name](spark, stops).select("point_id", "feature_idx", "rank", "distance").collect()
    assert sorted(map(tuple, found)) == snapped(*known) and found


def test_vertices_of_all_events(spark, stops):
    ends = [p for two in streets().values() for p in two]
    for name, of in (("nearest_vertex", set(ends)), ("nearest_node", {p for p in ends if ends.count(p) != 2})):
        known = {i: round(min(math.dist(at, p) for p in of), 9) for i, at in spots().items()}
        assert {r["point_id"]: r["distance"] for r in q.QUERIES[name](spark, stops).collect()} == known


def test_tours_of_all_events(spark, stops):
    # a route for each event that has one before it: all but the latest ids, which come first in time
    rows = q.route_legs_totals(spark, stops).collect()
    assert {(r["route_id"], r["ok"], r["n_legs"]) for r in rows} == {(i, True, 1) for i in range(1, 13)}
    for name in ("optimal_selection", "geojson_linestring"):
        assert {r["route_id"] for r in q.QUERIES[name](spark, stops).collect()} == set(range(1, 13))
    for name in ("route_skip", "route_straight"):
        assert {r["route_id"] for r in q.QUERIES[name](spark, stops).collect()} == {0, 1, 2}
    # all events but event 1 lie beyond the last row and snap to one place for each user, so that only the trip to it moves
    assert {r["route_id"] for r in q.route_sections(spark, stops).collect()} == {1}


def test_near_misses_of_rows_too(spark, stops):
    found = {(r["x"], r["y"], r["feature_a"]) for r in q.near_misses(spark, stops).collect()}
    assert {r for r in found if r[2] % 2 == 0} == {(0.0, 0.0, 0), (0.0, 1.0, 100), (0.0, 2.0, 200)}
    assert len({r for r in found if r[2] % 2 == 1}) == 2 * sum(f % 2 for f in streets())
