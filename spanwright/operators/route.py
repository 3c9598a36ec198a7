"""Batches of routes: candidate choice, failure policies, legs, sections, geometry and totals.

Candidates come from the grid join of ``snap``; each route is then planned in one task over the broadcast network,
because what a leg connects can depend on earlier failures. Routes are independent, so a batch of any size spreads.
Routes through the same places are planned once. Of a large network the part around the places is sent; a search that
would go on beyond it is repeated with a wider part, so that the result is that of the whole network.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.engine import KNOW_CUTS, Anchor, Cut, Engine, Leg, Net, apart, connect, dijkstra, engine, partial_cost
from spanwright.operators.snap import Snap, _by_spot, _targets, candidates
from spanwright.plans import graph as gr
from spanwright.plans.graph import Graph
from spanwright.plans.materialise import settled

INF = math.inf
#: Legs that a task remembers.
KNOWN_LEGS = 50_000


@dataclass(frozen=True)
class RouteOptions:
    """Defaults follow the catalogue in SURVEY section 2.15.

    algorithm: the name of a registered search, or the search. cost_mode: whether leaving the first and reaching the
    last place costs (snap_cost times the distance), with 'arrive-depart' reaching and leaving every other one too.
    connectors: the path goes on to the waypoints themselves, at its ends or at every leg. include_snap_weight and
    include_connector_distance add these to weight and distance. Without details, path, legs, sections and waypoints stay
    empty, except with levels or connectors.
    """

    algorithm: str | Engine = "astar"
    snap: Snap = field(default_factory=Snap)
    selection: str = "nearest"
    connectivity: str = "connected"
    snap_cost: float = 1.0
    cost_mode: str = "none"
    on_failure: str = "fail"
    skip_max: float = INF
    skip_leading: bool = False
    max_cost: float = INF
    max_settled: float = INF
    sections_detail: str = "feature"
    connectors: str | None = None
    include_snap_weight: bool = False
    include_connector_distance: bool = False
    details: bool = True

    def __post_init__(self) -> None:
        engine(self.algorithm)
        for name, known in (("selection", ("nearest", "optimal")), ("connectivity", ("connected", "reachable", "nearest")), ("cost_mode", ("none", "ends", "arrive-depart")), ("on_failure", ("fail", "skip", "straight")), ("sections_detail", ("feature", "measure", "segment")), ("connectors", (None, "ends", "legs"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {known}")
        if self.max_cost < 0 or self.max_settled < 1 or not 0 <= self.snap_cost < INF:
            raise ValueError("budgets and costs are not negative")


_POINT = "struct<x:double,y:double,z:double>"
ROUTE = (
    "route_id long, ok boolean, reason string, failed_leg int, weight double, distance double, snap_weight double, network_weight double, network_distance double, "
    f"straight_distance double, level_changes double, vertical_distance double, settled long, path array<{_POINT}>, levels array<string>, "
    "legs array<struct<from_wp:int,to_wp:int,weight:double,distance:double,straight:boolean>>, "
    "sections array<struct<leg:int,feature_idx:bigint,start:int,end:int,distance:double,weight:double,measure_start:double,measure_end:double,grp:string>>, "
    "transitions array<struct<leg:int,from_level:string,to_level:string,level_change:double,start:int,end:int,feature_idx:array<bigint>,weight:double,distance:double>>, "
    "waypoints array<struct<wp_idx:int,x:double,y:double,distance:double,relocation:double,rank:int,relocated:boolean,feature_idx:bigint>>, "
    "skipped array<struct<wp_idx:int,reason:string>>"
)
_NAMES = ["route_id", "ok", "reason", "failed_leg", "weight", "distance", "snap_weight", "network_weight", "network_distance", "straight_distance", "level_changes", "vertical_distance", "settled", "path", "levels", "legs", "sections", "transitions", "waypoints", "skipped"]


def routes(graph: Graph, waypoints: DataFrame, options: RouteOptions | None = None) -> DataFrame:
    """One row for each route of waypoints(route_id, wp_idx, x, y, ...); a failed one has ok false and a reason.

    Reasons: INVALID_INPUT (fewer than two places, or one without coordinates), NO_CANDIDATE, DISCONNECTED,
    UNREACHABLE, BUDGET_EXCEEDED. With on_failure 'skip' a waypoint that cannot be reached is left out, with
    'straight' the leg is a straight line of its length. The snap's group and allowed may refer to the waypoints'
    further columns. With levels, ``levels`` has the path points' groups, and transitions are the rides between groups.
    """
    o = options or RouteOptions()
    own = {"route_id": F.col("route_id").cast("long"), "wp_idx": F.col("wp_idx").cast("int"), "x": F.col("x").cast("double"), "y": F.col("y").cast("double")}
    points = waypoints.withColumns(own).withColumn("point_id", F.struct("route_id", "wp_idx"))
    snap = o.snap
    if o.selection == "optimal" and snap.candidates is None:
        snap = replace(snap, candidates=4)
    if snap.group is not None or not _by_spot(_targets(graph, snap), snap):
        return _planned(graph, points, o, snap)
    shapes = settled(points.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("wp_idx", "x", "y"))).alias("shape")))
    firsts = settled(shapes.groupBy("shape").agg(F.min("route_id").alias("first")))
    if firsts.count() == shapes.count():
        return _planned(graph, points, o, snap)
    once = firsts.select(F.col("first").alias("route_id"), F.explode("shape").alias("s")).select("route_id", "s.*").withColumn("point_id", F.struct("route_id", "wp_idx"))
    own = shapes.join(firsts, "shape").select("route_id", "first")
    return own.join(_planned(graph, once, o, snap).withColumnRenamed("route_id", "first"), "first").select(*_NAMES)


def _planned(graph: Graph, points: DataFrame, o: RouteOptions, snap: Snap) -> DataFrame:
    good = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    if o.selection == "optimal" or o.connectivity == "nearest" or snap.mode == "exact":
        found = candidates(graph, good, snap)
    else:
        found = _shared(graph, good, snap)
    fields = ["rank", "distance", "x", "y", "chain_id", "pos", "component", "grp", "feature_idx"]
    listed = found.groupBy("route_id", "wp_idx").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("places"))
    stops = points.select("route_id", "wp_idx", F.col("x").alias("px"), F.col("y").alias("py")).join(listed, ["route_id", "wp_idx"], "left")
    plans = stops.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("wp_idx", "px", "py", "places"))).alias("stops"))
    # routes that start at one place have legs in common
    start = F.col("stops")[0]
    plans = plans.repartitionByRange(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), start["px"], start["py"], "route_id")
    # columns cannot be sent to workers, and a search registered here is not known there
    plain = replace(o, snap=Snap(o.snap.mode), algorithm=engine(o.algorithm))
    if not in_parts(graph, plain.algorithm):
        return plans.mapInPandas(_planner(graph.shared_net(), plain, graph.metric), ROUTE)
    plans = settled(plans)
    places = plans.select("route_id", F.explode("stops").alias("s")).select("route_id", F.explode("s.places").alias("p")).select("route_id", "p.x", "p.y", "p.chain_id")
    return over_parts(graph, plans, places, "route_id", lambda part: plans_over(part, plain, graph.metric), "ok is null")


def plans_over(shared, o: RouteOptions, metric):
    return lambda left: left.mapInPandas(_planner(shared, o, metric), ROUTE)


def in_parts(graph: Graph, search: Engine) -> bool:
    """Whether searches take a part of the network: it is large, was not made compact before, and the search knows of cuts."""
    return search in KNOW_CUTS and "net" not in graph._sent and graph.extent()[0] > gr.WHOLE_SEGMENTS


def over_parts(graph: Graph, asked: DataFrame, places: DataFrame, key: str, ask: Callable, open_: str, common: DataFrame | None = None) -> DataFrame:
    """What ``ask`` finds for the rows of asked, over the network around their places(key, x, y, chain_id) and those common to all.

    Rows whose result meets open_ go on to a part that is wider by five times the margin, at last to the whole network.
    """
    _, *whole = graph.extent()
    out, margin, left = None, None, asked
    places = settled(places.select(key, "x", "y", F.col("chain_id").cast("long").alias("chain_id")))
    while True:
        spots = places.drop(key) if common is None else places.drop(key).unionByName(common)
        box = spots.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        box = [0.0] * 4 if box[0] is None else list(box)
        if margin is None:
            side = math.sqrt(max((whole[2] - whole[0]) * (whole[3] - whole[1]), 0.0) / graph.extent()[0] * 64)
            margin = max(box[2] - box[0], box[3] - box[1], side) / 2
        box = [box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin]
        last = box[0] <= whole[0] and box[1] <= whole[1] and box[2] >= whole[2] and box[3] >= whole[3]
        shared = graph.shared_net() if last else graph.spark.sparkContext.broadcast(graph.part(tuple(box), spots.select("chain_id").distinct()))
        found = ask(shared)(left)
        if last:
            return found if out is None else out.unionByName(found)
        found = settled(found)
        done = found.filter(f"not ({open_})")
        out = done if out is None else out.unionByName(done)
        more = settled(found.filter(open_).select(key))
        if more.isEmpty():
            return out
        left, places = (settled(d.join(more, key, "left_semi")) for d in (left, places))
        margin *= 5


def _shared(graph: Graph, points: DataFrame, snap: Snap) -> DataFrame:
    """Nearest places; those of routes on which they lie in different components go on to one place a component."""
    nearest = settled(candidates(graph, points, replace(snap, candidates=1)))
    apart = nearest.groupBy("route_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("route_id")
    apart = settled(apart)
    if apart.isEmpty():
        return nearest
    more = candidates(graph, points.join(apart, "route_id", "left_semi"), replace(snap, candidates=16, distinct_by="component"))
    return nearest.join(apart, "route_id", "left_anti").unionByName(more)


def _planner(shared, o: RouteOptions, metric):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        net = shared.value
        index, known = net.chain_index(), {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append(plan(net, index, int(r.route_id), [_stop(s) for s in r.stops], o, metric, known))
                except Cut:
                    rows.append((int(r.route_id), *[None] * (len(_NAMES) - 1)))
            yield pd.DataFrame(rows, columns=_NAMES)

    return run


def _stop(s) -> dict:
    s = dict(s)
    places = s["places"] if s["places"] is not None else []
    return {"wp": int(s["wp_idx"]), "x": s["px"], "y": s["py"], "places": [dict(p) for p in places]}


@dataclass
class _Choice:
    wp: int
    place: dict
    nearest: float
    anchor: Anchor
    stop: tuple[float, float]


def plan(net: Net, index: dict[int, int], route_id: int, stops: list[dict], o: RouteOptions, metric, known: dict | None = None) -> tuple:
    """The row of a route; legs found before are taken from ``known``."""
    known = {} if known is None else known

    def failed(reason: str, leg: int | None = None, settled: int = 0, skipped=()) -> tuple:
        return (route_id, False, reason, leg, None, None, None, None, None, None, None, None, settled, [], [], [], [], [], [], list(skipped))

    if len(stops) < 2 or any(s["x"] is None or s["y"] is None or s["x"] != s["x"] or s["y"] != s["y"] for s in stops):
        return failed("INVALID_INPUT")

    def choice(s: dict, p: dict) -> _Choice:
        return _Choice(s["wp"], p, min(q["distance"] for q in s["places"]), Anchor(index[int(p["chain_id"])], _whole(float(p["pos"]))), (s["x"], s["y"]))

    skipped: list[dict] = []
    active = []
    for k, s in enumerate(stops):
        if s["places"]:
            active.append(s)
        elif o.on_failure == "skip" and (k or o.skip_leading):
            skipped.append({"wp_idx": s["wp"], "reason": "NO_CANDIDATE"})
        else:
            return failed("NO_CANDIDATE", max(0, k - 1))
    if len(active) < 2 or len(skipped) > o.skip_max:
        return failed("NO_CANDIDATE", 0, 0, skipped)
    if o.selection == "optimal":
        return _optimal(net, route_id, [[choice(s, p) for p in s["places"]] for s in active], o, skipped, failed, metric, known)
    orders = _assignments(active, o)
    if not orders:
        if o.on_failure == "fail":
            return failed("DISCONNECTED", 0)
        orders = [[s["places"][0] for s in active]]
    settled = 0
    for attempt, places in enumerate(orders):
        chosen = [choice(s, p) for s, p in zip(active, places, strict=True)]
        legs, used, gone, reason, leg_no = _walk(net, chosen, o, metric, known)
        settled += sum(leg.settled for leg, _ in legs)
        if reason is None or attempt == len(orders) - 1:
            break
    if reason is not None:
        return failed(reason, leg_no, settled, skipped + gone)
    if len(skipped) + len(gone) > o.skip_max or len(used) < 2:
        return failed("UNREACHABLE", 0, settled, skipped + gone)
    return _composed(net, route_id, used, legs, o, metric, sorted(skipped + gone, key=lambda x: x["wp_idx"]), settled)


def _whole(pos: float) -> float:
    near = round(pos)
    return float(near) if abs(pos - near) < 1e-12 * max(1.0, abs(pos)) else pos


def _assignments(active: list[dict], o: RouteOptions) -> list[list[dict]]:
    """Choices of a place for each waypoint, best first: the nearest ones, or those in a component that all share."""
    nearest = [s["places"][0] for s in active]
    if o.connectivity == "nearest" or o.snap.mode == "exact" or len({p["component"] for p in nearest}) == 1:
        return [nearest]
    by = [{} for _ in active]
    for k, s in enumerate(active):
        for p in s["places"]:
            by[k].setdefault(p["component"], p)
    shared = [c for c in by[0] if all(c in b for b in by)]
    shared.sort(key=lambda c: (sum(b[c]["distance"] for b in by), by[0][c]["rank"]))
    return [[b[c] for b in by] for c in (shared if o.connectivity == "reachable" else shared[:1])]


def _leg(net: Net, a: Anchor, b: Anchor, o: RouteOptions, known: dict) -> Leg:
    leg = known.get((a, b))
    if leg is None:
        leg = connect(net, a, b, o.algorithm, o.max_cost, o.max_settled)
        if len(known) >= KNOWN_LEGS:
            known.clear()
        known[a, b] = leg
    return leg


def _walk(net: Net, chosen: list[_Choice], o: RouteOptions, metric, known: dict) -> tuple[list[tuple[Leg, bool]], list[_Choice], list[dict], str | None, int | None]:
    """Legs between successive waypoints under the failure policy: (leg, whether straight), the waypoints used, those skipped."""
    legs, used, gone, k = [], [chosen[0]], [], 1
    while k < len(chosen):
        leg = _leg(net, used[-1].anchor, chosen[k].anchor, o, known)
        if leg.reason is None:
            legs.append((leg, False))
            used.append(chosen[k])
        elif o.on_failure == "straight":
            a, b = used[-1].place, chosen[k].place
            legs.append((Leg(metric.distance_py(a["x"], a["y"], b["x"], b["y"]), [], leg.settled), True))
            used.append(chosen[k])
        elif o.on_failure == "skip":
            if o.skip_leading and not legs and len(used) == 1 and k == 1 and len(chosen) > 2:
                gone.append({"wp_idx": used[0].wp, "reason": leg.reason})
                used = [chosen[k]]
            else:
                gone.append({"wp_idx": chosen[k].wp, "reason": leg.reason})
        else:
            return legs, used, gone, leg.reason, k - 1
        k += 1
    return legs, used, gone, None, None


def _optimal(net: Net, route_id: int, layers: list[list[_Choice]], o: RouteOptions, skipped: list[dict], failed, metric, known: dict) -> tuple:
    """The choice of places of least total cost, by dynamic programming over layers; ties take the nearer place.

    A place's snap cost counts at the route's ends, or where it is left and where it is reached ('arrive-depart').
    """
    def snap_cost(c: _Choice, k: int) -> float:
        return _snap_cost(o, c, k in (0, len(layers) - 1))

    costs = [snap_cost(c, 0) for c in layers[0]]
    back: list[list[tuple[int, Leg] | None]] = []
    settled = 0
    for k in range(1, len(layers)):
        here, links = [], []
        for c in layers[k]:
            best, pick = INF, None
            for j, before in enumerate(layers[k - 1]):
                if costs[j] < INF:
                    leg = _leg(net, before.anchor, c.anchor, o, known)
                    settled += leg.settled
                    if leg.reason is None and costs[j] + leg.cost < best:
                        best, pick = costs[j] + leg.cost, (j, leg)
            here.append(best + snap_cost(c, k))
            links.append(pick)
        if min(here) == INF:
            return failed("UNREACHABLE", k - 1, settled, skipped)
        costs = here
        back.append(links)
    at = min(range(len(costs)), key=lambda i: costs[i])
    used, legs = [layers[-1][at]], []
    for k in range(len(layers) - 1, 0, -1):
        at, leg = back[k - 1][at]
        legs.append((leg, False))
        used.append(layers[k - 1][at])
    used, legs = used[::-1], legs[::-1]
    return _composed(net, route_id, used, legs, o, metric, skipped, settled)


def _snap_cost(o: RouteOptions, c: _Choice, end: bool) -> float:
    factor = 0 if o.cost_mode == "none" else 1 if end else 2 if o.cost_mode == "arrive-depart" else 0
    return factor * o.snap_cost * c.place["distance"]


def _slots(net: Net, pieces: list[tuple[int, float, float]]) -> Iterator[tuple[int, float, float, bool]]:
    """(segment slot, from and to fraction in the chain's direction, whether against it) of each touched segment in travel order."""
    for chain, a, b in pieces:
        first, forward = int(net.chains["first"][chain]), a <= b
        low, high = min(a, b), max(a, b)
        inner = range(int(low), math.ceil(high))
        for k in inner if forward else reversed(inner):
            f, t = max(low - k, 0.0), min(high - k, 1.0)
            if t > f:
                yield first + k, f, t, not forward


def _at(c: dict, slot: int, f: float) -> tuple[float, float, float | None, str | None]:
    """The place at a fraction of a segment, and its group; inside a connector it has none."""
    if f == 0 or f == 1:
        k = "u" if f == 0 else "v"
        z = c[f"{k}z"][slot]
        return float(c[f"{k}x"][slot]), float(c[f"{k}y"][slot]), None if z != z else float(z), c[f"{k}_grp"][slot]
    x, y, z = (c[f"u{k}"][slot] + f * (c[f"v{k}"][slot] - c[f"u{k}"][slot]) for k in "xyz")
    return float(x), float(y), None if z != z else float(z), _group(c, slot)


def _group(c: dict, slot: int) -> str | None:
    return c["u_grp"][slot] if c["u_grp"][slot] == c["v_grp"][slot] else None


def _height(c: dict, slot: int, f: float) -> float:
    low, high = c["u_elevation"][slot], c["v_elevation"][slot]
    return float(low if f == 0 else high if f == 1 else low + f * (high - low))


def _passages(net: Net, sections: list[dict], levels: list[str | None]) -> list[dict]:
    """The rides of a route: successive sections without a group, of one leg, are one."""
    out: list[dict] = []
    for s in sections:
        if s["grp"] is not None:
            continue
        ride = out[-1] if out and out[-1]["leg"] == s["leg"] and out[-1]["_next"] == s["_k"] else None
        if ride is None:
            ride = {"leg": s["leg"], "from_level": levels[s["start"]], "start": s["start"], "feature_idx": [], "weight": 0.0, "distance": 0.0}
            out.append(ride)
        if s["feature_idx"] not in ride["feature_idx"]:
            ride["feature_idx"].append(s["feature_idx"])
        ride |= {"end": s["end"], "to_level": levels[s["end"]], "weight": ride["weight"] + s["weight"], "distance": ride["distance"] + s["distance"], "_next": s["_k"] + 1}
    for ride in out:
        change = net.levels.get(ride["to_level"], math.nan) - net.levels.get(ride["from_level"], math.nan)
        ride["level_change"] = change if change == change else 0.0
        del ride["_next"]
    return out


def _composed(net: Net, route_id: int, used: list[_Choice], legs: list[tuple[Leg, bool]], o: RouteOptions, metric, skipped: list[dict], settled: int) -> tuple:
    c, levelled = net.chains, net.levels is not None
    path: list[dict] = []
    levels: list[str | None] = []
    sections: list[dict] = []
    told: list[dict] = []
    weight = distance = network = straight_total = climbed = connector = 0.0
    def point(x: float, y: float, z: float | None, level: str | None = None) -> None:
        row = {"x": x, "y": y, "z": z}
        if not path or path[-1] != row or (levelled and levels[-1] != level):
            path.append(row)
            if levelled:
                levels.append(level)

    def reached(c: _Choice) -> float:
        """Goes to a waypoint itself."""
        x, y = c.stop
        gap = metric.distance_py(path[-1]["x"], path[-1]["y"], x, y)
        point(x, y, None, c.place["grp"])
        return gap

    if not o.details and not o.connectors and not levelled:
        return _totals(net, route_id, used, legs, o, metric, skipped, settled)
    if o.connectors:
        point(*used[0].stop, None, used[0].place["grp"])
    for k, (leg, straight) in enumerate(legs):
        a, b = used[k].place, used[k + 1].place
        begin = len(path)
        if straight:
            point(a["x"], a["y"], None, a["grp"])
            point(b["x"], b["y"], None, b["grp"])
            length = metric.distance_py(a["x"], a["y"], b["x"], b["y"])
            straight_total += length
        else:
            length = 0.0
            if not leg.pieces:
                point(a["x"], a["y"], None, a["grp"])
            last = None
            for slot, f, t, against in _slots(net, leg.pieces):
                start, end = (t, f) if against else (f, t)
                point(*_at(c, slot, start))
                point(*_at(c, slot, end))
                if levelled:
                    here, onward = _height(c, slot, start), _height(c, slot, end)
                    climbed += abs(onward - here) if onward == onward and here == here else 0.0
                part = t - f
                meters, cost = part * c["length"][slot], part * (c["against"] if against else c["along"])[slot]
                length += meters
                m0, m1 = (c["u_measure"][slot] + q * (c["v_measure"][slot] - c["u_measure"][slot]) for q in (start, end))
                grp = _group(c, slot)
                feature = int(c["feature"][slot])
                joined = last is not None and last["feature_idx"] == feature and last["grp"] == grp and o.sections_detail != "segment"
                if joined and o.sections_detail == "measure":
                    joined = last["_part"] == int(c["part"][slot]) and abs(last["measure_end"] - m0) <= 1e-9 * max(1.0, abs(m0))
                if joined:
                    last["end"], last["measure_end"] = len(path) - 1, float(m1)
                    last["distance"] += float(meters)
                    last["weight"] += float(cost)
                else:
                    last = {"leg": k, "feature_idx": feature, "start": max(len(path) - 2, 0), "end": len(path) - 1, "distance": float(meters), "weight": float(cost), "measure_start": float(m0), "measure_end": float(m1), "grp": grp, "_part": int(c["part"][slot]), "_k": len(sections)}
                    sections.append(last)
            network += length
        if o.connectors and k == 0 and begin < len(path):
            connector += metric.distance_py(*used[0].stop, a["x"], a["y"])
        if o.connectors == "legs" or (o.connectors and k == len(legs) - 1):
            gap = reached(used[k + 1])
            connector += gap * (1 if k == len(legs) - 1 else 2)
        weight += leg.cost
        distance += length
        told.append({"from_wp": used[k].wp, "to_wp": used[k + 1].wp, "weight": float(leg.cost), "distance": float(length), "straight": straight})
    rides = _passages(net, sections, levels) if levelled else []
    for s in sections:
        del s["_part"], s["_k"]
    snaps = sum(_snap_cost(o, u, k in (0, len(used) - 1)) for k, u in enumerate(used))
    total = weight + snaps * o.include_snap_weight
    changes = float(sum(abs(r["level_change"]) for r in rides)) if levelled else None
    stops = [{"wp_idx": u.wp, "x": u.place["x"], "y": u.place["y"], "distance": u.place["distance"], "relocation": u.place["distance"] - u.nearest, "rank": int(u.place["rank"]), "relocated": int(u.place["rank"]) > 0, "feature_idx": int(u.place["feature_idx"])} for u in used]
    return (route_id, True, None, None, float(total), float(distance + connector * o.include_connector_distance), float(snaps), float(weight), float(network), float(straight_total), changes, climbed if levelled else None, settled, path, levels, told, sections, rides, stops, skipped)


def _totals(net: Net, route_id: int, used: list[_Choice], legs: list[tuple[Leg, bool]], o: RouteOptions, metric, skipped: list[dict], settled: int) -> tuple:
    """A route's row without what lies along it; sums are taken in the order of ``_composed``."""
    c = net.chains
    weight = distance = network = straight_total = 0.0
    for k, (leg, straight) in enumerate(legs):
        a, b = used[k].place, used[k + 1].place
        if straight:
            length = metric.distance_py(a["x"], a["y"], b["x"], b["y"])
            straight_total += length
        else:
            if leg.length is None:
                leg.length = 0.0
                for slot, f, t, _ in _slots(net, leg.pieces):
                    leg.length += (t - f) * c["length"][slot]
            length = leg.length
            network += length
        weight += leg.cost
        distance += length
    snaps = sum(_snap_cost(o, u, k in (0, len(used) - 1)) for k, u in enumerate(used))
    return (route_id, True, None, None, float(weight + snaps * o.include_snap_weight), float(distance), float(snaps), float(weight), float(network), float(straight_total), None, None, settled, [], [], [], [], [], [], skipped)


def one_to_many(graph: Graph, sources: DataFrame, targets: DataFrame, snap: Snap | None = None, max_cost: float = INF) -> DataFrame:
    """origin_id, dest_id, weight for each row of sources(point_id, x, y) and each of targets(point_id, x, y); unreachable is infinite.

    One search from an origin settles all its targets, and targets are sent with the network, so their number is
    bounded like the network's; origins spread over tasks.
    """
    at = candidates(graph, targets, snap or Snap()).filter("rank = 0").select(F.col("point_id").cast("long").alias("dest_id"), "x", "y", "chain_id", "pos")
    ids = targets.select(F.col("point_id").cast("long").alias("dest_id"))
    at = settled(at)
    listed = ids.join(at, "dest_id", "left").orderBy("dest_id").limit(MOST_TARGETS + 1).collect()
    if len(listed) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets; call in blocks of targets")
    ends = [(r["dest_id"], r["chain_id"], r["pos"]) for r in listed]
    origins = candidates(graph, sources, snap or Snap()).filter("rank = 0").select(F.col("point_id").cast("long").alias("origin_id"), "x", "y", "chain_id", "pos")
    origins = sources.select(F.col("point_id").cast("long").alias("origin_id")).join(origins, "origin_id", "left")
    parts = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    origins = origins.repartition(parts, "origin_id")
    kind = "origin_id long, dest_id long, weight double"
    if not in_parts(graph, dijkstra):
        return origins.mapInPandas(_fan(graph.shared_net(), ends, max_cost), kind)
    origins = settled(origins)
    places = origins.filter("chain_id is not null").select("origin_id", "x", "y", "chain_id")
    return over_parts(graph, origins, places, "origin_id", lambda part: lambda left: left.mapInPandas(_fan(part, ends, max_cost), kind), "weight is null", at.select("x", "y", "chain_id"))


#: Targets of one call of one_to_many; a larger table is worked off in blocks.
MOST_TARGETS = 100_000


def _fan(shared, ends: list[tuple], max_cost: float):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from spanwright.operators.engine import exits, seeds

        net = shared.value
        index = net.chain_index()
        goals = [(d, None if c is None else Anchor(index[int(c)], _whole(float(p)))) for d, c, p in ends]
        outs = [(d, a, exits(net, a) if a else {}) for d, a in goals]
        wanted = {n for _, _, out in outs for n in out}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                here = None if r.chain_id != r.chain_id or r.chain_id is None else Anchor(index[int(r.chain_id)], _whole(float(r.pos)))
                start = seeds(net, here) if here else {}
                parts = {int(net.component[n]) for n in start}
                targets = {n for n in wanted if int(net.component[n]) in parts}
                try:
                    found = _reached(net, start, targets, max_cost)
                except Cut:
                    rows.extend((int(r.origin_id), int(dest), None) for dest, _, _ in outs)
                    continue
                for dest, a, out in outs:
                    cost = INF
                    if here is not None and a is not None:
                        if a == here:
                            cost = 0.0
                        elif a.chain == here.chain:
                            cost = partial_cost(net, a.chain, here.pos, a.pos)
                        if found is not None:
                            cost = min([cost, *(found.cost[n] + c for n, c in out.items() if n in found.cost)])
                    rows.append((int(r.origin_id), int(dest), float(cost) if cost <= max_cost else INF))
            yield pd.DataFrame(rows, columns=["origin_id", "dest_id", "weight"])

    return run


def _reached(net: Net, start: dict[int, float], targets: set[int], max_cost: float):
    """The search from one origin; where it would leave its part of the network, once more without targets that are not reached."""
    try:
        return dijkstra(net, start, targets, max_cost) if targets else None
    except Cut:
        near = {n for n in targets if not apart(net, set(start), {n})}
        if near == targets:
            raise
        return dijkstra(net, start, near, max_cost) if near else None


def matrix(costs: DataFrame) -> DataFrame:
    """origin_id and the array of weights in the order of dest_id, from a long table of costs."""
    return costs.groupBy("origin_id").agg(F.array_sort(F.collect_list(F.struct("dest_id", "weight"))).alias("m")).select("origin_id", F.col("m.weight").alias("weights"))
