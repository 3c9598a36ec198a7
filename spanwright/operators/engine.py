"""Shortest paths inside a task: a compact network, search strategies and their registry.

The arrays of a network are sent to executors once, after a check of their size; a batch of queries then runs in
parallel, one search each. Networks beyond the bound use the DataFrame relaxation in ``search``.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

INF = math.inf
#: A bound on estimates is scaled down by this much against rounding.
SLACK = 1 - 1e-6
ALT_SLACK = 1 - 1e-9


@dataclass
class Net:
    """Nodes 0..n-1 in CSR form. Edge e goes to target[e] at cost[e] over chain ref[e] // 2, against it if ref[e] is odd."""

    node_ids: np.ndarray
    offset: np.ndarray
    target: np.ndarray
    cost: np.ndarray
    ref: np.ndarray
    component: np.ndarray
    points: np.ndarray  # node positions in the metric's embedding
    scale: float = 0.0  # least cost per embedded distance; 0 switches the bound off
    per_level: float = 0.0
    ordinals: np.ndarray | None = None
    chains: dict = field(default_factory=dict)  # arrays over chains and their segments, see plans.graph
    landmarks: tuple[list[list[float]], list[list[float]]] | None = None  # costs landmark -> node and node -> landmark
    levels: dict[str, float] | None = None  # ordinals by group, for networks with levels
    cut: frozenset[int] = frozenset()  # nodes of a part of a network that have edges outside of it
    _back: Net | None = None
    _lists: tuple | None = None
    _index: dict | None = None
    _positions: list | None = None

    def lists(self) -> tuple:
        """Adjacency as Python lists, which the interpreter walks faster than arrays."""
        if self._lists is None:
            o = self.offset.tolist()
            t, c, r = self.target.tolist(), self.cost.tolist(), self.ref.tolist()
            self._lists = [list(zip(t[a:b], c[a:b], r[a:b], strict=True)) for a, b in zip(o[:-1], o[1:], strict=True)]
        return self._lists

    def chain_index(self) -> dict[int, int]:
        if self._index is None:
            self._index = {int(c): i for i, c in enumerate(self.chains["ids"])}
        return self._index

    def positions(self) -> list[tuple[float, ...]]:
        if self._positions is None:
            self._positions = list(map(tuple, self.points.tolist()))
        return self._positions

    def reverse(self) -> Net:
        src = np.repeat(np.arange(len(self.node_ids)), np.diff(self.offset))
        order = np.argsort(self.target, kind="stable")
        offset = np.searchsorted(self.target[order], np.arange(len(self.node_ids) + 1))
        return Net(self.node_ids, offset, src[order], self.cost[order], self.ref[order], self.component, self.points)

    def backward(self) -> Net:
        """The reverse, made once."""
        if self._back is None:
            self._back = self.reverse()
        return self._back

    @property
    def nbytes(self) -> int:
        arrays = [self.node_ids, self.offset, self.target, self.cost, self.ref, self.component, self.points, *(a for a in self.chains.values() if isinstance(a, np.ndarray))]
        return sum(a.nbytes for a in arrays) + sum(8 * len(d) for side in self.landmarks or () for d in side)


class Cut(Exception):
    """A search has to go on beyond its part of the network, so that its result is not known here."""


@dataclass
class Found:
    """cost to each settled target; previous (node, edge ref) of reached nodes; settled count; whether the budget ran out."""

    cost: dict[int, float]
    previous: dict[int, tuple[int, int]]
    settled: int
    exhausted: bool = False


Engine = Callable[..., Found]
_engines: dict[str, Engine] = {}


def register(name: str, engine: Engine, replace: bool = False) -> None:
    if name in _engines and not replace:
        raise ValueError(f"an algorithm named {name!r} is registered already")
    _engines[name] = engine


def engine(name: str | Engine) -> Engine:
    """The search of that name; a search itself is taken as it is, which is how one reaches the workers."""
    if callable(name):
        return name
    if name not in _engines:
        raise ValueError(f"unknown algorithm {name!r}; registered: {', '.join(sorted(_engines))}")
    return _engines[name]


def best_first(net: Net, sources: dict[int, float], targets: set[int], bound: Callable[[int], float] | None = None, max_cost: float = INF, max_settled: float = INF) -> Found:
    """Search from weighted sources until all targets are settled; a bound (never above the true rest) directs it.

    Without targets the whole reachable part is settled. Nodes of equal keys are taken in the order they were found.
    """
    near = net.lists()
    best = dict(sources)
    previous: dict[int, tuple[int, int]] = {}
    heap = []
    order = 0
    for node, cost in sources.items():
        rest = bound(node) if bound else 0.0
        if cost + rest <= max_cost and rest < INF:
            heapq.heappush(heap, (cost + rest, order, node, cost))
            order += 1
    left, done, settled = set(targets), {}, 0
    while heap:
        _, _, node, cost = heapq.heappop(heap)
        if cost > best[node]:
            continue
        if settled >= max_settled:
            return Found(done, previous, settled, True)
        settled += 1
        if not targets or node in left:
            done[node] = cost
            left.discard(node)
            if targets and not left:
                break
        if node in net.cut:
            raise Cut
        for to, step, ref in near[node]:
            reached = cost + step
            if reached < best.get(to, INF):
                rest = bound(to) if bound else 0.0
                if rest < INF and reached + rest <= max_cost:
                    best[to] = reached
                    previous[to] = (node, ref)
                    heapq.heappush(heap, (reached + rest, order, to, reached))
                    order += 1
                    if to in done:  # an inconsistent bound may reopen a settled target
                        left.add(to)
    return Found(done, previous, settled)


def dijkstra(net: Net, sources: dict[int, float], targets: set[int], max_cost: float = INF, max_settled: float = INF, **_) -> Found:
    return best_first(net, sources, targets, None, max_cost, max_settled)


def astar(net: Net, sources: dict[int, float], targets: set[int], max_cost: float = INF, max_settled: float = INF, active: int = 4, **_) -> Found:
    """Best-first with the largest of the geometric, level and landmark bounds; none of them with more than 16 targets."""
    if not 0 < len(targets) <= 16:
        return dijkstra(net, sources, targets, max_cost, max_settled)
    return best_first(net, sources, targets, rest_bound(net, list(targets), list(sources), active), max_cost, max_settled)


def rest_bound(net: Net, targets: list[int], sources: list[int], active: int = 4) -> Callable[[int], float]:
    points, known = net.positions(), {}
    scale = net.scale * SLACK
    goals = [points[t] for t in targets]
    ordinals = net.ordinals.tolist() if net.ordinals is not None and net.per_level > 0 else None
    levels = [ordinals[t] for t in targets] if ordinals is not None else None
    rise = net.per_level * SLACK
    chosen = []
    if net.landmarks is not None:
        out, back = net.landmarks
        gain = [max(_alt(out[k], back[k], s, targets) for s in sources) for k in range(len(out))]
        chosen = sorted(range(len(out)), key=lambda k: (-gain[k] if not math.isnan(gain[k]) else 0, k))[:active]
        chosen = [(out[k], back[k]) for k in chosen]

    def bound(node: int) -> float:
        value = known.get(node)
        if value is None:
            at = points[node]
            if levels is None:
                value = min([math.dist(at, g) for g in goals]) * scale
            else:
                own = ordinals[node]
                value = min(math.dist(at, g) * scale + (abs(o - own) * rise if o == o and own == own else 0.0) for g, o in zip(goals, levels, strict=True))
            for out, back in chosen:
                value = max(value, _alt(out, back, node, targets) * ALT_SLACK)
            known[node] = value
        return value

    return bound


def _alt(out: list[float], back: list[float], node: int, targets: list[int]) -> float:
    """The least over targets of what one landmark's triangle inequalities say of the cost from node."""
    least, from_mark, to_mark = INF, out[node], back[node]
    for t in targets:
        value = 0.0
        if from_mark < INF:
            # a landmark that reaches node but not the target tells that node cannot either
            value = max(value, out[t] - from_mark) if out[t] < INF else INF
        if back[t] < INF:
            value = max(value, to_mark - back[t]) if to_mark < INF else INF
        least = min(least, value)
    return least


def bidirectional(net: Net, sources: dict[int, float], targets: set[int], max_cost: float = INF, max_settled: float = INF, target_costs: dict[int, float] | None = None, **_) -> Found:
    """Searches from both ends until the two frontiers' keys add up to the best meeting; one target or a super-target of several with costs."""
    if max_cost < INF or (len(targets) != 1 and target_costs is None) or not targets:
        return dijkstra(net, sources, targets, max_cost, max_settled)
    sides = [(net.lists(), dict(sources)), (net.backward().lists(), dict(target_costs or dict.fromkeys(targets, 0.0)))]
    prev: list[dict[int, tuple[int, int]]] = [{}, {}]
    heaps = [[(c, i, n) for i, (n, c) in enumerate(side[1].items())] for side in sides]
    for h in heaps:
        heapq.heapify(h)
    closed: list[set[int]] = [set(), set()]
    best, meet, settled, order = INF, -1, 0, len(heaps[0]) + len(heaps[1])
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] < best:
        if settled >= max_settled:
            return Found({}, prev[0], settled, True)
        k = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, node = heapq.heappop(heaps[k])
        near, reached = sides[k]
        if node in closed[k]:
            continue
        closed[k].add(node)
        settled += 1
        if node in net.cut:
            raise Cut
        other = sides[1 - k][1].get(node, INF)
        if cost + other < best:
            best, meet = cost + other, node
        for to, step, ref in near[node]:
            if cost + step < reached.get(to, INF):
                reached[to] = cost + step
                prev[k][to] = (node, ref)
                heapq.heappush(heaps[k], (cost + step, order, to))
                order += 1
                if reached[to] + sides[1 - k][1].get(to, INF) < best:
                    best, meet = reached[to] + sides[1 - k][1][to], to
    if meet < 0:
        return Found({}, prev[0], settled)
    node = meet
    while node in prev[1]:  # the backward half, turned round
        onward, ref = prev[1][node]
        prev[0][onward] = (node, ref)
        node = onward
    return Found({node: best - (target_costs or {}).get(node, 0.0)}, prev[0], settled)


register("dijkstra", dijkstra)
register("astar", astar)
register("bidijkstra", bidirectional)


#: Searches that stop at the edge of a part of a network; others get the whole one.
KNOW_CUTS = (dijkstra, astar, bidirectional)


def apart(net: Net, sources: set[int], targets: set[int]) -> int:
    """If no source reaches a target, the number of nodes that tell so, else 0.

    Both sides spread by turns, breadth first, and the one with fewer nodes decides. A side that would leave its part of the network tells nothing.
    """
    near = (net.lists(), net.backward().lists())
    seen, rest, told = (set(sources), set(targets)), (deque(sources), deque(targets)), [True, True]
    if seen[0] & seen[1]:
        return 0
    while any(told):
        for k in (0, 1):
            if not told[k]:
                continue
            if not rest[k]:
                return len(seen[k])
            node = rest[k].popleft()
            if node in net.cut:
                told[k] = False
                continue
            for to, _, _ in near[k][node]:
                if to not in seen[k]:
                    if to in seen[1 - k]:
                        return 0
                    seen[k].add(to)
                    rest[k].append(to)
    return 0


def path_edges(found: Found, sources: dict[int, float], target: int) -> list[tuple[int, int]]:
    """(node, edge ref) steps from a source to the target."""
    steps, node, seen = [], target, set()
    while node in found.previous:
        before, ref = found.previous[node]
        if node in seen:
            raise RuntimeError("the search tree has a cycle")
        seen.add(node)
        steps.append((node, ref))
        node = before
        if node in sources and node not in found.previous:
            break
    return steps[::-1]


# --- positions inside chains -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Anchor:
    """A place on a chain: pos is the number of segments before it, whole ones and a fraction."""

    chain: int
    pos: float


def partial_cost(net: Net, chain: int, a: float, b: float) -> float:
    """The cost from pos a to pos b of a chain; infinite if a touched segment is impassable that way."""
    first = int(net.chains["first"][chain])
    costs = net.chains["along"] if a <= b else net.chains["against"]
    low, high = min(a, b), max(a, b)
    total, k = 0.0, int(low)
    while k < high:
        part = min(high, k + 1) - max(low, k)
        if part > 0:
            step = costs[first + k]
            if not step < INF:
                return INF
            total += part * step
        k += 1
    return float(total)


def seeds(net: Net, at: Anchor) -> dict[int, float]:
    """The nodes at which a route from the anchor can enter the network, and the cost until there."""
    n = int(net.chains["count"][at.chain])
    out: dict[int, float] = {}
    for node, pos in ((int(net.chains["from"][at.chain]), 0.0), (int(net.chains["to"][at.chain]), float(n))):
        if (cost := partial_cost(net, at.chain, at.pos, pos)) < out.get(node, INF):
            out[node] = cost
    return out


def exits(net: Net, at: Anchor) -> dict[int, float]:
    """The nodes from which the anchor is reached, and the cost from there."""
    n = int(net.chains["count"][at.chain])
    out: dict[int, float] = {}
    for node, pos in ((int(net.chains["from"][at.chain]), 0.0), (int(net.chains["to"][at.chain]), float(n))):
        if (cost := partial_cost(net, at.chain, pos, at.pos)) < out.get(node, INF):
            out[node] = cost
    return out


@dataclass
class Leg:
    """cost and the pieces (chain, start pos, end pos) of a route between two anchors; reason says why there is none."""

    cost: float
    pieces: list[tuple[int, float, float]]
    settled: int = 0
    reason: str | None = None
    length: float | None = None  # once someone asked for it


def connect(net: Net, a: Anchor, b: Anchor, algorithm: str | Engine = "astar", max_cost: float = INF, max_settled: float = INF, active: int = 4) -> Leg:
    """The cheapest leg from a to b: directly along a shared chain, or over nodes."""
    if a == b or _same_node(net, a, b):
        return Leg(0.0, [])
    direct = partial_cost(net, a.chain, a.pos, b.pos) if a.chain == b.chain else INF
    start, end = seeds(net, a), exits(net, b)
    cost, pieces, settled = direct, [(a.chain, a.pos, b.pos)] if direct < INF else [], 0
    reachable = {int(net.component[n]) for n in start} & {int(net.component[n]) for n in end}
    if start and end and reachable:
        if max_cost == INF and max_settled == INF and not direct < INF and (tried := apart(net, set(start), set(end))):
            return Leg(INF, [], tried, "UNREACHABLE")
        found = engine(algorithm)(net, start, set(end), max_cost=min(max_cost, direct), max_settled=max_settled, active=active, target_costs=end)
        if found.exhausted and not direct < INF:
            return Leg(INF, [], found.settled, "BUDGET_EXCEEDED")
        settled = found.settled
        for node, until in found.cost.items():
            if until + end[node] < cost:
                cost = until + end[node]
                pieces = _pieces(net, a, b, start, found, node)
    if cost > max_cost:
        return Leg(INF, [], settled, "BUDGET_EXCEEDED")
    return Leg(cost, pieces, settled, None if cost < INF else "UNREACHABLE")


def node_of(net: Net, at: Anchor) -> int | None:
    if at.pos == 0:
        return int(net.chains["from"][at.chain])
    return int(net.chains["to"][at.chain]) if at.pos == net.chains["count"][at.chain] else None


def _same_node(net: Net, a: Anchor, b: Anchor) -> bool:
    n = node_of(net, a)
    return n is not None and n == node_of(net, b)


def _pieces(net: Net, a: Anchor, b: Anchor, start: dict[int, float], found: Found, target: int) -> list[tuple[int, float, float]]:
    steps = path_edges(found, start, target)
    entry = target if not steps else found.previous[steps[0][0]][0]
    count = net.chains["count"]

    def end_pos(at: Anchor, node: int, leaving: bool) -> float:
        options = [p for n, p in ((int(net.chains["from"][at.chain]), 0.0), (int(net.chains["to"][at.chain]), float(count[at.chain]))) if n == node]
        return min(options, key=lambda p: partial_cost(net, at.chain, at.pos, p) if leaving else partial_cost(net, at.chain, p, at.pos))

    pieces = [(a.chain, a.pos, end_pos(a, entry, True))]
    for _, ref in steps:
        chain, against = ref // 2, ref % 2
        n = float(count[chain])
        pieces.append((chain, n, 0.0) if against else (chain, 0.0, n))
    pieces.append((b.chain, end_pos(b, target, False), b.pos))
    return [p for p in pieces if p[1] != p[2]]
