"""Ordering of chains: a greedy walk that always drives to the nearest remaining chain."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..config import EARTH_RADIUS_M, MILES_PER_M, PlannerConfig
from ..operators.graph import Csr


def metres(a, b) -> float:
    la, lb = math.radians(a[0]), math.radians(b[0])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(s))


@dataclass
class Chain:
    """What the walk needs of a chain: ids of its end nodes, its ends, sizes and middle."""

    chain_id: int
    first: int
    last: int
    length_m: float
    time_s: float
    oneway: bool
    centroid: tuple[float, float] = (0.0, 0.0)


@dataclass
class Network:
    """Graph, node positions and chains of a plan; broadcast as one value."""

    graph: Csr
    at: list[tuple[float, float]]
    chains: dict[int, Chain]
    depot: int | None = None
    config: PlannerConfig = field(default_factory=PlannerConfig)

    def __post_init__(self):
        self._both = None

    def reach(self, source: int, targets: set[int]):
        """(target, seconds, meters, path, against one-way): legally, else against one-way rules, else None."""
        for graph, wrong in ((lambda: self.graph, False), (self.both, True)):
            found = next(graph().search(source, targets), None)
            if found:
                return *found, wrong
        return None

    def both(self) -> Csr:
        if self._both is None:
            self._both = self.graph.both_ways()
        return self._both

    def jump(self, source: int, target: int):
        d = metres(self.at[source], self.at[target])
        return target, d / (self.config.default_speed_kmh * 1000 / 3600), d, [source, target]


def walk(net: Network, order: list[int], start: int | None = None) -> list[dict]:
    """Legs in drive order. ``order`` decides between chains that share an entry; without ``start`` the first one's begin is it."""
    entries: dict[int, list[tuple[int, bool]]] = {}
    for ci in order:
        chain = net.chains[ci]
        entries.setdefault(chain.first, []).append((ci, False))
        if not chain.oneway and chain.last != chain.first:
            entries.setdefault(chain.last, []).append((ci, True))
    left, waiting = set(order), {n: len(options) for n, options in entries.items()}
    targets = set(waiting)
    here = net.chains[order[0]].first if start is None and order else start
    rank = {ci: i for i, ci in enumerate(order)}
    legs = []
    while left:
        found = net.reach(here, targets)
        if found:
            target, seconds, meters, path, wrong = found
        else:
            target = min(targets, key=lambda n: (metres(net.at[here], net.at[n]), min(rank[ci] for ci, _ in entries[n] if ci in left)))
            (target, seconds, meters, path), wrong = net.jump(here, target), False
        ci, flipped = next(x for x in entries[target] if x[0] in left)
        chain = net.chains[ci]
        legs.append({"chain_id": ci, "flipped": flipped, "dh_s": seconds, "dh_m": meters, "path": path, "is_jump": not found, "is_wrong_way": wrong})
        left.discard(ci)
        for n in {chain.first, chain.last} & waiting.keys() if not chain.oneway else {chain.first}:
            waiting[n] -= 1
            if not waiting[n]:
                targets.discard(n)
        here = chain.first if flipped else chain.last
    return legs


def solve_day(net: Network, members: list[int]) -> dict:
    """One shift: from the depot over all members and back. hours come from the paces, not from map speeds."""
    legs = walk(net, members, net.depot)
    last = net.chains[legs[-1]["chain_id"]]
    end = last.first if legs[-1]["flipped"] else last.last
    back = net.reach(end, {net.depot})
    jumps = sum(leg["is_jump"] for leg in legs) + (back is None)
    _, return_s, return_m, path = (back or net.jump(end, net.depot))[:4]
    survey_m = sum(net.chains[ci].length_m for ci in members)
    deadhead_m = sum(leg["dh_m"] for leg in legs)
    c = net.config
    return {
        "members": list(members), "legs": legs, "survey_m": survey_m, "deadhead_m": deadhead_m, "return_m": return_m, "return_s": return_s, "return_path": path, "jumps": int(jumps),
        "wrong_way": sum(leg["is_wrong_way"] for leg in legs), "wrong_way_return": bool(back and back[4]), "hours": survey_m * MILES_PER_M / c.collect_mph + (deadhead_m + return_m) * MILES_PER_M / c.transfer_mph,
    }


def trimmed(net: Network, day: dict, max_hours: float) -> tuple[dict, list[int]]:
    """Leave out the chains nearest to the depot one by one until the day fits, or one is left; (day, left out)."""
    out = []
    while day["hours"] > max_hours and len(day["members"]) > 1:
        near = min(day["members"], key=lambda ci: metres(net.at[net.depot], net.chains[ci].centroid))
        out.append(near)
        day = solve_day(net, [ci for ci in day["members"] if ci != near])
    return day, out
