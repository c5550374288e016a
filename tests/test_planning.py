import heapq
import math
import random

import pytest

from roadweave.config import PlannerConfig
from roadweave.operators.graph import Csr, shortest_paths
from roadweave.plans import days as dy
from roadweave.plans.walk import Chain, Network, solve_day, trimmed, walk


def random_graph(seed, n=12, m=30):
    rng = random.Random(seed)
    best = {}
    for _ in range(m):
        a, b, w = rng.randrange(n), rng.randrange(n), float(rng.randint(1, 4))
        if a != b and w < best.get((a, b), math.inf):
            best[a, b] = w
    return best


def csr(best, n=12):
    e = sorted(best)
    return Csr(n, [a for a, _ in e], [b for _, b in e], [best[x] for x in e], [best[x] * 7 for x in e])


def distances(best, source):
    done, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = d
        for (a, b), w in best.items():
            if a == u and b not in done:
                heapq.heappush(heap, (d + w, b))
    return done


def reference_walk(best, chains, order):
    """Nearest remaining entry by (seconds, node), legally, then both ways, then straight."""
    both = dict(best)
    for (a, b), w in best.items():
        both[b, a] = min(w, both.get((b, a), math.inf))
    here, left, out = chains[order[0]].first, list(order), []
    while left:
        entry = {}
        for ci in left:
            entry.setdefault(chains[ci].first, []).append((order.index(ci), ci, False))
            if not chains[ci].oneway and chains[ci].first != chains[ci].last:
                entry.setdefault(chains[ci].last, []).append((order.index(ci), ci, True))
        for graph in (best, both):
            reached = [(d, u) for u, d in distances(graph, here).items() if u in entry]
            if reached:
                break
        if not reached:
            return out
        d, u = min(reached)
        _, ci, flipped = min(entry[u])
        out.append((ci, flipped, d))
        left.remove(ci)
        here = chains[ci].first if flipped else chains[ci].last
    return out


def chains_of(seed, n=12):
    rng = random.Random(seed + 1000)
    return {i: Chain(i, rng.randrange(n), rng.randrange(n), 100.0 + i, 10.0 + i, rng.random() < 0.4) for i in range(6)}


@pytest.mark.parametrize("seed", range(60))
def test_walk(seed):
    best, chains = random_graph(seed), chains_of(seed)
    net = Network(csr(best), [(40 + i * 0.01, -74.0) for i in range(12)], chains)
    legs = walk(net, list(range(6)))
    assert sorted(leg["chain_id"] for leg in legs) == list(range(6))
    expected = reference_walk(best, chains, list(range(6)))
    assert [(leg["chain_id"], leg["flipped"], leg["dh_s"]) for leg in legs][: len(expected)] == expected
    assert not any(leg["flipped"] and chains[leg["chain_id"]].oneway for leg in legs)
    for leg in legs:
        assert leg["path"][-1] == (chains[leg["chain_id"]].last if leg["flipped"] else chains[leg["chain_id"]].first)


def test_wrong_way_and_jump():
    net = Network(csr({(0, 1): 2.0}, 4), [(40.0, -74.0), (40.01, -74.0), (41.0, -74.0), (41.01, -74.0)], {0: Chain(0, 1, 1, 1.0, 1.0, True), 1: Chain(1, 0, 0, 1.0, 1.0, True), 2: Chain(2, 2, 3, 1.0, 1.0, True)})
    legs = walk(net, [0, 1, 2])
    assert [(leg["chain_id"], leg["is_wrong_way"], leg["is_jump"]) for leg in legs] == [(0, False, False), (1, True, False), (2, False, True)]


def test_shortest_paths_operator(spark):
    best = random_graph(3)
    rows = shortest_paths(spark.range(12).withColumnRenamed("id", "node_id"), set(range(12)), csr(best)).collect()
    assert {(r["source"], r["target"]): r["seconds"] for r in rows} == {(s, t): d for s in range(12) for t, d in distances(best, s).items()}


def star(k=8, config=None):
    """Chains around a depot at node 0, each at the end of a two-way spoke."""
    at = [(40.0, -74.0)] + [(40 + 0.1 * math.cos(2 * math.pi * i / k), -74 + 0.1 * math.sin(2 * math.pi * i / k)) for i in range(k)]
    e = [(0, i + 1) for i in range(k)] + [(i + 1, 0) for i in range(k)]
    graph = Csr(k + 1, [a for a, _ in e], [b for _, b in e], [600.0] * len(e), [10_000.0] * len(e))
    chains = {i: Chain(i, i + 1, i + 1, 20_000.0 + 1000 * i, 1000.0 + i, False, at[i + 1]) for i in range(k)}
    return Network(graph, at, chains, 0, config or PlannerConfig())


def chain_table(spark, net):
    return spark.createDataFrame([(c.chain_id, [c.centroid], c.time_s) for c in net.chains.values()], "chain_id long, coords array<struct<lat: double, lon: double>>, time_s double")


def test_day_hours():
    day = solve_day(star(), [0, 1])
    miles = (20_000 + 21_000) / 1609.344, 40_000 / 1609.344
    assert day["hours"] == pytest.approx(miles[0] / 35 + miles[1] / 45)
    assert (day["jumps"], day["wrong_way_return"]) == (0, False)


def test_sweep_is_a_partition(spark):
    net = star()
    for days in (1, 2, 3, 5):
        groups = dy.sweep_partition(chain_table(spark, net), (40.0, -74.0), days)
        assert sorted(c for g in groups for c in g) == list(range(8))
        assert len(groups) <= days


def test_empty_wedges():
    assert dy.fill_empty([[1, 2, 3], [], [4]]) == [[1, 2], [3], [4]]
    assert dy.fill_empty([[], [1, 2]]) == [[1], [2]]
    assert dy.fill_empty([[1], [], [2]]) == [[1], [2]]


def test_moves():
    assert dy.moves([5.0, 1.0, 3.0]) == [(0, 1, -1), (0, 1, -1), (2, 1, 0)]
    assert dy.moves([1.0, 5.0]) == [(1, 0, 0), (1, 0, 0)]


def test_plan_balances_and_trims(spark):
    net = star(config=PlannerConfig(shift_hours=1.0, max_days=3))
    solved, filler = dy.plan_groups(spark, chain_table(spark, net), (40.0, -74.0), 200_000.0, spark.sparkContext.broadcast(net))
    planned = sorted(c for d in solved for c in d["members"])
    assert sorted(planned + filler) == list(range(8))
    assert all(d["hours"] <= 1.0 or len(d["members"]) == 1 for d in solved)
    assert filler


def test_trim_takes_the_nearest_first():
    net = star()
    net.chains[3].centroid = (40.001, -74.0)
    day, left = trimmed(net, solve_day(net, [1, 3, 5]), 1.5)
    assert left[0] == 3 and day["members"] == [c for c in (1, 3, 5) if c not in left]


def test_day_estimate():
    config = PlannerConfig()
    assert dy.estimated_days(0.0, None, config) == (1, 5)
    assert dy.estimated_days(1e9, None, config) == (5, 5)
    assert dy.estimated_days(1e9, 2, config) == (2, 2)
