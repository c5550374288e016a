import pytest
from pyspark.sql import functions as F

from roadweave.functions.geo import LINE
from roadweave.operators import chains as ch
from roadweave.operators.sections import build_sections
from roadweave.operators.spatial import merge_endpoints
from roadweave.plans.walk import metres


def made(spark, rows):
    """Sections of (id, points, fields)."""
    df = spark.createDataFrame([(i, line, fields or {}, f"s{i}") for i, line, fields in rows], f"section_id long, coords {LINE}, fields map<string, string>, name string")
    return build_sections(df)


A, B, C, D, E = (40.0, -74.0), (40.01, -74.0), (40.02, -74.0), (40.03, -74.0), (40.01, -73.99)


@pytest.mark.parametrize(
    "fields, oneway, against",
    [({"dir": "I"}, True, False), ({"dir": "d"}, True, True), ({"dir": "B"}, False, False), ({"dir": "T"}, False, False), ({"dir": "both"}, False, False), ({"dir": "NB"}, True, False), ({}, None, False), ({"oneway": "yes", "is_one_way": "no"}, False, False), ({"one-way": "1"}, True, False), ({"oneway": "maybe"}, None, False)],
)
def test_direction(spark, fields, oneway, against):
    r = made(spark, [(1, [A, B], fields)]).first()
    assert (r["oneway"], r["digitized_reversed"]) == (oneway, against)
    assert (r["start"]["lat"], r["digitized_coords"][0]["lat"]) == ((B if against else A)[0], A[0])


def test_flags_speed_and_bad_lines(spark):
    rows = made(spark, [(1, [A, B], {"collected": " Yes", "scheduled": "no", "maxspeed": "0", "speed": "25 mph"}), (2, [A, A], None), (3, [A], None), (4, [A, A, B], {"collected": ""})]).orderBy("section_id").collect()
    assert [r["section_id"] for r in rows] == [1, 4]
    assert (rows[0]["collected"], rows[0]["scheduled"], rows[1]["collected"]) == (True, False, False)
    assert rows[0]["speed_limit"] == pytest.approx(40.2335)
    assert len(rows[1]["coords"]) == 2


def test_merge_endpoints(spark):
    near, far = (40.010045, -74.0), (40.0102, -74.0)  # 5 m and 22 m from B
    r = {x["section_id"]: x for x in merge_endpoints(made(spark, [(0, [A, B], None), (1, [near, C], None), (2, [far, D], None)])).collect()}
    assert r[1]["start"]["lat"] == B[0] and r[1]["coords"][0]["lat"] == B[0]
    assert r[2]["start"]["lat"] == far[0]
    assert r[1]["length_m"] == pytest.approx(metres(near, C), abs=1e-6)  # as digitised


def test_merge_is_greedy_in_order(spark):
    p = [(40.0 + i * 0.00009, -74.0) for i in range(3)]  # 10 m apart in a row
    r = merge_endpoints(made(spark, [(0, [p[0], C], None), (1, [p[1], D], None), (2, [p[2], E], None)])).orderBy("section_id").collect()
    assert [x["start"]["lat"] for x in r] == [p[0][0], p[0][0], p[2][0]]


def test_tiny_section_keeps_its_end(spark):
    end = (40.00004, -74.0)
    r = merge_endpoints(made(spark, [(0, [A, end], None)])).first()
    assert (r["start"]["lat"], r["end"]["lat"]) == (A[0], end[0])


def replay(rows):
    """The same rules, one section after another: {seed: [(id, flipped)]}."""
    at = {}
    for i, line, oneway in rows:
        at.setdefault(line[0], []).append((i, True))
        at.setdefault(line[-1], []).append((i, False))
    line_of, one = {i: x for i, x, _ in rows}, {i: o for i, _, o in rows}
    used, out = set(), {}

    def follow(node, i):
        others = [e for e in at[node] if e[0] != i]
        return others[0] if len(others) == 1 and others[0][0] not in used else None

    for i, *_ in rows:
        if i in used:
            continue
        used.add(i)
        run = [(i, False)]
        while (e := follow(line_of[run[-1][0]][0 if run[-1][1] else -1], run[-1][0])) and (e[1] or one[e[0]] is not True):
            used.add(e[0])
            run.append((e[0], not e[1]))
        while (e := follow(line_of[run[0][0]][-1 if run[0][1] else 0], run[0][0])) and (not e[1] or one[e[0]] is not True):
            used.add(e[0])
            run.insert(0, (e[0], e[1]))
        out[i] = run
    return out


def test_chains_as_replayed(spark):
    import random

    rng = random.Random(7)
    places = [(40 + i * 0.01, -74.0) for i in range(60)]
    rows = []
    for i in range(70):
        a = rng.randrange(60)
        b = (a + rng.choice([1, 1, 1, 2, 0])) % 60
        line = [places[a], places[b]] if a != b else [places[a], (39.0, -74.0 - i * 0.01), places[a]]
        rows.append((i, line, rng.choice([True, False, None])))
    found = {}
    sections = made(spark, [(i, line, {} if o is None else {"oneway": "yes" if o else "no"}) for i, line, o in rows])
    for r in ch.chain_parts(sections).orderBy("chain_id", "pos").collect():
        found.setdefault(r["chain_id"], []).append((r["section_id"], r["flipped"]))
    assert found == replay(rows)


def test_roll_up(spark):
    sections = made(spark, [(0, [A, B], None), (1, [C, B], {"oneway": "no"}), (2, [C, D], {"oneway": "yes"})])
    chains, parts = ch.chain_sections(sections)
    r = chains.collect()
    assert len(r) == 1
    assert (r[0]["oneway"], r[0]["n_parts"], r[0]["name"], [p["lat"] for p in r[0]["coords"]]) == (True, 3, "s0 … s2 (3 sections)", [A[0], B[0], C[0], D[0]])
    assert r[0]["time_s"] == pytest.approx(r[0]["length_m"] / (30 * 1000 / 3600))
    assert parts.where(F.col("flipped")).first()["section_id"] == 1
