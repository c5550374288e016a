"""Plans against a plain version, files read back, sources with fakes, and the command line."""

import io
import json
import math
import random

import pytest

from roadweave import __main__ as cli
from roadweave.config import PlannerConfig
from roadweave.functions.geo import LINE
from roadweave.operators import chains as ch
from roadweave.operators.ranking import ranked
from roadweave.operators.sections import to_survey
from roadweave.operators.spatial import nearest_node
from roadweave.plans import days as dy
from roadweave.plans.engine import plan_days, plan_route
from roadweave.plans.walk import Chain, Network, metres, solve_day
from roadweave.queries import sections as table_sections
from roadweave.sinks import report
from roadweave.sources import depot, kml, network, project

from test_planning import csr
from test_sections import replay

HEAD = '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
TAIL = "</Document></kml>"


def kml_file(path, rows):
    """Sections (id, points, more fields) as a KML file."""
    value = lambda k, v: f'<Data name="{k}"><value>{v}</value></Data>'
    mark = lambda i, line, fields: "<Placemark><name>n" + str(i) + "</name><ExtendedData>" + value("CollId", i) + "".join(value(k, v) for k, v in fields.items()) + "</ExtendedData><LineString><coordinates>" + " ".join(f"{b},{a},0" for a, b in line) + "</coordinates></LineString></Placemark>"
    path.write_text(HEAD + "".join(mark(*r) for r in rows) + TAIL)
    return str(path)


def spokes(k=8, far=0.05):
    """Sections around (40, -74), one in each direction, no two of which touch."""
    at = lambda i, r: (round(40 + r * math.cos(2 * math.pi * i / k), 6), round(-74 + r * math.sin(2 * math.pi * i / k), 6))
    return [(100 + i, [at(i, far), at(i, far * 1.4)], {"Dir": "B" if i % 2 else "I"}) for i in range(k)]


# planning


def plain_sweep(net, chains, days):
    """Chains by bearing from the depot, cut after the widest gap into days of even time."""
    home = net.at[net.depot]

    def bearing(c):
        (la, lo), (lb, lp) = (map(math.radians, p) for p in (home, chains[c]))
        return math.atan2(math.sin(lp - lo) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(lp - lo)) % (2 * math.pi)

    order = sorted(chains, key=lambda c: (bearing(c), c))
    if days <= 1:
        return [order]
    gaps = [(bearing(order[(i + 1) % len(order)]) - bearing(c)) % (2 * math.pi) for i, c in enumerate(order)]
    seam = gaps.index(max(gaps)) + 1
    order = order[seam:] + order[:seam]
    total, done, groups = sum(net.chains[c].time_s for c in order), 0.0, [[] for _ in range(days)]
    for c in order:
        own = net.chains[c].time_s
        groups[min(days - 1, int((done + own / 2) / (total / days)))].append(c)
        done += own
    return dy.fill_empty(groups)


def plain_rebalance(net, groups, solved):
    for _ in range(net.config.rebalance_rounds if len(groups) > 1 else 0):
        hours = [d["hours"] for d in solved]
        spread = max(hours) - min(hours)
        if spread <= net.config.rebalance_stop * sum(hours) / len(hours):
            break
        hi, lo, options = hours.index(max(hours)), hours.index(min(hours)), []
        for a, b, at in ((hi, hi - 1, 0), (hi, hi + 1, -1), (lo - 1, lo, -1), (lo + 1, lo, 0)):
            if min(a, b) < 0 or max(a, b) >= len(groups) or hours[b] >= hours[a] or len(groups[a]) < 2:
                continue
            c = groups[a][at]
            new = [x for x in groups[a] if x != c], [c, *groups[b]] if at == -1 else [*groups[b], c]
            days = [solve_day(net, g) for g in new]
            now = list(hours)
            now[a], now[b] = days[0]["hours"], days[1]["hours"]
            if max(now) - min(now) < spread:
                options.append((max(now) - min(now), len(options), a, b, new, days))
        if not options:
            break
        _, _, a, b, new, days = min(options, key=lambda x: x[:2])
        groups[a], groups[b] = new
        solved[a], solved[b] = days
    return groups, solved


def plain_plan(net, chains, survey_m, days=None):
    c = net.config
    count, most = dy.estimated_days(survey_m, days, c)
    while True:
        groups = plain_sweep(net, chains, count)
        groups, solved = plain_rebalance(net, groups, [solve_day(net, g) for g in groups])
        if count >= most or max(d["hours"] for d in solved) <= c.shift_hours:
            break
        count += 1
    filler = []
    for i in range(len(groups)):
        while solved[i]["hours"] > c.shift_hours and len(groups[i]) > 1:
            near = min(groups[i], key=lambda x: metres(net.at[net.depot], chains[x]))
            groups[i].remove(near)
            filler.append(near)
            solved[i] = solve_day(net, groups[i])
    if filler:
        groups, solved = plain_rebalance(net, groups, solved)
    return solved, filler


@pytest.mark.parametrize("seed, days, hours", [(1, None, 2.0), (2, 3, 0.9), (3, 4, 3.0), (4, 2, 1.2)])
def test_plan_as_plain(spark, seed, days, hours):
    rng = random.Random(seed)
    at = [(40.0, -74.0)] + [(round(40 + rng.uniform(-0.2, 0.2), 6), round(-74 + rng.uniform(-0.2, 0.2), 6)) for _ in range(14)]
    best = {}
    for i in range(15):
        for j in rng.sample(range(15), 4):
            if i != j:
                best[i, j] = float(rng.randint(60, 900))
    chains = {i: Chain(i, i + 1, i + 1, rng.uniform(5e3, 3e4), float(rng.randint(300, 2000)), False, at[i + 1]) for i in range(14)}
    net = Network(csr(best, 15), at, chains, 0, PlannerConfig(shift_hours=hours, max_days=4))
    table = spark.createDataFrame([(c.chain_id, [c.centroid], c.time_s) for c in chains.values()], f"chain_id long, coords {LINE}, time_s double")
    survey = sum(c.length_m for c in chains.values())
    solved, filler = dy.plan_groups(spark, table, at[0], survey, spark.sparkContext.broadcast(net), days)
    expected, left = plain_plan(net, {c.chain_id: c.centroid for c in chains.values()}, survey, days)
    assert [d["members"] for d in solved] == [d["members"] for d in expected] and filler == left
    assert [d["hours"] for d in solved] == pytest.approx([d["hours"] for d in expected])


def test_chains_of_a_whole_table(spark, sf_dir):
    sections = table_sections(spark, sf_dir)
    place = lambda p: (round(p["lat"] * 10**6), round(p["lon"] * 10**6))
    rows = sorted((r["section_id"], [place(r["start"]), place(r["end"])], r["oneway"]) for r in sections.select("section_id", "start", "end", "oneway").collect())
    found = {}
    for r in ch.chain_parts(sections).orderBy("chain_id", "pos").collect():
        found.setdefault(r["chain_id"], []).append((r["section_id"], r["flipped"]))
    assert found == replay(rows)


def test_ranks_and_sums(spark):
    df = spark.createDataFrame([(i * 7 % 50, float(i)) for i in range(50)], "k int, v double").repartition(6)
    rows = ranked(df, "rn", "k", before="v").orderBy("k").collect()
    assert [r["rn"] for r in rows] == list(range(50))
    assert [r["before"] for r in rows] == [sum(x["v"] for x in rows[:i]) for i in range(50)]
    assert ranked(df.limit(0), "rn", "k", before="v").count() == 0


def test_far_nodes(spark):
    rng = random.Random(3)
    points = [(i, (rng.uniform(-60, 60), rng.uniform(-179, 179))) for i in range(40)] + [(100, (10.0, 179.9)), (101, (40.0, -74.0))]
    nodes = [(i, rng.uniform(-60, 60), rng.uniform(-179, 179)) for i in range(25)] + [(50, 10.0, -179.9), (51, 40.00001, -74.0), (52, 40.00001, -74.0)]
    found = nearest_node(spark.createDataFrame(points, "id long, p struct<lat: double, lon: double>"), spark.createDataFrame(nodes, "node_id long, lat double, lon double"))
    assert {r["id"]: r["node_id"] for r in found.collect()} == {i: min(nodes, key=lambda n: (metres(p, n[1:]), n[0]))[0] for i, p in points}
    assert nearest_node(spark.createDataFrame(points, "id long, p struct<lat: double, lon: double>"), spark.createDataFrame([], "node_id long, lat double, lon double")).count() == 0


# files


def test_state_file_gives_the_same_open_work(spark, tmp_path):
    rows = spokes() + [(200, [(40.2, -74.0), (40.21, -74.0)], {"Collected": "Yes", "Region": "7"})]
    given = project.read_sections(spark, kml_file(tmp_path / "in.kml", rows))
    first = plan_days(spark, given, (40.0, -74.0), days=3, lock=2, out_dir=str(tmp_path / "out"))
    assert set(first.files) == {"html", "report", "state", "remaining"} | {f"day_{i}_{k}" for i in (1, 2, 3) for k in ("mpz", "gpx")}
    day_of = {r["collid"]: r["day"] for r in first.assignment.join(given.select("section_id", "collid"), "section_id").collect()}
    state = project.read_sections(spark, first.files["state"])
    read = {r["collid"]: (r["collected"], r["scheduled"], r["fields"].get("scheduledday"), r["fields"].get("region")) for r in state.collect()}
    assert read == {str(i): (i == 200, False, str(day_of[str(i)]) if i != 200 else None, "7" if i == 200 else None) for i, *_ in rows}
    assert to_survey(state, honour_scheduled=True).count() == 8
    again = plan_days(spark, state, (40.0, -74.0), days=3)
    assert again.parts.count() == 8 and again.totals["survey_m"] == pytest.approx(first.totals["survey_m"])
    left = project.read_sections(spark, first.files["remaining"])
    read = {r["collid"]: (r["scheduled"], r["fields"].get("scheduledday")) for r in left.collect()}
    assert read == {str(i): (day_of.get(str(i)) == 2, str(day_of[str(i)]) if day_of.get(str(i)) in (1, 3) else None) for i, *_ in rows}
    following = plan_days(spark, left, (40.0, -74.0), days=2)
    assert {r["collid"] for r in following.assignment.join(left.select("section_id", "collid"), "section_id").collect()} == {c for c, d in day_of.items() if d != 2}
    page = (tmp_path / "out" / "plan.html").read_text()
    assert page.count("Already collected") == 1 and "Route 3: ~" in page


def test_route_file(spark, tmp_path):
    rows = [(1, [(40.0, -74.0), (40.01, -74.0)], {"Dir": "NB", "Juris": "T"}), (2, [(40.02, -74.0), (40.03, -74.0)], {"Dir": "D"}), (3, [(40.1, -74.0), (40.11, -74.0)], {"Collected": "y"})]
    result = plan_route(spark, project.read_sections(spark, kml_file(tmp_path / "in.kml", rows)), out_dir=str(tmp_path))
    summary = result.summary()
    assert (summary["sections"], summary["collected"], summary["runs"], summary["jumps"]) == (2, 1, 2, 1) and summary["mpz"].endswith("route.mpz")
    db = project.open_database((tmp_path / "route.mpz").read_bytes())
    items = db.execute("select id, name, description from t_item where type = 3 order by order_idx").fetchall()
    assert [n for _, n, _ in items] == ["0001 · 1", "→ 0002", "0002 · 2", "✓ 3"]
    names = dict(db.execute("select id, name from t_property"))
    values = lambda i: {names[p]: v.decode() for p, v in db.execute("select property_id, value from t_property_lkp where item_id = ? and value is not null", (i,)) if p in names}
    assert items[0][2].startswith("Run 1 of 2 | 1.11 km | ETA +0.0 h | BLUE: drive WITH the arrows | original Dir: NB | next: CollId 2")
    assert values(items[0][0]) == {"CollId": "1", "Dir": "I", "Juris": "T", "Collected": "No", "RouteOrder": "1", "NextCollId": "2"}
    moved = values(items[1][0])
    assert (moved["RouteName"], moved["RouteOrder"], moved["NextCollId"]) == ("Deadhead", "2", "2") and "to segment 0002 (CollId 2)" in items[1][2]
    assert values(items[3][0])["Collected"] == "Yes" and items[3][2] == "Already collected — not part of the route"
    guids = [g for (g,) in db.execute("select guid from t_item")]
    other = project.open_database(project_content())
    assert len(set(guids)) == len(guids) and not {g for (g,) in other.execute("select guid from t_item")} & set(guids)
    assert db.execute("select count(*) from t_sequence").fetchone()[0] == 6
    # generated transfers are not read again
    assert project.read_sections(spark, str(tmp_path / "route.mpz")).count() == 3
    gpx = (tmp_path / "route.gpx").read_text()
    assert "<name>Survey Route</name>" in gpx and "2 runs, " in gpx and gpx.count("<wpt") == 2 and "ETA +0.0 h (" in gpx
    assert "Already collected: 1" in (tmp_path / "route.html").read_text()


def project_content():
    from roadweave.sinks.project import Project

    return Project("t").content()


def test_report_tests_the_total():
    day = {"day": 1, "hours": 2.0, "survey_mi": 50.0, "deadhead_mi": 30.0, "total_mi": 80.0, "efficiency": 62.5, "segments": 3, "wrong_way_return": True}
    text = report.plan_report([day, day | {"day": 2, "hours": 3.0, "total_mi": 60.0}], {1: ["A1I  B2D"]}, 2.5, 70.0, (4, 12.0))
    assert "minimum 70 mi: OK" in text and "minimum 70 mi: UNDER" in text and "(OVER the 2.5 h shift)" in text and "    A1I  B2D" in text
    assert "4 segments, 12 mi near" in text and "spread 40% of average" in text and "return leg ignores" in text


# sources


def test_broken_xml():
    found = kml.features((HEAD + "<Placemark><name>A&nbsp;B &amp; C & D\x7f &#65;</name><LineString><coordinates>1,1 2,2</coordinates></LineString></Placemark>" + TAIL).encode())
    assert found[0]["feature_name"] == "A&nbsp;B & C & D A"


def test_fetched_tiles_are_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = f"file://{tmp_path}/tiles"

    def fetch(box):
        (calls / "_".join(map(str, box))).write_text("")
        if box[0] >= 40.25:
            return []
        return [{"type": "way", "id": int(box[1] * 100), "geometry": [{"lat": box[0], "lon": box[1]}, {"lat": box[2], "lon": box[3]}], "tags": {"highway": "service", "oneway": "yes"}}]

    points = spark.createDataFrame([((40.1, -74.1),)], "p struct<lat: double, lon: double>")
    first = sorted(map(str, network.network_ways(points, None, fetch, folder=folder).collect()))
    assert len(list(calls.iterdir())) == 9 and len(first) == 3
    for f in calls.iterdir():
        f.unlink()
    second = network.network_ways(points, None, fetch, folder=folder)
    assert [r["oneway"] for r in second.collect()] == [True] * 3 and not list(calls.iterdir())
    (tmp_path / "tiles" / "tile_160_-297.json").write_text("{broken")
    assert network.network_ways(points, None, fetch, folder=folder).count() == 3 and len(list(calls.iterdir())) == 1
    assert json.loads((tmp_path / "tiles" / "tile_161_-297.json").read_text()) == {"ways": []}


def test_patient_fetcher(spark, monkeypatch):
    waits, asked = [], []

    def refuse(request, timeout):
        asked.append(request.full_url)
        raise OSError("busy")

    monkeypatch.setattr(network.urllib.request, "urlopen", refuse)
    fetch = network.http_fetcher(urls=("http://a", "http://b"), pause=waits.append)
    with pytest.raises(RuntimeError):
        fetch((0.0, 0.0, 1.0, 1.0))
    assert len(asked) == 2 and waits == []
    with pytest.raises(RuntimeError):
        fetch.patient((0.0, 0.0, 1.0, 1.0))
    assert len(asked) == 8 and waits == [2.0, 4.0]


def test_address_search():
    asked = []

    def answer(request, timeout):
        asked.append((request.full_url, timeout))
        return io.BytesIO(json.dumps([{"lat": "40.1234567", "lon": "-74.5"}] if "Main" in request.full_url else []).encode())

    search = depot.address_search(open_url=answer)
    assert depot.resolve_depot("1 Main Street, Town", search) == (40.123457, -74.5) and "limit=1" in asked[0][0] and asked[0][1] == 30
    with pytest.raises(ValueError):
        depot.resolve_depot("nowhere", search)
    assert depot.resolve_depot("40,-74", search) == (40.0, -74.0) and len(asked) == 2


# command line


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    given = kml_file(tmp_path / "in.kml", spokes(4))
    monkeypatch.chdir(tmp_path)
    route = cli.run(spark, ["route", given, "--no-osm", "--start", "40.0,-74.0", "--html", "", "--mpz", "out.mpz"])
    assert set(route.files) == {"gpx", "mpz"} and (tmp_path / "out.mpz").exists() and (tmp_path / "survey_route.gpx").exists()
    days = cli.run(spark, ["days", given, "--no-osm", "--hotel", "40.0,-74.0", "--days", "2", "--lock", "1", "--min-miles", "1", "--collect-mph", "30", "--out-dir", str(tmp_path / "plan")])
    assert (tmp_path / "plan" / "remaining_segments.mpz").exists() and days.days.count() == 2 and "30 mph collecting" in capsys.readouterr().out
    for wrong in (["route", given, "--start", "here"], ["days", given], []):
        with pytest.raises(SystemExit):
            cli.run(spark, wrong)


def test_data_sources(spark, tmp_path):
    from roadweave.sinks.project import Project
    from roadweave.sources.datasource import register

    register(spark)
    kml_file(tmp_path / "in.kml", spokes(3))
    rows = spark.read.format("roadweave_kml").load(str(tmp_path / "in.kml"))
    assert sections_names(kml.sections_of(rows)) == ["100", "101", "102"]
    own = Project("t")
    own.add_line("a", [(1.0, 1.0), (1.0, 2.0)], {"CollId": "7", "Dir": "I"})
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.mpz").write_bytes(own.content())
    read = lambda table: spark.read.format("roadweave_project").option("table", table).load(f"file://{tmp_path}/p")
    sections = project.sections_of_tables(read("items"), read("shapes"), read("properties"), read("property_values"))
    assert sections_names(sections) == ["7"]


def sections_names(sections):
    return [r["name"] for r in sections.orderBy("section_id").collect()]
