import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from roadweave.plans.engine import plan_days, plan_route
from roadweave.sinks.gpx import gpx_text
from roadweave.sources import kml, network, project
from roadweave.sources.depot import resolve_depot

HEAD = '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
TAIL = "</Document></kml>"


def mark(line, data="", name="", description=""):
    return f"<Placemark><name>{name}</name><description>{description}</description><ExtendedData>{data}</ExtendedData><LineString><coordinates>{line}</coordinates></LineString></Placemark>"


def value(k, v):
    return f'<Data name="{k}"><value>{v}</value></Data>'


SAMPLE = HEAD + "".join(mark(line, value("CollId", f"SEG00{i}") + value("RouteName", road) + value("Dir", d)) for i, (line, road, d) in enumerate([("-74.0,40.0,0 -74.0,40.01,0", "Main Street", "NB"), ("-74.0,40.01,0 -74.0,40.02,0", "Main Street", "NB"), ("-74.0,40.02,0 -73.99,40.02,0", "Cross Street", "EB")], 1)) + TAIL


@pytest.fixture
def sample(spark, tmp_path):
    (tmp_path / "in.kml").write_text(SAMPLE)
    return project.read_sections(spark, str(tmp_path / "in.kml"))


def test_kml_variants():
    broken = HEAD + mark("1,2 1,2 bad,3 1,3", '<SchemaData><SimpleData name="Road">A & B\x02</SimpleData></SchemaData>', "x") + mark("5,5") + "<Placemark><Point/></Placemark>" + TAIL
    found = kml.features(broken.encode())
    assert len(found) == 1
    assert found[0]["coords"] == [{"lat": 2.0, "lon": 1.0}, {"lat": 3.0, "lon": 1.0}]
    assert found[0]["fields"] == {"road": "A & B"}
    two = HEAD + "<Placemark><MultiGeometry><LineString><coordinates>1,1 2,2</coordinates></LineString><LineString><coordinates>3,3 4,4</coordinates></LineString></MultiGeometry></Placemark>" + TAIL
    assert kml.features(two.encode())[0]["coords"][0] == {"lat": 1.0, "lon": 1.0}
    assert kml.features(SAMPLE.replace("kml/2.2", "kml/2.1").encode()) == []


def test_kml_speed_from_description(spark, tmp_path):
    (tmp_path / "a.kml").write_text(HEAD + mark("1,1 2,2", description="limit 25 mph") + mark("1,1 2,2", value("maxspeed", "50"), description="25 mph") + TAIL)
    rows = kml.read_kml(spark, str(tmp_path / "a.kml")).orderBy("section_id").collect()
    assert [round(r["speed_limit"], 4) for r in rows] == [40.2335, 50.0]
    assert [r["name"] for r in rows] == ["Section 1", "Section 2"]


def test_no_features_is_an_error(spark, tmp_path):
    (tmp_path / "a.kml").write_text(HEAD + TAIL)
    with pytest.raises(ValueError):
        kml.read_kml(spark, str(tmp_path / "a.kml"))


def test_sample_route(spark, sample, tmp_path):
    r = plan_route(spark, sample, out_dir=str(tmp_path))
    assert r.totals["survey_m"] == pytest.approx(3075.452, abs=1e-3)
    assert r.totals["survey_s"] == pytest.approx(369.054, abs=1e-3)
    assert (r.totals["deadhead_m"], r.totals["jumps"], r.totals["wrong_way"], len(r.routes[0])) == (0, 0, 0, 4)
    v = r.visits.orderBy("order").collect()
    assert [round(x["eta_s"], 3) for x in v] == [0, 133.434, 266.868]
    assert [(x["dir_out"], x["next_segment"]) for x in v] == [("I", "SEG002"), ("I", "SEG003"), ("I", None)]
    back = project.read_sections(spark, str(tmp_path / "route.mpz")).orderBy("section_id").collect()
    assert [x["collid"] for x in back] == ["SEG001", "SEG002", "SEG003"]
    assert "<trkpt" in (tmp_path / "route.gpx").read_text() and "L.polyline" in (tmp_path / "route.html").read_text()


def test_days_and_lock(spark, sample, tmp_path):
    r = plan_days(spark, sample, (40.0, -74.01), lock=1, out_dir=str(tmp_path))
    assert r.filler == [] and r.days.count() == 1
    state = project.read_sections(spark, str(tmp_path / "remaining_segments.mpz"))
    assert state.where("scheduled").count() == 3
    with pytest.raises(ValueError):
        plan_days(spark, state, (40.0, -74.01))
    with pytest.raises(ValueError):
        plan_days(spark, sample, (40.0, -74.01), lock=9)
    assert plan_route(spark, state).totals["survey_m"] > 0  # one route ignores the schedule


def test_project_reading(spark):
    content = project.open_database  # a project made by hand
    db = sqlite3.connect(":memory:")
    from roadweave.functions.shapes import encode

    for q in ("create table t_item (id integer, name text, type integer)", "create table t_shape (item_id integer, coordinates blob)", "create table t_property (id integer, name text)", "create table t_property_lkp (item_id integer, property_id integer, value blob)"):
        db.execute(q)
    line = encode([(1.0, 1.0), (1.0, 2.0)])
    db.executemany("insert into t_item values (?, ?, ?)", [(1, "a", 3), (2, "b", 3), (3, "c", 1), (4, "d", 3), (5, "e", 3)])
    db.executemany("insert into t_shape values (?, ?)", [(1, line), (2, line), (3, line), (4, b"bad"), (5, line)])
    db.executemany("insert into t_property values (?, ?)", [(1, "RouteName"), (2, "CollId")])
    db.executemany("insert into t_property_lkp values (?, ?, ?)", [(1, 1, b"R1"), (1, 2, b"\xff\xfe"), (2, 1, b"Deadhead"), (5, 2, b" ")])
    db.commit()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data.sdb", db.serialize())
    files = spark.createDataFrame([("f", out.getvalue())], "file string, content binary")
    rows = project.parse_projects(files).orderBy("section_id").collect()
    assert [(r["name"], r["fields"]) for r in rows] == [("R1 a", {"routename": "R1"}), ("e", {})]
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("x", "y")
    with pytest.raises(ValueError):
        content(empty.getvalue())


def test_ways_and_tiles(spark, tmp_path):
    answer = {"elements": [
        {"type": "way", "id": 1, "geometry": [{"lat": 40.0, "lon": -74.0}, {"lat": 40.01, "lon": -74.0}], "tags": {"highway": "primary", "oneway": "-1"}},
        {"type": "way", "id": 2, "geometry": [{"lat": 40.0, "lon": -74.0}], "tags": {"highway": "primary"}},
        {"type": "node", "id": 3}, {"type": "way", "id": 4, "geometry": [{"lat": 40.0, "lon": -74.0}, {"lat": 40.0, "lon": -74.01}], "tags": {"highway": "odd", "maxspeed": "25 mph"}},
        {"type": "way", "id": 5, "geometry": [{"lat": 40.0, "lon": -74.0}, {"lat": 40.0, "lon": -74.01}], "tags": {"highway": "footway"}},
    ]}
    raw = network.parse_response(spark.createDataFrame([(json.dumps(answer),)], "json string"))
    rows = network.ways_from_elements(raw).orderBy("way_id").collect()
    assert [(r["way_id"], round(r["speed_kmh"], 4), r["oneway"]) for r in rows] == [(1, 70.0, True), (4, 40.2335, False)]
    way = lambda i, v: {"id": i, "geometry": [[40.0, -74.0], [40.01, -74.0]], "speed_kmh": v, "oneway": False}
    (tmp_path / "tile_160_-296.json").write_text(json.dumps({"ways": [way(1, 50.0), way(None, 1.0)]}))
    (tmp_path / "tile_160_-295.json").write_text(json.dumps({"ways": [way(1, 60.0), way(None, 1.0)]}))
    (tmp_path / "tile_161_-296.json").write_text("{broken")
    cache = network.read_tile_cache(spark, str(tmp_path))
    points = spark.createDataFrame([((40.0, -74.0),)], "p struct<lat: double, lon: double>")
    assert network.tile_cover(points).count() == 9
    found = network.network_ways(points, cache)
    assert sorted((r["way_id"] or 0, r["speed_kmh"]) for r in found.collect()) == [(0, 1.0), (0, 1.0), (1, 50.0)]
    calls = lambda box: [{"type": "way", "id": 9, "geometry": [{"lat": box[0], "lon": box[1]}, {"lat": box[2], "lon": box[3]}], "tags": {"highway": "service"}}]
    both = network.network_ways(points, cache, fetch=calls)
    assert both.where(F.col("way_id") == 9).count() == 1 and both.count() == 4


def test_quarters_and_retries():
    seen = []

    def fail(box):
        seen.append(box)
        raise RuntimeError

    assert len(list(network.fetch_quarters(fail, lambda box: [box], (0.0, 0.0, 1.0, 1.0)))) == 16
    assert len(seen) == 5


def test_depot():
    assert resolve_depot("40.1234567, -74.5") == (40.123457, -74.5)
    assert resolve_depot("x", lambda t: (1.0, 2.0)) == (1.0, 2.0)
    with pytest.raises(ValueError):
        resolve_depot("nowhere")


def test_roads_link_sections(spark, sample):
    cache = spark.createDataFrame([(160, -296, 1, [(40.0, -74.005), (40.03, -74.005)], 50.0, False)], "tx long, ty long, way_id long, geometry array<struct<lat: double, lon: double>>, speed_kmh double, oneway boolean")
    r = plan_days(spark, sample, (40.0, -74.006), cache=cache)
    assert r.days.first()["jumps"] == 0 and r.totals["deadhead_m"] > 0


def test_gpx_text():
    out = gpx_text([(1.0, 2.0)], [{"name": "a & b", "dist_m": 1500.0, "time_s": 60.0, "lat": 1.0, "lon": 2.0}], {"survey_m": 1.0, "deadhead_m": 2.0})
    assert "1. a &amp; b" in out and out.count("<trkseg>") == 1
