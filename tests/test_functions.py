import math

import pytest
from pyspark.sql import functions as F

from roadweave.functions import geo, shapes, text
from roadweave.plans.walk import metres

SPEEDS = [
    ("25 mph", 40.2335), ("50 km/h", 50.0), ("50 km/h (30 mph)", 48.2802), ("mph speed=30", 48.2802), ("0", 0.0), ("80", 80.0), ("50 kph", 50.0), ("maxspeed: 45", 45.0),
    ("walk", None), ("none", None), ("signals", None), ("variable", None), ("", None), (None, None), ("fast", None),
]


def test_speed_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPEEDS)], "i int, t string").select("i", text.parse_speed_limit(F.col("t")).alias("v")).orderBy("i").collect()
    for row, (given, expected) in zip(rows, SPEEDS, strict=True):
        assert row["v"] == (None if expected is None else pytest.approx(expected)), given


def test_geometry(spark):
    line = [(40.0, -74.0), (40.01, -74.0), (40.01, -74.0), (40.02, -73.99)]
    df = spark.createDataFrame([(1, line)], f"i int, line {geo.LINE}")
    r = df.select(
        geo.path_length(F.col("line")).alias("d"), F.size(geo.collapse_repeats(F.col("line"))).alias("n"), geo.middle(F.col("line")).alias("m"), geo.centroid(F.col("line")).alias("c"),
        geo.bearing(geo.point(F.lit(0.0), F.lit(0.0)), geo.point(F.lit(0.0), F.lit(-1.0))).alias("b"), geo.cell(F.lit(-0.5), 1.0).alias("cell"), geo.path_length(F.slice("line", 1, 1)).alias("none"),
    ).first()
    assert r["d"] == pytest.approx(sum(metres(a, b) for a, b in zip(line, line[1:], strict=False)), abs=1e-6)
    assert (r["n"], r["m"]["lat"], r["cell"], r["none"]) == (3, 40.01, 0, 0.0)
    assert r["c"]["lat"] == pytest.approx(40.01)
    assert r["b"] == pytest.approx(1.5 * math.pi)


def test_padding_and_escapes(spark):
    r = spark.range(1).select(text.padded(F.lit(12345), F.lit(4)).alias("a"), text.padded(F.lit(7), F.lit(4)).alias("b"), text.xml_escape(F.lit("a<b & \"c\"")).alias("c"), text.repair_xml(F.lit("a\x01 & b &amp; c &#38;")).alias("d")).first()
    assert tuple(r) == ("12345", "0007", "a&lt;b &amp; &quot;c&quot;", "a &amp; b &amp; c &#38;")


def test_shapes():
    line = [(40.0, -74.0), (40.01, -74.0)]
    blob = shapes.encode(line)
    assert shapes.decode(blob) == line
    assert shapes.decode(b"\x00" + blob[1:]) is None
    assert shapes.decode(blob[:-1]) is None
    assert shapes.decode(shapes.encode(line[:1])) is None
    assert shapes.decode(shapes.encode([line[0], line[0]])) is None
    assert shapes.decode(None) is None
