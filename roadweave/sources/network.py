"""Road network: tiles, their cache, and ways of raw responses. Nothing is fetched unless a fetcher is given."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import EXCLUDED_HIGHWAYS, HIGHWAY_SPEEDS, NETWORK_URLS, PlannerConfig
from ..functions import geo, text
from ..operators.ranking import ranked

ELEMENT = f"struct<type: string, id: long, geometry: {geo.LINE}, tags: map<string, string>>"
CACHED = "ways array<struct<id: long, geometry: array<array<double>>, speed_kmh: double, oneway: boolean>>"

#: A fetcher gets (south, west, north, east) and returns raw elements as JSON objects.
Fetcher = Callable[[tuple[float, float, float, float]], list[dict]]


def tile_cover(points: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Distinct tiles (tx, ty) of rows (p) and the ring around them."""
    own = points.select(F.floor(F.col("p.lat") / config.tile_deg).cast("long").alias("x"), F.floor(F.col("p.lon") / config.tile_deg).cast("long").alias("y")).distinct()
    ring = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    return own.withColumn("o", ring).select((F.col("x") + F.col("o.dx")).alias("tx"), (F.col("y") + F.col("o.dy")).alias("ty")).distinct()


def uncached(tiles: DataFrame, cached: DataFrame) -> DataFrame:
    return tiles.join(cached.select("tx", "ty"), ["tx", "ty"], "left_anti")


def highway_speed(highway):
    """km/h of a road class by a literal map; null for others."""
    table = F.create_map(*[F.lit(x) for k, v in HIGHWAY_SPEEDS.items() for x in (k, float(v))])
    return F.try_element_at(table, F.coalesce(highway, F.lit("")))


def ways_from_elements(elements: DataFrame, config: PlannerConfig = PlannerConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(way_id, geometry, speed_kmh, oneway) and the columns to ``keep`` of rows (element): ways with two points or more of classes that are driven.

    -1 counts as one-way along the geometry; the posted speed comes first, then the class, then the default.
    """
    tags = F.col("element.tags")
    ways = elements.where("element.type = 'way' and size(element.geometry) >= 2").where(~F.coalesce(tags["highway"], F.lit("")).isin(*EXCLUDED_HIGHWAYS) & ~F.coalesce(tags["area"] == "yes", F.lit(False)))
    speed = F.coalesce(text.known_speed(text.parse_speed_limit(tags["maxspeed"])), highway_speed(tags["highway"]), F.lit(config.default_speed_kmh))
    line = F.transform("element.geometry", lambda p: geo.snap(p["lat"], p["lon"]))
    return ways.select(*keep, F.col("element.id").alias("way_id"), line.alias("geometry"), speed.alias("speed_kmh"), F.coalesce(tags["oneway"].isin("yes", "true", "1", "-1"), F.lit(False)).alias("oneway"))


def parse_response(responses: DataFrame) -> DataFrame:
    """Rows (element) of raw JSON responses (json)."""
    parsed = F.from_json("json", f"elements array<{ELEMENT}>")
    return responses.select(F.explode(parsed["elements"]).alias("element"))


def cached_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(tx, ty, ways) of the files tile_<tx>_<ty>.json; unreadable files count as not cached, a missing folder has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"tx long, ty long, {CACHED}")
    raw = spark.read.format("text").options(wholetext=True, ignoreCorruptFiles=True).load(folder, pathGlobFilter="tile_*.json")
    name = F.split(F.regexp_extract(F.input_file_name(), r"tile_(-?\d+)_(-?\d+)\.json$", 0), r"[_.]")
    parsed = raw.select(name.alias("n"), F.from_json("value", CACHED).alias("tile")).where("tile.ways is not null")
    return parsed.select(F.try_element_at("n", F.lit(2)).cast("long").alias("tx"), F.try_element_at("n", F.lit(3)).cast("long").alias("ty"), "tile.ways")


def ways_of_tiles(tiles: DataFrame) -> DataFrame:
    """Ways (tx, ty, way_id, geometry, speed_kmh, oneway) of ``cached_tiles``."""
    line = F.transform("w.geometry", lambda p: geo.point(p[0], p[1]))
    return tiles.select("tx", "ty", F.explode("ways").alias("w")).select("tx", "ty", F.col("w.id").alias("way_id"), line.alias("geometry"), "w.speed_kmh", "w.oneway")


def read_tile_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The ways of a folder's tiles."""
    return ways_of_tiles(cached_tiles(spark, folder))


def write_tile_cache(tiles: DataFrame, ways: DataFrame, folder: str) -> None:
    """Write each of ``tiles`` (tx, ty) with its ``ways`` as one file, a tile without ways too. One tile at a time comes to the driver, which writes it through Spark's file system."""
    spark = tiles.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    line = F.transform("geometry", lambda p: F.array(p["lat"], p["lon"]))
    own = ways.groupBy("tx", "ty").agg(F.collect_list(F.struct(F.col("way_id").alias("id"), line.alias("geometry"), "speed_kmh", "oneway")).alias("ways"))
    none = F.from_json(F.lit('{"ways": []}'), CACHED)["ways"]
    rows = tiles.join(own, ["tx", "ty"], "left").select("tx", "ty", F.to_json(F.struct(F.coalesce("ways", none).alias("ways"))).alias("json"))
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.toLocalIterator():
        out = files.create(path(f"{folder.rstrip('/')}/tile_{r['tx']}_{r['ty']}.json"), True)
        out.write(bytearray(r["json"].encode()))
        out.close()


def distinct_ways(ways: DataFrame) -> DataFrame:
    """The first row of each way_id by (fetched, tx, ty): cached tiles before fetched ones. Rows without an id all stay."""
    known = ways.where("way_id is not null").groupBy("way_id").agg(F.min_by(F.struct("geometry", "speed_kmh", "oneway", "fetched", "tx", "ty"), F.struct("fetched", "tx", "ty")).alias("w")).select("way_id", "w.*")
    return known.unionByName(ways.where("way_id is null").select(*known.columns))


def numbered_ways(ways: DataFrame) -> DataFrame:
    """Add way_no, the order in which ways enter the graph."""
    return ranked(ways, "way_no", "fetched", "tx", "ty", "way_id")


#: Rounds over all servers for a box that is not divided any more (fixed value).
PATIENT_ATTEMPTS = 3


def request_text(box: tuple[float, float, float, float], timeout: int) -> str:
    """The web API's query for drivable ways in a box."""
    excluded = "|".join(EXCLUDED_HIGHWAYS)
    return f'[out:json][timeout:{timeout}];way["highway"]["highway"!~"^({excluded})$"]["area"!="yes"]({",".join(f"{x:.6f}" for x in box)});out geom;'


def http_fetcher(timeout: int = 120, urls: tuple[str, ...] = NETWORK_URLS, attempts: int = 1, pause: Callable[[float], None] = time.sleep) -> Fetcher:
    """A fetcher that tries all servers, round by round with growing pauses. Its attribute ``patient`` is one of three rounds, for the smallest boxes."""

    def fetch(box):
        data, last = urllib.parse.urlencode({"data": request_text(box, timeout)}).encode(), None
        for attempt in range(attempts):
            for url in urls:
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, data), timeout=timeout) as answer:
                        return json.load(answer)["elements"]
                except (OSError, ValueError, KeyError) as error:
                    last = error
            if attempt + 1 < attempts:
                pause(2.0 ** (attempt + 1))
        raise RuntimeError(f"no server answered: {last}")

    fetch.patient = http_fetcher(timeout, urls, PATIENT_ATTEMPTS, pause) if attempts < PATIENT_ATTEMPTS else fetch
    return fetch


def fetch_quarters(fetch: Fetcher, final: Fetcher, box: tuple[float, float, float, float], depth: int = 0, deepest: int = 2) -> Iterator[dict]:
    """Elements of a box; one that fails is fetched by quarters, and at the deepest level by ``final``."""
    if depth == deepest:
        yield from final(box)
        return
    try:
        yield from fetch(box)
    except RuntimeError:
        south, west, north, east = box
        lat, lon = (south + north) / 2, (west + east) / 2
        for quarter in ((south, west, lat, lon), (south, lon, lat, east), (lat, west, north, lon), (lat, lon, north, east)):
            yield from fetch_quarters(fetch, final, quarter, depth + 1, deepest)


def fetch_tiles(tiles: DataFrame, fetch: Fetcher, final: Fetcher | None = None, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """Rows (tx, ty, element), one tile a task step; ``final`` is the more patient fetcher of the smallest boxes (else ``fetch.patient``, else ``fetch``)."""
    schema = f"tx long, ty long, element {ELEMENT}"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for tx, ty in zip(pdf["tx"], pdf["ty"], strict=True):
                box = (tx * config.tile_deg, ty * config.tile_deg, (tx + 1) * config.tile_deg, (ty + 1) * config.tile_deg)
                found = [{"type": e.get("type"), "id": e.get("id"), "geometry": e.get("geometry"), "tags": e.get("tags")} for e in fetch_quarters(fetch, final or getattr(fetch, "patient", fetch), box)]
                if found:
                    yield pd.DataFrame({"tx": [tx] * len(found), "ty": [ty] * len(found), "element": found})

    return tiles.repartition("tx", "ty").mapInPandas(run, schema)


def network_ways(points: DataFrame, cache: DataFrame | None, fetch: Fetcher | None = None, config: PlannerConfig = PlannerConfig(), folder: str | None = None) -> DataFrame:
    """Numbered ways of the tiles around points (p): cached ones, and fetched ones where a fetcher is given.

    The cache is ``cache`` (rows of ways) or the tiles in ``folder``, where fetched tiles are written so that no later run fetches them.
    """
    if cache is None and fetch is None and folder is None:
        raise ValueError("neither a tile cache nor a fetcher is given")
    tiles = tile_cover(points, config)
    columns = ["tx", "ty", "way_id", "geometry", "speed_kmh", "oneway"]
    parts, known = [], []
    if folder is not None:
        held = checkpointed(cached_tiles(points.sparkSession, folder))
        known.append(held.select("tx", "ty"))
        parts.append(ways_of_tiles(held.join(tiles, ["tx", "ty"], "left_semi")).select(*columns, F.lit(False).alias("fetched")))
    if cache is not None:
        known.append(cache.select("tx", "ty").distinct())
        parts.append(cache.join(tiles, ["tx", "ty"], "left_semi").select(*columns, F.lit(False).alias("fetched")))
    if fetch is not None:
        missing = tiles
        for tiles_held in known:
            missing = uncached(missing, tiles_held)
        missing = checkpointed(missing)
        ways = checkpointed(ways_from_elements(fetch_tiles(missing, fetch, config=config), config, keep=("tx", "ty")))
        if folder is not None:
            write_tile_cache(missing, ways, folder)
        parts.append(ways.select(*columns, F.lit(True).alias("fetched")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return numbered_ways(distinct_ways(found))
