"""Distance joins on integer grid cells: points meet by equality of a cell, distances decide after."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..config import M_PER_DEGREE, PlannerConfig
from ..functions import geo
from .components import components


#: Metres of a degree of latitude at least.
LEAST_M_PER_DEGREE = 111_000.0


def bucketed(df: DataFrame, p: Column, size: float) -> DataFrame:
    """Add the cell (cx, cy) of a point."""
    return df.withColumns({"cx": geo.cell(p["lat"], size), "cy": geo.cell(p["lon"], size)})


def near_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Rows of ``left`` (point a) and ``right`` (point b) whose cells are the same or neighbours, with ``d`` in metres and the cell's rank."""
    dealt = left.withColumn("_at", F.explode(geo.around(F.col("a"), size))).select(*left.columns, "_at.cx", "_at.cy", "_at.rank")
    return dealt.join(bucketed(right, F.col("b"), size), ["cx", "cy"]).drop("cx", "cy").withColumn("d", geo.haversine(F.col("a"), F.col("b")))


def proximity_pairs(points: DataFrame, tolerance_m: float = 15.0) -> DataFrame:
    """Pairs (id_a < id_b, d) of rows (id, p) nearer than the tolerance, as far as the latitude-sized grid brings them together."""
    size = tolerance_m / M_PER_DEGREE
    pairs = near_pairs(points.select(F.col("id").alias("id_a"), F.col("p").alias("a")), points.select(F.col("id").alias("id_b"), F.col("p").alias("b")), size)
    return pairs.where((F.col("id_a") < F.col("id_b")) & (F.col("d") < tolerance_m)).select("id_a", "id_b", "d")


def nearest_way_speed(sections: DataFrame, ways: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """(section_id, speed_kmh, d) of the way with the vertex nearest to each section's middle, within the match radius.

    ``ways`` (way_id, geometry, speed_kmh) take part where a vertex is in the 3 x 3 cells; equal distances go to the smaller way_id.
    """
    size = config.speed_cell_deg
    mid = sections.select("section_id", geo.middle(F.col("coords")).alias("a"))
    # sections share middles; a way stands in each cell that one of its vertices is in, with all of them
    dealt = mid.select("a").distinct().withColumn("_at", F.explode(geo.around(F.col("a"), size))).select("a", "_at.cx", "_at.cy")
    own = F.array_distinct(F.transform("geometry", lambda v: F.struct(geo.cell(v["lat"], size).alias("cx"), geo.cell(v["lon"], size).alias("cy"))))
    cells = ways.select("way_id", "speed_kmh", "geometry", F.explode(own).alias("_at")).select("way_id", "speed_kmh", "geometry", "_at.cx", "_at.cy")
    reached = dealt.join(cells, ["cx", "cy"]).withColumn("d", F.array_min(F.transform("geometry", lambda v: geo.haversine(F.col("a"), v))))
    best = reached.where(F.col("d") < config.speed_match_m).groupBy("a").agg(F.min_by(F.struct("speed_kmh", "d"), F.struct("d", "way_id")).alias("m"))
    return mid.join(best, "a").select("section_id", "m.speed_kmh", "m.d")


def nearest_node(points: DataFrame, nodes: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """(id, node_id, d) for rows (id, p): the nearest node of the 3 x 3 cells, else the nearest of all.

    Ties go to the cell of lower rank, then the smaller node_id. The second phase takes only the points that the grid left
    without a node: cells grow until each has a node at a distance that they cover. Without nodes there is no row.
    """
    size = config.link_cell_m / M_PER_DEGREE
    left = points.select("id", F.col("p").alias("a"))
    right = nodes.select("node_id", F.struct("lat", "lon").alias("b"))
    close = near_pairs(left, right, size).groupBy("id").agg(F.min_by(F.struct("node_id", "d"), F.struct("d", "rank", "node_id")).alias("m"))
    out = checkpointed(close)
    rest = checkpointed(left.join(out.select("id"), "id", "left_anti"))
    some = right.limit(1).count() > 0
    while some and rest.limit(1).count():
        size *= 8
        found = near_pairs(rest, right, size) if size < 45 else rest.crossJoin(right).withColumn("d", geo.haversine(F.col("a"), F.col("b")))
        found = found.groupBy("id").agg(F.min_by(F.struct("node_id", "d"), F.struct("d", "node_id")).alias("m"))
        if size < 45:  # in every direction the neighbouring cells reach at least this far, degrees of longitude being shorter
            met = found.join(rest, "id")
            reach = F.lit(size * LEAST_M_PER_DEGREE) * F.cos(F.radians(F.least(F.abs("a.lat") + 2 * size, F.lit(90.0))))
            found = met.where((F.col("m.d") <= reach) & (F.abs("a.lon") + 2 * size < 180)).select("id", "m")
        found = checkpointed(found)
        out, rest = out.unionByName(found), checkpointed(rest.join(found.select("id"), "id", "left_anti"))
    return out.select("id", "m.node_id", "m.d")


def depot_nearest(depot: tuple[float, float], nodes: DataFrame) -> DataFrame:
    """One row (node_id, d): the node nearest to the depot, the smaller id of equals."""
    at = geo.point(F.lit(depot[0]), F.lit(depot[1]))
    d = geo.haversine(at, F.struct("lat", "lon"))
    return nodes.withColumn("d", d).agg(F.min_by(F.struct("node_id", "d"), F.struct("d", "node_id")).alias("m")).where("m is not null").select("m.node_id", "m.d")


def _canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy by first appearance within one component: a point joins the nearest canonical point before it, else becomes canonical."""
    rows = pdf.sort_values("first").drop_duplicates("first")
    pairs: dict[int, list[tuple[float, int, int]]] = {}
    for a, b, d, rank in pdf[["first", "other", "d", "rank"]].dropna().itertuples(index=False):
        pairs.setdefault(int(a), []).append((d, int(rank), int(b)))
    canonical: dict[int, int] = {}
    for first in rows["first"].astype(int):
        options = sorted(x for x in pairs.get(first, ()) if canonical.get(x[2]) == x[2])
        canonical[first] = options[0][2] if options else first
    return pd.DataFrame({"first": list(canonical), "canonical": list(canonical.values())})


def merged_points(points: DataFrame, tolerance_m: float = 15.0) -> DataFrame:
    """(p, canonical) for distinct points (p, first) that move: ``first`` is the order of appearance. Order-dependent greedy, replayed per component."""
    size = tolerance_m / M_PER_DEGREE
    left = points.select(F.col("first").alias("fa"), F.col("p").alias("a"))
    right = points.select(F.col("first").alias("fb"), F.col("p").alias("b"))
    pairs = checkpointed(near_pairs(left, right, size).where((F.col("fa") != F.col("fb")) & (F.col("d") < tolerance_m)).select("fa", "fb", "d", "rank"))
    labels = components(pairs, "fa", "fb")
    rows = pairs.join(labels.withColumnRenamed("node", "fa"), "fa").select("root", F.col("fa").alias("first"), F.col("fb").alias("other"), "d", "rank")
    moved = rows.groupBy("root").applyInPandas(_canonical, "first long, canonical long").where("first <> canonical")
    at = points.select(F.col("first").alias("canonical"), F.col("p").alias("to"))
    return moved.join(points, "first").join(at, "canonical").select("p", "to")


def merge_endpoints(sections: DataFrame, tolerance_m: float = 15.0) -> DataFrame:
    """Snap section ends nearer than the tolerance to one shared point, in order of appearance (start before end of each section).

    Lengths and digitised geometry stay; a two-point section that would fall together keeps its own end.
    """
    ends = sections.select(F.col("section_id"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("p")), F.struct(F.lit(1).alias("side"), F.col("end").alias("p")))).alias("e"))
    points = ends.groupBy("e.p").agg(F.min(F.col("section_id") * 2 + F.col("e.side")).alias("first"))
    moved = checkpointed(merged_points(points, tolerance_m))
    out = sections
    for side in ("start", "end"):
        out = out.join(moved.select(F.col("p").alias(side), F.col("to").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    inner = F.slice("coords", F.lit(2), F.greatest(F.size("coords") - 2, F.lit(0)))
    own_end = (F.size("coords") == 2) & (F.col("_start") == F.col("_end"))
    new_end = F.when(own_end, F.col("end")).otherwise(F.col("_end"))
    out = out.withColumns({"coords": F.concat(F.array("_start"), inner, F.array(new_end)), "start": F.col("_start"), "end": new_end})
    return out.select(*sections.columns)
