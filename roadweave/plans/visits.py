"""Relational expansion of a solved route: legs, visits with arrival times, day reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FEET_PER_M, PlannerConfig
from ..functions import geo, text


def section_ref(collid, name):
    """How plans and files call a section: its collection id, else its name."""
    return F.coalesce(F.nullif(collid, F.lit("")), name)


def visits(legs: DataFrame, parts: DataFrame, sections: DataFrame, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """One row a section in drive order: (day, order, leg_no, section_id, reversed, dh_m, dh_s, time_s, eta_s).

    ``legs`` has (day, leg_no, chain_id, flipped, dh_m, dh_s). The transfer counts on a leg's first visit; eta_s has all
    transfers and sections before a visit, its own transfer included.
    """
    kmh = F.coalesce(text.known_speed(F.col("speed_limit")), F.lit(config.default_speed_kmh))
    one = legs.select("day", "leg_no", "chain_id", "flipped", "dh_m", "dh_s").join(parts.withColumnRenamed("flipped", "part_flipped"), "chain_id").join(sections.select("section_id", "length_m", "speed_limit", "digitized_reversed", "collid", "name"), "section_id")
    one = one.withColumns({"at": F.when(F.col("flipped"), -F.col("pos")).otherwise(F.col("pos")), "reversed": F.col("part_flipped") != F.col("flipped"), "time_s": geo.drive_seconds(F.col("length_m"), kmh)})
    drive = Window.partitionBy("day").orderBy("leg_no", "at")
    one = one.withColumn("order", F.row_number().over(drive)).withColumn("first", F.row_number().over(Window.partitionBy("day", "leg_no").orderBy("at")) == 1)
    transfer = F.when(F.col("first"), F.col("dh_s")).otherwise(0.0)
    before = F.coalesce(F.sum("time_s").over(drive.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    eta = before + F.sum(transfer).over(drive.rowsBetween(Window.unboundedPreceding, 0))
    moved = F.col("first") & (F.col("dh_m") > 0)
    return one.select(
        "day", "order", "leg_no", "section_id", "reversed", F.when(moved, F.col("dh_m")).alias("dh_m"), F.when(moved, F.col("dh_s")).alias("dh_s"), "time_s", eta.alias("eta_s"),
        F.when(F.col("reversed") != F.col("digitized_reversed"), "D").otherwise("I").alias("dir_out"), F.lead(section_ref(F.col("collid"), F.col("name"))).over(drive).alias("next_segment"), "length_m",
    )


def labelled(visited: DataFrame) -> DataFrame:
    """Add the day's number of visits, the padded rank (four digits or more) and the length in feet."""
    counted = visited.withColumn("visits", F.count("*").over(Window.partitionBy("day")))
    width = F.greatest(F.lit(4), F.length(F.col("visits").cast("string")))
    return counted.withColumns({"rank": text.padded(F.col("order"), width), "length_ft": F.round(F.col("length_m") * FEET_PER_M, 1)})


def leg_times(legs: DataFrame) -> DataFrame:
    """Add eta_s (time of all legs before) and the end of the route slice: the next leg's start, the last one's route_points (the route's length)."""
    order = Window.partitionBy("day").orderBy("leg_no")
    return legs.withColumns({"eta_s": F.coalesce(F.sum("time_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "end_index": F.coalesce(F.lead("start_index").over(order), "route_points")})


def leg_totals(legs: DataFrame) -> DataFrame:
    """Survey and transfer sums, jumps and one-way exceptions of each day."""
    return legs.groupBy("day").agg(
        F.sum("survey_m").alias("survey_m"), F.sum("survey_s").alias("survey_s"), F.sum("dh_m").alias("deadhead_m"), F.sum("dh_s").alias("deadhead_s"), F.count_if("is_jump").alias("jumps"), F.count_if("is_wrong_way").alias("wrong_way")
    )


def token_lines(visited: DataFrame, per_line: int = 10, between: str = " ") -> DataFrame:
    """(day, line_no, line): tokens {id}{I|D} in drive order, ten a line."""
    ids = visited.withColumns({"line_no": F.floor((F.col("order") - 1) / per_line).cast("long"), "token": F.concat(section_ref(F.col("collid"), F.col("name")), F.col("dir_out"))})
    rows = ids.groupBy("day", "line_no").agg(F.sort_array(F.collect_list(F.struct("order", "token"))).alias("t"))
    return rows.select("day", "line_no", F.array_join(F.transform("t", lambda x: x["token"]), between).alias("line"))
