"""Sections: one row per road piece to survey, projected from geometry and free attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text

ONEWAY_KEYS = ("oneway", "one_way", "one-way", "is_one_way")
SPEED_KEYS = ("maxspeed", "speed_limit", "speedlimit", "speed")
BOTH_WAYS = ("B", "T", "BOTH")

SECTIONS = (
    f"section_id long, coords {geo.LINE}, digitized_coords {geo.LINE}, digitized_reversed boolean, start {geo.POINT}, end {geo.POINT}, length_m double, "
    "oneway boolean, speed_limit double, name string, collid string, dir_code string, collected boolean, scheduled boolean, fields map<string, string>"
)


def direction(fields):
    """(dir code, one-way or null, whether the drive direction is against the digitised one)."""
    code = F.upper(F.coalesce(fields["dir"], F.lit("")))
    # the last of the keys with a readable value decides
    keyed = F.coalesce(*[text.yes_no(fields[k]) for k in reversed(ONEWAY_KEYS)])
    oneway = F.when(code == "", keyed).when(code.isin(*BOTH_WAYS), False).otherwise(True)
    return code, oneway, code == "D"


def posted_speed(fields):
    """The first key with a non-zero speed; else the last key's value, which may be zero."""
    parsed = [text.parse_speed_limit(fields[k]) for k in SPEED_KEYS]
    return F.coalesce(*[text.known_speed(p) for p in parsed])


def build_sections(raw: DataFrame) -> DataFrame:
    """Project rows (section_id, coords, fields, name) to sections; null fields count as none, lines under two distinct points go."""
    raw = raw.withColumns({"coords": geo.collapse_repeats(F.col("coords")), "fields": F.coalesce("fields", F.create_map().cast("map<string,string>"))}).where("size(coords) >= 2")
    code, oneway, against = direction(F.col("fields"))
    out = raw.withColumns({"dir_code": code, "oneway": oneway, "digitized_reversed": against, "digitized_coords": F.col("coords"), "coords": F.when(against, F.reverse("coords")).otherwise(F.col("coords"))})
    return out.select(
        "section_id", "coords", "digitized_coords", "digitized_reversed", F.element_at("coords", 1).alias("start"), F.element_at("coords", -1).alias("end"),
        geo.path_length(F.col("coords")).alias("length_m"), "oneway", posted_speed(F.col("fields")).alias("speed_limit"), "name", F.col("fields")["collid"].alias("collid"), "dir_code",
        text.starts_yes(F.col("fields")["collected"]).alias("collected"), text.starts_yes(F.col("fields")["scheduled"]).alias("scheduled"), "fields",
    )


def display_name(collid, feature_name, number, route):
    """Collection id, else feature name, else ``Section n``; the route's name before it."""
    own = F.coalesce(F.nullif(collid, F.lit("")), F.nullif(feature_name, F.lit("")), F.concat(F.lit("Section "), number.cast("string")))
    return F.concat_ws(" ", F.nullif(route, F.lit("")), own)


def to_survey(sections: DataFrame, honour_scheduled: bool = False) -> DataFrame:
    """Sections that are left: not collected and, for day plans, not scheduled."""
    left = sections.where(~F.col("collected"))
    return left.where(~F.col("scheduled")) if honour_scheduled else left


def totals(sections: DataFrame) -> DataFrame:
    return sections.agg(F.count("*").alias("sections"), F.round(F.sum("length_m") / 1000, 3).alias("km"), F.count_if("collected").alias("collected"), F.count_if("scheduled").alias("scheduled"))


def fill_speeds(sections: DataFrame, matched: DataFrame) -> DataFrame:
    """Take (section_id, speed_kmh) for sections without a speed."""
    joined = sections.join(matched.withColumnRenamed("speed_kmh", "_speed"), "section_id", "left")
    return joined.withColumn("speed_limit", F.coalesce(text.known_speed(F.col("speed_limit")), "_speed")).select(*sections.columns)
