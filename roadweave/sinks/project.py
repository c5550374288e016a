"""Map projects: the features of each file as DataFrames, one task that writes them into an SQLite database in a zip."""

from __future__ import annotations

import io
import sqlite3
import uuid
import zipfile
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEET_PER_M
from ..functions import geo, text
from ..functions.shapes import encode
from ..plans.visits import labelled, section_ref

#: Names and value types (1 text, 11 integer, 13 decimal) of the declared properties (fixed values).
PROPERTIES = (
    ("CollId", 11), ("RouteName", 1), ("Dir", 1), ("Collected", 1), ("LengthFt", 13), ("Region", 11), ("Juris", 1), ("CntyCode", 1), ("StRtNo", 1),
    ("SegNo", 1), ("BegM", 13), ("EndM", 13), ("IsPilot", 1), ("RouteOrder", 11), ("NextCollId", 1), ("Scheduled", 1), ("ScheduledDay", 11),
)

#: Tables of a project's database by name: column names and SQL types (a fixed format).
SCHEMA = {
    "t_sequence": "id INTEGER PRIMARY KEY, sequence INTEGER",
    "t_item": "id INTEGER PRIMARY KEY, guid TEXT, parent_id INTEGER, order_idx INTEGER, shortcut_id INTEGER, type INTEGER, name TEXT, short_name TEXT, description TEXT, feature_class_id INTEGER, icon_id INTEGER DEFAULT 0, icon_color INTEGER, image_id INTEGER, show_on_map INTEGER DEFAULT 1, display_mode INTEGER, indicator_index INTEGER, remind_distance INTEGER, subtype INTEGER, style TEXT, insert_date Double, update_date Double, access_date Double",
    "t_place": "item_id INTEGER PRIMARY KEY, type INTEGER, latitude Double, longitude Double, coord_type INTEGER, altitude Double, time Double, icon_scale Double DEFAULT 1.0, icon_rotate Double DEFAULT 0.0, label_color INTEGER, label_scale Double DEFAULT 1.0",
    "t_shape": "item_id INTEGER PRIMARY KEY, coordinates BLOB, coord_dimension INTEGER, coord_type INTEGER, line_color INTEGER, line_width Double, fill_color INTEGER, zorder INTEGER",
    "t_property": "id INTEGER PRIMARY KEY, feature_class_id INTEGER, order_idx INTEGER, name TEXT, type INTEGER, value_type INTEGER, options TEXT, insert_date Double, update_date Double",
    "t_property_lkp": "item_id INTEGER, property_id INTEGER, value BLOB, PRIMARY KEY (item_id, property_id)",
    "t_feature_style_lkp": "item_id INTEGER, style INTEGER, value TEXT, PRIMARY KEY (item_id, style)",
    "t_tiled_map": "item_id INTEGER PRIMARY KEY, zorder INTEGER, type INTEGER, version TEXT, min_zoom INTEGER, max_zoom INTEGER, url TEXT, invert_y INTEGER, server_parts TEXT, script TEXT, background_color INTEGER, x_offset INTEGER, y_offset INTEGER, scale Float, alpha Float, rotation Float, valid_duration INTEGER, tile_type TEXT, tile_conversion INTEGER, coordinate_type INTEGER, zoom_delta INTEGER, bounding BLOB",
    "t_tiled_map_download_info": "item_id INTEGER PRIMARY KEY, zooms TEXT, shape_type INTEGER, shape_data BLOB, shape_coord_type INTEGER, status INTEGER",
    "t_image": "id INTEGER PRIMARY KEY, mp_id TEXT, type INTEGER, width INTEGER, height INTEGER, color INTEGER, scale Float, file_type TEXT, key TEXT, hotspot_x Float, hotspot_y Float, hotspot_xunits INTEGER, hotspot_yunits INTEGER, markup BLOB, reference_id INTEGER, sha1 TEXT, insert_date Double, update_date Double",
    "t_file": "id INTEGER PRIMARY KEY, mp_id TEXT, type INTEGER, name TEXT, extension TEXT, sha1 TEXT, insert_date Double, update_date Double",
    "t_text_overlay": "item_id INTEGER PRIMARY KEY, box_type INTEGER, ctype INTEGER, text_bounding BLOB, text_rotation Double DEFAULT 0.0, text_scale Double DEFAULT 1.0, text_color INTEGER, halo_color INTEGER, fill_color INTEGER, line_color INTEGER, line_width Double, target_lat Double, target_lng Double",
    "t_recent": "content TEXT, type INTEGER, update_date Double",
    "t_tag": "id INTEGER PRIMARY KEY, tag TEXT, order_idx INTEGER, insert_date Double, update_date Double",
    "t_tag_lkp": "item_id INTEGER, tag_id INTEGER, order_idx INTEGER, PRIMARY KEY (item_id, tag_id)",
    "t_link": "id INTEGER PRIMARY KEY, type INTEGER, from_item_id INTEGER, to_item_id INTEGER",
    "t_version": "version TEXT, previous TEXT, update_date Double",
    "t_metadata": "name TEXT PRIMARY KEY, value TEXT, update_date Double",
}
#: Line colour, width and fill of surveyed pieces and of transfers (fixed values of the format's packed colours).
SEGMENT_LINE, TRANSFER_LINE = (1677753087, 3.0, 838892287), (1684300900, 2.0, 845440100)
#: Ids of the feature class and of the built-in route name, rule and collection properties, and item types (fixed values).
FEATURE_CLASS, ROUTE_NAME, RULE, SETTINGS = 10_001, 2, 600, {700: 0, 701: 25, 702: 0}
CLASS_TYPE, RULE_TYPE, COLLECTION_TYPE, LINE_TYPE = 2001, 2002, 70, 3
#: Style of the class: colour, width, label and flags by style number (fixed values).
CLASS_STYLE = {211: "1694433535", 213: "6", 220: "1", 221: "[CollId]", 234: "1"}
#: Display rules: name, condition, style (fixed values).
RULES = (
    ("Direction I", '[Dir]=="I"', {211: "1694433280"}),
    ("Pilot", '[IsPilot].beginswith("Y")', {211: "1677721855"}),
    ("Pilot Direction I", '[Dir]=="I"&&[IsPilot].beginswith("Y")', {211: "1694498560"}),
    ("Deadhead", '[RouteName]=="Deadhead"', {210: "2", 211: "1684300900", 212: "0.5"}),
    ("Scheduled", '[Scheduled].beginswith("Y")', {210: "2", 211: "1679834990", 212: "0.5", 234: "0"}),
    ("Collected", '[Collected].beginswith("Y")', {210: "2", 211: "1677721600", 212: "0.2972973", 220: "0", 234: "0"}),
)
#: Values that a property offers (fixed).
CHOICES = {"Collected": "Yes|No|", "Scheduled": "Yes|No|"}
#: Version of the format, the archive's second entry and its text (fixed values).
VERSION, METADATA = "2.8.14", ".com.miocool.mapplus.metadata/metadata.xml"
METADATA_TEXT = f"""<?xml version="1.0" encoding="UTF-8"?>
<MetaData>
  <Version>1.0</Version>
  <DatabaseVersion>{VERSION}</DatabaseVersion>
  <Description></Description>
  <RootItemType>70</RootItemType>
</MetaData>
"""
#: Route name of generated transfers; signs before the names of transfers, collected and locked pieces; notes (fixed values).
TRANSFER, TO, DONE, LOCKED = "Deadhead", "→ ", "✓ ", "◷ "
WITH_ARROWS, AGAINST_ARROWS = " | BLUE: drive WITH the arrows", " | PINK: drive AGAINST the arrows"
DONE_NOTE, UNROUTED_NOTE, LOCKED_NOTE = "Already collected", "Already collected — not part of the route", "Locked into an earlier day's route"


def state_of(sections: DataFrame, days: DataFrame) -> DataFrame:
    """Sections with the state to write: collected before scheduled before the planned day of ``days`` (section_id, day)."""
    joined = sections.join(days.select("section_id", "day"), "section_id", "left")
    state = F.when(F.col("collected"), "collected").when(F.col("scheduled"), "scheduled").when(F.col("day").isNotNull(), F.concat(F.lit("day "), F.col("day").cast("string"))).otherwise("open")
    return joined.withColumn("state", state)


def carried(fields: Column, without: Iterable[str] = ()) -> Column:
    """Original values by declared name, less some, as a map."""
    left_out = {n.lower() for n in without}
    pairs = [F.struct(F.lit(name).alias("key"), fields[name.lower()].alias("value")) for name, _ in PROPERTIES if name.lower() not in left_out]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))


def with_values(base: Column, **values: Column) -> Column:
    """``base`` with values set; a name in it gives way to the value."""
    names = list(values)
    kept = F.map_filter(base, lambda k, _: ~k.isin(*names))
    return F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]))


def _or(fields: Column, name: str, otherwise: Column) -> Column:
    """A field's value, or one to write where it is absent."""
    return F.coalesce(fields[name.lower()], otherwise)


FEATURE = ("part", "at", "step", "name", "note", "line", "transfer", "values")


def _feature(rows: DataFrame, part: int, at, step: int, name: Column, note: Column, line: Column, values: Column, transfer: bool = False) -> DataFrame:
    """Rows of a project's features: part, at and step order them."""
    return rows.select(F.lit(part).alias("part"), at.cast("long").alias("at"), F.lit(step).alias("step"), name.alias("name"), note.alias("note"), line.alias("line"), F.lit(transfer).alias("transfer"), values.alias("values"))


def route_features(visited: DataFrame, sections: DataFrame, transfers: DataFrame | None = None, collected: DataFrame | None = None, back: DataFrame | None = None) -> DataFrame:
    """Features of one day's route file in drawing order.

    ``visited`` are the day's visits; ``transfers`` (leg_no, path) the ways to legs, ``back`` (path) the way home,
    ``collected`` sections that ride along. A transfer stands before the first section of its leg if it has two points;
    sections keep their digitised geometry and original fields, Dir says how they are driven.
    """
    visits = labelled(visited).join(sections.select("section_id", "digitized_coords", "fields", "name", "collid", "dir_code"), "section_id")
    own, order = section_ref(F.col("collid"), F.col("name")), F.col("order").cast("string")
    with_dir = F.when(F.col("dir_out") == "D", AGAINST_ARROWS).otherwise(WITH_ARROWS)
    original = F.when(~F.col("dir_code").isin("", "I", "D") & (F.col("dir_code") != F.col("dir_out")), F.concat(F.lit(" | original Dir: "), F.col("dir_code"))).otherwise("")
    following = F.coalesce(F.concat(F.lit(" | next: CollId "), F.col("next_segment")), F.lit(""))
    note = F.concat(F.lit("Run "), order, F.lit(" of "), F.col("visits").cast("string"), F.lit(" | "), text.fixed(F.col("length_m") / 1000, 2), F.lit(" km | ETA +"), text.fixed(F.col("eta_s") / 3600, 1), F.lit(" h"), with_dir, original, following)
    fields = F.col("fields")
    values = with_values(carried(fields, ("RouteOrder", "NextCollId", "Dir")), Dir=F.col("dir_out"), CollId=_or(fields, "CollId", own), Collected=_or(fields, "Collected", F.lit("No")), RouteOrder=order, NextCollId=F.col("next_segment"))
    out = _feature(visits, 0, F.col("order"), 1, F.concat(F.col("rank"), F.lit(" · "), own), note, F.col("digitized_coords"), values)
    if transfers is not None:
        moved = visits.where("dh_m > 0").join(transfers, "leg_no").where("size(path) >= 2")
        note = F.concat(F.lit("Transfer "), text.fixed(F.col("dh_m") / 1000, 2), F.lit(" km (~"), text.fixed(F.col("dh_s") / 60, 0), F.lit(" min) to segment "), F.col("rank"), F.lit(" (CollId "), own, F.lit(")"))
        values = F.create_map(*[x for k, v in {"RouteName": F.lit(TRANSFER), "LengthFt": text.fixed(F.col("dh_m") * FEET_PER_M, 1), "RouteOrder": order, "NextCollId": own}.items() for x in (F.lit(k), v)])
        out = out.unionByName(_feature(moved, 0, F.col("order"), 0, F.concat(F.lit(TO), F.col("rank")), note, F.col("path"), values, True))
    if back is not None:
        home = back.where("size(path) >= 2").withColumn("meters", geo.path_length(F.col("path")))
        values = F.create_map(F.lit("RouteName"), F.lit(TRANSFER), F.lit("LengthFt"), text.fixed(F.col("meters") * FEET_PER_M, 1))
        out = out.unionByName(_feature(home, 1, F.lit(0), 0, F.lit(TO + "Return"), F.concat(F.lit("Return to start: "), text.fixed(F.col("meters") / 1000, 2), F.lit(" km")), F.col("path"), values, True))
    if collected is not None:
        values = with_values(carried(fields, ("RouteOrder", "NextCollId", "Collected")), Collected=F.lit("Yes"), CollId=_or(fields, "CollId", own))
        out = out.unionByName(_feature(collected, 2, F.col("section_id"), 0, F.concat(F.lit(DONE), own), F.lit(UNROUTED_NOTE), F.col("digitized_coords"), values))
    return out


def state_features(sections: DataFrame, days: DataFrame) -> DataFrame:
    """Features of a file with every section's state; only a section that is scheduled already says so, a planned one has its day."""
    rows = state_of(sections, days)
    own, state, fields = section_ref(F.col("collid"), F.col("name")), F.col("state"), F.col("fields")
    day = F.when(state.startswith("day "), F.col("day").cast("string"))
    values = with_values(carried(fields, ("RouteOrder", "NextCollId", "Scheduled", "ScheduledDay")), CollId=_or(fields, "CollId", own), Collected=_or(fields, "Collected", F.when(F.col("collected"), "Yes").otherwise("No")), Scheduled=F.when(state == "scheduled", "Yes"), ScheduledDay=day)
    name = F.when(state == "collected", F.concat(F.lit(DONE), own)).when(state == "scheduled", F.concat(F.lit(LOCKED), own)).when(day.isNotNull(), F.concat(F.lit("Day "), day, F.lit(" · "), own)).otherwise(own)
    note = F.when(state == "collected", DONE_NOTE).when(state == "scheduled", LOCKED_NOTE).when(day.isNotNull(), F.concat(F.lit("Planned for day "), day))
    present = F.map_filter(values, lambda k, v: v.isNotNull())
    return _feature(rows, 0, F.col("section_id"), 0, name, note, F.col("digitized_coords"), present)


class Project:
    """A project's database under construction; ``stamp`` is the time of all rows, ``base`` tells the ids of one file from another's."""

    def __init__(self, title: str, stamp: float = 0.0, note: str | None = None, base: str | None = None):
        self.stamp, self.base = stamp, base or uuid.uuid4().hex[:10].upper()
        self.database = sqlite3.connect(":memory:")
        for table, columns in SCHEMA.items():
            self.database.execute(f"create table {table} ({columns})")
        day = datetime.fromtimestamp(stamp, UTC)
        self._item(FEATURE_CLASS, 1, 1, CLASS_TYPE, title, description=f"{day:%b} {day.day}, {day.year}", icon_id=0, subtype=2)
        self._styles(FEATURE_CLASS, CLASS_STYLE)
        self.property = {name: 10_001 + i for i, (name, _) in enumerate(PROPERTIES)}
        for i, (name, kind) in enumerate(PROPERTIES, 1):
            self.database.execute("insert into t_property values (?, ?, ?, ?, 2, ?, ?, ?, ?)", (self.property[name], FEATURE_CLASS, i, name, kind, CHOICES.get(name), stamp, stamp))
        self._values(FEATURE_CLASS, dict.fromkeys([ROUTE_NAME, *self.property.values()]))
        for i, (name, rule, style) in enumerate(RULES, 1):
            self._item(FEATURE_CLASS + i, FEATURE_CLASS, i, RULE_TYPE, name)
            self._values(FEATURE_CLASS + i, {RULE: rule.encode()})
            self._styles(FEATURE_CLASS + i, style)
        self.collection = self.last = FEATURE_CLASS + len(RULES) + 1
        self._item(self.collection, 1, 2, COLLECTION_TYPE, title, description=note, feature_class_id=FEATURE_CLASS, show_on_map=1, display_mode=0, subtype=2)
        self._values(self.collection, {k: v.to_bytes(4, "little") for k, v in SETTINGS.items()})
        self.database.execute("insert into t_version values (?, null, ?)", (VERSION, stamp))
        self.database.execute("insert into t_metadata values ('version', ?, ?)", (VERSION, stamp))

    def _item(self, item: int, parent: int, order: int, kind: int, name: str, **more):
        row = {"id": item, "guid": f"RP{self.base}L{item - FEATURE_CLASS + 1}", "parent_id": parent, "order_idx": order, "type": kind, "name": name, "remind_distance": 0, "insert_date": self.stamp, "update_date": self.stamp} | more
        self.database.execute(f"insert into t_item ({', '.join(row)}) values ({', '.join('?' * len(row))})", tuple(row.values()))

    def _values(self, item: int, values: dict[int, bytes | None]):
        self.database.executemany("insert into t_property_lkp values (?, ?, ?)", [(item, k, v) for k, v in values.items()])

    def _styles(self, item: int, style: dict[int, str]):
        self.database.executemany("insert into t_feature_style_lkp values (?, ?, ?)", [(item, k, v) for k, v in style.items()])

    def add_line(self, name: str, line, values: dict[str, str | None], note: str | None = None, transfer: bool = False) -> int:
        """A feature in drawing order; the route name of what isn't a transfer is also written under its built-in id."""
        self.last += 1
        self._item(self.last, self.collection, self.last - self.collection, LINE_TYPE, name, description=note, feature_class_id=FEATURE_CLASS, display_mode=1)
        self.database.execute("insert into t_shape values (?, ?, 1, 0, ?, ?, ?, 0)", (self.last, encode(line), *(TRANSFER_LINE if transfer else SEGMENT_LINE)))
        text = {k: None if v is None else str(v).encode() for k, v in values.items()}
        self._values(self.last, ({} if transfer else {ROUTE_NAME: text.get("RouteName")}) | {self.property[k]: v for k, v in text.items()})
        return self.last

    def content(self) -> bytes:
        """The zip file."""
        last_property = FEATURE_CLASS + len(PROPERTIES)
        self.database.executemany("insert into t_sequence values (?, ?)", [(1, self.last + 1), (2, FEATURE_CLASS), (3, last_property), (4, FEATURE_CLASS), (5, FEATURE_CLASS), (6, FEATURE_CLASS)])
        self.database.commit()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("data.sdb", self.database.serialize())
            archive.writestr(METADATA, METADATA_TEXT)
        return out.getvalue()


def project_file(features: DataFrame, title: str, note: str, stamp: float = 0.0) -> bytes:
    """The file of ``route_features`` or ``state_features``. Rows stream to the driver in order, since the result is one file."""
    project = Project(title, stamp, note)
    for r in features.orderBy("part", "at", "step").toLocalIterator():
        project.add_line(r["name"], [(p["lat"], p["lon"]) for p in r["line"]], r["values"], r["note"], r["transfer"])
    return project.content()


def route_note(visits: int, totals: dict, collected: int = 0) -> str:
    """Description of a route file; ``totals`` has survey_m, deadhead_m, survey_s and deadhead_s."""
    hours = (totals["survey_s"] + totals["deadhead_s"]) / 3600
    note = f"{visits} segments in driving order | {totals['survey_m'] / 1000:.1f} km survey + {totals['deadhead_m'] / 1000:.1f} km deadhead | est. {hours:.1f} h"
    return note + (f" | {collected} already collected" if collected else "")


def state_note(sections: int, planned: int, locked: int, collected: int) -> str:
    """Description of a state file."""
    parts = ((planned, "in the current multi-day plan"), (locked, "locked into earlier days"), (collected, "collected"))
    return " | ".join([f"{sections} segments", *(f"{n} {what}" for n, what in parts if n)])
