"""KML 2.2 line features as sections."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import LINE
from ..functions.text import BARE_AMPERSAND, NOT_XML, parse_speed_limit
from ..operators.ranking import ranked
from ..operators.sections import build_sections, display_name

NS = "{http://www.opengis.net/kml/2.2}"
RAW = f"file string, n int, coords {LINE}, fields map<string, string>, feature_name string, description string"


def parse_tree(data: bytes) -> ET.Element:
    """The document's root; a broken one is read again without control characters and bare ampersands."""
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        text = re.sub(NOT_XML, "", data.decode("utf-8", "ignore"))
        return ET.fromstring(re.sub(BARE_AMPERSAND, "&amp;", text).encode())


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse_line(text: str) -> list[tuple[float, float]]:
    """Points of ``lon,lat[,alt]`` tokens, to six decimals, without repeats; unreadable tokens are left out."""
    out: list[tuple[float, float]] = []
    for token in text.split():
        parts = [_number(x) for x in token.split(",")[:2]]
        if len(parts) == 2 and None not in parts:
            p = (round(parts[1], 6), round(parts[0], 6))
            if not out or out[-1] != p:
                out.append(p)
    return out


def features(data: bytes) -> list[dict]:
    """Placemarks with a line (the first one counts) of two points or more."""
    found = []
    for mark in parse_tree(data).iter(f"{NS}Placemark"):
        line = mark.find(f".//{NS}LineString")
        at = line.find(f"{NS}coordinates") if line is not None else None
        coords = parse_line(at.text or "") if at is not None else []
        if len(coords) < 2:
            continue
        pairs = [(d.get("name"), d.findtext(f"{NS}value")) for d in mark.iter(f"{NS}Data")] + [(d.get("name"), d.text) for d in mark.iter(f"{NS}SimpleData")]
        fields = {k.lower(): v.strip() for k, v in pairs if k and v and v.strip()}
        found.append({"coords": [{"lat": a, "lon": b} for a, b in coords], "fields": fields, "feature_name": (mark.findtext(f"{NS}name") or "").strip(), "description": (mark.findtext(f"{NS}description") or "").strip()})
    return found


def parse_kml(files: DataFrame) -> DataFrame:
    """Raw features of rows (file, content): one task reads a file, files in parallel; n counts a file's features from 1."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                rows = [{"file": file, "n": n, **f} for n, f in enumerate(features(bytes(content)), 1)]
                yield pd.DataFrame(rows, columns=["file", "n", "coords", "fields", "feature_name", "description"])

    return files.select("file", "content").mapInPandas(run, RAW)


def sections_of(raw: DataFrame) -> DataFrame:
    """Sections of raw features; a speed in the description counts where no field has one."""
    own = ranked(raw, "section_id", "file", "n")
    name = display_name(F.col("fields")["collid"], F.col("feature_name"), F.col("section_id") + 1, F.col("fields")["routename"])
    built = build_sections(own.select("section_id", "coords", "fields", name.alias("name")))
    said = own.select(F.col("section_id").alias("_id"), parse_speed_limit(F.col("description")).alias("_speed")).where("_speed is not null")
    joined = built.join(said, F.col("section_id") == F.col("_id"), "left")
    return joined.withColumn("speed_limit", F.coalesce("speed_limit", F.nullif("_speed", F.lit(0.0)))).select(*built.columns)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Sections of the KML files at ``path``; an input without any is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    sections = sections_of(parse_kml(files))
    if sections.limit(1).count() == 0:
        raise ValueError(f"no line features in {path}")
    return sections
