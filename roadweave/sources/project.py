"""Map projects (zip files with an SQLite database data.sdb) as tables and as sections."""

from __future__ import annotations

import io
import sqlite3
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.shapes import decode_shape
from ..operators.ranking import ranked
from ..operators.sections import build_sections, display_name

LINE_TYPE = 3
#: Queries of a project's tables by tag, in the columns of ROWS.
TABLES = {
    "item": "select id, null, type, name, null from t_item",
    "shape": "select item_id, null, null, null, coordinates from t_shape",
    "property": "select null, id, null, name, null from t_property",
    "value": "select item_id, property_id, null, null, value from t_property_lkp",
}
ROWS = "file string, tag string, item_id long, property_id long, type int, name string, content binary"
#: Up to so many properties (17 a file, under 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_PROPERTIES = 200_000


def open_database(content: bytes) -> sqlite3.Connection:
    """The database inside a project, opened in memory."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        name = next((n for n in archive.namelist() if n.endswith("data.sdb")), None)
        if name is None:
            raise ValueError("the project holds no data.sdb")
        connection = sqlite3.connect(":memory:")
        connection.deserialize(archive.read(name))
    return connection


def project_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, shapes, properties, property values) of rows (file, content): every file is opened once, its tables are stored together."""
    names = [f.split()[0] for f in ROWS.split(", ")]

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                connection = open_database(bytes(content))
                for tag, query in TABLES.items():
                    cursor = connection.execute(query)
                    while rows := cursor.fetchmany(10_000):
                        rows = [(file, tag, *r[:-1], r[-1].encode() if isinstance(r[-1], str) else r[-1]) for r in rows]
                        yield pd.DataFrame(rows, columns=names).astype({"item_id": "Int64", "property_id": "Int64", "type": "Int32"})
                connection.close()

    rows = checkpointed(files.select("file", "content").mapInPandas(run, ROWS))
    part = lambda tag: rows.where(F.col("tag") == tag)
    return (
        part("item").select("file", "item_id", "name", "type"), part("shape").select("file", "item_id", F.col("content").alias("coordinates")),
        part("property").select("file", "property_id", "name"), part("value").select("file", "item_id", "property_id", F.col("content").alias("value")),
    )


def pivot_fields(values: DataFrame, properties: DataFrame) -> DataFrame:
    """(file, item_id, fields): readable, non-blank values by lower-case property name; the larger property id of equal names counts."""
    text = F.btrim(F.try_validate_utf8(F.col("value").cast("string")))
    few = properties.count() <= BROADCAST_PROPERTIES
    named = values.join(F.broadcast(properties) if few else properties, ["file", "property_id"]).withColumn("text", text).where("text is not null and text <> ''")
    one = named.groupBy("file", "item_id", F.lower("name").alias("key")).agg(F.max_by("text", "property_id").alias("text"))
    return one.groupBy("file", "item_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "text")))).alias("fields"))


def sections_of_tables(items: DataFrame, shapes: DataFrame, properties: DataFrame, values: DataFrame) -> DataFrame:
    """Sections of line items in id order; generated transfers (route name exactly ``Deadhead``) are left out."""
    fields = pivot_fields(values, properties)
    lines = items.where(F.col("type") == LINE_TYPE).join(shapes, ["file", "item_id"]).join(fields, ["file", "item_id"], "left")
    lines = lines.withColumns({"fields": F.coalesce("fields", F.create_map().cast("map<string,string>")), "coords": decode_shape("coordinates")})
    lines = lines.where("coords is not null and coalesce(fields['routename'], '') <> 'Deadhead'")
    own = ranked(lines, "section_id", "file", "item_id")
    name = display_name(F.col("fields")["collid"], F.col("name"), F.col("section_id") + 1, F.col("fields")["routename"])
    return build_sections(own.select("section_id", "coords", "fields", name.alias("name")))


def parse_projects(files: DataFrame) -> DataFrame:
    return sections_of_tables(*project_tables(files))


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """Sections of the projects at ``path``; an input without any is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    sections = parse_projects(files)
    if sections.limit(1).count() == 0:
        raise ValueError(f"no line features in {path}")
    return sections


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending: .mpz and .zip are projects, all else KML."""
    from .kml import read_kml

    return (read_project if path.lower().endswith((".mpz", ".zip")) else read_kml)(spark, path)
