"""Spark data sources of the file formats: ``spark.read.format("roadweave_kml")`` and ``"roadweave_project"`` after ``register(spark)``.

One partition a file, opened through Arrow's file systems (local or shared paths, and the stores that Arrow knows). The
readers in ``kml`` and ``project`` go through Spark's own ``binaryFile`` instead and reach every store that Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import kml, project

#: Columns of a project's tables by name.
PROJECT_TABLES = {
    "items": ("item", "file string, item_id long, name string, type int"),
    "shapes": ("shape", "file string, item_id long, coordinates binary"),
    "properties": ("property", "file string, property_id long, name string"),
    "property_values": ("value", "file string, item_id long, property_id long, value binary"),
}
#: Where those columns stand in the rows of ``project.TABLES``, after the file.
_AT = {"items": (0, 3, 2), "shapes": (0, 4), "properties": (1, 3), "property_values": (0, 1, 4)}


@dataclass
class FilePartition(InputPartition):
    path: str


def _files(path: str) -> list[str]:
    """A file, or the files of a folder that are not hidden, in order."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise ValueError(f"no such file: {path}")
    if found.type == fs.FileType.File:
        return [path]
    inside = system.get_file_info(fs.FileSelector(at))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(inside, key=lambda f: f.base_name) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]


def _content(path: str) -> bytes:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as stream:
        return stream.read()


class _FileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for p in _files(self.path)]


class _KmlReader(_FileReader):
    def read(self, partition: FilePartition) -> Iterator[tuple]:
        for n, f in enumerate(kml.features(_content(partition.path)), 1):
            yield partition.path, n, [(p["lat"], p["lon"]) for p in f["coords"]], f["fields"], f["feature_name"], f["description"]


class KmlSource(DataSource):
    """Raw line features of KML files."""

    @classmethod
    def name(cls) -> str:
        return "roadweave_kml"

    def schema(self) -> str:
        return kml.RAW

    def reader(self, schema) -> DataSourceReader:
        return _KmlReader(self.options["path"])


class _ProjectReader(_FileReader):
    def __init__(self, path: str, table: str):
        super().__init__(path)
        self.table = table

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        connection = project.open_database(_content(partition.path))
        for row in connection.execute(project.TABLES[PROJECT_TABLES[self.table][0]]):
            yield (partition.path, *(row[i].encode() if i == 4 and isinstance(row[i], str) else row[i] for i in _AT[self.table]))
        connection.close()


class ProjectSource(DataSource):
    """One table (option ``table``) of map projects."""

    @classmethod
    def name(cls) -> str:
        return "roadweave_project"

    def _table(self) -> str:
        table = self.options.get("table", "items")
        if table not in PROJECT_TABLES:
            raise ValueError(f"table must be one of {', '.join(PROJECT_TABLES)}")
        return table

    def schema(self) -> str:
        return PROJECT_TABLES[self._table()][1]

    def reader(self, schema) -> DataSourceReader:
        return _ProjectReader(self.options["path"], self._table())


def register(spark: SparkSession) -> None:
    for source in (KmlSource, ProjectSource):
        spark.dataSource.register(source)
