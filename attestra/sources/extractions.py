"""Code-graph extractions as a data source: ``spark.read.format("attestra_extraction").load(path)``.

``path`` is a folder of extractions, or one of them. Option ``table`` is nodes (default)
or links. A folder is a partition; equality filters on ``folder`` reach the partitions,
where ``spark.sql.python.filterPushdown.enabled`` is on. Folders are read by Arrow's file systems.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from attestra.sources.files import EXTRACTION_FILES

NAME = "attestra_extraction"
SCHEMAS = {
    "nodes": "folder string, id string, label string, type string, file_type string, source_file string, source_location string, version string",
    "links": "folder string, source string, target string, relation string, confidence string, source_location string",
}


def file_system(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Folder(InputPartition):
    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files = folder, files


def load_extraction(path: str, files: list[str]) -> dict:
    """The first of a folder's extraction files that has nodes; none is an error."""
    system, inside = file_system(path)
    for name in EXTRACTION_FILES:
        if name in files:
            with system.open_input_stream(posixpath.join(inside, name)) as stream:
                data = json.loads(stream.read())
            if isinstance(data, dict) and "nodes" in data:
                return data
    raise ValueError(f"no usable extraction in {path}")


class ExtractionReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table, self.only = path.rstrip("/"), table, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("folder",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inside = file_system(self.path)
        found: dict[str, list[str]] = {}
        for entry in system.get_file_info(fs.FileSelector(inside, recursive=True)):
            if entry.is_file and entry.base_name in EXTRACTION_FILES:
                found.setdefault(posixpath.dirname(posixpath.relpath(entry.path, inside)) or ".", []).append(entry.base_name)
        if not found:
            raise ValueError(f"no extraction below {self.path}")
        return [Folder(folder, files) for folder, files in sorted(found.items()) if self.only is None or folder in self.only]

    def read(self, partition: Folder) -> Iterator[tuple]:
        path = self.path if partition.folder == "." else f"{self.path}/{partition.folder}"
        data = load_extraction(path, partition.files)
        rows = data["nodes"] if self.table == "nodes" else data.get("edges", data.get("links", []))
        names = [x.split()[0] for x in SCHEMAS[self.table].split(", ")[1:]]
        for row in rows or ():
            yield (partition.folder, *(None if row.get(n) is None else str(row[n]) for n in names))


class ExtractionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "nodes")
        if table not in SCHEMAS:
            raise ValueError(f"table is one of {sorted(SCHEMAS)}, not {table!r}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema: StructType) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return ExtractionReader(self.options["path"], self._table())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ExtractionSource)
