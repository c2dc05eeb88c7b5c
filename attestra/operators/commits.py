"""Tables of Parquet folders whose versions are committed one by one.

A table's folder holds data, which is never changed, and a log of numbered commit files.
A commit names all folders of its version, by part (a project, say; a table without parts
has one). It is written aside and then renamed to its number; a rename never replaces a
file, so of two writers that began at one version one fails, and a reader sees a whole
version or the one before. To replace or drop parts is a commit that names other folders:
files of other parts are neither read nor written.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators.store import upsert

WHOLE = ""
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._=%-]*")


class CommitConflict(RuntimeError):
    """Another writer has committed since this one read the table."""


def safe_name(name: str) -> str:
    """``name`` if it is one plain part of a path, which can't leave its folder."""
    if not NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"not a plain name: {name!r}")
    return name


@dataclass(frozen=True)
class Version:
    """A commit's number (0: before the first), the folders of each part, and the table's schema as JSON."""

    number: int
    parts: dict[str, list[str]]
    schema: str | None


@dataclass(frozen=True)
class Table:
    """A table below ``root``; ``key`` is the column whose values are its parts, if it has parts."""

    spark: SparkSession
    root: str
    key: str | None = None

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *map(safe_name, names)]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[str]:
        path, files = self._path(*folder), self._files()
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def version(self) -> Version:
        """The last version committed."""
        number = max((int(n) for n in self._names("commits") if n.isdigit()), default=0)
        if not number:
            return Version(0, {}, None)
        held = json.loads(self.spark.read.text(self._path("commits", f"{number:020d}").toString(), wholetext=True).first()[0])
        return Version(number, held["parts"], held["schema"])

    def commit(self, base: Version, parts: dict[str, list[str]], schema: str | None) -> Version:
        """The version after ``base``, if no other writer has made it."""
        jvm, files = self.spark._jvm, self._files()
        aside, target = self._path("staged", uuid.uuid4().hex), self._path("commits", f"{base.number + 1:020d}")
        files.mkdirs(self._path("commits"))
        out = files.create(aside, False)
        out.write(bytearray(json.dumps({"parts": parts, "schema": schema}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {base.number + 1} of {self.root} is another writer's") from error
            raise
        return Version(base.number + 1, parts, schema)

    def write(self, df: DataFrame) -> dict[str, list[str]]:
        """Data folders of ``df`` by part, which no version names yet."""
        folder = uuid.uuid4().hex
        path = self._path("data", folder).toString()
        if self.key is None:
            df.write.parquet(path)
            return {WHOLE: [f"data/{folder}"]}
        if df.filter(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"rows without {self.key} are in no part")
        tagged = df.withColumn("_part", F.hex(F.encode(F.col(self.key).cast("string"), "UTF-8")))
        tagged.hint("rebalance", "_part").write.partitionBy("_part").parquet(path)  # splits large parts, and keeps small ones in few files
        found = [n for n in self._names("data", folder) if n.startswith("_part=")]
        return {bytes.fromhex(n.removeprefix("_part=")).decode(): [f"data/{folder}/{n}"] for n in found}

    def overwrite(self, df: DataFrame, base: Version | None = None, only: bool = False) -> Version:
        """A version in which ``df`` replaces the parts that it has rows of; with ``only``, or without parts, all."""
        base = base or self.version()
        schema = _schema_of(df)
        new = self.write(df)
        return self.commit(base, new if only or self.key is None else base.parts | new, schema)

    def delete(self, parts: list[str], base: Version | None = None) -> Version:
        """A version without these parts."""
        base = base or self.version()
        return self.commit(base, {p: f for p, f in base.parts.items() if p not in parts}, base.schema)

    def upsert(self, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> Version:
        """A version in which ``new`` replaces rows of the same keys; only parts that it has rows of are read and written."""
        base = self.version()
        touched = [r[0] for r in new.select(F.col(self.key).cast("string")).distinct().collect()] if self.key else [WHOLE]
        old = self.read(touched, base) if base.schema else new.limit(0)
        return self.overwrite(upsert(old.select(*new.columns), new, keys, order), base)

    def read(self, parts: list[str] | None = None, version: Version | None = None) -> DataFrame:
        """The rows of a version (the last), or of some parts of it."""
        version = version or self.version()
        if version.schema is None:
            raise FileNotFoundError(f"nothing is committed in {self.root}")
        folders = [f for p, own in version.parts.items() if parts is None or p in parts for f in own]
        schema = T.StructType.fromJson(json.loads(version.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*("/".join([self.root.rstrip("/"), f]) for f in folders))

    def collect_garbage(self) -> int:
        """Data folders that the last version doesn't name are removed, and their number returned; no writer or older reader may be at work."""
        named = {f.split("/")[1] for own in self.version().parts.values() for f in own}
        gone = [n for n in self._names("data") if n not in named]
        for n in gone:
            self._files().delete(self._path("data", n), True)
        return len(gone)


def _schema_of(df: DataFrame) -> str:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]).json()


def publish(df: DataFrame, root: str) -> Version:
    """``df`` as the next version of a table without parts."""
    return Table(df.sparkSession, root).overwrite(df)


def read_published(spark: SparkSession, root: str) -> DataFrame:
    return Table(spark, root).read()


def delete_project(tables: dict[str, Table], project: str, children: dict[str, tuple[str, str]] | None = None) -> dict[str, Version]:
    """A project's parts go from all tables, children before parents as they are named.

    Tables of ``children`` (parent table, key) have no project: they lose the rows of the
    project's parents, and are written anew.
    """
    out = {}
    for name, (parent, key) in (children or {}).items():
        gone = tables[parent].read([project]).select(key).distinct()
        base = tables[name].version()
        out[name] = tables[name].overwrite(tables[name].read(version=base).join(gone, key, "left_anti"), base)
    return out | {name: table.delete([project]) for name, table in tables.items() if name not in out}
