"""What the training-data operators share: the shared folder, input columns, Arrow passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The session's ``spark.checkpoint.dir`` names the folder. Where it is unset, a folder of
    this machine is set for the session if the master is local, as in tests; on a cluster
    that is an error, as executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/attestra-{uuid.uuid4().hex}"


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder (``options``: of the writer) and read it back, so its lineage is files."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a table made by ``materialize`` that nothing reads any more, so that a large one makes room before the end."""
    sc = table.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if folder.rpartition("/")[2].startswith("attestra-"):
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty); other columns and their names play no part."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Texts can be long, so functions get Arrow batches of this many rows.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Spark then removes a statement's shuffle files when it ends; what is needed again is a table in the shared folder.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Settings of a session for queries over texts; they save memory and disk, and change no result.

    Spark makes batches of ``BATCH_ROWS`` too, unless the session asks for fewer.
    """
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    spark.conf.set(CLEANUP_SETTING, "true")


def map_arrow(df: DataFrame, schema: str | T.StructType, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow`` with a schema (DDL or a type) and batches of ``rows`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.slice(at, rows) for batch in batches for at in range(0, max(1, batch.num_rows), rows))

    return df.mapInArrow(run, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


@dataclass(frozen=True)
class SharedDict:
    """A dictionary for tasks, sent as Arrow bytes: a worker holds the objects of the last one only."""

    token: str
    data: Broadcast

    @staticmethod
    def of(spark: SparkSession, keys: pa.Array, values: pa.Array) -> SharedDict:
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([keys, values], names=["key", "value"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return SharedDict(uuid.uuid4().hex, spark.sparkContext.broadcast(sink.getvalue().to_pybytes()))

    @property
    def value(self) -> dict:
        return _loaded(self)


@lru_cache(maxsize=1)
def _loaded(shared: SharedDict) -> dict:
    keys, values = pa.ipc.open_stream(shared.data.value).read_all().columns
    return dict(zip(keys.to_pylist(), values.to_pylist()))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
