"""Tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows, as they lie in memory, that one part of a dealt table is meant to hold.
PART_BYTES = 64 << 20


def local_path(uri: str) -> str:
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri


def filesystem(uri: str):
    """The pyarrow filesystem of a URI and the path inside it."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), local_path(uri)
    return fs.FileSystem.from_uri(uri)


def drop_folder(uri: str) -> None:
    system, path = filesystem(uri)
    system.delete_dir(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size to be, from the sizes of files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame) -> int:
    """How many parts keep each to PART_BYTES, by a pass over df's rows and the lengths of their strings; so a task's memory is the same at every
    size, whatever the session's number of shuffle partitions."""
    flat = (T.NumericType, T.BooleanType, T.DatetimeType)
    loose = [F.coalesce(F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema if not isinstance(f.dataType, flat)]
    size = functools.reduce(lambda a, b: a + b, loose, F.lit(16 * (len(df.columns) + 1)))
    total = df.select(F.sum(size.cast("bigint"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
