"""Reliable lineage cuts in the folder that every executor shares."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


@lru_cache(maxsize=1)
def _trim():
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def release() -> None:
    """Give memory that a batch has freed back to the system: Python workers outlive their tasks, and many share an executor."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only if it is unset on a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder: survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> str:
    """Write as Parquet in the shared folder; the path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and scan it back, so that every branch reads the same rows."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def placed(df: DataFrame, name: str) -> DataFrame:
    """The rows with a column that orders them as a Parquet folder holds them: number of the file, then row; null for anything but a scan."""
    try:
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
        return df.select("*", (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias(name))
    except AnalysisException:
        return df.withColumn(name, F.lit(None).cast("bigint"))


def require(df: DataFrame, *names: str) -> None:
    """Fail early, naming the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened where ``names`` has them (case aside)."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
