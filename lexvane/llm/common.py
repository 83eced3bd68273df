"""What the corpus operators share: the shared folder, stored tables and small expressions."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.files import filesystem

_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and Spark runs locally."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="lexvane-")
    return _OWN_ROOTS[app]


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored_at(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """``stored`` and the path written to, for ``discard``."""
    path = workspace(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    return stored_at(df, name, partition_by)[0]


def discard(*paths: str) -> None:
    """Remove stored tables that nothing will read again."""
    for path in paths:
        fs, at = filesystem(path)
        fs.delete_dir(at)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches. After the last one, memory that was freed goes back to the system: Spark keeps the worker for later tasks."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(name: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def between(items: Column, gone: Column) -> Column:
    """The items at no position of ``gone``, which is sorted: all stretches between two of them."""

    def stretch(i: Column) -> Column:
        start = F.coalesce(F.get(gone, i - 1) + 1, F.lit(0))
        end = F.coalesce(F.get(gone, i), F.size(items))
        return F.slice(items, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), stretch))
