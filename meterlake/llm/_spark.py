"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent, a local session gets a temporary folder, one for each
    application; on a cluster that would be another disk for each executor, so it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        folder = _LOCAL.setdefault(application, "") or tempfile.mkdtemp(prefix="spark-work-")
        _LOCAL[application] = folder
    return folder.rstrip("/")


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage, so that a lost executor costs a reread and not a
    recomputation, and gives later joins exact sizes.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


BATCH_ROWS = 2000


def over_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with small batches, and workers that hand back memory after a task.

    Texts are long, so batches of Spark's default 10,000 rows would hold tens of megabytes
    at both ends of the pipe. A session that sets its own batch size keeps it; one that
    does not gets ``BATCH_ROWS``, for its own later Arrow work too.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(size, None) is None:
        df.sparkSession.conf.set(size, str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return df.mapInArrow(lean, schema)
