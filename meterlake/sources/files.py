"""Which files of a folder are read, and a census of what lies in them."""

from __future__ import annotations

import gzip
import io
import os
import stat
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.tables import stored
from meterlake.sources.text import LINE_BYTES

#: Names left out in the scan itself, where there are no more of them.
NAMED = 10_000
CHUNK = 1 << 20


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def with_archives(spark: SparkSession, folders: list[str]) -> list[str]:
    """The folders, each ``sessions`` with the ``archived_sessions`` beside it, if there is one."""
    every = list(folders)
    for folder in folders:
        system, path = _hadoop(spark, folder)
        beside = system.makeQualified(path).getParent()
        if path.getName() == "sessions" and beside is not None:
            archive = spark._jvm.org.apache.hadoop.fs.Path(beside, "archived_sessions")
            if system.exists(archive):
                every.append(archive.toString())
    return list(dict.fromkeys(every))


def listed(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """path, size and inner (the path below its root) of the files; contents are not read.

    Spark leaves files without a byte out."""
    every = None
    for root in roots:
        system, path = _hadoop(spark, root)
        depth = len([p for p in system.makeQualified(path).toUri().getPath().split("/") if p])
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        parts = F.split(F.regexp_replace(F.col("_metadata.file_path"), "^[a-zA-Z0-9+.-]+:(//[^/]*)?/*", ""), "/")
        one = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.array_join(F.slice(parts, depth + 1, F.size(parts)), "/").alias("inner"))
        every = one if every is None else every.union(one)
    return every.dropDuplicates(["path"])


def second_copies(files: DataFrame) -> DataFrame:
    """Paths of :func:`listed` files that another copy of the same inner path stands for.

    A plain file goes before a packed one, then the larger, then the lesser path.
    """
    files = files.withColumn("plain", F.regexp_replace("inner", r"\.zst$", ""))
    order = F.struct(F.col("inner").endswith(".zst").cast("int").alias("packed"), (-F.col("size")).alias("size"), F.col("path").alias("path"))
    best = files.groupBy("plain").agg(F.min(order).alias("best"), F.count("*").alias("copies")).where("copies > 1")
    return files.join(best, "plain").where(F.col("path") != F.col("best.path")).select("path")


def without(lines: DataFrame, paths: DataFrame, named: int = NAMED) -> DataFrame:
    """The lines of all other files. Up to ``named`` paths become a condition on the file's
    name, by which Spark does not open these files; beyond, the lines are joined."""
    paths = stored(paths)
    few = [r.path for r in paths.limit(named + 1).collect()]
    if not few:
        return lines
    return lines.where(~F.col("path").isin(few)) if len(few) <= named else lines.join(paths, "path", "left_anti")


def _opened(path: str) -> io.BufferedIOBase:
    """A regular file, unpacked by its extension; a pipe would block, a device never end."""
    told = urlparse(path)
    if told.scheme not in ("", "file"):
        raise ValueError(f"a census needs mounted files, not {told.scheme}")
    raw = os.fdopen(os.open(unquote(told.path), os.O_RDONLY | os.O_NONBLOCK), "rb")
    if not stat.S_ISREG(os.fstat(raw.fileno()).st_mode):
        raw.close()
        raise OSError("not a regular file")
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return gzip.open(raw) if path.endswith(".gz") else raw


def _count(path: str, most: int) -> tuple[int, int, int, str | None]:
    """Lines, blank ones, overlong ones and what ended the reading; holds one chunk."""
    lines = blank = overlong = 0
    length, ink = 0, False  # of the line that the last chunk left open
    try:
        with _opened(path) as file:
            while chunk := file.read(CHUNK):
                data = np.frombuffer(chunk, np.uint8)
                ends = np.flatnonzero(data == 10)
                # white space that a trimmed line consists of: blanks, and the return before a line's end
                marks = np.concatenate([[0], np.cumsum((data != 32) & (data != 13) & (data != 10))])
                begins = np.concatenate([[0], ends + 1])
                stops = np.concatenate([ends, [len(data)]])
                sizes, inked = stops - begins, marks[stops] > marks[begins]
                sizes[0] += length
                inked[0] |= ink
                inked |= sizes > most
                length, ink = int(sizes[-1]), bool(inked[-1])
                lines += len(ends)
                overlong += int((sizes[:-1] > most).sum())
                blank += int((~inked[:-1]).sum())
        problem = None
    except ValueError:
        raise
    except Exception as e:  # a decoder's errors have no common class
        problem = str(e) or type(e).__name__
    if length:
        lines, overlong, blank = lines + 1, overlong + (length > most), blank + (not ink)
    return lines, blank, overlong, problem


def census(files: DataFrame, most: int = LINE_BYTES) -> DataFrame:
    """path, lines, blank, overlong and problem of each file, read in chunks of a megabyte.

    The line source passes over lines that are longer than ``most`` bytes without a word; this
    tells how many there are, and which files can't be read to their end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x]) if k is None else pa.array([x], k) for x, k in zip((path, *_count(path, most)), (None, pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "lines", "blank", "overlong", "problem"])

    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.select("path").repartition(parts, "path").mapInArrow(run, "path string, lines long, blank long, overlong long, problem string")
