"""A Spark data source over SQLite stores: small stores share a partition; all are opened read-only.

Options: ``table``; columns come from the schema given to the reader, followed by ``store``,
``pos`` (the row's place in the table) and ``problem``. ``time_column`` with ``since`` is pushed
into the store. Stores are opened without trusting their schema; views, virtual tables and
generated columns are refused, and a store that takes longer than ``seconds`` or returns more
than ``most_bytes`` ends early. Whatever is lost that way is told: the rows read
so far are followed by one row that has nothing but the store and the problem, which
:func:`losses` counts. A store without the table is complete and tells nothing.
"""

from __future__ import annotations

import os
import sqlite3
import time
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Limits of a store.
SECONDS, VALUE_BYTES, STORE_BYTES = 30, 64 << 20, 1 << 30
OWN = ("store", "pos", "problem")
KINDS = {"bigint": (pa.int64(), (int,)), "double": (pa.float64(), (int, float)), "binary": (pa.binary(), (bytes,)), "string": (pa.string(), (str,))}
BATCH = 2000
# Stores and bytes of files that make a partition; a larger store has one of its own.
PART_STORES, PART_BYTES = 128, 32 << 20


class Stores(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _size(path: str) -> int:
    try:
        return os.path.getsize(path)
    except OSError:  # told when it is read
        return 0


class Refused(Exception):
    """Why a store's table is not read."""


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = [f.name for f in schema.fields if f.name not in OWN]
        self.kinds = [KINDS[f.dataType.simpleString()] for f in schema.fields if f.name not in OWN]
        self.options = options

    def partitions(self) -> list[Stores]:
        parts, room = [], 0
        for path in self.options["paths"].split("\n"):
            if not path:
                continue
            size = _size(path)
            if not parts or len(parts[-1].paths) == PART_STORES or size > room:
                parts.append(Stores([]))
                room = PART_BYTES
            parts[-1].paths.append(path)
            room -= size
        return parts

    def read(self, partition: Stores | None) -> Iterator[pa.RecordBatch]:
        for path in partition.paths if partition else ():  # none: Spark's one partition where there are no stores
            yield from self._store(path)

    def _store(self, path: str) -> Iterator[pa.RecordBatch]:
        rows, first = [], 0
        problem = None
        try:
            for row in self._rows(path):
                rows.append(row)
                if len(rows) == BATCH:
                    yield self._batch(rows, path, first, None)
                    rows, first = [], first + BATCH
        except (sqlite3.Error, Refused, OSError) as e:
            problem = str(e) or type(e).__name__
        if rows:
            yield self._batch(rows, path, first, None)
        if problem:
            yield self._batch([(None,) * len(self.columns)], path, first + len(rows), problem)

    def _batch(self, rows: list[tuple], path: str, first: int, problem: str | None) -> pa.RecordBatch:
        """Values of another type than the column's are null."""
        columns = [pa.array([x if isinstance(x, kinds) else None for x in column], kind) for (kind, kinds), column in zip(self.kinds, zip(*rows, strict=True), strict=True)]
        own = [pa.array([path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array([problem] * len(rows), pa.string())]
        return pa.record_batch([*columns, *own], [*self.columns, *OWN])

    def _rows(self, path: str) -> Iterator[tuple]:
        table = self.options["table"]
        end = time.monotonic() + float(self.options.get("seconds", SECONDS))
        left = int(self.options.get("most_bytes", STORE_BYTES))
        if not os.path.isfile(path):
            raise Refused("not a file")
        if not os.path.getsize(path):  # new, and its writer may hold no lock yet
            return
        db = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
        try:
            db.execute("PRAGMA trusted_schema = OFF")
            db.execute("PRAGMA query_only = ON")
            db.setlimit(sqlite3.SQLITE_LIMIT_LENGTH, VALUE_BYTES)
            db.set_progress_handler(lambda: int(time.monotonic() > end), 10_000)
            kind = db.execute("SELECT type, sql FROM sqlite_master WHERE name = ?", (table,)).fetchone()
            if kind is None:
                return
            if kind[0] != "table" or "VIRTUAL" in (kind[1] or "").upper().split("(")[0]:
                raise Refused("no plain table")
            there = {r[1]: r[6] for r in db.execute(f'PRAGMA table_xinfo("{table}")')}
            if any(there.get(c) for c in self.columns):
                raise Refused("a generated column")
            picked = ", ".join(f'"{c}"' if c in there else f'NULL AS "{c}"' for c in self.columns)
            where, values = "", ()
            if "since" in self.options and self.options.get("time_column") in there:
                where, values = f' WHERE "{self.options["time_column"]}" >= ?', (int(self.options["since"]),)
            for row in db.execute(f'SELECT {picked} FROM "{table}"{where}', values):
                left -= sum(len(x) if isinstance(x, str | bytes) else 8 for x in row)
                if left < 0:
                    raise Refused("more bytes than a store may return")
                if time.monotonic() > end:
                    raise Refused("more time than a store may take")
                yield row
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "guarded_sqlite"

    def schema(self) -> str:
        return "store string, pos long, problem string"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_store(spark: SparkSession, paths: list[str], table: str, schema: str, **options: str) -> DataFrame:
    """Rows of a table of each store, with ``store``, ``pos`` and ``problem`` as last columns."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("guarded_sqlite").schema(f"{schema}, store string, pos long, problem string").option("paths", "\n".join(paths)).option("table", table)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def place(pos: Column) -> Column:
    """A row's place in the form that lines of files have."""
    return F.struct(F.lit(0).cast("long").alias("block"), pos.cast("long").alias("n"))


def losses(rows: DataFrame) -> DataFrame:
    """Stores of :func:`read_store` that were not read to their end, and why."""
    return rows.where("problem is not null").select("store", "problem")


def read_table(spark: SparkSession, paths: list[str], table: str, schema: str, **options: str) -> DataFrame:
    """The rows alone, with ``store`` as the last column; use :func:`read_store` where losses matter."""
    return read_store(spark, paths, table, schema, **options).where("problem is null").drop("pos", "problem")


LEDGER = "id string, session_id string, turn_index long, agent_id string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, total_nano_aiu long, initiator string, created_at string"


def ledger_calls(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The calls of a session store with the folder of their session."""
    calls = read_table(spark, paths, "assistant_usage_events", LEDGER)
    sessions = read_table(spark, paths, "sessions", "id string, cwd string").select(F.col("id").alias("session_id"), "cwd", "store")
    at = F.coalesce(F.try_to_timestamp("created_at"), F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd HH:mm:ss")))
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    out = calls.join(sessions, ["store", "session_id"], "left").withColumn("at", at)
    fresh = F.greatest(zero("input_tokens") - zero("cache_read_tokens") - zero("cache_write_tokens"), F.lit(0))
    return out.select(
        "store", "session_id", "at", "model", "cwd", fresh.alias("input"), zero("output_tokens").alias("output"), zero("cache_read_tokens").alias("cache_read"),
        zero("cache_write_tokens").alias("cache_creation"), zero("reasoning_tokens").alias("reasoning"), F.concat(F.lit("copilot-call:"), "id").alias("dedupe_key"),
    )


def messages(spark: SparkSession, paths: list[str], since_ms: int | None = None) -> DataFrame:
    """Usage of the messages of a message store; a message counts once over all stores."""
    options = {"since": str(since_ms), "time_column": "time_created"} if since_ms is not None else {}
    rows = read_table(spark, paths, "message", "id string, session_id string, time_created long, data string", **options)
    v = F.try_parse_json("data")
    field = lambda p: F.greatest(F.coalesce(F.try_variant_get("v", p, "bigint"), F.lit(0)), F.lit(0))
    rows = rows.withColumn("v", v).where("v is not null")
    out = rows.select(
        "store", "id", "session_id", F.timestamp_millis("time_created").alias("at"), F.try_variant_get("v", "$.modelID", "string").alias("model"), F.try_variant_get("v", "$.role", "string").alias("role"),
        field("$.tokens.input").alias("input"), (field("$.tokens.output") + field("$.tokens.reasoning")).alias("output"), field("$.tokens.reasoning").alias("reasoning"),
        field("$.tokens.cache.read").alias("cache_read"), field("$.tokens.cache.write").alias("cache_creation"),
        (F.try_variant_get("v", "$.time.completed", "bigint") - F.try_variant_get("v", "$.time.created", "bigint")).alias("duration_ms"),
    )
    one = out.groupBy("id").agg(F.min_by(F.struct(*out.columns), "store").alias("x")).select("x.*")
    return one.withColumn("volume", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation"))
