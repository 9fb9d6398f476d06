"""SQLite stores written from rows, for the queries that decode them."""

from __future__ import annotations

import os
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame


def write_stores(rows: DataFrame, folder: str, shapes: dict[str, str]) -> list[str]:
    """One SQLite file for each ``store`` of ``rows(store, tbl, cells...)``; their paths.

    ``shapes`` has the columns and types of each table. A store is written by one task, to a
    folder that all tasks see as a local path.
    """
    place = folder.removeprefix("file://").removeprefix("file:")

    def write(cells: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(place, exist_ok=True)
        path = f"{place}/{cells['store'].iloc[0]}"
        if os.path.exists(path):  # left by a lost task
            os.remove(path)
        db = sqlite3.connect(path)
        db.executescript("PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF")  # a new file: a lost task writes it again
        for table, shape in shapes.items():
            db.execute(f"CREATE TABLE {table}({shape})")
            columns = [x.split() for x in shape.split(", ")]
            own = cells[cells["tbl"] == table].sort_values("id")
            values = [[None if x is None or x != x else int(x) if kind == "INT" else x for x in own[name].tolist()] for name, kind in columns]
            db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", list(zip(*values, strict=True)))
        db.commit()
        db.close()
        return pd.DataFrame({"path": [path]})

    return sorted(r["path"] for r in rows.groupBy("store").applyInPandas(write, "path string").collect())  # one a store
