"""Queries over the driver's tables, with their DuckDB twins. Dates are given as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlake.plans import agy_logs, documents, fork_logs, log_twins, logs, price_logs, reports, store_logs, stream_logs, twins, work_logs


def _dated(report: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = report(spark, sf_dir)
        return out.withColumns({c: out[c].cast("string") for c, kind in out.dtypes if kind == "date"})

    run.__name__, run.__doc__ = report.__name__, report.__doc__
    return run


MORE = (work_logs, store_logs, fork_logs, agy_logs, stream_logs, documents, price_logs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _dated(getattr(reports, name)) for name in twins.BODIES} | {name: _dated(getattr(logs, name)) for name in log_twins.oracle_sql()}
    return found | {name: _dated(getattr(module, name)) for module in MORE for name in module.oracle_sql()}


def oracle_sql() -> dict[str, str]:
    found = {name: f"SELECT * REPLACE (d::varchar AS d) FROM ({text})" if name in twins.DATED else text for name, text in twins.twins().items()} | log_twins.oracle_sql()
    return found | {name: text for module in MORE for name, text in module.oracle_sql().items()}
