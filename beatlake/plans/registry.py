"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.session import with_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("q_beats", "q_events", "q_quality", "q_scoring", "q_summaries", "q_signal", "q_streams", "q_audit", "q_studies")

# Second 0 of the event tables' axis: 2024-01-01.
ORIGIN_US = 1_704_067_200_000_000
#: The events in SQL, as `events_table` gives them.
E = f"e AS (SELECT user_id, event_type, event_id, (epoch_us(ts) - {ORIGIN_US}) / 1e6 AS t, value FROM events)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, event_id, t (seconds), value."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ORIGIN_US)) / 1e6
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", t.alias("t"), "value")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"beatlake.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["detection_study"](spark, sf_dir)


def queries() -> dict[str, Query]:
    load()
    return {k: with_package(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
