"""The tables that the registered queries read, in the roles that the operators need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.scalar import micros, slot


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        REGISTRY[f.__name__] = Query(f, oracle)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their instant in microseconds (us) and hour since 1970."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return e.withColumn("us", micros("ts")).withColumn("hour", slot(F.col("us"), 3600)).drop("ts")


#: The same as a common table expression.
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour FROM events)"


def r(c, digits: int = 8):  # noqa: ANN001, ANN201
    return F.round(c, digits)
