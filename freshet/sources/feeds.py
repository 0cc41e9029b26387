"""Readers and sinks of the feeds: CSV series, JSON lines, GeoJSON, run registry, partitioned products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_series(spark: SparkSession, path: str, schema: str, time: str) -> DataFrame:
    """A CSV series with a header; ``time`` is read with its offset, rows without one get null and stay to be counted."""
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    dated = F.when(F.col(time).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.col(time)))
    return raw.withColumn(time, dated)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines log, and the lines that can't be parsed."""
    raw = spark.read.text(path).withColumn("_row", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_row").isNull() | F.col("_row._corrupt_record").isNotNull()
    return raw.where(~bad).select("_row.*").drop("_corrupt_record"), raw.where(bad).select("value")


def geojson_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features as rows: lon, lat and the properties; features of other geometry are left out."""
    schema = f"features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<{properties}>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    points = f.where("f.geometry.type = 'Point' and size(f.geometry.coordinates) >= 2")
    return points.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


def runs(registry: DataFrame, city: str | None = None, most: int = 50) -> DataFrame:
    """Newest runs first: by cycle, then by when they were made."""
    rows = registry if city is None else registry.where(F.col("city") == city)
    return rows.orderBy(F.desc("cycle"), F.desc("created")).limit(most)


def run_at(registry: DataFrame, instants: DataFrame, at: str, width: int = 86_400_000_000) -> DataFrame:
    """Each instant's newest run with a cycle at or before it, the oldest run if there is none.

    Instants meet the runs of their own stretch of ``width`` (a day); the last
    run of the stretches before, one row for each, is carried over to it.
    """
    from freshet.operators.temporal import asof

    slot = F.floor(F.col("cycle") / width).alias("_slot")
    left = instants.select(F.col(at).alias("cycle")).distinct().select("cycle", slot)
    right = registry.select("cycle", "run_id", slot)
    got = asof(left, right, ["_slot"], "cycle", "run_id", "run_id", tie=["run_id"])
    last = right.groupBy("_slot").agg(F.max_by("run_id", F.struct("cycle", "run_id")).alias("_last"))
    slots = left.select("_slot").distinct().join(last, "_slot", "full_outer")
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    carried = slots.select("_slot", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    oldest = registry.agg(F.min_by("run_id", F.struct("cycle", "run_id")).alias("_oldest"))
    met = got.join(carried, "_slot").join(F.broadcast(oldest))  # one row
    return met.select(F.col("cycle").alias(at), F.coalesce("run_id", "_carried", "_oldest").alias("run_id"))


def write_product(df: DataFrame, path: str, by: str) -> None:
    """A product partitioned by run; a run that is written again replaces its own partition only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def wet_json(df: DataFrame, key: str, step: str, depth: str, p: str, wet: float = 5.0) -> DataFrame:
    """One JSON document per key that reaches ``wet``: its steps with depth to one decimal and probability to two."""
    entry = F.struct(F.col(step).alias("step"), F.round(depth, 1).alias("depth_cm"), F.round(p, 2).alias("p"))
    g = df.groupBy(key).agg(F.max(depth).alias("_peak"), F.array_sort(F.collect_list(entry)).alias("steps")).where(F.col("_peak") >= wet)
    return g.select(key, F.to_json("steps").alias("series"))
