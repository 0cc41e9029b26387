"""Data-quality findings about a feed: one row per finding, worst level first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINDING = ("rule", "level", "subject", "n")


def gaps(df: DataFrame, keys: Sequence[str], time: str, cadence: int, level: str = "warning") -> DataFrame:
    """Places where the next row comes later than the cadence."""
    w = Window.partitionBy(*keys).orderBy(time)
    late = df.select(*keys, time).distinct().withColumn("_gap", F.col(time) - F.lag(time).over(w)).where(F.col("_gap") > cadence)
    return late.groupBy(*keys).agg(F.count("*").alias("n")).select(F.lit("cadence").alias("rule"), F.lit(level).alias("level"), F.concat_ws("|", *keys).alias("subject"), "n")


def out_of_range(df: DataFrame, column: str, lo: float, hi: float, level: str = "error") -> DataFrame:
    return _one(df.where(~F.col(column).between(lo, hi)), "range", level, column)


def missing(df: DataFrame, column: str, level: str = "error") -> DataFrame:
    return _one(df.where(F.col(column).isNull()), "missing", level, column)


def repeated(df: DataFrame, keys: Sequence[str], level: str = "error") -> DataFrame:
    return _one(df.groupBy(*keys).count().where("count > 1"), "repeated", level, ",".join(keys))


def absent_columns(df: DataFrame, wanted: Sequence[str], level: str = "error") -> DataFrame:
    lost = [c for c in wanted if c not in df.columns]
    rows = [("columns", level, c, 1) for c in lost]
    return df.sparkSession.createDataFrame(rows, "rule string, level string, subject string, n long")


def members(have: DataFrame, name: str, wanted: Sequence[str], level: str = "error") -> DataFrame:
    """A finding for each wanted member that is not there."""
    want = have.sparkSession.createDataFrame([(w,) for w in wanted], "subject string")
    lost = want.join(have.select(F.col(name).alias("subject")).distinct(), "subject", "left_anti")
    return lost.select(F.lit("members").alias("rule"), F.lit(level).alias("level"), "subject", F.lit(1).cast("long").alias("n"))


def not_monotone(df: DataFrame, keys: Sequence[str], order: str, time: str, level: str = "error") -> DataFrame:
    """Rows whose time is before that of the row ahead in the feed's own order."""
    back = df.select(*keys, (F.col(time) < F.lag(time).over(Window.partitionBy(*keys).orderBy(order))).alias("_back")).where("_back")
    return back.groupBy(*keys).agg(F.count("*").alias("n")).select(F.lit("monotone").alias("rule"), F.lit(level).alias("level"), F.concat_ws("|", *keys).alias("subject"), "n")


def outside_window(df: DataFrame, time: str, lo: int, hi: int, level: str = "error") -> DataFrame:
    return _one(df.where(~F.col(time).between(lo, hi)), "window", level, time)


def disagreeing(a: DataFrame, b: DataFrame, columns: Sequence[str], level: str = "error") -> DataFrame:
    """Grids whose ranges differ: a finding for each column whose least or largest value is not the same in both."""
    ends = lambda d: d.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("ends")) for c in columns])).alias("_e")).select("_e.*")
    met = ends(a).join(ends(b).withColumnRenamed("ends", "_other"), "subject").where(~F.col("ends").eqNullSafe(F.col("_other")))
    return met.select(F.lit("grid").alias("rule"), F.lit(level).alias("level"), "subject", F.lit(1).cast("long").alias("n"))


def unflagged(df: DataFrame, flag: str, level: str = "error") -> DataFrame:
    """Rows that don't say whether they are measured or made."""
    return _one(df.where(F.col(flag).isNull()), "flagged", level, flag)


def uncited(df: DataFrame, source: str, rule: str = "cited", level: str = "warning") -> DataFrame:
    """Rows without a source, or with a blank one."""
    return _one(df.where(F.col(source).isNull() | (F.trim(F.col(source)) == "")), rule, level, source)


def other_units(df: DataFrame, unit: str, allowed: Sequence[str], level: str = "error") -> DataFrame:
    return _one(df.where(F.col(unit).isNull() | ~F.col(unit).isin(*allowed)), "units", level, unit)


def too_few(df: DataFrame, subject: str, least: int, rule: str = "count", level: str = "warning") -> DataFrame:
    """A finding if fewer than ``least`` rows are there; n is how many are missing."""
    lost = df.agg((F.lit(least) - F.count("*")).cast("long").alias("n")).where("n > 0")
    return lost.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.lit(subject).alias("subject"), "n")


def _one(bad: DataFrame, rule: str, level: str, subject: str) -> DataFrame:
    return bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.lit(subject).alias("subject"), "n")


def findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def fingerprint(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A digest per key that doesn't depend on the order of rows: the SHA-256 of the sorted row digests."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)
    return df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("fingerprint"))
