"""Aggregates over ensemble members: quantiles, exceedance, levels and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], prefix: str = "p") -> DataFrame:
    """Exact, linearly interpolated percentiles of a group, a column for each."""
    return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(f"{prefix}{round(p * 100)}") for p in probs])


def exceedance(df: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of the members strictly above each threshold; members without a value don't count."""
    share = lambda t: F.avg(F.when(F.col(value) > t, 1.0).when(F.col(value).isNotNull(), 0.0))
    return df.groupBy(*keys).agg(*[share(t).alias(f"p_gt_{t:g}") for t in thresholds])


def recentre(df: DataFrame, keys: Sequence[str], value: str, level: str, out: str = "level_member") -> DataFrame:
    """Members moved so that their mean is the deterministic level, not below 0."""
    mean = F.avg(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.greatest(F.col(level) + (F.col(value) - mean), F.lit(0.0)))


def depth_band(df: DataFrame, group: Sequence[str], member: str, value: str) -> DataFrame:
    """p10, p50, p90 of the members' means over a group's places; null below two members."""
    means = df.groupBy(*group, member).agg(F.avg(value).alias("_mean"))
    q = lambda p: F.when(F.count("*") >= 2, F.percentile("_mean", F.lit(p)))
    return means.groupBy(*group).agg(F.count("*").alias("members"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"))


def spread(df: DataFrame, keys: Sequence[str], value: str, least: int = 3) -> DataFrame:
    """p10 to p90 across cycles; null below ``least`` of them."""
    q = lambda p: F.when(F.count(value) >= least, F.percentile(value, F.lit(p)))
    return df.groupBy(*keys).agg(F.count(value).alias("cycles"), q(0.1).alias("p10"), q(0.9).alias("p90"))


def segment_levels(bridge: DataFrame, cells: DataFrame, segment: str, step: str, cell: str, depth: str, share: float = 0.9) -> DataFrame:
    """A segment's depth in cm: the percentile over its wet and dry cells; a segment without cells stands at 0."""
    joined = bridge.join(cells, cell, "left").groupBy(segment, step).agg(F.percentile(depth, F.lit(share)).alias("_q"))
    return joined.withColumn("depth_cm", F.coalesce(F.col("_q") * 100, F.lit(0.0))).drop("_q")


def minutes_above(df: DataFrame, keys: Sequence[str], value: str, threshold: float, step_minutes: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg((F.count_if(F.col(value) > threshold) * step_minutes).alias("minutes_above"))


def wet_keys(df: DataFrame, keys: Sequence[str], value: str, wet: float = 5.0) -> DataFrame:
    """Rows of the keys whose peak is ``wet`` or more."""
    wet_only = df.groupBy(*keys).agg(F.max(value).alias("_peak")).where(F.col("_peak") >= wet).select(*keys)
    return df.join(wet_only, list(keys), "left_semi")


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean by weight over the rows that have a value; null without any weight."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(w), F.lit(0.0))).alias("weighted_mean"))
