"""Alerts: episodes above a level, hysteresis across cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.temporal import longest_island

LEVELS = (("severe", 45.0), ("moderate", 30.0), ("watch", 15.0))


def episodes(df: DataFrame, keys: Sequence[str], step: str, depth: str, levels: Sequence[tuple[str, float]] = LEVELS, least: int = 2) -> DataFrame:
    """Per key and level the longest run of steps strictly above it, with its peak, open-ended if it lasts to the key's end."""
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("severity"), F.lit(n).alias("level"), F.lit(t).alias("threshold")) for i, (n, t) in enumerate(levels)]))
    rows = df.withColumn("_l", level).select(*df.columns, "_l.*").withColumn("_over", F.col(depth) > F.col("threshold"))
    group = [*keys, "severity", "level", "threshold"]
    runs = longest_island(rows, group, step, "_over", least)
    last = df.groupBy(*keys).agg(F.max(step).alias("_end"))
    met = rows.join(runs, group).where(F.col(step).between(F.col("first_step"), F.col("last_step")))
    peaks = met.groupBy(*group, "first_step", "last_step", "length").agg(F.max(depth).alias("peak"))
    return peaks.join(last, list(keys)).withColumn("open_ended", F.col("last_step") == F.col("_end")).drop("_end")


def queue(alerts: DataFrame, key: str, most: int = 60) -> DataFrame:
    """What the desk sees: worst level first, then peak, then key; capped."""
    return alerts.orderBy("severity", F.desc("peak"), key).limit(most)


def hysteresis(df: DataFrame, keys: Sequence[str], cycle: str, p: str, gap: int | None = None, raise_at: float = 0.6, clear_at: float = 0.3) -> DataFrame:
    """State of each key after each of its cycles: none, pending or raised; ``event`` says what changed.

    A second cycle in a row at ``raise_at`` or more raises; a cycle at
    ``clear_at`` or less, or without p, clears; between them only what is raised
    stays.  A step of more than ``gap`` between cycles starts anew.  Cycles that
    clear and steps over the gap begin a stretch, and within a stretch the first
    second cycle in a row tells all, so windows are enough: no key's rows are
    gathered.
    """
    w, value = Window.partitionBy(*keys).orderBy(cycle, p), F.col(p).cast("double")
    rows = df.select(*keys, F.col(cycle).cast("long").alias(cycle), value.alias(p))
    high = F.coalesce(value >= raise_at, F.lit(False))
    stale = F.lit(False) if gap is None else F.coalesce(F.col(cycle) - F.lag(cycle).over(w) > gap, F.lit(False))
    rows = rows.withColumns({"_high": high, "_low": ~high & F.coalesce(value <= clear_at, F.lit(True)), "_stale": stale})
    rows = rows.withColumn("_stretch", F.sum((F.col("_low") | F.col("_stale")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "_stretch").orderBy(cycle, p)
    rows = rows.withColumns({"_n": F.row_number().over(within), "_again": F.col("_high") & F.lag("_high", 1, False).over(within)})
    rows = rows.withColumn("_since", F.min(F.when(F.col("_again"), F.col("_n"))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.col("_since").isNotNull(), "raised").when(F.col("_high"), "pending").otherwise("none")
    rows = rows.withColumns({"state": state, "cycles": F.coalesce(F.col("_n") - F.col("_since") + 2, F.col("_high").cast("int"))})
    cleared = F.col("_low") & ~F.col("_stale") & (F.lag("state").over(w) == "raised")
    event = F.when(F.col("_n") == F.col("_since"), "raised").when(cleared, "cleared")
    return rows.select(*keys, cycle, "state", "cycles", event.alias("event"))
