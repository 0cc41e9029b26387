"""Forecast verification: contingency tables, scores, reliability, skill horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, keys: Sequence[str], forecast: str, observed: str, cube: bool = False) -> DataFrame:
    """Hits, misses, false alarms and correct negatives; with ``cube`` for every subset of the keys."""
    f, o = F.col(forecast), F.col(observed)
    counts = [F.count_if(f & o).alias("hits"), F.count_if(~f & o).alias("misses"), F.count_if(f & ~o).alias("false_alarms"), F.count_if(~f & ~o).alias("correct_negatives")]
    return (df.cube(*keys) if cube else df.groupBy(*keys)).agg(*counts)


def scores(table: DataFrame) -> DataFrame:
    """CSI, POD and FAR of a contingency table; null where the denominator is 0."""
    h, m, fa = (F.col(c) for c in ("hits", "misses", "false_alarms"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return table.withColumns({"csi": ratio(h, h + m + fa), "pod": ratio(h, h + m), "far": ratio(fa, h + fa)})


def brier(df: DataFrame, keys: Sequence[str], p: str, observed: str) -> DataFrame:
    """Brier score, and skill against climatology; null where the reference is not above 0."""
    o = F.col(observed).cast("double")
    out = df.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - o, 2)).alias("brier"), F.avg(o).alias("base_rate"))
    reference = F.col("base_rate") * (1 - F.col("base_rate"))
    return out.withColumn("skill", F.when(reference > 0, 1 - F.col("brier") / reference))


def reliability(df: DataFrame, keys: Sequence[str], p: str, observed: str, bins: int = 10) -> DataFrame:
    """Count, mean forecast and observed share per bin of equal width; a value on an edge goes up, 1 into the last."""
    q = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    binned = df.withColumn("bin", F.least(F.floor(q * bins), F.lit(bins - 1)).cast("int"))
    return binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(q).alias("mean_p"), F.avg(F.col(observed).cast("double")).alias("observed_share"))


def murphy(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reliability, resolution and uncertainty from the table of bins."""
    total = Window.partitionBy(*keys)
    base = F.sum(F.col("n") * F.col("observed_share")).over(total) / F.sum("n").over(total)
    rows = bins.withColumn("_base", base)
    weighed = lambda e: F.sum(F.col("n") * F.pow(e, 2)) / F.sum("n")
    return rows.groupBy(*keys).agg(
        weighed(F.col("mean_p") - F.col("observed_share")).alias("reliability"),
        weighed(F.col("observed_share") - F.col("_base")).alias("resolution"),
        F.first(F.col("_base") * (1 - F.col("_base"))).alias("uncertainty"),
    )


def skill_horizon(df: DataFrame, keys: Sequence[str], lead: str, csi: str, held: str, floor: float = 0.5) -> DataFrame:
    """How far a forecast is ahead of a held frame, walking the leads up.

    The first lead without a score ends the walk undetermined, the first whose
    score is below the held frame's or ``floor`` ends it found; the horizon is
    the lead before, 0 if there is none; a walk that never ends is beyond the
    scored range.
    """
    stop = F.when(F.col(csi).isNull() | F.col(held).isNull(), "undetermined").when((F.col(csi) < F.col(held)) | (F.col(csi) < floor), "found")
    rows = df.withColumn("_stop", stop)
    end = rows.groupBy(*keys).agg(F.min_by(F.struct(F.col(lead).alias("lead"), F.col("_stop").alias("why")), F.when(F.col("_stop").isNotNull(), F.col(lead))).alias("_e"), F.min(F.when(F.col("_stop").isNotNull(), F.col(lead))).alias("_at"))
    ok = rows.join(end, list(keys)).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_at").isNull() | (F.col(lead) < F.col("_at")), F.col(lead))), F.lit(0)).cast("long").alias("horizon"),
        F.first(F.when(F.col("_at").isNull(), "beyond_scored_range").otherwise(F.col("_e.why"))).alias("status"),
    )
    return ok
