"""Calibration: log-linear fits, bias, gauge errors, scale to a target, clusters of one column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.temporal import numbered
from freshet.sources.storage import materialised


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def power_law(df: DataFrame, keys: Sequence[str], x: str, y: str, slope: tuple[float, float], scale: tuple[float, float], default: tuple[float, float], least: int = 8, span: float = 0.301) -> DataFrame:
    """a and b of y = log10(a) + b x by least squares, b clamped and the intercept solved again at the clamped b.

    Falls back to ``default`` below ``least`` pairs or where x spans less than ``span``.
    """
    q = df.groupBy(*keys).agg(
        F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.regr_slope(y, x).alias("_s"), F.regr_avgx(y, x).alias("_mx"), F.regr_avgy(y, x).alias("_my"),
        (F.max(F.when(F.col(y).isNotNull(), F.col(x))) - F.min(F.when(F.col(y).isNotNull(), F.col(x)))).alias("_span"), F.regr_r2(y, x).alias("r2"),
    )
    good = (F.col("n") >= least) & (F.col("_span") >= span) & F.col("_s").isNotNull()
    b = clamp(F.col("_s"), *slope)
    a = clamp(F.pow(F.lit(10.0), F.col("_my") - b * F.col("_mx")), *scale)
    return q.select(*keys, "n", F.when(good, a).otherwise(default[0]).alias("a"), F.when(good, b).otherwise(default[1]).alias("b"), F.when(good, F.col("r2")).alias("r2"), good.alias("fitted"))


def mean_field_bias(df: DataFrame, keys: Sequence[str], truth: str, estimate: str, lo: float = 0.2, hi: float = 5.0) -> DataFrame:
    """Sum of truth over sum of estimate over complete pairs, clamped; 1 without pairs or where the estimate sums to 0 or less."""
    pair = F.col(truth).isNotNull() & F.col(estimate).isNotNull()
    g, r = F.sum(F.when(pair, F.col(truth))), F.sum(F.when(pair, F.col(estimate)))
    return df.groupBy(*keys).agg(F.when(r > 0, clamp(g / r, lo, hi)).otherwise(1.0).alias("bias"), F.count_if(pair).alias("pairs"))


def gauge_error(df: DataFrame, keys: Sequence[str], truth: str, estimate: str) -> DataFrame:
    """Largest error in percent of the truth."""
    e = F.abs(F.col(estimate) - F.col(truth)) / F.nullif(F.col(truth), F.lit(0.0)) * 100
    return df.groupBy(*keys).agg(F.max(e).alias("max_error_pct"), F.count(e).alias("pairs"))


def scale_to(df: DataFrame, keys: Sequence[str], cells: str, background: str, target: float) -> DataFrame:
    """The factor on the cells' part that brings the sum to the target; null where it can't be reached."""
    c, b = F.sum(cells), F.sum(background)
    return df.groupBy(*keys).agg(F.when((c > 0) & (b <= target), (F.lit(target) - b) / c).alias("scale"))


def rmse_and_csi(df: DataFrame, keys: Sequence[str], truth: str, estimate: str, threshold: float) -> DataFrame:
    """Root mean square error, and CSI of exceeding the threshold, on a hold-out."""
    t, e = F.col(truth) > threshold, F.col(estimate) > threshold
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col(truth) - F.col(estimate), 2))).alias("rmse"),
        F.try_divide(F.count_if(t & e).cast("double"), F.count_if(t | e).cast("double")).alias("csi"),
    )


def quantiles(values: DataFrame, column: str, at: Sequence[float]) -> list[float]:
    """Interpolated quantiles of a whole column, exact: rows are numbered by ranges, and only those beside a quantile reach the driver."""
    tied = materialised(values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), F.monotonically_increasing_id().alias("tie")))
    n = tied.count()
    if not n:
        return []
    places = [(n - 1) * q for q in at]
    wanted = sorted({int(p) + k for p in places for k in (1, 2)} & set(range(1, n + 1)))
    value = {x.n: x.v for x in numbered(tied, [], ["v", "tie"]).where(F.col("n").isin(wanted)).select("n", "v").collect()}
    return [value[int(p) + 1] + (p - int(p)) * (value[min(int(p) + 2, n)] - value[int(p) + 1]) for p in places]


def clusters(df: DataFrame, column: str, k: int, most: int = 100, within: float = 0.01) -> DataFrame:
    """(cluster, centre) of ``k`` centres on a line: from the quantiles, moved to the means of what is nearest until none moves by ``within``.

    Nulls take no part; a centre that nothing is nearest to stays, of equally
    near ones the lowest takes a value; without values there are no rows.  The
    column is written once; only the centres are on the driver.
    """
    v = materialised(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")))
    centres = quantiles(v, "v", [(i + 0.5) / k for i in range(k)])
    for _ in range(most if centres else 0):
        nearest = F.array_min(F.array(*[F.struct(F.abs(F.col("v") - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]
        means = {x.i: x.m for x in v.groupBy(nearest.alias("i")).agg(F.avg("v").alias("m")).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if max(abs(a - b) for a, b in zip(moved, centres, strict=True)) < within:
            break
        centres = moved
    return df.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(centres)], "cluster int, centre double")
