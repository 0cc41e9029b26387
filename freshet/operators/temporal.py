"""Ordered-sequence operators: as-of and nearest joins, islands, trailing statistics, folds.

Times are longs (microseconds, or steps); all joins in time are a union and one
window per key, so nothing is compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.sources.storage import materialised


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, out: str, tie: Sequence[str] = (), within: int | None = None, oldest: bool = False) -> DataFrame:
    """Adds ``out`` and ``out_time``: the latest right value at or before each left row.

    ``tie``: right columns that order rows of one instant, the last wins.
    ``within``: how old a value may be.  ``oldest``: a left row before all right
    rows gets the oldest value.  A right row without value is not seen.
    """
    r = right.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(tie)], F.col(value).alias("v")).alias("_r"))
    order = Window.partitionBy(*keys).orderBy("_t", F.col("_side"), *[f"_r.tie{i}" for i in range(len(tie))])
    l_rows = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = l_rows.unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    last = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("_m", last)
    if oldest:
        first = F.first("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        both = both.withColumn("_m", F.coalesce("_m", first))
    got = both.where("_side = 1")
    if within is not None:
        got = got.withColumn("_m", F.when(F.col("_t") - F.col("_m.t") <= within, F.col("_m")))
    return got.select("_l.*", F.col("_m.v").alias(out), F.col("_m.t").alias(f"{out}_time"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, out: str, tolerance: int) -> DataFrame:
    """Adds ``out``: the right value nearest in time, the earlier on ties, null beyond ``tolerance``."""
    r = right.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_r"))
    l_rows = left.select(*keys, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l"))
    both = l_rows.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_t", "_side", "_r.v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), "_side", F.col("_r.v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_b", F.last("_r", ignorenulls=True).over(before)).withColumn("_a", F.last("_r", ignorenulls=True).over(after)).where("_side = 1")
    db, da = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    pick = F.when(db.isNotNull() & (da.isNull() | (db <= da)), F.col("_b")).otherwise(F.col("_a"))
    got = both.withColumn("_p", pick).withColumn("_p", F.when(F.abs(F.col("_t") - F.col("_p.t")) <= tolerance, F.col("_p")))
    return got.select("_l.*", F.col("_p.v").alias(out), F.col("_p.t").alias(f"{out}_time"))


def held(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, frame: str, within: int) -> DataFrame:
    """Adds ``frame``: the newest one at or before each left row; a row whose newest is older than ``within``, or that has none, is an error."""
    got = asof(left, right, keys, time, frame, "_frame", within=within)
    gap = F.raise_error(F.concat(F.lit("no frame is held at "), F.col(time).cast("string")))
    return got.select(*left.columns, F.when(F.col("_frame").isNull(), gap).otherwise(F.col("_frame")).alias(frame))


def valid_times(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, out: str, tolerance: int = 1_000_000) -> DataFrame:
    """The left rows that have a right value within ``tolerance``, with the nearest (the earlier on ties); none at all is an error."""
    got = nearest_in_time(left, right, keys, time, value, out, tolerance).where(F.col(f"{out}_time").isNotNull()).drop(f"{out}_time")
    if got.isEmpty():
        raise ValueError("the two series share no valid time")
    return got


def previous_record(df: DataFrame, key: str, time: str, name: str, usable: str, within: int) -> DataFrame:
    """Adds ``previous``: the name of the key's latest usable record before each row, no more than ``within`` earlier, the lower name on ties.

    Records of one instant are one row first, so a window runs over a key's instants.
    """
    at = df.groupBy(key, time).agg(F.min(F.when(F.col(usable), F.col(name))).alias("_name"))
    before = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_name").isNotNull(), F.struct(F.col(time).alias("t"), F.col("_name").alias("n"))), ignorenulls=True).over(before)
    at = at.withColumn("_p", last).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.when(F.col(time) - F.col("_p.t") <= within, F.col("_p.n")).alias("previous"))
    return df.join(at, (F.col(key) == F.col("_key")) & (F.col(time) == F.col("_time"))).drop("_key", "_time")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n") -> DataFrame:
    """Adds each row's number in its key, from 1, in the given order (which has to tell rows apart).

    Rows are range-partitioned, numbered in their part, and the counts of the
    parts ahead are added, so that a key of a third of all rows takes many tasks.
    """
    parts = materialised(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_rows")).withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).drop("_rows")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return parts.withColumn("_n", within).join(counts, [*keys, "_part"]).withColumn(out, F.col("_n") + F.col("_ahead")).drop("_n", "_ahead", "_part")


def overlap_join(left: DataFrame, right: DataFrame, slot_size: int, left_bounds: tuple[str, str], right_bounds: tuple[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of intervals [start, end) that overlap, with the overlap: an equi-join on the slots they touch."""
    def slots(df: DataFrame, bounds: tuple[str, str], name: str) -> DataFrame:
        a, b = F.col(bounds[0]), F.col(bounds[1])
        return df.where(b > a).withColumn(name, F.explode(F.sequence(F.floor(a / slot_size), F.floor((b - 1) / slot_size))))

    l_rows, r_rows = slots(left, left_bounds, "_slot"), slots(right, right_bounds, "_rslot")
    for k in keys:
        r_rows = r_rows.withColumnRenamed(k, f"_r_{k}")
    on = F.col("_slot") == F.col("_rslot")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    start, end = F.greatest(left_bounds[0], right_bounds[0]), F.least(left_bounds[1], right_bounds[1])
    met = l_rows.join(r_rows, on).where(end > start).where(F.col("_slot") == F.floor(start / slot_size))  # each pair once
    return met.withColumn("overlap", end - start).drop("_slot", "_rslot", *[f"_r_{k}" for k in keys])


def islands(df: DataFrame, keys: Sequence[str], step: str, flag: str, least: int = 1) -> DataFrame:
    """Runs of consecutive steps where the flag holds: first, last, length; shorter ones than ``least`` are left out."""
    on = df.where(F.col(flag))
    run = F.col(step) - F.row_number().over(Window.partitionBy(*keys).orderBy(step))
    grouped = on.withColumn("_run", run).groupBy(*keys, "_run")
    return grouped.agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("length")).drop("_run").where(F.col("length") >= least)


def longest_island(df: DataFrame, keys: Sequence[str], step: str, flag: str, least: int = 2) -> DataFrame:
    """Each key's longest run, the first on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc("length"), "first_step")
    return islands(df, keys, step, flag, least).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def both_steps(df: DataFrame, keys: Sequence[str], step: str, flag: str, out: str = "held") -> DataFrame:
    """Whether the flag holds here and one row before."""
    frame = Window.partitionBy(*keys).orderBy(step).rowsBetween(-1, 0)
    return df.withColumn(out, (F.min(F.col(flag).cast("int")).over(frame) == 1) & (F.count("*").over(frame) == 2))


def first_over(df: DataFrame, keys: Sequence[str], step: str, value: str, threshold: Column | float) -> DataFrame:
    """First and last step strictly above the threshold, null if never."""
    over = F.when(F.col(value) > threshold, F.col(step))
    return df.groupBy(*keys).agg(F.min(over).alias("first_over"), F.max(over).alias("last_over"))


def peak(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """The largest value and the first step that has it."""
    return df.groupBy(*keys).agg(F.max(value).alias("peak"), F.min_by(step, F.struct(-F.col(value), F.col(step))).alias("peak_step"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's last row in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def anomalies(df: DataFrame, key: str, snapshot: str, value: str, baseline: str, at: int, scored: int = 2, window: int = 12, z_below: float = -2.5) -> DataFrame:
    """Keys whose every row in the last ``scored`` snapshots up to ``at`` lies below ``z_below``.

    The spread is the sample deviation over the ``window`` snapshots before
    those.  Snapshots are counted over all keys, so a key that misses one does
    not reach further back.  A spread of 1 or less gives way to a fifth of the
    baseline, 3 at least.
    """
    ranks = df.select(snapshot).distinct().where(F.col(snapshot) <= at).orderBy(F.desc(snapshot)).limit(scored + window)
    ranks = ranks.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(snapshot))))  # of so many rows at most
    rows = df.join(F.broadcast(ranks), snapshot)
    sigma = rows.where(F.col("_r") > scored).groupBy(key).agg(F.stddev_samp(value).alias("sigma"))
    used = F.when(F.col("sigma") > 1, F.col("sigma")).otherwise(F.greatest(0.2 * F.col(baseline), F.lit(3.0)))
    z = rows.where(F.col("_r") <= scored).join(sigma, key, "left").withColumn("z", (F.col(value) - F.col(baseline)) / used)
    found = z.groupBy(key).agg(F.count("*").alias("n_consecutive"), F.max("z").alias("worst_z"), F.max_by(value, F.struct(F.col(snapshot), F.col(value))).alias("latest_value"), F.bool_and(F.coalesce(F.col("z") < z_below, F.lit(False))).alias("_all"))
    return found.where("_all").drop("_all")


def fold_log(df: DataFrame, key: str, seq: str, kind: str, until: str | None = None, at: Column | None = None, removed_by: str = "reopen") -> DataFrame:
    """State of an append-only log: each key's last entry, without removed ones and those whose ``until`` is not after ``at``."""
    rows = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(seq)).alias("_last")).select(key, "_last.*")
    rows = rows.where(F.col(kind) != removed_by)
    return rows if until is None else rows.where(F.col(until).isNull() | (F.col(until) > at))


def trapezoid(df: DataFrame, keys: Sequence[str], time: str, rate: str, per: float) -> DataFrame:
    """Integral of a rate (per ``per`` time units) by the trapezoid rule."""
    w = Window.partitionBy(*keys).orderBy(time)
    part = (F.col(rate) + F.lag(rate).over(w)) / 2 * (F.col(time) - F.lag(time).over(w)) / per
    return df.withColumn("_part", part).groupBy(*keys).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("total"))


def interpolate(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """The right series at each left instant: linear between neighbours, the end value beyond the ends."""
    r = right.select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")).alias("_r"))
    both = left.select(*keys, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l")).unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_b", F.max("_r").over(order)).withColumn("_a", F.min("_r").over(ahead)).where("_l is not null")
    span = F.col("_a.t") - F.col("_b.t")
    mid = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_t") - F.col("_b.t")) / F.when(span > 0, span)
    return both.select("_l.*", F.coalesce(mid, F.col("_b.v"), F.col("_a.v")).alias(out))
