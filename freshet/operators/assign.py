"""Assignment: greedy plans, capacity shares, hashing into shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalar import unit_interval


def greedy(scores: DataFrame, plan: str, source: str, order: Sequence[str], place: str, score: str) -> DataFrame:
    """Sources in order take the best place left, each place once; a place of no positive score is left.

    The choice is sequential within a plan, so a plan (a city and cycle of some
    dozens of pumps and places) is one group; plans run side by side.
    """
    schema = scores.select(plan, source, place, score).schema

    def choose(pdf):  # noqa: ANN001, ANN202
        taken, rows = set(), []
        pdf = pdf.sort_values([*order, source, place], ascending=[False] * len(order) + [True, True], kind="stable")
        for _, own in pdf.groupby(source, sort=False):
            best = None
            for r in own.itertuples(index=False):
                s = getattr(r, score)
                if getattr(r, place) not in taken and s > 0 and (best is None or s > getattr(best, score)):
                    best = r
            if best is not None:
                taken.add(getattr(best, place))
                rows.append([getattr(best, c) for c in (plan, source, place, score)])
        return type(pdf)(rows, columns=[plan, source, place, score])

    return scores.groupBy(plan).applyInPandas(choose, schema)


def shares(df: DataFrame, keys: Sequence[str], capacity: str, order: str) -> DataFrame:
    """Each option's share of the capacity and the cumulative share in order; equal where the total is not above 0."""
    w = Window.partitionBy(*keys)
    total, n = F.sum(capacity).over(w), F.count("*").over(w)
    out = df.withColumn("share", F.when(total > 0, F.col(capacity) / total).otherwise(1 / n))
    return out.withColumn("upto", F.sum("share").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def by_share(trips: DataFrame, options: DataFrame, keys: Sequence[str], trip: str, option: str, order: str) -> DataFrame:
    """The first option whose cumulative share is above the trip's place in [0, 1); trips without id get the first option.

    Options are a few per key, gathered into one array beside each trip.
    """
    few = options.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("upto").alias("u"), F.col(option).alias("x")))).alias("_all"))
    u = unit_interval(F.col(trip).cast("string"))
    hit = F.filter("_all", lambda o: F.col("_u") < o["u"])
    chosen = F.when(F.col(trip).isNull(), F.get("_all", F.lit(0))).otherwise(F.coalesce(F.get(hit, F.lit(0)), F.element_at("_all", -1)))
    return trips.join(few, list(keys)).withColumn("_u", u).withColumn(option, chosen["x"]).drop("_all", "_u")


def scored(saved_minutes: Column, weight: Column) -> Column:
    return saved_minutes * (0.5 + weight)
