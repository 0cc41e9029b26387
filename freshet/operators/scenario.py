"""Scenarios: attribution of a peak, prices of a plan, corridors, blends, bands and what they owe to each cause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blend(nowcast: Column, model: Column, lead_min: Column, tau_min: float = 60.0) -> Column:
    """The nowcast's share of the blend falls as exp(-lead / tau); a nowcast without value counts as 0; never below 0."""
    w = F.exp(-lead_min / tau_min)
    return F.greatest(w * F.coalesce(F.nanvl(nowcast, F.lit(0.0)), F.lit(0.0)) + (1 - w) * model, F.lit(0.0))


def unit_stats(cells: DataFrame, label: str, value: str) -> DataFrame:
    """Mean and maximum of the finite values of each unit, null where it has none; negative and null labels are no unit."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return cells.where(F.col(label) >= 0).groupBy(label).agg(F.avg(finite).alias("mean"), F.max(finite).alias("max"))


def attribution(df: DataFrame, target: str, candidate: str, step: str, depth: str, explained: str, most: int = 14, floor: float = 0.05) -> DataFrame:
    """For each target the candidates whose cleaning lowers its peak by ``floor`` or more, the strongest first, ``most`` of them.

    ``df``: a row per target, step and candidate with the depth that stands there
    (the same for all candidates of a step) and what cleaning the candidate takes
    from it.  ``combined`` evaluates the chosen ones together again: depths never
    fall below 0, so it need not be the sum.  Targets without any such candidate
    are left out: there is nothing to rank.
    """
    base = df.groupBy(target, step).agg(F.max(depth).alias("_depth"))
    before = base.groupBy(target).agg(F.max("_depth").alias("before"))
    # a step that a candidate has no part in keeps its depth, so the peak over those is one of the steps without it
    own = df.groupBy(target, candidate, step).agg(F.max(depth).alias("_depth"), F.sum(explained).alias("_less"))
    touched = own.groupBy(target, candidate).agg(F.max(F.greatest(F.col("_depth") - F.col("_less"), F.lit(0.0))).alias("_touched"), F.max(F.struct("_depth", step)).alias("_t"), F.count("*").alias("_n"))
    spread = own.select(target, candidate, step).withColumn("_own", F.lit(True))
    others = touched.select(target, candidate).join(base, target).join(spread, [target, candidate, step], "left").where("_own is null")
    untouched = others.groupBy(target, candidate).agg(F.max("_depth").alias("_untouched"))
    after = F.greatest(F.col("_touched"), F.coalesce("_untouched", F.lit(0.0)))
    scored = touched.join(untouched, [target, candidate], "left").join(before, target).select(target, candidate, "before", (F.col("before") - after).alias("effect"))
    rank = F.row_number().over(Window.partitionBy(target).orderBy(F.desc("effect"), candidate))
    best = scored.where(F.col("effect") >= floor).withColumn("position", rank).where(F.col("position") <= most)
    less = own.join(best.select(target, candidate), [target, candidate], "left_semi").groupBy(target, step).agg(F.sum("_less").alias("_all"))
    together = base.join(less, [target, step], "left").groupBy(target).agg(F.max(F.greatest(F.col("_depth") - F.coalesce("_all", F.lit(0.0)), F.lit(0.0))).alias("_after"))
    return best.join(together, target).select(target, candidate, "position", "effect", (F.col("before") - F.col("_after")).alias("combined"))


def price_plan(placements: DataFrame, fleet: DataFrame, minutes: Column, rate: str = "rate") -> DataFrame:
    """Marginal minutes of each pump of a hand-made plan, in order of arrival at its place, and why the others are refused.

    ``placements(seq, pump, place, travel)``, ``fleet(pump, status, rate)``;
    ``minutes``: what the combined rate ``total`` saves at a place.  A pump that
    the fleet does not have, that is withheld, or that stands earlier in the plan
    is refused and saves nothing.
    """
    met = placements.join(fleet.withColumnRenamed("pump", "_pump"), F.col("pump") == F.col("_pump"), "left")
    usable = F.col("_pump").isNotNull() & (F.col("status") == "ready")
    again = F.row_number().over(Window.partitionBy("pump").orderBy("seq")) > 1
    reason = F.when(F.col("_pump").isNull(), "unknown").when(~usable, "withheld").when(again, "placed twice")
    judged = met.withColumn("refused", reason)
    order = Window.partitionBy("place").orderBy("travel", "pump").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = judged.where("refused is null").withColumn("total", F.sum(rate).over(order)).withColumn("_saved", minutes)
    before = F.coalesce(F.lag("_saved").over(Window.partitionBy("place").orderBy("travel", "pump")), F.lit(0.0))
    columns = ("seq", "pump", "place", "refused", "minutes")
    lost = judged.where("refused is not null").withColumn("minutes", F.lit(0.0))
    return kept.withColumn("minutes", F.col("_saved") - before).select(*columns).unionByName(lost.select(*columns))


def corridors(legs: DataFrame, closed: DataFrame, tolerance: float, proxy: Column, keys: Sequence[str] = ("trip",), most: int = 3) -> DataFrame:
    """Safe corridors of each trip with their share of its traffic.

    ``legs(trip, route, place, segment, lanes, minutes, p)``; routes of the same
    streets in the same order are one, the first.  A route with a closed street
    or a probability of ``tolerance`` or more is dropped.  Capacity is what its
    narrowest leg holds, ``lanes * (1 - proxy)``, for each minute it takes, a second at least; the
    shares are in proportion, equal where no corridor has any.
    """
    shut = closed.select(F.col("segment").alias("_shut")).distinct()
    met = legs.withColumn("_left", F.col("lanes") * (1 - proxy)).join(shut, F.col("segment") == F.col("_shut"), "left")
    streets = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "segment"))), lambda x: x["segment"].cast("string")), ">"), 256)
    routes = met.groupBy(*keys, "route").agg(streets.alias("corridor"), F.min("_left").alias("_least"), F.sum("minutes").alias("minutes"), F.max("p").alias("worst"), F.max(F.col("_shut").isNotNull()).alias("_closed"))
    safe = routes.where(~F.col("_closed") & (F.col("worst") < tolerance))
    first = safe.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "corridor").orderBy("route"))).where("_n = 1")
    kept = first.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("route"))).where(F.col("position") <= most)
    kept = kept.withColumn("capacity", F.greatest(F.col("_least"), F.lit(0.0)) / F.greatest(F.col("minutes"), F.lit(1 / 60)))
    every = Window.partitionBy(*keys)
    total = F.sum("capacity").over(every)
    return kept.withColumn("share", F.when(total > 0, F.col("capacity") / total).otherwise(1 / F.count("*").over(every))).select(*keys, "route", "position", "minutes", "worst", "capacity", "share")


def decomposition(members: DataFrame, key: str, full: str, scenarios: Sequence[str], wet: float) -> DataFrame:
    """Width (90 % minus 10 %) of the full ensemble over its wet keys, of each scenario's, and the share it has of the full one.

    A key is wet if any of its members reaches ``wet`` in the full ensemble.
    """
    band = lambda c: F.percentile(c, F.lit(0.9)) - F.percentile(c, F.lit(0.1))
    by_key = members.groupBy(key).agg(F.max(full).alias("_top"), *[band(c).alias(f"_{c}") for c in (full, *scenarios)]).where(F.col("_top") >= wet)
    widths = by_key.agg(*[F.avg(f"_{c}").alias(c) for c in (full, *scenarios)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("scenario"), F.col(c).alias("width"), (F.col(c) / F.nullif(F.col(full), F.lit(0.0))).alias("share")) for c in (full, *scenarios)]))
    return widths.select(rows.alias("_r")).select("_r.*")


def levelled(published: DataFrame, base: DataFrame, scenario: DataFrame, keys: Sequence[str], depth: str) -> DataFrame:
    """A scenario's answer on the level of the run's own published series: published plus what the scenario changes, never below 0.

    Keys that the published series lacks are left out; where base or scenario lack one it counts as 0.
    """
    side = lambda d, n: d.select(*keys, F.col(depth).alias(n))
    met = published.join(side(base, "_b"), list(keys), "left").join(side(scenario, "_s"), list(keys), "left")
    change = F.coalesce("_s", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return met.select(*keys, F.greatest(F.col(depth) + change, F.lit(0.0)).alias(depth))


def first_edge_least(nodes: DataFrame, edges: DataFrame, node: str, segment: str, order: Sequence[str], value: str) -> DataFrame:
    """Least value under each segment: each node counts with its first edge, in file order, that has a finite value."""
    v = F.col(value)
    first = edges.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(node).agg(F.min_by(value, F.struct(*order)).alias("_v"))
    return nodes.where(F.col(segment).isNotNull()).join(first, node).groupBy(segment).agg(F.min("_v").alias(value))
