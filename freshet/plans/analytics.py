"""Ensemble, window, join and set queries over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.functions import scalar
from freshet.operators import alerts, ensemble, temporal
from freshet.plans.catalog import EVENTS, events, query, r, table

_HOURLY = f"WITH {EVENTS}, h AS (SELECT event_type, hour, max(value) AS depth, avg(value) AS mean_value, sum(value) AS total, count(*) AS n FROM e GROUP BY 1, 2)"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", "hour").agg(F.max("value").alias("depth"), F.avg("value").alias("mean_value"), F.sum("value").alias("total"), F.count("*").alias("n"))


@query("""
WITH d AS (SELECT l_suppkey, CAST(floor(epoch_us(l_shipdate) / 86400000000) AS BIGINT) AS day, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey, max(qty) AS peak, arg_min(day, struct_pack(a := -qty, b := day)) AS peak_day FROM d GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY round(peak, 1) DESC, s_suppkey) AS BIGINT) AS position, s_suppkey, s_name, round(peak, 1) AS peak, peak_day FROM p JOIN supplier ON l_suppkey = s_suppkey
QUALIFY position <= 60""")
def hotspot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places ranked by their rounded peak, register order on ties: the 60 worst."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", scalar.slot(scalar.micros("l_shipdate"), 86_400).alias("day"))
    daily = items.groupBy("l_suppkey", "day").agg(F.sum("l_quantity").alias("qty"))
    peaks = temporal.peak(daily, ["l_suppkey"], "day", "qty").withColumnRenamed("peak_step", "peak_day").withColumn("peak", F.round("peak", 1))
    top = peaks.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).orderBy(F.desc("peak"), "s_suppkey").limit(60)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("peak"), "s_suppkey")).cast("long")).select("position", "s_suppkey", "s_name", "peak", "peak_day")


@query(f"""WITH {EVENTS} SELECT event_type, hour, round(quantile_cont(value, 0.1), 8) AS p10, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.9), 8) AS p90 FROM e GROUP BY 1, 2""")
def ensemble_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ensemble.quantiles(events(spark, sf_dir), ["event_type", "hour"], "value", [0.1, 0.5, 0.9])
    return q.select("event_type", "hour", *[r(c).alias(c) for c in ("p10", "p50", "p90")])


@query(f"""WITH {EVENTS} SELECT event_type, hour, {", ".join(f"round(avg(CASE WHEN value > {t} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS p_gt_{t}" for t in (15, 30, 45, 60))} FROM e GROUP BY 1, 2""")
def exceedance_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ensemble.exceedance(events(spark, sf_dir), ["event_type", "hour"], "value", [15, 30, 45, 60])
    return x.select("event_type", "hour", *[r(c, 6).alias(c) for c in x.columns if c.startswith("p_gt")])


@query("""SELECT l_suppkey, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS month, round(quantile_cont(l_quantity, 0.9), 8) AS p90 FROM lineitem GROUP BY 1, 2""")
def segment_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("month"), "l_quantity")
    q = ensemble.quantiles(items, ["l_suppkey", "month"], "l_quantity", [0.9])
    return q.withColumn("p90", r("p90"))


@query(f"""WITH {EVENTS}, m AS (SELECT hour, event_type, user_id % 10 AS member, avg(value) AS v FROM e GROUP BY 1, 2, 3),
l AS (SELECT *, greatest(50.0::DOUBLE + (v - avg(v) OVER (PARTITION BY hour, event_type)), 0.0) AS level_member FROM m)
SELECT hour, event_type, member, round(level_member, 8) AS level_member FROM l""")
def recentre_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = events(spark, sf_dir).groupBy("hour", "event_type", (F.col("user_id") % 10).alias("member")).agg(F.avg("value").alias("v"))
    out = ensemble.recentre(members.withColumn("level", F.lit(50.0)), ["hour", "event_type"], "v", "level")
    return out.select("hour", "event_type", "member", r("level_member").alias("level_member"))


@query(f"""WITH {EVENTS}, m AS (SELECT hour, user_id % 10 AS member, avg(value) AS v FROM e GROUP BY 1, 2)
SELECT hour, count(*) AS members, round(CASE WHEN count(*) >= 2 THEN quantile_cont(v, 0.1) END, 8) AS p10, round(CASE WHEN count(*) >= 2 THEN quantile_cont(v, 0.5) END, 8) AS p50, round(CASE WHEN count(*) >= 2 THEN quantile_cont(v, 0.9) END, 8) AS p90 FROM m GROUP BY 1""")
def area_depth_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ensemble.depth_band(events(spark, sf_dir).withColumn("member", F.col("user_id") % 10), ["hour"], "member", "value")
    return b.select("hour", "members", *[r(c).alias(c) for c in ("p10", "p50", "p90")])


@query(f"""WITH {EVENTS}, c AS (SELECT event_type, CAST(floor(hour / 24) AS BIGINT) AS day, avg(value) AS v FROM e GROUP BY 1, 2)
SELECT event_type, count(v) AS cycles, round(CASE WHEN count(v) >= 3 THEN quantile_cont(v, 0.1) END, 8) AS p10, round(CASE WHEN count(v) >= 3 THEN quantile_cont(v, 0.9) END, 8) AS p90 FROM c GROUP BY 1""")
def spread_across_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("hour") / 24).alias("day")).agg(F.avg("value").alias("v"))
    return ensemble.spread(daily, ["event_type"], "v").withColumns({c: r(c) for c in ("p10", "p90")})


@query(f"""WITH {EVENTS}, p AS (SELECT event_type, hour, avg(CASE WHEN value > 60 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM e GROUP BY 1, 2),
d(profile, tolerance) AS (VALUES ('ambulance', 0.3::DOUBLE), ('bus', 0.4::DOUBLE), ('pedestrian', 0.5::DOUBLE))
SELECT event_type, profile, min(CASE WHEN p > tolerance THEN hour END) AS first_over, max(CASE WHEN p > tolerance THEN hour END) AS last_over FROM p CROSS JOIN d GROUP BY 1, 2""")
def safe_until_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ensemble.exceedance(events(spark, sf_dir), ["event_type", "hour"], "value", [60]).withColumnRenamed("p_gt_60", "p")
    profiles = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(t).alias("tolerance")) for n, t in (("ambulance", 0.3), ("bus", 0.4), ("pedestrian", 0.5))]))
    rows = x.withColumn("_d", profiles).select("event_type", "hour", "p", "_d.*")
    return temporal.first_over(rows, ["event_type", "profile"], "hour", "p", F.col("tolerance"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, arg_max(event_type, struct_pack(a := us, b := event_id)) AS kind, max(us) AS us FROM e WHERE event_type IN ('signup', 'error') GROUP BY 1)
SELECT user_id, kind, us FROM o WHERE kind <> 'error'""")
def ops_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).where("event_type in ('signup', 'error')").select("user_id", F.struct("us", "event_id").alias("seq"), F.col("event_type").alias("kind"), "us")
    return temporal.fold_log(log, "user_id", "seq", "kind", removed_by="error").select("user_id", "kind", "us")


@query(f"""{_HOURLY}, t(level, threshold, severity) AS (VALUES ('severe', 90.0::DOUBLE, 0), ('moderate', 70.0::DOUBLE, 1), ('watch', 40.0::DOUBLE, 2)),
f AS (SELECT *, depth > threshold AS over, hour - row_number() OVER (PARTITION BY event_type, level, depth > threshold ORDER BY hour) AS run FROM h CROSS JOIN t),
i AS (SELECT event_type, level, severity, run, min(hour) AS first_step, max(hour) AS last_step, count(*) AS length, max(depth) AS peak FROM f WHERE over GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type, level ORDER BY length DESC, first_step) AS n FROM i)
SELECT event_type, level, first_step, last_step, length, round(peak, 8) AS peak, last_step = (SELECT max(hour) FROM h x WHERE x.event_type = b.event_type) AS open_ended FROM b WHERE n = 1""")
def alert_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts.episodes(_hourly(spark, sf_dir).select("event_type", "hour", "depth"), ["event_type"], "hour", "depth", (("severe", 90.0), ("moderate", 70.0), ("watch", 40.0)))
    return a.select("event_type", "level", "first_step", "last_step", "length", r("peak").alias("peak"), "open_ended")


@query(f"""{_HOURLY}, c AS (SELECT event_type, hour, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k, least(mean_value / 100, 1.0::DOUBLE) AS p FROM h),
RECURSIVE s AS (SELECT event_type, k, hour, CASE WHEN p >= 0.6 THEN 'pending' ELSE 'none' END AS state, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS cycles, NULL::VARCHAR AS event FROM c WHERE k = 1
 UNION ALL SELECT c.event_type, c.k, c.hour,
  CASE WHEN p >= 0.6 THEN CASE WHEN s.state = 'raised' OR (s.state = 'pending' AND s.cycles + 1 >= 2) THEN 'raised' ELSE 'pending' END WHEN p > 0.3 AND s.state = 'raised' THEN 'raised' ELSE 'none' END,
  CASE WHEN p >= 0.6 THEN CASE WHEN s.state = 'none' THEN 1 ELSE s.cycles + 1 END WHEN p > 0.3 AND s.state = 'raised' THEN s.cycles + 1 ELSE 0 END,
  CASE WHEN p >= 0.6 AND s.state = 'pending' AND s.cycles + 1 >= 2 THEN 'raised' WHEN p <= 0.3 AND s.state = 'raised' THEN 'cleared' END
 FROM s JOIN c ON c.event_type = s.event_type AND c.k = s.k + 1)
SELECT event_type, hour, state, CAST(cycles AS INTEGER) AS cycles, event FROM s""".replace("WITH e AS", "WITH RECURSIVE e AS").replace("RECURSIVE s AS", "s AS"))
def alert_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = _hourly(spark, sf_dir).select("event_type", "hour", F.least(F.col("mean_value") / 100, F.lit(1.0)).alias("p"))
    return alerts.hysteresis(cycles, ["event_type"], "hour", "p")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id % 20 AS segment, hour, avg(value) AS kmh FROM e GROUP BY 1, 2), b AS (SELECT *, avg(kmh) OVER (PARTITION BY segment) AS baseline FROM s),
rk AS (SELECT hour, row_number() OVER (ORDER BY hour DESC) AS k FROM (SELECT DISTINCT hour FROM s)), j AS (SELECT b.*, k FROM b JOIN rk USING (hour)),
g AS (SELECT segment, stddev_samp(kmh) AS sigma FROM j WHERE k BETWEEN 3 AND 14 GROUP BY 1),
z AS (SELECT j.*, (kmh - baseline) / CASE WHEN sigma > 1 THEN sigma ELSE greatest(0.2 * baseline, 3.0) END AS z FROM j LEFT JOIN g USING (segment) WHERE k <= 2)
SELECT segment, count(*) AS n_consecutive, round(max(z), 8) AS worst_z, round(arg_max(kmh, hour), 8) AS latest_value FROM z GROUP BY 1 HAVING bool_and(z < -0.5)""")
def traffic_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("segment"), "hour").agg(F.avg("value").alias("kmh"))
    s = s.withColumn("baseline", F.avg("kmh").over(Window.partitionBy("segment")))
    last = s.agg(F.max("hour")).first()[0]
    a = temporal.anomalies(s, "segment", "hour", "kmh", "baseline", last, z_below=-0.5)
    return a.select("segment", "n_consecutive", r("worst_z").alias("worst_z"), r("latest_value").alias("latest_value"))


@query(f"""{_HOURLY}, d AS (SELECT event_type, hour, total, lag(hour) OVER w AS lh, lag(total) OVER w AS lt FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
SELECT event_type, round(coalesce(sum((total + lt) / 2 * (hour - lh)), 0.0), 6) AS total FROM d GROUP BY 1""")
def accumulation_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.trapezoid(_hourly(spark, sf_dir), ["event_type"], "hour", "total", 1.0).withColumn("total", r("total", 6))


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us, max(value) AS value FROM e WHERE event_type = 'click' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, round(c.value, 8) AS click_value, c.us AS click_value_time FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us""")
def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    clicks = e.where("event_type = 'click'").select("user_id", "us", "value")
    return temporal.asof(bought, clicks, ["user_id"], "us", "value", "click_value", tie=["value"]).select("event_id", "user_id", r("click_value").alias("click_value"), "click_value_time")


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, us, min(value) AS lo, max(value) AS hi FROM e WHERE event_type = 'view' GROUP BY 1, 2),
b AS (SELECT p.*, c.us AS bus, c.hi AS bv FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us),
a AS (SELECT b.*, c.us AS aus, c.lo AS av FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.us <= c.us),
k AS (SELECT event_id, CASE WHEN bus IS NOT NULL AND (aus IS NULL OR us - bus <= aus - us) THEN bus ELSE aus END AS t, CASE WHEN bus IS NOT NULL AND (aus IS NULL OR us - bus <= aus - us) THEN bv ELSE av END AS v, us FROM a)
SELECT event_id, round(CASE WHEN abs(us - t) <= 86400000000 THEN v END, 8) AS view_value, CASE WHEN abs(us - t) <= 86400000000 THEN t END AS view_value_time FROM k""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    views = e.where("event_type = 'view'").select("user_id", "us", "value")
    out = temporal.nearest_in_time(bought, views, ["user_id"], "us", "value", "view_value", 86_400_000_000)
    return out.select("event_id", r("view_value").alias("view_value"), "view_value_time")


@query(f"""WITH {EVENTS}, a AS (SELECT event_id, user_id, us AS s, us + 7200000000 AS t FROM e WHERE event_type = 'signup'), b AS (SELECT event_id AS other, us AS s2, us + 3600000000 AS t2, user_id FROM e WHERE event_type = 'error')
SELECT a.event_id, other, least(t, t2) - greatest(s, s2) AS overlap FROM a JOIN b ON a.user_id = b.user_id AND s < t2 AND s2 < t""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    a = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("us").alias("s"), (F.col("us") + 7_200_000_000).alias("t"))
    b = e.where("event_type = 'error'").select(F.col("event_id").alias("other"), "user_id", F.col("us").alias("s2"), (F.col("us") + 3_600_000_000).alias("t2"))
    return temporal.overlap_join(a, b, 3_600_000_000, ("s", "t"), ("s2", "t2"), ["user_id"]).select("event_id", "other", "overlap")


@query(f"""{_HOURLY}, l AS (SELECT hour * 3600000000 + 1800000000 AS us, event_type FROM h),
k AS (SELECT event_type, hour * 3600000000 AS us, mean_value AS v FROM h WHERE hour % 3 = 0),
b AS (SELECT l.*, k.us AS bu, k.v AS bv FROM l ASOF LEFT JOIN k ON l.event_type = k.event_type AND l.us >= k.us),
a AS (SELECT b.*, k.us AS au, k.v AS av FROM b ASOF LEFT JOIN k ON b.event_type = k.event_type AND b.us <= k.us)
SELECT event_type, us, round(CASE WHEN bu IS NULL THEN av WHEN au IS NULL OR au = bu THEN bv ELSE bv + (av - bv) * (us - bu) / (au - bu) END, 8) AS stage FROM a""")
def interpolated_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hourly(spark, sf_dir)
    wanted = h.select("event_type", (F.col("hour") * 3_600_000_000 + 1_800_000_000).alias("us"))
    known = h.where("hour % 3 = 0").select("event_type", (F.col("hour") * 3_600_000_000).alias("us"), "mean_value")
    return temporal.interpolate(wanted, known, ["event_type"], "us", "mean_value", "stage").withColumn("stage", r("stage"))


@query(f"""{_HOURLY}, f AS (SELECT event_type, hour, depth > 60 AS over, min((depth > 60)::INT) OVER w AS m, count(*) OVER w AS c FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT event_type, count(*) FILTER (m = 1 AND c = 2) AS held_steps, min(CASE WHEN m = 1 AND c = 2 THEN hour END) AS first_held FROM f GROUP BY 1""")
def rolling_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hourly(spark, sf_dir).withColumn("over", F.col("depth") > 60)
    held = temporal.both_steps(h, ["event_type"], "hour", "over")
    return held.groupBy("event_type").agg(F.count_if("held").alias("held_steps"), F.min(F.when(F.col("held"), F.col("hour"))).alias("first_held"))


@query(f"""WITH {EVENTS} SELECT user_id, arg_max(event_id, struct_pack(a := us, b := value, c := event_id)) AS event_id, round(arg_max(value, struct_pack(a := us, b := value, c := event_id)), 8) AS value FROM e GROUP BY 1""")
def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest(events(spark, sf_dir), ["user_id"], ["us", "value", "event_id"]).select("user_id", "event_id", r("value").alias("value"))


@query("""WITH s AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_discount FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS n FROM s)
SELECT p_partkey, p_name, l_suppkey, round(l_discount, 8) AS worst FROM part LEFT JOIN (SELECT * FROM k WHERE n = 1) ON p_partkey = l_partkey""")
def worst_edge_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by(F.struct("l_suppkey", "l_discount"), F.struct(-F.col("l_discount"), F.col("l_orderkey"), F.col("l_linenumber"))).alias("w"))
    met = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(worst, F.col("p_partkey") == F.col("l_partkey"), "left")
    return met.select("p_partkey", "p_name", "w.l_suppkey", r("w.l_discount").alias("worst"))


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def open_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey")
    taken = table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").join(returned, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    return s.join(taken, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey")


@query("""WITH b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
x AS (SELECT k FROM b EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0), i AS (SELECT k FROM x INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT k AS custkey FROM i""")
def pivot_topk_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    subjects = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")).union(o.where("o_orderpriority = '1-URGENT'").select("o_custkey")).distinct()
    kept = subjects.exceptAll(c.where("c_acctbal < 0").select("c_custkey"))
    return kept.intersect(c.where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query(f"""WITH {EVENTS} SELECT user_id, {", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in ("click", "error", "purchase", "signup", "view"))}, count(DISTINCT hour) AS hours FROM e GROUP BY 1""")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("click", "error", "purchase", "signup", "view")
    return events(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in kinds], F.countDistinct("hour").alias("hours"))


@query(f"""{_HOURLY} SELECT event_type, CAST(count(*) FILTER (depth > 90) * 5 AS BIGINT) AS minutes_above FROM h GROUP BY 1""")
def minutes_impassable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.minutes_above(_hourly(spark, sf_dir), ["event_type"], "depth", 90.0)


@query(f"""WITH {EVENTS}, w AS (SELECT user_id FROM e GROUP BY 1 HAVING max(value) >= 99)
SELECT e.user_id, count(*) AS n, round(max(value), 1) AS peak FROM e JOIN w USING (user_id) GROUP BY 1""")
def wet_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet = ensemble.wet_keys(events(spark, sf_dir), ["user_id"], "value", 99.0)
    return wet.groupBy("user_id").agg(F.count("*").alias("n"), r(F.max("value"), 1).alias("peak"))


@query("""SELECT c_nationkey, round(sum(c_acctbal * (1 + c_custkey % 3)) / sum(1 + c_custkey % 3), 8) AS weighted_mean FROM customer GROUP BY 1""")
def weighted_area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("w", 1.0 + F.col("c_custkey") % 3)
    return ensemble.weighted_mean(c, ["c_nationkey"], "c_acctbal", "w").withColumn("weighted_mean", r("weighted_mean"))


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice <= 450 THEN 450::DOUBLE WHEN o_totalprice <= 60000 THEN 60000 WHEN o_totalprice <= 150000 THEN 150000 ELSE 300000 END, 0) AS size,
round(1 + 2 * greatest(0, least(1, (o_totalprice / 5000 - 5) / 25)), 8) AS slow, round((1 - pow(1 - least(o_totalprice / 500000, 1), 5.0 / 3.0)) * 100, 3) AS loss,
CAST((o_totalprice >= 5000)::INT + (o_totalprice >= 15000)::INT + (o_totalprice >= 30000)::INT + (o_totalprice >= 45000)::INT + (o_totalprice >= 60000)::INT AS INTEGER) AS band,
round(CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0, 9) AS unit,
'order|' || o_orderkey || '|' || o_orderstatus AS name FROM orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalar.snap_up(p, (450.0, 60000.0, 150000.0, 300000.0)).alias("size"),
        r(scalar.slowdown(p / 5000, 30.0)).alias("slow"),
        r(scalar.capacity_loss(F.least(p / 500000, F.lit(1.0))), 3).alias("loss"),
        scalar.depth_band(p / 1000).alias("band"),
        r(scalar.unit_interval(F.col("o_orderkey").cast("string")), 9).alias("unit"),
        scalar.identity(F.lit("order"), F.col("o_orderkey"), F.col("o_orderstatus")).alias("name"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(CASE WHEN ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06' THEN 1 ELSE 0 END AS INTEGER) AS in_window,
CAST(epoch_us(greatest(least(time_bucket(INTERVAL '5 minutes', ts), TIMESTAMP '2024-01-20'), TIMESTAMP '2024-01-02')) AS BIGINT) AS cycle FROM events""")
def windows_and_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us, day = scalar.micros("ts"), 86_400_000_000
    at = lambda d: F.lit(19_723 * day + (d - 1) * day)  # 2024-01-01 is day 19,723
    return e.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        ((us > at(5)) & (us <= at(6))).cast("int").alias("in_window"),
        scalar.snap(us, at(2), at(20), 300).alias("cycle"),
    )
