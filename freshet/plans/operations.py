"""Operations-room queries: feeds in, masks, drains, plans, registries, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.functions import scalar
from freshet.operators import calibrate, graph, hulls, recurrence, spatial, temporal
from freshet.plans.catalog import EVENTS, events, query, r, table


@query(f"""WITH {EVENTS}, x AS (SELECT k AS i, CASE WHEN (k + 0.5) * 5 < 24 THEN (24 - (k + 0.5) * 5)::DOUBLE / 0.4 ELSE ((k + 0.5) * 5 - 24)::DOUBLE / 0.6 END AS x FROM range(12) t(k)), w AS (SELECT i, (0.2::DOUBLE * x + 10) / pow(x + 10, 1.8::DOUBLE) AS w FROM x),
d AS (SELECT user_id, CAST(floor(hour / 24.0) AS BIGINT) AS day, sum(value) AS depth FROM e GROUP BY 1, 2) SELECT user_id, day, CAST(i AS INTEGER) AS block, round(12 * depth * w / (SELECT sum(w) FROM w), 6) AS mm_h FROM d CROSS JOIN w""")
def design_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gauge's rain of a day as a design storm of an hour."""
    days = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("hour") / 24).alias("day")).agg(F.sum("value").alias("depth"))
    return recurrence.design_storms(days, "depth", 12, 5).select("user_id", "day", "block", r("mm_h", 6).alias("mm_h"))


@query(f"""WITH {EVENTS}, z AS (SELECT event_id, CASE WHEN value > 0 THEN 10 * log10(200 * pow(value, 1.6)) END AS dbz FROM e) SELECT event_id, round(dbz, 8) AS dbz, CAST(floor(dbz / 5) * 5 AS BIGINT) AS class, round(pow(pow(10, dbz / 10) / 200, 1 / 1.6), 6) AS back FROM z""")
def radar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain rendered as reflectivity in 5 dBZ classes, and the rate that reads back."""
    z = events(spark, sf_dir).select("event_id", scalar.reflectivity(F.col("value")).alias("dbz"))
    return z.select("event_id", r("dbz").alias("dbz"), (F.floor(F.col("dbz") / 5) * 5).cast("long").alias("class"), r(scalar.rain_rate(F.col("dbz")), 6).alias("back"))


@query("""WITH p(name, r, g, b, dbz) AS (VALUES ('light', 0, 120, 255, 20), ('moderate', 0, 200, 0, 35), ('heavy', 255, 200, 0, 45), ('violent', 230, 0, 0, 55)), x AS (SELECT p_partkey AS k, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part),
d AS (SELECT k, dbz, pow(x.r - p.r, 2) + pow(x.g - p.g, 2) + pow(x.b - p.b, 2) AS d FROM x CROSS JOIN p) SELECT k, arg_min(dbz, struct_pack(a := d, b := dbz)) AS dbz FROM d GROUP BY 1""")
def palette_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image colours to reflectivity: the nearest colour of a fixed palette, compared inside one expression."""
    palette = ((0, 120, 255, 20), (0, 200, 0, 35), (255, 200, 0, 45), (230, 0, 0, 55))
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *[(F.col("p_partkey") * m % 256).alias(c) for c, m in (("r", 37), ("g", 91), ("b", 53))])
    far = lambda p: F.pow(F.col("r") - p[0], 2) + F.pow(F.col("g") - p[1], 2) + F.pow(F.col("b") - p[2], 2)
    nearest = F.array_min(F.array(*[F.struct(far(p).alias("d"), F.lit(p[3]).alias("dbz")) for p in palette]))
    return x.select("k", nearest["dbz"].alias("dbz"))


@query(f"""WITH {EVENTS}, s AS (SELECT event_id, user_id, hour FROM e WHERE event_type IN ('error', 'signup') AND us > 1704412800000000 AND user_id BETWEEN 10 AND 120)
SELECT user_id, count(*) AS shown, count(*) FILTER (event_id % 3 = 0) AS hidden FROM s GROUP BY 1""")
def selected_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type in ('error', 'signup') and us > 1704412800000000").where(F.col("user_id").between(10, 120))
    return e.groupBy("user_id").agg(F.count("*").alias("shown"), F.count_if(F.col("event_id") % 3 == 0).alias("hidden"))


@query(f"""WITH {EVENTS}, c AS (SELECT user_id AS cell, hour, avg(value) AS v FROM e WHERE user_id % 7 <> 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY hour DESC) AS n FROM c)
SELECT cell, count(*) AS frames, round(var_pop(v), 6) AS variance, count(*) = 6 AND avg(v) >= 35 AND var_pop(v) < 900 AS clutter FROM k WHERE n <= 6 GROUP BY 1""")
def clutter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that stay bright over their last six frames; masked cells (every seventh) are left out before."""
    masked = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 7 = 0")
    c = events(spark, sf_dir).join(masked, "user_id", "left_anti").groupBy(F.col("user_id").alias("cell"), "hour").agg(F.avg("value").alias("v"))
    last = spatial.band_rank(c, ["cell"], "hour", "v", 6)
    return last.groupBy("cell").agg(F.count("*").alias("frames"), r(F.var_pop("v"), 6).alias("variance"), ((F.count("*") == 6) & (F.avg("v") >= 35) & (F.var_pop("v") < 900)).alias("clutter"))


@query(f"""WITH {EVENTS}, a AS (SELECT user_id % 36 AS bin, min(value) AS lo FROM e GROUP BY 1), d AS (SELECT a.bin, min(b.lo) AS lo FROM a JOIN a b ON b.bin IN (a.bin, (a.bin + 1) % 36, (a.bin + 35) % 36) GROUP BY 1) SELECT bin, round(lo, 8) AS lo FROM d""")
def shadow_by_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least value per azimuth bin, spread to the bins beside it around the circle."""
    a = events(spark, sf_dir).groupBy((F.col("user_id") % 36).alias("bin")).agg(F.min("value").alias("lo"))
    around = a.withColumn("bin", F.explode(F.array("bin", (F.col("bin") + 1) % 36, (F.col("bin") + 35) % 36)))
    return around.join(a.select("bin"), "bin", "left_semi").groupBy("bin").agg(r(F.min("lo")).alias("lo"))


@query("""SELECT DISTINCT l_suppkey, k AS node FROM (SELECT l_suppkey, l_partkey AS k FROM lineitem UNION SELECT l_suppkey, l_orderkey FROM lineitem) JOIN part ON k = p_partkey WHERE p_size > 25""")
def two_sided_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")
    ends = l.select("l_suppkey", F.col("l_partkey").alias("node")).union(l.select("l_suppkey", F.col("l_orderkey").alias("node")))
    return ends.join(p, F.col("node") == F.col("p_partkey"), "left_semi").distinct()


@query("""WITH d(p, speed) AS (VALUES ('1-URGENT', 40), ('2-HIGH', 30)) SELECT o_orderkey, coalesce(speed, 15) AS speed FROM orders LEFT JOIN d ON o_orderpriority = p""")
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = F.broadcast(spark.createDataFrame([("1-URGENT", 40), ("2-HIGH", 30)], "p string, speed int"))  # a fixed list
    return table(spark, sf_dir, "orders").join(speed, F.col("o_orderpriority") == F.col("p"), "left").select("o_orderkey", F.coalesce("speed", F.lit(15)).alias("speed"))


@query(f"""WITH {EVENTS}, f AS (SELECT event_type, us, avg(value) AS fc FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2), o AS (SELECT event_type, us AS ot, avg(value) AS ob FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT event_type, us, round(fc - ob, 8) AS error FROM f JOIN o USING (event_type) WHERE abs(us - ot) <= 600000000 QUALIFY row_number() OVER (PARTITION BY event_type, us ORDER BY abs(us - ot), ot) = 1""")
def valid_time_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast against the nearest truth; the feed is sparse, so ten minutes stand for the second that frames have."""
    e = events(spark, sf_dir)
    f = e.where("event_id % 2 = 0").groupBy("event_type", "us").agg(F.avg("value").alias("fc"))
    o = e.where("event_id % 2 = 1").groupBy("event_type", "us").agg(F.avg("value").alias("ob"))
    return temporal.valid_times(f, o, ["event_type"], "us", "ob", "ob", 600_000_000).select("event_type", "us", r(F.col("fc") - F.col("ob")).alias("error"))


@query("""WITH a AS (SELECT c_nationkey AS hotspot, c_custkey % 100 AS cell, c_acctbal AS weight FROM customer), b AS (SELECT DISTINCT s_suppkey AS segment, s_suppkey % 100 AS cell FROM supplier) SELECT segment, hotspot, count(*) AS cells, round(max(weight), 4) AS weight FROM a JOIN b USING (cell) GROUP BY 1, 2""")
def shared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("hotspot"), (F.col("c_custkey") % 100).alias("cell"), F.col("c_acctbal").alias("weight"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment"), (F.col("s_suppkey") % 100).alias("cell")).distinct()
    one = a.groupBy("hotspot", "cell").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))  # a hotspot's rows of a cell meet a segment as one
    return one.join(b, "cell").groupBy("segment", "hotspot").agg(F.sum("n").alias("cells"), r(F.max("weight"), 4).alias("weight"))


@query(f"""WITH {EVENTS}, a AS (SELECT DISTINCT user_id, hour AS cycle FROM e WHERE value > 60)
SELECT coalesce(n.user_id, p.user_id) AS user_id, coalesce(n.cycle, p.cycle + 1) AS cycle, CASE WHEN p.user_id IS NULL THEN 'new' WHEN n.user_id IS NULL THEN 'gone' ELSE 'kept' END AS change FROM a n FULL JOIN a p ON n.user_id = p.user_id AND n.cycle = p.cycle + 1""")
def previous_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts (more than 60) of each hourly cycle against those of the cycle before."""
    now = events(spark, sf_dir).where("value > 60").select("user_id", F.col("hour").alias("cycle")).distinct()
    before = now.select("user_id", (F.col("cycle") + 1).alias("cycle"), F.lit(True).alias("was"))
    met = now.withColumn("is", F.lit(True)).join(before, ["user_id", "cycle"], "full_outer")
    return met.select("user_id", "cycle", F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").otherwise("kept").alias("change"))


@query("""SELECT p_brand, CAST(year(l_shipdate) AS BIGINT) AS step, round(max(l_quantity), 4) AS depth, arg_max(p_partkey, struct_pack(a := l_quantity, b := -p_partkey)) AS worst FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1, 2""")
def road_name_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_brand is not null").select("p_partkey", "p_brand")
    met = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy("p_brand", F.year("l_shipdate").cast("long").alias("step")).agg(r(F.max("l_quantity"), 4).alias("depth"), F.max_by("p_partkey", F.struct("l_quantity", -F.col("p_partkey"))).alias("worst"))


@query(f"""WITH {EVENTS} SELECT event_type, round(median(value) FILTER (value >= 20), 8) AS median_lead, count(*) FILTER (value >= 20) AS n FROM e GROUP BY 1""")
def median_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.when(F.col("value") >= 20, F.col("value"))
    return events(spark, sf_dir).groupBy("event_type").agg(r(F.median(early)).alias("median_lead"), F.count(early).alias("n"))


@query("""WITH e AS (SELECT l_suppkey AS edge, l_partkey % 50 AS node, l_quantity AS q, l_discount * 5 AS beta FROM lineitem) SELECT node, round(sum(q * (1 - pow(1 - beta, 5.0 / 3))) / sum(q) * 100, 6) AS loss_pct, arg_max(edge, struct_pack(a := beta, b := -edge)) AS worst_edge, count(*) FILTER (beta > 0.4) AS blocked FROM e GROUP BY 1""")
def drain_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("edge"), (F.col("l_partkey") % 50).alias("node"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 5).alias("beta"))
    return e.groupBy("node").agg(r(F.sum(F.col("q") * scalar.capacity_loss(F.col("beta"))) / F.sum("q"), 6).alias("loss_pct"), F.max_by("edge", F.struct("beta", -F.col("edge"))).alias("worst_edge"), F.count_if(F.col("beta") > 0.4).alias("blocked"))


@query(f"""WITH {EVENTS}, h AS (SELECT hour, user_id, max(value) AS v FROM e GROUP BY 1, 2) SELECT hour, count(*) FILTER (v > 60) AS surcharging, count(*) FILTER (v < 5) AS backflow FROM h GROUP BY 1 HAVING count(*) FILTER (v > 60) > 0""")
def surcharge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = events(spark, sf_dir).groupBy("hour", "user_id").agg(F.max("value").alias("v"))
    return h.groupBy("hour").agg(F.count_if(F.col("v") > 60).alias("surcharging"), F.count_if(F.col("v") < 5).alias("backflow")).where("surcharging > 0")


@query("""WITH o AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS parts FROM lineitem GROUP BY 1) SELECT o_orderstatus, count(*) AS orders, round(abs(sum(o_totalprice) - sum(parts)) / nullif(sum(o_totalprice), 0), 6) AS residual FROM orders JOIN o ON o_orderkey = l_orderkey GROUP BY 1""")
def mass_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("parts"))
    met = table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), r(F.abs(F.sum("o_totalprice") - F.sum("parts")) / F.nullif(F.sum("o_totalprice"), F.lit(0.0)), 6).alias("residual"))


@query("""WITH p AS (SELECT c_custkey AS k, (c_custkey * 7919 % 5000)::DOUBLE AS x, (c_custkey * 104729 % 5000)::DOUBLE AS y FROM customer), g AS (SELECT (s_suppkey * 6101 % 5000)::DOUBLE AS gx, (s_suppkey * 3571 % 5000)::DOUBLE AS gy FROM supplier)
SELECT count(*) AS points, round(avg(CASE WHEN EXISTS (SELECT 1 FROM g WHERE pow(x - gx, 2) + pow(y - gy, 2) <= 40000) THEN 1.0::DOUBLE ELSE 0 END), 8) AS share FROM p""")
def register_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, m: (F.col(k) * m % 5000).cast("double")
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), at("c_custkey", 7919).alias("x"), at("c_custkey", 104_729).alias("y"))
    g = table(spark, sf_dir, "supplier").select(at("s_suppkey", 6101).alias("gx"), at("s_suppkey", 3571).alias("gy"))
    near = spatial.near_places(g, p, "gx", "gy", "x", "y", 200.0).select("x", "y").distinct()
    return spatial.overlap_share(p.join(near, ["x", "y"]), p, "k").withColumn("share", r("share"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_type AS stage, sum(value) AS ms FROM e GROUP BY 1, 2) SELECT user_id, round(sum(ms) FILTER (stage NOT LIKE '%.%' AND stage <> 'view'), 4) AS total_ms, count(*) AS stages FROM s GROUP BY 1""")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of a run's top-level stages, from a map of stage to time."""
    s = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("value").alias("ms"))
    m = s.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ms"))).alias("m"))
    top = F.map_filter("m", lambda k, _: ~k.contains(".") & (k != "view"))
    return m.select("user_id", r(F.aggregate(F.map_values(top), F.lit(0.0), lambda a, x: a + x), 4).alias("total_ms"), F.size("m").cast("long").alias("stages"))


@query("""SELECT o_orderkey, round(exp(-(epoch(TIMESTAMP '2002-01-01' - o_orderdate) / 86400) / 900.0) * (o_totalprice / 500000) + (1 - exp(-(epoch(TIMESTAMP '2002-01-01' - o_orderdate) / 86400) / 900.0)) * 0.1, 8) AS beta FROM orders""")
def relaxed_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.lit(11_688 * 86_400_000_000) - scalar.micros("o_orderdate")) / 86_400_000_000  # 2002-01-01 is day 11,688
    return table(spark, sf_dir, "orders").select("o_orderkey", r(recurrence.relaxed(F.col("o_totalprice") / 500_000, 0.1, days, 900.0)).alias("beta"))


@query(f"""WITH {EVENTS}, l AS (SELECT event_type AS topic, us AS seq, event_id, row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM e) SELECT topic, event_id, n AS age, greatest(c - 200, 0) AS dropped FROM l WHERE n <= 200""")
def topic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 events of each topic, and how many older ones were dropped."""
    w = Window.partitionBy("event_type").orderBy(F.desc("us"), F.desc("event_id"))
    e = events(spark, sf_dir).select(F.col("event_type"), "us", "event_id")
    kept = e.withColumn("age", F.row_number().over(w)).where("age <= 200")
    totals = e.groupBy("event_type").agg(F.greatest(F.count("*") - 200, F.lit(0)).alias("dropped"))
    return kept.join(totals, "event_type").select(F.col("event_type").alias("topic"), "event_id", F.col("age").cast("long").alias("age"), "dropped")


@query(f"""WITH {EVENTS}, c AS (SELECT *, CAST(floor(us / 300000000) AS BIGINT) AS cycle FROM e WHERE us <= 1705276800000000) SELECT cycle, count(*) AS fired, min(event_id) AS first_event FROM c GROUP BY 1""")
def replay_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each five-minute cycle of a replay fires, nothing from after its cut-off."""
    e = events(spark, sf_dir).where("us <= 1705276800000000").withColumn("cycle", scalar.slot(F.col("us"), 300))
    return e.groupBy("cycle").agg(F.count("*").alias("fired"), F.min("event_id").alias("first_event"))


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, event_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM e) SELECT user_id, count(*) AS requests, count(*) FILTER (n > 2) AS refused FROM k GROUP BY 1""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-21_600_000_000, 0)
    return events(spark, sf_dir).withColumn("n", F.count("*").over(w)).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("n") > 2).alias("refused"))


@query(f"""WITH {EVENTS}, s AS (SELECT DISTINCT event_type, CAST(ceil(us / 300000000) * 300000000 AS BIGINT) AS step FROM e) SELECT s.event_type, s.step AS us, max(e.us) AS frame FROM s JOIN e ON e.event_type = s.event_type AND e.us <= s.step AND e.us >= s.step - 600000000 GROUP BY 1, 2""")
def held_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame held at each five-minute step that follows a frame; one more than ten minutes old would be an error."""
    frames = events(spark, sf_dir).select("event_type", "us", F.col("us").alias("frame")).distinct()
    steps = frames.select("event_type", (F.ceil(F.col("us") / 300_000_000) * 300_000_000).cast("long").alias("us")).distinct()
    return temporal.held(steps, frames, ["event_type"], "us", "frame", 600_000_000)


@query(f"""WITH {EVENTS}, f AS (SELECT event_type, hour FROM e GROUP BY 1, 2), c AS (SELECT a.event_type, a.hour AS cycle, b.hour AS frame, row_number() OVER (PARTITION BY a.event_type, a.hour ORDER BY b.hour DESC) AS n FROM f a JOIN f b ON a.event_type = b.event_type AND b.hour <= a.hour AND b.hour > a.hour - 12) SELECT event_type, cycle, CAST(count(*) AS BIGINT) AS frames, min(frame) AS oldest FROM c WHERE n <= 3 GROUP BY 1, 2""")
def last_three_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events(spark, sf_dir).select("event_type", "hour").distinct()
    w = Window.partitionBy("event_type").orderBy("hour").rangeBetween(-11, 0)
    last = F.slice(F.reverse(F.array_sort(F.collect_list("hour").over(w))), 1, 3)
    return f.withColumn("last", last).select("event_type", F.col("hour").alias("cycle"), F.size("last").cast("long").alias("frames"), F.array_min("last").alias("oldest"))


@query("""WITH RECURSIVE ed AS (SELECT DISTINCT l_suppkey AS dst, l_partkey + 1000000 AS src FROM lineitem UNION SELECT DISTINCT l_partkey + 1000000, l_orderkey + 9000000 FROM lineitem), h(node, hop) AS (SELECT 3::BIGINT, 0 UNION SELECT src, hop + 1 FROM h JOIN ed ON node = dst WHERE hop < 2) SELECT node, min(hop) AS hop FROM h GROUP BY 1""")
def upstream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that drain to node 3 within two pipes, walking against the flow."""
    l = table(spark, sf_dir, "lineitem")
    part = (F.col("l_partkey") + 1_000_000).alias
    pipes = l.select(part("src"), F.col("l_suppkey").alias("dst")).union(l.select((F.col("l_orderkey") + 9_000_000).alias("src"), part("dst"))).distinct()
    return graph.hops(pipes.select(F.col("dst").alias("src"), F.col("src").alias("dst")), graph.start_nodes(spark, [3]), 2)


@query("""WITH x AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey, CAST(n AS INTEGER) AS position FROM x WHERE n <= 3""")
def worst_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.band_rank(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey", 3).select("s_nationkey", "s_suppkey", "position")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING sha256(string_agg(n_name, '' ORDER BY n_name)) <> sha256('ALGERIAETHIOPIAKENYAMOROCCOMOZAMBIQUE'))""")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    digest = n.groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), ""), 256).alias("d"))
    fresh = digest.where(F.col("d") == F.sha2(F.lit("ALGERIAETHIOPIAKENYAMOROCCOMOZAMBIQUE"), 256)).select("n_regionkey")
    return n.join(fresh, "n_regionkey", "left_anti").select("n_nationkey", "n_name")


@query()
def emulator_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each segment the reservoirs that follow its series best; the tests hold the fit against a plain one."""
    s = events(spark, sf_dir).groupBy("user_id", "hour").agg((F.avg("value") / 10).alias("rain"), (F.max("value") / 5).alias("depth"))
    return recurrence.fit_reservoirs(s, "user_id", "hour", "depth", "rain").withColumns({c: r(c, 6) for c in ("k", "gain", "drain", "mse")})


@query()
def emulator_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservoirs of each fifth of the users, days as storms: fitted above the base state, judged on the last two days; the tests hold it against a plain one."""
    e = events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("place"), F.floor(F.col("hour") / 24).alias("day"), (F.col("hour") % 24).alias("step"))
    s = e.agg((F.avg("value") / 10).alias("rain"), (F.max("value") / 4).alias("depth"))
    return recurrence.emulator(s, "place", "day", "step", "depth", "rain").withColumns({c: r(c, 6) for c in ("k", "gain", "drain", "rmse", "csi")})


@query("""WITH m AS (SELECT s_suppkey, k AS member, k % 4 AS weather, CAST(('0x' || substr(sha256(s_suppkey || '|' || k), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS u FROM supplier CROSS JOIN range(10) t(k)) SELECT s_suppkey, member, weather, round(least(greatest(0.3 + (u - 0.5) * 2, 0), 1), 8) AS beta FROM m""")
def member_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten members per pipe: weather in turn, a blockage drawn from a hash and clipped."""
    m = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("member"))
    u = scalar.unit_interval(F.concat_ws("|", "s_suppkey", "member"))
    return m.select("s_suppkey", "member", (F.col("member") % 4).alias("weather"), r(calibrate.clamp(0.3 + (u - 0.5) * 2, 0.0, 1.0)).alias("beta"))


@query("""WITH s AS (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS step, sum(l_quantity) AS depth FROM lineitem GROUP BY 1, 2), r AS (SELECT l_suppkey, step + 2 AS step, depth * 0.2 AS saved FROM s) SELECT s.l_suppkey, s.step, round(greatest(s.depth - coalesce(saved, 0), 0), 6) AS depth FROM s LEFT JOIN r ON s.l_suppkey = r.l_suppkey AND s.step = r.step""")
def pump_arrival_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("step")).agg(F.sum("l_quantity").alias("depth"))
    saved = s.select(F.col("l_suppkey"), (F.col("step") + 2).alias("step"), (F.col("depth") * 0.2).alias("saved"))
    return s.join(saved, ["l_suppkey", "step"], "left").select("l_suppkey", "step", r(F.greatest(F.col("depth") - F.coalesce("saved", F.lit(0.0)), F.lit(0.0)), 6).alias("depth"))


@query("""WITH d AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, l_returnflag AS way FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY u, v) AS n FROM d) SELECT u, v, 'S' || way || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS segment_id FROM k""")
def segment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("u"), F.greatest("l_partkey", "l_suppkey").alias("v"), F.col("l_returnflag").alias("way")).distinct()
    return temporal.numbered(d, ["way"], ["u", "v"]).select("u", "v", F.format_string("S%s-%03d", "way", "n").alias("segment_id"))


@query("""WITH n AS (SELECT n_regionkey, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), q AS (SELECT *, 20.0::DOUBLE * c / sum(c) OVER () AS exact FROM n), f AS (SELECT *, greatest(floor(exact), 1) AS base FROM q), k AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, n_regionkey) AS rnk, CAST(20 - sum(base) OVER () AS BIGINT) AS spare FROM f)
SELECT n_regionkey, CAST(base + CASE WHEN rnk <= spare THEN 1 ELSE 0 END AS BIGINT) AS seats FROM k""")
def proportional_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pumps dealt to the regions by their customers, one at least, the rest to the largest remainders."""
    n = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("c"))
    every = Window.partitionBy()  # of one row per region
    q = n.withColumn("exact", 20.0 * F.col("c") / F.sum("c").over(every)).withColumn("base", F.greatest(F.floor("exact"), F.lit(1)))
    q = q.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), "n_regionkey"))).withColumn("spare", 20 - F.sum("base").over(every))
    return q.select("n_regionkey", (F.col("base") + (F.col("rnk") <= F.col("spare")).cast("int")).cast("long").alias("seats"))


@query("""SELECT l_returnflag, round(CASE WHEN sum(l_extendedprice) > 0 AND sum(l_quantity) <= 1e12 THEN (1e12 - sum(l_quantity)) / sum(l_extendedprice) END, 6) AS scale FROM lineitem GROUP BY 1""")
def scale_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.scale_to(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 1e12).withColumn("scale", r("scale", 6))


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, (user_id % 5) / 4.0::DOUBLE AS class, max(value) AS near, count(*) AS n FROM e GROUP BY 1) SELECT user_id, round(least(1, greatest(0, 0.5 * class + 0.3 * greatest(0, 1 - near / 300) + 0.2 * least(1, n / 40.0::DOUBLE))), 8) AS weight FROM d""")
def exposure_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("user_id").agg(F.max("value").alias("near"), F.count("*").alias("n"))
    w = 0.5 * (F.col("user_id") % 5) / 4.0 + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("near") / 300) + 0.2 * F.least(F.lit(1.0), F.col("n") / 40.0)
    return d.select("user_id", r(calibrate.clamp(w, 0.0, 1.0)).alias("weight"))


@query()
def one_dimensional_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four centres over prices; the tests hold them against a plain version."""
    return calibrate.clusters(table(spark, sf_dir, "orders"), "o_totalprice", 4)


@query()
def reach_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of what each kind of line reaches in quantity and price; the tests hold it against a plain version."""
    hull = hulls.convex_hulls(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return hull.select("l_returnflag", "l_linestatus", "n_points", "n_corners", r("area", 4).alias("area"))
