"""Scenario queries: blends, bands, attribution, plans, corridors, bundle findings and the functions of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import scalar
from freshet.operators import quality, scenario, spatial, temporal
from freshet.plans.catalog import EVENTS, events, query, r, table


@query(f"""WITH {EVENTS}, m AS (SELECT event_type, avg(value) AS model FROM e GROUP BY 1) SELECT event_id, round(greatest(exp(-(hour % 36 + 1) * 5 / 60.0::DOUBLE) * coalesce(value, 0) + (1 - exp(-(hour % 36 + 1) * 5 / 60.0::DOUBLE)) * model, 0), 6) AS rain FROM e JOIN m USING (event_type)""")
def blended_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nowcast and model blended by lead."""
    e = events(spark, sf_dir)
    model = e.groupBy("event_type").agg(F.avg("value").alias("model"))
    lead = (F.col("hour") % 36 + 1) * 5
    return e.join(F.broadcast(model), "event_type").select("event_id", r(scenario.blend(F.col("value"), F.col("model"), lead), 6).alias("rain"))  # a row for each type


@query("""WITH c AS (SELECT l_suppkey AS unit, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS v FROM lineitem) SELECT unit, round(avg(v), 8) AS mean, max(v) AS max FROM c GROUP BY 1""")
def unit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest cell of each unit; every third line's cell is not a number."""
    v = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), v.alias("v"))
    return scenario.unit_stats(c, "unit", "v").withColumn("mean", r("mean"))


@query("""SELECT o_custkey, round(stddev_samp(o_totalprice), 4) AS sd, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY round(stddev_samp(o_totalprice), 4), o_custkey LIMIT 400""")
def sharpest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 customers whose orders spread least."""
    sd = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(r(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.count("*").alias("n")).where("n > 1")
    return sd.orderBy("sd", "o_custkey").limit(400)


@query("""WITH f AS (SELECT l_partkey AS node, arg_min(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber)) AS v FROM lineitem GROUP BY 1) SELECT p_brand AS segment, min(v) AS v FROM part JOIN f ON node = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1""")
def design_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest first pipe under each segment."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("segment"))
    return scenario.first_edge_least(nodes, edges, "node", "segment", ["l_orderkey", "l_linenumber"], "v")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(epoch_us(o_orderdate) AS BIGINT) AS us, o_orderstatus <> 'P' AS usable FROM orders), p AS (SELECT a.o_orderkey, arg_min(b.o_orderkey, struct_pack(t := -b.us, k := b.o_orderkey)) AS previous FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.usable AND b.us < a.us AND b.us >= a.us - 15552000000000 GROUP BY 1) SELECT o_orderkey, previous FROM o LEFT JOIN p USING (o_orderkey)""")
def previous_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's predecessor of the same customer within 180 days that has a record."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", scalar.micros("o_orderdate").alias("us"), (F.col("o_orderstatus") != "P").alias("usable"))
    return temporal.previous_record(o, "o_custkey", "us", "o_orderkey", "usable", 180 * 86_400_000_000).select("o_orderkey", "previous")


@query("""WITH g AS (SELECT p_partkey, p_size - 25 AS gain FROM part), k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM g WHERE gain > 0) SELECT p_partkey, CAST((n - 1) // 100 AS BIGINT) AS chunk FROM k""")
def active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a gain, in chunks of a hundred."""
    g = table(spark, sf_dir, "part").where("p_size - 25 > 0").select("p_partkey", F.lit(0).alias("k"))
    return temporal.numbered(g, ["k"], ["p_partkey"]).select("p_partkey", F.floor((F.col("n") - 1) / 100).alias("chunk"))


@query("""WITH m AS (SELECT l_suppkey AS segment, l_quantity AS full_cm, l_quantity * 0.8::DOUBLE AS sky_cm, 20 + l_discount * 100 AS params_cm, l_quantity * (1 - l_tax) AS clean_cm FROM lineitem), b AS (SELECT segment, max(full_cm) AS top, quantile_cont(full_cm, 0.9) - quantile_cont(full_cm, 0.1) AS f, quantile_cont(sky_cm, 0.9) - quantile_cont(sky_cm, 0.1) AS s, quantile_cont(params_cm, 0.9) - quantile_cont(params_cm, 0.1) AS p, quantile_cont(clean_cm, 0.9) - quantile_cont(clean_cm, 0.1) AS c FROM m GROUP BY 1 HAVING max(full_cm) >= 15),
w AS (SELECT avg(f) AS f, avg(s) AS s, avg(p) AS p, avg(c) AS c FROM b), u AS (SELECT 'full_cm' AS scenario, f AS width, f FROM w UNION ALL SELECT 'sky_cm', s, f FROM w UNION ALL SELECT 'params_cm', p, f FROM w UNION ALL SELECT 'clean_cm', c, f FROM w) SELECT scenario, round(width, 6) AS width, round(width / f, 6) AS share FROM u""")
def spread_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the width of the band owes to the sky, to the parameters and to blockage."""
    q = F.col("l_quantity")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("segment"), q.alias("full_cm"), (q * 0.8).alias("sky_cm"), (20 + F.col("l_discount") * 100).alias("params_cm"), (q * (1 - F.col("l_tax"))).alias("clean_cm"))
    out = scenario.decomposition(m, "segment", "full_cm", ["sky_cm", "params_cm", "clean_cm"], 15.0)
    return out.withColumns({"width": r("width", 6), "share": r("share", 6)})


@query("""WITH d AS (SELECT l_suppkey AS target, CAST(year(l_shipdate) AS BIGINT) AS step, l_partkey % 20 AS pipe, l_quantity AS q FROM lineitem), b AS (SELECT target, step, sum(q) AS depth FROM d GROUP BY 1, 2), o AS (SELECT target, step, pipe, sum(q) * 0.5 AS less FROM d GROUP BY 1, 2, 3),
x AS (SELECT b.target, p.pipe, b.step, depth, coalesce(less, 0) AS less FROM b JOIN (SELECT DISTINCT target, pipe FROM d) p ON b.target = p.target LEFT JOIN o ON o.target = b.target AND o.step = b.step AND o.pipe = p.pipe),
s AS (SELECT target, pipe, max(depth) - max(greatest(depth - less, 0)) AS effect FROM x GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY effect DESC, pipe) AS n FROM s WHERE effect >= 0.05), t AS (SELECT * FROM k WHERE n <= 5),
a AS (SELECT x.target, x.step, max(x.depth) AS depth, sum(CASE WHEN t.pipe IS NULL THEN 0 ELSE less END) AS less FROM x LEFT JOIN t ON x.target = t.target AND x.pipe = t.pipe GROUP BY 1, 2), c AS (SELECT target, max(depth) - max(greatest(depth - less, 0)) AS combined FROM a GROUP BY 1)
SELECT target, pipe, CAST(n AS INTEGER) AS position, round(effect, 6) AS effect, round(combined, 6) AS combined FROM t JOIN c USING (target)""")
def attributed_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pipes whose cleaning lowers each junction's peak most, and what all five do together."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), F.year("l_shipdate").cast("long").alias("step"), (F.col("l_partkey") % 20).alias("pipe"), F.col("l_quantity").alias("q"))
    depth = d.groupBy("target", "step").agg(F.sum("q").alias("depth"))
    own = d.groupBy("target", "step", "pipe").agg((F.sum("q") * 0.5).alias("less"))
    return scenario.attribution(own.join(depth, ["target", "step"]), "target", "pipe", "step", "depth", "less", most=5).withColumns({"effect": r("effect", 6), "combined": r("combined", 6)})


@query("""WITH b AS (SELECT l_suppkey AS pipe, max(l_discount) * 5 AS beta FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY beta DESC, pipe) AS n FROM b) SELECT pipe, round(CASE WHEN n <= 14 THEN 0.05 ELSE beta END, 8) AS beta FROM k""")
def cleaned_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockages after the fourteen worst pipes are cleaned to 5 %."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pipe")).agg((F.max("l_discount") * 5).alias("beta"))
    worst = b.orderBy(F.desc("beta"), "pipe").limit(14).select(F.col("pipe").alias("_worst"))
    met = b.join(F.broadcast(worst), F.col("pipe") == F.col("_worst"), "left")  # fourteen rows
    return met.select("pipe", r(F.when(F.col("_worst").isNotNull(), 0.05).otherwise(F.col("beta"))).alias("beta"))


@query("""WITH p AS (SELECT o_orderkey AS seq, o_custkey AS pump, o_orderkey % 40 AS place, (o_orderkey * 7 % 60)::DOUBLE AS travel FROM orders), f AS (SELECT c_custkey AS pump, CASE WHEN c_custkey % 7 = 0 THEN 'withheld' ELSE 'ready' END AS status, (c_custkey % 5 + 1)::DOUBLE AS rate FROM customer WHERE c_custkey % 11 <> 0),
j AS (SELECT p.*, rate, CASE WHEN f.pump IS NULL THEN 'unknown' WHEN status <> 'ready' THEN 'withheld' WHEN row_number() OVER (PARTITION BY p.pump ORDER BY seq) > 1 THEN 'placed twice' END AS refused FROM p LEFT JOIN f ON p.pump = f.pump),
t AS (SELECT *, sum(rate) OVER (PARTITION BY place ORDER BY travel, pump ROWS UNBOUNDED PRECEDING) AS total FROM j WHERE refused IS NULL), m AS (SELECT seq, pump, place, refused, 90 * (1 - exp(-total / 10)) AS saved, travel FROM t)
SELECT seq, pump, place, refused, round(saved - coalesce(lag(saved) OVER (PARTITION BY place ORDER BY travel, pump), 0), 6) AS minutes FROM m UNION ALL SELECT seq, pump, place, refused, 0.0 FROM j WHERE refused IS NOT NULL""")
def priced_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-made plan: what each pump adds where it stands, and which are refused."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("pump"), (F.col("o_orderkey") % 40).alias("place"), (F.col("o_orderkey") * 7 % 60).cast("double").alias("travel"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0")
    fleet = c.select(F.col("c_custkey").alias("pump"), F.when(F.col("c_custkey") % 7 == 0, "withheld").otherwise("ready").alias("status"), (F.col("c_custkey") % 5 + 1).cast("double").alias("rate"))
    return scenario.price_plan(p, fleet, 90 * (1 - F.exp(-F.col("total") / 10))).withColumn("minutes", r("minutes", 6))


@query("""WITH l AS (SELECT o_custkey AS trip, l_orderkey AS route, l_linenumber AS place, l_suppkey AS segment, (l_partkey % 3 + 1) AS lanes, l_quantity / 10 AS minutes, l_discount * 5 AS p, l_tax * 500 AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT DISTINCT s_suppkey AS shut FROM supplier WHERE s_suppkey % 13 = 0),
r AS (SELECT trip, route, string_agg(segment, '>' ORDER BY place, segment) AS corridor, min(lanes / (1 + 2 * greatest(0, least(1, (depth - 5) / 25.0::DOUBLE)))) AS least_left, sum(minutes) AS minutes, max(p) AS worst, bool_or(shut IS NOT NULL) AS closed FROM l LEFT JOIN c ON segment = shut GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY trip, corridor ORDER BY route) AS n FROM r WHERE NOT closed AND worst < 0.45), k AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY route) AS position FROM f WHERE n = 1), q AS (SELECT *, least_left / greatest(minutes, 1.0::DOUBLE / 60) AS capacity FROM k WHERE position <= 3)
SELECT trip, route, CAST(position AS INTEGER) AS position, round(minutes, 6) AS minutes, worst, round(capacity, 8) AS capacity, round(capacity / sum(capacity) OVER (PARTITION BY trip), 8) AS share FROM q""")
def safe_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the routes of a trip: the safe ones, and how its traffic is spread over them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("trip"))
    legs = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "trip", F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("segment"), (F.col("l_partkey") % 3 + 1).alias("lanes"),
        (F.col("l_quantity") / 10).alias("minutes"), (F.col("l_discount") * 5).alias("p"), (F.col("l_tax") * 500).alias("depth"),
    )
    closed = table(spark, sf_dir, "supplier").where("s_suppkey % 13 = 0").select(F.col("s_suppkey").alias("segment"))
    out = scenario.corridors(legs, closed, 0.45, 1 - 1 / scalar.slowdown(F.col("depth"), 30.0))
    return out.withColumns({"minutes": r("minutes", 6), "capacity": r("capacity"), "share": r("share")})


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, hour, avg(value) AS d FROM e GROUP BY 1, 2), b AS (SELECT user_id, hour, min(value) AS d FROM e WHERE event_type <> 'view' GROUP BY 1, 2), s AS (SELECT user_id, hour, min(value) * 0.5 AS d FROM e WHERE event_type <> 'click' GROUP BY 1, 2)
SELECT user_id, hour, round(greatest(p.d + coalesce(s.d, 0) - coalesce(b.d, 0), 0), 6) AS d FROM p LEFT JOIN b USING (user_id, hour) LEFT JOIN s USING (user_id, hour)""")
def levelled_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    by = lambda d, v: d.groupBy("user_id", "hour").agg(v.alias("d"))
    out = scenario.levelled(by(e, F.avg("value")), by(e.where("event_type <> 'view'"), F.min("value")), by(e.where("event_type <> 'click'"), F.min("value") * 0.5), ["user_id", "hour"], "d")
    return out.withColumn("d", r("d", 6))


@query("""WITH c AS (SELECT p_partkey AS cell, (p_partkey * 37 % 997)::DOUBLE AS x, (p_partkey * 53 % 991)::DOUBLE AS y FROM part), s AS (SELECT s_suppkey AS segment, (s_suppkey * 71 % 997)::DOUBLE AS x1, (s_suppkey * 29 % 991)::DOUBLE AS y1, (s_suppkey * 71 % 997 + s_suppkey % 9 * 12)::DOUBLE AS x2, (s_suppkey * 29 % 991 + s_suppkey % 7 * 12)::DOUBLE AS y2 FROM supplier),
t AS (SELECT *, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0))) AS t FROM c CROSS JOIN s), d AS (SELECT segment, cell, sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)) AS distance FROM t)
SELECT segment, cell, round(distance, 8) AS distance FROM d WHERE distance <= 15""")
def segment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within 15 m of a street segment."""
    at = lambda k, m, n: (F.col(k) * m % n).cast("double")
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), at("p_partkey", 37, 997).alias("x"), at("p_partkey", 53, 991).alias("y"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment"), at("s_suppkey", 71, 997).alias("x1"), at("s_suppkey", 29, 991).alias("y1"))
    s = s.withColumns({"x2": F.col("x1") + F.col("segment") % 9 * 12, "y2": F.col("y1") + F.col("segment") % 7 * 12})
    return spatial.near_segments(c, s, "cell", "segment", "x", "y", 15.0, 30.0, 8)


@query(f"""WITH {EVENTS}, g AS (SELECT event_type, us < lag(us) OVER (PARTITION BY event_type ORDER BY event_id) AS back FROM e), f AS (SELECT 'members' AS rule, 'error' AS level, 'gauge' AS subject, 1 AS n
UNION ALL SELECT 'monotone', 'error', event_type, count(*) FROM g WHERE back GROUP BY 3 UNION ALL SELECT 'window', 'error', 'us', count(*) FROM e WHERE NOT us BETWEEN 1704153600000000 AND 1706400000000000
UNION ALL SELECT 'grid', 'error', 'value', CASE WHEN (SELECT min(value) FROM e WHERE event_id % 2 = 0) IS DISTINCT FROM (SELECT min(value) FROM e WHERE event_id % 2 = 1) OR (SELECT max(value) FROM e WHERE event_id % 2 = 0) IS DISTINCT FROM (SELECT max(value) FROM e WHERE event_id % 2 = 1) THEN 1 ELSE 0 END
UNION ALL SELECT 'flagged', 'error', 'flag', count(*) FROM e WHERE event_id % 17 = 0 UNION ALL SELECT 'cited', 'warning', 'source', count(*) FROM e WHERE event_id % 19 = 0 OR event_id % 23 = 0 UNION ALL SELECT 'basis', 'error', 'basis', count(*) FROM e WHERE event_id % 29 = 0
UNION ALL SELECT 'units', 'error', 'unit', count(*) FROM e WHERE event_id % 31 = 0 UNION ALL SELECT 'count', 'warning', 'pins', 2000000 - (SELECT count(*) FROM e) UNION ALL SELECT 'floor', 'error', 'pins', 100 - (SELECT count(*) FROM e)) SELECT rule, level, subject, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""")
def bundle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a bundle: members, time axis, grids, flags, sources, units and counts."""
    e = events(spark, sf_dir)
    is_ = lambda m: F.col("event_id") % m == 0
    e = e.withColumns({
        "flag": F.when(~is_(17), True), "source": F.when(is_(23), " ").when(~is_(19), "log"), "basis": F.when(~is_(29), "measured"), "unit": F.when(is_(31), "inch").otherwise("mm"),
    })
    return quality.findings(
        quality.members(e, "event_type", ["click", "error", "gauge", "purchase", "signup", "view"]),
        quality.not_monotone(e, ["event_type"], "event_id", "us"),
        quality.outside_window(e, "us", 1_704_153_600_000_000, 1_706_400_000_000_000),
        quality.disagreeing(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["value"]),
        quality.unflagged(e, "flag"),
        quality.uncited(e, "source"),
        quality.uncited(e, "basis", "basis", "error"),
        quality.other_units(e, "unit", ["mm", "cm"]),
        quality.too_few(e, "pins", 2_000_000),
        quality.too_few(e, "pins", 100, "floor", "error"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE / 10 AS h, p_size::DOUBLE / 25 AS d, 0.002::DOUBLE + p_partkey % 10 / 1000.0::DOUBLE AS s, (p_partkey % 9 + 1)::DOUBLE AS a, (p_partkey % 5 + 1)::DOUBLE AS b FROM part)
SELECT k, round(0.67 * 0.5 * sqrt(2 * 9.81 * h), 6) AS orifice, round(least(1.66 * 2 * pow(h, 1.5), 0.67 * 0.4 * sqrt(2 * 9.81 * h)), 6) AS inlet, round(pi() / 4 * d * d * pow(d / 4, 2.0 / 3) * sqrt(s) / 0.015, 6) AS pipe, round(a * d * pow(a * d / (2 * (a + d)), 2.0 / 3) * sqrt(s) / 0.015, 6) AS box, round(a * 1000 * h / 3.6e6, 10) AS peak_flow,
round(a / (a + b), 8) AS prior_mean, round(sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), 8) AS prior_sd, round(ln(a / (a + b) / (1 - a / (a + b))), 8) AS logit, round(1 / (1 + exp(-h)), 8) AS sigmoid, CASE WHEN h >= 0.1 THEN round(10 * log10(h), 8) ELSE -15 END AS dbr, h > 0 AND h / 100 * d * 50 >= 0.5 AS hazard FROM p""")
def hydraulic_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("k"), (F.col("p_size").cast("double") / 10).alias("h"), (F.col("p_size").cast("double") / 25).alias("d"), (0.002 + k % 10 / 1000.0).alias("s"), (k % 9 + 1).cast("double").alias("a"), (k % 5 + 1).cast("double").alias("b"))
    h, d, s, a, b = (F.col(c) for c in "hdsab")
    mean, sd = scalar.beta_moments(a, b)
    return p.select(
        "k", r(scalar.orifice_flow(h, 0.5), 6).alias("orifice"), r(scalar.inlet_flow(h, F.lit(2.0), F.lit(0.4)), 6).alias("inlet"), r(scalar.pipe_flow(d, s), 6).alias("pipe"), r(scalar.box_flow(a, d, s), 6).alias("box"), r(scalar.rational_peak(a * 1000, h), 10).alias("peak_flow"),
        r(mean).alias("prior_mean"), r(sd).alias("prior_sd"), r(scalar.logit(mean)).alias("logit"), r(scalar.sigmoid(h)).alias("sigmoid"), r(scalar.to_dbr(h)).alias("dbr"), scalar.pedestrian_hazard(h, d * 50).alias("hazard"),
    )


@query("""WITH p AS (SELECT c_custkey AS k, (c_custkey * 7 % 170)::DOUBLE AS lon, (c_custkey * 11 % 80)::DOUBLE AS lat, (c_custkey % 30)::DOUBLE AS v, (c_custkey * 13 % 360)::DOUBLE AS a FROM customer)
SELECT k, round(2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(19 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(19)) * pow(sin(radians(72.8 - lon) / 2), 2)))), 2) AS metres, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS tile_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024) AS BIGINT) AS tile_y,
round(-v * sin(radians(a)), 8) AS u_east, round(-v * cos(radians(a)), 8) AS v_north, CAST((CAST(floor((degrees(atan2(lon - 72.8, lat - 19)) + 22.5) / 45) AS BIGINT) + 8) % 8 AS INTEGER) AS octant FROM p""")
def geo_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("k"), (k * 7 % 170).cast("double").alias("lon"), (k * 11 % 80).cast("double").alias("lat"), (k % 30).cast("double").alias("v"), (k * 13 % 360).cast("double").alias("a"))
    lon, lat = F.col("lon"), F.col("lat")
    tile, wind = scalar.tile_index(lon, lat, 10), scalar.wind_vector(F.col("v"), F.col("a"))
    far = scalar.haversine(lon, lat, F.lit(72.8), F.lit(19.0))
    return p.select("k", r(far, 2).alias("metres"), tile[0].alias("tile_x"), tile[1].alias("tile_y"), r(wind[0]).alias("u_east"), r(wind[1]).alias("v_north"), scalar.bearing_octant(lon - 72.8, lat - 19).alias("octant"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_extract(p_name || ' road (old); ' || p_brand, '^[^;(/,]*'), '\\s+', ' ', 'g')) AS street, repeat('*', 6) || right(CAST(9000000000 + p_partkey AS VARCHAR), 4) AS phone, 'MUM' AS city, CASE WHEN p_partkey % 2 = 0 THEN 'baked' ELSE 'live' END AS mode FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    run = F.concat(F.lit("MUM-20190702T0310Z-sky1.0-twin1.0-"), F.when(F.col("p_partkey") % 2 == 0, "baked").otherwise("live"))
    parts = scalar.run_id_parts(run)
    phone = scalar.masked_number((F.lit(9_000_000_000) + F.col("p_partkey")).cast("string"))
    return p.select("p_partkey", scalar.street_name(F.concat("p_name", F.lit(" road (old); "), "p_brand")).alias("street"), phone.alias("phone"), parts["city"].alias("city"), parts["mode"].alias("mode"))
