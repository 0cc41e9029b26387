"""Stream and source queries: each stream runs over all its input, each file format is written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import scalar
from freshet.plans.catalog import EVENTS, events, query, r, table
from freshet.sources import feeds
from freshet.sources.storage import shared_folder
from freshet.streaming import cycles


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.event_stream(spark, sf_dir, "events.parquet")


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.to_table(cycles.tumbling(_stream(spark, sf_dir), 5, "10 minutes", "event_type"), "complete").withColumn("total", r("total", 6))


@query(f"""WITH {EVENTS}, w AS (SELECT event_type, value, (floor((us - 1) / 1800000000) + k) * 1800000000 AS stop FROM e CROSS JOIN (VALUES (1), (2)) t(k))
SELECT CAST(stop AS BIGINT) AS end, event_type, count(*) AS n, max(value) AS peak FROM w GROUP BY 1, 2""".replace("AS end", 'AS "end"'))
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.to_table(cycles.sliding(_stream(spark, sf_dir), 60, 30, "10 minutes", "event_type"), "complete")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(us) AS start, max(us) + 21600000000 AS end, user_id, count(*) AS n FROM g GROUP BY user_id, k""".replace("AS end", 'AS "end"'))
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.timestamp_micros(scalar.micros("ts")))
    return cycles.sessions(e, "6 hours", "user_id")


def _cycles(spark: SparkSession, sf_dir: str) -> str:
    """Hourly probabilities in two files, the earlier half first."""
    h = events(spark, sf_dir).groupBy("event_type", "hour").agg(F.least(F.avg("value") / 100, F.lit(1.0)).alias("p"))
    lo, hi = h.agg(F.min("hour"), F.max("hour")).first()
    folder = shared_folder(spark)
    for part in (h.where(F.col("hour") <= (lo + hi) // 2), h.where(F.col("hour") > (lo + hi) // 2)):
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


@query(f"""WITH RECURSIVE {EVENTS}, c AS (SELECT event_type, hour, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k, least(avg(value) / 100, 1.0::DOUBLE) AS p FROM e GROUP BY 1, 2),
s AS (SELECT event_type, k, hour, CASE WHEN p >= 0.6 THEN 'pending' ELSE 'none' END AS state, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS cycles, NULL::VARCHAR AS event FROM c WHERE k = 1
 UNION ALL SELECT c.event_type, c.k, c.hour,
  CASE WHEN p >= 0.6 THEN CASE WHEN s.state = 'raised' OR (s.state = 'pending' AND s.cycles + 1 >= 2) THEN 'raised' ELSE 'pending' END WHEN p > 0.3 AND s.state = 'raised' THEN 'raised' ELSE 'none' END,
  CASE WHEN p >= 0.6 THEN CASE WHEN s.state = 'none' THEN 1 ELSE s.cycles + 1 END WHEN p > 0.3 AND s.state = 'raised' THEN s.cycles + 1 ELSE 0 END,
  CASE WHEN p >= 0.6 AND s.state = 'pending' AND s.cycles + 1 >= 2 THEN 'raised' WHEN p <= 0.3 AND s.state = 'raised' THEN 'cleared' END
 FROM s JOIN c ON c.event_type = s.event_type AND c.k = s.k + 1)
SELECT event_type, hour, state, CAST(cycles AS INTEGER) AS cycles, event FROM s""")
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _cycles(spark, sf_dir)
    raw = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return cycles.to_table(cycles.hysteresis(raw, "event_type", "hour", "p"), "append")


@query()
def stream_report_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed reports folded to the kept one of their area; the tests hold it against the batch operator."""
    e = _stream(spark, sf_dir)
    reports = e.select("event_id", scalar.micros("ts").alias("us"), (F.col("value") * 3).alias("x"), (F.col("user_id") % 40 * 10.0).alias("y"), F.concat_ws("|", "event_type", F.dayofyear("ts")).alias("area"))
    return cycles.to_table(cycles.fold_reports(reports, "area", "event_id", "x", "y", "us", 50.0, 600_000_000), "append")


@query(f"""WITH {EVENTS} SELECT event_id, value, us FROM e""")
def csv_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV with offsets and read back, half of the rows in another zone."""
    e = events(spark, sf_dir)
    shift = F.when(F.col("event_id") % 2 == 0, 19_800_000_000).otherwise(0)
    text = F.concat(F.expr("date_format(timestampadd(MICROSECOND, _us, TIMESTAMP_NTZ'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"), F.when(F.col("event_id") % 2 == 0, "+05:30").otherwise("Z"))
    path = shared_folder(spark)
    e.withColumn("_us", F.col("us") + shift).select("event_id", text.alias("ts"), "value").write.option("header", True).csv(path)
    back = feeds.csv_series(spark, path, "event_id long, ts string, value double", "ts")
    return back.select("event_id", "value", F.unix_micros("ts").alias("us"))


@query("""SELECT user_id, event_type AS kind, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS unreadable FROM events WHERE event_id % 10 <> 3 GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, NULL, count(*) FROM events WHERE event_id % 10 = 3""")
def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ops log as JSON lines in which every tenth line is broken: the rows, and how many lines can't be read."""
    path = shared_folder(spark)
    row = F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("kind")))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(row).alias("value")).write.text(path)
    rows, bad = feeds.json_lines(spark, path, "event_id long, user_id long, kind string")
    good = rows.groupBy("user_id", "kind").agg(F.count("*").alias("n")).withColumn("unreadable", F.lit(0).cast("long"))
    return good.unionByName(bad.agg(F.count("*").alias("unreadable")), allowMissingColumns=True)


@query("""SELECT s_suppkey, s_name, (s_suppkey % 360 - 180)::DOUBLE AS lon, (s_suppkey % 180 - 90)::DOUBLE AS lat FROM supplier""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array((F.col("s_suppkey") % 360 - 180).cast("double"), (F.col("s_suppkey") % 180 - 90).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("s_suppkey", "s_name").alias("properties"))
    path = shared_folder(spark)
    tiles = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 4).alias("tile")).agg(F.collect_list(feature).alias("features"))  # a collection per tile
    tiles.select("tile", F.lit("FeatureCollection").alias("type"), "features").write.partitionBy("tile").json(path)  # a file each
    return feeds.geojson_points(spark, path, "s_suppkey: bigint, s_name: string").select("s_suppkey", "s_name", "lon", "lat")


@query("""WITH g AS (SELECT o_orderkey AS run, 'C' || o_custkey % 3 AS city, CAST(epoch_us(o_orderdate) AS BIGINT) AS cycle, o_orderkey AS created FROM orders), k AS (SELECT * FROM g WHERE city = 'C1' ORDER BY cycle DESC, created DESC LIMIT 25) SELECT run, city, cycle, created FROM k""")
def run_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("C"), F.col("o_custkey") % 3).alias("city"), scalar.micros("o_orderdate").alias("cycle"), F.col("o_orderkey").alias("created"))
    return feeds.runs(o, "C1", 25)


@query("""WITH g AS (SELECT CAST(epoch_us(o_orderdate) AS BIGINT) AS cycle, max(o_orderkey) AS run_id FROM orders GROUP BY 1), t AS (SELECT DISTINCT CAST(epoch_us(l_shipdate) AS BIGINT) - 40000000000000 AS instant FROM lineitem)
SELECT instant, coalesce(g.run_id, (SELECT arg_min(run_id, cycle) FROM g)) AS run_id FROM t ASOF LEFT JOIN g ON t.instant >= g.cycle""")
def run_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(scalar.micros("o_orderdate").alias("cycle")).agg(F.max("o_orderkey").alias("run_id"))
    return feeds.run_at(o, table(spark, sf_dir, "lineitem").select((scalar.micros("l_shipdate") - 40_000_000_000_000).alias("instant")), "instant")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_quantity <= 25) GROUP BY 1, 2""")
def partitioned_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product partitioned by flag, of which one partition is written again: only that one changes."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", "l_returnflag")
    path = shared_folder(spark)
    feeds.write_product(rows, path, "l_returnflag")
    feeds.write_product(rows.where("l_returnflag = 'N' and l_quantity > 25"), path, "l_returnflag")
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, h AS (SELECT user_id, hour, max(value) AS d, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM e GROUP BY 1, 2)
SELECT user_id, CAST(to_json(list(struct_pack(step := hour, depth_cm := round(d, 1), p := round(p, 2)) ORDER BY hour)) AS VARCHAR) AS series FROM h GROUP BY 1 HAVING max(d) >= 50""")
def wet_series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = events(spark, sf_dir).groupBy("user_id", "hour").agg(F.max("value").alias("d"), F.avg((F.col("value") > 50).cast("double")).alias("p"))
    return feeds.wet_json(h, "user_id", "hour", "d", "p", 50.0)
