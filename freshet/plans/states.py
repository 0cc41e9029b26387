"""Streams with state over the events table, cut into slices that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.plans.catalog import EVENTS, events, query, r, table
from freshet.sources import cube, runs
from freshet.sources.storage import shared_folder
from freshet.streaming import cycles, live, state

SLICES = 4
CYCLE_US = 3_600_000_000


@query(f"""WITH {EVENTS}, q AS (SELECT event_type AS clock, event_id AS seq, us + (event_id % 7) * 600000000 AS due, CASE event_id % 16 WHEN 3 THEN 'pause' WHEN 5 THEN 'play' WHEN 9 THEN 'seek' ELSE 'tick' END AS command, us FROM e),
p AS (SELECT *, coalesce(last_value(CASE WHEN command IN ('play', 'pause') THEN command = 'play' END IGNORE NULLS) OVER (PARTITION BY clock ORDER BY seq), false) AS playing FROM q),
t AS (SELECT clock, seq, us, max(us) OVER (PARTITION BY clock ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM p WHERE command = 'tick' AND playing),
f AS (SELECT p.clock, min(t.seq) AS seq, 'event' AS kind, p.seq AS item FROM p JOIN t ON t.clock = p.clock AND t.seq >= p.seq AND t.us >= p.due GROUP BY p.clock, p.seq)
SELECT * FROM f UNION ALL SELECT clock, seq, 'cycle', us // {CYCLE_US} FROM t WHERE ahead IS NULL OR us // {CYCLE_US} > ahead // {CYCLE_US}""")
def stream_replay_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock for each kind of event: every event is scheduled and then ticks, seeks back three hours, pauses or plays."""
    e = events(spark, sf_dir)
    command = F.when(F.col("event_id") % 16 == 3, "pause").when(F.col("event_id") % 16 == 5, "play").when(F.col("event_id") % 16 == 9, "seek").otherwise("tick")
    at = F.when(command == "seek", F.col("us") - 10_800_000_000).otherwise(F.col("us"))
    rows = e.select("event_type", F.col("event_id").alias("seq"), F.col("event_id").alias("event"), (F.col("us") + F.col("event_id") % 7 * 600_000_000).alias("due"), command.alias("command"), at.alias("at"))
    return cycles.to_table(state.replay(state.in_slices(rows, "seq", SLICES), "event_type", CYCLE_US), "append")


@query(f"""WITH {EVENTS}, f AS (SELECT DISTINCT event_type AS "key", us AS frame FROM e), n AS (SELECT *, row_number() OVER k AS n, lag(frame) OVER k AS last, lag(frame, 2) OVER k AS third FROM f WINDOW k AS (PARTITION BY "key" ORDER BY frame))
SELECT "key", frame, CAST(least(n, 3) AS INTEGER) AS frames, coalesce(third, last, frame) AS oldest, frame - last AS age, coalesce(frame - last > 600000000, false) AS stale, n >= 3 AS complete FROM n""")
def stream_frame_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three frames of each kind of event as each arrives, and those held for more than ten minutes."""
    frames = events(spark, sf_dir).select("event_type", "us")
    return cycles.to_table(state.ringed(state.in_slices(frames, "us", SLICES), "event_type", "us"), "append")


@query(f"""WITH RECURSIVE {EVENTS}, a AS (SELECT event_type AS topic, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM e),
t AS (SELECT topic, seq, n, row_number() OVER (PARTITION BY topic ORDER BY seq) AS i, n - coalesce(lag(n) OVER (PARTITION BY topic ORDER BY seq), 0) AS came FROM a WHERE seq % 25 = 0),
q(topic, i, seq, n, held, dropped, got) AS (SELECT topic, i, seq, n, least(came, 20), greatest(came - 20, 0), least(came, 20, 12) FROM t WHERE i = 1
UNION ALL SELECT t.topic, t.i, t.seq, t.n, least(q.held - q.got + t.came, 20), q.dropped + greatest(q.held - q.got + t.came - 20, 0), least(q.held - q.got + t.came, 20, 12) FROM q JOIN t ON t.topic = q.topic AND t.i = q.i + 1)
SELECT q.topic, q.seq, CAST(a.n - q.n + q.held AS INTEGER) AS place, a.seq AS event, q.dropped, CAST(q.held - q.got AS INTEGER) AS waiting FROM q JOIN a ON a.topic = q.topic AND a.n > q.n - q.held AND a.n <= q.n - q.held + q.got""")
def stream_bounded_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader of each kind of event that takes twelve at times, from a queue of twenty."""
    rows = events(spark, sf_dir).select("event_type", F.col("event_id").alias("seq"), F.col("event_id").alias("event"), F.when(F.col("event_id") % 25 == 0, 12).alias("take"))
    return cycles.to_table(state.delivered(state.in_slices(rows, "seq", SLICES), "event_type", 20), "append")


def _days_sql() -> str:
    """The state after each quarter of the days, from that before."""
    out = "o AS (SELECT user_id, us, value, CAST(hour // 24 % 4 AS INTEGER) AS b FROM e WHERE value IS NOT NULL), s0 AS (SELECT user_id, NULL::DOUBLE AS mean, NULL::DOUBLE AS sd, NULL::BIGINT AS seen FROM e WHERE false)"
    for i in range(4):
        w = "exp(-greatest((x.seen - s.seen) / 86400000000, 0) / 14)"
        p, q = "(1 / pow(coalesce(s.sd, 20.0::DOUBLE), 2))", "(x.n / 225.0::DOUBLE)"
        out += f""", x{i} AS (SELECT user_id, count(value) AS n, avg(value) AS v, max(us) AS seen FROM o WHERE b = {i} GROUP BY 1),
s{i + 1} AS MATERIALIZED (SELECT coalesce(s.user_id, x.user_id) AS user_id, CASE WHEN n IS NULL THEN s.mean ELSE ({p} * coalesce({w} * s.mean + (1 - {w}) * 50.0::DOUBLE, 50.0) + {q} * v) / ({p} + {q}) END AS mean, CASE WHEN n IS NULL THEN s.sd ELSE 1 / sqrt({p} + {q}) END AS sd, coalesce(x.seen, s.seen) AS seen FROM s{i} s FULL JOIN x{i} x ON s.user_id = x.user_id)"""
    return out


@query(f"WITH {EVENTS}, {_days_sql()} SELECT user_id, round(mean, 8) AS mean, round(sd, 8) AS sd, seen FROM s4")
def stream_carried_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's level, carried through four batches (days by number modulo four) in a versioned table."""
    rows = events(spark, sf_dir).select("user_id", "us", "value", (F.floor(F.col("hour") / 24) % 4).cast("int").alias("b"))
    folder = shared_folder(spark)
    step = state.carried(spark, f"{folder}/state", lambda s, batch: state.posterior(s, batch, "user_id", "us", "value", 50.0, 20.0, 15.0))
    stream = state.in_parts(rows, "b", range(4))
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return state.newest(spark, f"{folder}/state").select("user_id", r("mean").alias("mean"), r("sd").alias("sd"), F.col("at").alias("seen"))


#: Feeds that a cycle expects; no event is of the last kind.
MEMBERS = ("click", "error", "purchase", "signup", "view", "tide")


@query(f"""WITH {EVENTS}, m(member) AS (VALUES {", ".join(f"('{m}')" for m in MEMBERS)}), b AS (SELECT CAST(hour // 24 % 4 AS INTEGER) AS run, event_type, count(*) AS n, round(avg(value), 8) AS level FROM e GROUP BY ALL),
k AS (SELECT DISTINCT run FROM b WHERE run >= 1)
SELECT CAST(k.run AS VARCHAR) AS run, member, n, level, CASE WHEN event_type IS NULL THEN 'no ' || member || ' in this cycle' END AS note FROM k CROSS JOIN m LEFT JOIN b ON b.run = k.run AND event_type = member""")
def live_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product for each of four batches (days by number modulo four), with notes for feeds that brought nothing; the last three are kept."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("member"), "value", (F.floor(F.col("hour") / 24) % 4).cast("int").alias("b"))
    folder = shared_folder(spark)
    make = lambda batch: live.with_notes(batch.groupBy("member").agg(F.count("*").alias("n"), r(F.avg("value")).alias("level")), "member", MEMBERS)
    live.live(state.in_parts(rows, "b", range(4)), live.cycle(make, f"{folder}/product", 3), f"{folder}/log")
    return runs.read_runs(spark, f"{folder}/product").select("run", "member", "n", "level", "note")


@query("""SELECT l_returnflag AS run, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 4) AS quantity, l_returnflag = 'N' AS refused FROM lineitem GROUP BY ALL""")
def refused_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each return flag, published whole; a second one for N is refused and changes nothing."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", "l_returnflag")
    folder = shared_folder(spark)
    refused = []
    for flag, half in (("A", False), ("N", False), ("R", False), ("N", True)):
        part = rows.where(F.col("l_returnflag") == flag).drop("l_returnflag")
        try:
            runs.publish(part.where("l_quantity > 25") if half else part, folder, flag)
        except runs.RunExistsError:
            refused.append(flag)
    out = runs.read_runs(spark, folder).groupBy("run", F.col("l_linestatus").alias("status"))
    return out.agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 4).alias("quantity")).withColumn("refused", F.col("run").isin(refused))


@query(f"""WITH {EVENTS}, f AS (SELECT hour - (SELECT min(hour) FROM e) AS frame, user_id % 24 AS "row", length(event_type) AS col, max(value) AS v FROM e WHERE value IS NOT NULL GROUP BY ALL)
SELECT 'all' AS scope, frame, count(*) AS cells, round(sum(v), 6) AS total FROM f GROUP BY 2 UNION ALL SELECT 'from the third day', frame, count(*), round(sum(v), 6) FROM f WHERE frame >= 48 GROUP BY 2""")
def cube_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames by the hour of a grid, written as a cube and read back whole, and from the 48th frame on."""
    e = events(spark, sf_dir).where("value is not null").select("hour", (F.col("user_id") % 24).cast("int").alias("row"), F.length("event_type").alias("col"), "value")
    first, last = e.agg(F.min("hour"), F.max("hour")).first()
    folder = shared_folder(spark)
    cube.write_cube(e.withColumn("frame", F.col("hour") - first).drop("hour"), folder, 24, 16, last - first + 1, 24)
    per_frame = lambda d, scope: d.groupBy(F.lit(scope).alias("scope"), "frame").agg(F.count("*").alias("cells"), r(F.sum("value"), 6).alias("total"))
    return per_frame(cube.read_cube(spark, folder), "all").unionByName(per_frame(cube.read_cube(spark, folder, first=48), "from the third day"))
