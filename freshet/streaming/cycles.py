"""Event-time streams: cycles, sliding windows, hysteresis and report folding as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from freshet.functions.scalar import micros
from freshet.sources.storage import shared_folder


def event_stream(spark: SparkSession, folder: str, pattern: str, time: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; zone-less instants become event times whatever the session's zone."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("at", F.timestamp_micros(micros(time)))


def tumbling(df: DataFrame, minutes: int, late: str, *keys: str) -> DataFrame:
    """Count and sum of value for every cycle; rows later than ``late`` behind the newest are dropped and counted by the engine."""
    w = F.window("at", f"{minutes} minutes")
    g = df.withWatermark("at", late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_micros("window.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, minutes: int, every: int, late: str, *keys: str) -> DataFrame:
    """Trailing windows (end - minutes, end] at each cycle: a row on a window's end belongs to it."""
    shifted = df.withColumn("at", F.timestamp_micros(F.unix_micros("at") - 1))
    w = F.window("at", f"{minutes} minutes", f"{every} minutes")
    g = shifted.withWatermark("at", late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return g.select(F.unix_micros("window.end").alias("end"), *keys, "n", "peak")


def sessions(df: DataFrame, gap: str, *keys: str) -> DataFrame:
    g = df.groupBy(F.session_window("at", gap), *keys).agg(F.count("*").alias("n"))
    return g.select(F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), *keys, "n")


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all that is there and gives its result table.

    Append results are added by the file sink, which commits each batch once; in
    complete mode each batch replaces the table and the last one stays.  The
    stream's state has no more partitions than tasks run at once: every batch
    starts a task, and for keyed state a Python worker, for each of them.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)
    out, log = f"{root}/out", f"{root}/log"

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    writer = writer.format("parquet").option("path", out) if mode == "append" else writer.foreachBatch(replace)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(partitions), spark.sparkContext.defaultParallelism))
    try:
        q = writer.start()  # which takes the settings along
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stateful(df: DataFrame, keys: list[str], step: Callable, output: str, state: str, timeout: GroupStateTimeout = GroupStateTimeout.NoTimeout) -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(step, output, state, "append", timeout)


def hysteresis(df: DataFrame, key: str, cycle: str, p: str, raise_at: float = 0.6, clear_at: float = 0.3, gap: int | None = None) -> DataFrame:
    """The alert states of the batch operator, carried from batch to batch in keyed state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, cycles, last = state.get if state.exists else ("none", 0, None)
        rows = []
        for c, q in pd.concat(list(parts)).sort_values(cycle)[[cycle, p]].itertuples(index=False):
            if gap is not None and last is not None and c - last > gap:
                name, cycles = "none", 0
            event = None
            if q >= raise_at:
                cycles = cycles + 1 if name != "none" else 1
                if name == "pending" and cycles >= 2:
                    name, event = "raised", "raised"
                elif name == "none":
                    name = "pending"
            elif q > clear_at and name == "raised":
                cycles += 1
            else:
                event = "cleared" if name == "raised" else None
                name, cycles = "none", 0
            last = c
            rows.append((k[0], int(c), name, cycles, event))
        state.update((name, cycles, last))
        yield pd.DataFrame(rows, columns=[key, cycle, "state", "cycles", "event"])

    kind = df.schema[key].dataType.simpleString()
    return stateful(df, [key], step, f"{key} {kind}, {cycle} long, state string, cycles int, event string", "state string, cycles int, last long")


def fold_reports(df: DataFrame, area: str, report: str, x: str, y: str, t: str, radius: float, within: int) -> DataFrame:
    """Each report with the kept one it joins: the first leader within ``radius`` and ``within`` of it, or itself.

    Leaders older than ``within`` can gain nobody and leave the state.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        rows = []
        for r in pd.concat(list(parts)).sort_values([t, report])[[report, x, y, t]].itertuples(index=False):
            kept = [q for q in kept if r[3] - q[3] <= within]
            lead = next((q[0] for q in kept if (q[1] - r[1]) ** 2 + (q[2] - r[2]) ** 2 <= radius**2), None)
            if lead is None:
                kept.append(tuple(r))
            rows.append((k[0], int(r[0]), int(r[0] if lead is None else lead)))
        state.update(tuple([q[i] for q in kept] for i in range(4)))
        yield pd.DataFrame(rows, columns=[area, report, "leader"])

    return stateful(df, [area], step, f"{area} string, {report} long, leader long", "ids array<long>, xs array<double>, ys array<double>, ts array<long>")
