"""What the operators of this subpackage have in common: tables, shared storage and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only in local mode, where
    driver and executors are one process, a local folder is made where it is
    unset; elsewhere that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/freshet-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each of the names, with underscores ahead until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def row_mark(df: DataFrame) -> Column:
    """A hash of all a row's columns but maps: rows with the same mark and id are taken for equal."""
    return F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])


def picked(df: DataFrame, chosen: DataFrame, id_col: str, keep: str | None = None) -> DataFrame:
    """The rows that ``chosen(id, mark, rows)`` names by id and mark, equal rows once; ``keep``: a column of ``chosen`` that comes along.

    ``rows`` says how often a row stands; only those that stand more than once are grouped.
    """
    mark, mine, its = unused(df, "mark", "chosen_id", "chosen_mark")
    marked = df.withColumn(mark, row_mark(df))
    out = [*df.columns, *([keep] if keep else [])]

    def met(part: DataFrame) -> DataFrame:
        named = part.select(F.col("id").alias(mine), F.col("mark").alias(its), *([keep] if keep else []))
        return marked.join(named, F.col(id_col).eqNullSafe(F.col(mine)) & (F.col(mark) == F.col(its)))

    again = met(chosen.where("rows > 1")).dropDuplicates([id_col, mark])
    return met(chosen.where("rows = 1")).select(*out).unionByName(again.select(*out))


def small_batches(spark: SparkSession, mb: int = 2) -> None:
    """Spark hands no more than about ``mb`` MB of rows to Python at a time, however long the texts; a session that asks for less keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if now.isdigit() and int(now) > mb << 20:
        spark.conf.set(key, str(mb << 20))


def stored(df: DataFrame, as_schema: StructType | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends there, and any executor can reread it.

    ``as_schema``: types to read the table with, where they differ from those it
    is written with (a struct as a vector).
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(as_schema or df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component) per node, the smallest node as component.

    Alternating large-star and small-star steps: every step is a distinct, a
    grouped minimum and a join, edges never grow beyond their first number, and
    only the count of changed edges comes to the driver.  The neighbours of one
    node are never gathered into a list.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if large:  # larger neighbours go to the least of the neighbourhood
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # smaller neighbours, and the node itself
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        e = stored(star(star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
