"""Runs of a product as folders that appear whole or not at all, and never change."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunExistsError(ValueError):
    """A run of that name has been published before."""


def _path(spark: SparkSession, name: str) -> tuple[JavaObject, JavaObject]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, folder: str, run: str | int) -> None:
    """Writes the rows as run ``run`` of the product: staged beside the runs, then moved into place by one rename.

    The rename fails if the run is there, also if another writer came first; the
    staged files then go and the run stays as it was.  Readers never see a part.
    """
    spark = df.sparkSession
    final, fs = _path(spark, f"{folder}/run={run}")
    if fs.exists(final):
        raise RunExistsError(f"run {run} is in {folder} already")
    staged, _ = _path(spark, f"{folder}/_staged-{uuid.uuid4().hex}")
    df.write.parquet(staged.toString())
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(staged), fs.makeQualified(final), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        fs.delete(staged, True)
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(final):
            raise RunExistsError(f"run {run} is in {folder} already") from e
        raise


def run_names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n[4:] for n in names if n.startswith("run="))


def pruned(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes all but the last ``keep`` runs, whose names are numbers, and what writers left staged; gives the names that went."""
    names = sorted(run_names(spark, folder), key=int)
    gone = names[: max(0, len(names) - keep)]
    for name in gone:
        path, fs = _path(spark, f"{folder}/run={name}")
        fs.delete(path, True)
    return gone


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs with their names in column ``run``."""
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/run={n}" for n in run_names(spark, folder)]).withColumn("run", F.col("run").cast("string"))
