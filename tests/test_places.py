"""Rows at one place, or of one cell, meet others as one: the work follows places and results, not copies."""

import time

import pytest
from pyspark.sql import functions as F

from freshet.operators import spatial
from freshet.plans import REGISTRY

COPIES = 20_000


@pytest.fixture
def crowds(spark):
    """Two crowds, five apart."""
    a = spark.range(COPIES).select(F.col("id").alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    b = spark.range(COPIES).select((F.col("id") + 7).alias("g"), F.lit(3.0).alias("gx"), F.lit(4.0).alias("gy"), F.lit(2.0).alias("res"))
    return a, b


def test_pairs_of_places_stand_once(spark, crowds):
    a, b = crowds
    assert [tuple(p) for p in spatial.near_places(b, a, "gx", "gy", "x", "y", 5.0).collect()] == [(3.0, 4.0, 0.0, 0.0, 5.0)]
    few = spatial.radius_join(b.limit(3), a.limit(4), "gx", "gy", "x", "y", 5.0, 8)
    assert few.columns == ["g", "gx", "gy", "res", "k", "x", "y", "distance"] and few.count() == 12
    assert spatial.near_places(b, a, "gx", "gy", "x", "y", 4.9).isEmpty()


def test_idw_of_crowds(spark, crowds):
    began = time.monotonic()
    got = spatial.idw(*crowds, "k", "x", "y", "gx", "gy", "res", 10.0).agg(F.count("*"), F.min("correction"), F.max("correction")).first()
    w = 0.1**2
    assert got[0] == COPIES and got[1] == got[2] == pytest.approx(COPIES * w * 2 / (COPIES * w + 0.01))
    assert time.monotonic() - began < 45  # all pairs take minutes


def test_nearest_of_crowds(spark, crowds):
    began = time.monotonic()
    got = spatial.nearest(*crowds, "k", "x", "y", "g", "gx", "gy", 5.0).groupBy("g", "distance").count().collect()
    assert [tuple(r) for r in got] == [(7, 5.0, COPIES)]
    assert time.monotonic() - began < 45  # all pairs take minutes


def test_register_of_crowds(spark, tmp_path):
    began = time.monotonic()
    at = F.col("id") * 5000 + 1
    spark.range(COPIES).select(at.alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(COPIES).select(at.alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = REGISTRY["register_overlap"].run(spark, str(tmp_path)).first()
    assert got.points == COPIES and got.share in (0.0, 1.0)
    assert time.monotonic() - began < 45  # all pairs take minutes


def test_cells_of_crowds_and_bent_ways(spark):
    began = time.monotonic()
    points = spark.range(COPIES).select(F.col("id").alias("cell"), F.lit(50.0).alias("x"), F.lit(61.0).alias("y"))
    ways = spark.range(COPIES).select(F.col("id").alias("segment"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(100.0).alias("x2"), F.lit(100.0).alias("y2")).withColumn("x1", -F.col("segment").cast("double"))
    one = spatial.near_segments(points.limit(2), ways.where("segment = 0"), "cell", "segment", "x", "y", 15.0, 30.0, 8).collect()
    assert {r.distance for r in one} == {round(11 / 2**0.5, 8)} and len(one) == 2
    assert spatial.near_segments(points, ways, "cell", "segment", "x", "y", 1e-9, 30.0).isEmpty()  # the places are measured once
    assert time.monotonic() - began < 45


def test_repeated_suppliers_share_a_cell_once(spark, tmp_path):
    spark.createDataFrame([(1, 3, 5.0), (101, 3, 7.0), (2, 3, 9.0)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(201,), (201,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert [tuple(r) for r in REGISTRY["shared_cells"].run(spark, str(tmp_path)).collect()] == [(201, 3, 2, 7.0)]
