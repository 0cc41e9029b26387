"""Units of a raster: small ones merged into their neighbours by contracting the graph of units, large ones split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.temporal import numbered
from freshet.sources.storage import materialised


def borders(cells: DataFrame, row: str = "row", col: str = "col", label: str = "label") -> DataFrame:
    """(a, b, shared): how many cell edges each two units share, a row for each direction; negative and null labels are no unit."""
    own = cells.where(F.col(label) >= 0).select(F.col(row).alias("_r"), F.col(col).alias("_c"), F.col(label).alias("a"))
    next_to = own.select(F.col("_r"), (F.col("_c") - 1).alias("_c"), F.col("a").alias("b")).unionByName(own.select((F.col("_r") - 1).alias("_r"), F.col("_c"), F.col("a").alias("b")))
    met = own.join(next_to, ["_r", "_c"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def merged(cells: DataFrame, least: int, passes: int = 6, row: str = "row", col: str = "col", label: str = "label") -> DataFrame:
    """(label, unit): where each label ends after units of fewer than ``least`` cells have joined a neighbour.

    In a pass every small unit joins that of its larger neighbours (ties in size:
    the smaller label is larger) with which it shares most edges, the smaller
    label on ties.  Joins form a forest, followed to its roots by doubling jumps.
    Only the graph of units is contracted: cells are read once.
    """
    size = cells.where(F.col(label) >= 0).groupBy(F.col(label).alias("unit")).agg(F.count("*").alias("n"))
    size, edge = materialised(size), materialised(borders(cells, row, col, label))
    where = size.select(F.col("unit").alias("label"), "unit")
    for _ in range(passes):
        small = size.where(F.col("n") < least)
        there = size.select(F.col("unit").alias("b"), F.col("n").alias("_n"))
        able = small.join(edge, F.col("unit") == F.col("a")).join(there, "b").where((F.col("_n") > F.col("n")) | (F.col("_n") == F.col("n")) & (F.col("b") < F.col("unit")))
        to = materialised(able.groupBy("unit").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("to")))
        if to.isEmpty():
            break
        while True:
            onward = to.select(F.col("unit").alias("_u"), F.col("to").alias("_to"))
            met = materialised(to.join(onward, F.col("to") == F.col("_u"), "left").select("unit", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
            to = met.drop("moved")
            if met.where("moved").isEmpty():
                break
        end = lambda d, c: d.join(to.withColumnRenamed("unit", "_u"), F.col(c) == F.col("_u"), "left").withColumn(c, F.coalesce("to", c)).drop("_u", "to")
        where = materialised(end(where, "unit"))
        size = materialised(end(size, "unit").groupBy("unit").agg(F.sum("n").alias("n")))
        edge = materialised(end(end(edge, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("shared").alias("shared")))
    return where


def split(cells: DataFrame, most: int, row: str = "row", col: str = "col", unit: str = "unit") -> DataFrame:
    """Adds ``part``: units of more than ``most`` cells fall into the fewest parts, in row-major order, whose sizes differ by one at most.

    A cell's place in its unit is the cells in the unit's rows above plus its
    place in the row, so no unit is sorted as a whole.
    """
    from pyspark.sql import Window

    rows = cells.groupBy(unit, row).agg(F.count("*").alias("_in_row"))
    every = Window.partitionBy(unit)
    rows = rows.withColumn("_above", F.coalesce(F.sum("_in_row").over(every.orderBy(row).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_in_row").over(every)).drop("_in_row")
    place = F.col("_above") + F.row_number().over(Window.partitionBy(unit, row).orderBy(col)) - 1
    placed = cells.join(rows, [unit, row]).withColumn("_place", place).withColumn("_parts", F.ceil(F.col("_size") / most))
    base, extra = F.expr("_size div _parts"), F.col("_size") % F.col("_parts")
    long = extra * (base + 1)
    part = F.when(F.col("_place") < long, F.floor(F.col("_place") / (base + 1))).otherwise(extra + F.floor((F.col("_place") - long) / base))
    return placed.withColumn("part", part.cast("long")).drop("_above", "_size", "_place", "_parts")


def compact(cells: DataFrame, unit: str = "unit", part: str = "part") -> DataFrame:
    """Puts one number from 0 in the place of unit and part: units keep their order, further parts come behind all units."""
    names = cells.select(unit, part).distinct().withColumn("_new", F.col(part) > 0)
    number = numbered(names, [], ["_new", unit, part]).select(F.col(unit).alias("_u"), F.col(part).alias("_p"), (F.col("n") - 1).alias("_n"))
    return cells.join(number, (F.col(unit) == F.col("_u")) & (F.col(part) == F.col("_p"))).withColumn(unit, F.col("_n")).drop("_u", "_p", "_n", part)


def regrouped(cells: DataFrame, least: int, most: int, passes: int = 6) -> DataFrame:
    """(row, col, unit) of the labelled ``cells(row, col, label)``: small units merged, large ones split, numbers without gaps."""
    labelled = cells.where("label >= 0")
    met = labelled.join(merged(cells, least, passes), "label").select("row", "col", "unit")
    return compact(materialised(split(met, most)))
