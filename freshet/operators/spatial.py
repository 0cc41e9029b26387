"""Spatial joins on a grid: rows meet through the cells they touch, exact distances decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(df: DataFrame, x: str, y: str, size: float, spread: int) -> DataFrame:
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not spread:
        return df.withColumns({"_cx": cx, "_cy": cy})
    around = F.sequence(F.lit(-spread), F.lit(spread))
    return df.withColumn("_cx", F.explode(F.transform(around, lambda d: cx + d))).withColumn("_cy", F.explode(F.transform(around, lambda d: cy + d)))


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: few bytes that make many pairs would else be put together into a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def near_places(left: DataFrame, right: DataFrame, x: str, y: str, rx: str, ry: str, radius: float) -> DataFrame:
    """(x, y, rx, ry, distance): the places of both sides within ``radius`` (inclusive) of each other, each pair of places once however many rows stand there.

    The side to be passed as ``left`` has fewer places: they go to the nine cells
    around them, the others to their own.
    """
    l_at = _dealt(_cells(left.select(x, y).distinct(), x, y, radius, 1), "_cx", "_cy")
    r_at = _dealt(_cells(right.select(rx, ry).distinct(), rx, ry, radius, 0).withColumnsRenamed({"_cx": "_rcx", "_cy": "_rcy"}), "_rcx", "_rcy")
    dx, dy = F.col(x) - F.col(rx), F.col(y) - F.col(ry)
    met = l_at.join(r_at, (F.col("_cx") == F.col("_rcx")) & (F.col("_cy") == F.col("_rcy")))
    return met.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= radius).select(x, y, rx, ry, "distance")


def radius_join(left: DataFrame, right: DataFrame, x: str, y: str, rx: str, ry: str, radius: float, digits: int | None = None) -> DataFrame:
    """All pairs within ``radius`` (inclusive), with their distance, to ``digits`` if given.

    Pairs of places come first (see ``near_places``), so that rows at one place
    are measured, and rounded, once.
    """
    near = near_places(left, right, x, y, rx, ry, radius)
    if digits is not None:
        near = near.withColumn("distance", F.round("distance", digits))
    met = _dealt(near, x, y).join(left, [x, y]).join(right, [rx, ry])
    return met.select(*left.columns, *right.columns, "distance")


def nearest(left: DataFrame, right: DataFrame, key: str, x: str, y: str, rkey: str, rx: str, ry: str, cutoff: float) -> DataFrame:
    """Each left key's nearest right row within ``cutoff``, ties by right key; keys without one have nulls."""
    first = right.groupBy(rx, ry).agg(F.min(rkey).alias(rkey))
    near = near_places(left, right, x, y, rx, ry, cutoff).join(first, [rx, ry])
    place = near.groupBy(x, y).agg(F.min(F.struct("distance", rkey)).alias("_b"))
    best = left.select(key, x, y).join(place, [x, y]).groupBy(key).agg(F.min("_b").alias("_b"))
    return left.join(best.select(key, F.col(f"_b.{rkey}").alias(rkey), F.col("_b.distance").alias("distance")), key, "left")


def first_box(x: Column, y: Column, boxes: Sequence[tuple[str, float, float, float, float]]) -> Column:
    """Name of the first box that holds the point (edges included); null outside all, or for coordinates that aren't finite."""
    out = F.lit(None).cast("string")
    for name, x0, y0, x1, y1 in reversed(boxes):
        out = F.when(x.between(x0, x1) & y.between(y0, y1), F.lit(name)).otherwise(out)
    finite = ~(F.isnan(x) | F.isnan(y)) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
    return F.when(finite, out)


def grid_cell(x: Column, y: Column, x0: float, y0: float, size: float) -> tuple[Column, Column]:
    """Row and column of a point in a raster whose origin is its upper left corner."""
    return F.floor((F.lit(y0) - y) / size).cast("long"), F.floor((x - F.lit(x0)) / size).cast("long")


def overlap_share(near: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Share of the points that have a match among ``near``."""
    hit = points.join(near.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("points"), F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("share"))


def idw(cells: DataFrame, anchors: DataFrame, key: str, x: str, y: str, ax: str, ay: str, residual: str, radius: float, power: float = 2.0, least: float = 1.0) -> DataFrame:
    """Inverse-distance weighted residual per cell: weight ((R - d) / (R d))^p, and a prior of value 0 and weight R^-p.

    Only anchors within the radius weigh anything, so it is a radius join; the
    anchors of a place are added up before it, and cells at one place share its sum.
    """
    at = anchors.groupBy(ax, ay).agg(F.sum(residual).alias("_r"), F.count("*").alias("_n"))
    near = near_places(anchors, cells, ax, ay, x, y, radius).join(at, [ax, ay])
    d = F.greatest(F.col("distance"), F.lit(least))
    w = F.pow(F.greatest(F.lit(0.0), (radius - d) / (radius * d)), F.lit(power))
    place = near.groupBy(x, y).agg(F.sum(w * F.col("_r")).alias("_wr"), F.sum(w * F.col("_n")).alias("_w"))
    got = cells.select(key, x, y).join(place, [x, y]).groupBy(key).agg(F.sum("_wr").alias("_wr"), F.sum("_w").alias("_w"))
    return cells.join(got, key, "left").withColumn("correction", F.coalesce(F.col("_wr") / (F.col("_w") + radius**-power), F.lit(0.0))).drop("_wr", "_w")


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, row: str, col: str, value: str, key: str) -> DataFrame:
    """Value of a unit grid at a point: the four corners weighed, those without a value left out."""
    corner = F.explode(F.array(*[F.struct((F.floor(y) + i).alias("r"), (F.floor(x) + j).alias("c"), (F.abs(1 - i - (F.col(y) - F.floor(y))) * F.abs(1 - j - (F.col(x) - F.floor(x)))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    spread = points.withColumn("_k", corner)
    met = spread.join(grid, (F.col("_k.r") == F.col(row)) & (F.col("_k.c") == F.col(col)))
    w = F.when(F.col(value).isNotNull(), F.col("_k.w"))
    return met.groupBy(key).agg((F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("sampled"))


def near_segments(points: DataFrame, segments: DataFrame, key: str, segment: str, x: str, y: str, radius: float, size: float, digits: int | None = None) -> DataFrame:
    """(segment, key, distance): points within ``radius`` of a segment from (x1, y1) to (x2, y2), by the distance to its nearest point, to ``digits`` if given.

    A segment goes to the cells of ``size`` that it comes within the radius of;
    places of points to their own, once however many points stand there.
    """
    cell = lambda c: F.floor(c / size)
    low, high = lambda a, b: cell(F.least(a, b) - radius), lambda a, b: cell(F.greatest(a, b) + radius)
    wide = segments.withColumn("_sx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn("_sy", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def square(px: Column, py: Column) -> Column:
        along = ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        ex, ey = px - F.col("x1") - t * dx, py - F.col("y1") - t * dy
        return ex * ex + ey * ey

    # no point of a cell is farther than half its diagonal from its centre
    reach = radius + size * 0.7072
    wide = wide.where(square((F.col("_sx") + 0.5) * size, (F.col("_sy") + 0.5) * size) <= reach * reach)
    wide = _dealt(wide, "_sx", "_sy")
    places = _dealt(points.select(x, y).distinct().withColumns({"_px": cell(F.col(x)), "_py": cell(F.col(y))}), "_px", "_py")
    met = places.join(wide, (F.col("_px") == F.col("_sx")) & (F.col("_py") == F.col("_sy")))
    d = F.sqrt(square(F.col(x), F.col(y)))
    near = met.withColumn("distance", d).where(F.col("distance") <= radius).select(segment, x, y, (F.col("distance") if digits is None else F.round("distance", digits)).alias("distance"))
    return near.join(points.select(key, x, y), [x, y]).select(segment, key, "distance")


def leaders(df: DataFrame, order: Sequence[str], x: str, y: str, t: str, radius: float, within: int, area: str) -> DataFrame:
    """Leader clustering of reports: each joins the first kept leader within ``radius`` and ``within``, else leads itself.

    It depends on order and isn't transitive, so each area is walked in order;
    an area (a city's district and day) bounds what one task holds.  Leaders lie
    in boxes as wide as they reach.  No two of a box are within reach of each
    other, so that it holds a few at most and a report looks at 27 boxes, however
    many leaders there are.
    """
    columns = df.columns
    schema = df.select(*columns, F.lit(0).cast("long").alias("leader"), F.lit(0).cast("long").alias("place")).schema
    # a trifle wider than the reach, so that rounding puts nobody two boxes off
    size, span = radius * (1 + 1e-9) or 1.0, within or 1
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

    def walk(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        boxes: dict[tuple, list[int]] = {}
        lead = []
        xs, ys, ts = (pdf[c].tolist() for c in (x, y, t))
        for i, (px, py, pt) in enumerate(zip(xs, ys, ts, strict=True)):
            if any(v is None or not -1e300 < v < 1e300 for v in (px, py, pt)):
                lead.append(i)  # nowhere: out of everyone's reach
                continue
            p, q, s = px // size, py // size, pt // span
            near = (k for a, b, c in around for k in boxes.get((p + a, q + b, s + c), ()))
            found = min((k for k in near if (xs[k] - px) ** 2 + (ys[k] - py) ** 2 <= radius**2 and abs(ts[k] - pt) <= within), default=None)
            if found is None:
                boxes.setdefault((p, q, s), []).append(i)
            lead.append(i if found is None else found)
        pdf["leader"], pdf["place"] = lead, range(len(pdf))
        return pdf[[*columns, "leader", "place"]]

    return df.groupBy(area).applyInPandas(walk, schema)


def band_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, most: int) -> DataFrame:
    """The ``most`` largest rows of each key, position from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
