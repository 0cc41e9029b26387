"""Convex hulls of the points of a key, merged from hulls of the tasks' points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of hulls that a task holds before it hands them on.
HELD_POINTS = 500_000
#: Second-level groups of a key, so that the hulls of very many tasks don't meet in one.
SALTS = 32


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counterclockwise from the leftmost (lowest) one; points on an edge are none.

    Of points with one x only the lowest and the highest can be corners.
    """
    if len(points) == 0:
        return points
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    first = np.concatenate([[True], points[1:, 0] != points[:-1, 0]])
    ends = points[first | np.concatenate([first[1:], [True]])]
    ends = ends[np.concatenate([[True], (ends[1:] != ends[:-1]).any(axis=1)])]

    def side(rows: np.ndarray) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out

    if len(ends) < 3:
        return ends
    return np.array(side(ends)[:-1] + side(ends[::-1])[:-1])


def area(corners: np.ndarray) -> float:
    """What the corners enclose; 0 for a point or a line."""
    if len(corners) < 3:
        return 0.0
    x, y = (corners - corners[0]).T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def convex_hulls(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n_points, n_corners, area, corners) for every key with a point; corners counterclockwise from the leftmost.

    Tasks turn their points into hulls batch by batch, then hulls of hulls are
    taken by key and salt and at last by key: what meets in a task are corners,
    never a key's points.  (Points that all lie on a curve are all corners;
    nothing can make their hull smaller.)  Points with a null or non-finite
    coordinate take no part; null keys are a key.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    named = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    partial = f"{named}, _x double, _y double, _n long"
    finite = [F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in (x, y)]
    points = df.where(finite[0] & finite[1]).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(1).cast("long").alias("_n"))

    def frame(name: tuple, corners: np.ndarray, n: int) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * len(corners) for k, v in zip(keys, name, strict=True)}, "_x": corners[:, 0], "_y": corners[:, 1], "_n": [n] + [0] * (len(corners) - 1)})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, int]] = {}
        size = 0
        for batch in batches:
            for name, rows in batch.groupby(keys, dropna=False, sort=False):
                name = tuple(None if pd.isna(v) else v for v in name)
                before, n = held.get(name, (np.zeros((0, 2)), 0))
                corners = hull(np.concatenate([before, rows[["_x", "_y"]].to_numpy()]))
                held[name] = corners, n + len(rows)
                size += len(corners) - len(before)
            if size > HELD_POINTS:
                yield pd.concat([frame(k, *v) for k, v in held.items()])
                held, size = {}, 0
        if held:
            yield pd.concat([frame(k, *v) for k, v in held.items()])

    def merged(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return frame(name[: len(keys)], hull(rows[["_x", "_y"]].to_numpy()), int(rows["_n"].sum()))

    def whole(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        corners = hull(rows[["_x", "_y"]].to_numpy())
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, name, strict=True)}, "n_points": [int(rows["_n"].sum())], "n_corners": [len(corners)], "area": [area(corners)], "corners": [corners.tolist()]})

    some = points.mapInPandas(parts, partial).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    fewer = some.groupBy(*keys, "_salt").applyInPandas(merged, partial)
    return fewer.groupBy(*keys).applyInPandas(whole, f"{named}, n_points long, n_corners long, area double, corners array<array<double>>")
