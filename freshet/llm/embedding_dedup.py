"""Embedding near-duplicates: tiles in PCA order, compared leading dimensions first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import components, small_batches, stored, table

THRESHOLD = 0.9
#: Vectors in a tile, the unit that boxes rule out.
TILE = 2_048
#: Bytes of vectors in a block of neighbouring tiles, the unit that is shipped; a task holds two blocks.
BLOCK_BYTES = 4 << 20
#: Leading PCA dimensions that are multiplied out for every pair of a tile pair.
LEADING = 16
#: Above the rounding of single precision; products so close to the threshold are taken again in double precision.
MARGIN = 1e-4


def distinct_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(node, rep, values, copies) of the distinct usable vectors, the smallest id as rep; node numbers them, whatever ids they share.

    Usable: with an id, not null, no null or non-finite component, not zero.
    """
    finite = ~F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("values")).where("id is not null and values is not null")
    usable = usable.where(F.coalesce(finite, F.lit(False)) & F.exists("values", lambda x: x != 0))
    same = usable.groupBy("values").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return same.select(F.monotonically_increasing_id().alias("node"), "rep", "copies", _doubles("values").alias("values"))


def _doubles(vector: str) -> Column:
    """A vector in double precision, without negative zeros."""
    return F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the axes of the vectors' second moments, those that hold most first.

    Tasks sum outer products of unit vectors; the sums meet entry by entry, so
    the driver gets d * d numbers for each dimension that stands in the table.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x in _by_dimension(b.column(0)):
                x = _unit(x)
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            n = m.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d), pa.int32()), pa.array(np.arange(n), pa.int64()), pa.array(m.ravel())], names=["d", "at", "v"])

    sums = vectors.select("values").mapInArrow(moments, "d int, at long, v double").groupBy("d", "at").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for d, part in sums.groupby("d"):
        d = int(d)
        m = part.sort_values("at")["v"].to_numpy().reshape(d, d)
        axes[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return axes


def _by_dimension(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(np.asarray(column.offsets))
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        if d:
            rows = np.flatnonzero(sizes == d)
            yield int(d), flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component goes first, so that no square is too large or too small."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def blocks(vectors: DataFrame, axes: dict[int, np.ndarray], tile: int, block_bytes: int) -> DataFrame:
    """(block, d, nodes, copies, data, low, high): the vectors in blocks along the first axis, sorted within, and where on that axis a block begins and ends."""
    first = {d: a[:, 0] for d, a in axes.items()}

    @F.pandas_udf("double")
    def along(values: pd.Series) -> pd.Series:
        sizes = values.map(len)
        out = pd.Series(np.zeros(len(values)))
        for d in sizes.unique():
            mine = sizes == d
            out[mine.to_numpy()] = _unit(np.stack(values[mine].to_numpy())) @ first[int(d)]
        return out

    # vectors of one place on the axis are told apart by a shift below any that matters, so that no place is a hot group
    shift = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20) * 1e-7
    placed = stored(vectors.withColumn("at", along("values") + shift).withColumn("d", F.size("values")))
    n_bytes = placed.agg(F.coalesce(F.sum(4 * F.col("d")), F.lit(0))).first()[0]
    cuts = max(1, math.ceil(n_bytes / block_bytes))
    splits = placed.approxQuantile("at", [i / cuts for i in range(1, cuts)], 0.1 / cuts) if cuts > 1 else []
    edges = np.array(sorted(set(splits)))

    @F.pandas_udf("int")
    def place(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(), side="right"))

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "node"])
        x = np.stack(pdf["values"].to_numpy())
        at = _unit(x) @ first[int(key[0])]
        single = x.astype(np.float32)
        x = single if (single == x).all() else x  # half the bytes where nothing is lost
        row = (f"{key[0]}:{key[1]}", int(key[0]), pdf["node"].to_numpy(np.int64).tobytes(), pdf["copies"].to_numpy(np.int64).tobytes(), x.tobytes(), float(at.min()), float(at.max()))
        return pd.DataFrame([row], columns=["block", "d", "nodes", "copies", "data", "low", "high"])

    schema = "block string, d int, nodes binary, copies binary, data binary, low double, high double"
    return stored(placed.withColumn("place", place("at")).groupBy("d", "place").applyInPandas(cut, schema))


def block_pairs(ends: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks (a <= b) that can hold a link.

    Unit vectors of cosine t are no further apart than the root of 2 - 2t, on
    any axis.  Blocks meet in the stretches of that width that they touch, one
    of the two also in those beside them.
    """
    width = math.sqrt(max(1e-6, 2 - 2 * threshold)) + 1e-6
    slots = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    a = ends.select(F.col("block").alias("a"), "d", F.col("low").alias("a_low"), F.col("high").alias("a_high"), slots(F.col("low"), F.col("high")).alias("slot"))
    b = ends.select(F.col("block").alias("b"), "d", F.col("low").alias("b_low"), F.col("high").alias("b_high"), slots(F.col("low") - width, F.col("high") + width).alias("slot"))
    near = (F.col("a_low") - F.col("b_high") <= width) & (F.col("b_low") - F.col("a_high") <= width)
    return a.join(b, ["d", "slot"]).where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def tile_pairs(x: np.ndarray, y: np.ndarray, same: bool, tile: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Starts of the tile pairs of two blocks that can hold a link, from the leading coordinates ``x`` and ``y``.

    Leading products of any two points of the tiles' boxes, plus what the rest
    can add, have to reach the threshold.  Per dimension the largest product of
    two intervals is at their ends; no point of a box has less in the leading
    dimensions than its distance from 0.
    """

    def boxes(z: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
        out = []
        for a in range(0, len(z), tile):
            low, high = z[a : a + tile].min(axis=0), z[a : a + tile].max(axis=0)
            inner = np.where((low <= 0) & (high >= 0), 0.0, np.minimum(low * low, high * high)).sum()
            out.append((a, low, high, math.sqrt(max(0.0, 1 - inner))))
        return out

    of_y = boxes(y)
    for a, low, high, rest in boxes(x):
        for b, other_low, other_high, other_rest in of_y:
            if same and b < a:
                continue
            lead = np.max([low * other_low, low * other_high, high * other_low, high * other_high], axis=0).sum()
            if lead + rest * other_rest >= threshold - MARGIN:
                yield a, b


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of x and y whose cosine reaches the threshold.

    Products of the leading coordinates come first; where they and the product
    of the norms of the rest (the most that the rest can add) stay below the
    threshold the pair is done.  The others go on over the remaining
    dimensions; what is within MARGIN of the threshold is decided in double
    precision.  ``x`` and ``y`` are unit vectors.
    """
    ux, uy = x, y
    px, py = (ux @ axes).astype(np.float32), (uy @ axes).astype(np.float32)
    rx, ry = (np.sqrt(np.maximum(0, (p[:, LEADING:] ** 2).sum(axis=1))) for p in (px, py))
    bound = px[:, :LEADING] @ py[:, :LEADING].T
    bound += np.outer(rx, ry)
    i, j = np.nonzero(bound >= threshold - MARGIN)
    found_i, found_j = [], []
    for a in range(0, len(i), 1 << 16):
        ii, jj = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        cos = np.einsum("ij,ij->i", px[ii], py[jj])
        near = np.abs(cos - threshold) <= MARGIN
        cos = cos.astype(np.float64)
        cos[near] = np.einsum("ij,ij->i", ux[ii[near]], uy[jj[near]])
        ok = cos >= threshold
        found_i.append(ii[ok])
        found_j.append(jj[ok])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or empty), np.concatenate(found_j or empty)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 of the edges (i, j) that connect what all of them connect."""
    label = np.arange(n)
    while True:  # each node takes the least label around it until none changes
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(cut: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float, tile: int) -> DataFrame:
    """(node, n, other): for each block pair its vectors' link counts, copies included, and the edges of a forest over its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                d, same = r["d"], r["a"] == r["b"]
                nodes = [np.frombuffer(r[f"{s}_nodes"], np.int64) for s in "ab"]
                copies = [np.frombuffer(r[f"{s}_copies"], np.int64) for s in "ab"]
                x, y = (_unit(np.frombuffer(r[f"{s}_data"], f"f{len(r[f'{s}_data']) // (len(m) * d)}").reshape(-1, d).astype(np.float64)) for s, m in zip("ab", nodes, strict=True))
                lead = axes[d][:, :LEADING]
                i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b in tile_pairs(x @ lead, y @ lead, same, tile, threshold):
                    u, v = compare(x[a : a + tile], y[b : b + tile], axes[d], threshold)
                    keep = u < v if same and a == b else np.ones(len(u), dtype=bool)
                    i.append(u[keep] + a)
                    j.append(v[keep] + b)
                i, j = np.concatenate(i), np.concatenate(j)
                if not len(i):
                    continue
                n = len(x)
                count_x = np.bincount(i, weights=copies[1][j], minlength=n)
                count_y = np.bincount(j, weights=copies[0][i], minlength=len(y))
                every = nodes[0] if same else np.concatenate(nodes)
                counts = (count_x + count_y if same else np.concatenate([count_x, count_y])).astype(np.int64)
                u, v = _forest(i, j if same else j + n, len(every))
                held = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([every[held], every[u]])), pa.array(np.concatenate([counts[held], np.zeros(len(u), np.int64)])), pa.array([None] * len(held) + every[v].tolist(), pa.int64())],
                    names=["node", "n", "other"],
                )

    side = lambda s: cut.select(F.col("block").alias(s), *([F.col("d")] if s == "a" else []), *[F.col(c).alias(f"{s}_{c}") for c in ("nodes", "copies", "data")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return stored(joined.mapInArrow(run, "node long, n long, other long"))


def link(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows``.

    Vectors link at a cosine of ``threshold`` or more, in double precision,
    however large or small their components; equal vectors link as well.
    Vectors that are null, zero, or hold null or non-finite components, and rows
    without id, link with nothing.  Vectors of different dimensions are not
    compared.  Repeated rows count as the vectors they are, and different
    vectors under one id stand for themselves: each row gets the links and the
    component of its own vector.  Rows meet their vector by two 64-bit hashes of it.
    """
    small_batches(rows.sparkSession)
    vectors = stored(distinct_vectors(rows, id_col, vector))
    axes = principal_axes(vectors)
    named = lambda v: [F.xxhash64(v).alias("_h1"), F.xxhash64(v, F.lit(1)).alias("_h2")]
    ids = F.col(id_col).cast("long")
    if not axes:
        return rows.select(ids.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), ids.alias("component_id"), F.lit(True).alias("kept"))
    cut = blocks(vectors, axes, tile, block_bytes)
    pairs = stored(block_pairs(cut.select("block", "d", "low", "high"), threshold))
    found = links(cut, pairs, axes, threshold, tile)
    comps = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "_node")
    counts = found.where("other is null").groupBy(F.col("node").alias("_counted")).agg(F.sum("n").alias("n"))
    slim = vectors.select("node", "rep", "copies", *named("values"))
    known = slim.join(counts, F.col("node") == F.col("_counted"), "left").join(comps, F.col("node") == F.col("_node"), "left").withColumn("comp", F.coalesce("component", "node"))
    known = stored(known.select("_h1", "_h2", "comp", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "comp").select(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), "n_links", "component_id")
    out = rows.select(ids.alias("vec_id"), _doubles(vector).alias("_v")).select("vec_id", *named("_v"))
    met = out.join(known, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
