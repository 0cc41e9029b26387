"""A cube of frames on a grid, stored in compressed chunks of frames; Spark reads a chunk as a partition."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_META = "cube.json"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, of a kind that pyarrow knows, and the folder's path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _put(folder: str, name: str, data: bytes) -> None:
    """The file appears whole: a task that is run twice writes the same bytes again."""
    store, path = _open(folder)
    part = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


def write_cube(df: DataFrame, folder: str, rows: int, cols: int, frames: int, chunk: int) -> None:
    """Writes ``df(frame, row, col, value)`` as a cube of ``frames`` frames, ``chunk`` in a file.

    Frames, rows and columns count from 0; rows beyond them, or with a null place,
    are refused with a ValueError; a cell without a row, or with a null value, is
    NaN; of rows of one place the largest value counts.  A task holds one chunk.
    The description is written last: a cube without it is none.
    """
    inside = F.col("frame").between(0, frames - 1) & F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    if not df.where(~F.coalesce(inside, F.lit(False))).isEmpty():
        raise ValueError(f"rows beyond {frames} frames of {rows} by {cols} cells")
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    shape = (chunk, rows, cols)

    def save(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        values = np.full(shape, np.nan)
        values[cells["frame"] - key[0] * chunk, cells["row"], cells["col"]] = cells["value"]
        _put(folder, f"c{key[0]}", zlib.compress(values.astype("<f8").tobytes(), 1))
        return pd.DataFrame({"chunk": [key[0]], "cells": [len(cells)]})

    cells = df.groupBy("frame", "row", "col").agg(F.max("value").cast("double").alias("value")).withColumn("chunk", F.floor(F.col("frame") / chunk))
    written = cells.groupBy("chunk").applyInPandas(save, "chunk long, cells long").agg(F.sum("cells")).first()[0]
    _put(folder, _META, json.dumps({"frames": frames, "rows": rows, "cols": cols, "chunk": chunk, "cells": written or 0}).encode())


class Chunk(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)


class CubeReader(DataSourceReader):
    def __init__(self, folder: str, first: int | None, last: int | None) -> None:
        self.folder = folder
        store, path = _open(folder)
        with store.open_input_stream(f"{path}/{_META}") as f:
            self.meta = json.loads(f.read())
        self.first = max(0, first or 0)
        self.last = self.meta["frames"] - 1 if last is None else min(last, self.meta["frames"] - 1)

    def partitions(self) -> list[Chunk]:
        step = self.meta["chunk"]
        return [Chunk(i) for i in range(self.first // step, self.last // step + 1)] if self.first <= self.last else [Chunk(-1)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        step, rows, cols = (self.meta[k] for k in ("chunk", "rows", "cols"))
        store, path = _open(self.folder)
        if store.get_file_info(f"{path}/c{partition.value}").type == fs.FileType.NotFound:
            return  # a chunk without any cell
        with store.open_input_stream(f"{path}/c{partition.value}") as f:
            values = np.frombuffer(zlib.decompress(f.read()), dtype="<f8").reshape(step, rows * cols)
        for i, frame in enumerate(values):
            at = np.flatnonzero(~np.isnan(frame))
            if len(at):
                columns = [pa.array(np.full(len(at), partition.value * step + i)), pa.array((at // cols).astype(np.int32)), pa.array((at % cols).astype(np.int32)), pa.array(frame[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["frame", "row", "col", "value"])


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_cube"

    def schema(self) -> str:
        return "frame long, row int, col int, value double"

    def reader(self, schema) -> CubeReader:  # noqa: ANN001
        first, last = (self.options.get(k) for k in ("first", "last"))
        return CubeReader(self.options["path"], first and int(first), last and int(last))


def read_cube(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(frame, row, col, value): the cells that have a value, of frames ``first`` to ``last``; only the chunks that hold such frames are opened.

    Frames are chosen here and not by conditions that Spark pushes down: two scans
    of one loaded Python source share what was pushed, so that a plan with two
    conditions on it would lose rows.
    """
    spark.dataSource.register(CubeSource)
    chosen = {k: str(v) for k, v in (("first", first), ("last", last)) if v is not None}
    df = spark.read.format("frame_cube").options(**chosen).load(folder)
    if first is not None:
        df = df.where(F.col("frame") >= first)
    return df if last is None else df.where(F.col("frame") <= last)
