"""The chunked cube: round trips, and which chunks a range of frames opens."""

import random

import pytest

from freshet.sources import cube
from freshet.sources.storage import shared_folder

CELLS = "frame long, row int, col int, value double"


def test_round_trip_and_chosen_frames(spark):
    rng = random.Random(1)
    cells = {(f, rng.randrange(4), rng.randrange(5)): rng.random() for f in range(50) for _ in range(6) if not 20 <= f < 30}
    folder = shared_folder(spark)
    cube.write_cube(spark.createDataFrame([(*k, v) for k, v in cells.items()] + [(*next(iter(cells)), -1.0), (3, 0, 0, None)] * 2, CELLS), folder, 4, 5, 50, 8)
    whole = cube.read_cube(spark, folder)
    kept = {k: v for k, v in cells.items()}
    assert {(r.frame, r.row, r.col): r.value for r in whole.collect()} == kept
    assert whole.rdd.getNumPartitions() == 7
    for first, last, parts in [(17, 17, 1), (16, 23, 1), (15, 24, 3), (None, 8, 2), (41, None, 2), (50, None, 1), (9, 3, 1), (-5, 999, 7)]:
        part = cube.read_cube(spark, folder, first, last)
        assert part.rdd.getNumPartitions() == parts
        assert {(r.frame, r.row, r.col) for r in part.collect()} == {k for k in kept if (first is None or k[0] >= first) and (last is None or k[0] <= last)}
    both = whole.where("frame < 3").unionByName(whole)  # conditions on one loaded cube don't meet
    assert both.count() == len(kept) + sum(k[0] < 3 for k in kept)


def test_empty_cube_and_rows_beyond_it(spark):
    folder = shared_folder(spark)
    cube.write_cube(spark.createDataFrame([], CELLS), folder, 4, 5, 10, 4)
    assert cube.read_cube(spark, folder).count() == 0
    for row in ((10, 0, 0, 1.0), (0, 4, 0, 1.0), (0, 0, -1, 1.0), (None, 0, 0, 1.0)):
        with pytest.raises(ValueError):
            cube.write_cube(spark.createDataFrame([row], CELLS), folder, 4, 5, 10, 4)
