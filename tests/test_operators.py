"""Edge cases of the operators on frames made by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import scalar
from freshet.operators import alerts, assign, calibrate, ensemble, graph, hulls, quality, recurrence, spatial, temporal, verify


def dicts(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def test_exceedance_is_strict_and_skips_missing(spark):
    df = spark.createDataFrame([("a", 15.0), ("a", 15.1), ("a", None), ("b", None)], "k string, v double")
    assert dicts(ensemble.exceedance(df, ["k"], "v", [15]), "k") == [{"k": "a", "p_gt_15": 0.5}, {"k": "b", "p_gt_15": None}]


def test_band_needs_two_members(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0), ("b", 2, 4.0)], "g string, m int, v double")
    got = {r["g"]: r for r in dicts(ensemble.depth_band(df, ["g"], "m", "v"))}
    assert got["a"]["p50"] is None and got["b"]["p50"] == 3.0


def test_recentre_floors_at_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 1.0)], "k string, v double, level double")
    assert sorted(r.level_member for r in ensemble.recentre(df, ["k"], "v", "level").collect()) == [0.0, 6.0]


def test_asof_takes_equal_instants_and_the_oldest_on_demand(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 7, 3.0), ("a", 4, None)], "k string, t long, v double")
    got = {(r["k"], r["t"]): r["x"] for r in dicts(temporal.asof(left, right, ["k"], "t", "v", "x", tie=["v"]))}
    assert got == {("a", 5): 2.0, ("a", 1): None, ("b", 9): None}
    assert {r["t"]: r["x"] for r in dicts(temporal.asof(left, right, ["k"], "t", "v", "x", oldest=True)) if r["k"] == "a"}[1] is not None
    assert {r["t"]: r["x"] for r in dicts(temporal.asof(left.select("k", (F.col("t") + 10).alias("t")), right, ["k"], "t", "v", "x", within=8)) if r["k"] == "a"} == {15: 3.0, 11: 3.0}


def test_nearest_in_time_prefers_the_earlier_on_ties(spark):
    left = spark.createDataFrame([("a", 10), ("a", 30)], "k string, t long")
    right = spark.createDataFrame([("a", 8, 1.0), ("a", 12, 2.0)], "k string, t long, v double")
    assert {r["t"]: r["x"] for r in dicts(temporal.nearest_in_time(left, right, ["k"], "t", "v", "x", 5))} == {10: 1.0, 30: None}


def test_islands_of_two_count_and_the_first_of_equals_wins(spark):
    rows = [("a", i, i in (1, 2, 5, 6, 9)) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, s int, on boolean")
    assert dicts(temporal.longest_island(df, ["k"], "s", "on")) == [{"k": "a", "first_step": 1, "last_step": 2, "length": 2}]


def test_episode_open_at_the_horizon_and_none_of_one_step(spark):
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate([50.0, 0.0, 16.0, 16.0])], "k string, s int, d double")
    got = dicts(alerts.episodes(df, ["k"], "s", "d"))
    assert [(r["level"], r["first_step"], r["open_ended"], r["peak"]) for r in got] == [("watch", 2, True, 16.0)]


@pytest.mark.parametrize(
    ("ps", "states"),
    [
        ([0.6, 0.6, 0.5, 0.3], ["pending", "raised", "raised", "none"]),
        ([0.6, 0.5, 0.6], ["pending", "none", "pending"]),
        ([0.59, 0.6, 0.9], ["none", "pending", "raised"]),
    ],
)
def test_hysteresis(spark, ps, states):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(ps)], "k string, c long, p double")
    assert [r["state"] for r in dicts(alerts.hysteresis(df, ["k"], "c", "p"), "c")] == states


def test_hysteresis_forgets_after_a_gap(spark):
    df = spark.createDataFrame([("a", 0, 0.9), ("a", 5, 0.9), ("a", 99, 0.5)], "k string, c long, p double")
    assert [r["state"] for r in dicts(alerts.hysteresis(df, ["k"], "c", "p", gap=60), "c")] == ["pending", "raised", "none"]


def test_hysteresis_against_a_plain_fold(spark):
    rng = random.Random(8)
    rows = [(k, c, rng.choice([0.1, 0.3, 0.5, 0.6, 0.9, 0.9, 0.9, None, float("nan")])) for k in ("a", "b", None) for c in sorted(rng.sample(range(400), 120))]
    for gap in (None, 5):
        want, state, cycles, last = [], {}, {}, {}
        for k, c, p in rows:
            if gap is not None and k in last and c - last[k] > gap:
                state[k] = "none"
            s, event = state.get(k, "none"), None
            if p is not None and not p < 0.6:
                new = "raised" if s in ("pending", "raised") else "pending"
                n = cycles[k] + 1 if s != "none" else 1
                event = "raised" if s == "pending" else None
            elif p is not None and p > 0.3 and s == "raised":
                new, n = "raised", cycles[k] + 1
            else:
                new, n, event = "none", 0, "cleared" if s == "raised" and (p is None or p <= 0.3) else None
            state[k], cycles[k], last[k] = new, n, c
            want.append((k, c, new, n, event))
        df = spark.createDataFrame(rows, "k string, c long, p double").repartition(3)
        got = [(x.k, x.c, x.state, x.cycles, x.event) for x in alerts.hysteresis(df, ["k"], "c", "p", gap=gap).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_clusters_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(0, 50, 300).round(1), np.repeat([1.0, 1.0, 9.0], 7), np.array([4.0]), np.array([])):
        centres = [float(np.quantile(values, (i + 0.5) / 3)) for i in range(3)] if len(values) else []
        for _ in range(100 if len(values) else 0):
            near = np.abs(values[:, None] - np.array(centres)[None]).argmin(axis=1)
            moved = [values[near == i].mean() if (near == i).any() else c for i, c in enumerate(centres)]
            if max(abs(a - b) for a, b in zip(moved, centres)) < 0.01:
                break
            centres = moved
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        assert [x.centre for x in calibrate.clusters(df, "v", 3).orderBy("cluster").collect()] == pytest.approx(centres)


def test_hulls_against_every_line(spark):
    rng = np.random.default_rng(9)
    sets = {"many": rng.integers(0, 30, (200, 2)), "line": np.array([[i, 2 * i] for i in range(9)]), "upright": np.array([[3, i] for i in range(4)]), "one": np.array([[1, 1]] * 3), None: rng.integers(0, 5, (40, 2))}
    rows = [(k, float(a), float(b)) for k, p in sets.items() for a, b in p]
    df = spark.createDataFrame([*rows, ("bad", None, 1.0), ("bad", float("nan"), 1.0), ("bad", float("inf"), 1.0)], "k string, x double, y double").repartition(5)
    got = {x.k: x for x in hulls.convex_hulls(df, ["k"], "x", "y").collect()}
    assert set(got) == set(sets)
    for k, p in sets.items():
        p = np.unique(p, axis=0).astype(float)
        edges = []  # directed lines with no point on the right
        for a in p:
            for b in p:
                cross = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
                on = p[cross == 0]
                if (a != b).any() and (cross >= 0).all() and np.hypot(*(b - a)) == max(np.hypot(*(u - v)) for u in on for v in on):
                    edges.append((tuple(a), tuple(b)))
        corners = {a for a, _ in edges} or {tuple(p[0])}
        assert got[k].n_points == len(sets[k]) and {tuple(c) for c in got[k].corners} == corners and got[k].n_corners == len(corners)
        assert got[k].area == pytest.approx(abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in edges)) / 2, abs=1e-9)
    assert hulls.convex_hulls(df.limit(0), ["k"], "x", "y").count() == 0


def test_design_storms_and_keyed_cells(spark):
    d = spark.createDataFrame([("a", 60.0), ("b", 0.0), ("c", None)], "k string, depth double")
    got = recurrence.design_storms(d, "depth", 12, 5).collect()
    assert len(got) == 36 and [x.mm_h for x in got if x.k == "a"] == pytest.approx(recurrence.hyetograph(12, 5, 60.0))
    assert all(x.mm_h == 0 for x in got if x.k == "b") and all(x.mm_h is None for x in got if x.k == "c")
    cells = spark.createDataFrame([("a", 0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 1.0, 8.0), ("b", 4.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0, 6.0)], "k string, birth double, life double, x0 double, y0 double, vx double, vy double, sigma double, peak double")
    grid = spark.createDataFrame([("a", 0.0, 0.0, 5.0), ("b", 0.0, 0.0, 5.5), ("c", 0.0, 0.0, 5.0)], "k string, x double, y double, t double")
    rain = {x.k: x.rain for x in recurrence.storm_field(grid, cells, "x", "y", "t", 2.0, ["k"]).collect()}
    assert rain == pytest.approx({"a": 10.0, "b": 8.0, "c": 2.0})


def test_anomaly_needs_every_scored_row(spark):
    rows = [("low", t, 40.0) for t in range(12)] + [("low", 12, 1.0), ("low", 13, 2.0)] + [("half", t, 40.0) for t in range(13)] + [("half", 13, 1.0)] + [("once", t, 40.0) for t in range(12)] + [("once", 13, 1.0)]
    df = spark.createDataFrame([(*r, 40.0) for r in rows], "k string, t long, v double, b double")
    got = {r["k"]: r["n_consecutive"] for r in dicts(temporal.anomalies(df, "k", "t", "v", "b", 13))}
    assert got == {"low": 2, "once": 1}


def test_fold_keeps_the_last_entry_and_expires(spark):
    df = spark.createDataFrame([("a", 1, "close", 50), ("a", 2, "reopen", None), ("b", 1, "close", 10), ("c", 1, "close", None)], "k string, seq int, kind string, until int")
    assert [r["k"] for r in dicts(temporal.fold_log(df, "k", "seq", "kind", "until", F.lit(10)), "k")] == ["c"]


def test_radius_is_inclusive_and_crosses_cells(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "i int, x double, y double")
    b = spark.createDataFrame([(2, 30.0, 40.0), (3, -50.0, 0.0), (4, 36.0, 36.0)], "j int, u double, v double")
    assert sorted(r.j for r in spatial.radius_join(a, b, "x", "y", "u", "v", 50.0).collect()) == [2, 3]


def test_radius_join_against_every_pair(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(120)]
    a, b = spark.createDataFrame(pts[:40], "i int, x double, y double"), spark.createDataFrame(pts[40:], "j int, u double, v double")
    want = {(p[0], q[0]) for p in pts[:40] for q in pts[40:] if math.hypot(p[1] - q[1], p[2] - q[2]) <= 70}
    assert {(r.i, r.j) for r in spatial.radius_join(a, b, "x", "y", "u", "v", 70.0).collect()} == want


def test_leaders_are_not_transitive(spark):
    df = spark.createDataFrame([("a", i, 40.0 * i, 0.0, i) for i in range(4)], "area string, r int, x double, y double, t long")
    assert [r["leader"] for r in dicts(spatial.leaders(df, ["t"], "x", "y", "t", 50.0, 10, "area"), "r")] == [0, 0, 2, 2]


def test_box_edges_and_missing_points(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.1, 0.0), (float("nan"), 0.0), (None, 0.0)], "x double, y double")
    assert [r.c for r in df.select(spatial.first_box(F.col("x"), F.col("y"), [("in", 0, 0, 1, 1)]).alias("c")).collect()] == ["in", "in", None, None, None]


def test_scores_without_denominator_are_null(spark):
    df = spark.createDataFrame([("a", False, False)], "k string, f boolean, o boolean")
    got = dicts(verify.scores(verify.contingency(df, ["k"], "f", "o")))[0]
    assert (got["correct_negatives"], got["csi"], got["pod"], got["far"]) == (1, None, None, None)


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(0.0, True), (0.1, True), (1.0, False)], "p double, o boolean")
    assert [r["bin"] for r in dicts(verify.reliability(df, [], "p", "o"), "bin")] == [0, 1, 9]


@pytest.mark.parametrize(
    ("csi", "want"),
    [([0.9, 0.4, 0.9], (5, "found")), ([0.9, None, 0.1], (5, "undetermined")), ([0.9, 0.9, 0.9], (15, "beyond_scored_range")), ([0.2, 0.9, 0.9], (0, "found"))],
)
def test_skill_horizon(spark, csi, want):
    df = spark.createDataFrame([("a", 5 * (i + 1), c, 0.3) for i, c in enumerate(csi)], "k string, lead int, csi double, held double")
    got = dicts(verify.skill_horizon(df, ["k"], "lead", "csi", "held"))[0]
    assert (got["horizon"], got["status"]) == want


def test_power_law_falls_back_and_clamps(spark):
    few = spark.createDataFrame([("a", 0.1 * i, 2.0 + 0.16 * i) for i in range(7)], "k string, x double, y double")
    assert [(r.a, r.b, r.fitted) for r in calibrate.power_law(few, ["k"], "x", "y", (1.1, 1.8), (100.0, 400.0), (200.0, 1.6)).collect()] == [(200.0, 1.6, False)]
    steep = spark.createDataFrame([("a", 0.1 * i, 0.5 * i) for i in range(9)], "k string, x double, y double")
    got = calibrate.power_law(steep, ["k"], "x", "y", (1.1, 1.8), (100.0, 400.0), (200.0, 1.6)).first()
    assert got.b == 1.8 and got.a == 100.0 and got.fitted


def test_bias_without_pairs_is_one(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 9.0, 1.0), ("c", 1.0, 0.0)], "k string, g double, r double")
    assert {r["k"]: r["bias"] for r in dicts(calibrate.mean_field_bias(df, ["k"], "g", "r"))} == {"a": 1.0, "b": 5.0, "c": 1.0}


def test_reservoirs_against_a_loop(spark):
    rain = [5.0, 0.0, 12.0, 0.0, 0.0]
    s1 = s2 = pond = 0.0
    want = []
    for r in rain:
        o1, o2 = s1 / 2, s2 / 2
        s1, s2, pond = s1 + r - o1, s2 + o1 - o2, max(pond + o2 - 0.5, 0)
        want.append(pond)
    got = spark.createDataFrame([(rain,)], "rain array<double>").select(recurrence.reservoirs(F.col("rain"), 2.0, drain=0.5).alias("p")).first().p
    assert got == pytest.approx(want)


def test_hyetograph_holds_its_depth():
    blocks = recurrence.hyetograph(12, 5, 60.0)
    assert blocks.index(max(blocks)) == 4 and blocks[4] > 3 * blocks[-1]
    assert sum(b * 5 / 60 for b in blocks) == pytest.approx(60.0) and max(blocks) == blocks[4]


def test_storm_of_more_cells_than_are_broadcast_keeps_them_all(spark):
    n = 10_300
    cells = [(float(i % 977) / 7, float(i % 37 + 1) / 3, 50.0 * (i % 11), 30.0 * (i % 13), 3.0, -2.0, 100.0 + i % 5, 1.0 + i % 3) for i in range(n)]
    grid = [(x, y, t) for x in (0.0, 300.0) for y in (0.0, 200.0) for t in (0.0, 55.5, 139.0, 400.0)]
    got = {(r["x"], r["y"], r["t"]): r["rain"] for r in dicts(recurrence.storm_field(spark.createDataFrame(grid, "x double, y double, t double"), spark.createDataFrame(cells, "birth double, life double, x0 double, y0 double, vx double, vy double, sigma double, peak double"), "x", "y", "t", 2.0))}
    for x, y, t in grid:
        want = 2.0
        for birth, life, x0, y0, vx, vy, sigma, peak in cells:
            if birth <= t <= birth + life:
                want += peak * math.sin(math.pi * (t - birth) / life) * math.exp(-((x - x0 - vx * (t - birth)) ** 2 + (y - y0 - vy * (t - birth)) ** 2) / (2 * sigma**2))
        assert got.pop((x, y, t)) == pytest.approx(want)
    assert not got


def test_trees_of_any_depth(spark):
    deep = [(i, i - 1 if i else None, 1.0 if i else 500.0) for i in range(150)] + [(1000 + i, i, 2.0) for i in range(0, 150, 10)]
    tree = spark.createDataFrame(deep, "n long, p long, z double")
    up = {n: p for n, p, _ in deep}
    total, members, sill = dict.fromkeys(up, 0.0), dict.fromkeys(up, 0), {}
    for n, _, z in deep:
        a = n
        while a is not None:
            total[a], members[a], a = total[a] + z, members[a] + 1, up[a]
        sill[n] = 500.0
    got = {r["n"]: (r["total"], r["members"]) for r in dicts(graph.accumulate_to_root(tree, "n", "p", "z"))}
    assert got == {n: (total[n], members[n]) for n in up}
    assert {r["n"]: r["sill"] for r in dicts(graph.sill_to_root(tree, "n", "p", "z"))} == sill


def test_own_parents_are_roots_and_cycles_raise(spark):
    pits = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "n long, p long")
    assert {(r["node"], r["ancestor"], r["depth"]) for r in dicts(graph.closure(pits, "n", "p"))} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (2, 1, 1), (3, 2, 1), (3, 1, 2)}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "n long, p long")
    with pytest.raises(RuntimeError, match="cycle"):
        graph.closure(ring, "n", "p")


def test_held_frames_and_gaps(spark):
    frames = spark.createDataFrame([("a", 0, 0), ("a", 500, 500)], "k string, t long, frame long")
    at = lambda *ts: spark.createDataFrame([("a", t) for t in ts], "k string, t long")
    assert {r["t"]: r["frame"] for r in dicts(temporal.held(at(0, 100, 500, 600), frames, ["k"], "t", "frame", 100))} == {0: 0, 100: 0, 500: 500, 600: 500}
    for t in (-1, 101, 601):
        with pytest.raises(Exception, match="no frame is held"):
            temporal.held(at(t), frames, ["k"], "t", "frame", 100).collect()


def test_valid_times_tolerate_a_second_and_raise_on_none(spark):
    f = spark.createDataFrame([("a", 10_000_000), ("a", 20_000_000)], "k string, t long")
    o = spark.createDataFrame([("a", 10_900_000, 1.0), ("a", 9_200_000, 2.0), ("a", 21_000_001, 3.0)], "k string, t long, v double")
    assert [(r["t"], r["v"]) for r in dicts(temporal.valid_times(f, o, ["k"], "t", "v", "v"))] == [(10_000_000, 2.0)]
    with pytest.raises(ValueError, match="no valid time"):
        temporal.valid_times(f, o.where("v = 3"), ["k"], "t", "v", "v")


def test_rows_are_numbered_in_their_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i) for i in rng.sample(range(10_000), 600)]
    got = {(r["k"], r["v"]): r["n"] for r in dicts(temporal.numbered(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"]))}
    assert got == {(k, v): 1 + sum(x < v for j, x in rows if j == k) for k, v in rows}


def test_runs_are_carried_over_stretches(spark):
    from freshet.sources import feeds

    runs = spark.createDataFrame([(5, 1), (5, 2), (31, 3), (95, 4)], "cycle long, run_id long")
    instants = [0, 5, 9, 10, 30, 31, 60, 94, 95, 500]
    got = {r["t"]: r["run_id"] for r in dicts(feeds.run_at(runs, spark.createDataFrame([(t,) for t in instants], "t long"), "t", 10))}
    assert got == {0: 1, 5: 2, 9: 2, 10: 2, 30: 2, 31: 3, 60: 3, 94: 3, 95: 4, 500: 4}


def test_reservoir_fit_against_a_plain_one(spark):
    rng = random.Random(9)
    rows = [(s, i, rng.random() * 10, max(0.0, rng.gauss(3, 2) + i) * (s > 0)) for s in range(4) for i in range(30)]
    got = {r["s"]: r for r in dicts(recurrence.fit_reservoirs(spark.createDataFrame(rows, "s long, i long, x double, y double"), "s", "i", "y", "x"))}

    def error(x, y, k, gain, drain):
        s1 = s2 = pond = total = 0.0
        for r, t in zip(x, y, strict=True):
            o1, o2 = s1 / k, s2 / k
            s1, s2 = s1 + r - o1, s2 + o1 - o2
            pond = max(pond + gain * o2 - drain, 0.0)
            total += (1 + max(t, 0) / 5) * (pond - t) ** 2
        return total / len(x)

    for s in range(4):
        x, y = [r[2] for r in rows if r[0] == s], [r[3] for r in rows if r[0] == s]
        r = got[s]
        if not any(y):
            assert (r["k"], r["gain"], r["drain"], r["mse"]) == (3.0, 0.0, 0.0, 0.0)
            continue
        assert r["mse"] == pytest.approx(error(x, y, r["k"], r["gain"], r["drain"]))
        seen = []
        for k in [0.5 + 11.5 * j / 15 for j in range(16)]:
            a11 = a12 = a22 = b1 = b2 = s1 = s2 = c = 0.0
            for n, (rain, t) in enumerate(zip(x, y, strict=True), 1):
                o1, o2 = s1 / k, s2 / k
                s1, s2 = s1 + rain - o1, s2 + o1 - o2
                c += o2
                w = (1 + max(t, 0) / 5) ** 2
                a11, a12, a22, b1, b2 = a11 + w * c * c, a12 - w * c * n, a22 + w * n * n, b1 + w * c * t, b2 - w * n * t
            det = a11 * a22 - a12 * a12
            gain, drain = max((b1 * a22 - b2 * a12) / det, 0), max((a11 * b2 - a12 * b1) / det, 0)
            if gain > 0:
                seen += [error(x, y, k, gain * g, drain * d) for g in (0.6, 1, 1.5, 2.2, 3.2, 4.5, 6) for d in (0, 0.5, 1, 1.5)]
        assert r["mse"] == pytest.approx(min(seen, default=error(x, y, 3.0, 0.0, 0.0)), rel=1e-6)


def test_components_against_a_plain_walk(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), 100 + rng.randrange(90)) for _ in range(70)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["component"] for r in dicts(graph.groups(spark.createDataFrame(edges, "src long, dst long")))} == label


def test_hops_and_sills_and_costs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 9)], "src long, dst long")
    assert {r["node"]: r["hop"] for r in dicts(graph.hops(graph.both_ways(e), graph.start_nodes(spark, [2]), 1))} == {1: 1, 2: 0, 3: 1}
    tree = spark.createDataFrame([("r", None, 1.0), ("a", "r", 5.0), ("b", "a", 2.0)], "n string, p string, z double")
    assert {r["n"]: r["sill"] for r in dicts(graph.sill_to_root(tree, "n", "p", "z"))} == {"r": 1.0, "a": 5.0, "b": 5.0}
    w = e.withColumn("cost", F.lit(2.0))
    assert {r["node"]: r["cost"] for r in dicts(graph.shortest(w, graph.start_nodes(spark, [1]).withColumn("cost", F.lit(0.0))))} == {1: 0.0, 2: 2.0, 3: 4.0, 4: 6.0}
    assert {r["node"]: r["component"] for r in dicts(graph.groups(e))} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_closed_streets_are_passed_by(spark):
    arcs = spark.createDataFrame([(1, 2, "a", 60.0), (1, 3, "b", 100.0), (3, 2, "c", 100.0)], "src long, dst long, segment string, time_s double")
    risk = spark.createDataFrame([("a", 0, 0.5, 1.0)], "segment string, step int, p double, factor double")
    got = {r["node"]: r["seconds"] for r in dicts(graph.earliest_arrival(arcs, risk, graph.start_nodes(spark, [1]), 0, 300.0, 0.5, 35))}
    assert got == {1: 0.0, 2: 200.0, 3: 100.0}


def test_greedy_takes_each_place_once(spark):
    df = spark.createDataFrame([("p", "big", 2.0, "x", 9.0), ("p", "big", 2.0, "y", 9.0), ("p", "small", 1.0, "x", 8.0), ("p", "small", 1.0, "y", 1.0), ("p", "none", 0.5, "z", 0.0)], "plan string, pump string, size double, place string, score double")
    got = {r["pump"]: r["place"] for r in dicts(assign.greedy(df, "plan", "pump", ["size"], "place", "score"))}
    assert got == {"big": "x", "small": "y"}


def test_shares_are_equal_without_capacity(spark):
    df = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 0.0)], "k string, o int, c double")
    assert [(r["share"], r["upto"]) for r in dicts(assign.shares(df, ["k"], "c", "o"), "o")] == [(0.5, 0.5), (0.5, 1.0)]


def test_findings(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 5, None), ("a", 20, 300.0), ("a", 20, 1.0)], "k string, t long, v double")
    f = quality.findings(quality.gaps(df, ["k"], "t", 5), quality.out_of_range(df, "v", 0, 200), quality.missing(df, "v"), quality.repeated(df, ["k", "t"]), quality.absent_columns(df, ["v", "w"]))
    assert {(r["rule"], r["n"]) for r in dicts(f)} == {("cadence", 1), ("range", 1), ("missing", 1), ("repeated", 1), ("columns", 1)}


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.street_name(F.lit("  Link   Road / NH 8")).alias("street"),
        scalar.masked_number(F.lit("+91 98200 12345")).alias("number"),
        scalar.run_id_parts(F.lit("ABC-20190702T0310Z-sky1.0-live")).alias("run"),
        scalar.run_id_parts(F.lit("nonsense")).alias("bad"),
        scalar.pedestrian_hazard(F.lit(50.0), F.lit(-1.0)).alias("hazard"),
        scalar.pedestrian_hazard(F.lit(50.0), F.lit(None).cast("double")).alias("unknown"),
        scalar.rain_rate(scalar.reflectivity(F.lit(25.0))).alias("rate"),
        scalar.from_dbr(scalar.to_dbr(F.lit(0.05))).alias("dry"),
        scalar.slowdown(F.lit(5.0), 30.0).alias("dry_street"),
        scalar.slowdown(F.lit(99.0), 30.0).alias("deep_street"),
        scalar.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("degree"),
        scalar.fitted_text(F.lit("word " * 50)).alias("sms"),
        scalar.bearing_octant(F.lit(1.0), F.lit(0.0)).alias("east"),
    ).first()
    assert row.street == "Link Road" and row.number == "********2345" and row.run.city == "ABC" and row.run.mode == "live" and row.bad.city is None
    assert row.hazard and not row.unknown and row.rate == pytest.approx(25.0) and row.dry == 0.0 and (row.dry_street, row.deep_street) == (1.0, 3.0)
    assert row.degree == pytest.approx(111195, abs=1) and len(row.sms) <= 160 and row.sms.endswith("word...") and row.east == 2


def test_streamed_leaders_equal_the_batch_ones(spark, tmp_path):
    from freshet.streaming import cycles

    rng = random.Random(5)
    rows = [("ab"[i % 2], i, rng.uniform(0, 200), rng.uniform(0, 60), i * 40) for i in range(200)]
    df = spark.createDataFrame(rows, "area string, r long, x double, y double, t long")
    for k in range(2):
        df.where(F.floor(F.col("r") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.r: r.leader for r in cycles.to_table(cycles.fold_reports(stream, "area", "r", "x", "y", "t", 50.0, 600), "append").collect()}
    batch = spatial.leaders(df, ["t", "r"], "x", "y", "t", 50.0, 600, "area").collect()
    ids = {(r.area, r.place): r.r for r in batch}
    assert got == {r.r: ids[r.area, r.leader] for r in batch}
