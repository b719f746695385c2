"""Assertions on hand-made trials, and kernels against brute force."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrid.config import RIG
from kinegrid.functions import expr
from kinegrid.operators import align, behavior, curves, density, distances, fda, geometry, medoids, ml, plotdata, pose, registration, shapes, shapley, stats, tsc


def log_rows():
    return [(i, -0.2 if i == 3 else 0.4, 9.0 if i == 7 else 0.5, i % 2, i % 2, 4, 10.0 + i, 0.3) for i in range(20)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(log_rows(), "absolute_trial long, sample double, latency double, presented int, response int, cue int, time double, retrieval double").withColumn("session_id", F.lit("s"))


def test_behavior_filter(log):
    rows = behavior.clean_behavior(log).collect()
    assert len(rows) == 18 and {r["t0_anchor"] for r in rows} == {10.0}
    later = behavior.clean_behavior(log, trial_offset=2).collect()
    assert len(later) == 16 and {r["t0_anchor"] for r in later} == {12.0}
    assert [r["idx"] for r in sorted(later, key=lambda r: r["idx"])] == list(range(16))


def test_event_names(log):
    with pytest.raises(ValueError):
        behavior.event_frames(behavior.clean_behavior(log), 0.0, events=("nothing",))


def test_settings():
    assert RIG.framerate == 25 and RIG.peak_floor == 9.0
    with pytest.raises(Exception):
        RIG.framerate = 1


def trial_frames(spark, side: int, dev: float = 0.0):
    """Center at (820, 360), chosen port 70 px to a side; a hold, a move over frames 5 to 35, a hold."""
    goal = np.array([822.0, 430.0 if side else 290.0])
    center = np.array([820.0, 360.0])
    path = np.tile(center, (40, 1))
    for f in range(5, 40):
        share = min(1.0, (f - 5) / 30)
        path[f] = center + share * (goal - center)
    if dev:
        turn = center + np.array([0.0, -dev if side else dev])
        for f in range(5, 40):
            share = min(1.0, (f - 5) / 30)
            path[f] = center + share * 3 * (turn - center) if share < 1 / 3 else turn + (share - 1 / 3) * 1.5 * (goal - turn)
    rows = [("s", f, float(x), float(y), 10.0 if 5 <= f < 35 else 0.0) for f, (x, y) in enumerate(path)]
    return spark.createDataFrame(rows, "session_id string, frame long, x double, y double, lin_vel double")


PORTS = "session_id string, center_x double, center_y double, left_x double, left_y double, right_x double, right_y double"


def ports(spark):
    return spark.createDataFrame([("s", 820.0, 360.0, 822.0, 290.0, 822.0, 430.0)], PORTS)


def one_trial(spark, side):
    return spark.createDataFrame([("s", 0, 5, 35, side, side, 0, 4, 0.5)], "session_id string, idx long, ce long, ch long, target int, choice int, error int, cue int, rt double")


def test_axis_scale(spark):
    a = geometry.decision_axis(ports(spark)).first()
    assert a["scale"] == pytest.approx(8 / 140) and a["d_right"] == pytest.approx(70) and a["d_left"] == pytest.approx(-70)
    same = spark.createDataFrame([("s", 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], PORTS)
    assert geometry.decision_axis(same).count() == 0
    with pytest.raises(Exception, match="coincide"):
        geometry.decision_axis(same, strict=True).collect()


@pytest.mark.parametrize("side", [0, 1])
def test_straight_trial(spark, side):
    axis = geometry.decision_axis(ports(spark))
    m = geometry.build_measure_table(one_trial(spark, side), trial_frames(spark, side), axis).first()
    assert m["dev_unchosen_cm"] == pytest.approx(0) and m["i_dev"] == 0
    assert m["path_len_cm"] == pytest.approx(3.792379, abs=1e-5) and m["path_len_norm"] == pytest.approx(0.948095, abs=1e-5)
    assert m["tortuosity"] == pytest.approx(1) and m["t_commit"] == pytest.approx(0.6) and m["t_choice"] == pytest.approx(1.2)


@pytest.mark.parametrize("side", [0, 1])
def test_every_measure(spark, side):
    """The hand-made trial's goldens, with heading and behaviour columns."""
    axis = geometry.decision_axis(ports(spark))
    series = trial_frames(spark, side).withColumns({"ang_vel": F.lit(0.0), "head_angle": F.lit(math.atan2(70.0 if side else -70.0, 2.0))})
    table = geometry.build_measure_table(one_trial(spark, side).withColumn("sampling", F.lit(0.4)), series, axis)
    m = table.first()
    assert m["head_to_chosen"] == pytest.approx(0.999592, abs=1e-6) and m["peak_lin_vel"] == 10 and m["t_peak_lin_vel"] == 0 and m["vel_choice"] == 0
    assert m["peak_ang_vel"] == 0 and m["sampling"] == 0.4 and {"sampling", "rt", "t_choice"} <= set(geometry.measure_columns(table))
    assert not {"idx", "target", "choice", "error"} & set(geometry.measure_columns(table))


def test_session_series_needs_its_heading_node(spark):
    rows = spark.createDataFrame([("s", f, n, float(f) + d, d) for f in range(10) for n, d in (("l", 0.0), ("r", 1.0))], "session_id string, frame long, node string, x double, y double")
    with pytest.raises(KeyError):
        pose.session_series(rows, left="l", right="r", heading="nose")
    assert pose.session_series(rows, left="l", right="r").where("lin_vel > 0 and ang_vel = 0").count() == 10


def test_bootstrap_is_reproducible(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    one, two = (stats.bootstrap_mean_ci(rows.repartition(n), "v", ["g"], n_boot=100).orderBy("g").collect() for n in (1, 7))
    assert [(r["g"], pytest.approx(r["low"]), pytest.approx(r["high"])) for r in one] == [(r["g"], r["low"], r["high"]) for r in two]


def test_bootstrap_draws_equal_rows_one_by_one(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("double").alias("v"))
    r = stats.bootstrap_mean_ci(rows, "v", [], n_boot=500).first()
    assert r["mean"] == 0.5 and 0.42 < r["low"] < 0.47 and 0.53 < r["high"] < 0.58
    keyed = stats.bootstrap_mean_ci(rows.withColumn("g", F.when(F.col("v") > 2, "x")), "v", ["g"], n_boot=50)
    assert keyed.columns == ["g", "mean", "low", "high"] and keyed.first()["g"] is None


def test_bowed_trial(spark):
    axis = geometry.decision_axis(ports(spark))
    m = geometry.build_measure_table(one_trial(spark, 1), trial_frames(spark, 1, 20.0), axis).first()
    assert m["dev_unchosen_cm"] == pytest.approx(1.142391, abs=1e-3) and m["i_dev"] == 10 and m["tortuosity"] > 1.3


def test_empty_measures(spark):
    axis = geometry.decision_axis(ports(spark))
    none = geometry.build_measure_table(one_trial(spark, 1).where("idx > 5"), trial_frames(spark, 1), axis)
    assert none.count() == 0 and "path_len_cm" in geometry.measure_columns(none) and "target" not in geometry.measure_columns(none)


def test_missing_port_side(spark):
    p = geometry.locate_ports(one_trial(spark, 1), trial_frames(spark, 1)).first()
    assert p["left_x"] is None and (p["right_x"], p["right_y"]) == (822.0, 430.0)
    assert len(geometry.ports_array(geometry.locate_ports(one_trial(spark, 1), trial_frames(spark, 1))).first()["ports"]) == 2


def test_build_trials(spark):
    t = spark.createDataFrame([("s", 0, 5, 30), ("s", 1, 60, 61)], "session_id string, idx long, entry long, choice_frame long")
    rows = align.build_trials(t, trial_frames(spark, 1)).collect()
    assert [(r["w_start"], r["w_end"], len(r["samples"])) for r in rows] == [(0, 40, 40)]


def test_clean_outliers_settles(spark):
    rows = [("s", f, 500.0 if f == 4 else float(f), 0.0) for f in range(10)]
    got = pose.clean_outliers(spark.createDataFrame(rows, "session_id string, frame long, x double, y double")).orderBy("frame").collect()
    assert all(abs(r["x"] - r["frame"]) < 1e-9 for r in got) and got[0]["cleaning_rounds"] < 100


def test_short_series_has_no_velocity(spark):
    rows = spark.createDataFrame([("s", f, float(f), 0.0) for f in range(6)], "session_id string, frame long, x double, y double")
    assert {r["velocity"] for r in pose.velocity(rows).collect()} == {None}
    line = spark.createDataFrame([("s", f, 2.0 * f, 0.0) for f in range(9)], "session_id string, frame long, x double, y double")
    assert all(r["velocity"] == pytest.approx(2) for r in pose.velocity(line).collect())


def test_unwrap_inverts_wrap(spark):
    rows = [("s", i, math.cos(0.9 * i), math.sin(0.9 * i)) for i in range(30)]
    got = pose.angular_measures(spark.createDataFrame(rows, "session_id string, frame long, hx double, hy double")).orderBy("frame").collect()
    assert all(r["angle_unwrapped"] == pytest.approx(0.9 * r["frame"], abs=1e-9) for r in got)
    assert got[3]["ang_vel"] == pytest.approx(22.5)


def test_half_turns_go_where_the_c_library_says(spark):
    rng = np.random.default_rng(3)
    rows, angles = [], {}
    for s in range(300):
        hx, hy, sign = round(float(rng.uniform(-20, 20)), 2), int(rng.integers(0, 8)) + 0.5, rng.choice([-1, 1])
        frames = [(round(20.5 + m * hx, 2) - 20.5, m * hy) for i in range(6) for m in [float(sign * (-1) ** i * rng.choice([1, 3, 5]))]]
        rows += [(s, i, x, y) for i, (x, y) in enumerate(frames)]
        a = np.array([math.atan2(y, x) for x, y in frames])
        turned = a + math.pi
        angles[s] = np.unwrap(turned - 2 * math.pi * np.floor(turned / (2 * math.pi)) - math.pi)
    got = pose.angular_measures(spark.createDataFrame(rows, "session_id long, frame long, hx double, hy double")).collect()
    assert len(got) == 1800
    assert all(r["angle_unwrapped"] == pytest.approx(angles[r["session_id"]][r["frame"]], abs=1e-9) for r in got)
    none = pose.angular_measures(spark.createDataFrame([(1, 0, None, 1.0), (1, 1, 1.0, 1.0)], "session_id long, frame long, hx double, hy double")).orderBy("frame").collect()
    assert [r["head_angle"] for r in none] == [None, pytest.approx(math.pi / 4)]


def test_lerp(spark):
    got = spark.range(1).select(*[expr.lerp_at(F.array(F.lit(0.0), F.lit(2.0), F.lit(6.0)), F.lit(a)).alias(str(i)) for i, a in enumerate((-1.0, 0.5, 1.5, 9.0))]).first()
    assert tuple(got) == (0.0, 1.0, 4.0, 6.0)


def test_ranks_and_p_values(spark):
    df = spark.createDataFrame([(float(v), g) for v, g in [(1, 1), (2, 1), (2, 0), (5, 0), (7, 1), (None, 0)] if v is not None], "v double, g int")
    assert sorted(r["r_v"] for r in stats.mid_ranks(df, ["v"]).collect()) == [1, 2.5, 2.5, 4, 5]
    r = stats.rank_biserial(df, "v", "g").first()
    assert (r["n1"], r["n0"]) == (3, 2) and r["u"] == pytest.approx(2.5)
    assert stats.mann_whitney_p(0, 3, 3) == pytest.approx(0.1) and stats.mann_whitney_p(4.5, 3, 3) == pytest.approx(1.0)
    assert stats.mann_whitney_p(30.0, 20, 9) == pytest.approx(stats.mann_whitney_p(150.0, 9, 20))
    assert stats.spearman_p(0.0, 10) == pytest.approx(1.0) and stats.spearman_p(1.0, 10) == 0.0
    assert stats.spearman_p(0.5, 12) == pytest.approx(0.0978, abs=2e-3)


def test_permutation_ignores_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.random((40, 3))], "a double, b double, c double")
    one, two = (stats.perm_partial_p(d, "a", "b", "c", n_perm=60) for d in (df, df.repartition(3)))
    assert one == pytest.approx(two)


def test_shuffles_are_bijections_and_differ(spark):
    places = spark.range(37).crossJoin(spark.range(1, 41).withColumnRenamed("id", "r")).withColumn("to", stats.shuffled_place(F.col("id"), F.col("r"), 37, 0)).toPandas()
    assert all(sorted(p) == list(range(37)) for _, p in places.groupby("r")["to"]) and places.groupby("r")["to"].apply(tuple).nunique() == 40
    assert places.groupby("id")["to"].mean().between(10, 26).all()


def test_replicates_as_tasks_and_as_rows_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 50
    g, e = np.arange(n) % 2, rng.integers(0, 2, n)
    a = np.round(rng.random(n), 1)
    b = np.round(a * (g + 0.2) + rng.random(n), 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, rng.integers(0, 4, n), g, e)], "a double, b double, c double, g double, e double")
    df = df.union(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0), (0.5, 1.0, 1.0, 3.0, 1.0)], df.schema))
    tests = [lambda: stats.perm_partial_p(df, "a", "b", "c", n_perm=300), lambda: stats.perm_diff_partial(df, "a", "b", "c", "g", n_perm=300), lambda: stats.perm_diff_biserial(df, "a", "e", "g", n_perm=300)]
    tasks = [f() for f in tests]
    assert tasks == [f() for f in tests]
    monkeypatch.setattr(stats, "TASK_ROWS", 10)
    for one, f in zip(tasks, tests, strict=True):
        other = f()
        assert one["observed"] == pytest.approx(other["observed"]) and abs(one["p"] - other["p"]) < 0.12


def test_permutation_tests_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 60
    a, c, g, e = rng.random(n), rng.integers(0, 4, n), np.arange(n) % 2, rng.integers(0, 2, n)
    b = a * (g + 0.2) + rng.random(n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, g, e)], "a double, b double, c double, g double, e double")
    rank = lambda v: (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2

    def partial(k):
        r = np.corrcoef([rank(v[k]) for v in (a, b, c)])
        return (r[0, 1] - r[0, 2] * r[1, 2]) / math.sqrt((1 - r[0, 2] ** 2) * (1 - r[1, 2] ** 2))

    def effect(k):
        x, y = a[k & (e == 0)], a[k & (e == 1)]
        return ((x[:, None] > y).mean() + (x[:, None] == y).mean() / 2) * 2 - 1

    def p(f, label):
        null = [f(q == 1) - f(q == 0) for q in (rng.permutation(label) for _ in range(1000))]
        return np.mean(np.abs(null) >= abs(f(label == 1) - f(label == 0)))

    for found, f in ((stats.perm_diff_partial(df, "a", "b", "c", "g", n_perm=300), partial), (stats.perm_diff_biserial(df, "a", "e", "g", n_perm=300), effect)):
        assert found["observed"] == pytest.approx(f(g == 1) - f(g == 0)) and abs(found["p"] - p(f, g)) < 0.12
    assert stats.perm_partial_p(df, "a", "b", "c", n_perm=100)["observed"] == pytest.approx(partial(g >= 0))


def bumps(spark, shifts):
    t = np.linspace(0, 1, 41)
    return spark.createDataFrame([(i, np.exp(-(((t - 0.5 - s) / 0.1) ** 2)).tolist()) for i, s in enumerate(shifts)], "idx long, y array<double>")


def test_registration_invariants(spark):
    out, info = fda.elastic_register(bumps(spark, [-0.1, 0.0, 0.1]), max_iter=4)
    rows = {r["idx"]: r for r in out.collect()}
    for r in rows.values():
        g = np.array(r["warping"])
        assert g[0] == 0 and g[-1] == 1 and (np.diff(g) >= -1e-9).all()
    assert rows[0]["lag"] < rows[1]["lag"] < rows[2]["lag"]
    peaks = [int(np.argmax(r["registered"])) for r in rows.values()]
    assert max(peaks) - min(peaks) <= 2
    same, _ = fda.elastic_register(bumps(spark, [0.0, 0.0, 0.0]), max_iter=2)
    assert all(abs(r["lag"]) < 1e-6 for r in same.collect())


def locked(spark):
    df = bumps(spark, [-0.1, -0.04, 0.02, 0.07, 0.1, 0.05]).unionByName(bumps(spark, [0.02, 0.03, -0.05, 0.01]).withColumn("idx", F.col("idx") + 10))
    return df.withColumn("event", F.when(F.col("idx") < 10, "in").otherwise("out")).withColumn("session_id", F.lit("s"))


def plain_warps(q1, q2, t):
    """The warps' dynamic programme, a slope's differences at a time; and the squared distance that is left."""
    n, p, h = len(q2), len(t), t[1] - t[0]
    cost, back = np.full((p, n, p), np.inf), np.zeros((p, n, p), int)
    cost[0, :, 0] = 0.0
    for i in range(1, p):
        for s, (di, dj) in enumerate(registration.SLOPES):
            if di <= i and dj < p:
                at = np.arange(p - dj)[:, None] + np.arange(1, di + 1) * (dj / di)
                lo = np.minimum(at.astype(int), p - 2)
                moved = (q2[:, lo] + (q2[:, lo + 1] - q2[:, lo]) * (at - lo)) * math.sqrt(dj / di)
                total = cost[i - di, :, : p - dj] + h * ((q1[:, None, i - di + 1 : i + 1] - moved) ** 2).sum(axis=2)
                better = total < cost[i, :, dj:]
                cost[i, :, dj:][better], back[i, :, dj:][better] = total[better], s
    out = np.empty((n, p))
    for r in range(n):
        path = [(p - 1, p - 1)]
        while path[-1][0]:
            i, j = path[-1]
            di, dj = registration.SLOPES[back[i, r, j]]
            path.append((i - di, j - dj))
        x, y = np.array(path[::-1]).T
        out[r] = np.interp(t, t[0] + x * h, t[0] + y * h)
    return out, cost[-1, :, -1]


def test_warps_are_those_of_the_plain_programme_and_faster():
    rng = np.random.default_rng(4)
    for n, p in ((40, 3), (40, 6), (40, 20), (256, 50)):
        t = np.linspace(0, 1, p)
        a, b = (registration.srsf(np.cumsum(rng.normal(size=(n, p)), axis=1), t) for _ in range(2))
        b[0] = a[0]
        began = time.process_time()
        want, left = plain_warps(a, b, t)
        plain = time.process_time() - began
        got = registration.best_warps(a, b, t)
        assert np.allclose(got, want, atol=1e-9) and np.allclose(got[0], t)
        assert left[0] == pytest.approx(0, abs=1e-9)
        took = time.process_time() - began - plain
        assert p < 50 or took < plain / 2
    flat = np.stack([a, b], axis=1)
    assert np.allclose(registration.best_warps(flat, flat, t), t)


def test_groups_are_registered_as_if_alone(spark):
    df = locked(spark)
    rows, groups = registration.register_groups(df.repartition(5), ["session_id", "idx"], ["event"], max_iter=4)
    got = {r["idx"]: r for r in rows.collect()}
    for event in ("in", "out"):
        own = df.where(F.col("event") == event)
        alone, info = fda.elastic_register(own, max_iter=4)
        scores = {r["idx"]: r for r in fda.amplitude_phase_scores(alone).collect()}
        _, model = fda.fpca(own, 4, weighted=True)
        group = groups.where(F.col("event") == event).first()
        assert group["n"] == own.count() and group["pc1_var"] == pytest.approx(model["ratio"][0]) and group["rounds"] == info["rounds"]
        assert group["template"] == pytest.approx(info["template"].tolist())
        for r in alone.collect():
            assert got[r["idx"]]["lag"] == pytest.approx(r["lag"], abs=1e-9) and got[r["idx"]]["warping"] == pytest.approx(r["warping"])
            for c in ("amp", "phase", "joint"):
                assert [abs(v) for v in got[r["idx"]][c]] == pytest.approx([abs(v) for v in scores[r["idx"]][c]], abs=1e-6)


def test_registration_goes_on_from_its_state(spark, tmp_path):
    df = locked(spark)
    keys, by = ["session_id", "idx"], ["event"]
    whole = registration.fit_templates(df, keys, by, max_iter=5, tol=1e-9)
    registration.fit_templates(df, keys, by, max_iter=2, tol=1e-9).write.parquet(str(tmp_path / "state"))
    kept = spark.read.parquet(str(tmp_path / "state"))
    assert {r["rounds"] for r in kept.collect()} == {2}
    on = registration.fit_templates(df, keys, by, state=kept, max_iter=5, tol=1e-9)
    a, b = ({r["_g"]: r for r in s.collect()} for s in (whole, on))
    assert set(a) == set(b) and all(a[g]["template"] == pytest.approx(b[g]["template"]) and a[g]["objective"] == pytest.approx(b[g]["objective"]) for g in a)


def test_reports_of_registrations(spark):
    df = locked(spark)
    report = {r["event"]: r for r in registration.convergence_report(df, ["session_id", "idx"], ["event"], (1, 2)).collect()}
    assert report["in"]["n"] == 6 and report["in"]["lag_corr"] > 0.9 and report["in"]["lag_stable"] == (report["in"]["lag_corr"] >= 0.99)
    labels = df.select("session_id", "idx", (-F.col("idx")).cast("double").alias("rt"), F.lit(1).alias("cue"))
    table, rows = registration.compare_event_locks(df, labels, max_iter=1)
    got = {r["event"]: r for r in table.collect()}
    assert rows.count() == 10 and got["in"]["n"] == 6 and got["out"]["lag_cue"] is None and 0 < got["out"]["pc1_var"] <= 1
    lag = {r["idx"]: r["lag"] for r in rows.collect() if r["event"] == "in"}
    order = lambda v: np.argsort(np.argsort(v))
    assert got["in"]["lag_rt"] == pytest.approx(np.corrcoef(order([lag[i] for i in range(6)]), order([-i for i in range(6)]))[0, 1])
    assert registration.register_groups(df.limit(0), ["session_id", "idx"], ["event"])[0].count() == 0


def arcs(spark, count=6, by=1):
    """Arcs of unlike bend, turned, shifted and run through at unlike speeds."""
    rng, rows = np.random.default_rng(4), []
    for i in range(count):
        t = np.linspace(0, 1, 31)
        t = t + 0.15 * rng.random() * np.sin(np.pi * t) * t
        bend = 0.3 * (i % 3)
        b = np.stack([t, bend * np.sin(np.pi * t)])
        a = rng.random() * 6
        b = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) @ b * by + rng.random((2, 1))
        rows.append(("s", i, b[0].tolist(), b[1].tolist()))
    return spark.createDataFrame(rows, "session_id string, idx long, u array<double>, v array<double>")


def test_shapes_are_invariant(spark):
    scores, group = shapes.elastic_shapes(arcs(spark), n=2, max_iter=5)
    group = group.first()
    d = {r["idx"]: r for r in scores.collect()}
    assert group["ratio"][0] > 0.9 and len(group["modes_u"]) == 4 and len(group["mean_u"]) == 31
    for i in range(3):  # the same bend has the same shape, whatever its place, turn and speed
        assert d[i]["scores"] == pytest.approx(d[i + 3]["scores"], abs=0.15)
    assert abs(d[0]["scores"][0] - d[2]["scores"][0]) > 0.3
    one, mean = shapes.elastic_shapes(arcs(spark, 1).unionByName(arcs(spark, 1).withColumn("idx", F.lit(9).cast("long"))), n=1)
    assert all(r["distance"] < 1e-6 for r in one.collect())
    path = arcs(spark, 1).first()
    length = lambda u, v: np.hypot(np.diff(u), np.diff(v)).sum()
    mean = mean.first()
    assert length(mean["mean_u"], mean["mean_v"]) == pytest.approx(length(path["u"], path["v"]), rel=0.01)
    large, _ = shapes.elastic_shapes(arcs(spark, 6, 5), n=2, scale=True, max_iter=2)
    small, _ = shapes.elastic_shapes(arcs(spark, 6, 1), n=2, scale=True, max_iter=2)
    b = {r["idx"]: r["scores"] for r in small.collect()}
    assert all([abs(x) for x in r["scores"]] == pytest.approx([abs(x) for x in b[r["idx"]]], abs=1e-6) for r in large.collect())
    labels = scores.select("session_id", "idx", (F.col("idx") % 2).cast("int").alias("error"), F.lit(1).alias("cue"))
    assert shapes.shape_contrasts(scores, labels, 2).count() == 2


def test_shift_lag(spark):
    got = {r["idx"]: r["shift"] for r in fda.shift_lag(bumps(spark, [-0.1, 0.0, 0.1])).collect()}
    assert got[2] - got[0] == pytest.approx(0.2, abs=0.03)


def test_shifts_are_those_of_single_curves(spark):
    rng = np.random.default_rng(2)
    y, t, shifts = rng.random((40, 11)).cumsum(axis=1), np.linspace(0, 1, 11), np.linspace(-0.5, 0.5, 21)
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda c: (read.add(1), c)[1], "array<double>").asNondeterministic()
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(y)], "idx long, y array<double>").select("idx", seen("y").alias("y"))
    got = {r["idx"]: r["shift"] for r in fda.shift_lag(rows, steps=21, rounds=3).collect()}
    mean = y.mean(axis=0)
    for _ in range(3):
        moved = np.array([[np.interp(t + s, t, c) for s in shifts] for c in y])
        best = ((moved - mean) ** 2).sum(axis=2).argmin(axis=1)
        mean = moved[np.arange(40), best].mean(axis=0)
    assert got == {i: pytest.approx(shifts[k]) for i, k in enumerate(best)}
    assert read.value == 40  # the curves are made once, not in every round


def test_fpca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.random((30, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "idx long, y array<double>")
    _, model = fda.fpca(df, 3)
    values = np.linalg.eigvalsh(np.cov(y.T))[::-1]
    assert model["ratio"] == pytest.approx(values[:3] / values.sum())


def test_dtw_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, b = rng.random(7), rng.random(5)
        d = np.full((8, 6), np.inf)
        d[0, 0] = 0
        for i in range(1, 8):
            for j in range(1, 6):
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        assert ml.dtw(a, b) == pytest.approx(d[7, 5]) and ml.dtw(a, a) == 0


def test_density_clusters():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[20.0, -20.0]]])
    label = density.density_clusters(points, 10)
    assert len(set(label[:30])) == 1 and len(set(label[30:60])) == 1 and label[0] != label[40] and label[60] == -1


def test_varimax_is_a_rotation():
    r = ml.varimax(np.random.default_rng(0).random((6, 3)))
    assert r.T @ r == pytest.approx(np.eye(3), abs=1e-9) and (ml.varimax(np.ones((4, 1))) == 1).all()


def test_shapelet_of_the_same_series():
    y = np.sin(np.arange(30.0))
    assert tsc.shapelet_distance(y, y[4:12]) == pytest.approx(0)
    assert tsc.information_gain(np.array([[1, 0], [1, 0], [0, 1], [0, 1]])) == pytest.approx(1)


def test_views_and_padding(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    r = plotdata.VIEWS["paper"].apply(df).first()
    assert (r["u"], r["v"]) == (2.0, 1.0)
    paths = spark.createDataFrame([(0, [1.0], [1.0]), (1, [1.0, 2.0], [3.0, 4.0])], "idx long, x array<double>, y array<double>")
    assert {tuple(r["x"]) for r in plotdata.padded(paths, ["idx"]).collect()} == {(1.0, None), (1.0, 2.0)}


def test_first_peak_and_no_peak(spark):
    rows = [("s", 0, k, v) for k, v in enumerate([0.0, 5.0, 1.0, 12.0, 3.0])] + [("s", 1, k, 1.0) for k in range(5)]
    s = spark.createDataFrame(rows, "session_id string, idx long, k long, lin_vel double")
    peaks = curves.first_peak(s)
    assert [(r["idx"], r["peak_k"]) for r in peaks.collect()] == [(0, 3)]
    rest = {r["idx"]: r["rest_k"] for r in curves.rest_minimum(s, peaks).collect()}
    assert rest == {0: 2, 1: 0}


def edit_distance(name, x, y):
    """The three programmes as plain recurrences."""
    n, m = len(x), len(y)
    d = np.full((n + 1, m + 1), np.inf)
    split = lambda v, a, b: 1.0 if a <= v <= b or b <= v <= a else 1.0 + min(abs(v - a), abs(v - b))
    d[0, 0] = 0.0
    if name == "msm":
        e = np.zeros((n, m))
        for i in range(n):
            for j in range(m):
                ways = []
                if i == j == 0:
                    ways.append(abs(x[0] - y[0]))
                if i and j:
                    ways.append(e[i - 1, j - 1] + abs(x[i] - y[j]))
                if i:
                    ways.append(e[i - 1, j] + split(x[i], x[i - 1], y[j]))
                if j:
                    ways.append(e[i, j - 1] + split(y[j], x[i], y[j - 1]))
                e[i, j] = min(ways)
        return e[-1, -1]
    a, b = np.concatenate([[0], x]), np.concatenate([[0], y])
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if name == "dtw":
                d[i, j] = (a[i] - b[j]) ** 2 + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
            elif name == "dtw2" and abs(i - j) <= 2:
                d[i, j] = (a[i] - b[j]) ** 2 + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
            elif name == "twe":
                match = d[i - 1, j - 1] + (a[i] - b[j]) ** 2 + (a[i - 1] - b[j - 1]) ** 2 + 0.002 * abs(i - j)
                d[i, j] = min(match, d[i - 1, j] + (a[i] - a[i - 1]) ** 2 + 1.001, d[i, j - 1] + (b[j] - b[j - 1]) ** 2 + 1.001)
    return d[n, m]


def test_elastic_distances_are_brute_force():
    rng = np.random.default_rng(7)
    rows, one = rng.normal(size=(5, 20)), rng.normal(size=20)
    for name, as_ in (("dtw", "dtw"), ("msm", "msm"), ("twe", "twe"), ("dtw@0.1", "dtw2")):
        assert distances.distances_to(rows, one, name) == pytest.approx([edit_distance(as_, r, one) for r in rows])
    assert distances.distances_to(rows, one, "msm:2") == pytest.approx([edit_distance("msm", r[:10], one[:10]) + edit_distance("msm", r[10:], one[10:]) for r in rows])
    many = np.cumsum(rng.normal(size=(400, 20)), axis=1)
    at, d, measured = distances.nearest(many, many[3], 5)
    every = distances.distances_to(many, many[3], "dtw@0.1")
    best = np.lexsort((np.arange(400), every))[:5]
    assert at.tolist() == best.tolist() and d == pytest.approx(every[best]) and measured < 300
    assert (distances.lower_bounds(many, many[3], 2) <= every + 1e-9).all()


def blobs(spark, n=120, p=8):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, p)) * 4
    return np.stack([centres[i % 3] + rng.normal(size=p) for i in range(n)])


def voronoi(d, k, start):
    chosen = list(start)
    while True:
        label = d[:, chosen].argmin(axis=1)
        new = [int(np.flatnonzero(label == c)[d[np.ix_(label == c, label == c)].sum(axis=1).argmin()]) for c in range(k)]
        if new == chosen:
            return chosen, d[:, chosen].min(axis=1).sum()
        chosen = new


def test_move_split_merge_is_the_plain_programme_and_faster():
    def split(x, y, z):
        inside = ((y <= x) & (x <= z)) | ((z <= x) & (x <= y))
        return np.where(inside, 1.0, 1.0 + np.minimum(np.abs(x - y), np.abs(x - z)))

    def plain(a, b):
        """All cells of all rows at once, a diagonal after the other."""
        n, m = a.shape[1], len(b)
        d = np.zeros((len(a), n, m))
        d[:, 0, 0] = np.abs(a[:, 0] - b[0])
        for i in range(1, n):
            d[:, i, 0] = d[:, i - 1, 0] + split(a[:, i], a[:, i - 1], b[0])
        for j in range(1, m):
            d[:, 0, j] = d[:, 0, j - 1] + split(b[j], a[:, 0], b[j - 1])
        for s in range(2, n + m - 1):
            i = np.arange(max(1, s - m + 1), min(n - 1, s - 1) + 1)
            j = s - i
            up, side = d[:, i - 1, j] + split(a[:, i], a[:, i - 1], b[j]), d[:, i, j - 1] + split(b[j], a[:, i], b[j - 1])
            d[:, i, j] = np.minimum(np.minimum(d[:, i - 1, j - 1] + np.abs(a[:, i] - b[j]), up), side)
        return d[:, -1, -1]

    rng = np.random.default_rng(9)
    for rows, n, m in ((3, 1, 1), (3, 1, 4), (3, 4, 1), (5, 2, 3), (600, 13, 9), (2048, 32, 32)):
        a, b = np.round(rng.normal(size=(rows, n)), 1), np.round(rng.normal(size=m), 1)
        began = time.process_time()
        want = plain(a, b)
        took = time.process_time() - began
        assert (distances.msm(a, b) == want).all()
        assert rows < 2048 or time.process_time() - began - took < took / 1.5


def test_kmedoids_reaches_the_inertia_of_a_distance_matrix(spark):
    x = blobs(spark)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, y array<double>")
    labels, found, inertia = medoids.kmedoids(df.repartition(5), 3, n_init=4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    best = min(voronoi(d, 3, s)[1] for s in ([0, 1, 2], [3, 4, 5], [0, 3, 1]))
    got = {r["i"]: r for r in labels.collect()}
    assert inertia == pytest.approx(best) and sum(r["d"] for r in got.values()) == pytest.approx(inertia)
    assert all(got[i]["cluster"] == got[i % 3]["cluster"] for i in range(120)) and len(set(found)) == 3
    s = {r["i"]: r["s"] for r in medoids.silhouettes(df, labels).collect()}
    own = [got[i]["cluster"] for i in range(120)]
    for i in (0, 7, 50):
        mean = {c: np.mean([d[i, j] for j in range(120) if own[j] == c and j != i]) for c in set(own)}
        b = min(v for c, v in mean.items() if c != own[i])
        assert s[i] == pytest.approx((b - mean[own[i]]) / max(b, mean[own[i]]))
    scores = medoids.suggest_k(df, (2, 3, 4), n_init=2)
    assert max(scores, key=scores.get) == 3
    with pytest.raises(ValueError):
        medoids.kmedoids(df.limit(2), 3)


def test_all_pairs_are_measured_block_by_block(spark, monkeypatch, tmp_path):
    from kinegrid.plans import inference

    monkeypatch.setattr(ml, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ml, "PAIR_ROWS", 10)
    rng = np.random.default_rng(8)
    y = rng.normal(size=(90, 12)).astype(np.float32).astype(float)
    y[40:60] = y[3]
    label = np.where(np.arange(90) == 7, 5, np.arange(90) % 3)
    spark.createDataFrame([(i, c.tolist(), int(g)) for i, (c, g) in enumerate(zip(y, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    d = np.sqrt(((y[:, None] - y) ** 2).sum(axis=2))
    total = np.stack([d[:, label == g].sum(axis=1) for g in (0, 1, 2, 5)], axis=1)
    want = {}
    for i in range(90):
        own = (0, 1, 2, 5).index(label[i])
        size = np.array([(label == g).sum() - (g == label[i]) for g in (0, 1, 2, 5)])
        mean = total[i] / np.maximum(size, 1)
        a, b = mean[own], np.delete(mean, own).min()
        want[i] = (b - a) / max(a, b) if size[own] else 0.0
    got = {r["i"]: r["s"] for r in inference.q38_silhouette(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1.1e-6) for i in got)
    medoids_ = {r["cluster"]: r["medoid"] for r in inference.q38b_medoids(spark, str(tmp_path)).collect()}
    assert medoids_ == {g: min(np.flatnonzero(label == g), key=lambda i: (round(d[i, label == g].sum(), 9), i)) for g in (0, 1, 2, 5)}


def test_medoids_beyond_the_reference(spark, monkeypatch):
    monkeypatch.setattr(medoids, "REFERENCE", 8)
    monkeypatch.setattr(medoids, "CANDIDATES", 6)
    x = blobs(spark)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, y array<double>")
    one, two = (medoids.kmedoids(df.repartition(n), 3, n_init=2)[1:] for n in (2, 7))
    assert one[0] == two[0] and one[1] == pytest.approx(two[1])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert one[1] < 1.05 * voronoi(d, 3, [0, 1, 2])[1]


def test_cluster_timeseries(spark):
    t = np.linspace(0, 1, 20)
    rows = [("s", i, c, k, float(np.sin(6 * (t[k] + 0.05 * (i // 2))) * (1 if i % 2 else -1) * (2 if c == "b" else 1))) for i in range(8) for c in ("a", "b") for k in range(20)]
    df = spark.createDataFrame(rows, "session_id string, idx long, channel string, k long, y float")
    for name in ("msm", "dtw"):
        labels, _, _ = medoids.cluster_timeseries(df, 2, distance=name, z=True, n_init=2)
        got = {r["idx"]: r["cluster"] for r in labels.collect()}
        assert labels.columns == ["session_id", "idx", "cluster", "d"] and len({got[i] for i in (0, 2, 4, 6)}) == 1 and got[0] != got[1]


def test_density_cells_are_weighted_points(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.3, (60, 2)), rng.uniform(-10, 14, (20, 2))]).round(1)
    each = density.density_clusters(x)
    places, at, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    whole = density.density_clusters(places, 10, n, np.zeros(len(places)))[at]
    same = lambda l: [[a == b for b in l] for a in l]
    assert same(each[each >= 0]) == same(whole[each >= 0]) and ((each < 0) == (whole < 0)).all()
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "i long, a double, b double")
    few = {r["i"]: r["cluster"] for r in density.cluster_points(df.repartition(3), "a", "b").collect()}
    assert same([few[i] for i in range(140)]) == same(each.tolist())
    many = np.concatenate([rng.normal(0, 0.3, (3000, 2)), rng.normal(4, 0.3, (3000, 2))])
    big = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(many)], "i long, a double, b double")
    got = {r["i"]: r["cluster"] for r in density.cluster_points(big, "a", "b", cells=500).collect()}
    main = [max(set(v), key=v.count) for v in ([got[i] for i in range(3000)], [got[i] for i in range(3000, 6000)])]
    assert len(got) == 6000 and main[0] != main[1] and min(main) >= 0
    assert sum(got[i] == main[i // 3000] for i in range(6000)) > 5000
    assert density.cluster_points(df.limit(0), "a", "b").count() == 0


def test_shapley_values_are_brute_force(spark):
    from itertools import combinations

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i long, a double, b double, c double, d double, y double")
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    model = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(rows)
    found = shapley.model_leaves(model, spark)
    got = {r["i"]: r for r in shapley.shapley_values(df, {"1": found}, list("abcd"), ["i"]).collect()}
    raw = {r["i"]: float(r["rawPrediction"][1]) for r in model.transform(rows).select("i", "rawPrediction").collect()}

    def given(row, known):
        """The expected margin with some features known."""
        return sum(leaf.value * math.prod(float(low < row[f] <= high) if f in known else share for f, low, high, share in leaf.conditions) for leaf in found)

    for i in range(0, 80, 9):
        assert got[i]["expected"] + sum(got[i]["phi"]) == pytest.approx(raw[i])
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(math.factorial(s) * math.factorial(3 - s) / 24 * (given(x[i], {*c, f}) - given(x[i], set(c))) for s in range(4) for c in combinations(rest, s))
            assert got[i]["phi"][f] == pytest.approx(want, abs=1e-9)
    three = df.withColumn("y", (F.col("a") > 0.5).cast("int") + (F.col("a") > -0.5).cast("int"))
    importance, values, score = shapley.classifier_importance(three, list("abcd"), "y", ["i"], rounds=3)
    assert importance.first()["feature"] == "a" and {r["class"] for r in values.collect()} == {"0", "1", "2"} and score > 0.6


def test_multirocket_is_a_direct_loop():
    rng = np.random.default_rng(12)
    y = rng.normal(size=(3, 30)).cumsum(axis=1)
    plan = tsc.multirocket_plan(y, 3 * 84)
    got, at = tsc.multirocket_rows(y, plan), 0
    assert sum(len(b) for d, b in plan[0]) == 3
    for form, steps in zip((y, np.diff(y, axis=1)), plan):
        p = form.shape[1]
        for d, biases in steps:
            for i, bias in enumerate(biases):
                inside = range(4 * d, p - 4 * d) if i % 2 and p > 8 * d else range(p)
                for k in range(84):
                    for r in range(3):
                        z = []
                        for t in inside:
                            terms = ((2.0 if j in tsc.TRIPLES[k] else -1.0) * form[r, t + (j - 4) * d] for j in range(9) if 0 <= t + (j - 4) * d < p)
                            z.append(sum(terms) - bias[k])
                        on = [t for t, v in enumerate(z) if v > 0]
                        runs = "".join("1" if v > 0 else " " for v in z).split()
                        want = [len(on) / len(z), max(map(len, runs), default=0), sum(z[t] for t in on) / max(len(on), 1), sum(on) / len(on) if on else -1]
                        assert got[r, at : at + 4] == pytest.approx(want), (d, i, k, r)
                    at += 4
    assert at == got.shape[1]


def test_shapelets_are_rated_by_all_curves(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 24)) * 0.3
    x[::2, 5:13] += np.sin(np.linspace(0, 6, 8)) * 3
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "idx long, label int, y array<double>")
    features, summary = tsc.shapelet_transform(df.repartition(4), "label", 40, 5)
    best = summary.orderBy("shapelet").collect()
    shape = x[int(best[0]["source"])][best[0]["start"] : best[0]["start"] + best[0]["length"]]
    exact = np.array([tsc.shapelet_distance(v, shape) for v in x])

    def gain(d):
        order = np.argsort(d, kind="stable")
        return tsc.information_gain(np.eye(2)[np.arange(60)[order] % 2])

    assert best[0]["quality"] == pytest.approx(gain(exact), abs=0.05) and best[0]["quality"] > 0.9
    got = {r["idx"]: r["features"] for r in features.collect()}
    assert [got[i][0] for i in range(60)] == pytest.approx(exact.tolist())
    assert best[0]["quality"] >= best[-1]["quality"]
