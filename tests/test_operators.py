"""Analytic expectations of the operators, and numpy mirrors on seeded input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import geometry as G
from tideline.functions.numeric import nan_min, nan_percentile, safe_div
from tideline.operators import align, fields, ordered, segments, spectral, summary, times

BY, ORDER = ["k"], ["t", "i"]


def seq(spark, t, **columns):
    names = ["i", "t", *columns]
    rows = [(i, float(t[i]), *[float(c[i]) for c in columns.values()]) for i in range(len(t))]
    return spark.createDataFrame(rows, ", ".join(["i long", *[f"{n} double" for n in names[1:]]])).withColumn("k", F.lit("a"))


def values(df, c, order="i"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def pose(x, y, yaw):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(yaw)).alias("yaw"))


def test_safe_div_follows_ieee(spark):
    assert one(spark, safe_div(F.lit(1.0), F.lit(0.0))) == math.inf
    assert one(spark, safe_div(F.lit(-1.0), F.lit(0.0))) == -math.inf
    assert math.isnan(one(spark, safe_div(F.lit(0.0), F.lit(0.0))))
    assert one(spark, safe_div(F.lit(None).cast("double"), F.lit(0.0))) is None


def test_nan_spreads_in_min_and_percentile(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    r = df.agg(nan_min(F.col("x")).alias("a"), nan_percentile(F.col("x"), 0.5).alias("b")).first()
    assert math.isnan(r["a"]) and math.isnan(r["b"])


@pytest.mark.parametrize("rpy", [(0.1, 0.05, 0.5), (-0.2, 0.1, -1.0), (0.3, -0.15, 2.0)])
def test_rpy_round_trip(spark, rpy):
    r = one(spark, G.quat_to_rpy(G.rpy_to_quat(*map(F.lit, rpy))))
    assert np.allclose([r["roll"], r["pitch"], r["yaw"]], rpy, atol=1e-10)


def test_pitch_is_clamped_at_the_pole(spark):
    r = one(spark, G.quat_to_rpy(G.quaternion(F.lit(0.0), F.lit(0.8), F.lit(0.0), F.lit(0.8))))
    assert r["pitch"] == pytest.approx(math.pi / 2)


def test_angles_wrap_into_half_open_range(spark):
    for a, want in ((2 * math.pi, 0), (3 * math.pi, -math.pi), (-2 * math.pi, 0), (-3 * math.pi, -math.pi), (math.pi, -math.pi)):
        assert one(spark, G.normalize_angle(F.lit(a))) == pytest.approx(want, abs=1e-9)
    assert one(spark, G.angle_diff(F.lit(math.pi - 0.1), F.lit(-math.pi + 0.1))) == pytest.approx(-0.2)


def test_distances_and_speeds(spark):
    o, p, q = (G.point(*map(F.lit, v)) for v in ((0.0, 0.0, 0.0), (3.0, 4.0, 9.0), (1.0, 2.0, 2.0)))
    assert one(spark, G.distance_2d(o, p)) == 5 and one(spark, G.distance_3d(o, q)) == 3
    assert one(spark, G.twist_to_speed(q)) == 3 and one(spark, G.twist_to_speed_2d(p)) == 5


def test_pose_errors(spark):
    df = spark.range(1)
    e = lambda a, r, f: ordered.with_pose_error(df, a, r, f).first()["pose_error"]
    r = e(pose(3, 5, 0.1), pose(1, 2, 0), "xy")
    assert (r["along"], r["cross"]) == (2, 3) and r["yaw"] == pytest.approx(0.1)
    r = e(pose(1, 1, math.pi / 2), pose(0, 0, math.pi / 2), "ref_heading")
    assert (r["along"], r["cross"]) == (pytest.approx(1), pytest.approx(-1))
    with pytest.raises(ValueError, match="Unknown frame"):
        e(pose(0, 0, 0), pose(0, 0, 0), "nope")


def test_pose_error_on_a_path(spark):
    df = seq(spark, [0, 1, 2], x=[0, 1, 2])
    a = F.struct("x", F.lit(0.5).alias("y"), F.lit(0.0).alias("yaw"))
    r = F.struct("x", F.lit(0.0).alias("y"), F.lit(0.0).alias("yaw"))
    got = ordered.with_pose_error(df.withColumns({"a": a, "r": r}), "a", "r", "ref_path", BY, ORDER).select("pose_error.*").collect()
    assert all(abs(x["along"]) < 1e-12 and x["cross"] == pytest.approx(0.5) for x in got)


def test_calculus(spark):
    t = np.linspace(0, 5, 101)
    d = values(ordered.with_diff(seq(spark, t, x=2 * t + 3), "x", "t", BY, ORDER), "diff")
    assert d[0] is None and np.allclose(d[1:], 2, atol=1e-9)
    c = values(ordered.with_integral(seq(spark, t, x=np.full(101, 3.0)), "x", "t", BY, ORDER), "integral")
    assert c[0] == 0 and np.allclose(c, 3 * t)
    assert values(ordered.with_diff(seq(spark, [0, 0], x=[1, 2]), "x", "t", BY, ORDER), "diff")[1] == math.inf


@pytest.mark.parametrize("w", [1, 4, 5, 11])
def test_moving_average_needs_whole_windows(spark, w):
    x = np.random.default_rng(1).normal(size=50)
    got = values(ordered.with_moving_average(seq(spark, np.arange(50), x=x), "x", w, BY, ORDER), "moving_average")
    want = np.convolve(x, np.ones(w) / w, mode="valid")
    assert got[: w // 2] == [None] * (w // 2) and np.allclose(got[w // 2 : w // 2 + len(want)], want)
    assert all(v is None for v in got[w // 2 + len(want) :])


def test_unwrap_equals_numpy(spark):
    a = np.random.default_rng(2).uniform(-10, 10, 300)
    got = values(ordered.with_unwrapped(seq(spark, np.arange(300), a=a), "a", BY, ORDER), "unwrapped")
    assert np.allclose(got, np.unwrap(a), atol=1e-9)


def test_paths(spark):
    df = seq(spark, range(4), x=range(4)).withColumns({"p": G.point("x", F.lit(0.0)), "q": G.yaw_to_quat(F.col("x") * 0.1)})
    assert values(ordered.with_cumulative_distance(df, "p", BY, ORDER), "distance") == [0, 1, 2, 3]
    assert values(ordered.with_velocity(df, "p", "t", BY, ORDER), "velocity") == [None, 1, 1, 1]
    assert np.allclose(values(ordered.with_yaw_rate(df, "q", "t", BY, ORDER), "yaw_rate")[1:], 0.1)


def test_describe_and_rms(spark):
    r = summary.describe(seq(spark, range(5), x=range(1, 6)), "x", BY).first()
    assert (r["mean"], r["median"], r["min"], r["max"]) == (3, 3, 1, 5)
    assert r["std"] == pytest.approx(math.sqrt(2)) and (r["p5"], r["p95"]) == (pytest.approx(1.2), pytest.approx(4.8))
    assert r["rms"] == pytest.approx(math.sqrt(11))


def step_row(spark, t, y, goal):
    return summary.stepinfo(seq(spark, t, y=y, g=np.broadcast_to(goal, np.shape(t))), "y", "g", "t", BY, ORDER).first()


def test_stepinfo_first_and_second_order(spark):
    t = np.arange(0, 10, 0.005)
    r = step_row(spark, t, 1 - np.exp(-t), 1.0)
    assert r["overshoot"] == 0 and r["settling_time"] == pytest.approx(-math.log(0.02), rel=0.05)
    assert r["rise_time"] == pytest.approx(math.log(9), rel=0.02)
    z, wn = 0.3, 10.0
    wd = wn * math.sqrt(1 - z * z)
    y = 1 - np.exp(-z * wn * t) * (np.cos(wd * t) + z / math.sqrt(1 - z * z) * np.sin(wd * t))
    assert step_row(spark, t, y, 1.0)["overshoot"] == pytest.approx(math.exp(-math.pi * z / math.sqrt(1 - z * z)) * 100, rel=0.05)


def test_stepinfo_ramp_and_no_step(spark):
    t = np.arange(0, 2, 0.01)
    assert step_row(spark, t, np.clip(t, 0, 1), 1.0)["rise_time"] == pytest.approx(0.8, abs=0.011)
    r = step_row(spark, t, np.ones(200), 1.0)
    assert math.isnan(r["rise_time"]) and math.isnan(r["settling_time"]) and r["overshoot"] == 0
    assert math.isnan(step_row(spark, t, np.linspace(0, 0.5, 200), 1.0)["settling_time"])


def test_tracking_error(spark):
    r = summary.tracking_error(seq(spark, range(3), a=[1, 2, 3], b=[2, 2, 5]), "a", "b", BY).first()
    assert (r["mean"], r["max"]) == (pytest.approx(-1), 2) and r["rms"] == pytest.approx(math.sqrt(5 / 3))


def test_rates(spark):
    r = summary.topic_rate(seq(spark, np.arange(1001) / 100), "t", BY, ORDER).first()
    assert r["count"] == 1001 and r["mean_hz"] == pytest.approx(100) and r["std_hz"] == pytest.approx(0, abs=1e-6) and r["duration"] == pytest.approx(10)
    r = summary.topic_rate(seq(spark, [1.0]), "t", BY, ORDER).first()
    assert r["count"] == 1 and r["mean_hz"] == r["std_hz"] == r["min_dt"] == r["max_dt"] == r["duration"] == 0
    both = seq(spark, np.arange(51) / 50).withColumn("k", F.lit("b")).unionByName(seq(spark, np.arange(101) / 100))
    got = summary.latency_chain(both, "t", BY, ORDER).collect()
    assert [x["k"] for x in got] == ["a", "b"] and [round(x["mean_hz"]) for x in got] == [100, 50]


def test_gaps(spark):
    t = np.concatenate([np.arange(100) / 100, 1.5 + np.arange(100) / 100])
    g = summary.message_gaps(seq(spark, t), 100, "t", BY, ORDER).collect()
    assert len(g) == 1 and g[0]["duration"] == pytest.approx(0.51) and g[0]["expected_count"] == 51
    assert summary.message_gaps(seq(spark, [1.0]), 100, "t", BY, ORDER).count() == 0
    # half to even, and the limit itself is no gap
    assert summary.message_gaps(seq(spark, [0, 2.5]), 1, "t", BY, ORDER).first()["expected_count"] == 2
    assert summary.message_gaps(seq(spark, [0, 1.5]), 1, "t", BY, ORDER).count() == 0


def test_delay(spark):
    r = summary.topic_delay(seq(spark, range(4), p=[0, 1, 2, 3], r=[0.1, 1.2, 2.1, 3.3]), "p", "r", BY).first()
    assert (r["mean"], r["max"], r["median"]) == (pytest.approx(0.175), pytest.approx(0.3), pytest.approx(0.15))


def ten_hz(spark, n=100):
    start = 1_704_067_200_000_000_000
    return spark.range(n).select((F.lit(start) + F.col("id") * 100_000_000).alias("recv_time_ns"), F.col("id").cast("double").alias("data"))


def test_time_slice_and_find_time(spark):
    df = ten_hz(spark)
    assert [times.time_slice(df, *s).count() for s in ((1, 2), (0.5, 1.5), (100, 200))] == [11, 11, 0]
    assert times.find_time_or_raise(df, "data", lambda x: x >= 50) == pytest.approx(5.0)
    with pytest.raises(ValueError):
        times.find_time_or_raise(df, "data", lambda x: x > 1e9)


def test_stamps_keep_nanoseconds(spark):
    stamp = F.struct(F.lit(1773585473).alias("sec"), F.lit(896158980).cast("long").alias("nanosec"))
    df = spark.range(1).select(F.struct(stamp.alias("stamp")).alias("header"))
    assert times.reindex_by_stamp(df).first()["time_ns"] == 1773585473896158980
    assert df.select(times.stamp_to_sec().alias("s")).first()["s"] == pytest.approx(1773585473.8961592)


def test_align_origin(spark):
    df = seq(spark, [5.0, 6.0, 7.5, 8.0], g=[0, 0, 1, 1])
    assert values(times.align_origin(df, "t", ["g"], ["i"]), "aligned") == [0, 1, 2.5, 3]
    with pytest.raises(ValueError):
        times.align_origin(df, "t", [], ["i"])


def match(spark, q, s):
    a, b = seq(spark, q).drop("k"), seq(spark, s).drop("k")
    return values(align.match_by_time(a, b, "t", "t", source_order=["i"]), "matched_index")


def test_nearest_match(spark):
    assert match(spark, [0.4, 1.6, 2.9], [0, 1, 2, 3]) == [0, 2, 3]
    assert match(spark, [1, -5, 100], [0, 2]) == [0, 0, 1]
    assert match(spark, [7.0], [1.0]) == [0]
    assert match(spark, [1.0, 0.9], [0, 1, 1, 2]) == [2, 1]
    rng = np.random.default_rng(3)
    q, s = rng.uniform(0, 10, 200), np.sort(rng.uniform(0, 10, 80))
    assert match(spark, q, s) == [int(np.abs(s - x).argmin()) for x in q]


def test_align_time(spark):
    a, b = seq(spark, [0, 1], v=[0, 10]).select("t", "v"), seq(spark, [0, 0.5], v=[0, 100]).withColumn("s", F.lit("x")).select("t", "v", "s")
    got = align.align_time(a, b, "t").orderBy("t").collect()
    assert [(r["t"], r["v_a"], r["v_b"], r["s_b"]) for r in got] == [(0, 0, 0, "x"), (0.5, 5, 100, "x")]


def test_align_time_refuses_repeated_times(spark):
    a = seq(spark, [0, 1, 1], v=[0, 1, 2]).select("t", "v")
    with pytest.raises(ValueError, match="repeats a time"):
        align.align_time(a, a, "t")
    assert align.align_time(a, a, "t", strict=False).count() == 2


def test_align_time_takes_rows_of_one_time_in_order(spark):
    rows = lambda r: spark.createDataFrame([(float(t), float(v), i) for t, v, i in r], "t double, v double, i long")
    a, b = rows([(0, 0, 0), (2, 30, 3), (2, 10, 1), (2, 20, 2), (4, 50, 0)]), rows([(0, 1, 0), (1, 2, 0), (2, 4, 1), (2, 3, 0), (3, 6, 0), (4, 7, 1), (4, 8, 0)])
    got = align.align_time(a, b, "t", strict=False, order=["i"]).orderBy("t").collect()
    assert [(r["t"], r["v_a"], r["v_b"]) for r in got] == [(0, 0, 1), (1, 5, 2), (2, 30, 4), (3, 40, 6), (4, 50, 7)]


def test_resample(spark):
    df = seq(spark, [0, 1, 2], v=[0, 10, 20]).select("k", "t", "v")
    got = align.resample(df, 0.5, "t", BY).orderBy("t").collect()
    assert [(r["t"], r["v"]) for r in got] == [(0, 0), (0.5, 5), (1, 10), (1.5, 15)]
    with pytest.raises(ValueError):
        align.resample(df, 0, "t", BY)


def test_interp_pose(spark):
    df = seq(spark, [0, 1], x=[0, 2], a=[0, math.pi / 2]).select("t", G.point("x", F.lit(1.0)).alias("position"), G.yaw_to_quat("a").alias("orientation"))
    got = align.interp_pose(df, seq(spark, [0.5, -1, 3]).select("i", "t"), "t").orderBy("i").select("position.*", G.quat_to_yaw("orientation").alias("yaw")).collect()
    assert [(r["x"], r["y"]) for r in got] == [(1, 1), (0, 1), (2, 1)]
    assert np.allclose([r["yaw"] for r in got], [math.pi / 4, 0, math.pi / 2], atol=1e-6)


def test_slerp_takes_the_shorter_arc(spark):
    q = lambda a, s: G.quaternion(F.lit(0.0), F.lit(0.0), F.lit(s * math.sin(a / 2)), F.lit(s * math.cos(a / 2)))
    r = one(spark, G.slerp(q(0.2, 1), q(1.0, -1), F.lit(0.25)))
    assert abs(2 * math.atan2(r["z"], r["w"])) == pytest.approx(0.4)


def test_lowpass_recovers_a_sine(spark):
    t = np.arange(1000) / 500
    clean = np.sin(2 * np.pi * 5 * t)
    df = seq(spark, t, x=clean + 0.5 * np.sin(2 * np.pi * 50 * t))
    got = np.array(values(spectral.lowpass(df, "x", 10, 500, BY, ORDER), "lowpass"))
    assert np.abs(got - clean)[100:-100].max() < 0.05


def plain_filter(b, a, x):
    """One section, sample by sample."""
    s1, s2, out = (1 - b[0]) * x[0], (b[2] - a[2]) * x[0], []
    for v in x:
        y = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * y + s2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_blocks_equal_samples(n):
    x = np.random.default_rng(n).normal(size=n)
    for degree in (1, 4, 5):
        for b, a in spectral.butterworth(degree, 3, 200):
            assert np.allclose(spectral._Section(b, a).run(x), plain_filter(b, a, x), atol=1e-10)


@pytest.mark.parametrize("n", [120, 400, 1000, 1203])
def test_lowpass_in_chunks(spark, n):
    t = np.arange(n) / 100
    df = seq(spark, t, x=np.cumsum(np.random.default_rng(6).normal(size=n)))
    whole = values(spectral.lowpass(df, "x", 20, 100, BY, ORDER), "lowpass")
    assert spectral.settling(20, 100) < 100
    got = values(spectral.lowpass(df, "x", 20, 100, BY, ORDER, bounds=segments.span(df.select("t")), chunk=200), "lowpass")
    assert len(got) == n and np.allclose(got, whole, atol=1e-9)


def ragged(spark):
    """Sequences with hot, tiny and null keys, equal times, nulls, NaN and infinite times."""
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 3 else None, i, float(np.round(rng.normal(0, 5), 1)), None if i % 7 == 0 else float(rng.normal())) for i in range(400)]
    rows += [("one", 1000, 1.0, 2.0), ("none", 1001, 0.0, None), ("hot", 1002, float("nan"), 1.0), ("hot", 1003, float("inf"), 2.0), ("hot", 1004, float("-inf"), 3.0), ("hot", 1005, None, 4.0)]
    return spark.createDataFrame(rows, "k string, i long, t double, x double")


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("strict", [False, True])
def test_neighbours_and_sums_in_segments_equal_whole_windows(spark, by, strict):
    from pyspark.sql import Window

    df, order = ragged(spark), ["t", "i"]
    bounds = segments.span(df.select("t"))
    assert all(map(math.isfinite, bounds)) and segments.span(df.where("false").select("t")) == (0.0, 0.0)
    w = Window.partitionBy(*by)
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    after = w.orderBy(*order).rowsBetween(1 if strict else 0, Window.unboundedFollowing)
    want = df.withColumns({"v_before": F.last("x", True).over(before), "v_after": F.first("x", True).over(after)})
    got = segments.around(df, {"v": F.col("x")}, by, order, bounds, strict)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    sums = {r["i"]: r["s"] for r in df.withColumn("s", F.sum("x").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).collect()}
    mine = {r["i"]: r["s"] for r in segments.running_sums(df, {"s": F.col("x")}, by, order, bounds).collect()}
    assert mine.keys() == sums.keys() and all((a is None) == (mine[i] is None) and (a is None or abs(a - mine[i]) < 1e-9) for i, a in sums.items())


def test_running_operators_in_segments(spark):
    df = ragged(spark).where("t is not null and abs(t) < 100").withColumns({"p": G.point("x", F.col("x") * 2), "a": F.col("x") * 4, "y": F.coalesce("x", F.lit(0.0))})
    bounds, order = segments.span(df.select("t")), ["t", "i"]
    for run, out in (
        (lambda **k: ordered.with_integral(df, "y", "t", BY, order, **k), "integral"),
        (lambda **k: ordered.with_unwrapped(df.where("x is not null"), "a", BY, order, **k), "unwrapped"),
        (lambda **k: ordered.with_cumulative_distance(df, "p", BY, order, **k), "distance"),
        (lambda **k: ordered.with_diff(df, "x", "t", BY, order, **k), "diff"),
        (lambda **k: ordered.with_velocity(df, "p", "t", BY, order, **k), "velocity"),
        (lambda **k: ordered.with_yaw_rate(df.withColumn("q", G.yaw_to_quat("y")), "q", "t", BY, order, **k), "yaw_rate"),
        (lambda **k: ordered.with_moving_average(df, "y", 4, BY, order, **k), "moving_average"),
        (lambda **k: ordered.with_moving_average(df, "y", 7, BY, order, **k | ({"chunk": 10} if k else {})), "moving_average"),
        (lambda **k: ordered.with_pose_error(df, F.struct("x", "y", "a", F.col("a").alias("yaw")), F.struct("t", F.col("t").alias("x"), "y", F.col("a").alias("yaw")), "ref_path", BY, order, **k).select("i", "pose_error.*"), "along"),
    ):
        assert np.allclose(np.array(values(run(), out), float), np.array(values(run(bounds=bounds), out), float), atol=1e-9, equal_nan=True), out
    for run in (lambda **k: summary.topic_rate(df, "t", BY, order, **k), lambda **k: summary.latency_chain(df, "t", BY, order, **k), lambda **k: summary.message_gaps(df, 2.0, "t", BY, order, **k)):
        a, b = (sorted(run(**k).collect(), key=str) for k in ({}, {"bounds": bounds}))
        assert len(a) == len(b) and all(x == pytest.approx(y) if isinstance(x, float) else x == y for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("by", [["k"], []])
def test_percentiles_equal_numpy(spark, by):
    df = ragged(spark)
    got = {r["_k0"] if by else None: r for r in segments.percentiles(df, F.col("x"), [0.0, 0.05, 0.5, 0.95, 1.0], [F.col(b) for b in by]).collect()}
    rows = df.where("x is not null").toPandas()
    for key, r in got.items():
        x = rows[rows["k"].isna() if key is None else rows["k"] == key]["x"] if by else rows["x"]
        assert r["_n"] == len(x) and np.allclose([r[f"_p{i}"] for i in range(5)], np.percentile(x, [0, 5, 50, 95, 100]))
    assert len(got) == (3 if by else 1)
    d = summary.describe(df, "x").first()
    assert d["median"] == pytest.approx(np.median(rows["x"])) and summary.describe(df.where("false"), "x").first()["median"] is None


def test_pose_forms(spark):
    df = spark.range(1).select(F.struct(G.point(F.lit(3.0), F.lit(5.0), F.lit(0.0)).alias("position"), G.yaw_to_quat(F.lit(0.1)).alias("orientation")).alias("pose"), pose(1, 2, 0).alias("ref"))
    for actual in ("pose", F.col("pose"), fields.msg(df).pose, {"x": 3, "y": 5, "yaw": 0.1}):
        for reference in ("ref", {"x": 1, "y": 2, "yaw": 0}):
            r = ordered.with_pose_error(df, actual, reference, "xy").first()["pose_error"]
            assert (r["along"], r["cross"], r["yaw"]) == (2, 3, pytest.approx(0.1))
    for bad in ("pose.position", {"x": 1}, 3):
        with pytest.raises(TypeError):
            ordered.with_pose_error(df, bad, "ref", "xy")


def test_fields_are_columns(spark):
    df = nested(spark)
    assert df.select(G.distance_2d(fields.msg(df).twist.linear, fields.msg(df)["twist"]["linear"]).alias("d")).first()["d"] == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 6])
def test_butterworth_gains(order):
    z = np.exp(1j * 2 * np.pi * 20 / 200)
    gain = lambda z: np.prod([np.polyval(b[::-1], 1 / z) / np.polyval(a[::-1], 1 / z) for b, a in spectral.butterworth(order, 20, 200)])
    assert abs(gain(1)) == pytest.approx(1) and abs(gain(z)) == pytest.approx(math.sqrt(0.5))
    assert np.allclose(spectral.zero_phase(np.full(100, 3.0), 20, 200, order), 3.0)
    with pytest.raises(ValueError):
        spectral.zero_phase(np.ones(5), 20, 200, order)


@pytest.mark.parametrize("n", [63, 64])
def test_fft_and_its_relational_form(spark, n):
    x = np.random.default_rng(4).normal(size=n)
    df = seq(spark, np.arange(n) / 200, x=x)
    want = np.abs(np.fft.rfft(x)) * 2 / n
    want[0] /= 2
    for f in (spectral.fft, spectral.dft):
        got = f(df, "x", 200.0, BY, ORDER).orderBy("frequency").collect()
        assert np.allclose([r["amplitude"] for r in got], want, atol=1e-9)
        assert np.allclose([r["frequency"] for r in got], np.arange(n // 2 + 1) * 200 / n)


def test_delay_estimate(spark):
    t = np.arange(0, 2, 0.001)
    c = np.where(t < 1, np.sin(2 * np.pi * 5 * t), 0)
    r = np.interp(t - 0.05, t, c, left=0)
    got = spectral.delay_estimate(seq(spark, t, c=c, r=r), "c", "r", "t", BY, ORDER).first()["delay"]
    assert got == pytest.approx(0.05, abs=0.002)


def nested(spark):
    return spark.sql("SELECT named_struct('linear', named_struct('x', 1D, 'y', 2D), 'n', 3) AS twist, array(1D, 2D) AS a, array(named_struct('p', named_struct('x', 5D))) AS poses")


def test_fields(spark):
    df = nested(spark)
    m = fields.msg(df)
    assert df.select(m.twist.linear.x.col).first()[0] == 1
    assert m["twist"]["linear"].df.columns == ["x", "y"] and m.twist.n.df.columns == ["n"]
    for bad in (lambda: m.nope, lambda: m.twist.nope):
        with pytest.raises(AttributeError, match="No fields matching"):
            bad()
    assert fields.leaves(df.schema) == ["twist.linear.x", "twist.linear.y", "twist.n", "a", "poses"]
    assert fields.flatten_fields(df, "_").columns[0] == "twist_linear_x"
    assert df.select(fields.element_fields("poses", "p.x").alias("v")).first()["v"] == [5.0]


def test_explode_array(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "i long, a array<double>")
    got = fields.explode_array(df, "a", keep=["i"]).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 2.0), (2, 3.0, None)]
    assert fields.explode_array(df, "a", ["p", "q"]).columns == ["p", "q"]
    with pytest.raises(ValueError, match="names has"):
        fields.explode_array(df, "a", ["p"])
    with pytest.raises(Exception, match="names has"):
        fields.explode_array(df, "a", ["p"], check=False).collect()
    assert fields.explode_array(df, "a", ["p", "q", "r"], check=False).where("q is null").count() == 1


def test_plot_frames(spark):
    df = seq(spark, range(100), x=np.sin(np.arange(100)), y=range(100))
    assert fields.plot_timeseries(df, "t", {"x": "x", "y": "y"}, BY).count() == 200
    few = fields.plot_timeseries(df, "t", {"x": "x"}, BY, points=10)
    assert few.count() <= 20 and few.agg(F.max("value")).first()[0] == pytest.approx(max(np.sin(np.arange(100))))
    path = fields.plot_xy_trajectory(df, "x", "y", BY, ORDER, ("y", "x"))
    assert path.count() == 200 and path.where("is_start").count() == 2 and path.where("is_end").count() == 2
    band = fields.plot_step_response(df.withColumn("g", F.lit(-10.0)), "t", "x", "g", BY).first()
    assert (band["band_lo"], band["band_hi"]) == (pytest.approx(-10.2), pytest.approx(-9.8))
    e = fields.plot_error_band(df, "t", "y", BY).first()
    assert e["upper"] == pytest.approx(np.std(np.arange(100))) == -e["lower"]


def test_zip_by_position(spark):
    a, b = seq(spark, [3, 1, 2]).select("t", "i"), seq(spark, [9, 8, 7]).select(F.col("t").alias("u"), "i")
    got = fields.zip_by_position(a.drop("i"), b.drop("i"), ["t"], ["u"]).orderBy("t").collect()
    assert [(r["t"], r["u"]) for r in got] == [(1, 7), (2, 8), (3, 9)]


def test_to_numpy(spark):
    df = seq(spark, range(3), x=range(3)).select(G.point("x", "x", "x").alias("p"))
    m = np.array([r["m"] for r in df.select(G.to_numpy_3d("p").alias("m")).collect()])
    assert m.shape == (3, 3) and df.select(*G.to_xy("p")).columns == ["x", "y"] and df.select(*G.to_xyz("p")).columns == ["x", "y", "z"]
