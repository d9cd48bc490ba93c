"""Hand-computed cases of the imaging operators, the readers and writers, and whole workflows."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.layout import to_frames, to_pixels
from framelake.operators import channels as ch
from framelake.operators import checks, regions, registration, regression, stencils
from framelake.operators import frames as fr
from framelake.plans.preprocess import preprocess
from framelake.plans.report import report
from framelake.sources import readers, writers
from framelake.streaming import live

FRAME = "session_id string, frame_idx bigint, height int, width int, pixels array<double>"


def frames(spark, arrays, session="s"):
    return spark.createDataFrame([(session, i, a.shape[0], a.shape[1], [float(v) for v in a.reshape(-1)]) for i, a in enumerate(arrays)], FRAME)


def stack(df):
    return np.array([np.reshape(r["pixels"], (r["height"], r["width"])) for r in df.orderBy("frame_idx").collect()])


def plain_baseline(a, w, integers=True):
    w += w % 2
    s = np.cumsum(np.trunc(a) if integers else a)
    m = (s[w:] - s[:-w]) / w
    return np.concatenate([np.full(w // 2, m[: w // 2].mean()), m, np.full(w // 2, m[max(0, len(m) - w // 2) :].mean())])


@pytest.mark.parametrize("n,w", [(20, 4), (20, 5), (9, 6), (40, 20)])
def test_baseline(spark, n, w):
    a = np.random.default_rng(n).uniform(3, 90, n)
    traces = spark.createDataFrame([("s", "gcamp", 0, 0, k, float(v)) for k, v in enumerate(a)], "session_id string, channel string, y int, x int, k int, value double")
    got = [r["f0"] for r in ch.rolling_baseline(traces, w).orderBy("k").collect()]
    assert np.allclose(got, plain_baseline(a, w))
    with pytest.raises(Exception, match="window"):
        ch.rolling_baseline(traces, n + 2).collect()


def test_separation_leaves_ties_out(spark):
    stats = spark.createDataFrame([("s", i, 0.0, float(v)) for i, v in enumerate([1, 2, 3])], "session_id string, frame_idx bigint, mean double, std double")
    assert {(r["frame_idx"], r["channel"]) for r in ch.separate(stats).collect()} == {(0, "isosb"), (2, "gcamp")}
    assert {(r["frame_idx"], r["channel"]) for r in ch.separate(stats, flip=True).collect()} == {(2, "isosb"), (0, "gcamp")}


@pytest.mark.parametrize("start,left", [(1, 0), (2, 2), (3, 2), (4, 4), (5, 4), (6, 6), (50, 50)])
def test_even_skips(start, left):
    assert fr.even_skips(start, 5) == (left, 6)


def test_skip_crop_bin(spark):
    a = np.arange(10 * 36, dtype=float).reshape(10, 6, 6)
    df = frames(spark, a)
    assert np.array_equal(stack(fr.skip(df, 3, 2)), a[2:8])
    assert np.array_equal(stack(fr.crop(df, 1)), a[:, 1:-1, 1:-1])
    assert np.array_equal(stack(fr.keep_corner(df, 4, 0)), a[:, :4])
    assert np.allclose(stack(fr.spatial_bin(df, 3)), a.reshape(10, 2, 3, 2, 3).mean(axis=(2, 4)))
    with pytest.raises(Exception, match="multiples"):
        fr.spatial_bin(df, 4).collect()
    assert np.array_equal(stack(to_frames(to_pixels(df))), a)
    s = fr.statistics(df).orderBy("frame_idx").collect()
    assert np.allclose([r["std"] for r in s], a.reshape(10, -1).std(axis=1))


def test_rescale_and_zscore(spark):
    got = stack(fr.to_bytes(frames(spark, np.array([[[-1.0, 0.0, 3.0]]]))))
    assert got.reshape(-1).tolist() == [0, 63, 255]
    z = fr.zscore(to_pixels(frames(spark, np.full((3, 1, 1), 4.0)))).collect()
    assert all(math.isnan(r["z"]) for r in z)


def test_checks(spark):
    times = spark.createDataFrame([("s", i, int(t * 1e6)) for i, t in enumerate([0, 0.02, 0.04, 1.06])], "session_id string, frame_idx bigint, micros bigint")
    assert [r["ms"] for r in checks.intervals(times).orderBy("frame_idx").collect()] == [20, 20, 1020]
    assert [r["ms"] for r in checks.intervals(times, seconds_as_ms=True).orderBy("frame_idx").collect()] == [0, 0, 1]
    even = spark.createDataFrame([("s", i, 20_000 * i) for i in range(5)], "session_id string, frame_idx bigint, micros bigint")
    assert not checks.timestamp_jumps(checks.intervals(even)).first()["passed"]
    rng = np.random.default_rng(0)
    assert checks.dip_p(rng.random(150), 60) > 0.05
    two = np.concatenate([rng.normal(0, 1, 80), rng.normal(12, 1, 80)])
    assert checks.dip_p(two, 60) < 0.05
    assert checks.dip(np.ones(5)) == 0.1


def chain(x, y, upper):
    """The hull point by point, without thinning out."""
    kept, sign = [], -1.0 if upper else 1.0
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if sign * ((y[b] - y[a]) * (x[i] - x[a]) - (y[i] - y[a]) * (x[b] - x[a])) < 0:
                break
            kept.pop()
        kept.append(i)
    return kept


def test_hulls_are_whole_and_quick():
    rng, n = np.random.default_rng(4), 6000
    shapes = [rng.random(n), rng.normal(size=n), np.round(rng.normal(size=n), 2), rng.pareto(0.3, n), np.repeat(rng.random(n // 6), 6), np.sqrt(np.arange(n)), np.arange(n) ** 2.0, np.arange(n) * 1.0]
    shapes += [np.append(rng.normal(0, 1, n), rng.normal(5, 1, n)), np.append(np.zeros(n), np.ones(n)), *(rng.integers(0, 6, k) * 1.0 for k in range(1, 30))]
    for x in map(np.sort, shapes):
        y = np.arange(len(x), dtype=float)
        for upper in (False, True):
            assert checks._hull(x, y, upper) == chain(x, y, upper)
    x, y = np.sort(rng.random(100_000)), np.arange(100_000, dtype=float)
    began = time.process_time()
    chain(x, y, False)
    plain, began = time.process_time() - began, time.process_time()
    checks.dip(x)
    assert time.process_time() - began < plain


def test_histogram_separation_deals_its_samples_out(spark):
    rng = np.random.default_rng(5)
    series = {"one": rng.normal(0, 1, 160), "two": np.append(rng.normal(0, 1, 80), rng.normal(12, 1, 80)), "odd": rng.random(75), "short": np.array([1.0, 2.0, 9.0])}
    rows = [(k, float(v)) for k, x in series.items() for v in x] + [("two", None), ("two", float("nan")), ("none", None)]
    context = spark.sparkContext
    context.setJobGroup("dip", "dip")
    got = {r["session_id"]: r for r in checks.histogram_separation(spark.createDataFrame(rows, "session_id string, std double")).collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == {*series, "none"}
    for k, x in series.items():
        assert got[k]["dip"] == checks.dip(x)
        assert got[k]["p"] == (checks.dip_p(x) if len(x) > 3 else 1.0)
    assert (got["none"]["dip"], got["none"]["p"]) == (0.0, 1.0)
    assert [k for k in got if got[k]["passed"]] == ["two"]
    rng, again = np.random.default_rng(7), checks.dip(series["odd"])
    assert got["odd"]["p"] == np.mean([checks.dip(rng.random(75)) >= again for _ in range(200)])
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("dip") for s in tracker.getJobInfo(j).stageIds}
    assert max(info.numTasks for s in stages if (info := tracker.getStageInfo(s))) >= 50


def test_stencils(spark):
    flat = stack(stencils.gaussian_laplace(frames(spark, np.full((1, 12, 12), 5.0))))
    assert np.allclose(flat, 5.0, atol=0.01) and np.ptp(flat) < 1e-9
    a = np.random.default_rng(3).uniform(0, 9, (2, 7, 9))
    assert np.allclose(stack(stencils.warp(frames(spark, a), np.eye(3))), a)
    shift = stack(stencils.warp(frames(spark, a), [[1, 0, 2], [0, 1, 1], [0, 0, 1]]))
    assert np.allclose(shift[:, :-1, :-2], a[:, 1:, 2:]) and not shift[:, -1].any()
    ramp = np.tile(np.arange(9.0), (7, 1))[None]
    assert np.allclose(stack(stencils.warp(frames(spark, ramp), [[1, 0, 0.3], [0, 1, 0], [0, 0, 1]]))[0, :, 1:6], ramp[0, :, 1:6] + 0.3)


def test_affine():
    m = np.array([[1.1, 0.2, 3], [-0.1, 0.9, -2], [0, 0, 1]])
    points = {k: (x, y) for k, x, y in readers.TEMPLATE_LANDMARKS}
    moved = {k: tuple(m[:2, :2] @ p + m[:2, 2]) for k, p in points.items()}
    assert np.allclose(registration.estimate_affine(*registration.paired(points, dict(reversed(moved.items())))), m)
    with pytest.raises(ValueError):
        registration.estimate_affine([(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 0), (0, 1)])
    with pytest.raises(ValueError):
        registration.paired(points, {"a": (0, 0)})


def test_regions(spark):
    raster = spark.createDataFrame([(y, x, y // 2 + 1 if x < 3 else 0) for y in range(6) for x in range(6)], "y int, x int, region_id int")
    atlas = regions.both_hemispheres(raster, 6)
    names = spark.createDataFrame([(1, "REG1", ""), (2, "REG2", ""), (3, "FRP1", ""), (8, "NONE", "")], "id int, acronym string, name string")
    a = np.random.default_rng(1).uniform(0, 1, (4, 6, 6))
    got = {(r["region"], r["frame_idx"]): r["F"] for r in regions.all_regions(frames(spark, a), atlas, names).collect()}
    assert math.isclose(got["L_REG2", 1], a[1, 2:4, :3].mean()) and math.isclose(got["R_REG2", 1], a[1, 2:4, 3:].mean())
    assert math.isnan(got["L_NONE", 0]) and not any("FRP1" in k[0] for k in got)
    one = regions.region_activity(frames(spark, a), atlas, names, "REG1", "BOTH").orderBy("frame_idx").collect()
    assert np.allclose([r["F"] for r in one], a[:, :2].mean(axis=(1, 2)))
    with pytest.raises(ValueError):
        regions.region_activity(frames(spark, a), atlas, names, "none")


def test_ridge(spark):
    rng = np.random.default_rng(42)
    x, b = rng.normal(size=(200, 3)), rng.normal(size=(3, 4, 5))
    y = np.einsum("tr,rhw->thw", x, b)
    y[:, 0, 0] = 3.0
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_idx bigint, values array<double>")
    got = {(r["y"], r["x"]): r for r in regression.ridge(to_pixels(frames(spark, y)), table, 1.0).collect()}
    xc = x - x.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ y[:, 2, 3])
    assert np.allclose(got[2, 3]["coef"], want) and got[2, 3]["r2"] > 0.99
    assert got[0, 0]["mse"] < 1e-9


def test_ridge_of_two_recordings(spark):
    rng = np.random.default_rng(7)
    made, rows, want = [], [], {}
    for name, n in (("p", 40), ("q", 60)):
        x, y = rng.normal(size=(n, 2)), rng.normal(size=(n, 1, 2))
        made.append(frames(spark, y).withColumn("session_id", F.lit(name)))
        rows += [(name, i, [float(v) for v in r]) for i, r in enumerate(x)]
        xc = x - x.mean(axis=0)
        want[name] = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ y[:, 0, 1])
    both, table = made[0].unionByName(made[1]), spark.createDataFrame(rows, "session_id string, sample_idx bigint, values array<double>")
    got = {(r["session_id"], r["x"]): r["coef"] for r in regression.ridge(to_pixels(both), table).collect()}
    assert np.allclose(got["p", 1], want["p"]) and np.allclose(got["q", 1], want["q"])
    with pytest.raises(Exception, match="60 rows of regressors"):
        regression.ridge(to_pixels(made[0]), table.where("session_id = 'q'").drop("session_id")).collect()
    trials = spark.createDataFrame([("p", 0, 5), ("p", 1, 5), ("q", 0, 7)], "session_id string, sample_idx bigint, frame_idx bigint")
    assert {(r["session_id"], r["frame_idx"]) for r in regression.select_trials(both, trials).collect()} == {("p", 0), ("p", 1), ("q", 0)}


def test_window_of_each_recording(spark):
    rng = np.random.default_rng(8)
    make = lambda n: np.array([rng.normal(200, 40 if i % 2 else 5, (4, 4)) for i in range(n)])
    long, short = make(120), make(40)
    both = frames(spark, long).withColumn("session_id", F.lit("long")).unionByName(frames(spark, short).withColumn("session_id", F.lit("short")))
    together = preprocess(both, qa=False)["change"]
    for name, a in (("long", long), ("short", short)):
        alone = preprocess(frames(spark, a), qa=False)["change"]
        key = lambda df: [r["value"] for r in df.orderBy("k", "y", "x").collect()]
        assert np.allclose(key(together.where(F.col("session_id") == name)), key(alone))


def test_nan_pixels_and_the_order_of_the_dictionary(spark):
    raster = spark.createDataFrame([(y, x, y // 2 + 1 if x < 3 else 0) for y in range(6) for x in range(6)], "y int, x int, region_id int")
    atlas = regions.both_hemispheres(raster, 6)
    names = spark.createDataFrame([(0, 2, "REG"), (1, 1, "REG"), (2, 3, "OTHER")], "ord int, id int, acronym string")
    a = np.random.default_rng(1).uniform(0, 1, (2, 6, 6))
    a[1, 0, 5] = np.nan
    get = lambda **k: {(r["region"], r["frame_idx"]): r["F"] for r in regions.all_regions(frames(spark, a), atlas, names, **k).collect()}
    got = get()
    assert math.isclose(got["L_REG", 0], a[0, 2:4, :3].mean()) and all(math.isnan(v) for (_, i), v in got.items() if i == 1)
    assert not any(math.isnan(v) for v in get(spread_nan=False).values())
    one = regions.region_activity(frames(spark, a), atlas, names, "REG", "left").orderBy("frame_idx").first()
    assert math.isclose(one["F"], a[0, 2:4, :3].mean())


def test_readers_and_writers(spark, tmp_path):
    path = writers.landmarks_csv(str(tmp_path / "points"), readers.template_landmarks())
    assert readers.landmarks(spark, path) == readers.template_landmarks()
    xml = tmp_path / "a.points"
    xml.write_text('<namedpointset><pointworld set="1" name="one" x="1.5" y="2"/><pointworld set="0" name="none"/></namedpointset>')
    assert readers.landmarks(spark, str(xml)) == {"one": (1.5, 2.0)}
    with pytest.raises(ValueError):
        readers.landmarks(spark, "a.txt")
    (tmp_path / "m.json").write_text(json.dumps({"lab": "here"}))
    assert readers.metadata(spark, str(tmp_path / "m.json"), sex="F")["lab"] == "here"
    with pytest.raises(ValueError):
        readers.metadata(spark, None, colour="x")
    np.savez(tmp_path / "r.npz", regressors=np.ones((3, 2)), labels=np.array(["a", "b"]), trial_idx=np.array([2, 0, 2]))
    table, labels, trials = readers.regressors(spark, str(tmp_path / "r.npz"))
    assert labels == ["a", "b"] and table.count() == 3 and [r["frame_idx"] for r in trials.orderBy("sample_idx").collect()] == [2, 0, 2]
    (tmp_path / "t.csv").write_text("when;n\n2024-01-01T00:00:00.1;0\n2024-01-01T00:00:00.2;1\n")
    assert [r["ts_raw"] for r in readers.timestamps(spark, str(tmp_path / "t.csv"), 0, ";", True).orderBy("frame_idx").collect()] == ["2024-01-01T00:00:00.1", "2024-01-01T00:00:00.2"]


def test_workflow_and_report(spark, tmp_path):
    rng = np.random.default_rng(6)
    a = np.array([rng.normal(200, 40 if i % 2 else 5, (8, 8)) for i in range(120)])
    times = spark.createDataFrame([("s", i, f"2024-01-01T00:00:{i / 50:09.6f}", 20_000 * i + i % 3) for i in range(120)], "session_id string, frame_idx bigint, ts_raw string, micros bigint")
    out = preprocess(frames(spark, a), times, bins=2, window=10)
    assert {r["channel"]: r["n"] for r in ch.counts(out["channels"]).collect()} == {"gcamp": 60, "isosb": 60}
    binned = a.reshape(120, 4, 2, 4, 2).mean(axis=(2, 4))
    change = lambda t: (t - plain_baseline(t, 10)) / plain_baseline(t, 10)
    want = change(binned[1::2, 1, 2]) - change(binned[0::2, 1, 2])
    got = [r["value"] for r in out["change"].where("y = 1 and x = 2").orderBy("k").collect()]
    assert np.allclose(got, want)
    out.write(str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/change_times")).count() == 60
    page = report("a run", {k: spark.read.parquet(str(tmp_path / f"run/{k}")) for k in ("check_noise", "check_snr", "check_consistency")})
    assert "check_noise" in page and page.count("<table>") == 3


def test_live_statistics(spark, tmp_path):
    import datetime as dt

    rows = [("s", i, dt.datetime(2024, 1, 1, 0, 0, i), 1, 2, [float(i), i + 2.0]) for i in range(30)]
    spark.createDataFrame(rows, "session_id string, frame_idx bigint, ts timestamp, height int, width int, pixels array<double>").write.parquet(str(tmp_path / "in"))
    query = live.windowed(live.statistics(live.read_frames(spark, str(tmp_path / "in")))).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("live").collect()) == [10, 10, 10]
