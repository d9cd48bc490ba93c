"""The workflows from the command line, one after the other over one recording."""

import numpy as np
import pytest

from framelake import __main__ as cli
from framelake.sources import readers, writers


def test_all_commands(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("mouse", i, 12, 14, [float(v) for v in rng.normal(200, 40 if i % 2 else 5, 168)], f"2024-03-01T10:00:{i * 0.02:09.6f}") for i in range(80)]
    spark.createDataFrame(rows, "session_id string, frame_idx bigint, height int, width int, pixels array<double>, ts_raw string").write.parquet(f"{tmp_path}/mouse.parquet")
    go = lambda *words: cli.run(spark, cli.parser().parse_args([*words]))
    out = ("-o", str(tmp_path / "out"))
    base = go("convert", f"{tmp_path}/mouse.parquet", *out, "--lab", "here")
    times = spark.read.parquet(f"{base}/times").orderBy("frame_idx").collect()
    assert base.endswith("/out/mouse") and np.allclose([r["seconds"] for r in times], np.arange(80) * 0.02)
    assert "Session date: 2024-03-01" in go("inspect", base) and "(here, Unknown)" in go("inspect", base)
    assert "No changes found!" in go("inspect", base, "--level", "deltaf")

    done = go("preprocess", base, *out)
    attributes = {r["name"]: r["value"] for r in spark.read.parquet(f"{done}/attributes").collect()}
    assert attributes["lab"] == "here" and {"noise_check", "snr", "snr_check", "bleaching_factor", "timestamp_jump", "histogram_separation"} <= set(attributes)
    assert "changes: 1680 rows" in go("inspect", base, "--level", "deltaf")
    go("process", "zscore", done)
    z = np.array([r["z"] for r in spark.read.parquet(f"{done}/zscores").where("y = 1 and x = 2").collect()])
    assert len(z) == 40 and abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9
    assert spark.read.parquet(go("process", "smooth", done, *out) + "/smoothed").count() == 40

    with pytest.raises(ValueError, match="name a file"):
        go("register", "landmarks", done, *out)
    points = {"a": (0.0, 0.0), "b": (5.0, 1.0), "c": (2.0, 4.0)}
    writers.landmarks_csv(f"{done}_landmarks.csv", {k: (x + 1, y + 1) for k, (x, y) in points.items()})
    writers.landmarks_csv(f"{tmp_path}/template.csv", points)
    registered = go("register", "landmarks", done, "-t", f"{tmp_path}/template.csv", *out)
    placed = {r["landmark"]: (r["x"], r["y"]) for r in spark.read.parquet(f"{registered}/landmarks").where("set_id = 'registered'").collect()}
    assert all(np.allclose(placed[k], points[k]) for k in points)
    assert "registered frames: 40 rows" in go("inspect", base, "--level", "registered")

    spark.createDataFrame([(y, x, 1 if x < 3 else 0) for y in range(6) for x in range(7)], "y int, x int, region_id int").write.parquet(f"{tmp_path}/raster")
    (tmp_path / "names.csv").write_text("id, acronym, name\n1, ONE, first\n")
    regions = go("process", "regions", registered, "--raster", f"{tmp_path}/raster", "--dictionary", f"{tmp_path}/names.csv", "--width", "7", *out)
    assert spark.read.csv(regions, header=True).groupBy("region").count().count() == 2
    np.savez(tmp_path / "r.npz", regressors=rng.normal(size=(30, 2)), labels=np.array(["a", "b"]), trial_idx=np.arange(5, 35))
    with np.load(go("process", "regression", done, f"{tmp_path}/r.npz", *out)) as maps:
        assert maps["coef"].shape == (2, 6, 7) and maps["r2"].shape == (6, 7)

    assert spark.read.text(go("export", "timestamps", done, *out)).count() == 40
    assert go("export", "deltaf", done, *out).startswith(f"{tmp_path}/out/mouse_deltaf")
    assert open(go("sample", base, "--index", "3", "--crop", "2", *out), "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    for folder in (done, registered):
        assert "<table>" in open(go("report", folder, *out)).read()
    with pytest.raises(ValueError):
        go("report", base, *out)


def test_metadata_and_timestamps_of_text(spark, tmp_path):
    spark.createDataFrame([("x", i, 2, 2, [1.0, 2.0, 3.0, 4.0]) for i in range(3)], "session_id string, frame_idx bigint, height int, width int, pixels array<double>").drop("session_id").write.parquet(f"{tmp_path}/rec.parquet")
    (tmp_path / "t.csv").write_text("2024-01-01T00:00:01\n2024-01-01T00:00:02\n2024-01-01T00:00:04\n")
    (tmp_path / "m.json").write_text('{"sex": "F", "lab": "there"}')
    base = cli.run(spark, cli.parser().parse_args(["convert", f"{tmp_path}/rec.parquet", "-t", f"{tmp_path}/t.csv", "-m", f"{tmp_path}/m.json", "--lab", "here", "-o", str(tmp_path / "out")]))
    found = {r["name"]: r["value"] for r in spark.read.parquet(f"{base}/attributes").collect()}
    assert (found["sex"], found["lab"], found["session_start"], found["species"]) == ("F", "here", "2024-01-01T00:00:01", readers.DEFAULT_METADATA["species"])
    assert [r["seconds"] for r in spark.read.parquet(f"{base}/times").orderBy("frame_idx").collect()] == [0.0, 1.0, 3.0]
