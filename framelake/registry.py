"""The registered queries of the imaging operators over the driver's tables, and their SQL.

Frames are the vectors of ``embeddings`` (8 x 8 whole intensities), timestamps and names those of ``events``; atlas, dictionary and regressors are made here, alike in both
languages. Results are rounded where the order of additions may differ.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import names
from framelake.layout import to_frames, to_pixels, vector_frames
from framelake.operators import channels as ch
from framelake.operators import checks, regions, registration, regression, stencils
from framelake.operators import frames as fr

WINDOW = 20
SIGMA = 2.0
MATRIX = np.array([[1.0471975512, 0.0981747704, 0.5413], [-0.0785398163, 0.9738937226, -0.2617], [0, 0, 1]])


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _binned(spark: SparkSession, d: str) -> DataFrame:
    return fr.spatial_bin(vector_frames(spark, d), 2)


def _dff(spark: SparkSession, d: str) -> DataFrame:
    return ch.rolling_dff(ch.channel_traces(ch.split(_binned(spark, d))), WINDOW)


def _change(spark: SparkSession, d: str) -> DataFrame:
    return ch.corrected(_dff(spark, d))


def _atlas(spark: SparkSession) -> DataFrame:
    cells = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"))
    raster = cells.withColumn("region_id", F.when(F.col("x") < 4, 1 + F.floor(F.col("y") / 2)).otherwise(0).cast("int"))
    return regions.both_hemispheres(raster, 8)


def _regions(spark: SparkSession) -> DataFrame:
    rows = [(1, "REG1", "first"), (2, "REG2", "second"), (3, "REG3", "third"), (4, "FRP1", "left out"), (9, "REG9", "without pixels")]
    return spark.createDataFrame(rows, "id int, acronym string, name string")


def _times(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


def frame_statistics(spark, d):
    return fr.statistics(vector_frames(spark, d)).select("frame_idx", _r("mean"), _r("std"))


def spatial_bin(spark, d):
    return to_pixels(_binned(spark, d)).select("frame_idx", "y", "x", _r("value"))


def crop_frames(spark, d):
    return to_pixels(fr.crop(vector_frames(spark, d), 2)).select("frame_idx", "y", "x", "value")


def skip_frames(spark, d):
    return fr.statistics(fr.skip(vector_frames(spark, d), 4, 5)).select("frame_idx", _r("mean"))


def registration_crop(spark, d):
    return to_pixels(fr.keep_corner(vector_frames(spark, d), 5, 0)).select("frame_idx", "y", "x", "value")


def channel_separation(spark, d):
    return ch.separate(fr.statistics(_binned(spark, d))).select("frame_idx", "channel", F.col("k").cast("bigint").alias("k"))


def channel_separation_means_flipped(spark, d):
    return ch.separate(fr.statistics(_binned(spark, d)), use_means=True, flip=True).select("frame_idx", "channel", F.col("k").cast("bigint").alias("k"))


def channel_counts(spark, d):
    return ch.counts(ch.separate(fr.statistics(_binned(spark, d)))).select("channel", "n")


def channel_means(spark, d):
    return ch.channel_series(ch.split(_binned(spark, d))).select("channel", F.col("k").cast("bigint").alias("k"), _r("mean"))


def projections(spark, d):
    return fr.projections(ch.split(_binned(spark, d)), "channel").select("channel", "y", "x", _r("mean"), _r("std"), _r("maxip"))


def baseline_f0(spark, d):
    return _dff(spark, d).select("channel", F.col("k").cast("bigint").alias("k"), "y", "x", _r("f0"))


def rolling_dff(spark, d):
    return _dff(spark, d).select("channel", F.col("k").cast("bigint").alias("k"), "y", "x", _r("dff"))


def haemodynamic_correction(spark, d):
    return ch.corrected_series(_change(spark, d)).select(F.col("k").cast("bigint").alias("k"), _r("mean"))


def corrected_pixels(spark, d):
    return _change(spark, d).select(F.col("k").cast("bigint").alias("k"), "frame_idx", "y", "x", _r("value"))


def channel_dff_means(spark, d):
    return _dff(spark, d).groupBy("channel", "k").agg(F.avg("dff").alias("mean")).select("channel", F.col("k").cast("bigint").alias("k"), _r("mean"))


def corrected_max_projection(spark, d):
    return _change(spark, d).groupBy("y", "x").agg(F.max("value").alias("maxip")).select("y", "x", _r("maxip"))


def corrected_timestamps(spark, d):
    times = vector_frames(spark, d).select("session_id", "frame_idx", F.concat(F.lit("2024-01-01T14:00:00."), F.lpad(F.col("frame_idx").cast("string"), 6, "0"), F.lit("Z")).alias("ts_raw"))
    return ch.corrected_times(ch.separate(fr.statistics(_binned(spark, d))), times).select(F.col("k").cast("bigint").alias("k"), "ts_raw")


def signal_histogram(spark, d):
    return fr.histogram(fr.statistics(vector_frames(spark, d)), "mean", 20).select(F.col("bin").cast("bigint").alias("bin"), "n", _r("low", 3))


def session_duration(spark, d):
    return checks.duration(_times(spark, d)).select("session_id", F.col("minutes").cast("bigint").alias("minutes"), "n")


def timestamp_intervals(spark, d):
    return checks.intervals(_times(spark, d)).select("session_id", "frame_idx", "ms")


def timestamp_consistency(spark, d):
    return checks.timestamp_consistency(checks.intervals(_times(spark, d)), threshold=4.0).select("session_id", _r("p"), "passed")


def timestamp_jumps(spark, d):
    return checks.timestamp_jumps(checks.intervals(_times(spark, d)), threshold=5.0).select("session_id", _r("jump"), "passed")


def noise_map(spark, d):
    return checks.noise_map(to_pixels(vector_frames(spark, d))).select("y", "x", _r("noise"))


def noise_check(spark, d):
    return checks.noise_check(checks.noise_map(to_pixels(vector_frames(spark, d))), threshold=3000.0).select(_r("noise"), "passed")


def snr(spark, d):
    pixels = to_pixels(vector_frames(spark, d))
    return checks.snr(pixels, checks.noise_map(pixels)).select(_r("snr"), "passed")


def bleaching(spark, d):
    return checks.bleaching(ch.corrected_series(_change(spark, d))).select(_r("slope", 9), "passed")


def pixel_zscore(spark, d):
    return fr.zscore(to_pixels(vector_frames(spark, d))).select("frame_idx", "y", "x", _r("z"))


def gaussian_laplace(spark, d):
    return to_pixels(stencils.gaussian_laplace(vector_frames(spark, d), SIGMA)).select("frame_idx", "y", "x", _r("value", 4))


def rescale_uint8(spark, d):
    return to_pixels(fr.to_bytes(vector_frames(spark, d))).select("frame_idx", "y", "x", F.col("value").cast("bigint").alias("value"))


REGION_COLUMNS = tuple(side + r for r in ("REG1", "REG2", "REG3", "REG9") for side in ("L_", "R_"))


def region_single(spark, d):
    return regions.region_activity(vector_frames(spark, d), _atlas(spark), _regions(spark), "REG2", "Left").select("frame_idx", _r("F"))


def region_all_long(spark, d):
    return regions.all_regions(vector_frames(spark, d), _atlas(spark), _regions(spark)).select("region", "frame_idx", F.round(F.nanvl("F", F.lit(None)), 6).alias("F"))


def region_all_wide(spark, d):
    wide = regions.wide(regions.all_regions(vector_frames(spark, d), _atlas(spark), _regions(spark)), list(REGION_COLUMNS))
    return wide.select("frame_idx", *[F.round(F.nanvl(c, F.lit(None)), 6).alias(c) for c in REGION_COLUMNS])


def region_exclusion(spark, d):
    return regions.included(_regions(spark), ("REG3",)).select(F.col("id").cast("bigint").alias("id"), "acronym")


def trial_selection(spark, d):
    frames = vector_frames(spark, d)
    trials = frames.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("c"), "frame_idx").select((F.col("c") * 1_000_000 + F.col("frame_idx")).alias("sample_idx"), "frame_idx")
    return fr.statistics(regression.select_trials(frames, trials)).select("frame_idx", _r("mean"))


def ridge_maps(spark, d):
    frames = vector_frames(spark, d)
    x = frames.select(F.col("frame_idx").alias("sample_idx"), F.array((F.col("frame_idx") % 7).cast("double"), (F.col("frame_idx") % 11).cast("double")).alias("values"))
    return regression.ridge(to_pixels(frames), x, 1.0).select("y", "x", F.round(F.col("coef")[0], 6).alias("b0"), F.round(F.col("coef")[1], 6).alias("b1"), _r("r2"), F.round("mse", 4).alias("mse"))


def _two(frames):
    """The vectors as two recordings of unlike length, by the remainder of their number by three."""
    late = F.col("frame_idx") % 3 == 2
    return frames.withColumns({"session_id": F.when(late, "b").otherwise("a"), "frame_idx": F.when(late, F.floor(F.col("frame_idx") / 3)).otherwise(2 * F.floor(F.col("frame_idx") / 3) + F.col("frame_idx") % 3)})


def ridge_maps_two_recordings(spark, d):
    frames = _two(vector_frames(spark, d))
    x = frames.select("session_id", F.col("frame_idx").alias("sample_idx"), F.array(((F.col("frame_idx") * F.when(F.col("session_id") == "a", 1).otherwise(3)) % 7).cast("double")).alias("values"))
    return regression.ridge(to_pixels(frames), x, 1.0).select("session_id", "y", "x", F.round(F.col("coef")[0], 6).alias("b0"), F.round("mse", 4).alias("mse"))


def baseline_two_windows(spark, d):
    frames = _two(vector_frames(spark, d))
    traces = to_pixels(frames.withColumns({"channel": F.lit("one"), "k": F.col("frame_idx")}), "channel", "k")
    windows = frames.select("session_id").distinct().withColumn("window", F.when(F.col("session_id") == "a", 20).otherwise(9))
    return ch.rolling_baseline(traces, windows).select("session_id", "k", "y", "x", _r("f0"))


def timestamp_checks_default(spark, d):
    gaps = checks.intervals(_times(spark, d))
    return checks.timestamp_consistency(gaps).select("session_id", _r("p"), "passed").join(checks.timestamp_jumps(gaps).select("session_id", _r("jump"), F.col("passed").alias("even")), "session_id")


def noise_check_default(spark, d):
    return checks.noise_check(checks.noise_map(to_pixels(vector_frames(spark, d)))).select(_r("noise"), "passed")


def affine_points(spark, d):
    points = vector_frames(spark, d).select("frame_idx", (F.col("frame_idx") % 13).cast("double").alias("x"), (F.col("frame_idx") % 17).cast("double").alias("y"))
    return registration.transformed(points, MATRIX).select("frame_idx", _r("x"), _r("y"))


def warp_bicubic(spark, d):
    return to_pixels(stencils.warp(vector_frames(spark, d), MATRIX)).select("frame_idx", "y", "x", _r("value", 4))


def frame_layout_round_trip(spark, d):
    return to_pixels(to_frames(to_pixels(vector_frames(spark, d)))).select("frame_idx", "y", "x", "value")


def dip_test(spark, d):
    return checks.histogram_separation(fr.statistics(vector_frames(spark, d)), "std").select(_r("dip"), "p", "passed")


def stem_parsing(spark, d):
    path = F.concat(F.lit("/data/raw/sub-"), F.col("user_id").cast("string"), F.lit("_exp-"), F.col("event_type"), F.lit("_date-"), F.date_format("ts", "yyyyMMdd"), F.lit(".h5"))
    stem = names.stem(path)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", stem.alias("stem"), names.field(stem, "sub").alias("animal"), names.field(stem, "exp").alias("experiment"), names.field(stem, "date").alias("date"))


QUERIES = (
    frame_statistics, spatial_bin, crop_frames, skip_frames, registration_crop, channel_separation, channel_separation_means_flipped, channel_counts, channel_means, projections,
    baseline_f0, rolling_dff, haemodynamic_correction, corrected_pixels, channel_dff_means, corrected_max_projection, corrected_timestamps, signal_histogram, session_duration,
    timestamp_intervals, timestamp_consistency, timestamp_jumps, noise_map, noise_check, snr, bleaching, pixel_zscore, gaussian_laplace, rescale_uint8, region_single, region_all_long,
    region_all_wide, region_exclusion, trial_selection, ridge_maps, ridge_maps_two_recordings, baseline_two_windows, timestamp_checks_default, noise_check_default, affine_points, warp_bicubic, frame_layout_round_trip, dip_test, stem_parsing,
)


def queries():
    return {q.__name__: q for q in QUERIES}


# The SQL: common table expressions that build on each other.
_CTE = {
    "raw": ("", "SELECT vec_id AS frame_idx, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, floor((CAST(embedding[p + 1] AS DOUBLE) + 1.0) * 1000) AS value FROM embeddings, (SELECT unnest(range(64)) AS p)"),
    "stats": ("raw", "SELECT frame_idx, avg(value) AS mean, stddev_pop(value) AS std FROM raw GROUP BY frame_idx"),
    "binned": ("raw", "SELECT frame_idx, y // 2 AS y, x // 2 AS x, avg(value) AS value FROM raw GROUP BY ALL"),
    "bstats": ("binned", "SELECT frame_idx, avg(value) AS mean, stddev_pop(value) AS std FROM binned GROUP BY frame_idx"),
    "chan": ("bstats", "SELECT frame_idx, channel, row_number() OVER (PARTITION BY channel ORDER BY frame_idx) - 1 AS k FROM (SELECT frame_idx, CASE WHEN std > (SELECT avg(std) FROM bstats) THEN 'gcamp' WHEN std < (SELECT avg(std) FROM bstats) THEN 'isosb' END AS channel FROM bstats) WHERE channel IS NOT NULL"),
    "tr": ("chan", "SELECT channel, k, frame_idx, y, x, value, count(*) OVER (PARTITION BY channel, y, x) AS n, sum(CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY channel, y, x ORDER BY k) AS s FROM binned JOIN chan USING (frame_idx)"),
    "m": ("tr", "SELECT *, CASE WHEN k >= 10 AND k < n - 10 THEN (lead(s, 10) OVER w - lag(s, 10) OVER w) / 20.0 END AS m FROM tr WINDOW w AS (PARTITION BY channel, y, x ORDER BY k)"),
    "base": ("m", "SELECT *, CASE WHEN k < 10 THEN avg(m) FILTER (WHERE k >= 10 AND k < least(20, n - 10)) OVER w WHEN k >= n - 10 THEN avg(m) FILTER (WHERE k >= greatest(10, n - 20) AND k < n - 10) OVER w ELSE m END AS f0 FROM m WINDOW w AS (PARTITION BY channel, y, x)"),
    "dff": ("base", "SELECT channel, k, frame_idx, y, x, f0, (value - f0) / f0 AS dff FROM base"),
    "change": ("dff", "SELECT a.k, a.frame_idx, a.y, a.x, a.dff - b.dff AS value FROM dff a JOIN dff b ON a.k = b.k AND a.y = b.y AND a.x = b.x WHERE a.channel = 'gcamp' AND b.channel = 'isosb'"),
    "times": ("", "SELECT user_id AS session_id, event_id AS frame_idx, epoch_us(ts) AS micros FROM events"),
    "gaps": ("times", "SELECT * FROM (SELECT session_id, frame_idx, CAST(trunc((micros - lag(micros) OVER (PARTITION BY session_id ORDER BY frame_idx)) / 1000) AS BIGINT) AS ms FROM times) WHERE ms IS NOT NULL"),
    "two": ("raw", "SELECT CASE WHEN frame_idx % 3 = 2 THEN 'b' ELSE 'a' END AS session_id, CASE WHEN frame_idx % 3 = 2 THEN frame_idx // 3 ELSE 2 * (frame_idx // 3) + frame_idx % 3 END AS k, y, x, value FROM raw"),
    "tworeg": ("two", "SELECT session_id, y, x, k, value, (CASE WHEN session_id = 'a' THEN k ELSE 3 * k END) % 7 AS r FROM two"),
    "twofit": ("tworeg", "SELECT session_id, y, x, count(*) AS n, covar_pop(r, value) * count(*) AS s, var_pop(r) * count(*) AS p, var_pop(value) * count(*) AS tot FROM tworeg GROUP BY ALL"),
    "twosum": ("two", "SELECT *, CASE WHEN session_id = 'a' THEN 10 ELSE 5 END AS h, count(*) OVER (PARTITION BY session_id, y, x) AS n, sum(CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY session_id, y, x ORDER BY k) AS s FROM two"),
    "twom": ("twosum", "SELECT *, CASE WHEN k >= h AND k < n - h THEN (CASE WHEN h = 10 THEN lead(s, 10) OVER w - lag(s, 10) OVER w ELSE lead(s, 5) OVER w - lag(s, 5) OVER w END) / (2.0 * h) END AS m FROM twosum WINDOW w AS (PARTITION BY session_id, y, x ORDER BY k)"),
    "gz": ("gaps", "SELECT session_id, CASE WHEN stddev_pop(ms) OVER w = 0 THEN 'NaN'::DOUBLE ELSE (ms - avg(ms) OVER w) / stddev_pop(ms) OVER w END AS z FROM gaps WINDOW w AS (PARTITION BY session_id)"),
    "noise": ("raw", "SELECT y, x, median(abs(d)) / 5.0 * 100 AS noise FROM (SELECT y, x, value - lag(value) OVER (PARTITION BY y, x ORDER BY frame_idx) AS d FROM raw) WHERE d IS NOT NULL GROUP BY y, x"),
    "cells": ("", "SELECT CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x FROM (SELECT unnest(range(64)) AS p)"),
    "atlas": ("cells", "SELECT 'L_' AS side, y, x, CASE WHEN x < 4 THEN 1 + y // 2 ELSE 0 END AS id FROM cells UNION ALL SELECT 'R_', y, 7 - x, CASE WHEN x < 4 THEN 1 + y // 2 ELSE 0 END FROM cells"),
    "regs": ("", "SELECT * FROM (VALUES (1, 'REG1'), (2, 'REG2'), (3, 'REG3'), (4, 'FRP1'), (9, 'REG9')) t(id, acronym)"),
    "act": ("raw atlas regs", "SELECT side || acronym AS region, frame_idx, avg(value) AS F FROM raw JOIN atlas USING (y, x) JOIN regs USING (id) WHERE acronym <> 'FRP1' GROUP BY ALL"),
    "kern": ("", "SELECT d, phi, (d * d / 16.0 - 0.25) * phi AS bent FROM (SELECT d, exp(-d * d / 8.0) / sum(exp(-d * d / 8.0)) OVER () AS phi FROM (SELECT unnest(range(-8, 9)) AS d))"),
    "mirror": ("kern", "SELECT i, d, phi, bent, CASE WHEN j < 8 THEN j ELSE 15 - j END AS j FROM (SELECT i, d, phi, bent, (i + d + 32) % 16 AS j FROM (SELECT unnest(range(8)) AS i), kern)"),
    "across": ("raw mirror", "SELECT frame_idx, y, i AS x, sum(value * phi) AS a, sum(value * bent) AS b FROM raw JOIN mirror ON x = j GROUP BY ALL"),
    "fit": ("raw", "SELECT y, x, count(*) AS n, avg(value) AS my, var_pop(value) * count(*) AS tot, sum((frame_idx % 7 - m1) * value) AS s1, sum((frame_idx % 11 - m2) * value) AS s2 FROM raw, (SELECT avg(vec_id % 7) AS m1, avg(vec_id % 11) AS m2 FROM embeddings) GROUP BY y, x"),
    "xx": ("", "SELECT sum((vec_id % 7 - m1) * (vec_id % 7 - m1)) AS p11, sum((vec_id % 7 - m1) * (vec_id % 11 - m2)) AS p12, sum((vec_id % 11 - m2) * (vec_id % 11 - m2)) AS p22 FROM embeddings, (SELECT avg(vec_id % 7) AS m1, avg(vec_id % 11) AS m2 FROM embeddings)"),
    "beta": ("fit xx", "SELECT *, (s1 * (p22 + 1) - s2 * p12) / ((p11 + 1) * (p22 + 1) - p12 * p12) AS b0, (s2 * (p11 + 1) - s1 * p12) / ((p11 + 1) * (p22 + 1) - p12 * p12) AS b1 FROM fit, xx"),
    "res": ("beta", "SELECT *, greatest(0, tot - 2 * (b0 * s1 + b1 * s2) + b0 * b0 * p11 + 2 * b0 * b1 * p12 + b1 * b1 * p22) AS res FROM beta"),
    "src": ("cells", "SELECT y, x, 1.0471975512::DOUBLE * x + 0.0981747704::DOUBLE * y + 0.5413::DOUBLE AS sx, -0.0785398163::DOUBLE * x + 0.9738937226::DOUBLE * y - 0.2617::DOUBLE AS sy FROM cells"),
    "frac": ("src", "SELECT y, x, floor(sx::DOUBLE) AS bx, floor(sy::DOUBLE) AS by_, sx::DOUBLE - floor(sx::DOUBLE) AS tx, sy::DOUBLE - floor(sy::DOUBLE) AS ty FROM src"),
    "tapx": ("frac", "SELECT y, x, unnest([bx - 1, bx, bx + 1, bx + 2]) AS cx, unnest([(-tx*tx*tx + 2*tx*tx - tx) / 2, (3*tx*tx*tx - 5*tx*tx + 2) / 2, (-3*tx*tx*tx + 4*tx*tx + tx) / 2, (tx*tx*tx - tx*tx) / 2]) AS wx FROM frac"),
    "tapy": ("frac", "SELECT y, x, unnest([by_ - 1, by_, by_ + 1, by_ + 2]) AS cy, unnest([(-ty*ty*ty + 2*ty*ty - ty) / 2, (3*ty*ty*ty - 5*ty*ty + 2) / 2, (-3*ty*ty*ty + 4*ty*ty + ty) / 2, (ty*ty*ty - ty*ty) / 2]) AS wy FROM frac"),
    "taps": ("tapx tapy", "SELECT y, x, cx, cy, wx * wy AS w FROM tapx JOIN tapy USING (y, x)"),
    "warped": ("raw taps", "SELECT r.frame_idx, t.y, t.x, sum(t.w * r.value) AS v FROM taps t JOIN raw r ON r.y = t.cy AND r.x = t.cx GROUP BY ALL"),
}


def _sql(body: str, needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _CTE[name][0].split():
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    return ("WITH " + ", ".join(f"{n} AS ({_CTE[n][1]})" for n in order) + " " if order else "") + body


def oracle_sql():
    flipped = "CASE WHEN mean > (SELECT avg(mean) FROM bstats) THEN 'isosb' WHEN mean < (SELECT avg(mean) FROM bstats) THEN 'gcamp' END"
    return {
        "frame_statistics": _sql("SELECT frame_idx, round(mean, 6) AS mean, round(std, 6) AS std FROM stats", "stats"),
        "spatial_bin": _sql("SELECT frame_idx, y, x, round(value, 6) AS value FROM binned", "binned"),
        "crop_frames": _sql("SELECT frame_idx, y - 2 AS y, x - 2 AS x, value FROM raw WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5", "raw"),
        "skip_frames": _sql("SELECT frame_idx - 4 AS frame_idx, round(mean, 6) AS mean FROM stats WHERE frame_idx >= 4 AND frame_idx < (SELECT max(frame_idx) + 1 FROM stats) - 6", "stats"),
        "registration_crop": _sql("SELECT frame_idx, y, x, value FROM raw WHERE y < 5", "raw"),
        "channel_separation": _sql("SELECT frame_idx, channel, k FROM chan", "chan"),
        "channel_separation_means_flipped": _sql(f"SELECT frame_idx, channel, row_number() OVER (PARTITION BY channel ORDER BY frame_idx) - 1 AS k FROM (SELECT frame_idx, {flipped} AS channel FROM bstats) WHERE channel IS NOT NULL", "bstats"),
        "channel_counts": _sql("SELECT channel, count(*) AS n FROM chan GROUP BY channel", "chan"),
        "channel_means": _sql("SELECT channel, k, round(mean, 6) AS mean FROM chan JOIN bstats USING (frame_idx)", "chan bstats"),
        "projections": _sql("SELECT channel, y, x, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value), 6) AS maxip FROM binned JOIN chan USING (frame_idx) GROUP BY channel, y, x", "binned chan"),
        "baseline_f0": _sql("SELECT channel, k, y, x, round(f0, 6) AS f0 FROM dff", "dff"),
        "rolling_dff": _sql("SELECT channel, k, y, x, round(dff, 6) AS dff FROM dff", "dff"),
        "haemodynamic_correction": _sql("SELECT k, round(avg(value), 6) AS mean FROM change GROUP BY k", "change"),
        "corrected_pixels": _sql("SELECT k, frame_idx, y, x, round(value, 6) AS value FROM change", "change"),
        "channel_dff_means": _sql("SELECT channel, k, round(avg(dff), 6) AS mean FROM dff GROUP BY channel, k", "dff"),
        "corrected_max_projection": _sql("SELECT y, x, round(max(value), 6) AS maxip FROM change GROUP BY y, x", "change"),
        "corrected_timestamps": _sql("SELECT a.k, substr('2024-01-01T14:00:00.' || lpad(CAST(a.frame_idx AS VARCHAR), 6, '0') || 'Z', 1, 25) AS ts_raw FROM chan a JOIN chan b ON a.k = b.k WHERE a.channel = 'gcamp' AND b.channel = 'isosb'", "chan"),
        "signal_histogram": _sql("SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(min(a + bin * step), 3) AS low FROM (SELECT a, step, least(floor((mean - a) / step), 19) AS bin FROM stats, (SELECT min(mean) AS a, (max(mean) - min(mean)) / 20 AS step FROM stats)) GROUP BY bin", "stats"),
        "session_duration": _sql("SELECT session_id, CAST(floor((max(micros) - min(micros)) / 60000000) AS BIGINT) AS minutes, count(*) AS n FROM times GROUP BY session_id", "times"),
        "timestamp_intervals": _sql("SELECT session_id, frame_idx, ms FROM gaps", "gaps"),
        "timestamp_consistency": _sql("SELECT session_id, round(p, 6) AS p, coalesce(NOT isnan(p) AND p <= 4.0, false) AS passed FROM (SELECT session_id, quantile_cont(z, 0.99) AS p FROM gz GROUP BY session_id)", "gz"),
        "timestamp_jumps": _sql("SELECT session_id, round(j, 6) AS jump, coalesce(NOT isnan(j) AND j <= 5.0, false) AS passed FROM (SELECT session_id, max(abs(z)) AS j FROM gz GROUP BY session_id)", "gz"),
        "noise_map": _sql("SELECT y, x, round(noise, 6) AS noise FROM noise", "noise"),
        "noise_check": _sql("SELECT round(median(noise), 6) AS noise, median(noise) <= 3000 AS passed FROM noise", "noise"),
        "snr": _sql("SELECT round(t / l, 6) AS snr, t / l >= 1.5 AS passed FROM (SELECT median(p) AS t FROM (SELECT quantile_cont(value, 0.99) AS p FROM raw GROUP BY y, x)), (SELECT quantile_cont(noise / 100, 0.99) AS l FROM noise)", "raw noise"),
        "bleaching": _sql("SELECT round(regr_slope(mean, k), 9) AS slope, regr_slope(mean, k) >= -5e-7 AS passed FROM (SELECT k, avg(value) AS mean FROM change GROUP BY k)", "change"),
        "pixel_zscore": _sql("SELECT frame_idx, y, x, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM raw WINDOW w AS (PARTITION BY y, x)", "raw"),
        "gaussian_laplace": _sql("SELECT a.frame_idx, CAST(m.i AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, round(sum(a.a * m.phi + a.a * m.bent + a.b * m.phi), 4) AS value FROM across a JOIN mirror m ON a.y = m.j GROUP BY a.frame_idx, m.i, a.x", "across mirror"),
        "rescale_uint8": _sql("SELECT frame_idx, y, x, CAST(floor((value + abs(lo)) / (hi + abs(lo)) * 255) AS BIGINT) AS value FROM raw, (SELECT min(value) AS lo, max(value) AS hi FROM raw)", "raw"),
        "region_single": _sql("SELECT frame_idx, round(avg(value), 6) AS F FROM raw JOIN atlas USING (y, x) WHERE side = 'L_' AND id = 2 GROUP BY frame_idx", "raw atlas"),
        "region_all_long": _sql("SELECT region, frame_idx, round(F, 6) AS F FROM act UNION ALL SELECT side || 'REG9', frame_idx, NULL FROM stats, (VALUES ('L_'), ('R_')) t(side)", "act stats"),
        "region_all_wide": _sql("SELECT frame_idx, " + ", ".join(f'round(max(F) FILTER (WHERE region = \'{r}\'), 6) AS "{r}"' for r in REGION_COLUMNS) + " FROM act GROUP BY frame_idx", "act"),
        "region_exclusion": _sql("SELECT CAST(id AS BIGINT) AS id, acronym FROM regs WHERE acronym NOT IN ('FRP1', 'REG3')", "regs"),
        "trial_selection": _sql("SELECT c * 1000000 + frame_idx AS frame_idx, round(mean, 6) AS mean FROM stats, (SELECT unnest([0, 1]) AS c)", "stats"),
        "ridge_maps": _sql("SELECT y, x, round(b0, 6) AS b0, round(b1, 6) AS b1, round(CASE WHEN res = 0 THEN 1 WHEN tot = 0 THEN 0 ELSE 1 - res / tot END, 6) AS r2, round(res / n, 4) AS mse FROM res", "res"),
        "ridge_maps_two_recordings": _sql("SELECT session_id, y, x, round(s / (p + 1), 6) AS b0, round(greatest(0, tot - 2 * s / (p + 1) * s + s / (p + 1) * s / (p + 1) * p) / n, 4) AS mse FROM twofit", "twofit"),
        "baseline_two_windows": _sql("SELECT session_id, k, y, x, round(CASE WHEN k < h THEN avg(m) FILTER (WHERE k >= h AND k < least(2 * h, n - h)) OVER w WHEN k >= n - h THEN avg(m) FILTER (WHERE k >= greatest(h, n - 2 * h) AND k < n - h) OVER w ELSE m END, 6) AS f0 FROM twom WINDOW w AS (PARTITION BY session_id, y, x)", "twom"),
        "timestamp_checks_default": _sql("SELECT session_id, round(p, 6) AS p, coalesce(NOT isnan(p) AND p <= 2.0, false) AS passed, round(j, 6) AS jump, coalesce(NOT isnan(j) AND j <= 2.0, false) AS even FROM (SELECT session_id, quantile_cont(z, 0.99) AS p, max(abs(z)) AS j FROM gz GROUP BY session_id)", "gz"),
        "noise_check_default": _sql("SELECT round(median(noise), 6) AS noise, median(noise) <= 10 AS passed FROM noise", "noise"),
        "affine_points": _sql("SELECT vec_id AS frame_idx, round(1.0471975512::DOUBLE * (vec_id % 13) + 0.0981747704::DOUBLE * (vec_id % 17) + 0.5413::DOUBLE, 6) AS x, round(-0.0785398163::DOUBLE * (vec_id % 13) + 0.9738937226::DOUBLE * (vec_id % 17) - 0.2617::DOUBLE, 6) AS y FROM embeddings", ""),
        "warp_bicubic": _sql("SELECT f.frame_idx, f.y, f.x, round(CASE WHEN coalesce(v, 0) = 0 THEN 0 ELSE least(greatest(v, lo), hi) END, 4) AS value FROM raw f JOIN (SELECT frame_idx, min(value) AS lo, max(value) AS hi FROM raw GROUP BY frame_idx) USING (frame_idx) LEFT JOIN warped g ON g.frame_idx = f.frame_idx AND g.y = f.y AND g.x = f.x", "raw warped"),
        "frame_layout_round_trip": _sql("SELECT frame_idx, y, x, value FROM raw", "raw"),
        "stem_parsing": "SELECT event_id, 'sub-' || user_id || '_exp-' || event_type || '_date-' || strftime(ts, '%Y%m%d') AS stem, CAST(user_id AS VARCHAR) AS animal, event_type AS experiment, strftime(ts, '%Y%m%d') AS date FROM events",
    }
