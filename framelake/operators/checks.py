"""Quality checks of recordings; ``passed`` is true where a recording is sound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def intervals(times: DataFrame, by: str = "session_id", order: str = "frame_idx", micros: str = "micros", seconds_as_ms: bool = False) -> DataFrame:
    """by, order, ms: whole milliseconds to the time before, truncated. ``seconds_as_ms`` reads a second as a millisecond, as is done with decimal seconds by default elsewhere."""
    gap = F.col(micros) - F.lag(micros).over(Window.partitionBy(by).orderBy(order))
    unit = 1_000_000 if seconds_as_ms else 1000
    return times.select(by, order, (gap / unit).cast("bigint").alias("ms")).where("ms is not null")


def standardised(df: DataFrame, value: str, by: str) -> DataFrame:
    """df with ``z``; NaN where nothing varies."""
    over = Window.partitionBy(by)
    out = df.withColumns({"__m": F.avg(value).over(over), "__s": F.stddev_pop(value).over(over)})
    return out.withColumn("z", F.when(F.col("__s") == 0, NAN).otherwise((F.col(value) - F.col("__m")) / F.when(F.col("__s") != 0, F.col("__s")))).drop("__m", "__s")


def _passed(value):
    return F.coalesce(~F.isnan(value) & (value <= F.col("__limit")), F.lit(False))


def _verdict(df: DataFrame, by: str, value, name: str, limit: float) -> DataFrame:
    out = df.groupBy(by).agg(value.alias(name)).withColumn("__limit", F.lit(limit))
    return out.withColumn("passed", _passed(F.col(name))).drop("__limit")


def timestamp_consistency(gaps: DataFrame, by: str = "session_id", percentile: float = 99.0, threshold: float = 2.0) -> DataFrame:
    """by, p, passed: a percentile of the standardised intervals is no more than the threshold."""
    z = standardised(gaps, "ms", by)
    return _verdict(z, by, F.percentile("z", F.lit(percentile / 100)), "p", threshold)


def timestamp_jumps(gaps: DataFrame, by: str = "session_id", threshold: float = 2.0) -> DataFrame:
    """by, jump, passed: no standardised interval is larger than the threshold, either way."""
    z = standardised(gaps, "ms", by)
    return _verdict(z, by, F.max(F.abs("z")), "jump", threshold)


def noise_map(pixels: DataFrame, rate: float = 25.0, order: str = "frame_idx") -> DataFrame:
    """session_id, y, x, noise: the median absolute step over the root of the frame rate, in per cent; NaN steps don't count."""
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("session_id", "y", "x").orderBy(order)))
    steps = pixels.select("session_id", "y", "x", step.alias("d")).where("d is not null and not isnan(d)")
    return steps.groupBy("session_id", "y", "x").agg((F.median("d") / rate**0.5 * 100).alias("noise"))


def noise_check(noise: DataFrame, threshold: float = 10.0) -> DataFrame:
    return _verdict(noise, "session_id", F.median("noise"), "noise", threshold)


def snr(pixels: DataFrame, noise: DataFrame, threshold: float = 1.5) -> DataFrame:
    """session_id, snr, passed: the median over pixels of their 99th percentile, by the 99th percentile over pixels of the noise (as a share)."""
    top = pixels.groupBy("session_id", "y", "x").agg(F.percentile("value", F.lit(0.99)).alias("top")).groupBy("session_id").agg(F.median("top").alias("top"))
    low = noise.groupBy("session_id").agg(F.percentile(F.col("noise") / 100, F.lit(0.99)).alias("low"))
    value = F.when(F.col("low") == 0, NAN).otherwise(F.col("top") / F.when(F.col("low") != 0, F.col("low")))
    return top.join(low, "session_id").select("session_id", value.alias("snr")).withColumn("passed", ~F.isnan("snr") & (F.col("snr") >= threshold))


def bleaching(series: DataFrame, threshold: float = 5e-7) -> DataFrame:
    """session_id, slope, passed: the mean signal does not fall faster than the threshold per frame. series: session_id, k, mean."""
    fit = series.groupBy("session_id").agg(F.regr_slope("mean", "k").alias("slope"))
    return fit.withColumn("passed", F.coalesce(F.col("slope") >= -abs(threshold), F.lit(False)))


def duration(times: DataFrame, by: str = "session_id", micros: str = "micros") -> DataFrame:
    """by, minutes (whole, between first and last), n."""
    return times.groupBy(by).agg(F.floor((F.max(micros) - F.min(micros)) / 60_000_000).alias("minutes"), F.count("*").alias("n"))


# The dip: how far a distribution is from the nearest with one mode.


#: Blocks whose lowest points are knots of one round of thinning out.
BLOCKS = 256
#: Tasks over which the samples of a session are dealt.
DRAW_TASKS = 50


def _chain(x: np.ndarray, y: np.ndarray, sign: float) -> list[int]:
    """Places of the hull's corners among points in order, one after the other."""
    xs, ys, kept = x.tolist(), y.tolist(), []
    for i in range(len(xs)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if sign * ((ys[b] - ys[a]) * (xs[i] - xs[a]) - (ys[i] - ys[a]) * (xs[b] - xs[a])) < 0:
                break
            kept.pop()
        kept.append(i)
    return kept


def _thinned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places, in order, of the points that can be on the minorant, x being different: none is left out but what lies clearly above a chord between two others."""
    left, knots = np.arange(len(x)), np.array([0, len(x) - 1])
    if len(x) <= 4 * BLOCKS or not np.isfinite(x[-1] - x[0]):
        return left
    slack = 1e-12 * (1 + np.ptp(y))
    gap = y - np.interp(x, x[knots], y[knots])
    while len(left) > 4 * BLOCKS:
        per = len(left) // BLOCKS
        low = gap[: per * BLOCKS].reshape(BLOCKS, per).argmin(1) + per * np.arange(BLOCKS)
        knots = np.union1d(knots, left[low])
        knots = knots[_chain(x[knots], y[knots], 1.0)]
        gap = y[left] - np.interp(x[left], x[knots], y[knots])
        under, before = gap <= slack, len(left)
        left, gap = left[under], gap[under]
        if 2 * len(left) > before:
            break
    return left


def _hull(x: np.ndarray, y: np.ndarray, upper: bool) -> list[int]:
    """Indices of the greatest convex minorant (or least concave majorant) of points in order. Of equal x only the outermost counts, and both ends."""
    sign, apart = (-1.0 if upper else 1.0), x[1:] > x[:-1]
    outer = np.flatnonzero(np.append(apart, True) if upper else np.append(True, apart))
    ends = outer[_thinned(x[outer], sign * y[outer])]
    kept = np.union1d(ends, [0, len(x) - 1])
    return kept[_chain(x[kept], y[kept], sign)].tolist()


def dip(values: np.ndarray) -> float:
    """The dip statistic: the modal interval shrinks to where the majorant and the minorant of the empirical distribution are farthest apart."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 1.0 / (2 * max(n, 1))
    low, high, worst = 0, n - 1, 1.0
    rank = np.arange(n, dtype=float)
    while True:
        part = slice(low, high + 1)
        xs = x[part]
        g, m = _hull(xs, rank[part], False), _hull(xs, rank[part] + 1, True)
        below = np.interp(xs, xs[g], (rank[part])[g])
        above = np.interp(xs, xs[m], (rank[part] + 1)[m])
        knots = sorted({*g, *m})
        gaps = (above - below)[knots]
        best = int(np.argmax(gaps))
        if gaps[best] <= worst:
            break
        at = knots[best]
        left = max(i for i in g if i <= at) if any(i <= at for i in g) else 0
        right = min((i for i in m if i >= at), default=len(xs) - 1)
        if at in g:
            left = at
        if at in m:
            right = at
        inner = np.max((rank[part] + 1 - below)[: left + 1], initial=0.0), np.max((above - rank[part])[right:], initial=0.0)
        worst = max(worst, *inner)
        if (left, right) == (0, len(xs) - 1) or right <= left:
            worst = max(worst, min(float(gaps[best]), worst))
            break
        low, high = low + left, low + right
    return worst / (2 * n)


def _drawn_dip(n: int, draw: int, seed: int = 7) -> float:
    """The dip of the draw-th (from 0) of consecutive uniform samples of size n from a seed; the generator skips what comes before."""
    return dip(np.random.Generator(np.random.PCG64(seed).advance(draw * n)).random(n))


def dip_p(values: np.ndarray, draws: int = 200, seed: int = 7) -> float:
    """The share of uniform samples of this size whose dip is as large at least; from a fixed seed."""
    d, n = dip(values), len(values)
    return float(np.mean([_drawn_dip(n, i, seed) >= d for i in range(draws)]))


def histogram_separation(series: DataFrame, value: str = "std", alpha: float = 0.05, draws: int = 200) -> DataFrame:
    """session_id, dip, p, passed: one number per frame has more than one mode; p as by ``dip_p``. A session's series goes to one task (frames, not pixels), its samples to ``DRAW_TASKS``.
    Sessions of one length share their samples' dips; a series of 3 or fewer has p = 1."""

    def found(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame[value].dropna().to_numpy()
        return pd.DataFrame({"session_id": [key[0]], "dip": [dip(values) if len(values) else 0.0], "n": [len(values)]})

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], float] = {}
        for frame in frames:
            pairs = list(zip(frame["n"].tolist(), frame["draw"].tolist(), strict=True))
            for n, draw in {*pairs} - known.keys():
                known[n, draw] = _drawn_dip(n, draw) if n > 3 else np.inf
            yield frame[["session_id", "dip"]].assign(as_large=np.array([known[pair] for pair in pairs], dtype=float) >= frame["dip"].to_numpy())

    dips = series.select("session_id", value).groupBy("session_id").applyInPandas(found, "session_id string, dip double, n bigint")
    each = dips.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).repartitionById(DRAW_TASKS, F.col("draw") % DRAW_TASKS)
    against = each.mapInPandas(compared, "session_id string, dip double, as_large boolean")
    out = against.groupBy("session_id").agg(F.first("dip").alias("dip"), F.avg(F.col("as_large").cast("int")).alias("p"))
    return out.withColumn("passed", F.col("p") < alpha)
