"""Two interleaved channels: telling them apart, baseline, relative change, and the correction of one by the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.numbers import divided, whole
from framelake.layout import small, to_pixels
from framelake.operators.frames import numbered, statistics

SIGNAL, REFERENCE = "gcamp", "isosb"


def separate(stats: DataFrame, use_means: bool = False, flip: bool = False) -> DataFrame:
    """session_id, frame_idx, channel, k: the frames above and below the session's mean statistic; frames at it are in neither channel."""
    by = "mean" if use_means else "std"
    bar = stats.groupBy("session_id").agg(F.avg(by).alias("__bar"))
    high, low = (REFERENCE, SIGNAL) if flip else (SIGNAL, REFERENCE)
    channel = F.when(F.col(by) > F.col("__bar"), high).when(F.col(by) < F.col("__bar"), low)
    found = stats.join(small(bar), "session_id").withColumn("channel", channel).where("channel is not null")
    return numbered(found.select("session_id", "frame_idx", "channel"), ["session_id", "channel"], "frame_idx", "k")


def of_channels(frames: DataFrame, separated: DataFrame) -> DataFrame:
    """frames with ``channel`` and ``k``, their place in it."""
    return frames.join(separated, ["session_id", "frame_idx"])


def split(frames: DataFrame, use_means: bool = False, flip: bool = False) -> DataFrame:
    return of_channels(frames, separate(statistics(frames), use_means, flip))


def counts(separated: DataFrame) -> DataFrame:
    return separated.groupBy("session_id", "channel").agg(F.count("*").alias("n"))


def channel_series(frames: DataFrame) -> DataFrame:
    """session_id, channel, k, mean of frames with channels."""
    return frames.select("session_id", "channel", "k", "frame_idx", F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v, lambda s: s / F.size("pixels")).alias("mean"))


def default_window(frames_in_all: int, seconds: int = 30, rate: int = 25) -> int:
    """Frames of the rolling baseline: 30 s, or a quarter of the recording (both channels together) if that is shorter than 30 s."""
    return seconds * rate if seconds * rate <= frames_in_all else frames_in_all // 4


def session_windows(frames: DataFrame) -> DataFrame:
    """session_id, window: the default window of each recording."""
    n = F.count("*")
    return frames.groupBy("session_id").agg(F.when(n >= default_window(10**9), F.lit(default_window(10**9))).otherwise(F.floor(n / 4)).cast("int").alias("window"))


def rolling_baseline(traces: DataFrame, window: int | DataFrame, integers: bool = True, by: tuple[str, ...] = ("session_id", "channel", "y", "x")) -> DataFrame:
    """traces (by, k, value) with ``f0``, a moving mean.

    The mean around place k is over k - w/2 + 1 to k + w/2 and comes from running sums, so that the work does not grow with the window; with ``integers`` values are
    truncated to unsigned integers before. The first and last w/2 places have the mean of the w/2 nearest means (fewer if there are no more). An odd window is
    one longer; a window longer than the trace is an error. window: places, or a table (session_id, window); of its different values, which are few, each adds two
    columns to the one pass over the traces.
    """
    if isinstance(window, int):
        windows, traces, asked = [window], traces, F.lit(window)
    else:
        windows = sorted(r["window"] for r in window.select("window").distinct().collect())
        traces, asked = traces.join(small(window.select("session_id", F.col("window").alias("__asked"))), "session_id"), F.col("__asked")
    w = asked + asked % 2
    half = (w / 2).cast("int")
    trace = Window.partitionBy(*by)
    order = trace.orderBy("k")
    value = whole(F.col("value")) if integers else F.col("value")
    out = traces.withColumns({"__n": F.count("*").over(trace), "__sum": F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    middle = (F.col("k") >= half) & (F.col("k") < F.col("__n") - half)
    across = F.lit(None).cast("bigint" if integers else "double")
    for each in windows:
        h = (each + each % 2) // 2
        across = F.when(asked == each, F.lead("__sum", h).over(order) - F.lag("__sum", h).over(order)).otherwise(across)
    out = out.withColumn("__m", F.when(middle, across / w))
    head = (F.col("k") >= half) & (F.col("k") < F.least(w, F.col("__n") - half))
    tail = (F.col("k") >= F.greatest(half, F.col("__n") - w)) & (F.col("k") < F.col("__n") - half)
    out = out.withColumns({"__h": F.avg(F.when(head, F.col("__m"))).over(trace), "__t": F.avg(F.when(tail, F.col("__m"))).over(trace)})
    f0 = F.when(F.col("k") < half, F.col("__h")).when(F.col("k") >= F.col("__n") - half, F.col("__t")).otherwise(F.col("__m"))
    checked = F.when(F.col("__n") < asked, F.raise_error(F.format_string("the baseline's window is %d, but a trace has %d places only", asked, F.col("__n"))).cast("double")).otherwise(F.coalesce(f0, F.lit(float("nan"))))
    return out.withColumn("f0", checked).drop("__n", "__sum", "__m", "__h", "__t", "__asked")


def rolling_dff(traces: DataFrame, window: int | DataFrame, integers: bool = True) -> DataFrame:
    """traces with ``f0`` and ``dff``, the change relative to it."""
    return rolling_baseline(traces, window, integers).withColumn("dff", divided(F.col("value") - F.col("f0"), F.col("f0")))


def channel_traces(frames: DataFrame) -> DataFrame:
    """session_id, channel, k, frame_idx, y, x, value of frames with channels."""
    return to_pixels(frames, "channel", "k")


def corrected(dff: DataFrame) -> DataFrame:
    """session_id, k, frame_idx, y, x, value: the signal's k-th change less the reference's; places that one channel alone has go."""
    signal = dff.where(F.col("channel") == SIGNAL).select("session_id", "k", "frame_idx", "y", "x", F.col("dff").alias("__a"))
    other = dff.where(F.col("channel") == REFERENCE).select("session_id", "k", "y", "x", F.col("dff").alias("__b"))
    return signal.join(other, ["session_id", "k", "y", "x"]).select("session_id", "k", "frame_idx", "y", "x", (F.col("__a") - F.col("__b")).alias("value"))


def corrected_series(change: DataFrame) -> DataFrame:
    return change.groupBy("session_id", "k").agg(F.avg("value").alias("mean"))


def corrected_times(separated: DataFrame, times: DataFrame) -> DataFrame:
    """session_id, k, ts_raw: the timestamps of the corrected frames, cut to 25 characters."""
    both = separated.groupBy("session_id", "k").agg(F.max(F.when(F.col("channel") == SIGNAL, F.col("frame_idx"))).alias("frame_idx"), F.count("*").alias("__n")).where("__n = 2")
    return both.join(times, ["session_id", "frame_idx"]).select("session_id", "k", F.substring("ts_raw", 1, 25).alias("ts_raw"))
