"""Selection and reduction of frames; all but projections stay within a frame's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import arrays
from framelake.functions.numbers import rescaled
from framelake.layout import small, to_pixels


def even_skips(start: int | None, end: int | None) -> tuple[int, int]:
    """Frames to leave out at either end: whole pairs, as two channels alternate; the start counts from 1."""
    first = max(0, (start or 0) - 1)
    return first + first % 2, (end or 0) + (end or 0) % 2


def skip(frames: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The frames between, numbered from 0 again. Frame numbers of a session run from 0 without gaps."""
    first, last = even_skips(start, end)
    if not first and not last:
        return frames
    n = frames.groupBy("session_id").agg((F.max("frame_idx") + 1).alias("__n"))
    kept = frames.join(small(n), "session_id").where((F.col("frame_idx") >= first) & (F.col("frame_idx") < F.col("__n") - last))
    return kept.withColumn("frame_idx", F.col("frame_idx") - first).drop("__n")


def reshaped(frames: DataFrame, pixels: Column, height: Column, width: Column) -> DataFrame:
    """frames with other pixels and sides. In two steps: inside a lambda, names of one step would mean its new columns."""
    made = frames.withColumn("__pixels", pixels)
    return made.withColumns({"height": height.cast("int"), "width": width.cast("int")}).withColumn("pixels", F.col("__pixels")).drop("__pixels")


def crop(frames: DataFrame, edge: int) -> DataFrame:
    """Without ``edge`` pixels on every side."""
    if edge <= 0:
        return frames
    down, across = F.col("height") - 2 * edge, F.col("width") - 2 * edge
    return reshaped(frames, arrays.window(F.col("pixels"), F.col("width"), edge, edge, down, across), down, across)


def keep_corner(frames: DataFrame, rows: int = 0, columns: int = 0) -> DataFrame:
    """The first rows and columns; 0 keeps all of them."""
    down = F.least(F.lit(rows), F.col("height")) if rows else F.col("height")
    across = F.least(F.lit(columns), F.col("width")) if columns else F.col("width")
    return reshaped(frames, arrays.window(F.col("pixels"), F.col("width"), 0, 0, down, across), down, across)


def spatial_bin(frames: DataFrame, bins: int = 2) -> DataFrame:
    """Means of bins x bins squares; sides that don't divide are an error."""
    fits = (F.col("height") % bins == 0) & (F.col("width") % bins == 0)
    value = F.when(fits, arrays.binned(F.col("pixels"), F.col("width"), F.col("height"), bins)).otherwise(F.raise_error(F.lit(f"a frame's sides are no multiples of {bins}")))
    return reshaped(frames, value, F.col("height") / bins, F.col("width") / bins)


def statistics(frames: DataFrame) -> DataFrame:
    """session_id, frame_idx, mean, std of each frame."""
    return frames.select("session_id", "frame_idx", arrays.mean(F.col("pixels")).alias("mean"), arrays.std(F.col("pixels")).alias("std"))


def projections(frames: DataFrame, *by: str) -> DataFrame:
    """session_id, by, y, x, mean, std, maxip over time; each task sends one row per pixel."""
    pixels = to_pixels(frames, *by)
    return pixels.groupBy("session_id", *by, "y", "x").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("maxip"))


def to_bytes(frames: DataFrame) -> DataFrame:
    """session_id, frame_idx, height, width, pixels of 0 to 255 over the session's range."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    ends = frames.groupBy("session_id").agg(F.min(low).alias("__low"), F.max(high).alias("__high"))
    scaled: Column = F.transform("pixels", lambda v: rescaled(v, F.col("__low"), F.col("__high")))
    return frames.join(small(ends), "session_id").select("session_id", "frame_idx", "height", "width", scaled.alias("pixels"))


def zscore(pixels: DataFrame, value: str = "value") -> DataFrame:
    """pixels with ``z`` over time; NaN where a pixel never changes. Pixel statistics are joined back, the rows stay where they are if those are few."""
    of = pixels.groupBy("session_id", "y", "x").agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = F.when(F.col("__s") == 0, float("nan")).otherwise((F.col(value) - F.col("__m")) / F.when(F.col("__s") != 0, F.col("__s")))
    return pixels.join(small(of), ["session_id", "y", "x"]).withColumn("z", z).drop("__m", "__s")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin, n, low of equal parts of a column's range; the last part has its upper end."""
    ends = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    step = (F.col("__b") - F.col("__a")) / bins
    at = F.when(step == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("__a")) / F.when(step != 0, step)), F.lit(bins - 1))).cast("int")
    return df.select(value).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(F.col("__a") + at * step).alias("low"))


def numbered(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Places from 0 within ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
