"""The tables of the engine: frames (a row per frame), pixels (a row per pixel and frame), and the ways between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: session_id string, frame_idx bigint, height int, width int, pixels array<double>, and more columns as they come.
FRAME = ("session_id", "frame_idx", "height", "width", "pixels")
#: Rows that a side has at most to be broadcast.
SMALL_ROWS = 200_000


def to_pixels(frames: DataFrame, *keep: str) -> DataFrame:
    """session_id, frame_idx, ``keep``, y, x, value."""
    flat = frames.select("session_id", "frame_idx", *keep, "width", F.posexplode("pixels").alias("p", "value"))
    return flat.select("session_id", "frame_idx", *keep, F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), "value")


def to_frames(pixels: DataFrame) -> DataFrame:
    """Frames from whole grids of pixels."""
    grouped = pixels.groupBy("session_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("a"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return grouped.select("session_id", "frame_idx", "height", "width", F.transform("a", lambda s: s["value"]).alias("pixels"))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marked for broadcast if it has so few rows (it is counted up to there), as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings`` as 8 x 8 frames of whole intensities."""
    intensity = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 1000).cast("double"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("vectors").alias("session_id"), F.col("vec_id").alias("frame_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"), intensity.alias("pixels"))
