"""Statistics of frames as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import frames as fr


def read_frames(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """Frames from Parquet files that come into a folder."""
    schema = "session_id string, frame_idx bigint, ts timestamp, height int, width int, pixels array<double>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def statistics(frames: DataFrame) -> DataFrame:
    """session_id, frame_idx, ts, mean, std of each frame; nothing is kept between batches."""
    made = fr.arrays
    return frames.select("session_id", "frame_idx", "ts", made.mean(F.col("pixels")).alias("mean"), made.std(F.col("pixels")).alias("std"))


def windowed(stats: DataFrame, every: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Frames, mean and largest deviation of each session and window of time; state is kept until the watermark has passed."""
    grouped = stats.withWatermark("ts", late).groupBy("session_id", F.window("ts", every))
    return grouped.agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), F.max("std").alias("std")).select("session_id", F.col("window.start").alias("start"), "n", "mean", "std")
