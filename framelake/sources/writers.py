"""What goes out: bundles of Parquet tables, text for people, arrays for other tools."""

from __future__ import annotations

import io
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bundle(path: str, tables: dict[str, DataFrame], attributes: dict[str, object] | None = None, compression: str = "zstd") -> None:
    """A folder with a Parquet table for each entry, and one of attributes as text."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")
    if attributes and tables:
        spark = next(iter(tables.values())).sparkSession
        rows = [(k, None if v is None else str(v)) for k, v in attributes.items()]
        spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes")


def open_bundle(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Tables under names that SQL knows: linked, not copied."""
    for name, table in tables.items():
        table.createOrReplaceTempView(prefix + name)


def interim(df: DataFrame, path: str) -> DataFrame:
    """Written once and read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def landmarks_csv(path: str, points: dict[str, tuple[float, float]]) -> str:
    """A file on the driver; ``.csv`` is added if it is missing."""
    path = path if path.endswith(".csv") else path + ".csv"
    with open(path, "w", encoding="utf-8") as file:
        file.write("landmark,x,y\n" + "".join(f"{k},{x:g},{y:g}\n" for k, (x, y) in points.items()))
    return path


def means_text(series: DataFrame, path: str) -> None:
    """Channel means in order of time with four decimals, a folder of text for each channel."""
    series.select("channel", "k", F.format_string("%.4f", "mean").alias("value")).repartition("channel").sortWithinPartitions("channel", "k").select("channel", "value").write.mode("overwrite").partitionBy("channel").text(path)


def timestamps_text(times: DataFrame, path: str) -> None:
    """One timestamp a line, in the order of frames; a file for each range of frames, named in order."""
    times.repartitionByRange("frame_idx").sortWithinPartitions("frame_idx").select("ts_raw").write.mode("overwrite").text(path)


def regions_csv(activity: DataFrame, path: str) -> None:
    """region, timestamp, F with a header."""
    activity.select("region", "timestamp", "F").repartitionByRange("region").sortWithinPartitions("region", "timestamp").write.mode("overwrite").option("header", True).csv(path)


def maps_npz(path: str, maps: DataFrame, columns: list[str], most: int = 4_000_000) -> None:
    """Maps (y, x, columns) as arrays of one file on the driver; larger ones than ``most`` pixels belong into a bundle."""
    rows = maps.select("y", "x", *columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pixels: write a bundle")
    h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
    out = {}
    for c in columns:
        first = np.asarray(rows[0][c], dtype=float)
        a = np.full((*first.shape, h, w), np.nan)
        for r in rows:
            a[..., r["y"], r["x"]] = r[c]
        out[c] = a
    buffer = io.BytesIO()
    np.savez(buffer, **out)
    with open(path if path.endswith(".npz") else path + ".npz", "wb") as file:
        file.write(buffer.getvalue())


def video(frames: DataFrame, path: str) -> None:
    """Grey frames as video, where a writer is installed."""
    try:
        import imageio
    except ImportError as e:
        raise ImportError("writing videos takes imageio; rescaled frames can be written as Parquet") from e
    with imageio.get_writer(os.path.join(path), fps=25) as out:
        for r in frames.orderBy("frame_idx").toLocalIterator():
            grey = np.array(r["pixels"], dtype=np.uint8).reshape(r["height"], r["width"])
            out.append_data(np.repeat(grey[..., None], 3, axis=2))
