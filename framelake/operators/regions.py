"""Activity of atlas regions. Atlas and dictionary are tables: atlas (hemisphere, y, x, region_id), regions (id, acronym, name, ...), with ``ord`` where the order of
rows counts: of several regions of one acronym the first stands (without it, that of the least id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.layout import small, to_pixels

# Regions left out unless asked for.
DEFAULT_EXCLUDE = (
    "FRP1",
    "VISpl1",
    "VISpor1",
    "VISli1",
    "TEa1",
    "AUDd1",
    "AUDp1",
    "AUDpo1",
    "AUDv1",
    "ORBm1",
)


def both_hemispheres(raster: DataFrame, width: int) -> DataFrame:
    """hemisphere, y, x, region_id from the left raster (y, x, region_id) and its mirror image."""
    left = raster.select(F.lit("left").alias("hemisphere"), "y", "x", "region_id")
    return left.unionByName(raster.select(F.lit("right").alias("hemisphere"), "y", (F.lit(width - 1) - F.col("x")).alias("x"), "region_id"))


def _order(regions: DataFrame) -> list[str]:
    return ["ord", "id"] if "ord" in regions.columns else ["id"]


def included(regions: DataFrame, exclude: tuple[str, ...] = (), ignore_default: bool = False) -> DataFrame:
    """The first region of each acronym but those excluded."""
    first = Window.partitionBy("acronym").orderBy(*_order(regions))
    kept = regions.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    out = [*exclude, *(() if ignore_default else DEFAULT_EXCLUDE)]
    return kept.where(~F.col("acronym").isin(out)) if out else kept


def region_activity(frames: DataFrame, atlas: DataFrame, regions: DataFrame, acronym: str, hemisphere: str = "both") -> DataFrame:
    """session_id, frame_idx, F of one region on one side or both; NaN pixels count as NaN."""
    side = hemisphere.lower()
    if side not in ("left", "right", "both"):
        raise ValueError(f"no such hemisphere: {hemisphere}")
    ids = [r["id"] for r in regions.where(F.col("acronym") == acronym).orderBy(*_order(regions)).limit(1).collect()]
    if not ids:
        raise ValueError(f"no such region: {acronym}")
    cells = atlas if side == "both" else atlas.where(F.col("hemisphere") == side)
    # On both sides labels are added up, cell by cell, before they are compared.
    cells = cells.groupBy("y", "x").agg(F.sum("region_id").alias("region_id")).where(F.col("region_id") == ids[0]).select("y", "x")
    return to_pixels(frames).join(small(cells), ["y", "x"]).groupBy("session_id", "frame_idx").agg(F.avg("value").alias("F"))


def all_regions(frames: DataFrame, atlas: DataFrame, regions: DataFrame, exclude: tuple[str, ...] = (), ignore_default: bool = False, spread_nan: bool = True) -> DataFrame:
    """session_id, region (L_ or R_ and acronym), frame_idx, F; NaN for regions without pixels. Pixels are averaged where their frame is read.

    A NaN pixel anywhere makes all regions of its frame NaN (all are one product of matrices); without ``spread_nan`` only those that it lies in.
    """
    named = included(regions, exclude, ignore_default).select("id", "acronym")
    sides = named.select("*", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("hemisphere"))
    sides = sides.withColumn("region", F.concat(F.when(F.col("hemisphere") == "left", "L_").otherwise("R_"), "acronym"))
    cells = atlas.join(sides, (atlas["region_id"] == sides["id"]) & (atlas["hemisphere"] == sides["hemisphere"])).select("y", "x", "region")
    spoilt = F.exists("pixels", F.isnan) if spread_nan else F.lit(False)
    pixels = to_pixels(frames.withColumn("__nan", spoilt), "__nan").join(small(cells), ["y", "x"])
    means = pixels.groupBy("session_id", "region", "frame_idx").agg(F.when(F.max("__nan"), F.lit(float("nan"))).otherwise(F.avg("value")).alias("F"))
    empty = sides.join(cells.select("region").distinct(), "region", "left_anti").select("region")
    none = frames.select("session_id", "frame_idx").crossJoin(small(empty)).select("session_id", "region", "frame_idx", F.lit(float("nan")).alias("F"))  # regions are few
    return means.unionByName(none)


def wide(activity: DataFrame, names: list[str]) -> DataFrame:
    """session_id, frame_idx and a column for each region named."""
    return activity.groupBy("session_id", "frame_idx").pivot("region", names).agg(F.first("F"))


def with_times(activity: DataFrame, times: DataFrame) -> DataFrame:
    """region, timestamp, F, ready for a sink."""
    return activity.join(times, ["session_id", "frame_idx"]).select("session_id", "region", F.col("ts_raw").alias("timestamp"), "F")
