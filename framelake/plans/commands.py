"""The workflows as commands over folders: a recording is a folder of Parquet tables (``frames``, ``times``) and of attributes, and so is what comes out."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import names
from framelake.layout import to_frames, to_pixels
from framelake.operators import frames as fr
from framelake.operators import regions as rg
from framelake.operators import registration, regression, stencils
from framelake.plans.preprocess import preprocess
from framelake.plans.report import report
from framelake.sources import readers, writers

#: Attributes of a bundle: the table of a check, its column, and the name that it goes by.
CHECKS = (
    ("check_separation", "passed", "histogram_separation"), ("check_consistency", "passed", "timestamp_consistency"), ("check_jumps", "passed", "timestamp_jump"), ("check_noise", "passed", "noise_check"),
    ("check_snr", "passed", "snr_check"), ("check_snr", "snr", "snr"), ("check_bleaching", "passed", "bleaching_check"), ("check_bleaching", "slope", "bleaching_factor"),
)
# The optics that a converted recording is marked with.
OPTICS = {"rate_per_channel": "25.0", "excitation_signal_nm": "470.0", "excitation_reference_nm": "405.0", "grid_spacing_um": "20.0"}


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def attributes(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/attributes").collect()} if path_exists(spark, f"{path}/attributes") else {}


def session_of(path: str) -> str:
    """What a path's last part is called, without the step it comes from."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    for step in ("_preprocessed", "_registered"):
        last = last.removesuffix(step)
    return last


def seconds(times: DataFrame) -> DataFrame:
    """times with ``micros`` and ``seconds`` since the first of the session."""
    times = times.withColumn("micros", names.moment(F.col("ts_raw")))
    first = times.groupBy("session_id").agg(F.min(F.struct("frame_idx", "micros"))["micros"].alias("__first"))
    return times.join(F.broadcast(first), "session_id").withColumn("seconds", (F.col("micros") - F.col("__first")) / 1_000_000).drop("__first")  # a row per recording


def convert(spark: SparkSession, source: str, out: str, times: str | None = None, metadata: str | None = None, column: int = 0, delimiter: str = ",", header: bool = False, rate: float = 50.0, start: str = "1970-01-01T00:00:00", **given: str | None) -> str:
    """A recording's folder from a table of frames (Parquet; HDF5 and NWB where h5py is installed) and from timestamps: of the table (``ts_raw``), of text, or even ones.

    The session starts with its first timestamp. Frames or timestamps that are missing are an error.
    """
    frames = readers.foreign(spark, source) if source.endswith((".h5", ".nwb")) else readers.recording(spark, source)
    if "pixels" not in frames.columns:
        raise ValueError(f"no frames in {source}")
    name = session_of(source).rsplit(".", 1)[0]
    frames = frames if "session_id" in frames.columns else frames.withColumn("session_id", F.lit(name))
    if "ts_raw" in frames.columns:
        stamped = frames.select("session_id", "frame_idx", "ts_raw")
    elif times:
        stamped = readers.timestamps(spark, times, column, delimiter, header).select(F.lit(name).alias("session_id"), "frame_idx", "ts_raw")
    else:
        stamped = readers.synthetic_times(spark, frames.count(), start, rate).select(F.lit(name).alias("session_id"), "frame_idx", "ts_raw")
    stamped = seconds(stamped)
    begin = stamped.agg(F.min(F.struct("micros", "ts_raw"))["ts_raw"]).first()[0]
    if begin is None:
        raise ValueError(f"no timestamps for {source}")
    fields = readers.metadata(spark, metadata, **given)
    writers.bundle(out, {"frames": frames.drop("ts_raw"), "times": stamped}, {"identifier": name, "session_start": begin} | fields | OPTICS)
    return out


def run_preprocess(spark: SparkSession, path: str, out_dir: str, **options) -> str:
    """``<session>_preprocessed`` with every table of the run, the series of both channels, and the checks as attributes."""
    frames, times = spark.read.parquet(f"{path}/frames"), spark.read.parquet(f"{path}/times")
    done, out = preprocess(frames, times, **options), f"{out_dir}/{session_of(path)}_preprocessed"
    writers.bundle(out, done.tables)
    found = dict(attributes(spark, path))
    for table, column, name in CHECKS:
        if table in done.tables:
            row = spark.read.parquet(f"{out}/{table}").agg(F.min(column)).first()  # of several recordings the worst
            found[name] = row[0]
    rows = [(k, None if v is None else str(v)) for k, v in found.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{out}/attributes")
    return out


def change_frames(spark: SparkSession, path: str) -> DataFrame:
    """The changes of a preprocessed or registered folder as frames."""
    if path_exists(spark, f"{path}/registered"):
        return spark.read.parquet(f"{path}/registered")
    return to_frames(spark.read.parquet(f"{path}/change").select("session_id", F.col("k").alias("frame_idx"), "y", "x", "value"))


def change_times(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/change_times").select("session_id", F.col("k").alias("frame_idx"), "ts_raw")


def register_landmarks(spark: SparkSession, path: str, out_dir: str, recording_points: str | None = None, template_points: str | None = None, crop_x: int = 0, crop_y: int = 0) -> str:
    """``<session>_registered``: frames in the template's space, the matrix, and the landmarks of both and as registered. Unnamed landmarks are those beside the folder."""
    if not recording_points:
        recording_points = path.rstrip("/") + "_landmarks.csv"
        if not path_exists(spark, recording_points):
            raise ValueError(f"no landmarks at {recording_points}: name a file of landmarks")
    mine = readers.landmarks(spark, recording_points)
    template = readers.landmarks(spark, template_points) if template_points else readers.template_landmarks()
    moved, matrix = registration.register(change_frames(spark, path), mine, template, crop_y, crop_x)
    back = registration.transformed(readers.landmark_table(spark, mine, "registered"), np.linalg.inv(matrix))
    points = readers.landmark_table(spark, mine, "recording").unionByName(readers.landmark_table(spark, template, "template")).unionByName(back)
    out = f"{out_dir}/{session_of(path)}_registered"
    tables = {"registered": moved, "landmarks": points, "change_times": spark.read.parquet(f"{path}/change_times")}
    writers.bundle(out, tables, attributes(spark, path) | {"matrix": " ".join(map(repr, matrix.reshape(-1).tolist()))})
    return out


def smooth(spark: SparkSession, path: str, out_dir: str, sigma: float = 2.0) -> str:
    out = f"{out_dir}/{session_of(path)}_smoothed"
    writers.bundle(out, {"smoothed": stencils.gaussian_laplace(change_frames(spark, path), sigma)})
    return out


def zscore(spark: SparkSession, path: str) -> str:
    """z-scores beside the changes, in the same folder."""
    pixels = to_pixels(change_frames(spark, path))
    fr.zscore(pixels).write.mode("overwrite").parquet(f"{path}/zscores")
    return f"{path}/zscores"


def region_table(spark: SparkSession, path: str, out_dir: str, raster: str, dictionary: str, width: int, exclude: tuple[str, ...] = (), ignore_default: bool = False) -> str:
    """``<session>_regions``, CSV of region, timestamp, F. raster: Parquet of the left side (y, x, region_id)."""
    atlas = rg.both_hemispheres(spark.read.parquet(raster), width)
    activity = rg.all_regions(change_frames(spark, path), atlas, readers.region_dictionary(spark, dictionary), exclude, ignore_default)
    out = f"{out_dir}/{session_of(path)}_regions"
    writers.regions_csv(rg.with_times(activity, change_times(spark, path)), out)
    return out


def regress(spark: SparkSession, path: str, regressor_path: str, out_dir: str, alpha: float = 1.0) -> str:
    """``<session>_regression.npz`` with coef, r2, mse of one recording's z-scores, of the trials that the regressors name."""
    table, _, trials = readers.regressors(spark, regressor_path)
    frames = change_frames(spark, path)
    pixels = fr.zscore(to_pixels(frames)).select("session_id", "frame_idx", "y", "x", F.col("z").alias("value"))
    if trials is not None:
        pixels = regression.select_trials(pixels, trials)
    out = f"{out_dir}/{session_of(path)}_regression.npz"
    writers.maps_npz(out, regression.ridge(pixels, table, alpha), ["coef", "r2", "mse"])
    return out


def export_changes(spark: SparkSession, path: str, out_dir: str) -> str:
    """The changes as bytes, frame by frame: a folder, and a video where a writer is installed."""
    out = f"{out_dir}/{session_of(path)}_deltaf"
    fr.to_bytes(change_frames(spark, path)).write.mode("overwrite").parquet(out)
    try:
        writers.video(spark.read.parquet(out), out + ".mp4")
    except ImportError:
        return out
    return out + ".mp4"


def export_timestamps(spark: SparkSession, path: str, out_dir: str) -> str:
    out = f"{out_dir}/{session_of(path)}_timestamps"
    writers.timestamps_text(change_times(spark, path), out)
    return out


def grey_png(path: str, image: np.ndarray, low: float, high: float) -> None:
    """An image of one channel, low black and high white."""
    scaled = np.clip((np.asarray(image, dtype=float) - low) / (high - low if high > low else 1.0) * 255, 0, 255).astype(np.uint8)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in scaled)
    with open(path, "wb") as file:
        file.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", scaled.shape[1], scaled.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b""))


def sample(spark: SparkSession, path: str, out_dir: str, index: int = 0, crop: int = 0, vmin: float = 0, vmax: float = 255, key: str = "frames") -> str:
    """One frame as a PNG on the driver."""
    row = fr.crop(spark.read.parquet(f"{path}/{key}").where(F.col("frame_idx") == index), crop).first()
    if row is None:
        raise ValueError(f"no frame {index} in {path}/{key}")
    out = f"{out_dir}/{session_of(path)}_sample-{index}.png"
    grey_png(out, np.array(row["pixels"]).reshape(row["height"], row["width"]), vmin, vmax)
    return out


def inspect(spark: SparkSession, path: str, level: str = "meta-only") -> str:
    """What a folder says of itself, and how far it has come; a level that names a step says so if it is missing."""
    found, name = attributes(spark, path), path.rstrip("/")
    base = name.removesuffix("_preprocessed").removesuffix("_registered")
    steps = {"acquisition": (f"{base}/frames", "acquisition data"), "deltaf": (f"{base}_preprocessed/change", "changes"), "registered": (f"{base}_registered/registered", "registered frames")}
    steps |= {k: (f"{name}/{w.rsplit('/', 1)[1]}", what) for k, (w, what) in steps.items() if not path_exists(spark, w)}
    there = {k: path_exists(spark, where) for k, (where, _) in steps.items()}
    shown = [("File identifier", found.get("identifier", session_of(path))), ("Session date", str(found.get("session_start", "Unknown"))[:10]), ("Session description", found.get("session_description", "Unknown"))]
    shown += [("Experimenter", f"{found.get('experimenter', 'Unknown')} ({found.get('lab', 'Unknown')}, {found.get('institution', 'Unknown')})")]
    shown += [(f"Subject {k}", found.get(f, "Unknown")) for k, f in (("ID", "subject_id"), ("DOB", "dob"), ("sex", "sex"), ("species", "species"), ("strain", "strain"), ("genotype", "genotype"))]
    lines = [f"Metadata for {path}", *(f"{k}: {v}" for k, v in shown), *(f"{what}: {'there' if there[k] else 'not there'}" for k, (_, what) in steps.items())]
    if level != "meta-only":
        if level not in steps:
            raise ValueError(f"no such level: {level}")
        where, what = steps[level]
        lines.append(f"{what}: {spark.read.parquet(where).count()} rows" if there[level] else f"No {what} found!")
    return "\n".join(lines)


def write_report(spark: SparkSession, path: str, out_dir: str) -> str:
    """A page on a preprocessed or registered folder."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    wanted = {"_preprocessed": ("attributes", "channel_means", "change_means", *(t for t, _, _ in CHECKS)), "_registered": ("attributes", "landmarks")}
    for step, tables in wanted.items():
        if name.endswith(step):
            found = {t: spark.read.parquet(f"{path}/{t}") for t in dict.fromkeys(tables) if path_exists(spark, f"{path}/{t}")}
            out = f"{out_dir}/{name}_report.html"
            report(name, found, out)
            return out
    raise ValueError("a report takes a folder that ends with _preprocessed or _registered")
