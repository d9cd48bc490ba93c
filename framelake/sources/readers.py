"""What comes in. Large things are read by Spark; files of a few rows (landmarks, metadata, regressors) are read from its binary source, so that any store will do."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's landmarks, as name, x, y.
TEMPLATE_LANDMARKS = (
    ("bregma", 71, 60),
    ("cFP", 71, 19),
    ("lFP", 51, 19),
    ("rFP", 90, 19),
    ("lPB", 30, 35),
    ("rPB", 111, 35),
    ("lpRSP", 60, 115),
    ("rpRSP", 81, 115),
    ("aIPB", 71, 102),
)

# Metadata fields and what they are where nothing is given.
DEFAULT_METADATA = {
    "subject_id": "unknown",
    "sex": "Unknown",
    "genotype": "Unknown",
    "species": "Unknown",
    "strain": "Unknown",
    "dob": "1900-01-01",
    "session_description": "No description",
    "experimenter": "Unknown",
    "lab": "Unknown",
    "institution": "Unknown",
}


def content(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def recording(spark: SparkSession, path: str) -> DataFrame:
    """A table of frames, or of changes; only the columns that are used later are read."""
    return spark.read.parquet(path)


def template_landmarks() -> dict[str, tuple[float, float]]:
    return {name: (float(x), float(y)) for name, x, y in TEMPLATE_LANDMARKS}


def landmarks(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """name -> (x, y) in the file's order, from ``.csv`` (landmark, x, y) or ``.points`` (XML); nothing else is known."""
    if path.endswith(".csv"):
        text = content(spark, path).decode("utf-8-sig")
        head, *rows = [line.split(",") for line in text.splitlines() if line.strip()]
        at = {name.strip(): i for i, name in enumerate(head)}
        return {r[at["landmark"]].strip(): (float(r[at["x"]]), float(r[at["y"]])) for r in rows}
    if path.endswith(".points"):
        found = ET.fromstring(content(spark, path)).iter("pointworld")
        return {p.get("name"): (float(p.get("x")), float(p.get("y"))) for p in found if p.get("x") is not None}
    raise ValueError(f"neither .csv nor .points: {path}")


def landmark_table(spark: SparkSession, points: dict[str, tuple[float, float]], set_id: str = "") -> DataFrame:
    rows = [(set_id, i, name, float(x), float(y)) for i, (name, (x, y)) in enumerate(points.items())]
    return spark.createDataFrame(rows, "set_id string, ord int, landmark string, x double, y double")


def regressors(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], DataFrame | None]:
    """regressors (sample_idx, values), labels, and trials (sample_idx, frame_idx) or None; from ``.npz`` or a Parquet table with those columns."""
    if path.endswith(".npz"):
        with np.load(io.BytesIO(content(spark, path)), allow_pickle=False) as file:
            table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.atleast_2d(file["regressors"]))], "sample_idx bigint, values array<double>")
            labels = [str(x) for x in file["labels"]] if "labels" in file else []
            trials = file["trial_idx"] if "trial_idx" in file else None
            if trials is None or np.ndim(trials) == 0:
                return table, labels, None
            return table, labels, spark.createDataFrame([(i, int(f)) for i, f in enumerate(trials)], "sample_idx bigint, frame_idx bigint")
    if path.endswith(".parquet"):
        table = spark.read.parquet(path)
        trials = table.select("sample_idx", "frame_idx") if "frame_idx" in table.columns else None
        return table.select("sample_idx", "values"), [], trials
    raise ValueError(f"neither .npz nor .parquet: {path}")


def metadata(spark: SparkSession, path: str | None = None, **given: str | None) -> dict[str, str]:
    """The ten fields: what is given, else what the file (``.json``, ``.yaml``) has, else the defaults; unknown fields are an error."""
    found: dict = {}
    if path:
        text = content(spark, path).decode()
        if path.endswith(".json"):
            found = json.loads(text)
        elif path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text) or {}
        else:
            raise ValueError(f"neither .json nor .yaml: {path}")
    if unknown := sorted({*found, *given} - set(DEFAULT_METADATA)):
        raise ValueError(f"unknown fields: {unknown}")
    return {k: str(given.get(k) or found.get(k) or v) for k, v in DEFAULT_METADATA.items()}


def timestamps(spark: SparkSession, path: str, column: int = 0, delimiter: str = ",", header: bool = False) -> DataFrame:
    """frame_idx, ts_raw from one column of delimited text, in the file's order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    rows = rows.where((F.length("line") > 0) & (F.col("n") >= int(header)))
    escaped = delimiter if delimiter.isalnum() else f"[{delimiter}]" if delimiter not in ("\t", " ") else delimiter
    return rows.select((F.col("n") - int(header)).cast("bigint").alias("frame_idx"), F.trim(F.get(F.split("line", escaped), F.lit(column or 0))).alias("ts_raw"))


def synthetic_times(spark: SparkSession, frames: int, start: str, rate: float = 50.0) -> DataFrame:
    """frame_idx, ts_raw at an even rate from a start."""
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("id") * (1_000_000 / rate)).cast("bigint")
    return spark.range(frames).select(F.col("id").alias("frame_idx"), F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts_raw"))


def region_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id, acronym, name, ord (the order of the rows) from text whose columns are parted by comma and blank."""
    return spark.read.csv(path, sep=", ", header=True, schema="id int, acronym string, name string").withColumn("ord", F.monotonically_increasing_id())


def foreign(spark: SparkSession, path: str) -> DataFrame:
    """Frames from an HDF5 or NWB file, where h5py is installed: a task per range of frames, each of which opens the file itself."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 and NWB files takes h5py; convert them to Parquet elsewhere") from e
    name = "acquisition/DualChannelImagingSeries/data" if path.endswith(".nwb") else "frames"
    with h5py.File(path, "r") as file:
        n, height, width = file[name].shape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            with h5py.File(path, "r") as file:
                for i in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pylist([{"session_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "frame_idx": i, "height": height, "width": width, "pixels": file[name][i].reshape(-1).astype(float).tolist()}])

    return spark.range(n, numPartitions=max(1, n // 500)).mapInArrow(run, "session_id string, frame_idx bigint, height int, width int, pixels array<double>")
