"""Ridge regression of every pixel's trace on a few regressors, from sums that one pass gathers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.numbers import finite
from framelake.layout import small


def _keys(table: DataFrame) -> list[str]:
    """A table for all recordings alike has no session_id."""
    return ["session_id"] if "session_id" in table.columns else []


def select_trials(frames: DataFrame, trials: DataFrame) -> DataFrame:
    """frames by (sample_idx, frame_idx), for all recordings or, with session_id, for each its own: they may repeat and change order; sample_idx is their new number."""
    return frames.join(small(trials), [*_keys(trials), "frame_idx"]).withColumn("frame_idx", F.col("sample_idx")).drop("sample_idx")


def _moments(x: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """keys, n, mean, xx (products of the centred regressors), solve (the inverse with the penalty): a row per recording, from sums that tasks gather as matrices."""
    spark, size = x.sparkSession, x.agg(F.max(F.size("__x"))).first()[0]
    if not size:
        raise ValueError("no regressors")
    mean = {r["s"]: r for r in x.groupBy((F.col("session_id") if keys else F.lit("")).alias("s")).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("__x")[i]) for i in range(size)]).alias("mean")).collect()}
    means = {s: np.array(r["mean"], dtype=float) for s, r in mean.items()}

    def run(batches):
        sums = {}
        for batch in batches:
            for s, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(s, []).append(row)
            sums = {s: [*rows] if len(rows) < 4096 else [_product(rows, means[s])] for s, rows in sums.items()}
        for s, rows in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.string()), pa.array([_product(rows, means[s]).reshape(-1).tolist()], pa.list_(pa.float64()))], names=["s", "xx"])

    total = {s: np.zeros((size, size)) for s in means}
    for r in x.select((F.col("session_id") if keys else F.lit("")).alias("s"), "__x").mapInArrow(run, "s string, xx array<double>").toLocalIterator():
        total[r["s"]] += np.array(r["xx"]).reshape(size, size)
    rows = [(s, mean[s]["n"], means[s].tolist(), xx.tolist(), np.linalg.inv(xx + alpha * np.eye(size)).tolist()) for s, xx in total.items()]
    out = spark.createDataFrame(rows, "session_id string, n bigint, __mean array<double>, __xx array<array<double>>, __solve array<array<double>>")
    return out if keys else out.drop("session_id")


def _product(rows: list, mean: np.ndarray) -> np.ndarray:
    """Sum of the products of centred rows; a matrix among them is a sum already."""
    out = sum((r for r in rows if isinstance(r, np.ndarray)), np.zeros((len(mean), len(mean))))
    flat = [r for r in rows if not isinstance(r, np.ndarray)]
    centred = np.array(flat, dtype=float).reshape(len(flat), len(mean)) - mean
    return out + centred.T @ centred


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def ridge(pixels: DataFrame, regressors: DataFrame, alpha: float = 1.0) -> DataFrame:
    """session_id, y, x, coef, r2, mse. regressors: sample_idx, values array<double>, matched to frame_idx; with session_id, each recording has its own.

    NaN counts as 0 on either side; the intercept is not penalised. Every frame of a recording has one row of regressors and the other way round, or it is an error. The
    regressors' own products (R x R for each recording) are solved on the driver; of pixels only sums travel, one row per pixel and task. A constant pixel that is
    met exactly has r2 = 1.
    """
    keys = _keys(regressors)
    x = regressors.select(*keys, F.col("sample_idx").alias("frame_idx"), F.transform("values", finite).alias("__x"))
    known = _moments(x, keys, alpha)
    size = len(known.first()["__mean"])
    means = small(known.select(*keys, F.col("n").alias("__rows"), "__mean"))
    x = x.join(means, keys) if keys else x.crossJoin(F.broadcast(means))  # one row
    x = x.select(*keys, "frame_idx", F.zip_with("__x", "__mean", lambda v, m: v - m).alias("__c"))
    joined = pixels.join(small(x), [*keys, "frame_idx"], "left").withColumn("__y", finite(F.col("value")))
    sums = [F.sum(F.col("__c")[i] * F.col("__y")) for i in range(size)]
    per = joined.groupBy("session_id", "y", "x").agg(F.count("*").alias("frames"), F.count("__c").alias("matched"), F.avg("__y").alias("m"), F.var_pop("__y").alias("v"), F.array(*sums).alias("__s"))
    per = per.join(F.broadcast(known), keys, "left") if keys else per.crossJoin(F.broadcast(known))  # a row per recording, one in all
    wrong = F.col("n").isNull() | (F.col("frames") != F.col("n")) | (F.col("matched") != F.col("n"))
    text = F.format_string("recording %s has %d frames, %d of them with regressors, and %d rows of regressors", "session_id", "frames", "matched", F.coalesce("n", F.lit(0)))
    per = per.withColumn("coef", F.when(wrong, F.raise_error(text).cast("array<double>")).otherwise(F.transform("__solve", lambda row: _dot(row, F.col("__s")))))
    per = per.withColumns({"tot": F.col("v") * F.col("frames"), "quad": _dot(F.col("coef"), F.transform("__xx", lambda row: _dot(row, F.col("coef"))))})
    per = per.withColumn("res", F.greatest(F.lit(0.0), F.col("tot") - 2 * _dot(F.col("coef"), F.col("__s")) + F.col("quad")))
    r2 = F.when(F.col("res") == 0, 1.0).when(F.col("tot") == 0, 0.0).otherwise(1 - F.col("res") / F.when(F.col("tot") != 0, F.col("tot")))
    return per.select("session_id", "y", "x", "coef", r2.alias("r2"), (F.col("res") / F.col("frames")).alias("mse"))
