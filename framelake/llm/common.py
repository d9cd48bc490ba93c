"""What the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but blank and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; only where a local session names none (tests) one is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="framelake-checkpoint-")
            sc.setCheckpointDir(named)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that survive the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Ask for a collection of the driver's garbage: only with it go the shuffle files of plans that are done. What a first one lets go of, a second one finds."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more; shuffle files of what led to it go when the driver's garbage does, which is asked for."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.nodeName().startswith(("LogicalRDD", "Scan ExistingRDD", "ExistingRDD")) else None
    if file is not None and file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    tidy(spark)


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches, rows: int = 512):
    """Record batches in smaller pieces, so that what a piece needs in memory stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, with the types the operators expect."""
    kinds = {"doc_id": "bigint", "text": "string", "source": "string"}
    return docs.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in names])


def boxed(docs: DataFrame, **made: Column) -> DataFrame:
    """The caller's whole rows in one column, ``row``, beside columns of our own: no names of theirs can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in made.items()])


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The caller's columns again, some of them changed."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def reach_workers(spark: SparkSession) -> None:
    """Python workers that start from now on can import this package, wherever the session was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
