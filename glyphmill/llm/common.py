"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; make a folder only on a local master without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so that losing an executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The frame as a Parquet table in a shared folder: lineage ends there, and only the columns that are used are read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, each query's shuffle files go when it ends; what is written is all that is read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0..cn and the place of each name (exact spelling first, first of repeats)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    where: dict[str, str] = {}
    for name, c in zip(df.columns, names):
        where.setdefault(name, c)
    for name, c in zip(df.columns, names):
        where.setdefault(name.lower(), c)
    return df.toDF(*names), where


def pick(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, whatever else the frame carries, also under names that differ in case only."""
    flat, where = positional(df)
    return flat.select(*[F.col(where[w]).alias(w) for w in wanted])


def keep_rows(df: DataFrame, needed: Sequence[str], condition) -> DataFrame:
    """Rows for which condition(columns of needed) holds, all columns as they were."""
    flat, where = positional(df)
    kept = flat.filter(condition(*[F.col(where[n]) for n in needed]))
    return kept.toDF(*df.columns)


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11)).cast("double") / F.lit(float(1 << 53))


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def slices_by_size(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose total length stays below limit (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
