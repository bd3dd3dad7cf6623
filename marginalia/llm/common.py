"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only for a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, like: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{like}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_dealt(df: DataFrame, key: str, parts: int, like: str = "stage") -> DataFrame:
    """``stage`` with the rows of each file dealt by ``key``: a join on it in ``parts`` partitions does not move them."""
    name = f"{like}_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(name)
    return df.sparkSession.table(name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, U64))


def word_hashes(data: bytes, is_space: np.ndarray) -> np.ndarray:
    """64-bit hash of every maximal run of bytes outside ``is_space``, A-Z lower-cased."""
    global _POWERS
    a = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~is_space[a]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    at = np.flatnonzero(inside)
    within = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    most = int(length.max())
    if most > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * most, 0x9E3779B97F4A7C15 | 1, U64))
    value = mix(a[at].astype(U64) + U64(1)) * _POWERS[within]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(U64))
