"""Shared plumbing: the written tables of iterative jobs and small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import delete_path
from ..operators.tables import read as read_table  # noqa: F401
from ..operators.tables import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Give back to the system what Arrow and the C library hold unused: a Python worker
    lives on after its task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


class Shelf:
    """The written tables of one job, by name; drop() deletes those that no later
    step reads, so that a job holds no more disk than it needs."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.paths = spark, job, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = path = new_path(self.spark, f"{self.job}-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.paths.pop(name))
