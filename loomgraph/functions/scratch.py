"""Intermediate tables in the shared folder: they cut lineage and are read again after an executor is lost."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, local sessions get a folder of their own; a cluster has to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, by: list[str] = ()) -> DataFrame:
        """``df`` written and read again; a folder for each value of the columns ``by``, so that a reader of one value reads no other."""
        path = f"{self.root}/{len(self.paths)}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        out._scratch_path = path  # for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                delete(self.spark, path)


    def clear(self) -> None:
        """Delete all tables of this folder."""
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_scope: ContextVar[Scratch | None] = ContextVar("scratch scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that operators write within this block go to one folder, which is deleted at its end: what is kept has to be collected or
    written elsewhere before."""
    scratch = Scratch(spark)
    token = _scope.set(scratch)
    try:
        yield scratch
    finally:
        _scope.reset(token)
        scratch.clear()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again; deleted with the innermost ``scratch_scope``, if there is one."""
    return (_scope.get() or Scratch(df.sparkSession)).write(df)
