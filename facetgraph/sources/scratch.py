"""Tables that a job writes to the shared folder and reads back.

A plan ends where a table is written, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="facetgraph-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to a folder of its own; it stays there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables of one job: drop() removes those whose readers have ended, leaving the block removes all.

    What outlives the block must not read them: write it with written() before.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.path}/{len(self.tables)}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in self.tables:
            if any(df is t for t in tables):
                remove(self.spark, path)
