"""Reading the corpus and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Kept:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    ``keep`` writes a frame and returns it as read back; ``drop`` deletes one that
    no later step reads.  What remains goes with the shared folder's own cleaning.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_folder(spark)}/packwatch/{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n:03d}-{name}"
        schema = frame.schema
        frame.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        if path := self.paths.pop(name, None):
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
