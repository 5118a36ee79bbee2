"""A session with the settings the library assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC days, ANSI arithmetic; partition counts and sizes stay the cluster's."""
    builder = SparkSession.builder.appName("packwatch")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true", **conf}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="packwatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage and outlives executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/packwatch/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
