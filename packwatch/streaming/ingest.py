"""Incremental ingest with Structured Streaming in place of cursors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import PART_ROWS, Store


#: Parts by a hash of the key into which an appended table is split.
PARTS = 64


def new_files(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files, of one or of a folder; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, which may also match a file


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str]):
    """Appends one row for each key that the target lacks, one batch at a time, until the folder is read; known keys never change.

    The target is kept in PARTS folders by a hash of the key, so a batch reads the keys
    of the parts that its own rows fall in, and no values.  ``upserts`` is the one that
    changes known rows and whose parts grow in number with the table.

    There is no watermark: rows of any age count, whatever the order of the files.  A batch that is run again writes over its own folder, so a restart adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{target}/batch={number}"
        batch = batch.dropDuplicates(keys).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")).persist()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = batch
        if files.exists(where) and any(f.isDirectory() and f.getPath().getName() != f"batch={number}" for f in files.listStatus(where)):
            met = [r.part for r in batch.select("part").distinct().collect()]  # at most PARTS numbers
            seen = spark.read.parquet(target).where((F.col("batch") != number) & F.col("part").isin(met)).select(*keys)
            rows = batch.join(seen, keys, "left_anti")
        rows.write.mode("overwrite").partitionBy("part").parquet(own)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts(stream: DataFrame, store: Store, name: str, checkpoint: str, keys: list[str], newest: list[str]):
    """Upserts a stream into a table of the store, batch by batch, until the folder is read: of the rows of a key the newest stays.

    There is no watermark: rows of any age count, whatever the order of the files.  A
    batch that is run again after a failure is known by its number and adds nothing.
    Rows with a null in a key are left out, as nothing tells whether they are the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for its keys, its parts and its rows
        changes = store.begin(name, number)
        if changes is not None:
            changes.upsert(name, keys, batch, newest)
            changes.commit()
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(spark: SparkSession, path: str, folder: str, keys: list[str], newest: str | list[str], files_per_batch: int = 100, part_rows: int = PART_ROWS) -> DataFrame:
    """Ingests a folder to its end and returns the table: the row of each key that is newest by these columns."""
    at = f"{folder}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    stream = new_files(spark, path, schema, files_per_batch).select(*[F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])
    store = Store(spark, f"{at}/store", part_rows)
    upserts(stream, store, "rows", f"{at}/checkpoint", keys, [newest] if isinstance(newest, str) else newest).awaitTermination()
    out = store.read("rows")
    return spark.createDataFrame([], stream.schema) if out is None else out
