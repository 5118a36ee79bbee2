"""Pages of a table by key: what comes after a key is read from the files that hold it, not from all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_FILE = 1_000_000


def write_sorted(rows: DataFrame, key: str, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes rows in the order of a key, with an index of the first and last key and the number of rows of each file.

    Keys should be distinct and not null: rows with a null key are left out, as no page
    begins behind them.  Equal keys are next to each other, but a page that ends within
    them leaves the rest to no page.
    """
    rows = rows.where(F.col(key).isNotNull())
    rows.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    index = written.select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key")).groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    index.repartitionByRange("first").sortWithinPartitions("first").write.parquet(f"{path}/index")


class Pages:
    """Reads pages of a table that ``write_sorted`` wrote."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.index = spark.read.parquet(f"{path}/index")
        self.schema = spark.read.parquet(f"{path}/rows").schema

    def after(self, last, n: int) -> DataFrame:
        """The n rows next behind a key in its order (the first n for None), fewer at the end.

        Of the index, the one file the key falls in and as many more as n rows take reach
        the driver; the files after the first are opened only where the first has too
        few rows left.
        """
        behind = self.index if last is None else self.index.where(F.col("last") > F.lit(last))
        files, more = [], behind.orderBy("first")
        rows = self.spark.createDataFrame([], self.schema)
        for f in more.limit(1).collect():
            files, rows = [f.file], self._rows([f.file], last)
            missing = n - rows.limit(n).count()
            if missing > 0:  # whole files follow, whose rows are counted in the index
                rest = more.where(F.col("first") > F.lit(f["last"])).limit(missing).collect()  # each has a row at least
                for r in rest:
                    if missing > 0:
                        files.append(r.file)
                        missing -= r.n
                rows = self._rows(files, last)
        return rows.orderBy(self.key).limit(n)

    def _rows(self, files: list[str], last) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*files)
        return rows if last is None else rows.where(F.col(self.key) > F.lit(last))
