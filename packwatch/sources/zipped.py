"""CSV members of landed ZIP archives, as a data source: a partition for each member, inflated as a stream.

Register it once with ``spark.dataSource.register(ZippedCsv)``; then
``spark.read.format("zipped_csv").schema(...).option("members", "*.csv").load(path)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _open(uri: str):
    """A seekable file of any store that Arrow opens, local paths among them."""
    from pyarrow.fs import FileSystem

    files, path = FileSystem.from_uri(uri)
    return files.open_input_file(path)


@dataclass
class Member(InputPartition):
    archive: str
    name: str


class ZippedCsv(DataSource):
    """Rows of the CSV members of an archive whose names fit the option ``members`` (all *.csv), by their headers.

    The schema names the columns that are read; one that a member lacks is null, and so
    is an empty field.  Options: members, and block (bytes
    parsed at a time).
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> "ZippedCsvReader":
        return ZippedCsvReader(schema, self.options)


class ZippedCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.archive = schema, options["path"]
        self.members, self.block = options.get("members", "*.csv"), int(options.get("block", 1 << 20))

    def partitions(self) -> list[Member]:
        from zipfile import ZipFile

        with _open(self.archive) as file, ZipFile(file) as archive:
            names = [i.filename for i in archive.infolist() if not i.is_dir() and fnmatch(i.filename.rsplit("/", 1)[-1], self.members)]
        return [Member(self.archive, n) for n in names]

    def read(self, partition: Member | None) -> Iterator:
        from zipfile import ZipFile

        import pyarrow as pa
        from pyarrow import csv

        if partition is None:  # an archive without members
            return
        schema = to_arrow_schema(self.schema)
        with _open(partition.archive) as file, ZipFile(file) as archive, archive.open(partition.name) as member:
            convert = csv.ConvertOptions(column_types=schema, include_columns=schema.names, include_missing_columns=True, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
            for batch in csv.open_csv(member, csv.ReadOptions(block_size=self.block), csv.ParseOptions(newlines_in_values=True), convert):
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in schema.names], schema=schema)
