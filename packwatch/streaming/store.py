"""Keyed tables that change batch by batch, with one version pointer for all of them.

A table is cut into parts by a hash of its key columns.  A batch rewrites only the
parts that its keys fall in, into new folders; then one manifest names the folders of
every table.  Readers follow the newest manifest, so they see all tables as of one
batch and never half of it, and a batch that is run again after its manifest was
written changes nothing.  The number of parts doubles with the rows, and a part is
split when it is next rewritten.  There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Rows of a part, on average, before parts are split.
PART_ROWS = 1_000_000


class Store:
    """Named tables below a folder that all nodes share."""

    def __init__(self, spark: SparkSession, path: str, part_rows: int = PART_ROWS):
        self.spark, self.path, self.part_rows = spark, path.rstrip("/"), part_rows

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; before the first batch an empty one."""
        if version is None:
            files, folder = self._at(f"{self.path}/manifest")
            names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
            version = max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)
        if not version:
            return {"version": 0, "batches": {}, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of the newest version or a given one; None before its first rows."""
        table = self.manifest(version)["tables"].get(name)
        return self._read(table, table["parts"]) if table else None

    def _read(self, table: dict, parts: list[dict]) -> DataFrame:
        folders = [p["folder"] for p in parts]
        return self.spark.read.schema(table["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], table["schema"])

    def begin(self, stream: str, number: int) -> "Batch | None":
        """A batch of changes; None if this number of the stream was committed before."""
        now = self.manifest()
        return None if now["batches"].get(stream, -1) >= number else Batch(self, now, stream, number)

    def changes(self, name: str, key: list[str], since: int, until: int | None = None) -> DataFrame:
        """What differs between two versions of a table: key, kind (insert, update, delete), before, after (rows, null where there is none).

        Only parts that were written in between are read.  The key, distinct in the
        table, may be other columns than those that parts go by.
        """
        old, new = (self.manifest(v)["tables"].get(name) if v != 0 else None for v in (since, until))
        table = new or old
        if table is None:
            raise ValueError(f"no table {name} in these versions")
        left, right = ([] if t is None else t["parts"] for t in (old, new))
        same = {p["folder"] for p in left} & {p["folder"] for p in right}
        row = lambda t: F.struct(*[F.col(c) for c in self._read(t, []).columns])
        before = self._read(old or table, [p for p in left if p["folder"] not in same]).select(*key, row(old or table).alias("before"))
        after = self._read(table, [p for p in right if p["folder"] not in same]).select(*key, row(table).alias("after"))
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return before.join(after, key, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(*key, kind.alias("kind"), "before", "after")

    def vacuum(self, keep: int = 1) -> None:
        """Deletes folders that none of the last ``keep`` versions reads, and older manifests."""
        last = self.manifest()["version"]
        used = {p["folder"].split("/data/")[1].split("/")[0] for v in range(max(last - keep, 0) + 1, last + 1) for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        for folder, gone in (("data", lambda n: n not in used), ("manifest", lambda n: int(n[:12]) <= last - keep)):
            files, where = self._at(f"{self.path}/{folder}")
            for f in files.listStatus(where) if files.exists(where) else []:
                if gone(f.getPath().getName()):
                    files.delete(f.getPath(), True)


class Batch:
    """Changes of one batch: reads see the version before it, writes take effect together by ``commit``."""

    def __init__(self, store: Store, before: dict, stream: str, number: int):
        self.store, self.before, self.spark = store, before, store.spark
        self.after = {"version": before["version"] + 1, "batches": {**before["batches"], stream: number}, "tables": dict(before["tables"])}

    @staticmethod
    def _part(keys: list[str], depth: int):
        return F.pmod(F.xxhash64(*keys), F.lit(1 << depth))

    def _met(self, table: dict, depth: int, touched: DataFrame) -> list[dict]:
        """Parts that rows of the touched keys may be in; at most one number for each part reaches the driver."""
        if len(table["parts"]) < 2:
            return table["parts"]
        met = {r.part for r in touched.select(self._part(table["keys"], depth).alias("part")).distinct().collect()}
        return [p for p in table["parts"] if any(k % (1 << p["depth"]) == p["part"] for k in met)]

    def rows_of(self, name: str, touched: DataFrame) -> DataFrame | None:
        """Rows of the touched keys as of the version before; only their parts are read."""
        table = self.before["tables"].get(name)
        if table is None:
            return None
        depth = max((p["depth"] for p in table["parts"]), default=0)
        rows = self.store._read(table, self._met(table, depth, touched))
        return rows.join(touched.select(*table["keys"]), table["keys"], "left_semi")

    def replace(self, name: str, keys: list[str], touched: DataFrame, rows: DataFrame) -> None:
        """From now on the rows of the touched keys are these; rows must belong to touched keys.

        Keys with a null are never touched.  A key with very many rows is written by
        several tasks.
        """
        table = self.before["tables"].get(name) or {"keys": keys, "schema": _ddl(rows), "parts": []}
        touched = touched.select(*keys)
        total = round(sum(p["rows"] for p in table["parts"]))  # what this batch adds counts from the next one on
        depth = max([p["depth"] for p in table["parts"]] + [(max(1, -(-total // self.store.part_rows)) - 1).bit_length()])
        met = self._met(table, depth, touched)
        new = rows
        if met:
            new = self.store._read(table, met).join(touched, keys, "left_anti").select(*rows.columns).unionByName(rows)
        folder, seen = f"{self.store.path}/data/{uuid.uuid4().hex}", Observation()
        new = new.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("_part", self._part(keys, depth))
        (new.hint("rebalance", "_part") if depth else new).write.partitionBy("_part").parquet(folder)  # a file or a few for each part
        files, where = self.store._at(folder)
        written = [int(n[6:]) for n in (f.getPath().getName() for f in files.listStatus(where)) if n.startswith("_part=")]
        n = seen.get["n"] if written else 0  # a plan that is known to be empty observes nothing
        parts = [p for p in table["parts"] if p not in met] + [{"depth": depth, "part": k, "folder": f"{folder}/_part={k}", "rows": n / len(written)} for k in written]
        self.after["tables"][name] = {**table, "parts": parts}

    def upsert(self, name: str, keys: list[str], rows: DataFrame, newest: list[str]) -> None:
        """Of the rows of a key, old and new, the one with the greatest ``newest`` stays, of equal ones the one of this batch."""
        rows = rows.dropna(subset=keys)
        rest = [c for c in rows.columns if c not in keys]
        now = rows.withColumn("_now", F.lit(1))
        old = self.rows_of(name, rows)
        if old is not None:
            now = now.unionByName(old.withColumn("_now", F.lit(0)))
        best = F.max(F.struct(*[F.struct(F.col(c).isNotNull().alias("has"), F.col(c).alias("value")).alias(f"_{k}") for k, c in enumerate(newest)], "_now", *rest)).alias("_r")
        self.replace(name, keys, rows, now.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))

    def commit(self) -> int:
        """Makes the changes visible: the manifest is written beside and moved to its place."""
        files, there = self.store._at(f"{self.store.path}/manifest/{self.after['version']:012d}.json")
        if files.exists(there):
            raise RuntimeError(f"version {self.after['version']} was written by another")
        beside = self.store._at(f"{self.store.path}/manifest/.{uuid.uuid4().hex}")[1]
        out = files.create(beside, True)
        out.write(bytearray(json.dumps(self.after).encode()))
        out.close()
        if not files.rename(beside, there):
            raise RuntimeError(f"version {self.after['version']} couldn't be written")
        return self.after["version"]


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
