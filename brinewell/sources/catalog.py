"""Tables as immutable Parquet snapshots behind a pointer: readers see a whole set of tables, writers swap it at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES, VERSION, conform


class Catalog:
    """A folder with snapshots and a small pointer table that names the current one of each table.

    commit() writes all new snapshots first and then one pointer file, so that a failed commit leaves what was there.
    Pointers are rows (version, seq, table, snapshot); the highest seq counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("version int, seq long, name string, snapshot string").parquet(f"{self.root}/_pointers")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_pointers")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def current(self) -> dict[str, str]:
        """Snapshot by table. Pointer rows are one per table and commit."""
        if not self._exists():
            return {}
        best = self._pointers().groupBy("name").agg(F.max(F.struct("seq", "snapshot", "version")).alias("p")).collect()
        newer = [r["name"] for r in best if r["p"]["version"] > VERSION]
        if newer:
            raise ValueError(f"written by a newer schema: {newer}")
        return {r["name"]: r["p"]["snapshot"] for r in best}

    def read(self, name: str) -> DataFrame:
        """The current snapshot in the current schema; a table never written is empty."""
        at = self.current().get(name)
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.parquet(at)
        return conform(df, name) if name in TABLES else df

    def commit(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> int:
        """Writes tables and makes them current together; returns the commit's number."""
        seq = 1 + (self._pointers().agg(F.max("seq")).first()[0] or 0 if self._exists() else 0)
        rows = []
        for name, df in tables.items():
            at = f"{self.root}/{name}/{seq:08d}-{uuid.uuid4().hex[:8]}"
            writer = df.write.mode("errorifexists")
            (writer.partitionBy(partition_by[name]) if partition_by and name in partition_by else writer).parquet(at)
            rows.append((VERSION, seq, name, at))
        self.spark.createDataFrame(rows, "version int, seq long, name string, snapshot string").coalesce(1).write.mode("append").parquet(f"{self.root}/_pointers")
        return seq


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash of all rows."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def backup(catalog: Catalog, destination: str) -> dict[str, tuple[int, int]]:
    """A copy of all current tables in a new folder, checked by count and hash; an existing destination is an error."""
    made = {}
    for name in sorted(catalog.current()):
        source = catalog.read(name)
        source.write.mode("errorifexists").parquet(f"{destination.rstrip('/')}/{name}")
        copy = catalog.spark.read.schema(source.schema).parquet(f"{destination.rstrip('/')}/{name}")
        if fingerprint(copy) != (made.setdefault(name, fingerprint(source))):
            raise OSError(f"the copy of {name} differs")
    return made
