"""What the operators share: column picking, shared-folder tables, ASCII lower-casing."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import BATCH as BATCH
from ..session import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(df: DataFrame, name: str) -> int | None:
    """Place of a column: an exact match goes before one that differs in case."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    return at[0] if at else None


def plain(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, …, so that no name of the input clashes with one of ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is null. Other columns, whatever they are called, never reach the operator."""
    rows, at = plain(df), {n: position(df, n) for n in names}
    return rows.select(*[(F.lit(None).cast("string") if at[n] is None else rows[f"c{at[n]}"]).alias(n) for n in names])


#: Rows of an Arrow batch that are Python objects at a time.
ROWS = 1024


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, ROWS):
        yield batch.slice(i, ROWS)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with all their columns, less the rows whose doc_id and text hash are in gone (_gone, raw)."""
    rows = plain(docs)
    key, text = rows[f"c{position(docs, 'doc_id')}"], rows[f"c{position(docs, 'text')}"]
    return rows.join(gone, (key == F.col("_gone")) & (F.xxhash64(text) == F.col("raw")), "left_anti").toDF(*docs.columns)


def filtered(docs: DataFrame, keep) -> DataFrame:
    """docs, with all their columns, where keep(list of texts) -> booleans holds. Nothing is shuffled."""
    at = position(docs, "text")
    rows = plain(docs)

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                yield some.filter(pa.array(keep([t or "" for t in some.column(at).to_pylist()]), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set a temporary one in local mode, as in tests, and an error on a cluster."""
    bounded_batches(spark)
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


#: Drops a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    The shuffle files that made it have no use once it is written, so they are dropped at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; Spark deletes the files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() does just that on pure ASCII and is far faster than translate()."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def in_groups(texts: list[str], most: int):
    """Consecutive texts of about `most` characters together; a longer one is on its own."""
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > most:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t)
    if group:
        yield group


def ranked_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank (from 0, gapless, in the given order) and total.

    The rows are dealt out by range and sorted, and a row's rank is its place in its partition plus the sizes of those
    before. Only those sizes, one for each partition, meet in one task and are broadcast; identical rows rank in any order.
    """
    ranged = written(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("total"))
    joined = placed.join(F.broadcast(parts), F.shiftright(placed["_at"], 33) == parts["_part"])
    return joined.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_n", "_before")
