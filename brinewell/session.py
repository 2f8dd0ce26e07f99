"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "brinewell", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


#: Bytes of an Arrow batch: what a Python worker and its task hold at a time, however long the rows are.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH, where it is above that."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH:
        spark.conf.set(key, BATCH)
