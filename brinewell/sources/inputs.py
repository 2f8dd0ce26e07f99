"""Input files: seeds, sitemaps, fetch results; and a data source that replays canned results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls
from .schemas import FETCH_RESULT


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """url, seed_class of a text file: an address a line, 'class=name' after it, '#' begins a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "(^|\\s)#.*$", "")).alias("line")).filter("line <> ''")
    parsed = lines.select(urls.normalize(F.split("line", r"\s+")[0]).alias("p"), F.nullif(F.regexp_extract("line", r"\sclass=(\S+)", 1), F.lit("")).alias("seed_class"))
    return parsed.filter("p.url is not null").select("p.url", "p.host", "seed_class")


def seed_classes(domains: DataFrame, seeds: DataFrame) -> DataFrame:
    """The domains with the class of their seeds (domain, seed_class)."""
    new = seeds.filter("seed_class is not null").groupBy(F.col("domain").alias("d")).agg(F.max("seed_class").alias("c"))
    return domains.join(new, F.col("domain") == F.col("d"), "left").withColumn("seed_class", F.coalesce("c", "seed_class")).drop("d", "c")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Fetch results from JSON lines in their fixed schema."""
    return spark.read.schema(FETCH_RESULT).json(path)


def once(results: DataFrame) -> DataFrame:
    """Each idempotency key's first result: a replay changes nothing."""
    return results.dropDuplicates(["idempotency_key"])


def error_code(status):
    """The transport error that an HTTP status of the fetch service stands for."""
    return F.when(status == 403, "FORBIDDEN").when(status == 429, "QUEUE_FULL").when(status == 426, "INCOMPATIBLE").when(status == 408, "TIMEOUT").when(status >= 500, "UNAVAILABLE").otherwise("JOB_FAILED")


class ReplayDataSource(DataSource):
    """format("replay"): rows (requested_url, outcome, http_status, text) for a JSON object {url: outcome or {…}} in option 'answers'."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "requested_url string, outcome string, http_status int, title string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _ReplayReader(json.loads(self.options.get("answers", "{}")), int(self.options.get("parts", "2")))


class _ReplayReader(DataSourceReader):
    def __init__(self, answers: dict, parts: int):
        self.answers, self.parts = sorted(answers.items()), parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition):
        for url, a in self.answers[partition.value :: self.parts]:
            a = {"outcome": a} if isinstance(a, str) else a
            yield url, a.get("outcome", "FETCHED"), a.get("http_status", 200 if a.get("outcome", "FETCHED") == "FETCHED" else None), a.get("title"), a.get("text")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplayDataSource)
