"""Registered queries: a name, a function of (spark, sf_dir), and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
          "pages", "conversations", "embeddings", "benchmark")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables, and relations shaped from them by SQL that both engines read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


def plain(text: str) -> str:
    """The same SQL for an engine that has the tables as views; doubled braces are plain ones."""
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text.replace("{{", "{").replace("}}", "}")


def query(name: str, sql: str | None = None):
    """Registers ``function(tables)`` under ``name``; ``sql`` may use the shaped relations' texts."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"a second query {name}")
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = plain(sql)
        return function

    return register
