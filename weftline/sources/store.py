"""Keyed stores: upserts that keep the latest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import union_all

KEY = ("url",)


def upsert_requests(store: DataFrame, requests: DataFrame, now: str, overwrite: bool = False, keys: Sequence[str] = KEY) -> DataFrame:
    """New requests join the store with error ``unknown``; known ones only if ``overwrite``: their creation time stays."""
    fresh = requests.withColumns({"updated_at": F.lit(now), "error": F.lit("unknown")})
    born = store.groupBy(*keys).agg(F.min("created_at").alias("__born"))
    fresh = fresh.join(born, list(keys), "left").withColumn("created_at", F.coalesce("__born", F.lit(now)))
    if not overwrite:
        fresh = fresh.where("__born IS NULL")
    fresh = fresh.drop("__born")
    kept = store.join(fresh.select(*keys), list(keys), "left_anti")
    return union_all([kept, fresh])


def upsert_results(store: DataFrame, results: DataFrame, now: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Raw output, JSON and error for known keys."""
    columns = ("output_raw", "output_json", "error")
    new = results.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    rows = store.join(new, list(keys), "left")
    taken = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    taken["updated_at"] = F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("updated_at"))
    return rows.withColumns(taken).select(store.columns)


def pending(cases: DataFrame, store: DataFrame, resume: str = "all", key: str = "url") -> DataFrame:
    """Cases still to run: none of the stored (``all``), all but those without error (``error``), or all (``none``)."""
    if resume == "none":
        return cases
    done = store if resume == "all" else store.where("error IS NULL OR error = ''")
    return cases.join(done.select(key), key, "left_anti")


def merge_members(archive: DataFrame, files: DataFrame, key: str = "member") -> DataFrame:
    """Members of an archive win over new files of their name."""
    return union_all([archive, files.join(archive.select(key), key, "left_anti")])


def migrate_cache(cache: DataFrame, old: DataFrame) -> DataFrame:
    """Both under one schema, each distinct row once."""
    return union_all([cache, old]).dropDuplicates()
