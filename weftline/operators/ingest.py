"""Resumable ingestion: completed and failed files, idempotent appends, the gate before publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCANNED, FAILED = "__scan_marker__", "__error_marker__"


def completed_files(cache: DataFrame, retry_errors: bool = True, file: str = "file") -> DataFrame:
    """Files in the cache; with ``retry_errors`` rows that mark an error do not count."""
    flag = F.coalesce("_flag", F.lit(""))
    return cache.where(flag != FAILED if retry_errors else F.lit(True)).select(file).distinct()


def failed_files(cache: DataFrame, file: str = "file") -> DataFrame:
    """Files with an error that never completed."""
    failed = cache.where(F.col("_flag") == FAILED).select(file).distinct()
    return failed.join(completed_files(cache, True, file), file, "left_anti")


def open_files(expected: DataFrame, cache: DataFrame, retry_errors: bool = True, file: str = "file") -> DataFrame:
    return expected.select(file).distinct().join(completed_files(cache, retry_errors, file), file, "left_anti")


def appended(cache: DataFrame, rows: DataFrame, retry_errors: bool = True, file: str = "file") -> DataFrame:
    """The cache with the rows of files that were not complete before."""
    fresh = rows.join(completed_files(cache, retry_errors, file), file, "left_anti")
    return cache.unionByName(fresh, allowMissingColumns=True)


def may_publish(expected: DataFrame, cache: DataFrame, file: str = "file") -> bool:
    """Whether every expected file was tried."""
    return expected.select(file).join(cache.select(file), file, "left_anti").isEmpty()


def flush_due(pending: int, waited: float, most: int = 10_000, longest: float | None = 900.0) -> bool:
    """Whether what has been gathered should be written: rows enough, or waiting long enough."""
    return pending > 0 and (pending >= most or (longest is not None and waited >= longest))


def data_rows(cache: DataFrame) -> DataFrame:
    return cache.where("_flag IS NULL").drop("_flag", "_error")


def error_rows(cache: DataFrame, columns: Sequence[str] = ("project", "file", "_error")) -> DataFrame:
    keep = [c for c in columns if c in cache.columns]
    return cache.where(F.col("_flag") == FAILED).select(*keep).distinct()
