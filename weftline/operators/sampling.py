"""Sample sizes, allocations and seeded samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import tags
from weftline.operators.relational import ORD, keep_first, union_all

# Z of the supported confidence levels.
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def sample_size(population: int, confidence: float = 0.95, margin: float = 0.05, share: float = 0.5) -> int:
    """Cochran's size with the finite correction, rounded up."""
    if population <= 0:
        return 0
    if confidence not in Z:
        raise ValueError(f"confidence must be one of {sorted(Z)}")
    infinite = Z[confidence] ** 2 * share * (1 - share) / margin**2
    return min(population, math.ceil(infinite / (1 + (infinite - 1) / population)))


def sample_size_column(population: Column, confidence: float = 0.95, margin: float = 0.05, share: float = 0.5) -> Column:
    infinite = Z[confidence] ** 2 * share * (1 - share) / margin**2
    size = F.ceil(F.lit(infinite) / (1 + F.lit(infinite - 1) / population)).cast("long")
    return F.when(population > 0, F.least(size, population)).otherwise(F.lit(0).cast("long"))


def draw(seed: int, *keys: str) -> Column:
    """The place of a key in a seeded draw: a digest of seed and key, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def seeded_sample(df: DataFrame, keys: Sequence[str], n: Column | int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """n rows of each group, by the order of a seeded digest of the key: the same for any partitioning."""
    place = [draw(seed, *keys), *[F.col(k) for k in keys]]
    if not by and isinstance(n, int):  # a top-n of all rows: each task keeps its own n first
        return df.orderBy(*place).limit(n)
    order = Window.partitionBy(*by).orderBy(*place)
    ranked = df.withColumn("__rank", F.row_number().over(order))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def sample_with_reuse(available: DataFrame, existing: DataFrame, target: int, seed: int, key: str = "from_url") -> DataFrame:
    """Existing keys that are still available, topped up from the others to ``target``."""
    reused = available.join(existing.select(key).distinct(), key, "left_semi").select(key)
    missing = max(0, target - reused.count())
    fresh = seeded_sample(available.join(existing.select(key), key, "left_anti").select(key), [key], missing, seed)
    return reused.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def sampled_flags(df: DataFrame, picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sampled: "1" or "0"."""
    marks = picked.select(*keys).distinct().withColumn("__hit", F.lit("1"))
    return df.drop("sampled").join(marks, list(keys), "left").withColumn("sampled", F.coalesce("__hit", F.lit("0"))).drop("__hit")


def slot_numbers(existing: Sequence[int], required: int, least: int = 1001) -> list[int]:
    """Free numbers: gaps within the existing ones first, then outwards nearest to their mean."""
    taken = set(existing)
    if not taken:
        return list(range(least, least + required))
    low, high = min(taken), max(taken)
    out = [n for n in range(low, high + 1) if n not in taken][:required]
    mean = sum(taken) / len(taken)
    while len(out) < required:
        down, up = low - 1, high + 1
        if down >= least and mean - down < up - mean:
            out.append(down)
            low = down
        else:
            out.append(up)
            high = up
    return out


def rare_histories(histories: DataFrame, least: int, commits: str = "commits") -> tuple[DataFrame, DataFrame]:
    """Histories with at least ``least`` commits, and the others."""
    enough = F.coalesce(F.size(commits), F.lit(0)) >= least
    return histories.where(enough), histories.where(~enough)


def test_pool(edges: DataFrame, methods: DataFrame, exclude: str | None = None) -> DataFrame:
    """Test cases that call anything, in the order of their first call, without those whose artifact
    matches ``exclude``: from_url, artifact, ordinal. methods: url, artifact."""
    first = edges.groupBy("from_url").agg(F.min(ORD).alias(ORD))
    known = methods.select(F.col("url").alias("from_url"), "artifact").dropDuplicates(["from_url"])
    rows = first.join(known.where(tags.has_tag(F.col("artifact"), "test-case-method")), "from_url")
    return rows if not exclude else rows.where(~F.rlike("artifact", F.lit(exclude)))


def barred(existing: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """The list of barred methods with ``rows`` added; the last row of each key counts."""
    both = union_all([existing.withColumn("__source", F.lit(0)), rows.withColumn("__source", F.lit(1))])
    return keep_first(both, [key], [F.desc("__source"), F.desc(ORD)]).drop("__source")


def missing_methods(required: DataFrame, existing: DataFrame, barred: DataFrame, seed: int, key: str = "url") -> DataFrame:
    """Per project a seeded pick of required - existing methods, without known or barred ones.

    required: project, url, required (how many the project should have).
    """
    counts = existing.groupBy("project").agg(F.count(F.lit(1)).alias("__have"))
    open_rows = required.join(existing.select(key), key, "left_anti").join(barred.select(key), key, "left_anti")
    rows = open_rows.join(counts, "project", "left").na.fill(0, ["__have"])
    picked = seeded_sample(rows, [key], F.col("required") - F.col("__have"), seed, ["project"])
    return picked.drop("__have")
