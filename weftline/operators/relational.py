"""Keyed building blocks: ordered de-duplication, prefixed attaches, lookups, set operations.

Row order is data: every base relation carries an ordinal (``_ord``), and "first" or "last" always
mean by it, never by the physical order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_lineage

ORD = "_ord"


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """All columns renamed with ``prefix``, but for those in ``keep``."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = (ORD,)) -> DataFrame:
    """The first row of every key by ``order``."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).where("__rank = 1").drop("__rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: str = ORD) -> DataFrame:
    return keep_first(df, keys, [F.desc(order)])


#: Rows up to which a side is counted and then broadcast.
FEW = 100_000


def join_few(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` joined to a side that is usually short.  It is counted: up to FEW rows are broadcast, so that
    few keys do not gather all rows of ``df`` in few tasks; more are shuffled."""
    few = right.limit(FEW + 1).count() <= FEW
    return df.join(F.broadcast(right) if few else right, list(keys), how)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    return union_all(frames).dropDuplicates()


def attach_both(links: DataFrame, attributes: DataFrame, key: str = "url") -> DataFrame:
    """``attributes`` of both ends: inner joins on from_<key> and to_<key>."""
    from_side, to_side = prefixed(attributes, "from_"), prefixed(attributes, "to_")
    return links.join(from_side, f"from_{key}").join(to_side, f"to_{key}")


def attach_revisions(links: DataFrame, history: DataFrame, changes: Sequence[str], tool: str) -> DataFrame:
    """Change counts of both ends, from_ and to_ side by side, with the tool's name."""
    found = attach_both(links, history.select("url", *changes))
    pairs = [f"{side}_{c}" for c in changes for side in ("from", "to")]
    rest = [c for c in links.columns if c not in pairs]
    return found.select(*rest, F.lit(tool).alias("tool"), *pairs)


def attach_unique(df: DataFrame, right: DataFrame, keys: Sequence[str], order: str = ORD) -> DataFrame:
    """Inner join with the first row of ``right`` for every key."""
    return df.join(keep_first(right, keys, [order]).drop(order), list(keys))


def attach_code(df: DataFrame, code: DataFrame, keys: Sequence[str] = ("project", "url")) -> DataFrame:
    """Left join with method code; rows without code go."""
    first = keep_first(code.select(*keys, "code", ORD), keys).drop(ORD)
    return df.join(first, list(keys), "left").where(F.coalesce(F.col("code"), F.lit("")) != "")


def lookup(df: DataFrame, right: DataFrame, keys: Sequence[str], value: str, default=None, last: bool = False) -> DataFrame:
    """``value`` of the first (or last) matching row; ``default`` where there is none."""
    picked = (keep_last if last else keep_first)(right.select(*keys, value, ORD), keys).drop(ORD)
    found = df.join(picked.withColumnRenamed(value, "__value"), list(keys), "left")
    filled = F.col("__value") if default is None else F.coalesce("__value", F.lit(default))
    return found.drop(value).withColumn(value, filled).drop("__value")


def prediction_columns(df: DataFrame, predictions: DataFrame | None, column: str) -> DataFrame:
    """A technique's 0/1 prediction for (from_url, to_url); null where the pair or the file is missing."""
    if predictions is None:
        return df.withColumn(column, F.lit(None).cast("long"))
    missing = {"from_url", "to_url", column} - set(predictions.columns)
    if missing:
        raise ValueError(f"predictions lack columns: {', '.join(sorted(missing))}")
    return lookup(df, predictions, ["from_url", "to_url"], column, last=True)


def is_member(df: DataFrame, right: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """0/1 column ``name``: whether the key exists on the right."""
    marks = right.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce("__hit", F.lit(0))).drop("__hit")


def compare_full(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of two keyed values with side: left_only, right_only or both."""
    a = left.select(*keys, F.col(value).alias(f"{value}_left"), F.lit(1).alias("__l"))
    b = right.select(*keys, F.col(value).alias(f"{value}_right"), F.lit(1).alias("__r"))
    side = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
    return a.join(b, list(keys), "full").withColumn("side", side).drop("__l", "__r")


def carry_values(df: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values of ``old`` win for matching keys (its last row counts); others keep their own."""
    picked = keep_last(old.select(*keys, *columns, ORD), keys).drop(ORD)
    marked = picked.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in columns], F.lit(True).alias("__has"))
    found = df.join(marked, list(keys), "left")
    taken = {c: F.when(F.col("__has"), F.col(f"__old_{c}")).otherwise(F.col(c)) for c in columns}
    return found.withColumns(taken).select(df.columns)


def append_missing(df: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``more`` whose key is new come after those of ``df``."""
    return union_all([df, more.join(df.select(*keys), list(keys), "left_anti")])


def append_after_group(df: DataFrame, more: DataFrame, keys: Sequence[str], group: str, order: str = ORD) -> DataFrame:
    """As ``append_missing``, but new rows stand after the last row of their group; ``order`` is renumbered.

    New rows of groups that are not there yet come last.
    """
    fresh = more.join(df.select(*keys), list(keys), "left_anti")
    ends = df.groupBy(group).agg(F.max(order).alias("__end"))
    placed = fresh.join(ends, group, "left").withColumn("__source", F.lit(1))
    own = df.withColumn("__end", F.col(order)).withColumn("__source", F.lit(0))
    return renumbered(union_all([own, placed]), [F.col("__end").asc_nulls_last(), F.col("__source").asc(), F.col(order).asc()], order).drop(
        "__end", "__source"
    )


def renumbered(df: DataFrame, sort: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: places from 0 in the order of ``sort``, by ranges rather than in one task.

    What each partition holds is counted, one row a partition, and the counts before it are added.
    """
    placed = cut_lineage(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__row", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__row", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = placed.join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__base") + F.col("__row") - F.col("__first")).drop("__row", "__part", "__first", "__base")


def running_total(df: DataFrame, sort: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to each row in the order of ``sort``, by ranges.

    As ``renumbered``: what each partition holds is summed up, one row a partition, and the sums
    before it are added.
    """
    placed = cut_lineage(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__row", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__row", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("__within", F.sum(value).over(within)).join(F.broadcast(sums), "__part")
    return summed.withColumn(name, F.col("__base") + F.col("__within")).drop("__row", "__part", "__within", "__base")


def signature_urls(df: DataFrame, methods: DataFrame, signature: str, url: str) -> DataFrame:
    """Fills blank URLs where exactly one method has the signature."""
    single = methods.groupBy(F.col("fqs").alias(signature)).agg(F.min("url").alias("__url"), F.count(F.lit(1)).alias("__n"))
    found = df.join(single.where("__n = 1").drop("__n"), signature, "left")
    empty = F.coalesce(F.col(url), F.lit("")) == ""
    return found.withColumn(url, F.when(empty, F.coalesce("__url", F.lit(""))).otherwise(F.col(url))).drop("__url")


def first_source(frames: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Rows of the first source that has any for a key, with the source's name."""
    tagged = union_all([df.withColumn("source", F.lit(n)).withColumn("__rank", F.lit(k)) for k, (n, df) in enumerate(frames)])
    best = F.min("__rank").over(Window.partitionBy(*keys))
    return tagged.withColumn("__best", best).where("__rank = __best").drop("__rank", "__best")


def join_lower(df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a name whatever its case; the right side must have each name once."""
    folded = right.withColumnRenamed(key, "__name").withColumn("__key", F.lower("__name")).drop("__name")
    return df.withColumn("__key", F.lower(F.col(key))).join(folded, "__key", "left").drop("__key")


def group_ranges(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive integers: first, last and size of each."""
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return (
        df.select(*by, value).distinct().withColumn("__island", island).groupBy(*by, "__island")
        .agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("size"))
        .drop("__island")
    )


def ecdf(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the share of rows up to each, from the histogram."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("__n").over(up_to) / F.sum("__n").over(Window.partitionBy(*by))
    return counts.withColumn("share", share).drop("__n")
