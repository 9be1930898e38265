"""Data steps behind tables and figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators.revisions import MARKERS
from weftline.operators.smells import ANY, NONE


def filter_summary(before: DataFrame, after: DataFrame, by: str = "project") -> DataFrame:
    """Rows and distinct tests, productions and pairs before and after a filter, with an ``all`` row.

    Distinct counts of the total are counted anew, not summed.
    """
    def counts(df: DataFrame, name: str) -> DataFrame:
        pair = F.struct("from_url", "to_url")
        sums = df.groupingSets([[by], []], by).agg(
            F.grouping(by).alias("__all"), F.count(F.lit(1)).alias(f"{name}_rows"), F.count_distinct("from_url").alias(f"{name}_tests"),
            F.count_distinct("to_url").alias(f"{name}_productions"), F.count_distinct(pair).alias(f"{name}_pairs"),
        )
        return sums.select(F.when(F.col("__all") == 1, "all").otherwise(F.col(by)).alias(by), *[c for c in sums.columns if c not in (by, "__all")])

    both = counts(before, "before").join(counts(after, "after"), by, "left")
    return both.na.fill(0)


def effect_percentages(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each effect size among the rows, one decimal; sizes without rows stay."""
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(*[text.round_even(F.count_if(F.col("effect_size") == s) / n * 100.0, 1).alias(s) for s in MARKERS.values()])


def average_rows(metrics: DataFrame, datasets: Sequence[str], strategies: Sequence[str]) -> DataFrame:
    """The ``avg-`` row of every dataset and strategy, in order; a missing one is an error."""
    spark = metrics.sparkSession
    wanted = [(i, d, f"avg-{d}", s) for i, (d, s) in enumerate((d, s) for d in datasets for s in strategies)]
    order = spark.createDataFrame(wanted, "place int, dataset string, project string, strategy string")
    found = order.join(metrics, ["project", "strategy"], "left")
    key = next(c for c in metrics.columns if c not in ("project", "strategy"))
    checked = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("no average row for "), F.col("dataset"), F.lit(" / "), F.col("strategy")))
    )
    return found.withColumn(key, checked).orderBy("place").drop("place")


def above_limit(long: DataFrame, limit: float, value: str = "s", by: Sequence[str] = ("tool",)) -> DataFrame:
    return long.groupBy(*by).agg(F.count_if(F.col(value) > limit).alias("above"))


def runtime_rows(df: DataFrame) -> DataFrame:
    """(tool, s): positive seconds of every ``<tool>_runtime`` column of milliseconds."""
    columns = [c for c in df.columns if c.endswith("_runtime")]
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "tool", "ms")
    return long.select(F.regexp_replace("tool", "_runtime$", "").alias("tool"), (F.col("ms") / 1000).alias("s")).where("s > 0")


def box_values(unique: DataFrame, group: str) -> DataFrame:
    """(group, count, n): how often each number of distinct smells occurs - all that a box plot needs."""
    count = F.size(F.array_distinct(text.split_smells(F.col("smells"))))
    return unique.groupBy(F.col(group).alias("grp"), count.cast("long").alias("smell_count")).agg(F.count(F.lit(1)).alias("n"))


def five_numbers(values: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Least, quartiles (linear) and greatest value."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return values.groupBy(*by).agg(F.min(value).alias("low"), q.alias("__q"), F.max(value).alias("high")).select(
        *by, "low", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3"), "high"
    )


def smell_display_order(prevalence: DataFrame) -> DataFrame:
    """any and none first, then smells by total count, then name."""
    totals = prevalence.groupBy("smell").agg(F.sum("smell_n").alias("total"))
    first = F.when(F.col("smell") == ANY, 0).when(F.col("smell") == NONE, 1).otherwise(2)
    return totals.orderBy(first, F.desc("total"), "smell")


def comparison_pairs(table: DataFrame, preferred: tuple[str, str] = ("HTR", "NTR")) -> DataFrame:
    """Distinct (focal_group, baseline_group), the preferred pair first."""
    hit = (F.col("focal_group") == preferred[0]) & (F.col("baseline_group") == preferred[1])
    return table.select("focal_group", "baseline_group").distinct().orderBy((~hit).cast("int"), "focal_group", "baseline_group")


def effect_order(table: DataFrame, pair: tuple[str, str] = ("HTR", "NTR")) -> DataFrame:
    """Smells by the difference of one pair, smallest first."""
    hit = (F.col("focal_group") == pair[0]) & (F.col("baseline_group") == pair[1]) & ~F.col("smell").isin(ANY, NONE)
    return table.where(hit).groupBy("smell").agg(F.min("difference_pp").alias("difference_pp")).orderBy("difference_pp", "smell")


def sort_any_case(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by text keys whatever their case; names that differ in case only by code point."""
    return rows.orderBy(*[F.lower(k) for k in keys], *keys)


def projects_then_total(rows: DataFrame, total: str = "all") -> DataFrame:
    return rows.orderBy((F.col("project") == total).cast("int"), "project")


def method_index(methods: DataFrame, keys: Sequence[str] = ("file", "name")) -> DataFrame:
    """Methods (no constructors) by key, in file order."""
    rows = methods.where("expression = 'method'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_ord", "url"))), lambda x: x["url"])
    return rows.groupBy(*keys).agg(ordered.alias("urls"))


def ranked_groups(df: DataFrame, by: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
