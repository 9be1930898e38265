"""Rater agreement and ground-truth statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators.evaluation import PAIR
from weftline.operators.relational import compare_full, keep_first


def kappa_of(both1: Column, left1: Column, right1: Column, n: Column) -> Column:
    """Cohen's kappa of two binary raters: rows both marked, each marked, and all rows."""
    n = n.cast("double")
    observed = (n - left1 - right1 + 2 * both1) / n
    expected = (left1 / n) * (right1 / n) + (1 - left1 / n) * (1 - right1 / n)
    return F.when(n > 0, F.when(expected == 1, F.when(observed == 1, 1.0)).otherwise((observed - expected) / (1 - expected)))


def cohen_kappa(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """n and kappa over rows that both raters labelled 0 or 1."""
    a, b = text.number(F.col(left).cast("string")), text.number(F.col(right).cast("string"))
    rows = df.select(*by, a.alias("__a"), b.alias("__b")).where("__a IN (0, 1) AND __b IN (0, 1)")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("__a") == 1) & (F.col("__b") == 1)).alias("__both"),
        F.count_if(F.col("__a") == 1).alias("__l"), F.count_if(F.col("__b") == 1).alias("__r"),
    )
    return sums.select(*by, "n", kappa_of(F.col("__both"), F.col("__l"), F.col("__r"), F.col("n")).alias("kappa"))


def checked_labels(truth: DataFrame) -> DataFrame:
    """The first row of every pair; a pair with different labels is an error."""
    first = F.min("label").over(Window.partitionBy(*PAIR))
    last = F.max("label").over(Window.partitionBy(*PAIR))
    fine = F.when(first == last, F.col("label")).otherwise(
        F.raise_error(F.concat(F.lit("different labels for "), F.col("from_url"), F.lit(" -> "), F.col("to_url")))
    )
    return keep_first(truth.withColumn("label", fine), PAIR)


def disagreement_reason(side: Column, left: Column, right: Column) -> Column:
    valid = left.isin(0.0, 1.0) & right.isin(0.0, 1.0)
    return (
        F.when(side == "right_only", "only_right").when(side == "left_only", "only_left")
        .when(~F.coalesce(valid, F.lit(False)), "unlabeled_or_invalid").when(left != right, "label_mismatch")
    )


def compare_labels(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("project", *PAIR)) -> DataFrame:
    """Both labels of every pair with its side and, where they differ, the reason."""
    rows = compare_full(left, right, keys, "label")
    a, b = (text.number(F.col(f"label_{s}").cast("string")) for s in ("left", "right"))
    return rows.withColumns({"label_left": a, "label_right": b}).withColumn(
        "reason", disagreement_reason(F.col("side"), F.col("label_left"), F.col("label_right"))
    )


def agreement_summary(compared: DataFrame, by: str = "project") -> DataFrame:
    """Counts, agreement and kappa by project and over all (``total``), recomputed from pooled counts."""
    valid = (F.col("side") == "both") & F.col("label_left").isin(0.0, 1.0) & F.col("label_right").isin(0.0, 1.0)
    valid = F.coalesce(valid, F.lit(False))
    one = lambda c: F.col(c) == 1
    sums = compared.groupingSets([[by], []], by).agg(
        F.grouping(by).alias("__all"),
        F.count_if(F.col("side") == "both").alias("both"), F.count_if(F.col("side") == "left_only").alias("only_left"),
        F.count_if(F.col("side") == "right_only").alias("only_right"), F.count_if(valid).alias("labelled"),
        F.count_if(valid & (F.col("label_left") == F.col("label_right"))).alias("agreed"),
        F.count_if(valid & one("label_left") & one("label_right")).alias("__both1"),
        F.count_if(valid & one("label_left")).alias("__left1"), F.count_if(valid & one("label_right")).alias("__right1"),
    )
    return sums.select(
        F.when(F.col("__all") == 1, "total").otherwise(F.col(by)).alias(by),
        "both", "only_left", "only_right", "labelled", "agreed",
        text.percent(F.col("agreed"), F.col("labelled")).alias("agreement"),
        kappa_of(F.col("__both1"), F.col("__left1"), F.col("__right1"), F.col("labelled")).alias("kappa"),
    )


def truth_statistics(truth: DataFrame, excluded: Sequence[str] = (), by: Sequence[str] = ("project",)) -> DataFrame:
    """tests, candidate pairs, median pairs of a test (0 included), positive links."""
    tags = F.split(text.blank(F.col("tags")), r"\s+")
    barred = F.arrays_overlap(tags, F.array(*[F.lit(e) for e in excluded])) if excluded else F.lit(False)
    fine = (text.number(F.col("candidate").cast("string")) == 1) & ~barred
    rows = truth.withColumn("__ok", F.coalesce(fine, F.lit(False)))
    hit = F.col("__ok") & (text.number(F.col("label").cast("string")) == 1)
    pair = F.when(F.col("__ok"), F.col("to_url"))
    a_test = rows.groupBy(*by, "from_url").agg(
        F.count_distinct(pair).alias("__n"), F.count_distinct(F.when(hit, F.col("to_url"))).alias("__pos")
    )
    return a_test.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tests"), F.sum("__n").alias("pairs"), F.median("__n").alias("median_pairs"),
        F.sum("__pos").alias("positive_links"),
    )
