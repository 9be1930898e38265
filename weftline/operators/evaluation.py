"""Link quality against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators.relational import ORD, join_few, keep_first, union_all

PAIR = ["from_url", "to_url"]


def positive_truth(truth: DataFrame) -> DataFrame:
    """Rows with label 1 where there is a label at all."""
    return truth.where(text.number(F.col("label")) == 1) if "label" in truth.columns else truth


def _shares(tp: Column, fp: Column, fn: Column) -> list[Column]:
    ratio = lambda a, b: text.round_even(F.try_divide(a.cast("double"), b))
    return [
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def link_metrics(predicted: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """gt_links, pred_links, tp, fp, fn, precision, recall, f1 over distinct pairs (null without a base)."""
    keys = [*by, *PAIR]
    a = predicted.select(*keys).distinct().withColumn("__p", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("__t", F.lit(1))
    both = a.join(b, keys, "full")
    p, t = F.col("__p").isNotNull(), F.col("__t").isNotNull()
    counts = both.groupBy(*by).agg(
        F.count_if(t).alias("gt_links"), F.count_if(p).alias("pred_links"), F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn"),
    )
    return counts.select("*", *_shares(F.col("tp"), F.col("fp"), F.col("fn")))


def micro_average(predicted: DataFrame, truth: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of groups of experiments over the union of their pairs; ``members``: grp, experiment.

    Pairs of different experiments and projects stay apart.
    """
    keep = ["grp", *by, "experiment", "project", *PAIR]
    pairs = (df.select(*keep[1:]).distinct() for df in (predicted, truth))
    a, b = (join_few(df, members.select("grp", "experiment").distinct(), ["experiment"]).select(*keep) for df in pairs)
    keys = keep
    both = a.withColumn("__p", F.lit(1)).join(b.withColumn("__t", F.lit(1)), keys, "full")
    p, t = F.col("__p").isNotNull(), F.col("__t").isNotNull()
    counts = both.groupBy("grp", *by).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn")
    )
    return counts.select("*", *_shares(F.col("tp"), F.col("fp"), F.col("fn")))


def mismatches(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions as TP or FP and missing truth as FN, the first row of each pair."""
    marks = truth.select(*PAIR).distinct().withColumn("__t", F.lit(1))
    seen = predicted.join(marks, PAIR, "left").withColumn("label", F.when(F.col("__t") == 1, "TP").otherwise("FP")).drop("__t")
    gone = truth.join(predicted.select(*PAIR), PAIR, "left_anti").withColumn("label", F.lit("FN"))
    rows = union_all([seen.withColumn("__side", F.lit(0)), gone.withColumn("__side", F.lit(1))])
    return keep_first(rows, PAIR, ["__side", ORD]).drop("__side")


def mean_average_precision(predicted: DataFrame, truth: DataFrame, score: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """map: mean over the truth's tests of the sum of precisions at hits over the number of true links.

    Predictions rank by score (nulls last), then ordinal; without a score by ordinal.
    """
    test = [*by, "from_url"]
    first = keep_first(predicted, [*by, *PAIR])
    marks = truth.select(*by, *PAIR).distinct()
    sizes = marks.groupBy(*test).agg(F.count(F.lit(1)).alias("__links"))
    labelled = first.join(sizes.select(*test), test, "left_semi").join(
        marks.withColumn("__hit", F.lit(1)), [*by, *PAIR], "left"
    )
    order = [F.col(score).try_cast("double").desc_nulls_last()] if score else []
    rank = Window.partitionBy(*test).orderBy(*order, ORD)
    ranked = labelled.withColumns(
        {"__rank": F.row_number().over(rank), "__hits": F.count("__hit").over(rank.rowsBetween(Window.unboundedPreceding, 0))}
    )
    sums = ranked.where("__hit = 1").groupBy(*test).agg(F.sum(F.col("__hits") / F.col("__rank")).alias("__sum"))
    each = sizes.join(sums, test, "left").select(*test, (F.coalesce("__sum", F.lit(0.0)) / F.col("__links")).alias("__ap"))
    return each.groupBy(*by).agg(F.avg("__ap").alias("map"))


def scored_candidates(candidates: DataFrame, truth: DataFrame, score: str) -> DataFrame:
    """Candidates of the truth's tests with a numeric score, first of each pair, with label."""
    tests = truth.select("from_url").distinct()
    rows = candidates.join(tests, "from_url", "left_semi").withColumn("score", F.col(score).try_cast("double"))
    rows = keep_first(rows.where("score IS NOT NULL AND to_url IS NOT NULL"), PAIR)
    marks = truth.select(*PAIR).distinct().withColumn("label", F.lit(1))
    return rows.select(*PAIR, "score").join(marks, PAIR, "left").na.fill(0, ["label"])


def pr_auc(labelled: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """auc: trapezoids under the precision-recall curve over distinct scores; null with one class.

    Rows are first summed up by score, so ranking meets one row a distinct score.
    """
    points = labelled.groupBy(*by, score).agg(F.sum(label).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    down = Window.partitionBy(*by).orderBy(F.desc(score))
    running = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    curve = points.withColumns({"__tp": F.sum("__pos").over(running), "__all": F.sum("__n").over(running), "__total": F.sum("__pos").over(whole)})
    curve = curve.withColumns({"__precision": F.col("__tp") / F.col("__all"), "__recall": F.try_divide(F.col("__tp").cast("double"), F.col("__total"))})
    before = {k: F.lag(f"__{k}", 1, v).over(down) for k, v in (("precision", 1.0), ("recall", 0.0))}
    area = (F.col("__recall") - before["recall"]) * (F.col("__precision") + before["precision"]) / 2
    sums = curve.withColumn("__area", area).groupBy(*by).agg(
        F.sum("__area").alias("__auc"), F.sum("__pos").alias("__p"), F.sum("__n").alias("__n")
    )
    return sums.select(*by, F.when((F.col("__p") > 0) & (F.col("__p") < F.col("__n")), F.col("__auc")).alias("auc"))


def resolve_groups(groups: dict[str, list[str]], selected: str | None) -> tuple[str, list[str]]:
    """Output name and member experiments of ``all``, one group or a comma list."""
    if not selected or selected.strip().lower() == "all":
        return "all", list(dict.fromkeys(m for ms in groups.values() for m in ms))
    names = list(dict.fromkeys(n.strip() for n in selected.split(",") if n.strip()))
    unknown = [n for n in names if n not in groups]
    if unknown:
        raise ValueError(f"unknown group: {', '.join(unknown)}")
    return names[0] if len(names) == 1 else "multi-group", list(dict.fromkeys(m for n in names for m in groups[n]))


def evaluate(links: DataFrame, truth: DataFrame, candidates: DataFrame, score: str | None, by: Sequence[str] = ("project",)) -> DataFrame:
    """Metrics, map and auc by ``by``; predictions count only for tests of the truth."""
    truth = positive_truth(truth)
    own = links.join(truth.select(*by, "from_url").distinct(), [*by, "from_url"], "left_semi")
    out = link_metrics(own, truth, by)
    rank = mean_average_precision(own, truth, score, by)
    out = out.join(rank.withColumn("map", text.round_even(F.col("map"))), list(by), "left")
    if score:
        marks = truth.select(*by, *PAIR).distinct().withColumn("label", F.lit(1))
        rows = candidates.join(truth.select(*by, "from_url").distinct(), [*by, "from_url"], "left_semi")
        rows = keep_first(rows.withColumn("score", F.col(score).try_cast("double")).where("score IS NOT NULL"), [*by, *PAIR])
        rows = rows.select(*by, *PAIR, "score").join(marks, [*by, *PAIR], "left").na.fill(0, ["label"])
        area = pr_auc(rows, by=by)
        return out.join(area.withColumn("auc", text.round_even(F.col("auc"))), list(by), "left")
    return out.withColumn("auc", F.lit(None).cast("double"))
