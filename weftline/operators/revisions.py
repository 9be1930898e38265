"""Revision histories: change counts, rank statistics from histograms, deltas and their CDFs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import statistics, tags, text
from weftline.operators.filters import CHANGE_TYPES
from weftline.operators.relational import renumbered, running_total
from weftline.session import cut_lineage

LEAST_ROWS = 30
MARKERS = {"N": "negligible", "S": "small", "M": "medium", "L": "large"}


# ---- change counts --------------------------------------------------------------------------


def change_counts(commits: DataFrame, key: Sequence[str] = ("url",)) -> DataFrame:
    """ch_all, ch_diff and a count for each change type, from one row a commit.

    commits: key, commit, type (``Ybodychange`` or ``Ymultichange(Yrename,Ybodychange)``), diff,
    subchange_diffs (array of string, may be null). A commit counts once for each distinct type; an
    unknown type is an error.
    """
    types = F.array_distinct(
        F.filter(F.transform(F.split(F.col("type"), r"[(),]"), lambda t: F.trim(t)), lambda t: t != "")
    )
    known = F.array(*[F.lit(t) for t in CHANGE_TYPES])
    unknown = F.array_except(types, known)
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown change type: "), F.array_join(unknown, ", ")))).otherwise(types)
    has_diff = (text.blank(F.col("diff")) != "") | F.coalesce(
        F.exists("subchange_diffs", lambda d: F.coalesce(d, F.lit("")) != ""), F.lit(False)
    )
    rows = commits.withColumns({"__types": checked, "__diff": has_diff})
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("ch_all"),
        F.count_if("__diff").alias("ch_diff"),
        *[F.count_if(F.array_contains("__types", t)).alias(f"ch_{n}") for t, n in CHANGE_TYPES.items()],
    )


def subsequent(value: Column) -> Column:
    """Revisions after the introduction."""
    return F.greatest(value - 1, F.lit(0))


# ---- rank statistics ------------------------------------------------------------------------


def rank_sums(df: DataFrame, value: str, is_first: Column, by: Sequence[str] = ()) -> DataFrame:
    """n1, n2, u1, ties of two samples: ranks come from the histogram of distinct values.

    ``is_first`` picks the first sample. Rows are summed up by value before any window, so even the
    group of all rows is ranked over its few distinct values. Null values drop out.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count_if(is_first).alias("__a"), F.count_if(~is_first).alias("__b"))
    )
    return rank_sums_of_histogram(counts, value, by)


def rank_sums_of_histogram(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """As ``rank_sums``, from (by, value, __a, __b)."""
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    size = (F.col("__a") + F.col("__b")).cast("double")
    ranked = counts.withColumns({"__t": size, "__below": F.coalesce(F.sum(size).over(below), F.lit(0.0))})
    middle = F.col("__below") + (F.col("__t") + 1) / 2
    sums = ranked.groupBy(*by).agg(
        F.sum("__a").alias("n1"),
        F.sum("__b").alias("n2"),
        F.sum(middle * F.col("__a")).alias("__r1"),
        F.sum(F.col("__t") * F.col("__t") * F.col("__t") - F.col("__t")).alias("ties"),
    )
    n1 = F.col("n1").cast("double")
    return sums.withColumn("u1", F.col("__r1") - n1 * (n1 + 1) / 2).drop("__r1")


def mann_whitney(sums: DataFrame) -> DataFrame:
    """u2, p, delta and its size from n1, n2, u1, ties."""
    pairs = F.col("n1").cast("double") * F.col("n2")
    delta = F.when(pairs > 0, 2 * F.col("u1") / pairs - 1)
    return sums.withColumns(
        {
            "u2": pairs - F.col("u1"),
            "p": statistics.mann_whitney_p_column(F.col("u1"), F.col("n1"), F.col("n2"), F.col("ties")),
            "delta": delta,
            "effect_size": statistics.delta_size(delta),
        }
    )


def sign(delta: Column) -> Column:
    return F.when(delta > 0, "+").when(delta < 0, "-").otherwise("=")


def size_markers(size: Column) -> dict[str, Column]:
    return {m: F.when(size == name, "x").otherwise("") for m, name in MARKERS.items()}


def revision_comparison(
    methods: DataFrame, changes: Sequence[str], by: Sequence[str] = ("tool",), project: str = "project", least: int = LEAST_ROWS
) -> DataFrame:
    """Production against test revisions after introduction, by project and over all projects.

    methods: by..., project, method_kind and the change counts. A project needs ``least`` rows; rows
    of all projects take part in ``all``. The histogram is summed up once, by grouping sets.
    """
    pairs = ", ".join(f"'{c.removeprefix('ch_')}', CAST({c} AS DOUBLE)" for c in changes)
    long = methods.select(*by, project, "method_kind", F.expr(f"stack({len(changes)}, {pairs}) AS (change, value)"))
    is_main = F.col("method_kind") == tags.PRODUCTION_KIND
    histogram = (
        long.withColumn("value", subsequent(F.col("value")))
        .groupBy(*by, project, "change", "value")
        .agg(F.count_if(is_main).alias("__a"), F.count_if(~is_main).alias("__b"))
    )
    sets = histogram.groupingSets(
        [[*by, project, "change", "value"], [*by, "change", "value"]], *by, project, "change", "value"
    ).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"), F.grouping(project).alias("__all"))
    named = sets.withColumn(project, F.when(F.col("__all") == 1, "all").otherwise(F.col(project)))
    group = ["__all", *by, project, "change"]
    sizes = named.groupBy(*group).agg(F.sum(F.col("__a") + F.col("__b")).alias("size"))
    sums = rank_sums_of_histogram(named.where("value IS NOT NULL"), "value", group)
    rows = mann_whitney(sums.where("n1 > 0 AND n2 > 0")).join(sizes, group)
    rows = rows.where((F.col("__all") == 1) | (F.col("size") >= least)).drop("__all")
    return rows.select(
        project, *by, "change", "size",
        F.col("n1").alias("main_size"), F.col("n2").alias("test_size"),
        text.round_even(F.col("u1")).alias("mww_u1"), text.round_even(F.col("u2")).alias("mww_u2"),
        text.round_even(F.col("p")).alias("mww_p"), text.round_even(F.col("delta")).alias("d_value"),
        sign(F.col("delta")).alias("d_sign"), "effect_size",
        *[c.alias(m) for m, c in size_markers(F.col("effect_size")).items()],
    )


def pair_correlation(pairs: DataFrame, changes: Sequence[str], by: Sequence[str] = ("project", "tool", "strategy")) -> DataFrame:
    """Kendall's tau-b and the rank test of linked counts (production first, introduction included).

    Pairs are summed up by (production, test) values first; a group's distinct pairs go to one task.
    """
    entries = ", ".join(
        f"'{c.removeprefix('ch_')}', CAST(to_{c} AS DOUBLE), CAST(from_{c} AS DOUBLE)" for c in changes
    )
    long = pairs.select(*by, F.expr(f"stack({len(changes)}, {entries}) AS (change, production, test)"))
    group = [*by, "change"]
    both = long.groupBy(*group, "production", "test").agg(F.count(F.lit(1)).alias("n"))
    schema = both.select(*group).schema.add("corr", "double").add("corr_p", "double").add("size", "long")

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.dropna(subset=["production", "test"])
        x, y, times = (known[c].tolist() for c in ("production", "test", "n"))
        value, p = statistics.kendall_of_counts(x, y, times) if len(set(x)) > 1 and len(set(y)) > 1 else (None, None)
        return pdf[group].head(1).assign(corr=value, corr_p=p, size=int(pdf["n"].sum()))

    correlated = both.groupBy(*group).applyInPandas(tau, schema)
    one = both.select(*group, F.col("production").alias("value"), F.col("n").alias("__a"), F.lit(0).cast("long").alias("__b"))
    other = both.select(*group, F.col("test").alias("value"), F.lit(0).cast("long").alias("__a"), F.col("n").alias("__b"))
    counts = one.unionByName(other).where("value IS NOT NULL").groupBy(*group, "value").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    ranked = mann_whitney(rank_sums_of_histogram(counts, "value", group))
    rounded = {n: text.round_even(F.col(c)) for n, c in (("corr", "corr"), ("corr_p", "corr_p"))}
    return correlated.withColumns(rounded).join(ranked, group).select(
        *by, "size", "change", "corr", "corr_p",
        text.round_even(F.col("u1")).alias("mwu_u1"), text.round_even(F.col("u2")).alias("mwu_u2"),
        text.round_even(F.col("p")).alias("mwu_p"), text.round_even(F.col("delta")).alias("mwu_d"),
        F.col("effect_size").alias("mwu_size"),
    )


# ---- deltas and distributions ---------------------------------------------------------------


def deltas(pairs: DataFrame, change: str, keep: Sequence[str] = ("project",)) -> DataFrame:
    """test - production where both are numbers."""
    delta = text.number(F.col(f"from_{change}")) - text.number(F.col(f"to_{change}"))
    return pairs.select(*keep, delta.cast("long").alias("delta")).where("delta IS NOT NULL")


def step_cdf(df: DataFrame, value: str) -> DataFrame:
    """(value, until, cdf): the distribution as steps, a row for each value that occurs.

    ``cdf`` holds from value up to ``until``, the integer before the next one (the greatest value:
    itself).  Rows are as many as distinct values, however far apart these are.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    steps = cut_lineage(running_total(counts, [F.col(value).asc()], "__n", "__upto"))
    # The next value is that of the next place; places are numbered by ranges, too.
    placed = cut_lineage(renumbered(steps, [F.col(value).asc()], "__at"))
    ahead = placed.select((F.col("__at") - 1).alias("__at"), F.col(value).alias("__next"))
    total = steps.agg(F.max("__upto").alias("__total"))  # one row
    rows = placed.join(ahead, "__at", "left").crossJoin(F.broadcast(total))
    return rows.select(value, F.coalesce(F.col("__next") - 1, F.col(value)).alias("until"), (F.col("__upto") / F.col("__total")).alias("cdf"))


def dense_cdf(df: DataFrame, value: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(value, cdf) for every integer from the least to the greatest value, or within the bounds of a display."""
    steps = step_cdf(df, value)
    if low is not None:
        steps = steps.where(F.col("until") >= low).withColumn(value, F.greatest(F.col(value), F.lit(low)))
    if high is not None:
        steps = steps.where(F.col(value) <= high).withColumn("until", F.least("until", F.lit(high)))
    return steps.select(F.explode(F.sequence(F.col(value), F.col("until"))).alias(value), "cdf")


def clipped(value: Column, bound: int = 10) -> Column:
    return F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))


def coverage_threshold(cdf: DataFrame, value: str, coverage: float = 0.8) -> DataFrame:
    """The first value whose CDF reaches ``coverage``, with covered and tail percent; steps are enough for it."""
    hit = cdf.where(F.col("cdf") >= coverage).agg(F.min(F.struct(value, "cdf")).alias("h"))
    return hit.where("h IS NOT NULL").select(
        F.col(f"h.{value}").alias("threshold"),
        text.round_even(F.col("h.cdf") * 100).alias("covered"),
        text.round_even((1 - F.col("h.cdf")) * 100).alias("tail"),
    )


def delta_groups(delta: Column) -> Column:
    """No more test than production revisions, up to four more, or at least five more."""
    return F.when(delta <= 0, "NTR").when(delta < 5, "MTR").otherwise("HTR")


def delta_group_counts(df: DataFrame) -> DataFrame:
    """n, percent and projects of each delta group; groups without rows stay."""
    groups = df.sparkSession.createDataFrame([("NTR",), ("MTR",), ("HTR",)], "grp string")
    counted = df.withColumn("grp", delta_groups(F.col("delta"))).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("project").alias("projects")
    )
    filled = groups.join(F.broadcast(counted), "grp", "left").na.fill(0, ["n", "projects"])  # three rows
    return filled.withColumn("percent", text.percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def tick_values(most: int) -> list[int]:
    """0, 1, 2, 5, 10, 20, 50, ... up to the first that reaches ``most``."""
    ticks, scale = [0], 1
    while ticks[-1] < most:
        for step in (1, 2, 5):
            ticks.append(step * scale)
            if ticks[-1] >= most:
                break
        scale *= 10
    return ticks


def display_position(value: Column, ticks: Sequence[int]) -> Column:
    """Place of a value on an axis with evenly spaced ticks, linear between them."""
    out = F.when(value <= ticks[0], F.lit(0.0))
    for i, (a, b) in enumerate(zip(ticks, ticks[1:])):
        out = out.when(value <= b, i + (value - a) / float(b - a))
    return out.otherwise(F.lit(float(len(ticks) - 1)))


def value_at_marker(steps: DataFrame, markers: DataFrame, x: str, y: str, marker: str = "marker") -> DataFrame:
    """y of the last step at or before each marker; the first y where there is none (as-of, backward)."""
    points = steps.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.lit(None).cast("double").alias("__m"))
    asked = markers.select(F.col(marker).alias("__x"), F.lit(None).cast("double").alias("__y"), F.col(marker).alias("__m"))
    # Ranges of x are looked through side by side; a range takes over the last y of those before it.
    spread = points.unionByName(asked).withColumn("__asks", F.col("__m").isNotNull()).repartitionByRange("__x", "__asks")
    rows = cut_lineage(spread.withColumn("__part", F.spark_partition_id()))
    back = Window.partitionBy("__part").orderBy("__x", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    ends = rows.groupBy("__part").agg(F.max_by("__y", F.when(~F.col("__asks"), F.col("__x"))).alias("__end"))
    ends = ends.select("__part", F.last("__end", True).over(before).alias("__before"))
    first = steps.agg(F.min_by(y, x).alias("__first"))
    seen = rows.withColumn("__last", F.last("__y", True).over(back)).where("__asks").join(F.broadcast(ends), "__part")
    return seen.crossJoin(F.broadcast(first)).select(  # one row
        F.col("__m").alias(marker), F.coalesce("__last", "__before", "__first").alias(y)
    )


def direction_summary(rows: DataFrame) -> DataFrame:
    """By sign: projects, significant projects, share of each effect size; the total row does not count."""
    own = rows.where("project <> 'all'")
    shares = [
        text.round_even(F.count_if(F.col("effect_size") == n) / F.count(F.lit(1)) * 100, 1).alias(n) for n in MARKERS.values()
    ]
    return own.groupBy("d_sign").agg(
        F.count(F.lit(1)).alias("projects"), F.count_if(F.col("mww_p") <= 0.05).alias("significant"), *shares
    )


def population_counts(methods: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """Rows, distinct tests and distinct production methods."""
    kind = F.col("method_kind")
    return methods.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(kind == tags.TEST_KIND, F.col("url"))).alias("test"),
        F.count_distinct(F.when(kind == tags.PRODUCTION_KIND, F.col("url"))).alias("production"),
    )


def call_statistics(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """prod_methods, tests, unique_calls, median_calls by project; tests without a call count as 0."""
    url = methods.select("project", "url", "artifact").dropDuplicates(["project", "url"])
    test = url.where(tags.has_tag(F.col("artifact"), "test-case-method")).select("project", F.col("url").alias("from_url"))
    sizes = url.groupBy("project").agg(
        F.count_if(tags.has_tag(F.col("artifact"), "main-code")).alias("prod_methods"),
        F.count_if(tags.has_tag(F.col("artifact"), "test-case-method")).alias("tests"),
    )
    known = url.select("project", F.col("url").alias("to_url"))
    calls = edges.select("project", "from_url", "to_url").distinct().join(known, ["project", "to_url"], "left_semi")
    a_test = test.join(calls, ["project", "from_url"], "left").groupBy("project", "from_url").agg(F.count("to_url").alias("n"))
    sums = a_test.groupBy("project").agg(F.sum("n").alias("unique_calls"), F.median("n").alias("median_calls"))
    return sizes.join(sums, "project", "left").na.fill(0, ["unique_calls"])


def runtime_statistics(df: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """mean, median, max seconds of every ``<tool>_runtime`` column of milliseconds."""
    columns = [c for c in df.columns if c.endswith("_runtime") and c.removesuffix("_runtime") not in excluded]
    long = df.unpivot([], columns, "tool", "ms") if columns else None
    if long is None:
        return df.sparkSession.createDataFrame([], "tool string, mean double, median double, max double")
    seconds = long.select(F.regexp_replace("tool", "_runtime$", "").alias("tool"), (text.number(F.col("ms").cast("string")) / 1000).alias("s"))
    return seconds.where("s > 0").groupBy("tool").agg(
        F.avg("s").alias("mean"), F.median("s").alias("median"), F.max("s").alias("max")
    )
