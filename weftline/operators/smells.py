"""Test smells against revision groups: reduction, prevalence, association, size control."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import statistics, text
from weftline.operators.relational import ORD, join_few, running_total
from weftline.operators.revisions import mann_whitney, rank_sums, sign, size_markers
from weftline.session import cut_lineage

ANY, NONE = "any", "none"
GROUPS = ("NTR", "ATR", "HTR")
# Other names of revision groups, and what the groups of a comparison hold.
ALIASES = {"AHTR": "MTR", "MHTR": "MTR"}
MEMBERS = {"NTR": ("NTR",), "ATR": ("ATR",), "HTR": ("HTR",), "MTR": ("ATR", "HTR")}
LEAST_DIFFERENCE = 5
ALPHA = 0.05
SIZES = ("Small", "Medium", "Large")


def revision_group(test: Column, production: Column, least: float = LEAST_DIFFERENCE) -> Column:
    """NTR: no more test revisions; HTR: at least ``least`` more; ATR between; blank without numbers."""
    a, b = text.number(test), text.number(production)
    return (
        F.when(a.isNull() | b.isNull(), "").when(a <= b, "NTR").when(a - b >= least, "HTR").otherwise("ATR")
    )


def normal_group(group: Column) -> Column:
    out = group
    for alias, name in ALIASES.items():
        out = F.when(group == alias, name).otherwise(out)
    return out


def group_pairs(value: str | None) -> list[tuple[str, str]]:
    """(focal, baseline) pairs of ``HTR,NTR;ATR,NTR``."""
    if not (value or "").strip():
        return [("HTR", "NTR")]
    out = []
    for part in value.split(";"):
        names = [ALIASES.get(n.strip(), n.strip()) for n in part.split(",") if n.strip()]
        if len(names) != 2 or not set(names) <= set(MEMBERS):
            raise ValueError(f"not a pair of known groups: {part}")
        out.append((names[0], names[1]))
    return out


def smell_summary(smells: DataFrame, key: str = "url", smell: str = "smell") -> DataFrame:
    """Sorted distinct smells of each method in one cell."""
    named = F.collect_set(F.when(F.trim(smell) != "", F.trim(smell)))
    return smells.groupBy(F.col(key).alias("from_url")).agg(F.array_join(F.array_sort(named), " ").alias("smells"))


def attach_smells(links: DataFrame, smells: DataFrame) -> DataFrame:
    """Links with their test's smells, blank where it has none."""
    found = links.join(smell_summary(smells), "from_url", "left")
    return found.withColumn("smells", text.blank(F.col("smells")))


def attach_groups(links: DataFrame, changes: Sequence[str], least: float = LEAST_DIFFERENCE) -> DataFrame:
    """rg_<change> for every change that both ends have."""
    return links.withColumns(
        {f"rg_{c.removeprefix('ch_')}": revision_group(F.col(f"from_{c}"), F.col(f"to_{c}"), least) for c in changes}
    )


def unique_methods(frame: DataFrame, group: str, groups: Sequence[str]) -> DataFrame:
    """One row a test among the selected groups: first values, united smells; tests of two groups drop out."""
    rows = frame.withColumn(group, normal_group(F.col(group))).where(F.col(group).isin(*[ALIASES.get(g, g) for g in groups]))
    rest = [c for c in frame.columns if c not in ("from_url", "smells", ORD)]
    reduced = rows.groupBy("from_url").agg(
        F.min(group).alias("__low"),
        F.max(group).alias("__high"),
        F.min_by(F.struct(*rest), ORD).alias("__first"),
        F.min(ORD).alias(ORD),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(text.split_smells(F.col("smells")))))).alias("__smells"),
    )
    return reduced.where("__low = __high").select(
        "from_url", "__first.*", F.array_join("__smells", " ").alias("smells"), ORD
    )


def comparison_methods(frame: DataFrame, group: str, focal: str, baseline: str) -> DataFrame:
    """``unique_methods`` of two groups that may be unions: members take their group's name first."""
    focal, baseline = ALIASES.get(focal, focal), ALIASES.get(baseline, baseline)
    own = normal_group(F.col(group))
    renamed = F.when(own.isin(*MEMBERS[baseline]), baseline).when(own.isin(*MEMBERS[focal]), focal)
    return unique_methods(frame.withColumn(group, renamed), group, [baseline, focal])


def smell_order(frame: DataFrame) -> DataFrame:
    """(smell, n) by occurrences, repeats in a cell included; ties by name."""
    return (
        frame.select(F.explode(text.split_smells(F.col("smells"))).alias("smell")).groupBy("smell")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "smell")
    )


def smell_counts(unique: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, smell, smell_n) with any and none: one row a method and smell, summed up."""
    smells = F.array_distinct(text.split_smells(F.col("smells")))
    marks = F.concat(F.when(F.size(smells) > 0, F.array(F.lit(ANY))).otherwise(F.array(F.lit(NONE))), smells)
    return unique.select(*by, F.explode(marks).alias("smell")).groupBy(*by, "smell").agg(F.count(F.lit(1)).alias("smell_n"))


def prevalence(frame: DataFrame, group: str, groups: Sequence[str] = GROUPS) -> DataFrame:
    """methods, smell_n and percent of every smell in every group; pairs without rows stay as zeros."""
    unique = unique_methods(frame, group, groups)
    spark = frame.sparkSession
    group_rows = spark.createDataFrame([(g,) for g in groups], "rg_group string")
    counts = smell_counts(unique.withColumnRenamed(group, "rg_group"), ["rg_group"])
    smells = counts.select("smell").union(spark.createDataFrame([(ANY,), (NONE,)], "smell string")).distinct()
    sizes = unique.groupBy(F.col(group).alias("rg_group")).agg(F.count(F.lit(1)).alias("methods"))
    grid = smells.crossJoin(F.broadcast(group_rows))  # a few groups
    full = grid.join(sizes, "rg_group", "left").join(counts, ["rg_group", "smell"], "left").na.fill(0, ["methods", "smell_n"])
    return full.select(
        "rg_group", "methods", "smell", text.percent(F.col("smell_n"), F.col("methods")).alias("percent"),
        F.col("methods").alias("smell_total"), "smell_n",
    )


# ---- sizes ----------------------------------------------------------------------------------


def first_valid_loc(smells: DataFrame, key: str = "url", loc: str = "loc") -> DataFrame:
    """The first positive line count of each method; blank keys drop out."""
    value = text.valid_loc(F.col(loc))
    rows = smells.select(F.col(key).alias("from_url"), value.alias("loc"), ORD).where("loc IS NOT NULL AND from_url <> ''")
    return rows.groupBy("from_url").agg(F.min_by("loc", ORD).alias("loc"))


def loc_thresholds(locs: DataFrame, shares: Sequence[float] = (0.7, 0.8, 0.9)) -> DataFrame:
    """One row p70, p80, p90: the values nearest to the quantiles' places, from the histogram."""
    counts = locs.groupBy("loc").agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.orderBy("loc").rowsBetween(Window.unboundedPreceding, 0)  # one row a distinct size
    running = counts.withColumns({"__up": F.sum("__n").over(up_to), "__all": F.sum("__n").over(Window.partitionBy())})
    place = lambda q: F.rint((F.col("__all") - 1) * q)
    return running.agg(*[F.min(F.when(F.col("__up") > place(q), F.col("loc"))).alias(f"p{round(q * 100)}") for q in shares])


def loc_group(loc: Column) -> Column:
    return F.when(loc <= F.col("p70"), "S").when(loc <= F.col("p80"), "M").when(loc <= F.col("p90"), "L").otherwise("XL")


def with_loc_groups(locs: DataFrame) -> DataFrame:
    return locs.crossJoin(F.broadcast(loc_thresholds(locs))).withColumn("loc_group", loc_group(F.col("loc"))).drop("p70", "p80", "p90")


def loc_group_table(locs: DataFrame) -> DataFrame:
    """methods, loc_min, loc_max, percent of S, M, L, XL; empty groups stay."""
    names = locs.sparkSession.createDataFrame([(g,) for g in ("S", "M", "L", "XL")], "loc_group string")
    sizes = with_loc_groups(locs).groupBy("loc_group").agg(
        F.count(F.lit(1)).alias("methods"), F.min("loc").alias("loc_min"), F.max("loc").alias("loc_max")
    )
    full = names.join(F.broadcast(sizes), "loc_group", "left").na.fill(0, ["methods"])  # four rows
    return full.withColumn("percent", text.percent(F.col("methods"), F.sum("methods").over(Window.partitionBy())))


def control_group(loc: Column) -> Column:
    return F.when(loc < 30, "Small").when(loc <= 60, "Medium").otherwise("Large")


def smell_count_frame(smells: DataFrame, key: str = "url", smell: str = "smell") -> DataFrame:
    """Distinct smells of each method and their number; methods without smells count 0."""
    named = F.array_sort(F.collect_set(F.when(F.trim(smell) != "", F.trim(smell))))
    return smells.groupBy(F.col(key).alias("from_url")).agg(
        F.array_join(named, " ").alias("smells"), F.size(named).cast("long").alias("smell_count")
    )


def linked_locs(links: DataFrame) -> DataFrame:
    """The first positive end - start + 1 of each linked test."""
    loc = text.whole(F.col("from_end")) - text.whole(F.col("from_start")) + 1
    rows = links.select("from_url", loc.alias("loc"), ORD).where("loc > 0")
    return rows.groupBy("from_url").agg(F.min_by("loc", ORD).alias("loc"))


def outliers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Values outside 1.5 interquartile ranges (linear quantiles), from the histogram of values.

    Places of quartiles come from a running count over ranges of (by, value), so a group needs no
    task of its own.
    """
    histogram = cut_lineage(df.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n")))
    sort = [*[F.col(c).asc() for c in by], F.col("__v").asc()]
    known = running_total(histogram.where("__v IS NOT NULL"), sort, "__n", "__up")
    sizes = known.groupBy(*by).agg(F.min(F.col("__up") - F.col("__n")).alias("__base"), F.sum("__n").alias("__rows"))
    placed = _with_group(known, sizes, by).withColumn("__up", F.col("__up") - F.col("__base"))
    place = {q: (F.col("__rows") - 1) * q for q in (0.25, 0.75)}
    at = lambda nth: F.min(F.when(F.col("__up") > nth, F.col("__v")))
    found = placed.groupBy(*by).agg(
        F.first("__rows").alias("__rows"), *[at(k(place[q])).alias(f"__{n}_{q}") for q in place for n, k in (("low", F.floor), ("high", F.ceil))]
    )
    q1, q3 = (
        F.when(F.floor(p) == F.ceil(p), F.col(f"`__low_{q}`")).otherwise((F.ceil(p) - p) * F.col(f"`__low_{q}`") + (p - F.floor(p)) * F.col(f"`__high_{q}`"))
        for q, p in place.items()
    )
    ends = found.select(*by, q1.alias("__q1"), q3.alias("__q3"))
    spread = F.col("__q3") - F.col("__q1")
    outside = (F.col("__v") < F.col("__q1") - 1.5 * spread) | (F.col("__v") > F.col("__q3") + 1.5 * spread)
    counted = _with_group(histogram, ends, by, "left").groupBy(*by)
    return counted.agg(F.coalesce(F.sum(F.when(outside, F.col("__n"))), F.lit(0)).alias("extreme"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))


def _with_group(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the row of its group; without ``by`` there is one."""
    if by:
        return join_few(df.dropna(subset=list(by)), groups, by, how)
    return df.join(F.broadcast(groups), how="left") if how == "left" else df.crossJoin(F.broadcast(groups))


# ---- tests ----------------------------------------------------------------------------------


def count_comparison(unique: DataFrame, group: str, focal: str, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank test of distinct smell counts of two groups, with medians, by stratum and over all (ALL).

    unique: group, smells and the ``by`` column (at most one) that names strata.
    """
    rows = unique.withColumn("n", F.size(F.array_distinct(text.split_smells(F.col("smells")))))
    if by:
        rows = rows.withColumn("__s", F.explode(F.array(F.lit("ALL"), F.col(by[0])))).drop(by[0]).withColumnRenamed("__s", by[0])
    rows = rows.where(F.col(group).isin(focal, baseline))
    is_focal = F.col(group) == focal
    middles = rows.groupBy(*by).agg(
        F.median(F.when(is_focal, F.col("n"))).alias("g1_median"), F.median(F.when(~is_focal, F.col("n"))).alias("g2_median")
    )
    tested = mann_whitney(rank_sums(rows, "n", is_focal, by).where("n1 > 0 AND n2 > 0"))
    tested = tested.join(middles, list(by)) if by else tested.crossJoin(F.broadcast(middles))
    return tested.select(
        *by, F.lit(focal).alias("g1"), F.lit(baseline).alias("g2"), F.col("n1").alias("g1_size"), F.col("n2").alias("g2_size"),
        "g1_median", "g2_median", text.round_even(F.col("u1")).alias("mww_u1"), text.round_even(F.col("u2")).alias("mww_u2"),
        text.round_even(F.col("p")).alias("mww_p"), text.round_even(F.col("delta")).alias("d_value"),
        sign(F.col("delta")).alias("d_sign"), "effect_size", *[c.alias(m) for m, c in size_markers(F.col("effect_size")).items()],
    )


def paired_smells(table: DataFrame, g1: str, g2: str) -> DataFrame:
    """(smell, g1, g2) percentages of smells that both groups list; any and none drop out."""
    side = lambda g, n: table.where(F.col("rg_group") == g).select("smell", F.col("percent").alias(n))
    return side(g1, "g1").join(side(g2, "g2"), "smell").where(~F.col("smell").isin(ANY, NONE))


def signed_rank(pairs: DataFrame, a: str = "g1", b: str = "g2", by: Sequence[str] = ()) -> DataFrame:
    """w_stat and w_p of paired values: zeros drop out; without any difference w is 0 and p 1."""
    diff = pairs.select(*by, (F.col(a) - F.col(b)).alias("__d")).withColumn("__s", F.abs(F.col("__d")))
    counts = diff.groupBy(*by, "__s").agg(F.count_if(F.col("__d") > 0).alias("__pos"), F.count(F.lit(1)).alias("__t"))
    below = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    nonzero = counts.where("__s > 0").withColumn("__below", F.coalesce(F.sum("__t").over(below), F.lit(0)))
    t = F.col("__t").cast("double")
    sums = nonzero.groupBy(*by).agg(
        F.sum((F.col("__below") + (t + 1) / 2) * F.col("__pos")).alias("__w"), F.sum("__t").alias("__n"), F.sum(t * t * t - t).alias("__ties")
    )
    groups = counts.groupBy(*by).agg(F.sum("__t").alias("size"))
    full = (groups.join(sums, list(by), "left") if by else groups.crossJoin(F.broadcast(sums))).na.fill(0)
    n = F.col("__n").cast("double")
    w = F.least(F.col("__w"), n * (n + 1) / 2 - F.col("__w"))
    p = statistics.wilcoxon_p_column(F.col("__w"), F.col("__n"), F.col("__ties"))
    return full.select(*by, "size", w.alias("w_stat"), p.alias("w_p"))


def mantel_haenszel(tables: DataFrame, by: Sequence[str]) -> DataFrame:
    """mh_odds_ratio and mh_p over strata, from one row (by, a, b, c, d) for each stratum with both groups."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    expected = (a + b) * (a + c) / n
    spread = F.when(n > 1, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).otherwise(0.0)
    sums = tables.where((a + b > 0) & (c + d > 0)).groupBy(*by).agg(
        F.sum(a * d / n).alias("__num"), F.sum(b * c / n).alias("__den"), F.sum(a - expected).alias("__diff"), F.sum(spread).alias("__var")
    )
    ratio = (
        F.when(F.col("__den") > 0, F.col("__num") / F.col("__den"))
        .when(F.col("__num") > 0, F.lit(math.inf)).otherwise(F.lit(math.nan))
    )
    p = statistics.chi_square_tail_column(F.try_divide(F.col("__diff") * F.col("__diff"), F.col("__var")))
    return sums.select(*by, ratio.alias("mh_odds_ratio"), F.when(F.col("__var") > 0, p).otherwise(F.lit(1.0)).alias("mh_p"))


def adjust(df: DataFrame, p: str, name: str, by: Sequence[str] = (), order: Sequence[str] = ("smell",)) -> DataFrame:
    """Benjamini-Hochberg: running least of p * n / rank from the greatest p down, at most 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p, *order))
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    down = Window.partitionBy(*by).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumns({"__rank": rank, "__total": total})
    low = F.min(F.col(p) * F.col("__total") / F.col("__rank")).over(down)
    return ranked.withColumn(name, F.least(low, F.lit(1.0))).drop("__rank", "__total")


def association(unique: DataFrame, group: str, focal: str, baseline: str, by: Sequence[str] = (), adjust_all: bool = False) -> DataFrame:
    """Per smell: counts, percentages, difference with interval, exact odds ratio, stratified odds ratio, adjusted p.

    unique: one row a method with project, smells and ``group``. any and none are not adjusted
    (unless ``adjust_all``). ``by`` adds strata, each with its own adjustment.
    """
    rows = unique.where(F.col(group).isin(focal, baseline))
    is_focal = F.col(group) == focal
    sizes = rows.groupBy(*by, "project").agg(F.count_if(is_focal).alias("f"), F.count_if(~is_focal).alias("g"))
    smells = F.array_distinct(text.split_smells(F.col("smells")))
    marks = F.concat(F.when(F.size(smells) > 0, F.array(F.lit(ANY))).otherwise(F.array(F.lit(NONE))), smells)
    has = rows.select(*by, "project", is_focal.alias("__f"), F.explode(marks).alias("smell")).groupBy(*by, "project", "smell").agg(
        F.count_if("__f").alias("a"), F.count_if(~F.col("__f")).alias("c")
    )
    # A project without the smell has a = c = 0 and adds nothing to any sum over strata; the pooled
    # table needs no more of it than the sizes.
    pooled = has.groupBy(*by, "smell").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    totals = sizes.groupBy(*by).agg(F.sum("f").alias("f"), F.sum("g").alias("g"))  # one row a stratum set
    both = totals.select(*by, F.explode(F.array(F.lit(ANY), F.lit(NONE))).alias("smell"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("c"))
    pooled = pooled.unionByName(both).groupBy(*by, "smell").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    pooled = pooled.join(totals, list(by)) if by else pooled.crossJoin(F.broadcast(totals))
    pooled = pooled.select(*by, "smell", "a", (F.col("f") - F.col("a")).alias("b"), "c", (F.col("g") - F.col("c")).alias("d"))
    pooled = pooled.where("a + b > 0 AND c + d > 0")
    tables = has.join(sizes, [*by, "project"]).select(
        *by, "smell", "a", (F.col("f") - F.col("a")).alias("b"), "c", (F.col("g") - F.col("c")).alias("d")
    )
    n1, n0 = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    low, high = statistics.difference_interval(F.col("a"), n1, F.col("c"), n0)
    exact = statistics.fisher_column(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    share1, share0 = F.col("a") / n1 * 100, F.col("c") / n0 * 100
    r = text.round_even
    out = pooled.withColumn("__x", exact).select(
        *by, F.lit(baseline).alias("baseline_group"), F.lit(focal).alias("focal_group"), "smell",
        n0.alias("baseline_n"), F.col("c").alias("baseline_smell_n"), r(share0).alias("baseline_percent"),
        n1.alias("focal_n"), F.col("a").alias("focal_smell_n"), r(share1).alias("focal_percent"),
        r(share1 - share0).alias("difference_pp"), r(low).alias("difference_ci_low"), r(high).alias("difference_ci_high"),
        r(F.col("__x.odds_ratio")).alias("odds_ratio"), r(F.col("__x.low")).alias("odds_ratio_ci_low"),
        r(F.col("__x.high")).alias("odds_ratio_ci_high"), F.col("__x.p").alias("fisher_p"),
    )
    strata = mantel_haenszel(tables, [*by, "smell"])
    out = out.join(strata.withColumn("mh_odds_ratio", r(F.col("mh_odds_ratio"))), [*by, "smell"], "left")
    out = out.na.fill(1.0, ["mh_p"]).withColumn("mh_odds_ratio", F.coalesce("mh_odds_ratio", F.lit(math.nan)))
    counted = F.lit(True) if adjust_all else ~F.col("smell").isin(ANY, NONE)
    tested, rest = out.where(counted), out.where(~counted)
    tested = adjust(adjust(tested, "fisher_p", "fisher_p_adjusted", by), "mh_p", "mh_p_adjusted", by)
    rest = rest.withColumns({"fisher_p_adjusted": F.lit(math.nan), "mh_p_adjusted": F.lit(math.nan)})
    full = tested.unionByName(rest)
    mark = lambda c: F.when(c, "x").otherwise("")
    significant = {n: mark(F.col(p) < ALPHA) for n, p in (("significant", "fisher_p_adjusted"), ("mh_significant", "mh_p_adjusted"))}
    full = full.withColumns(significant)
    ratio = F.col("mh_odds_ratio")
    same = ((F.col("difference_pp") > 0) & (ratio > 1)) | ((F.col("difference_pp") < 0) & (ratio < 1))
    agrees = same & (F.col("significant") == F.col("mh_significant"))
    return full.withColumn("sensitivity_agrees", F.when(counted, mark(agrees)).otherwise(""))


def robust_smells(table: DataFrame, focal: str, baseline: str, alpha: float = ALPHA) -> DataFrame:
    """Smells that are significant both ways, sorted."""
    hit = (F.col("focal_group") == focal) & (F.col("baseline_group") == baseline)
    hit = hit & (F.col("fisher_p_adjusted") < alpha) & (F.col("mh_p_adjusted") < alpha) & ~F.col("smell").isin(ANY, NONE)
    return table.where(hit).select("smell").distinct().orderBy("smell")


def top_smells(table: DataFrame, focal: str, baseline: str, n: int) -> DataFrame:
    """The n smells of greatest difference; ties by name."""
    hit = (F.col("focal_group") == focal) & (F.col("baseline_group") == baseline) & ~F.col("smell").isin(ANY, NONE)
    return table.where(hit).select("smell", "difference_pp").orderBy(F.desc("difference_pp"), "smell").limit(n)


def smell_differences(unique: DataFrame, group: str, focal: str, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """focal percent - baseline percent of every smell."""
    counts = smell_counts(unique, [*by, group]).where(~F.col("smell").isin(ANY, NONE))
    is_focal = F.col(group) == focal
    sizes = unique.groupBy(*by).agg(F.count_if(is_focal).alias("__f"), F.count_if(F.col(group) == baseline).alias("__g"))
    n = counts.groupBy(*by, "smell").agg(
        F.sum(F.when(is_focal, F.col("smell_n")).otherwise(0)).alias("__a"),
        F.sum(F.when(F.col(group) == baseline, F.col("smell_n")).otherwise(0)).alias("__c"),
    )
    full = n.join(sizes, list(by)) if by else n.crossJoin(F.broadcast(sizes))
    difference = text.percent(F.col("__a"), F.col("__f")) - text.percent(F.col("__c"), F.col("__g"))
    return full.select(*by, "smell", text.round_even(difference).alias("difference"))


def union_of_tops(differences: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Smells among the first n of any stratum, by best rank, then greatest difference, then name."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("difference"), "smell"))
    best = differences.withColumn("__rank", rank).where(F.col("__rank") <= n).groupBy("smell").agg(
        F.min("__rank").alias("rank"), F.max("difference").alias("difference")
    )
    return best.orderBy("rank", F.desc("difference"), "smell")


def size_controlled(unique: DataFrame, controls: DataFrame, group: str, focal: str, baseline: str, smells: Sequence[str]) -> DataFrame:
    """``association`` within size groups for chosen smells and ROBUST (any of them), adjusted over all rows of a stratum.

    controls: from_url, control_group.
    """
    chosen = F.array(*[F.lit(s) for s in smells])
    kept = F.array_intersect(text.split_smells(F.col("smells")), chosen)
    marked = F.when(F.size(kept) > 0, F.concat(kept, F.array(F.lit("ROBUST")))).otherwise(kept)
    rows = unique.withColumn("smells", F.array_join(marked, " ")).join(controls, "from_url")
    out = association(rows, group, focal, baseline, by=["control_group"], adjust_all=True)
    pseudo = out.where(F.col("smell").isin(ANY, NONE))
    own = out.join(pseudo.select("smell").distinct(), "smell", "left_anti")
    own = own.drop("fisher_p_adjusted", "mh_p_adjusted")
    own = adjust(adjust(own, "fisher_p", "fisher_p_adjusted", ["control_group"]), "mh_p", "mh_p_adjusted", ["control_group"])
    mark = lambda c: F.when(c, "x").otherwise("")
    return own.withColumns(
        {"significant": mark(F.col("fisher_p_adjusted") < ALPHA), "mh_significant": mark(F.col("mh_p_adjusted") < ALPHA)}
    )


def size_correlations(methods: DataFrame, smells: Sequence[str]) -> DataFrame:
    """Pearson, Spearman and Kendall of loc and the number of chosen smells; null with one distinct value.

    methods: loc, smells. Values are summed up by (loc, count) before any rank or pair is made.
    """
    chosen = F.array(*[F.lit(s) for s in smells])
    count = F.size(F.array_intersect(text.split_smells(F.col("smells")), chosen))
    pairs = methods.select(F.col("loc").cast("double").alias("x"), count.cast("double").alias("y"))
    joint = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    ranks = joint
    for c in ("x", "y"):
        sums = joint.groupBy(c).agg(F.sum("n").alias("__t"))
        below = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct value
        mid = sums.select(c, (F.coalesce(F.sum("__t").over(below), F.lit(0)) + (F.col("__t") + 1) / 2).alias(f"r{c}"))
        ranks = ranks.join(mid, c)

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, times = (pdf[c].tolist() for c in ("x", "y", "n"))
        rows = [("kendall", *statistics.kendall_of_counts(x, y, times))] if len(set(x)) > 1 < len(set(y)) else [("kendall", None, None)]
        return pd.DataFrame(rows, columns=["correlation_algorithm", "correlation", "p_value"])

    schema = "correlation_algorithm string, correlation double, p_value double"
    kendall = joint.groupBy(F.lit(0).alias("__k")).applyInPandas(lambda pdf: tau(pdf), schema)
    n, linear = F.sum("n").cast("double"), []
    for name, a, b in (("pearson", "x", "y"), ("spearman", "rx", "ry")):
        w = F.col("n")
        sa, sb, saa, sbb, sab = (F.sum(w * v) for v in (F.col(a), F.col(b), F.col(a) * F.col(a), F.col(b) * F.col(b), F.col(a) * F.col(b)))
        spread = (n * saa - sa * sa) * (n * sbb - sb * sb)
        value = F.when(spread > 0, (n * sab - sa * sb) / F.sqrt(spread))
        one = ranks.agg(value.alias("correlation"), n.alias("__n"))
        t = F.col("correlation") * F.sqrt((F.col("__n") - 2) / F.greatest(1 - F.col("correlation") * F.col("correlation"), F.lit(1e-300)))
        p = F.when(F.col("correlation").isNotNull(), statistics.t_two_sided_column(F.coalesce(t, F.lit(0.0)), F.col("__n") - 2))
        linear.append(one.select(F.lit(name).alias("correlation_algorithm"), "correlation", p.alias("p_value")))
    out = linear[0].unionByName(linear[1]).unionByName(kendall)
    return out.withColumn("effect_size", statistics.correlation_size(F.col("correlation")))
