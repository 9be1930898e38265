"""Comparisons of revision groups over every dimension at once: one scan, counted once.

The revision groups of all change types are unpivoted, methods are reduced once for every
(dimensions, change), and what follows works on counts: a histogram of smell counts by stratum and
group, from which every pair of groups takes its two columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators.revisions import mann_whitney, rank_sums_of_histogram, sign, size_markers
from weftline.operators.smells import ANY, NONE, normal_group

# The dimensions of a linked frame and the stratum of all methods.
DIMENSIONS = ("strategy", "tool", "smell_detector")
EVERY = "ALL"


#: Smells of one integer of a set, and of all integers; with more the sets are arrays.
WORD, MOST_MARKED = 63, 504


def grouped_methods(frame: DataFrame, changes: Sequence[str], groups: Sequence[str], dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(dims, change, from_url, rg_group, smells as an array): a row for each method, once.

    A method counts for a change type if its rows in ``groups`` name one group only; its smells are
    those of all these rows.  Change types without a column rg_<change> have no rows.
    """
    there = [c for c in changes if f"rg_{c}" in frame.columns]
    names = smell_names(frame) if there and len(set(groups)) <= WORD else None
    if names is not None:
        return marked_methods(frame, there, list(dict.fromkeys(groups)), names, dims)
    sides = F.array(*[F.struct(F.lit(c).alias("change"), normal_group(F.col(f"rg_{c}")).alias("rg_group")) for c in there])
    rows = frame.select(*dims, "from_url", text.split_smells(F.col("smells")).alias("smells"), F.explode(sides).alias("g"))
    rows = rows.select(*dims, "g.change", "from_url", "g.rg_group", "smells").where(F.col("rg_group").isin(*groups))
    reduced = rows.groupBy(*dims, "change", "from_url").agg(
        F.min("rg_group").alias("rg_group"), F.max("rg_group").alias("__high"), F.array_distinct(F.flatten(F.collect_set("smells"))).alias("smells")
    )
    return reduced.where("rg_group = __high").drop("__high")


def smell_names(frame: DataFrame) -> list[str] | None:
    """The names of all smells, in order, if there are at most MOST_MARKED."""
    cells = frame.select("smells").distinct().select(F.explode(text.split_smells(F.col("smells"))).alias("smell")).distinct()
    found = [r["smell"] for r in cells.limit(MOST_MARKED + 1).collect()]
    return sorted(found) if len(found) <= MOST_MARKED else None


def marked_methods(frame: DataFrame, changes: Sequence[str], groups: Sequence[str], names: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """``grouped_methods`` with sets as bits: one row a method for all change types is shuffled, of
    integers, which aggregate in place; names come back after it."""
    words = [list(names[i : i + WORD]) for i in range(0, len(names), WORD)] or [[]]
    cell = text.split_smells(F.col("smells"))
    marked = lambda word: F.aggregate(cell, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(_bit(x, word)))
    bits = [marked(word) for word in words]
    group = {c: _bit(normal_group(F.col(f"rg_{c}")), groups) for c in changes}
    rows = frame.select(*dims, "from_url", *[b.alias(f"__s{i}") for i, b in enumerate(bits)], *[g.alias(f"__g_{c}") for c, g in group.items()])
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(f"__g_{c}") != 0 for c in changes]))
    sums = [F.bit_or(f"__g_{c}").alias(f"__g_{c}") for c in changes]
    sums += [F.bit_or(F.when(F.col(f"__g_{c}") != 0, F.col(f"__s{i}")).otherwise(F.lit(0).cast("long"))).alias(f"__s{i}_{c}") for c in changes for i in range(len(words))]
    reduced = rows.groupBy(*dims, "from_url").agg(*sums)
    sides = F.array(*[F.struct(F.lit(c).alias("change"), F.col(f"__g_{c}").alias("g"), *[F.col(f"__s{i}_{c}").alias(f"s{i}") for i in range(len(words))]) for c in changes])
    each = reduced.select(*dims, "from_url", F.explode(sides).alias("x")).where(F.bit_count("x.g") == 1)
    smells = F.concat(*[_named(F.col(f"x.s{i}"), w) for i, w in enumerate(words)])
    return each.select(*dims, "x.change", "from_url", F.element_at(_named(F.col("x.g"), groups), 1).alias("rg_group"), smells.alias("smells"))


def _bit(value: Column, names: Sequence[str]) -> Column:
    """The bit of a name, 0 for others and null."""
    if not names:
        return F.lit(0).cast("long")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    bit = F.get(F.array(*[F.lit(1 << i).cast("long") for i in range(len(names))]), (place - 1).cast("int"))
    return F.coalesce(bit, F.lit(0).cast("long"))


def _named(bits: Column, names: Sequence[str]) -> Column:
    """The names whose bits are set."""
    if not names:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names)]))


def comparison_cube(
    frame: DataFrame, changes: Sequence[str], pairs: Sequence[tuple[str, str]], strata: DataFrame | None = None,
    dims: Sequence[str] = DIMENSIONS,
) -> DataFrame:
    """Rank test of smell counts for every dimension, change type, pair of groups and stratum.

    ``strata`` gives (from_url, loc_group); the stratum ALL has every method.  Rows exist where both
    groups have methods.
    """
    groups = list(dict.fromkeys(g for pair in pairs for g in pair))
    methods = grouped_methods(frame, changes, groups, dims).withColumn("n", F.size("smells")).drop("smells")
    if strata is not None:
        methods = methods.join(strata.select("from_url", "loc_group"), "from_url", "left")
        own = F.array_compact(F.array(F.lit(EVERY), F.col("loc_group")))
    else:
        own = F.array(F.lit(EVERY))
    by = [*dims, "change", "loc_group"]
    counts = methods.withColumn("loc_group", F.explode(own)).groupBy(*by, "rg_group", "n").agg(F.count(F.lit(1)).alias("__n"))
    sides = F.array(*[F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a, b in pairs])
    split = counts.withColumn("p", F.explode(F.filter(sides, lambda p: F.col("rg_group").isin(*groups) & ((p["g1"] == F.col("rg_group")) | (p["g2"] == F.col("rg_group"))))))
    by = [*by, "g1", "g2"]
    split = split.select(*by[:-2], "p.g1", "p.g2", "rg_group", "n", "__n")
    histogram = split.groupBy(*by, "n").agg(
        F.sum(F.when(F.col("rg_group") == F.col("g1"), F.col("__n")).otherwise(0)).alias("__a"),
        F.sum(F.when(F.col("rg_group") == F.col("g2"), F.col("__n")).otherwise(0)).alias("__b"),
    )
    tested = mann_whitney(rank_sums_of_histogram(histogram, "n", by).where("n1 > 0 AND n2 > 0"))
    middle = medians(histogram, by)
    r = text.round_even
    return tested.join(middle, by).select(
        F.concat_ws(",", "g1", "g2").alias("comparison"), *by[:-2], (F.col("n1") + F.col("n2")).alias("size"), "g1", "g2",
        F.col("n1").alias("g1_size"), F.col("n2").alias("g2_size"), r(F.col("g1_median")).alias("g1_median"), r(F.col("g2_median")).alias("g2_median"),
        r(F.col("u1")).alias("mww_u1"), r(F.col("u2")).alias("mww_u2"), r(F.col("p")).alias("mww_p"), r(F.col("delta")).alias("d_value"),
        sign(F.col("delta")).alias("d_sign"), "effect_size", *[c.alias(m) for m, c in size_markers(F.col("effect_size")).items()],
    )


def medians(histogram: DataFrame, by: Sequence[str], value: str = "n") -> DataFrame:
    """g1_median and g2_median of (by, value, __a, __b), from running counts over distinct values."""
    up_to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    ranked = histogram
    for c in ("__a", "__b"):
        ranked = ranked.withColumns({f"{c}_up": F.sum(c).over(up_to), f"{c}_all": F.sum(c).over(whole)})
    at = lambda c, k: F.min(F.when(F.col(f"{c}_up") >= k, F.col(value)))
    middle = {}
    for name, c in (("g1_median", "__a"), ("g2_median", "__b")):
        low, high = F.ceil(F.col(f"{c}_all") / 2), F.floor(F.col(f"{c}_all") / 2) + 1
        middle[name] = (at(c, low) + at(c, high)) / 2
    return ranked.groupBy(*by).agg(*[m.alias(name) for name, m in middle.items()])


def prevalence_cube(frame: DataFrame, changes: Sequence[str], groups: Sequence[str], dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """methods, smell_n and percent of every smell and group, for every dimension and change type.

    Smells are those that any group of the same dimensions and change has, with any and none;
    pairs without methods stay as zeros.
    """
    by = [*dims, "change"]
    methods = grouped_methods(frame, changes, groups, dims)
    marks = F.concat(F.when(F.size("smells") > 0, F.array(F.lit(ANY))).otherwise(F.array(F.lit(NONE))), F.col("smells"))
    counts = methods.select(*by, "rg_group", F.explode(marks).alias("smell")).groupBy(*by, "rg_group", "smell").agg(F.count(F.lit(1)).alias("smell_n"))
    sizes = methods.groupBy(*by, "rg_group").agg(F.count(F.lit(1)).alias("methods"))
    both = sizes.select(*by).distinct().withColumn("smell", F.explode(F.array(F.lit(ANY), F.lit(NONE))))
    names = counts.select(*by, "smell").unionByName(both).distinct()
    grid = names.withColumn("rg_group", F.explode(F.array(*[F.lit(g) for g in groups])))
    full = grid.join(sizes, [*by, "rg_group"], "left").join(counts, [*by, "rg_group", "smell"], "left").na.fill(0, ["methods", "smell_n"])
    return full.select(*by, "rg_group", "smell", "methods", "smell_n", text.percent(F.col("smell_n"), F.col("methods")).alias("percent"))


def greatest_cube(prevalence: DataFrame, pairs: Sequence[tuple[str, str]], n: int, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """The ``n`` smells whose percentages differ most between the groups of each pair (ties by name)."""
    by = [*dims, "change"]
    share = F.map_from_entries(F.collect_list(F.struct("rg_group", "percent")))  # one entry a group
    wide = prevalence.where(~F.col("smell").isin(ANY, NONE)).groupBy(*by, "smell").agg(share.alias("__p"))
    sides = F.array(*[F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a, b in pairs])
    rows = wide.withColumn("p", F.explode(sides)).select(*by, "smell", "p.g1", "p.g2", "__p")
    rows = rows.withColumn("difference", text.round_even(F.element_at("__p", F.col("g1")) - F.element_at("__p", F.col("g2")))).drop("__p")
    rank = F.row_number().over(Window.partitionBy(*by, "g1", "g2").orderBy(F.desc("difference"), "smell"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)
