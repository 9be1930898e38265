"""Review data: progress, updates of labels and tags, related methods, timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import dates, tags, text
from weftline.operators.evaluation import PAIR
from weftline.operators.relational import ORD, append_after_group, carry_values, first_source, keep_first, union_all
from weftline.session import cut_lineage

LAGGED_DAYS = 7


# ---- progress -------------------------------------------------------------------------------


def test_progress(truth: DataFrame) -> DataFrame:
    """Per test: rows, labelled, true, non-candidates, tags, notes; incomplete tests first."""
    label = F.trim(text.blank(F.col("label").cast("string")))
    candidate = F.trim(text.blank(F.col("candidate").cast("string")))
    rows = truth.groupBy("from_url").agg(
        F.min(ORD).alias(ORD), F.count(F.lit(1)).alias("total"), F.count_if(label.isin("0", "1")).alias("labelled"),
        F.count_if(label == "1").alias("true_links"), F.count_if(candidate.isin("", "0")).alias("non_candidates"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags.review_tags(F.col("tags")))))).alias("tags"),
        F.array_sort(F.collect_set(F.when(F.trim(text.blank(F.col("notes"))) != "", F.trim("notes")))).alias("notes"),
    )
    return rows.withColumn("complete", F.col("labelled") == F.col("total")).orderBy("complete", ORD)


def project_progress(truth: DataFrame, by: str = "project") -> DataFrame:
    """rows, tests and complete tests of each project."""
    label = F.trim(text.blank(F.col("label").cast("string"))).isin("0", "1")
    a_test = truth.groupBy(by, "from_url").agg(F.count(F.lit(1)).alias("__n"), F.count_if(label).alias("__done"))
    return a_test.groupBy(by).agg(
        F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("tests"),
        F.count_if(F.col("__n") == F.col("__done")).alias("complete_tests"),
    )


def scope_progress(rows: DataFrame, scope: Column) -> DataFrame:
    """labelled, total and percent within a scope; "0" is a label."""
    label = F.trim(text.blank(F.col("label").cast("string"))) != ""
    counts = rows.where(scope).agg(F.count_if(label).alias("labelled"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("percent", text.percent(F.col("labelled"), F.col("total")))


def tag_dictionary(truth: DataFrame, column: str = "tags") -> DataFrame:
    """Distinct tags, whatever the case in order."""
    names = truth.select(F.explode(tags.review_tags(F.col(column))).alias("tag")).distinct()
    return names.orderBy(F.lower("tag"), "tag")


def candidates_of(truth: DataFrame, from_url: str) -> DataFrame:
    return truth.where(F.col("from_url") == from_url).orderBy(ORD)


# ---- changes --------------------------------------------------------------------------------


def update_labels(truth: DataFrame, updates: DataFrame) -> DataFrame:
    """New labels (blank, 0 or 1) for all rows of a pair; two labels or an unknown pair are errors."""
    label = F.trim(text.blank(F.col("label").cast("string")))
    summed = updates.select(*PAIR, label.alias("label")).groupBy(*PAIR).agg(F.min("label").alias("a"), F.max("label").alias("b"))
    bad = summed.where("a <> b OR a NOT IN ('', '0', '1')")
    lost = summed.join(truth.select(*PAIR), PAIR, "left_anti")
    if not bad.isEmpty() or not lost.isEmpty():
        raise ValueError("an update has two labels, an unknown label or no matching row")
    return carry_values(truth, summed.select(*PAIR, F.col("a").alias("label"), F.lit(0).alias(ORD)), PAIR, ["label"])


def update_note(rows: DataFrame, from_url: str, to_url: str, values: dict[str, str]) -> DataFrame:
    """Sets values in the first row of a pair only."""
    hit = (F.col("from_url") == from_url) & (F.col("to_url") == to_url)
    first = rows.where(hit).agg(F.min(ORD)).first()[0]
    if first is None:
        raise ValueError("no such pair")
    return rows.withColumns({c: F.when(F.col(ORD) == first, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_test(truth: DataFrame, from_url: str) -> DataFrame:
    return truth.where(~F.col("from_url").eqNullSafe(from_url))


def delete_pair(truth: DataFrame, from_url: str, to_url: str) -> DataFrame:
    return truth.where(~(F.col("from_url").eqNullSafe(from_url) & F.col("to_url").eqNullSafe(to_url)))


def insert_candidate(truth: DataFrame, methods: DataFrame, from_url: str, to_url: str) -> DataFrame:
    """A new row for a pair, after the test's last row: the test's own columns, the method's as to_ columns,
    depth 1, not a candidate. A pair that is there, or an unknown test or method, is an error."""
    own = truth.where(F.col("from_url") == from_url)
    if not own.where(F.col("to_url") == to_url).isEmpty():
        raise ValueError("the pair is there already")
    method = methods.where(F.col("url") == to_url).orderBy(ORD).limit(1)
    method = method.select([F.col(c).alias(f"to_{c}") for c in methods.columns if c != ORD and f"to_{c}" in truth.columns])
    test = own.orderBy(F.desc(ORD)).limit(1).select(*[c for c in truth.columns if c.startswith("from_") or c in ("project", ORD)])
    row = test.crossJoin(method).withColumns({"candidate": F.lit("0"), "to_call_depth": F.lit("1")})  # one row each
    if row.isEmpty():
        raise ValueError("no such test or method")
    kinds = dict(truth.dtypes)
    row = row.select(*[F.col(c).cast(kinds[c]).alias(c) for c in row.columns if c in kinds])
    return append_after_group(truth, row, PAIR, "from_url")


def rename_tag(truth: DataFrame, old: str, new: str, column: str = "tags") -> DataFrame:
    """Replaces a token in every tag list; nothing else changes."""
    tokens = F.split(text.blank(F.col(column)), " ")
    return truth.withColumn(column, F.array_join(F.transform(tokens, lambda t: F.when(t == old, new).otherwise(t)), " "))


def review_rows(current: DataFrame, existing: DataFrame, identity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Current rows with the review values they had; identity columns stay current."""
    return carry_values(current, existing, PAIR, [c for c in columns if c not in identity])


def refresh_manual(truth: DataFrame, methods: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Selected from_ and to_ columns anew from the method table, where the method is known."""
    out = truth
    for side in ("from", "to"):
        names = [c.removeprefix(f"{side}_") for c in columns if c.startswith(f"{side}_")]
        if names:
            first = methods.groupBy(F.col("url").alias(f"{side}_url")).agg(
                F.min_by(F.struct(*names), ORD).alias("__m")
            )
            out = out.join(first, f"{side}_url", "left")
            out = out.withColumns({f"{side}_{n}": F.coalesce(F.col(f"__m.{n}"), F.col(f"{side}_{n}")) for n in names}).drop("__m")
    return out.select(truth.columns)


def with_links(rows: DataFrame, base: str) -> DataFrame:
    """A derived review URL of every row."""
    query = [F.concat(F.lit(f"{p}="), F.url_encode(text.blank(F.col(p)))) for p in ("project", "tool", "from_url", "to_url") if p in rows.columns]
    return rows.withColumn("revision_url", F.concat(F.lit(base.rstrip("/") + "/revision?"), F.array_join(F.array(*query), "&")))


# ---- histories ------------------------------------------------------------------------------


def timeline(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Commits of two methods side by side, latest first. Both: by, commit, ts, place."""
    a = left.select(*by, "commit", F.col("ts").alias("ts_left"), F.col("place").alias("place_left"))
    b = right.select(*by, "commit", F.col("ts").alias("ts_right"), F.col("place").alias("place_right"))
    rows = a.join(b, [*by, "commit"], "full").withColumn("ts", F.greatest("ts_left", "ts_right"))
    return rows.orderBy(*by, F.desc_nulls_last("ts"), F.coalesce("place_left", "place_right"), "commit")


def nearest_gap(events: DataFrame, others: DataFrame, time: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """``events`` with gap_days: days to the nearest event of the other side, before or after; null if none.

    An as-of join both ways: one sort of both sides by ranges of (by, time), no pairing.  A group, or
    all rows where ``by`` is empty, may lie in many ranges: each range adds the latest other before
    it and the earliest after it, one row a group and range.
    """
    rows = union_all(
        [events.withColumn("__mine", F.lit(True)), others.select(*by, time).withColumn("__mine", F.lit(False))]
    ).withColumn("__other", F.when(~F.col("__mine"), F.col(time)))
    placed = cut_lineage(rows.repartitionByRange(*by, time).withColumn("__part", F.spark_partition_id()))
    here, so_far = Window.partitionBy(*by, "__part"), (Window.unboundedPreceding, Window.currentRow)
    # Both frames grow from the start: one that ends at the last row is computed anew for each row.
    placed = placed.withColumns(
        {
            "__before": F.max("__other").over(here.orderBy(F.asc(time)).rangeBetween(*so_far)),
            "__after": F.min("__other").over(here.orderBy(F.desc(time)).rangeBetween(*so_far)),
        }
    )
    ranges = Window.partitionBy(*by)
    preceding = (Window.unboundedPreceding, -1)
    ends = placed.groupBy(*by, "__part").agg(F.max("__other").alias("__last"), F.min("__other").alias("__first"))
    ends = ends.select(
        *[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__range"),
        F.max("__last").over(ranges.orderBy(F.asc("__part")).rowsBetween(*preceding)).alias("__earlier"),
        F.min("__first").over(ranges.orderBy(F.desc("__part")).rowsBetween(*preceding)).alias("__later"),
    )
    same = F.col("__part") == F.col("__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    seen = placed.where("__mine").join(ends, same)
    before, after = F.coalesce("__before", "__earlier"), F.coalesce("__after", "__later")
    gap = F.least(dates.days_between(F.col(time), before), dates.days_between(F.col(time), after))
    return seen.select(*[c for c in rows.columns if not c.startswith("__")], gap.alias("gap_days"))


def calling_tests(sources: Sequence[tuple[str, DataFrame]], by: Sequence[str] = ()) -> DataFrame:
    """The tests of every method from the first source that knows any, with the source's name: the
    related lookup in reverse, for all methods at once. Sources: by, from_url, to_url, ordinal."""
    keys = [*by, "to_url"]
    first = first_source([(name, keep_first(df, [*keys, "from_url"])) for name, df in sources], keys)
    return first.select(*keys, "from_url", "source", ORD)


def pair_summary(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shared and own commits, the nearest gap, and a label: direct, lagged (within a week) or separate."""
    a, b = left.select(*by, "commit", "ts"), right.select(*by, "commit", "ts")
    keys = [*by, "commit"]
    marks = a.select(*keys).distinct().withColumn("__a", F.lit(1)).join(b.select(*keys).distinct().withColumn("__b", F.lit(1)), keys, "full")
    counts = marks.groupBy(*by).agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"),
        F.count_if(F.col("__b").isNull()).alias("left_only"), F.count_if(F.col("__a").isNull()).alias("right_only"),
    )
    gaps = nearest_gap(a, b, "ts", by).groupBy(*by).agg(F.min("gap_days").alias("gap_days"))
    out = counts.join(gaps, list(by), "left") if by else counts.crossJoin(F.broadcast(gaps))
    label = F.when(F.col("shared") > 0, "direct").when(F.col("gap_days") <= LAGGED_DAYS, "lagged").otherwise("separate")
    return out.withColumn("label", label)


def change_comparison(pair: DataFrame, changes: Sequence[str], always: Sequence[str] = ("ch_all", "ch_diff")) -> DataFrame:
    """(change, from_count, to_count) in order; rows of two zeros drop out but for the totals."""
    entries = ", ".join(f"{i}, '{c}', CAST(from_{c} AS BIGINT), CAST(to_{c} AS BIGINT)" for i, c in enumerate(changes))
    rows = pair.select(F.expr(f"stack({len(changes)}, {entries}) AS (place, change, from_count, to_count)"))
    used = (F.col("from_count") != 0) | (F.col("to_count") != 0) | F.col("change").isin(*always)
    return rows.where(used).orderBy("place").drop("place")
