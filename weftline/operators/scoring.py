"""Traceability scores of test-to-production candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.strings import lcs
from weftline.operators.relational import ORD

#: Scores fall by this factor for each further call level (the value of the published technique).
DISCOUNT = 0.5
# Score columns; those averaged in the combined score; those scaled by a test's best.
BASE = (
    "tech_nc", "tech_ncc", "tech_lcs_b", "tech_lcs_u", "tech_leven", "tech_lcba", "tech_tarantula", "tech_tfidf",
)
SCALED = ("tech_lcs_b", "tech_lcs_u", "tech_leven", "tech_tarantula", "tech_tfidf")
COMBINED = "tech_combined"
TECHNIQUES = (*BASE, COMBINED)


def test_subject(name: Column) -> Column:
    """A lower-case test name without its leading or trailing ``test``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "^test_?", ""), "_?test$", "")


def call_depth(value: Column) -> Column:
    """An integer of at least 1; anything else counts as 1."""
    depth = text.number(value)
    return F.when(depth >= 1, F.floor(depth)).otherwise(1).cast("int")


def name_equality(function: Column, test: Column) -> Column:
    return F.when((function != "") & (test_subject(test) == function), 1).otherwise(0)


def name_containment(function: Column, test: Column) -> Column:
    return F.when((function != "") & F.contains(F.lower(test), function), 1).otherwise(0)


def common_length(function: Column, test: Column) -> Column:
    """Longest common subsequence of a function's name and what a test's name is about."""
    return lcs(function, test_subject(test))


def lcs_both(function: Column, test: Column, common: Column) -> Column:
    longest = F.greatest(F.length(function), F.length(test_subject(test)))
    return F.when(longest > 0, common / longest).otherwise(F.lit(0.0))


def lcs_unit(function: Column, common: Column) -> Column:
    return F.when(function != "", common / F.length(function)).otherwise(F.lit(0.0))


def levenshtein_score(function: Column, test: Column) -> Column:
    subject = test_subject(test)
    longest = F.greatest(F.length(function), F.length(subject))
    return F.when(longest > 0, 1.0 - F.levenshtein(function, subject) / longest).otherwise(F.lit(0.0))


def suspiciousness(callers: Column, tests: Column) -> Column:
    """Of a function under one test: its own pass share against that of all other tests."""
    others = (callers - 1) / (tests - 1)
    return F.when(tests > 1, 1.0 / (1.0 + others)).otherwise(F.lit(0.0))


def inverse_frequency(callers: Column, tests: Column) -> Column:
    return F.ln(tests / callers)


def candidate_pairs(
    candidates: DataFrame, test: str = "from_url", function: str = "to_url", by: Sequence[str] = ()
) -> DataFrame:
    """One row a (test, function) of a project: least depth, whether it stands before an assertion,
    last-seen names."""
    has = set(candidates.columns)
    depth = call_depth(F.col("to_call_depth")) if "to_call_depth" in has else F.lit(1)
    before = F.coalesce(text.number(F.col("to_lcba")) > 0, F.lit(False)) if "to_lcba" in has else F.lit(False)
    lower = lambda c: F.struct(F.col(ORD).alias("o"), F.lower(F.coalesce(F.col(c), F.lit(""))).alias("n"))
    return candidates.groupBy(*by, test, function).agg(
        F.min(depth).alias("depth"),
        F.max(before).alias("before_assert"),
        F.max(lower("from_name")).alias("__from"),
        F.max(lower("to_name")).alias("__to"),
    )


def pair_scores(
    candidates: DataFrame, test: str = "from_url", function: str = "to_url", discount: float = DISCOUNT, by: Sequence[str] = ()
) -> DataFrame:
    """All technique scores of every (test, function) pair, unrounded.

    ``by`` separates projects (null is one, too): tests are counted within. What concerns a function comes from an
    aggregation that is joined back, so a function that every test calls is not gathered; what
    concerns a test, which calls a bounded number of functions, comes from windows over it.
    """
    pairs = candidate_pairs(candidates, test, function, by)
    last = lambda c: F.max(c)["n"]
    a_function = pairs.groupBy(*by, function).agg(F.count(F.lit(1)).alias("__callers"), last("__to").alias("to_name"))
    # One row for each project.
    tests = pairs.select(*by, test).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__tests"))
    own = Window.partitionBy(*by, test)
    rows = null_safe(null_safe(pairs, tests, by), a_function, [*by, function]).withColumns(
        {"__functions": F.count(F.lit(1)).over(own), "from_name": F.max("__from").over(own)["n"]}
    )
    rows = rows.withColumn("__common", common_length(F.col("to_name"), F.col("from_name")))
    name, other = F.col("to_name"), F.col("from_name")
    fall = F.pow(F.lit(discount), F.col("depth") - 1)
    base = {
        "tech_nc": name_equality(name, other).cast("double"),
        "tech_ncc": name_containment(name, other).cast("double"),
        "tech_lcs_b": lcs_both(name, other, F.col("__common")) * fall,
        "tech_lcs_u": lcs_unit(name, F.col("__common")) * fall,
        "tech_leven": levenshtein_score(name, other) * fall,
        "tech_lcba": F.col("before_assert").cast("double"),
        "tech_tarantula": suspiciousness(F.col("__callers"), F.col("__tests")) * fall,
        "tech_tfidf": F.ln(1 + 1 / F.col("__functions")) * inverse_frequency(F.col("__callers"), F.col("__tests")) * fall,
    }
    scored = rows.select(*by, test, function, "depth", *[v.alias(k) for k, v in base.items()])
    of_test = Window.partitionBy(*by, test)
    scale = lambda c: F.when(F.max(c).over(of_test) > 0, F.col(c) / F.max(c).over(of_test)).otherwise(F.col(c))
    scored = scored.withColumns({c: scale(c) for c in SCALED})
    mean = sum((F.col(c) for c in BASE[1:]), F.col(BASE[0])) / len(BASE)
    scored = scored.withColumn(COMBINED, mean)
    return scored.withColumn(COMBINED, scale(COMBINED))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, of which nulls are equal."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys], F.lit(True))
    return left.join(other, same).drop(*[f"__{k}" for k in keys])


def last_call(candidates: DataFrame, test: str = "from_url", by: Sequence[str] = ()) -> DataFrame:
    """``candidates`` with tech_lc: 1 on the last call of each test, by ordinal."""
    last = F.max(ORD).over(Window.partitionBy(*by, test))
    return candidates.withColumn("tech_lc", F.col(ORD).eqNullSafe(last).cast("int"))


def score_candidates(
    candidates: DataFrame, columns: Sequence[str] = TECHNIQUES, discount: float = DISCOUNT, by: Sequence[str] | None = None
) -> DataFrame:
    """Every candidate row with its pair's scores, rounded to two digits; unselected techniques are null.

    Projects (a column project, where there is one, or ``by``) are scored each by itself.
    """
    by = [c for c in ("project",) if c in candidates.columns] if by is None else list(by)
    scored = pair_scores(candidates, discount=discount, by=by)
    picked = [
        text.round_even(F.col(c)).alias(c) if c in columns else F.lit(None).cast("double").alias(c) for c in TECHNIQUES
    ]
    rows = candidates.drop(*[c for c in TECHNIQUES if c in candidates.columns])
    keys = [*by, "from_url", "to_url"]
    return last_call(null_safe(rows, scored.select(*keys, *picked), keys), by=by)


def model_rank(invocations: DataFrame, test: str = "from_url", name: str = "name", score: str = "score") -> DataFrame:
    """Rank of each distinct invocation name of a test by score, ties by first appearance; overloads share it,
    and so do names that tie in both."""
    names = invocations.groupBy(test, name).agg(F.max(score).alias("__score"), F.min(ORD).alias("__first"))
    order = Window.partitionBy(test).orderBy(F.desc("__score"), "__first")
    ranked = names.withColumn("rank", F.dense_rank().over(order)).drop("__score", "__first")
    return invocations.join(ranked, [test, name])


def predict_top(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.withColumn("label_pred", (F.col("rank") <= k).cast("int"))
