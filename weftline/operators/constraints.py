"""Constraints and counters that ride on the pass which writes a frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftline.operators.relational import ORD


def required(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` as it is; the job that computes it fails at the first row that breaks a rule (null breaks
    it too), with the rule's name.  Nothing is read twice."""
    for name, rule in rules.items():
        df = df.where(F.assert_true(F.coalesce(rule, F.lit(False)), F.lit(name)).isNull())
    return df


def counted(df: DataFrame, counts: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates observed by the job that writes it: ``observation.get`` has them then."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def first_of_test(rows: DataFrame, test: str = "from_url", order: str = ORD) -> DataFrame:
    """``rows`` with first_row: whether it is the test's first one."""
    place = F.row_number().over(Window.partitionBy(test).orderBy(order))
    return rows.withColumn("first_row", place == 1)


def body_counts() -> dict[str, Column]:
    """For ``counted`` over ``first_of_test``: tests, and those whose first row has no body."""
    empty = F.coalesce(F.length("body"), F.lit(0)) == 0
    return {"tests": F.count_if("first_row"), "without_body": F.count_if(F.col("first_row") & empty)}


def check_bodies(counts: Mapping[str, int], source: str = "method code") -> None:
    """An error where tests came without a body; ``counts`` are those of ``body_counts``."""
    if counts["without_body"]:
        raise ValueError(f"{counts['without_body']} of {counts['tests']} tests have no body; check the coverage of {source}")


def coverage(rows: DataFrame, by: Sequence[str] = ("project",)) -> DataFrame:
    """Tests and tests without a body of each group."""
    return first_of_test(rows).groupBy(*by).agg(*[c.alias(n) for n, c in body_counts().items()])
