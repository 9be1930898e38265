"""Link selection: strategies as predicates over scored candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators.filters import select_named, test_to_production
from weftline.operators.relational import ORD, attach_both, keep_first
from weftline.operators.scoring import BASE, COMBINED, TECHNIQUES

# Atomic strategies in order of priority, and the scores from which they select.
STRATEGIES = (
    "omc", "nc", "ncc", "lcba", "lc", "max", "lcs-u", "lcs-b", "leven", "tarantula", "tfidf", "combined",
    "gpt-oss-20b", "gpt-oss-120b", "qwen-2d5b", "testlinker", "testlinkerv2",
)
THRESHOLDS = {
    "lcs-u": ("tech_lcs_u", 0.75), "lcs-b": ("tech_lcs_b", 0.55), "leven": ("tech_leven", 0.95),
    "tarantula": ("tech_tarantula", 0.95), "tfidf": ("tech_tfidf", 0.90), "combined": ("tech_combined", 0.85),
}
MODELS = ("gpt-oss-20b", "gpt-oss-120b", "qwen-2d5b")

Predicate = Callable[[DataFrame], Column]
_REGISTRY: dict[str, Predicate] = {}


def register_strategy(key: str, predicate: Predicate) -> None:
    """Adds (or replaces) an atomic strategy."""
    _REGISTRY[key] = predicate


def positive(df: DataFrame, column: str | None) -> Column:
    """Numbers above 0; a missing column selects nothing."""
    if column is None or column not in df.columns:
        return F.lit(False)
    return F.coalesce(text.number(F.col(column)) > 0, F.lit(False))


def at_least(df: DataFrame, column: str, threshold: float) -> Column:
    if column not in df.columns:
        return F.lit(False)
    return F.coalesce(text.number(F.col(column)) >= threshold, F.lit(False))


def model_column(df: DataFrame, key: str) -> str | None:
    """A model's prediction column under any of its spellings."""
    options = [f"tech_{m}{k}" for m in ("llm_", "") for k in (key, key.replace("-", "_"))]
    return next((o for o in options if o in df.columns), None)


for _key in ("nc", "ncc", "lcba", "lc"):
    register_strategy(_key, lambda df, c=f"tech_{_key}": positive(df, c))
for _key, (_column, _least) in THRESHOLDS.items():
    register_strategy(_key, lambda df, c=_column, t=_least: at_least(df, c, t))
for _key in MODELS:
    register_strategy(_key, lambda df, k=_key: positive(df, model_column(df, k)))
for _key in ("testlinker", "testlinkerv2"):
    register_strategy(_key, lambda df, c=f"tech_{_key}": positive(df, c))
register_strategy("max", lambda df: reduce(lambda a, b: a | b, [positive(df, c) for c in TECHNIQUES]))
register_strategy("omc", lambda df: F.col("__targets") == 1)


def parse_strategy(name: str) -> list[str]:
    """Atomic keys of ``a--b`` in order of priority."""
    order = [*STRATEGIES, *[k for k in _REGISTRY if k not in STRATEGIES]]
    parts = select_named(order, [p.lower() for p in name.split("--") if p], label="strategy")
    return [k for k in order if k in parts]


def strategy_key(parts: Sequence[str]) -> str:
    order = [*STRATEGIES, *[k for k in _REGISTRY if k not in STRATEGIES]]
    return "--".join(k for k in order if k in parts) or "none"


def strategy_columns(names: Sequence[str] | None) -> list[str]:
    """The scores that the strategies read; max reads all, combined needs its parts."""
    parts = {p for n in (names or STRATEGIES) for p in parse_strategy(n)}
    wanted = set(TECHNIQUES) if "max" in parts else set()
    wanted |= {f"tech_{p.replace('-', '_')}" for p in parts} & set(TECHNIQUES)
    if COMBINED in wanted:
        wanted |= set(BASE)
    return [c for c in TECHNIQUES if c in wanted]


def with_targets(links: DataFrame, test: str = "from_url", function: str = "to_url") -> DataFrame:
    """Number of distinct targets of each test, joined from an aggregation."""
    counts = links.select(test, function).distinct().groupBy(test).agg(F.count(F.lit(1)).alias("__targets"))
    return links.join(counts, test)


def select_links(links: DataFrame, strategy: str, exclusive: bool = False) -> DataFrame:
    """Rows that any stage of the strategy selects, first row of each pair, by ordinal.

    ``exclusive``: a later stage selects only for tests without a link from an earlier stage.
    """
    parts = parse_strategy(strategy)
    rows = with_targets(links) if "omc" in parts else links
    stages = [_REGISTRY[p](rows) for p in parts]
    if not exclusive:
        kept = rows.where(reduce(lambda a, b: a | b, stages))
    else:
        stage = reduce(lambda rest, ks: F.when(ks[1], ks[0]).otherwise(rest), reversed(list(enumerate(stages))), F.lit(None))
        staged = rows.withColumn("__stage", stage.cast("int")).where("__stage IS NOT NULL")
        best = staged.groupBy("from_url").agg(F.min("__stage").alias("__best"))
        kept = staged.join(best, "from_url").where("__stage = __best").drop("__stage", "__best")
    return keep_first(kept, ["from_url", "to_url"]).drop("__targets")


def tech_files(catalog: DataFrame, files: DataFrame, projects: Sequence[str] | None = None) -> DataFrame:
    """The scored files that exist for the selected projects, in catalog order.

    catalog: project, ordinal; files: path (named by project).
    """
    stem = F.url_decode(F.regexp_replace(F.substring_index("path", "/", -1), r"\.csv$", ""))
    rows = catalog.select("project", ORD).join(files.withColumn("project", stem), "project")
    return (rows if projects is None else rows.where(F.col("project").isin(*projects))).orderBy(ORD)


def link_project(scored: DataFrame, methods: DataFrame, strategy: str) -> DataFrame:
    """Artifacts attached to both ends, test case to main code only, then the strategy's links.

    The role filter comes after scoring and before selection: the one-target strategy counts targets
    that are main code.
    """
    return select_links(test_to_production(attach_both(scored, methods.select("url", "artifact"))), strategy)
