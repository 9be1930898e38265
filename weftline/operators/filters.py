"""Selection and projection: populations, named selections, column families."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import tags, text
from weftline.operators.relational import ORD, attach_code

DEFAULT_ARTIFACTS = ("main-code", "test-code")
# Commit change types, and the names of their counts, in order.
CHANGE_TYPES = {
    "Yintroduced": "introduction", "Ymovefromfile": "move", "Ybodychange": "body",
    "Ydocumentationchange": "documentation", "Yfilerename": "file_move", "Yrename": "rename",
    "Ymodifierchange": "modifier", "Yreturntypechange": "return_type", "Yexceptionschange": "exception",
    "Yparameterchange": "parameter", "Yparametermetachange": "parameter_meta", "Yannotationchnage": "annotation",
    "Yformatchange": "format", "Ymultichange": "multi",
}
CHANGES = ("ch_all", "ch_diff", *(f"ch_{name}" for name in CHANGE_TYPES.values()))


def by_artifact(df: DataFrame, selected: Sequence[str] | None = DEFAULT_ARTIFACTS, column: str = "artifact") -> DataFrame:
    """Rows with one of the selected tags; everything if unrestricted or without the column."""
    if selected is None or column not in df.columns:
        return df
    return df.where(F.arrays_overlap(tags.split_tags(F.col(column)), F.array(*[F.lit(s) for s in selected])))


def concrete(df: DataFrame) -> DataFrame:
    """Rows whose abstract flag is 0; flags that are neither 0 nor 1 drop out."""
    return df.where(text.number(F.col("abstract")) == 0)


def invalid_abstract(df: DataFrame) -> DataFrame:
    """(project, invalid, rows) for projects with abstract flags that are neither 0 nor 1."""
    valid = F.coalesce(text.number(F.col("abstract")).isin(0.0, 1.0), F.lit(False))
    counts = df.groupBy("project").agg(F.count_if(~valid).alias("invalid"), F.count(F.lit(1)).alias("rows"))
    return counts.where("invalid > 0")


def base_population(df: DataFrame) -> DataFrame:
    """Concrete test cases and production methods, with method_kind."""
    return concrete(df).withColumn("method_kind", tags.method_kind(F.col("artifact"))).where("method_kind IS NOT NULL")


def without_trivial_production(df: DataFrame) -> DataFrame:
    """Drops production rows whose code is empty or a short accessor."""
    trivial = text.is_trivial(F.col("name"), F.col("start_line"), F.col("end_line"), F.col("code"))
    return df.where(~((F.col("method_kind") == tags.PRODUCTION_KIND) & trivial))


def revision_population(methods: DataFrame, code: DataFrame) -> DataFrame:
    """The population of the revision study: base filter, code attached, no trivial production."""
    return without_trivial_production(attach_code(base_population(methods), code))


def only_with(df: DataFrame, right: DataFrame, key: str = "from_url") -> DataFrame:
    """Rows whose key exists on the right."""
    return df.join(right.select(key).distinct(), key, "left_semi")


def test_to_production(links: DataFrame) -> DataFrame:
    """Links from a test case to main code."""
    return links.where(
        tags.has_tag(F.col("from_artifact"), "test-case-method") & tags.has_tag(F.col("to_artifact"), "main-code")
    )


def drop_helpers(df: DataFrame, helpers: Sequence[str] = ("from_fqs_alt", "to_fqs_alt")) -> DataFrame:
    return df.drop(*helpers)


def large_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows (all if that is not positive).

    The counts meet the rows in a join, so a large group stays spread.
    """
    if least <= 0:
        return df
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(group)
    return df.join(counts, group, "left_semi")


def qualifying_pairs(df: DataFrame, changes: Sequence[str], least: float) -> DataFrame:
    """Rows where for any change both counts are numbers and from - to reaches ``least``."""
    hit = [
        F.coalesce(text.number(F.col(f"from_{c}")) - text.number(F.col(f"to_{c}")) >= least, F.lit(False))
        for c in changes
    ]
    return df.where(reduce(lambda a, b: a | b, hit))


def search(df: DataFrame, query: str, columns: Sequence[str], limit: int = 25) -> DataFrame:
    """The first rows (by ordinal) in which a column holds the text, whatever the case."""
    hit = [F.contains(F.lower(text.blank(F.col(c))), F.lit(query.strip().lower())) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hit)).orderBy(ORD).limit(limit)


def null_columns(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns})


def reset_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blanks columns, all of which must exist."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit("") for c in columns})


def alias_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """For every name its first existing alias, else blank."""
    found = {}
    for name, options in aliases.items():
        source = next((o for o in (name, *options) if o in df.columns), None)
        found[name] = F.col(source) if source else F.lit("")
    return df.withColumns(found)


def change_columns(
    columns: Sequence[str], selected: Sequence[str] | None = None, preferred: Sequence[str] = CHANGES, extra: bool = False
) -> list[str]:
    """The change columns among ``columns``: preferred order first, others only on request."""
    there = [c for c in columns if c.startswith("ch_")]
    if selected is not None:
        wanted = {s if s.startswith("ch_") else f"ch_{s}" for s in selected}
        there = [c for c in there if c in wanted]
    first = [c for c in preferred if c in there]
    return first + [c for c in there if c not in first and extra]


def order_change_columns(df: DataFrame) -> DataFrame:
    """Other columns first, then the change counts in order."""
    changes = change_columns(df.columns, extra=True)
    return df.select(*[c for c in df.columns if c not in changes], *changes)


def tool_after_project(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in ("project", "tool")]
    return df.select("project", "tool", *rest)


def complete_changes(df: DataFrame, changes: Sequence[str]) -> list[str]:
    """Changes that both ends of the links have."""
    return [c for c in changes if {f"from_{c}", f"to_{c}"} <= set(df.columns)]


# ---- named and positional selections (driver side) ------------------------------------------


def parse_names(value: str | Sequence[str] | None, unrestricted: str = ":") -> list[str] | None:
    """Names of a comma list, each once; None where nothing restricts."""
    if value is None:
        return None
    parts = value.split(",") if isinstance(value, str) else [p for v in value for p in v.split(",")]
    names = list(dict.fromkeys(p.strip() for p in parts if p.strip()))
    return None if not names or unrestricted in names else names


def select_named(items: Sequence[str], selected: Sequence[str] | None, strict: bool = True, label: str = "item") -> list[str]:
    """Selected items in the order of the selection; unknown names are an error if strict."""
    if selected is None:
        return list(items)
    known = set(items)
    unknown = [s for s in selected if s not in known]
    if unknown and strict:
        raise ValueError(f"unknown {label}: {', '.join(unknown)}")
    return list(dict.fromkeys(s for s in selected if s in known))


def parse_index(value: str | None, size: int, strict: bool = False) -> list[int] | None:
    """Positions named by ``0:10``, ``::2``, ``-1``, ``0,2,4`` or ``:`` (None: all)."""
    if value is None or value.strip() in ("", ":"):
        return None
    found: list[int] = []
    for token in (t.strip() for t in value.split(",")):
        if not token:
            continue
        if ":" in token:
            bounds = [int(p) if p.strip() else None for p in token.split(":")]
            found += range(*slice(*bounds).indices(size))
        else:
            at = int(token) + (size if int(token) < 0 else 0)
            if 0 <= at < size:
                found.append(at)
            elif strict:
                raise IndexError(f"no item {token} among {size}")
    return list(dict.fromkeys(found))


def select_projects(
    catalog: Sequence[str], names: Sequence[str] | None = None, index: str | None = None, strict: bool = True
) -> list[str]:
    """Projects in catalog order that are named and lie in the index slice."""
    if names is not None:
        select_named(catalog, names, strict, "project")
    places = parse_index(index, len(catalog))
    return [
        p
        for i, p in enumerate(catalog)
        if (names is None or p in set(names)) and (places is None or i in set(places))
    ]


def resolve_filters(
    given: dict[str, str | None], environment: dict[str, str], config: dict[str, str]
) -> dict[str, list[str] | None]:
    """Tools, projects and strategies: what is given, else the environment, else the configuration."""
    return {
        key: parse_names(next((v for v in (given.get(key), environment.get(key), config.get(key)) if v is not None), None))
        for key in ("tools", "projects", "strategies")
    }


def slice_projects(projects: DataFrame, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """A positional slice of the project table by its ordinal."""
    place = F.row_number().over(Window.orderBy(ORD)) - 1
    numbered = projects.withColumn("__place", place)
    hit = (F.col("__place") - (start or 0)) % step == 0
    hit = hit & (F.col("__place") >= (start or 0))
    if stop is not None:
        hit = hit & (F.col("__place") < stop)
    return numbered.where(hit).drop("__place")
