"""Regeneration of labelled ground truth from a new call graph, over all projects in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import tags, text
from weftline.operators.relational import ORD, keep_first, union_all
from weftline.operators.sampling import draw
from weftline.session import cut_lineage

# The columns of a ground truth file, in their order.
COLUMNS = (
    "project", "from_name", "to_name", "from_url", "to_url", "from_fqs", "from_tctracer_fqs", "from_testlinker_fqs", "to_fqs",
    "to_tctracer_fqs", "to_testlinker_fqs", "from_artifact", "to_artifact", "to_call_depth", "candidate", "label", "tags", "notes",
)
PROTECTED = ("from_url", "to_url", "label", "tags", "notes")
REVIEW = ("label", "tags", "notes")
KEY = ["project", "from_url", "to_url"]
# Where a row of the result comes from.
WORKING, FRESH, MANUAL, MISSING = "working", "fresh", "manual", "missing"


def update_columns(names: str | None) -> list[str]:
    """The columns of a comma-separated list, once each; unknown and protected ones are an error."""
    columns = list(dict.fromkeys(n.strip() for n in (names or "").split(",") if n.strip()))
    for kind, wrong in (("unknown", [c for c in columns if c not in COLUMNS]), ("protected", [c for c in columns if c in PROTECTED])):
        if wrong:
            raise ValueError(f"{kind} columns: {', '.join(wrong)}")
    return columns


def _shaped(df: DataFrame) -> DataFrame:
    """Every column of a ground truth as text (blank where missing), and the ordinal."""
    there = {c: F.col(c).cast("string") if c in df.columns else F.lit("") for c in COLUMNS}
    if "notes" not in df.columns and "note" in df.columns:
        there["notes"] = F.col("note").cast("string")
    return df.select(*[F.coalesce(v, F.lit("")).alias(c) for c, v in there.items()], ORD)


def _has(column: str) -> Column:
    return F.trim(text.blank(F.col(column).cast("string"))) != ""


def test_pool(edges: DataFrame, methods: DataFrame, exclude: str | None = None) -> DataFrame:
    """(project, from_url, barred) of the test cases that call anything; ``exclude`` is a pattern of
    artifacts that are not drawn, though they stay if they are there already."""
    known = keep_first(methods.select("project", "url", "artifact", ORD), ["project", "url"]).drop(ORD)
    cases = known.where(tags.has_tag(F.col("artifact"), "test-case-method"))
    pool = edges.select("project", "from_url").distinct().join(cases.withColumnRenamed("url", "from_url"), ["project", "from_url"])
    barred = F.rlike("artifact", F.lit(exclude)) if exclude else F.lit(False)
    return pool.select("project", "from_url", barred.alias("barred"))


def selected_tests(pool: DataFrame, working: DataFrame, samples: int, seed: int) -> DataFrame:
    """(project, from_url, reused): every test of the working rows, topped up from the pool to
    ``samples`` a project by a seeded draw."""
    there = working.where(_has("from_url")).select("project", "from_url").distinct()
    have = there.groupBy("project").agg(F.count(F.lit(1)).alias("__have"))
    free = pool.where(~F.col("barred")).join(there, ["project", "from_url"], "left_anti").join(have, "project", "left")
    place = F.row_number().over(Window.partitionBy("project").orderBy(draw(seed, "project", "from_url"), "from_url"))
    added = free.withColumn("__place", place).where(F.col("__place") <= samples - F.coalesce("__have", F.lit(0)))
    return there.withColumn("reused", F.lit(True)).unionByName(added.select("project", "from_url", F.lit(False).alias("reused")))


def fresh_rows(edges: DataFrame, pool: DataFrame, selected: DataFrame, methods: DataFrame) -> DataFrame:
    """The call rows of selected tests of the pool, each pair once at its least depth (numbers first,
    then file order); calls of test code are labelled 0."""
    rows = edges.join(pool.select("project", "from_url"), ["project", "from_url"], "left_semi")
    rows = rows.join(selected.select("project", "from_url"), ["project", "from_url"], "left_semi")
    artifact = keep_first(methods.select("project", "url", "artifact", ORD), ["project", "url"]).drop(ORD)
    for side in ("from", "to"):
        names = artifact.select("project", F.col("url").alias(f"{side}_url"), F.col("artifact").alias("__artifact"))
        rows = rows.drop(f"{side}_artifact").join(names, ["project", f"{side}_url"], "left")
        rows = rows.withColumn(f"{side}_artifact", F.coalesce("__artifact", F.lit(""))).drop("__artifact")
    rows = keep_first(rows, KEY, [F.col("to_call_depth").try_cast("double").asc_nulls_last(), F.col(ORD).asc()])
    rows = _shaped(rows.drop(*REVIEW, "candidate"))
    return rows.withColumn("label", F.when(tags.has_tag(F.col("to_artifact"), "test-code"), "0").otherwise(""))


def with_labels(rows: DataFrame, working: DataFrame) -> DataFrame:
    """Label, tags and notes of a pair's last working row, blank ones too; ``carried`` marks such rows."""
    last = keep_first(working.where(_has("from_url") & _has("to_url")), KEY, [F.desc(ORD)])
    old = last.select(*KEY, *[F.col(c).alias(f"__{c}") for c in REVIEW], F.lit(True).alias("carried"))
    found = rows.join(old, KEY, "left").withColumn("carried", F.coalesce("carried", F.lit(False)))
    return found.withColumns({c: F.when(F.col("carried"), F.col(f"__{c}")).otherwise(F.col(c)) for c in REVIEW}).drop(*[f"__{c}" for c in REVIEW])


def manual_rows(rows: DataFrame, working: DataFrame) -> DataFrame:
    """Working rows whose pair ``rows`` does not have, each pair once; rows without a pair all stay."""
    whole = _has("from_url") & _has("to_url")
    paired = keep_first(working.where(whole), KEY, [ORD]).join(rows.select(*KEY), KEY, "left_anti")
    return paired.unionByName(working.where(~whole))


def missing_rows(rows: DataFrame, working: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Candidates of working tests that ``rows`` lacks, each pair once, without review values."""
    tests = working.where(_has("from_url")).select("project", "from_url").distinct()
    more = edges.where(_has("from_url") & _has("to_url")).join(tests, ["project", "from_url"], "left_semi")
    more = keep_first(more, KEY).join(rows.select(*KEY), KEY, "left_anti")
    artifact = keep_first(methods.select("project", "url", "artifact", ORD), ["project", "url"]).drop(ORD)
    for side in ("from", "to"):
        names = artifact.select("project", F.col("url").alias(f"{side}_url"), F.col("artifact").alias(f"{side}_artifact"))
        more = more.drop(f"{side}_artifact").join(names, ["project", f"{side}_url"], "left")
    return _shaped(more.drop(*REVIEW, "candidate"))


def regenerate(
    working: DataFrame, edges: DataFrame, methods: DataFrame, samples: int, seed: int = 0, exclude: str | None = None,
    columns: Sequence[str] = (), add_missing: bool = False, add_only: bool = False,
) -> DataFrame:
    """The ground truth of all projects anew: its columns, an ordinal by project, and flags.

    Tests of the working rows stay, others are drawn until a project has ``samples``.  Their calls
    come first, by test and target; then working rows that no call explains, in their order;
    with ``add_missing`` further candidates stand after their test's last row.  Labels carry over.
    ``columns`` (see ``update_columns``) are taken anew from methods and calls.  With ``add_only``
    working rows stay as they are and only calls of drawn tests are added.  Without samples nothing
    is drawn and no call comes in.  ``origin`` says where a row comes from; ``carried``,
    ``refreshed`` whether it kept review values and got new columns.
    """
    # Read by many branches: each of the two is made once.
    working = cut_lineage(_shaped(working))
    methods = cut_lineage(keep_first(methods, ["project", "url"]))
    pool = test_pool(edges, methods, exclude)
    if samples <= 0:
        pool = pool.limit(0)
    selected = selected_tests(pool, working, samples, seed)
    candidates = keep_first(edges, KEY).select(*KEY, F.col("to_call_depth").cast("string").alias("__depth"), F.lit(True).alias("__hit"))
    if add_only:
        fresh = fresh_rows(edges, pool, selected.where(~F.col("reused")), methods).withColumn("candidate", F.lit("1"))
        rows = union_all(
            [
                working.withColumns({"origin": F.lit(WORKING), "carried": F.lit(True), "refreshed": F.lit(False)}),
                fresh.withColumns({"origin": F.lit(FRESH), "carried": F.lit(False), "refreshed": F.lit(False)}),
            ]
        )
    else:
        fresh = with_labels(fresh_rows(edges, pool, selected, methods), working)
        fresh = fresh.withColumn("refreshed", F.col("carried") & F.lit(bool(columns)))
        manual = manual_rows(fresh, working)
        manual = _refreshed(manual, methods, columns).withColumn("carried", F.lit(True))
        rows = fresh.withColumn("origin", F.lit(FRESH)).unionByName(manual.withColumn("origin", F.lit(MANUAL)))
        if add_missing:
            more = missing_rows(rows, working, edges, methods).withColumns({"carried": F.lit(False), "refreshed": F.lit(False)})
            rows = rows.unionByName(more.withColumn("origin", F.lit(MISSING)))
        rows = rows.join(candidates, KEY, "left")
        if "to_call_depth" in columns:
            rows = rows.withColumns(
                {"to_call_depth": F.coalesce("__depth", "to_call_depth"), "refreshed": F.col("refreshed") | F.col("__hit").isNotNull()}
            )
        rows = rows.withColumn("candidate", F.when(F.col("__hit"), "1").otherwise("0")).drop("__depth", "__hit")
    return _placed(rows)


def _refreshed(rows: DataFrame, methods: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``columns`` anew from their methods; ``refreshed`` where a method was known."""
    sides = [c for c in columns if c.startswith(("from_", "to_")) and c.split("_", 1)[1] in methods.columns]
    hit = F.lit(False)
    for side in ("from", "to"):
        names = [c for c in sides if c.startswith(f"{side}_")]
        if not names:
            continue
        first = keep_first(methods, ["project", "url"]).select(
            "project", F.col("url").alias(f"{side}_url"), F.struct(*[F.col(c.split("_", 1)[1]).cast("string").alias(c) for c in names]).alias(f"__{side}")
        )
        rows = rows.join(first, ["project", f"{side}_url"], "left")
        hit = hit | F.col(f"__{side}").isNotNull()
        rows = rows.withColumns({c: F.when(F.col(f"__{side}").isNotNull(), F.coalesce(F.col(f"__{side}.{c}"), F.lit(""))).otherwise(F.col(c)) for c in names})
    return rows.withColumn("refreshed", hit).drop("__from", "__to")


def _placed(rows: DataFrame) -> DataFrame:
    """An ordinal within each project: working rows as they were, calls by test and target, manual
    rows as they were, and missing ones after the last row of their test; ties by the pair."""
    rank = F.when(F.col("origin") == WORKING, 0).when(F.col("origin") == FRESH, 1).otherwise(2)
    by_name = F.col("origin") == FRESH
    key = F.struct(
        rank.alias("rank"), F.when(by_name, F.col("from_url")).alias("a"), F.when(by_name, F.col("to_url")).alias("b"), F.col(ORD).alias("c")
    )
    own = F.when(F.col("origin") != MISSING, key)
    end = F.max(own).over(Window.partitionBy("project", "from_url"))
    place = [F.coalesce(own, end).asc_nulls_last(), (F.col("origin") == MISSING).asc(), F.col(ORD).asc(), "from_url", "to_url"]
    nth = F.row_number().over(Window.partitionBy("project").orderBy(*place)) - 1
    return rows.withColumn("__nth", nth).select(*COLUMNS, "origin", "carried", "refreshed", F.col("__nth").cast("long").alias(ORD))


def regeneration_counts(rows: DataFrame) -> DataFrame:
    """Per project: tests, rows by origin, labels carried, rows refreshed and rows without a label."""
    of = lambda o: F.count_if(F.col("origin") == o)
    return rows.groupBy("project").agg(
        F.count_distinct(F.when(_has("from_url"), F.col("from_url"))).alias("tests"), F.count(F.lit(1)).alias("rows"),
        of(FRESH).alias("fresh_rows"), (of(MANUAL) + of(WORKING)).alias("manual_rows"), of(MISSING).alias("missing_rows"),
        F.count_if(F.col("carried") & _has("label")).alias("carried_labels"), F.count_if("refreshed").alias("refreshed_rows"),
        F.count_if(~_has("label")).alias("unlabelled_rows"),
    )


def rules() -> dict[str, Column]:
    """What every regenerated row keeps, for ``PartitionStore.replace``."""
    label = F.trim("label")
    return {"labels are 0, 1 or blank": label.isin("", "0", "1"), "candidate is 0 or 1": F.col("candidate").isin("0", "1")}


def counts() -> dict[str, Column]:
    """What the log says of a regeneration."""
    return {
        "labelled": F.count_if(_has("label")), "carried": F.count_if(F.col("carried") & _has("label")),
        "manual": F.count_if(F.col("origin") == MANUAL), "fresh": F.count_if(F.col("origin") == FRESH),
    }


def regenerate_projects(store, edges: DataFrame, methods: DataFrame, projects: Sequence[str], samples: int, **options) -> int | None:
    """Regenerates the named projects of a ``PartitionStore`` in one transaction; the others stay.

    A run that loses a labelled working row is given up, and nothing changes.  Returns the version.
    """
    working = store.read()
    wanted = F.col("project").isin(list(projects))
    if working is None:
        kinds = ", ".join(f"{c} string" for c in COLUMNS)
        working = edges.sparkSession.createDataFrame([], f"{kinds}, {ORD} long")
    working = working.where(wanted)
    rows = regenerate(working, edges.where(wanted), methods.where(wanted), samples, **options)
    names = edges.sparkSession.createDataFrame([(p,) for p in projects], "project string")
    whole = _has("from_url") & _has("to_url")
    last = keep_first(working.where(whole), KEY, [F.desc(ORD)]).unionByName(working.where(~whole))
    labelled = last.where(_has("label")).count()

    def nothing_lost(found: dict) -> None:
        if found["carried"] < labelled:
            raise ValueError(f"{labelled} labelled rows before, {found['carried']} after")

    return store.replace(rows, names, rules=rules(), counts=counts(), check=nothing_lost)
