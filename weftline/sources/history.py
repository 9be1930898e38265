"""History archives (tar.gz of JSON), history JSON and oracle JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.dates import parse_commit_date
from weftline.sources.archives import read_archives  # noqa: F401

ORACLE = (
    "repositoryName string, repositoryUrl string, startCommitHash string, file string, url string, language string, "
    "elementType string, element string, startLine int, endLine int, "
    "commits array<struct<commitHash:string,changeTags:array<string>>>"
)
DETAIL = (
    "struct<type:string,commitName:string,commitDate:string,commitMessage:string,commitAuthor:string,diff:string,"
    "diffUrl:string,commitUrl:string,oldFileUrl:string,newFileUrl:string,path:string,daysBetweenCommits:double,"
    "extendedDetails:struct<newMethodName:string,newPath:string>,subchanges:array<struct<diff:string>>>"
)
HISTORY = (
    "repositoryName string, sourceFilePath string, sourceFileName string, functionName string, functionId string, "
    "functionStartLine int, functionEndLine int, origin string, changeHistory array<string>, "
    f"changeHistoryShort map<string,string>, changeHistoryDetails map<string,{DETAIL}>"
)


def archive_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("project", "tool").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "blank", "invalid", "unreadable")]
    )


def member_index(members: DataFrame) -> DataFrame:
    """Names that an archive holds; an unreadable archive has none."""
    return members.where("member IS NOT NULL").select("archive", "member").distinct()


def repaired_members(members: DataFrame) -> DataFrame:
    """Without blank and repeated members."""
    return members.where("status <> 'blank' AND member IS NOT NULL").dropDuplicates(["archive", "member"])


def parse_histories(members: DataFrame) -> DataFrame:
    """``members`` with h, the typed history."""
    return members.where("status = 'ok'").withColumn("h", F.from_json("json", HISTORY))


def commit_rows(histories: DataFrame) -> DataFrame:
    """One row a commit: place in the history, type, tags shown, time, diff, diffs of sub-changes.

    The order is the change history's, else that of the details.
    """
    order = F.coalesce(
        F.when(F.size("h.changeHistory") > 0, F.col("h.changeHistory")), F.map_keys("h.changeHistoryDetails")
    )
    keep = [c for c in histories.columns if c not in ("h", "json")]
    rows = histories.select(*keep, "h", F.posexplode(order).alias("place", "commit"))
    d = F.element_at("h.changeHistoryDetails", F.col("commit"))
    short = F.element_at("h.changeHistoryShort", F.col("commit"))
    shown = F.array_distinct(F.array_compact(F.array(d["type"], short)))
    return rows.select(
        *keep, F.col("h.functionName").alias("name"), F.col("h.sourceFilePath").alias("source_path"), "place", "commit",
        d["type"].alias("type"), F.when(F.size(shown) > 0, shown).otherwise(F.array(F.lit("UNKNOWN"))).alias("types"),
        parse_commit_date(d["commitDate"]).alias("ts"), d["diff"].alias("diff"), d["path"].alias("path"),
        F.transform(d["subchanges"], lambda s: s["diff"]).alias("subchange_diffs"),
    )


#: Where the order of commits can come from, in order of precedence.
ORDERS = ("changeHistory", "commitDetails", "changeHistoryDetails", "commits")


def _names(v: Column, list_field: str, name_field: str) -> Column:
    """The names that the objects of a list have, blank and missing ones left out."""
    items = F.try_variant_get(v, f"$.{list_field}", "array<variant>")
    names = F.transform(items, lambda x: F.trim(F.coalesce(F.try_variant_get(x, f"$.{name_field}", "string"), F.lit(""))))
    return F.filter(names, lambda n: n != "")


def history_entries(members: DataFrame) -> DataFrame:
    """One row a commit of any kind of history: place, commit, short_hash, source, detail, date, author, type, path.

    The order is that of the first of ORDERS that is there and not empty (source).  A commit's
    detail is that of changeHistoryDetails, else of commitDetails; it stays a VARIANT, so fields
    that no schema knows survive.  A VARIANT sorts the keys of an object, so the order of
    changeHistoryDetails is read from the text.  A history without any order has no row, nor has
    one whose text repeats a key of an object, which is no VARIANT.
    """
    # In steps, so that no text is parsed twice; a filter on __v would be pushed below it and parse again.
    rows = members.where("status = 'ok'").withColumn("__v", F.try_parse_json("json"))
    v = F.col("__v")
    details = F.from_json(F.get_json_object("json", "$.changeHistoryDetails"), "map<string,string>")
    rows = rows.withColumns({"__details": F.when(v.isNotNull(), details), "__listed": F.try_variant_get(v, "$.commitDetails", "array<variant>")})
    details, listed = F.col("__details"), F.col("__listed")
    kinds = [
        F.try_variant_get(v, "$.changeHistory", "array<string>"), _names(v, "commitDetails", "commitName"),
        F.map_keys(details), _names(v, "commits", "commitHash"),
    ]
    rows = rows.withColumns({f"__k{i}": kind for i, kind in enumerate(kinds)})
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    there = [some(F.col("__k0")), some(listed), some(F.col("__k2")), some(F.try_variant_get(v, "$.commits", "array<variant>"))]
    order, source = F.when(there[0], F.col("__k0")), F.when(there[0], ORDERS[0])
    for i, name in list(enumerate(ORDERS))[1:]:
        order, source = order.when(there[i], F.col(f"__k{i}")), source.when(there[i], name)
    rows = rows.withColumn("__order", order)
    keep = [c for c in members.columns if c != "json"]
    first = F.filter(listed, lambda x: F.trim(F.try_variant_get(x, "$.commitName", "string")) == F.col("commit"))
    rows = rows.select(*keep, "__v", "__details", "__listed", source.alias("source"), F.posexplode("__order").alias("place", "commit"))
    detail = F.coalesce(F.try_parse_json(F.element_at("__details", F.col("commit"))), F.get(first, 0))
    rows = rows.withColumn("detail", detail)
    of = lambda name: F.try_variant_get("detail", f"$.{name}", "string")
    return rows.select(
        *keep, "source", "place", "commit", F.substring("commit", 1, 6).alias("short_hash"), of("commitAuthor").alias("author"),
        F.coalesce(of("type"), F.try_variant_get(v, "$.changeHistoryShort", "map<string,string>")[F.col("commit")]).alias("type"),
        parse_commit_date(of("commitDate")).alias("ts"), F.coalesce(of("path"), F.try_variant_get(v, "$.sourceFilePath", "string"), F.lit("")).alias("path"),
        "detail",
    )


def read_oracles(spark: SparkSession, path: str) -> DataFrame:
    """Oracle files with their path, ordered by it."""
    rows = spark.read.schema(ORACLE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("path", F.input_file_name()).orderBy("path")


def oracle_counts(oracles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Oracles by project and by normalised repository URL."""
    a = oracles.groupBy(F.col("repositoryName").alias("project")).agg(F.count(F.lit(1)).alias("n"))
    b = oracles.groupBy(text.repository_url(F.col("repositoryUrl")).alias("repository")).agg(F.count(F.lit(1)).alias("n"))
    return a, b


def code_of_ranges(sources: DataFrame, methods: DataFrame) -> DataFrame:
    """``methods`` with code: lines start_line to end_line of their file, blank where that fails.

    sources: file, content.
    """
    lines = F.split("content", r"\r?\n")
    first = F.col("start_line")
    fine = (first >= 1) & (F.col("end_line") >= first) & (first <= F.size(lines))
    code = F.array_join(F.slice(lines, first, F.col("end_line") - first + 1), "\n")
    rows = methods.join(sources, "file", "left")
    return rows.withColumn("code", F.when(fine, F.regexp_replace(code, r"\n$", "")).otherwise("")).drop("content")
