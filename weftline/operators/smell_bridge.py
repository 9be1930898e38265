"""From detector output to methods: paths, names, line ranges, introduction commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.strings import similarity, strip_test_marker
from weftline.operators.relational import ORD, keep_first, union_all
from weftline.session import cut_lineage


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join by a shuffle: the planner's sizes do not see what explode adds, so it would
    broadcast frames many times larger than it takes them for."""
    return df.hint("merge")


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(text.blank(path), r"\\", "/"), "/", -1)


def match_paths(found: DataFrame, known: DataFrame, path: str = "path", file: str = "file", both_ways: bool = False) -> DataFrame:
    """``found`` with ``file``: the equal known file, else the longest that ends the path.

    Only files of the same base name meet, so the suffix test is an equi-join with a filter.
    ``both_ways``: the path may end the file as well. Paths without a match keep null.
    """
    a = found.withColumns({"__base": base_name(F.col(path)), "__path": F.concat(F.lit("/"), F.regexp_replace(path, r"^/+|\\", ""))})
    b = known.select(F.col(file).alias("__file")).distinct().withColumn("__base", base_name(F.col("__file")))
    slash = F.concat(F.lit("/"), F.col("__file"))
    hit = F.endswith(F.col("__path"), slash)
    if both_ways:
        hit = hit | F.endswith(slash, F.col("__path"))
    keys = found.select(path).distinct()
    pairs = a.select(path, "__base", "__path").distinct().join(spread(b), "__base").where(hit)
    order = Window.partitionBy(path).orderBy((slash == F.col("__path")).desc(), F.length("__file").desc(), "__file")
    best = pairs.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select(path, F.col("__file").alias(file))
    return found.join(spread(keys.join(spread(best), path, "left")), path, "left")


def narrow_by_range(pairs: DataFrame, row: Sequence[str], start: str, end: str, first: str, last: str) -> DataFrame:
    """Among several matches of a row those that contain its lines, if any does; else all."""
    inside = F.coalesce((F.col(start) <= F.col(first)) & (F.col(last) <= F.col(end)), F.lit(False))
    many = Window.partitionBy(*row)
    marked = pairs.withColumns({"__in": inside.cast("int")}).withColumns(
        {"__any": F.max("__in").over(many), "__n": F.count(F.lit(1)).over(many)}
    )
    return marked.where("__n = 1 OR __any = 0 OR __in = 1").drop("__in", "__any", "__n")


#: Bits of a line number that bins of each level leave out, the smallest bins first.
LEVELS = (4, 7, 10, 13, 16, 19, 22, 25, 28, 31)


def containing(elements: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str, end: str, first: str, last: str) -> DataFrame:
    """Pairs of an element and a range with equal ``keys`` that contains its lines, nested ones all.

    A range lies in the smallest bin that holds all of it, one row; an element asks the bins of
    every level that its first line lies in.  So ranges of one key meet the elements near them,
    not all of the key.  Ranges and elements without lines have no pair.
    """
    level = F.lit(None).cast("int")
    for bits in reversed(LEVELS):
        level = F.when(F.shiftright(start, bits) == F.shiftright(end, bits), bits).otherwise(level)
    binned = ranges.where(F.col(start) <= F.col(end)).withColumn("__level", level)
    binned = binned.withColumn("__bin", F.expr(f"shiftright(`{start}`, __level)")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    asked = elements.where(F.col(first) <= F.col(last)).withColumn(
        "__ask", F.explode(F.array(*[F.struct(F.lit(b).alias("level"), F.shiftright(first, b).alias("bin")) for b in LEVELS]))
    )
    same = (F.col("__ask.level") == F.col("__level")) & (F.col("__ask.bin") == F.col("__bin"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    inside = (F.col(start) <= F.col(first)) & (F.col(last) <= F.col(end))
    return asked.join(spread(binned), same & inside).drop("__ask", "__level", "__bin", *[f"__k_{k}" for k in keys])


#: Pairs of an element and a range of its key that one task makes where no range contains the element.
PAIRS_OF_TASK = 5_000_000


def narrowed(elements: DataFrame, ranges: DataFrame, keys: Sequence[str], row: str, start: str, end: str, first: str, last: str) -> DataFrame:
    """Elements (each with its own ``row``) with the ranges of their key that contain their lines, if
    any does; else with all ranges of the key.

    The latter are elements times ranges: where a key has many such pairs its ranges are dealt into
    parts, as many as the pairs need, and its elements go to each, so a few keys fill all tasks.
    """
    inside = containing(elements, ranges, keys, start, end, first, last)
    rest = cut_lineage(elements.join(spread(inside.select(row)), row, "left_anti"))
    loads = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(spread(ranges.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))), list(keys))
    loads = cut_lineage(loads.select(*keys, F.ceil(F.col("__n") * F.col("__m") / PAIRS_OF_TASK).alias("__parts")))
    parts, most = loads.agg(F.sum("__parts"), F.max("__parts")).first()
    if (most or 0) <= 1:
        return inside.unionByName(rest.join(spread(ranges), list(keys)))
    tasks = max(parts, int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.xxhash64(*[c for c in ranges.columns if c not in keys]), "__parts")
    dealt = ranges.join(spread(loads), list(keys)).withColumn("__part", place).drop("__parts")
    asked = rest.join(spread(loads), list(keys)).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    met = [*keys, "__part"]
    pairs = asked.repartition(tasks, *met).join(spread(dealt.repartition(tasks, *met)), met).drop("__part")
    return inside.unionByName(pairs)


def smell_items(raw: DataFrame) -> DataFrame:
    """One row a smelly element: method name and its line range from comma lists."""
    names = F.filter(F.transform(F.split(text.blank(F.col("testSmellMethod")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.select("*", F.posexplode(names).alias("__i", "method"))
    lines = text.smell_range(F.col("testSmellLineBegin"), F.col("testSmellLineEnd"), F.col("__i"))
    return rows.withColumns({"first": lines["first"], "last": lines["last"]}).drop("__i")


def smells_to_methods(raw: DataFrame, methods: DataFrame, acronyms: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(smells, errors): smells with the method's URL and size; elements without a method are errors.

    raw has path, testSmellName, testSmellMethod, line lists and an ordinal; methods has file, name,
    url, start, end.
    """
    names = F.create_map(*[F.lit(x) for kv in acronyms.items() for x in kv]) if acronyms else None
    smell = F.coalesce(names[F.col("testSmellName")], F.col("testSmellName")) if acronyms else F.col("testSmellName")
    items = match_paths(smell_items(raw), methods).withColumn("smell", smell)
    items = items.withColumn("__row", F.struct(ORD, "method", "first", "last"))
    kept = narrowed(items, methods.select("file", F.col("name").alias("method"), "url", "start", "end"), ["file", "method"], "__row", "start", "end", "first", "last")
    found = kept.select("url", F.col("method").alias("name"), "smell", F.col("first").alias("smell_begin"), F.col("last").alias("smell_end"), (F.col("end") - F.col("start") + 1).alias("loc"), ORD)
    lost = items.join(spread(methods.select("file", F.col("name").alias("method"))), ["file", "method"], "left_anti").drop("__row").withColumn("reason", F.lit("method not found"))
    return found, lost


def append_unsmelled(smells: DataFrame, bridge: DataFrame) -> DataFrame:
    """Bridge methods without a smell come with a blank smell and their current size."""
    rest = bridge.join(smells.select("url"), "url", "left_anti").dropDuplicates(["url"])
    return union_all([smells, rest.select("url", "name", F.lit("").alias("smell"), "loc")])


def find_histories(methods: DataFrame, histories: DataFrame) -> DataFrame:
    """Each method's history: same name and the source path ends its file; else a path of its details does.

    methods: url, name, file; histories: history_id, name, source_path, detail_paths.
    """
    own = histories.select("history_id", "name", F.col("source_path").alias("__path"), F.lit(0).alias("__rank"))
    detail = histories.select("history_id", "name", F.explode("detail_paths").alias("__path"), F.lit(1).alias("__rank"))
    every = own.unionByName(detail).withColumn("__base", base_name(F.col("__path")))
    pairs = methods.withColumn("__base", base_name(F.col("file"))).join(every, ["name", "__base"])
    slash = lambda c: F.concat(F.lit("/"), F.col(c))
    pairs = pairs.where(F.endswith(slash("file"), slash("__path")) | F.endswith(slash("__path"), slash("file")))
    best = keep_first(pairs, ["url"], ["__rank", "history_id"])
    return best.drop("__base", "__path", "__rank")


def introduction(commits: DataFrame, key: Sequence[str]) -> DataFrame:
    """The commit that introduced each method: the first introduction in commit order, else the last commit."""
    hit = F.contains(F.col("type"), F.lit("Yintroduced"))
    order = Window.partitionBy(*key).orderBy((~hit).cast("int"), F.when(hit, F.col("place")).otherwise(-F.col("place")))
    return commits.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def introduction_bridge(links: DataFrame, test_commits: DataFrame, production_commits: DataFrame) -> DataFrame:
    """Links with the test's introduction (name, lines, URL then) and the production method at that commit."""
    born = introduction(test_commits, ["url"]).select(
        F.col("url").alias("from_url"), F.col("commit").alias("__commit"), F.col("name").alias("from_old_name"),
        F.col("old_url").alias("from_old_url"), F.col("start").alias("from_old_start"),
        (F.col("start") + text.new_side_lines(F.col("diff")) - 1).alias("from_old_end"),
    )
    then = production_commits.select(
        F.col("url").alias("to_url"), F.col("commit").alias("__commit"), F.col("name").alias("to_old_name"), F.col("old_url").alias("to_old_url")
    )
    rows = links.join(born, "from_url").join(then, ["to_url", "__commit"], "left").drop("__commit")
    return rows.dropDuplicates()


def pick_production_file(pairs: DataFrame) -> DataFrame:
    """Per test file the production file of its name (confidence 1), else the most similar name; ties by path.

    pairs: test_file, test_class, to_file, to_class.
    """
    a, b = F.lower(strip_test_marker(F.col("test_class"))), F.lower("to_class")
    exact = (a == b).cast("int")
    rows = pairs.withColumns({"__exact": exact, "__sim": similarity(a, b)})
    best = keep_first(rows, ["test_file"], [F.desc("__exact"), F.desc("__sim"), "to_file"])
    sizes = pairs.groupBy("test_file").agg(F.count_distinct("to_file").alias("candidate_count"))
    confidence = F.when(F.col("__exact") == 1, 1.0).otherwise(F.col("__sim"))
    return best.withColumn("confidence", confidence).drop("__exact", "__sim").join(sizes, "test_file")


def adapter_input(rows: DataFrame) -> DataFrame:
    """One row a test path; an ambiguous production path is blank."""
    known = F.when(F.col("pathToProductionFile") != "", F.col("pathToProductionFile"))
    return rows.groupBy("appName", "pathToTestFile").agg(
        F.when(F.count_distinct(known) == 1, F.max(known)).otherwise("").alias("pathToProductionFile")
    )


def bridge_tests(bridge: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct on the test-side columns, the first row of each."""
    return keep_first(bridge, columns)
