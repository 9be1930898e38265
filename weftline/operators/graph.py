"""Call graphs and class hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import tags
from weftline.operators.relational import ORD, union_all
from weftline.session import cut_lineage

MAX_DEPTH = 5
# Assertion calls beside those that start with assert or assume.
ASSERTION_NAMES = ("fail", "assumingThat", "then", "failBecauseExceptionWasNotThrown")


def reverse_edges(edges: DataFrame, swapped: Sequence[str], cleared: Sequence[str] = ()) -> DataFrame:
    """Fan-in from fan-out: the ``swapped`` attributes change sides, ``cleared`` become null."""
    types = dict(edges.dtypes)
    swap = {f"from_{a}": f"to_{a}" for a in swapped} | {f"to_{a}": f"from_{a}" for a in swapped}
    return edges.select(
        [F.lit(None).cast(types[c]).alias(c) if c in cleared else F.col(swap.get(c, c)).alias(c) for c in edges.columns]
    )


def expand_calls(edges: DataFrame, methods: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Direct calls, and calls that tests reach through test code, with to_call_depth and to_caller_url.

    A call between test code is followed from its target; main code is not followed further. Of a
    start edge every target is reached once, at its least depth (ties: the first edge in file order).
    What is reached depends on the start's target alone, so each distinct target is expanded once,
    one join a level on the frontier, and its start edges come in at the end: a helper that all
    tests call costs as much as one that a single test calls.
    """
    known = methods.select("url", tags.split_tags(F.col("artifact")).alias("tags")).dropDuplicates(["url"])
    test, main = F.array_contains("tags", "test-code"), F.array_contains("tags", "main-code")
    flags = known.select("url", test.alias("is_test"), main.alias("is_main"))
    edges = edges.where(F.trim("to_url") != "")
    target_side = [c for c in edges.columns if c.startswith("to_")]
    direct = edges.withColumn("to_call_depth", F.lit(1))
    if "to_caller_url" not in edges.columns:
        direct = direct.withColumn("to_caller_url", F.lit(""))

    sides = edges.join(flags.select(F.col("url").alias("from_url"), F.col("is_test").alias("__a")), "from_url", "left").join(
        flags.select(F.col("url").alias("to_url"), F.col("is_test").alias("__b"), F.col("is_main").alias("__main")), "to_url", "left"
    )
    begun = sides.where("__a AND __b").select(
        F.col(ORD).alias("__edge_from"), F.col("to_url").alias("__start"), F.coalesce("__main", F.lit(False)).alias("__main")
    )
    starts = begun.select("__start", F.col("__start").alias("__at"), "__main").distinct()
    steps = edges.join(flags.select(F.col("url").alias("to_url"), F.col("is_main").alias("__next_main")), "to_url", "left").select(
        F.col("from_url").alias("__at"),
        F.col("to_url").alias("__next"),
        F.col(ORD).alias("__edge"),
        F.coalesce("__next_main", F.lit(False)).alias("__next_main"),
    )
    reached = starts.select("__start", F.col("__at").alias("__seen"))
    frontier, found = starts.where("NOT __main"), []
    for level in range(2, depth + 1):
        hops = frontier.join(steps, "__at")
        first = Window.partitionBy("__start", "__next").orderBy("__edge")
        hops = (
            hops.join(reached, (hops["__start"] == reached["__start"]) & (hops["__next"] == reached["__seen"]), "left_anti")
            .withColumn("__rank", F.row_number().over(first))
            .where("__rank = 1")
            .drop("__rank")
        )
        # Used three times below; without a cut every level would compute all before it again.
        hops = cut_lineage(hops)
        found.append(hops.select("__start", "__edge", F.lit(level).alias("__depth")))
        reached = reached.unionByName(hops.select("__start", F.col("__next").alias("__seen")))
        frontier = hops.where("NOT __next_main").select("__start", F.col("__next").alias("__at"))
    if not found:
        return direct.drop(ORD).dropDuplicates()
    # Start edges by target: a hub's edges meet its hits here, which is the size of the result.
    hits = union_all(found).join(begun.select("__start", "__edge_from"), "__start").drop("__start")
    left = edges.select(F.col(ORD).alias("__edge_from"), *[c for c in edges.columns if c not in (*target_side, ORD)])
    right = edges.select(F.col(ORD).alias("__edge"), F.col("from_url").alias("__caller"), *[c for c in target_side if c != "to_caller_url"])
    further = (
        hits.join(left, "__edge_from").join(right, "__edge")
        .withColumnsRenamed({"__depth": "to_call_depth_", "__caller": "to_caller_url"})
        .drop("__edge_from", "__edge", "to_call_depth").withColumnRenamed("to_call_depth_", "to_call_depth")
    )
    return union_all([direct.drop(ORD), further]).dropDuplicates()


def expand_calls_depth_first(edges: DataFrame, methods: DataFrame, depth: int = MAX_DEPTH, by: str = "project") -> DataFrame:
    """As ``expand_calls``, but each target's depth and caller are those of a last-edge-first walk.

    One project's graph is held by one task; use it for projects that fit one.
    """
    artifacts = methods.select(F.col("url").alias("to_url"), F.array_contains(tags.split_tags(F.col("artifact")), "main-code").alias("__main"))
    tests = methods.select("url", F.array_contains(tags.split_tags(F.col("artifact")), "test-code").alias("__t"))
    marked = (
        edges.where(F.trim("to_url") != "").join(artifacts.dropDuplicates(["to_url"]), "to_url", "left")
        .join(tests.dropDuplicates(["url"]).withColumnsRenamed({"url": "from_url", "__t": "__from_test"}), "from_url", "left")
        .join(tests.dropDuplicates(["url"]).withColumnsRenamed({"url": "to_url", "__t": "__to_test"}), "to_url", "left")
        .na.fill(False, ["__main", "__from_test", "__to_test"])
    )
    columns = [c for c in edges.columns if c not in (ORD, "to_call_depth", "to_caller_url")]
    schema = edges.select(*columns).schema.add("to_call_depth", "integer").add("to_caller_url", "string")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORD, kind="stable").reset_index(drop=True)
        out_edges: dict[str, list[int]] = {}
        for i, source in enumerate(pdf["from_url"]):
            out_edges.setdefault(source, []).append(i)
        targets, mains, sources = pdf["to_url"].tolist(), pdf["__main"].tolist(), pdf["from_url"].tolist()
        rows = []
        for i in range(len(pdf)):
            rows.append((i, i, 1, pdf["to_caller_url"][i] if "to_caller_url" in pdf else ""))
            if not (pdf["__from_test"][i] and pdf["__to_test"][i]):
                continue
            stack, seen = [(i, 1)], set()
            while stack:
                edge, level = stack.pop()
                here = targets[edge]
                if level > depth or here in seen:
                    continue
                seen.add(here)
                if level > 1:
                    rows.append((i, edge, level, sources[edge]))
                if not mains[edge]:
                    stack.extend((e, level + 1) for e in out_edges.get(here, ()))
        start, end = [r[0] for r in rows], [r[1] for r in rows]
        data = {c: pdf[c].iloc[end if c.startswith("to_") else start].tolist() for c in columns}
        data |= {"to_call_depth": [r[2] for r in rows], "to_caller_url": [r[3] for r in rows]}
        return pd.DataFrame(data)

    return marked.groupBy(by).applyInPandas(walk, schema).dropDuplicates()


def degrees(edges: DataFrame, methods: DataFrame, source: str = "from_url", target: str = "to_url", key: str = "url") -> DataFrame:
    """``methods`` that call or are called, with fan_out and fan_in (multi-edges count)."""
    out = edges.groupBy(F.col(source).alias(key)).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy(F.col(target).alias(key)).agg(F.count(F.lit(1)).alias("fan_in"))
    both = out.join(into, key, "full").na.fill(0, ["fan_out", "fan_in"])
    return methods.join(both, key)


def closure(pairs: DataFrame, child: str = "child", parent: str = "parent", most: int | None = None) -> DataFrame:
    """(child, ancestor, level): all ancestors at their least distance; cycles end by themselves.

    Distances double: once all pairs up to a distance h are known, a pair up to 2h apart is one of
    exactly h and one of the rest. So rounds grow with the logarithm of the depth, and each new
    pair comes from its midpoints only. ``most`` bounds the level where it is given.
    """
    first = pairs.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct().where("child <> ancestor")
    found = cut_lineage(first.withColumn("level", F.lit(1)))
    half = 1
    while most is None or half < most:
        apart = found.where(F.col("level") == half).select("child", F.col("ancestor").alias("middle"))
        if apart.isEmpty():
            break
        rest = found.select(F.col("child").alias("middle"), "ancestor", "level")
        fresh = apart.join(rest, "middle").where("child <> ancestor").groupBy("child", "ancestor").agg((F.min("level") + half).alias("level"))
        fresh = fresh.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti")
        if most is not None:
            fresh = fresh.where(F.col("level") <= most)
        found = cut_lineage(found.unionByName(fresh))
        half *= 2
    return found


def search_levels(ancestors: DataFrame, start: str) -> DataFrame:
    """(name, direction, level) around one type: itself, then subtypes, then supertypes by distance."""
    subs = ancestors.where(F.col("ancestor") == start).select(F.col("child").alias("name"), F.lit(1).alias("direction"), "level")
    supers = ancestors.where(F.col("child") == start).select(F.col("ancestor").alias("name"), F.lit(2).alias("direction"), "level")
    own = ancestors.sparkSession.createDataFrame([(start, 0, 0)], "name string, direction int, level int")
    return union_all([own, subs, supers])


def call_score(candidate: DataFrame) -> Column:
    """Points of a call candidate: qualified name, signature, bare signature, arity, same file.

    Columns c_* are the candidate's, e_* the call's; a different arity rejects (null).
    """
    points = (
        F.when(F.col("c_fqn") == F.col("e_fqn"), 300).otherwise(0)
        + F.when(F.col("c_fqs") == F.col("e_fqs"), 200).otherwise(0)
        + F.when(F.substring_index("c_fqs", "(", 1) == F.substring_index("e_fqs", "(", 1), 100).otherwise(0)
        + F.when(F.col("c_arity") == F.col("e_arity"), 50).otherwise(0)
        + F.when(F.col("c_file") == F.col("e_file"), 25).otherwise(0)
    )
    return F.when(F.col("c_arity") == F.col("e_arity"), points)


def best_call_target(candidates: DataFrame, call: str = "call_id") -> DataFrame:
    """Per call the best candidate of the nearest hierarchy level that has one; ties by ordinal."""
    scored = candidates.withColumn("score", call_score(candidates)).where("score IS NOT NULL")
    order = Window.partitionBy(call).orderBy("direction", "level", F.desc("score"), ORD)
    return scored.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def is_assertion(name: Column) -> Column:
    name = F.coalesce(name, F.lit(""))
    return name.startswith("assert") | name.startswith("assume") | name.isin(*ASSERTION_NAMES)


def last_assertion_line(calls: DataFrame, method: str = "from_url") -> DataFrame:
    return calls.groupBy(method).agg(F.max(F.when(is_assertion(F.col("name")), F.col("end_line"))).alias("last_assertion"))


def last_call_before_assertion(calls: DataFrame, method: str = "from_url") -> DataFrame:
    """``calls`` with lcba: 1 for the call that stands last before an assertion, or in its arguments.

    For each call the next assertion by line is found, and among the calls of one such assertion the
    last line wins; calls inside an assertion (``in_assertion``) are always marked.
    """
    ahead = Window.partitionBy(method).orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    check = is_assertion(F.col("name"))
    with_next = calls.withColumn("__assert", F.min(F.when(check, F.col("line"))).over(ahead))
    plain = ~check & ~F.col("in_assertion") & F.col("__assert").isNotNull()
    last = F.max(F.when(plain, F.struct("line", F.col(ORD)))).over(Window.partitionBy(method, "__assert"))
    mark = F.col("in_assertion") | (plain & (F.struct("line", F.col(ORD)) == last))
    return with_next.withColumn("lcba", mark.cast("int")).drop("__assert")
