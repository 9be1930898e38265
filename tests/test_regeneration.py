"""Ground truth regenerated in a transaction, shares and samples, constraints and counters."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import apportion, constraints, regeneration
from weftline.sources.versioned import Conflict, PartitionStore


def store_rows(store, version=None):
    df = store.read(version)
    return [] if df is None else sorted((r["project"], r["v"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "project string, v int")


def test_a_transaction_replaces_what_it_names(spark, tmp_path):
    store = PartitionStore(spark, f"file://{tmp_path}/store")
    assert store.read() is None and store.version() == 0
    assert store.replace(frame(spark, [("a", 1), ("b", 1), ("b", 2), (None, 9)])) == 1
    assert store.replace(frame(spark, [("a", 5)])) == 2
    found = [(r["project"], r["v"]) for r in store.read().collect()]
    assert sorted(found, key=str) == sorted([("a", 5), ("b", 1), ("b", 2), (None, 9)], key=str)
    # A named partition without rows ends empty; an unnamed one with rows is an error.
    store.replace(frame(spark, []), spark.createDataFrame([("b",)], "project string"))
    assert [(r["project"], r["v"]) for r in store.read().where("project IS NOT NULL").collect()] == [("a", 5)]
    with pytest.raises(ValueError, match="not replaced"):
        store.replace(frame(spark, [("c", 1)]), spark.createDataFrame([("b",)], "project string"))
    assert store.version() == 3 and store.read(1).count() == 4
    gone = store.vacuum()
    assert store.read().count() == 2 and len(gone) == 0  # version 1 still holds the null partition


def test_a_failed_transaction_changes_nothing(spark, tmp_path):
    store = PartitionStore(spark, f"file://{tmp_path}/store")
    store.replace(frame(spark, [("a", 1)]))
    with pytest.raises(Exception, match="small values"):
        store.replace(frame(spark, [("a", 2), ("a", 99)]), rules={"small values": F.col("v") < 10})
    with pytest.raises(ValueError, match="seen 2"):

        def check(found):
            raise ValueError(f"seen {found['big']}")

        store.replace(frame(spark, [("a", 50), ("a", 60)]), counts={"big": F.count_if(F.col("v") > 9)}, check=check)
    assert store_rows(store) == [("a", 1)] and store.version() == 1
    assert len(os.listdir(tmp_path / "store" / "data")) == 1

    # Another transaction takes the number between the staging and the entry.
    def overtaken(found):
        other = PartitionStore(spark, store.path)
        other.replace(frame(spark, [("a", 7)]))

    with pytest.raises(Conflict):
        store.replace(frame(spark, [("a", 8)]), check=overtaken)
    assert store_rows(store) == [("a", 7)] and store_rows(store, 1) == [("a", 1)]
    assert store.vacuum() and store_rows(store) == [("a", 7)]


def test_counts_ride_on_the_write(spark, tmp_path):
    store = PartitionStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("p", "t1", "{}", 1), ("p", "t1", "", 2), ("p", "t2", None, 3), ("p", "t3", "", 4)], "project string, from_url string, body string, _ord long")
    seen = {}
    store.replace(constraints.first_of_test(rows), counts=constraints.body_counts(), check=seen.update)
    assert seen == {"rows": 4, "tests": 3, "without_body": 2}
    entry = json.loads((tmp_path / "store" / "log" / "0000000001.json").read_text())
    assert entry["counts"] == seen
    with pytest.raises(ValueError, match="2 of 3 tests"):
        constraints.check_bodies(seen)
    assert [tuple(r) for r in constraints.coverage(rows).collect()] == [("p", 3, 2)]
    with pytest.raises(Exception, match="has a body"):
        constraints.required(rows, {"has a body": F.length("body") > 0}).collect()


GT = ", ".join(f"{c} string" for c in regeneration.COLUMNS) + ", _ord long"
METHODS = "project string, url string, name string, artifact string, _ord long"
EDGES = "project string, from_url string, to_url string, to_name string, to_call_depth string, _ord long"


def truth(spark, rows):
    """rows: project, from_url, to_url, label, notes."""
    full = []
    for i, (p, a, b, label, notes) in enumerate(rows):
        row = dict.fromkeys(regeneration.COLUMNS, "") | {"project": p, "from_url": a, "to_url": b, "label": label, "notes": notes, "to_name": "old"}
        full.append((*[row[c] for c in regeneration.COLUMNS], i))
    return spark.createDataFrame(full, GT)


@pytest.fixture
def graph(spark):
    methods = [("p", t, t.upper(), "#test-code #test-case-method" + (" #slow" if t == "t4" else ""), i) for i, t in enumerate(("t1", "t2", "t3", "t4"))]
    methods += [("p", m, m.upper(), "#test-code" if m == "h" else "#main-code", 9) for m in ("m1", "m2", "h")] + [("q", "t1", "T1", "#test-case-method", 1)]
    edges = [
        ("p", "t1", "m2", "x", "2", 1), ("p", "t1", "m1", "x", "", 2), ("p", "t1", "m1", "y", "1", 3), ("p", "t2", "h", "x", "1", 4),
        ("p", "t3", "m1", "x", "1", 5), ("p", "t4", "m1", "x", "1", 6), ("p", "m1", "m2", "x", "1", 7), ("q", "t1", "m9", "z", "1", 8),
    ]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(methods, METHODS)


def shown(rows):
    keep = [(r["project"], r["_ord"], r["from_url"], r["to_url"], r["label"], r["notes"], r["candidate"], r["origin"], r["to_name"]) for r in rows.collect()]
    return [k[2:] for k in sorted(keep)]


def test_regeneration(spark, graph):
    edges, methods = graph
    working = truth(spark, [("p", "t1", "m1", "1", "kept"), ("p", "t1", "gone", "1", "manual"), ("p", "", "m1", "", "no test"), ("p", "t9", "m1", "0", "lost"), ("p", "t1", "m1", "0", "last")])
    rows = regeneration.regenerate(working, edges.where("project = 'p'"), methods, 9, exclude="slow", columns=["to_name"])
    assert shown(rows) == [
        ("t1", "m1", "0", "last", "1", "fresh", "y"), ("t1", "m2", "", "", "1", "fresh", "x"), ("t2", "h", "0", "", "1", "fresh", "x"),
        ("t3", "m1", "", "", "1", "fresh", "x"), ("t1", "gone", "1", "manual", "0", "manual", "old"),
        ("", "m1", "", "no test", "0", "manual", "M1"), ("t9", "m1", "0", "lost", "0", "manual", "M1"),
    ]
    counts = regeneration.regeneration_counts(rows).first().asDict()
    assert counts == {"project": "p", "tests": 4, "rows": 7, "fresh_rows": 4, "manual_rows": 3, "missing_rows": 0, "carried_labels": 3, "refreshed_rows": 3, "unlabelled_rows": 3}
    # Two tests are there already, so one is drawn; the same one whatever the partitions.
    drawn = {r["from_url"] for r in regeneration.regenerate(working, edges.repartition(5), methods, 3, seed=4).where("origin = 'fresh' AND project = 'p'").collect()}
    again = {r["from_url"] for r in regeneration.regenerate(working, edges, methods, 3, seed=4).where("origin = 'fresh' AND project = 'p'").collect()}
    assert drawn == again and "t1" in drawn and len(drawn) == 2
    # Without samples no call comes in, but missing candidates of working tests can, after their test's rows.
    rows = regeneration.regenerate(working, edges.where("project = 'p'"), methods, 0, add_missing=True, columns=["to_call_depth"])
    assert [(r[0], r[1], r[5]) for r in shown(rows)] == [
        ("t1", "m1", "manual"), ("t1", "gone", "manual"), ("t1", "m2", "missing"), ("", "m1", "manual"), ("t9", "m1", "manual"),
    ]
    rows = regeneration.regenerate(working, edges.where("project = 'p'"), methods, 9, add_only=True)
    assert [(r[0], r[1], r[4], r[5]) for r in shown(rows)] == [
        *[(a, b, "", "working") for a, b in (("t1", "m1"), ("t1", "gone"), ("", "m1"), ("t9", "m1"), ("t1", "m1"))],
        ("t2", "h", "1", "fresh"), ("t3", "m1", "1", "fresh"), ("t4", "m1", "1", "fresh"),
    ]


def test_update_columns():
    assert regeneration.update_columns(" to_name, from_name,to_name ") == ["to_name", "from_name"]
    for wrong in ("label", "nothing"):
        with pytest.raises(ValueError):
            regeneration.update_columns(wrong)


def test_projects_are_regenerated_in_a_transaction(spark, graph, tmp_path):
    edges, methods = graph
    store = PartitionStore(spark, f"file://{tmp_path}/truth")
    regeneration.regenerate_projects(store, edges, methods, ["p", "q"], 9)
    assert {r["project"] for r in store.read().collect()} == {"p", "q"}
    labelled = store.read().withColumn("label", F.when(F.col("to_url") == "m1", "1").otherwise(F.col("label")))
    store.replace(labelled)
    before = sorted(map(str, store.read().where("project = 'q'").collect()))
    regeneration.regenerate_projects(store, edges.where("to_url <> 'm2'"), methods, ["p"], 9)
    after = store.read()
    assert sorted(map(str, after.where("project = 'q'").collect())) == before
    assert after.where("project = 'p' AND label = '1'").count() == 3
    # Calls that are gone leave manual rows behind, so nothing is lost; bad labels give the run up.
    bad = store.read().withColumn("label", F.lit("maybe"))
    store.replace(bad)
    version = store.version()
    with pytest.raises(Exception, match="labels are"):
        regeneration.regenerate_projects(store, edges, methods, ["p"], 9)
    assert store.version() == version and store.read().where("label = 'maybe'").count() == bad.count()


def plain_shares(sizes, target):
    """Units go round one by one."""
    names = [n for n in sizes if sizes[n] > 0]
    target = min(max(target, 0), sum(sizes[n] for n in names))
    share = dict.fromkeys(sizes, 0)
    if not target:
        return share
    total = sum(sizes[n] for n in names)
    quota = {n: target * sizes[n] / total for n in names}
    least = 1 if target >= len(names) else 0
    for n in names:
        share[n] = min(sizes[n], max(least, math.floor(quota[n])))
    rank = sorted(names, key=lambda n: (quota[n] - math.floor(quota[n]), sizes[n], n))
    while sum(share.values()) < target:
        for n in reversed(rank):
            if sum(share.values()) < target and share[n] < sizes[n]:
                share[n] += 1
    while sum(share.values()) > target:
        for n in rank:
            if sum(share.values()) > target and share[n] > least:
                share[n] -= 1
    return share


def test_shares(spark):
    draw = random.Random(4)
    cases = [({"a": 100, "b": 10, "c": 1}, 20), ({"big": 100_000, **{f"s{i}": 1 for i in range(60)}}, 90), ({"a": 5, "b": 5, "c": 5}, 2), ({"a": 3, "b": 0}, 9)]
    cases += [({f"g{i}": draw.randrange(40) for i in range(30)}, draw.randrange(400))]
    for sizes, target in cases:
        df = spark.createDataFrame(list(sizes.items()), "group string, size long")
        assert {r["group"]: r["share"] for r in apportion.allocate(df, F.lit(target)).collect()} == plain_shares(sizes, target)
    assert apportion.allocate(spark.createDataFrame([], "group string, size long"), F.lit(5)).count() == 0


def test_top_up(spark):
    rows = [("a", 5, 1, 2), ("b", 3, 0, 9), ("c", 1, 4, 9)]
    df = spark.createDataFrame(rows, "group string, share long, existing long, capacity long")
    assert {r["group"]: r["more"] for r in apportion.top_up(df, F.lit(50)).collect()} == {"a": 2, "b": 3, "c": 0}
    assert {r["group"]: r["more"] for r in apportion.top_up(df, F.lit(8)).collect()} == {n: plain_shares({"a": 2, "b": 3, "c": 0}, 3)[n] for n in "abc"}
    assert {r["more"] for r in apportion.top_up(df, F.lit(5)).collect()} == {0}
    full = spark.createDataFrame([("a", 1, 3, 0), ("b", 1, 1, 5)], "group string, share long, existing long, capacity long")
    assert {r["more"] for r in apportion.top_up(full, F.lit(9)).collect()} == {0}


def test_review_sample(spark):
    rows = [("a" if i < 800 else "b", f"t{i}", "m", i) for i in range(900)]
    population = spark.createDataFrame(rows, "project string, from_url string, to_url string, _ord long")
    size = 270  # of 900 at 95 % and 5 %
    picked = apportion.review_sample(population, 3)
    assert picked.count() == 900 and picked.where("sampled = '1'").count() == size
    keys = lambda df: sorted(r["from_url"] for r in df.where("sampled = '1'").collect())
    assert keys(picked) == keys(apportion.review_sample(population.repartition(7), 3))
    old = population.where("_ord % 9 = 0").selectExpr("*", "'1' AS label", "'#x' AS tags", "'n' AS notes", "'true' AS sampled")
    merged = apportion.review_sample(population, 3, old)
    assert merged.where("label = '1' AND sampled = '1' AND tags = '#x'").count() == 100 and merged.where("sampled = '1'").count() == size
