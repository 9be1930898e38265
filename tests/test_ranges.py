"""Step distributions of values far apart and the binned join of ranges against plain versions."""

import random

from weftline.operators import revisions, smell_bridge


def test_a_far_value_makes_no_rows_in_between(spark):
    df = spark.createDataFrame([(0,), (0,), (10**9,), (-5,), (None,)], "v long")
    assert sorted(tuple(r) for r in revisions.step_cdf(df, "v").collect()) == [(-5, -1, 0.25), (0, 10**9 - 1, 0.75), (10**9, 10**9, 1.0)]
    shown = sorted(tuple(r) for r in revisions.dense_cdf(df, "v", -7, 2).collect())
    assert shown == [(-5, 0.25), (-4, 0.25), (-3, 0.25), (-2, 0.25), (-1, 0.25), (0, 0.75), (1, 0.75), (2, 0.75)]
    hit = revisions.coverage_threshold(revisions.step_cdf(df, "v"), "v", 0.7).first()
    assert (hit["threshold"], hit["covered"]) == (0, 75.0)
    assert revisions.step_cdf(df.where("v > 10e9"), "v").count() == 0


def test_nested_and_overlapping_ranges(spark):
    draw = random.Random(2)
    ranges = [(draw.choice("ab"), i, (s := draw.randrange(1, 3000)), s + draw.choice([-1, 0, 3, 40, 900, 5000])) for i in range(400)]
    elements = [(draw.choice("abc"), i, (f := draw.randrange(1, 4000)), f + draw.choice([0, 1, 30, 700])) for i in range(300)]
    elements += [("a", 900, None, None), ("a", 901, 5, 4)]
    df = spark.createDataFrame(elements, "file string, k int, f int, l int")
    known = spark.createDataFrame(ranges, "file string, id int, s int, e int")
    inside = {(k, i) for a, k, f, last in elements for b, i, s, e in ranges if a == b and f is not None and f <= last and s <= f and last <= e}
    found = smell_bridge.containing(df, known, ["file"], "s", "e", "f", "l")
    assert {(r["k"], r["id"]) for r in found.collect()} == inside and found.count() == len(inside)
    hit = {k for k, _ in inside}
    rest = {(k, i) for a, k, _, _ in elements for b, i, _, _ in ranges if a == b and k not in hit}
    assert {(r["k"], r["id"]) for r in smell_bridge.narrowed(df, known, ["file"], "k", "s", "e", "f", "l").collect()} == inside | rest


def test_elements_outside_all_ranges_of_one_key_fill_many_tasks(spark):
    elements = spark.range(60).selectExpr("concat('a', id % 2) AS file", "id AS k", "IF(id < 40, 900, CAST(id AS INT)) AS f", "IF(id < 40, 901, CAST(id AS INT)) AS l")
    ranges = spark.range(500).selectExpr("concat('a', id % 4) AS file", "id", "CAST(id % 300 AS INT) AS s", "CAST(id % 300 + 40 AS INT) AS e")
    limit, smell_bridge.PAIRS_OF_TASK = smell_bridge.PAIRS_OF_TASK, 250
    try:
        out = smell_bridge.narrowed(elements, ranges, ["file"], "k", "s", "e", "f", "l").cache()
    finally:
        smell_bridge.PAIRS_OF_TASK = limit
    far = out.where("k < 40")
    assert far.count() == 40 * 125 and far.select("k", "id").distinct().count() == 40 * 125
    assert far.where("substr(file, 2) <> k % 2 OR id % 4 <> k % 2").count() == 0
    shares = [n for n in far.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    # One key has 2,500 such pairs, which one task made before.
    assert len(shares) > 4 and max(shares) < 2000
    near = {(k, i) for k in range(40, 60) for i in range(500) if i % 4 == k % 2 and i % 300 <= k <= i % 300 + 40}
    assert {(r["k"], r["id"]) for r in out.where("k >= 40").collect()} == near and len(near) == out.where("k >= 40").count()
