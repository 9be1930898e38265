import random

from weftline.operators import graph


def test_closure_goes_beyond_64_levels(spark):
    pairs = spark.sql("SELECT id AS child, id + 1 AS parent FROM range(70) UNION ALL SELECT 70, 69")
    found = {(r["child"], r["ancestor"]): r["level"] for r in graph.closure(pairs).collect()}
    wanted = {(a, b): b - a for a in range(71) for b in range(a + 1, 71)} | {(70, 69): 1}
    assert {k: v for k, v in found.items() if k != (70, 69)} == {k: v for k, v in wanted.items() if k != (70, 69)}
    assert found[70, 69] == 1


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """2,000 names in a row, and a random graph against a plain search."""
    cuts = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    pairs = spark.range(1999).selectExpr("CAST(id AS STRING) AS child", "CAST(id + 1 AS STRING) AS parent")
    found = graph.closure(pairs)
    assert len(cuts) <= 12
    wrong = found.where("CAST(ancestor AS INT) - CAST(child AS INT) <> level").count()
    assert wrong == 0 and found.count() == 1999 * 2000 // 2
    draw = random.Random(5)
    edges = {(draw.randrange(60), draw.randrange(60)) for _ in range(90)}
    out = {}
    for start in range(60):
        seen, level, frontier = {start}, 0, {start}
        while frontier:
            level += 1
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            out |= {(start, b): level for b in frontier}
    df = spark.createDataFrame(sorted(edges), "child int, parent int")
    assert {(r["child"], r["ancestor"]): r["level"] for r in graph.closure(df).collect()} == out
    assert {(r["child"], r["ancestor"]): r["level"] for r in graph.closure(df, most=3).collect()} == {k: v for k, v in out.items() if v <= 3}


def test_a_hub_is_expanded_once(spark, monkeypatch):
    """20,000 tests call one helper that calls 40 methods: the frontier holds the helper once."""
    sizes = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: sizes.append((out := cut(df)).count()) or out)
    n, m = 20_000, 40
    edges = spark.range(n + m).selectExpr(
        f"CASE WHEN id < {n} THEN concat('t', id) ELSE 'h' END AS from_url", f"CASE WHEN id < {n} THEN 'h' ELSE concat('m', id - {n}) END AS to_url", "id AS _ord"
    )
    methods = spark.range(n + m + 1).selectExpr(
        f"CASE WHEN id < {n} THEN concat('t', id) WHEN id < {n + m} THEN concat('m', id - {n}) ELSE 'h' END AS url",
        f"CASE WHEN id >= {n} AND id < {n + m} THEN '#main-code' ELSE '#test-code' END AS artifact",
    )
    found = graph.expand_calls(edges, methods)
    assert found.where("to_call_depth = 2").count() == n * m and max(sizes) == m
    assert found.where("to_call_depth = 2 AND to_caller_url <> 'h'").isEmpty()
