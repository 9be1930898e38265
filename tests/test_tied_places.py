"""Rows of a ground truth that tie in their place."""

from weftline.operators import regeneration


def test_tied_rows_stand_by_their_pair(spark):
    rows = [("p", f"t{i % 4}", f"m{i}", "1", 5) for i in range(12)]
    edges = spark.createDataFrame([], "project string, from_url string, to_url string, to_call_depth string, _ord long")
    methods = spark.createDataFrame([], "project string, url string, name string, artifact string, _ord long")
    for given in (rows, rows[::-1]):
        working = spark.createDataFrame(given, "project string, from_url string, to_url string, label string, _ord long")
        found = regeneration.regenerate(working, edges, methods, 3).orderBy("_ord").collect()
        assert [(r["from_url"], r["to_url"]) for r in found] == sorted((r[1], r[2]) for r in rows)
