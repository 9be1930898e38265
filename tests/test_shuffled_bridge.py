"""Frames that explode makes larger than the planner sees are not broadcast."""

from weftline.operators import smell_bridge


def test_no_broadcast_of_exploded_frames(spark):
    elements = spark.range(50).selectExpr("concat('a', id % 1) AS file", "id AS k", "CAST(id AS INT) AS f", "CAST(id + 1 AS INT) AS l")
    ranges = spark.range(20).selectExpr("concat('a', id % 1) AS file", "id", "CAST(id AS INT) AS s", "CAST(id + 3 AS INT) AS e")
    narrowed = smell_bridge.narrowed(elements, ranges, ["file"], "k", "s", "e", "f", "l")
    assert "Broadcast" not in narrowed._jdf.queryExecution().executedPlan().toString()
    assert narrowed.where("k = 4").count() == 3 and narrowed.where("k = 40").count() == 20
    raw = spark.range(9).selectExpr(
        "id AS _ord", "concat('/w/src/F', id, '.java') AS path", "'Eager Test' AS testSmellName", "'run, lost' AS testSmellMethod",
        "'5,8' AS testSmellLineBegin", "'6,9' AS testSmellLineEnd",
    )
    methods = spark.range(9).selectExpr("concat('src/F', id, '.java') AS file", "'run' AS name", "concat('u', id) AS url", "4 AS start", "7 AS end")
    for df in smell_bridge.smells_to_methods(raw, methods, {"Eager Test": "ET"}):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 9
