"""Few groups that hold all pairs."""

from weftline.operators import evaluation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_groups_do_not_gather_all_pairs(spark):
    rows = spark.range(40).selectExpr("concat('p', id % 2) AS project", "concat('p', id % 2) AS experiment", "concat('t', id) AS from_url", "'m' AS to_url")
    members = spark.createDataFrame([("a", "p0"), ("b", "p0"), ("b", "p1")], "grp string, experiment string")
    found = evaluation.micro_average(rows, rows.where("from_url <> 't4'"), members)
    assert sorted((r["grp"], r["tp"], r["fp"], r["fn"]) for r in found.collect()) == [("a", 19, 1, 0), ("b", 39, 1, 0)]
    assert plan(found).count("BroadcastHashJoin") >= 2
