"""Outliers from a histogram."""

from weftline.operators import smells


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outliers_take_a_histogram(spark):
    rows = [("a", float(v)) for v in [1, 2, 2, 3, 4, 5, 100]] + [("a", None), ("b", 1.0), ("c", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = smells.outliers(df, "v", ["g"])
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 8), ("b", 0, 1), ("c", 0, 1)]
    assert "percentile" not in plan(found)
    assert [tuple(r) for r in smells.outliers(df, "v").collect()] == [(1, 11)]
    assert [tuple(r) for r in smells.outliers(df.where("false"), "v").collect()] == [(0, 0)]
