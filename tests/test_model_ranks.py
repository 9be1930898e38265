"""Names that tie in score and place."""

from weftline.operators import scoring


def test_tied_names_share_a_rank(spark):
    rows = [("t", "a", 0.5, 3), ("t", "b", 0.5, 3), ("t", "c", 0.4, 1), ("t", "a", 0.1, 4), ("u", "c", 0.4, 2)]
    df = spark.createDataFrame(rows, "from_url string, name string, score double, _ord long")
    found = {(r["from_url"], r["name"], r["rank"]) for r in scoring.model_rank(df).collect()}
    assert found == {("t", "a", 1), ("t", "b", 1), ("t", "c", 2), ("u", "c", 1)}
