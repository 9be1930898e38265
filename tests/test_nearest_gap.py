"""Many events in one range of times."""

from weftline.operators import review


def test_a_range_of_many_events(spark):
    rows = spark.range(0, 400_000, 1, 1).selectExpr("id", "timestamp_seconds(1704067200 + id * 10) AS ts")
    found = review.nearest_gap(rows.where("id % 1000 <> 7"), rows.where("id % 1000 = 7").select("ts"))
    gaps = {r["id"]: round(r["gap_days"] * 8640) for r in found.where("id % 999 = 0").collect()}
    assert gaps == {i: min(abs(i - o) for o in range(7, 400_000, 1000)) for i in gaps}
    assert len(gaps) == len([i for i in range(0, 400_000, 999) if i % 1000 != 7])
