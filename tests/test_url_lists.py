"""Lists of URLs without a row for each."""

from weftline.operators import signatures


def test_url_lists_of_shared_signatures(spark):
    mapped = spark.createDataFrame([("1", "f"), ("1", "f"), ("1", "g"), ("2", "g"), ("3", "none")], "call_id string, signature string")
    methods = spark.createDataFrame(
        [("f", "u9", 4), ("f", "u1", 5), ("g", "u1", 1), ("g", "u2", 7), ("g", "u2", 3), ("h", "u3", 0)], "signature string, url string, _ord long"
    )
    found = {r["call_id"]: r["urls"] for r in signatures.signatures_to_urls(mapped, methods).collect()}
    assert found == {"1": ["u1", "u2", "u9"], "2": ["u1", "u2"]}
    limit, signatures.LISTED_METHODS = signatures.LISTED_METHODS, 1
    try:
        assert {r["call_id"]: r["urls"] for r in signatures.signatures_to_urls(mapped, methods).collect()} == found
    finally:
        signatures.LISTED_METHODS = limit


def test_lists_are_merged_once_for_calls_of_the_same_signatures(spark):
    mapped = spark.range(60).selectExpr("CAST(id AS STRING) AS call_id", "explode(array('f', concat('g', id % 2))) AS signature")
    methods = spark.createDataFrame(
        [("f", "u5", 5), ("f", "u1", 1), ("g0", "u3", 3), ("g0", "u5", 2), ("g0", None, 9), ("g1", "u4", 4), (None, "u0", 0)], "signature string, url string, _ord long"
    )
    out = signatures.signatures_to_urls(mapped, methods)
    # Nothing that is shuffled holds a URL.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__l" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    want = {str(i): ["u1", "u4", "u5"] if i % 2 else ["u1", "u5", "u3", None] for i in range(60)}
    limits = signatures.LISTED_METHODS, signatures.CALLS_OF_ROW, signatures.URLS_OF_BATCH
    try:
        for signatures.LISTED_METHODS, signatures.CALLS_OF_ROW, signatures.URLS_OF_BATCH in (limits, (100, 7, 1), (1, 7, 1)):
            found = {r["call_id"]: r["urls"] for r in signatures.signatures_to_urls(mapped, methods).collect()}
            assert {k: sorted(map(str, v)) for k, v in found.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
            assert found["1"] == ["u1", "u4", "u5"] and found["0"] == ["u1", "u5", "u3", None]
            joined = signatures.signatures_to_urls(mapped, methods, joined="+")
            assert {r["call_id"]: r["urls"] for r in joined.collect()} == {k: "+".join(u for u in v if u) for k, v in want.items()}
    finally:
        signatures.LISTED_METHODS, signatures.CALLS_OF_ROW, signatures.URLS_OF_BATCH = limits
