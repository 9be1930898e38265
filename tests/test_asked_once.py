"""A provider is asked once for each case."""

from pyspark.sql import functions as F

from weftline.operators import model_runs


def test_links_ask_the_provider_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def provider(asked):
        with open(log, "a") as file:
            file.write("x\n" * len(asked))
        return ['{"methods": [{"name": "f", "confidence": 0.5}]}' for _ in asked]

    each = F.array(F.struct(F.lit("c1").alias("id"), F.lit("f(int)").alias("signature")))
    cases = spark.range(5).select(F.col("id").cast("string").alias("from_url"), each.alias("candidates"), F.lit("q").alias("prompt_text"))
    urls = cases.select("from_url", F.lit("c1").alias("candidate_id"), F.lit("m").alias("to_url"))
    found = model_runs.predicted_links(cases, model_runs.run_cases(cases, provider), urls).collect()
    assert [(r["to_url"], r["prediction"], r["confidence"]) for r in found] == [("m", 1, 0.5)] * 5
    assert len(open(log).readlines()) == 5
