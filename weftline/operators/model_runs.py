"""Linking with a language model: open cases, batched calls, parsed answers, stored runs.

A case is one test with its candidates, as ``signatures.prompt_cases`` makes it.  A provider is a
function from a list of prompts to a list of answers; it is called in the tasks, a batch of prompts
at a time, so it must be picklable and make its own connection.  What is done is in the store of
runs, and a run takes up where one ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.strings import lenient_json
from weftline.operators.relational import keep_first, union_all
from weftline.operators.signatures import candidate_ids
from weftline.session import cut_lineage

DONE, ERROR = "done", "error"
RUNS = "from_url string, status string, answer string, error string"
ANSWER = "methods array<struct<name:string,confidence:double>>"


def open_cases(cases: DataFrame, runs: DataFrame, resume: str = "all") -> DataFrame:
    """Cases still to be run: ``none`` takes all, ``all`` those without a run, ``error`` also failed ones."""
    if resume == "none":
        return cases
    if resume not in ("all", "error"):
        raise ValueError("resume is none, all or error")
    kept = runs if resume == "all" else runs.where(F.col("status") == DONE)
    return cases.join(kept.select("from_url").distinct(), "from_url", "left_anti")


def run_cases(cases: DataFrame, provider: Callable[[Sequence[str]], Sequence[str]], batch: int = 16) -> DataFrame:
    """Answers to prompt_text: from_url, status, answer, error; a failing batch marks its own cases only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                out = {"from_url": part["from_url"], "status": DONE, "answer": None, "error": None}
                try:
                    out["answer"] = list(provider(part["prompt_text"].tolist()))
                except Exception as problem:  # a provider's failure is a result
                    out |= {"status": ERROR, "error": str(problem)[:256]}
                yield pd.DataFrame(out)

    return cases.select("from_url", "prompt_text").mapInPandas(run, RUNS)


def merged_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the new runs; a new one takes the place of an old one."""
    both = union_all([runs.withColumn("__age", F.lit(1)), new.withColumn("__age", F.lit(0))])
    return keep_first(both, ["from_url"], ["__age"]).drop("__age")


def predicted_links(cases: DataFrame, runs: DataFrame, urls: DataFrame) -> DataFrame:
    """(from_url, to_url, prediction, confidence): every candidate of an answered case, 1 where the answer
    names it. urls: from_url, candidate_id, to_url.

    Answers are parsed once into a table: two branches read them, and each would ask the provider anew."""
    parsed = F.from_json(lenient_json(F.col("answer")), ANSWER)["methods"]
    done = cut_lineage(runs.where(F.col("status") == DONE).select(F.col("from_url").alias("case_id"), parsed.alias("__methods")))
    named = done.select("case_id", F.explode("__methods").alias("__m")).select("case_id", "__m.name", "__m.confidence")
    each = cases.select(F.col("from_url").alias("case_id"), F.explode("candidates").alias("c"))
    each = each.select("case_id", F.col("c.id").alias("candidate_id"), F.col("c.signature").alias("signature"))
    hits = candidate_ids(named.select("case_id", "name").distinct(), each).join(named, ["case_id", "name"])
    best = hits.groupBy("case_id", "candidate_id").agg(F.max("confidence").alias("confidence"))
    answered = done.select("case_id").distinct()
    rows = each.join(answered, "case_id").join(best.withColumn("__hit", F.lit(1)), ["case_id", "candidate_id"], "left")
    links = rows.join(urls.withColumnRenamed("from_url", "case_id"), ["case_id", "candidate_id"])
    return links.select(
        F.col("case_id").alias("from_url"), "to_url", F.coalesce("__hit", F.lit(0)).alias("prediction"), "confidence"
    )
