"""Rows that share an id, or have none, are documents of their own in the stages that join back."""

import random
from collections import Counter

import pytest

from weftline.llm import mixing, shingle_sets, simhash

SCHEMA = "doc_id long, text string, source string"


def words(seed, n=80):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("stage", [simhash.keep_one, shingle_sets.keep_one])
def test_unlike_texts_of_one_id_all_stay(spark, stage):
    rows = [(None, words(i), "a") for i in range(20)] + [(7, words(i), "b") for i in range(20, 40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, stage(df).collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("stage", [simhash.keep_one, shingle_sets.keep_one])
def test_a_copy_goes_though_its_id_stays_elsewhere(spark, stage):
    rows = [(3, words(1), "a"), (5, words(1), "a"), (5, words(2), "a"), (6, words(3), "a"), (6, words(3), "a")]
    kept = stage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2], rows[3]]


def test_copies_stay_with_the_source_that_drew_them(spark):
    """All documents have one id; each source still gets the copies drawn for it."""
    rows = [(1, words(i, 30), f"s{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    drawn = Counter()
    targets = {}
    for r in mixing.source_targets(mixing.word_counts(df, keep=["source"])).collect():
        targets[r["source"]] = r["target"] / 30
    for r in mixing.mix(df).collect():
        drawn[r["source"]] += 1
    assert all(abs(drawn[s] - targets[s]) <= 2 for s in targets), (drawn, targets)
