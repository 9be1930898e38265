"""Methods with their smells as bits against sets as arrays."""

import random

from weftline.operators import cubes


def rows_of(df):
    return sorted((r["strategy"], r["change"], r["from_url"], r["rg_group"], tuple(sorted(r["smells"]))) for r in df.collect())


def test_bits_hold_what_arrays_hold(spark):
    draw = random.Random(5)
    names = [f"s{i}" for i in range(150)]
    pick = lambda: draw.choice(["NTR", "ATR", "HTR", "", None, "AHTR", "odd"])
    rows = [(draw.choice("ab"), f"t{draw.randrange(120)}", draw.choice([None, "", " ", *[" ".join(draw.sample(names, 3)) for _ in range(3)]]), pick(), pick()) for _ in range(400)]
    df = spark.createDataFrame(rows, "strategy string, from_url string, smells string, rg_all string, rg_diff string")
    args = (["all", "diff", "absent"], ["NTR", "HTR", "MTR"], ["strategy"])
    found = cubes.grouped_methods(df, *args)
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()
    limit, cubes.MOST_MARKED = cubes.MOST_MARKED, 100
    try:
        plain = cubes.grouped_methods(df, *args)
    finally:
        cubes.MOST_MARKED = limit
    assert "collect_set" in plain._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found) == rows_of(plain) and len(rows_of(plain)) > 40
