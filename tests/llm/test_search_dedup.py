import math
import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from weftline.llm import simhash, topk_search


def plain_top(rows, k=10):
    vectors = [
        (i, [math.floor(1024 * Fraction(float(x))) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i in sorted({i for i, _ in vectors if i % 100 == 0}):
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v)), j)
            for n, q in vectors
            for j, v in vectors
            if n == i and j != i and len(v) == len(q)
        )
        out += [(i, r, j, max(-(1 << 63), min(-s, (1 << 63) - 1))) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(n, width=6, seed=2):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(draw.normal(size=width), 1)]) for i in range(n)]


def found_top(df, **more):
    found = topk_search.top_k(topk_search.whole_vectors(df, "vec_id", "embedding"), F.col("id") % 100 == 0, **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("shard", [64, 8192])
def test_top_k_matches_brute_force(spark, shard):
    rows = vectors(900) + [(1000 + i, [0.5] * 6) for i in range(300)] + [(5, vectors(6)[5][1])] * 3 + [(300, [0.1] * 6)]
    rows += [(2001, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [math.inf] * 6), (2300, [math.nan] * 6), (None, [1.0] * 6)]
    rows += [(3000 + i, [float(i), 1.0]) for i in range(250)] + [(4000, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found_top(df, shard=shard) == plain_top([(r[0], r[1]) for r in df.collect()])


def test_top_k_of_large_components(spark):
    """Scores beyond what 64-bit floats hold, beyond 64 bits, and beyond what a float's exponent holds."""
    rows = vectors(420) + [(501, [3e6] * 6), (502, [3e6, 3e6, 3e6, 3e6, 3e6, 3000000.001])]
    assert found_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=64) == plain_top(rows)
    rows += [(500 + 100 * i, [(-7.0) ** (2 * i + 9)] * 6) for i in range(1, 8)] + [(1301, [1e300, -1e300, 1.7e308, 1.0, 2.0, 0.0])]
    assert found_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=64) == plain_top(rows)


def test_queries_visit_few_cells(spark):
    """On separate clusters a query is kept from most shards, and a repeated vector splits over tasks."""
    draw = np.random.default_rng(8)
    middles = draw.normal(size=(40, 3)) * 50
    rows = [(i, [float(x) for x in middles[i % 40] + draw.normal(size=3)]) for i in range(4000)]
    rows += [(100 * i, [1.0, 1.0, 1.0]) for i in range(41, 60)] * 2
    assert found_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=100) == plain_top(rows)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    assert topk_search.query(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], "x")], schema)
    assert topk_search.query(one).count() == 0
    three = spark.createDataFrame([(0, [1.0, 2.0], "x"), (3, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")], schema)
    assert [tuple(r) for r in topk_search.query(three).orderBy("rank").collect()] == [(0, 1, 2, 5 * 1024**2), (0, 2, 3, 5 * 1024**2)]


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_fingerprints_match_plain_counting(odd_documents):
    for r in simhash.fingerprints(odd_documents, keep=["doc_id", "text"]).collect():
        assert r["fingerprint"] % (1 << 64) == plain_print(r["text"])


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_manhattan_bound_never_exceeds_hamming():
    draw = np.random.default_rng(4)
    a = draw.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for flips in range(6):
        b = a.copy()
        for _ in range(flips):
            b ^= np.uint64(1) << draw.integers(0, 64, 2000, dtype=np.uint64)
        assert (simhash.near(a, b, 3) == (np.bitwise_count(a ^ b) <= 3)).all()


@pytest.mark.parametrize("cell", [8, 4096])
def test_components_match_brute_force(spark, cell):
    draw = random.Random(6)
    prints = [draw.getrandbits(64) for _ in range(150)]
    for _ in range(4):  # chains, and a large group around one fingerprint
        prints += [p ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for p in prints[:60]]
    prints += [prints[0] ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for _ in range(250)]
    prints = list(dict.fromkeys(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint long")
    links = simhash.near_links(df, cell=cell)
    for a, b in links.collect():
        assert ((a ^ b) % (1 << 64)).bit_count() <= 3
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert same_partition([root.get(p, p) for (p,) in signed], plain_components(prints))


def test_long_chain_of_links(spark):
    links = spark.sql("SELECT id AS a, id + 1 AS b FROM range(300)")
    rows = simhash.components(links).collect()
    assert {r["node"] for r in rows} == set(range(301)) and {r["root"] for r in rows} == {0}


def test_query_on_odd_rows(odd_documents, no_documents):
    documents = odd_documents.collect()
    rows = simhash.query(odd_documents).collect()
    assert len(rows) == len(documents)
    prints = [plain_print(r["text"]) for r in documents]
    group = plain_components(prints)
    least = {}
    for r, g in zip(documents, group):
        if r["doc_id"] is not None:
            least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    wanted = sorted((repr(r["doc_id"]), f"{p:016x}", repr(least.get(g))) for r, p, g in zip(documents, prints, group))
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in rows) == wanted
    assert simhash.query(no_documents).count() == 0


def test_one_of_each_component_stays(odd_documents, no_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    components = simhash.query(odd_documents).select("component_id").distinct().collect()
    assert ids == sorted((r["component_id"] for r in components), key=repr)
    assert simhash.keep_one(no_documents).count() == 0
