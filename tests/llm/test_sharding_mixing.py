import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import mixing, sharding


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    for shards in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def check_shards(rows, n):
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 40
        assert r["grown_shard"] in (r["shard"], 40)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_shards_on_odd_rows(odd_documents, no_documents):
    rows = sharding.query(odd_documents).collect()
    check_shards(rows, odd_documents.count())
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    assert sharding.query(no_documents).count() == 0


def test_hot_key_is_numbered_whole(spark):
    df = spark.sql("SELECT if(id < 70000, 7, id) AS doc_id, 'a' AS text FROM range(100000)")
    check_shards(sharding.query(df).collect(), 100_000)


def test_growth_moves_a_fair_share(spark):
    rows = sharding.assign_shards(spark.range(20_000), "id", 40).collect()
    moved = sum(r["shard"] != r["grown_shard"] for r in rows)
    assert 300 < moved < 700  # 20000 / 41 = 488
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) < 1.25 * min(counts.values())


def plain_targets(sizes, repeat=3):
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, targets, free = sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(targets.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > repeat * sizes[s]}
        if not over:
            return targets | {s: level * weights[s] for s in free}
        targets |= {s: repeat * sizes[s] for s in over}
        free -= over
    return targets


def check_mix(rows, documents, slack):
    sizes, taken, targets = Counter(), Counter(), {}
    source = {r["doc_id"]: r["source"] for r in documents}
    text = {r["doc_id"]: r["text"] or "" for r in documents}
    assert len(rows) == len(documents)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(text[r["doc_id"]].encode().split())
        assert r["taken"] <= 3 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
    wanted = plain_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(wanted[s])
        assert abs(taken[s] - wanted[s]) <= slack(s), s


def test_mix_on_odd_rows(odd_documents, no_documents):
    documents = odd_documents.collect()
    rows = mixing.query(odd_documents).collect()
    largest = Counter()
    for r in documents:
        largest[r["source"]] = max(largest[r["source"]], len((r["text"] or "").encode().split()))
    check_mix(rows, documents, lambda s: 2 * largest[s])
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.query(odd_documents.repartition(5)).collect()), key=repr)
    assert mixing.query(no_documents).count() == 0


def test_mix_comes_near_its_targets(spark):
    df = spark.sql(
        "SELECT id AS doc_id, repeat('w ', cast(1 + pmod(hash(id), 50) as int)) AS text, "
        "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source FROM range(20000)"
    )
    check_mix(mixing.query(df).collect(), df.collect(), lambda s: 110)


def test_equal_rows_spread_over_blocks_and_share_their_copies(spark):
    """Most rows are one row: no task gets them all, and the mix still meets its targets."""
    rows = [(None, "one two three", "a")] * 6000 + [(i, "w " * (i % 9), "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken = mixing.query(df).collect()
    assert len(taken) == len(rows)
    target = {r["target"] for r in taken if r["size"] == 3 and r["doc_id"] is None}.pop()
    assert abs(sum(r["taken"] for r in taken if r["doc_id"] is None) - target) <= 6
    mixed = Counter(r["source"] for r in mixing.mix(df).collect())
    assert abs(mixed["a"] * 3 - target) <= 6


def test_blocks_and_levels_balance(spark):
    units = spark.sql("SELECT id AS key, 1 + id % 9 AS size, 'a' AS source FROM range(5000)")
    targets = mixing.source_targets(units.unionByName(spark.sql("SELECT 0 AS key, 40000 AS size, 'b' AS source")))
    rows = mixing.mix_units(units, targets, block=64).collect()
    assert len(rows) == 5000
    assert abs(sum(r["size"] * r["copies"] for r in rows) - rows[0]["target"]) <= 20


def test_flight_is_right_on_average():
    chance, size = np.array([0.2, 0.5, 0.7, 0.35, 0.25]), np.array([3.0, 1.0, 4.0, 1.0, 5.0])
    runs = [mixing.flight(chance, size, np.random.default_rng(s), True) for s in range(4000)]
    assert set(np.unique(runs)) <= {0.0, 1.0}
    assert np.allclose(np.mean(runs, axis=0), chance, atol=0.03)
    assert all(abs(r.sum() - 2) < 1.01 for r in runs)


def test_mix_repeats_rows(odd_documents, no_documents):
    out = mixing.mix(odd_documents)
    assert out.columns == odd_documents.columns
    copies = sum(r["copies"] for r in mixing.take(odd_documents).collect())
    assert out.count() == copies
    assert mixing.mix(no_documents).count() == 0
