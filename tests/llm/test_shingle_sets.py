"""The pipeline's near-dedup stage against exact five-word Jaccard similarity of all pairs."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import mixing, quality_rules, shingle_sets
from weftline.llm.common import read_table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets = [plain_set(t) for t in texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_stage_finds_all_pairs_of_similarity(spark):
    """Near copies with words changed here and there, chains of them, short, blank and exact copies."""
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(3000)}"
    texts = [None, "", " \n", "one two", "One  two", "a b c d e", "a b c d f"]
    for _ in range(40):
        words = [word() for _ in range(draw.randrange(50, 300))]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5, 8):
            for _ in range(changes * len(words) // 300 + 1):
                words[draw.randrange(len(words))] = word()
            texts.append(" ".join(words))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    least = {}
    for i, g in enumerate(plain_groups(texts)):
        least.setdefault(g, i)
    assert 45 < len(least) < len(texts) - 100
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(kept) == sorted(least.values())
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_links_within_blocks_join_what_all_links_join():
    """Families of one block and of several, dense and sparse, against all pairs of sets."""
    draw = np.random.default_rng(11)
    for n, spread in ((2, 1), (6, 12), (60, 6), (200, 20)):
        base = draw.choice(1 << 40, 100, replace=False)
        sets = []
        for _ in range(n):
            own = base.copy()
            change = draw.choice(100, draw.integers(0, spread + 1), replace=False)
            own[change] = draw.choice(1 << 40, len(change))
            sets.append(np.unique(own[: 100 - draw.integers(0, 3)]).astype(np.uint64))
        plain = [set(s.tolist()) for s in sets]
        alike = [[5 * len(a & b) >= 4 * len(a | b) for b in plain] for a in plain]
        block = draw.integers(0, 4 if n > 8 else 1, n)
        links = []
        for i in range(4):
            for j in range(i, 4):
                at = np.flatnonzero((block == i) | (block == j))
                if len(at) > 1 and (i == j or len(set(block[at])) == 2):
                    found = shingle_sets.verified([sets[k] for k in at], block[at])
                    assert len(found) < len(at)
                    links += [(at[a], at[b]) for a, b in found]
        assert groups(n, links) == groups(n, [(a, b) for a in range(n) for b in range(a) if alike[a][b]])


def groups(n, links):
    group = list(range(n))
    for a, b in links:
        if group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return group


def test_a_large_family_is_verified_in_blocks(spark):
    """2,000 near copies of one text lose no link and none is invented."""
    draw = random.Random(6)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(2000):
        words = list(base)
        for _ in range(draw.choice([1, 1, 1, 2, 3, 6, 12])):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    sets = [shingle_sets.shingles(t.encode()) for t in texts]
    everything = np.arange(len(sets))
    close = shingle_sets.alike_pairs(sets, everything, everything)
    some = draw.sample(range(2000), 40)
    for i in some[:20]:
        for j in some[20:]:
            assert close[i, j] == (5 * len(plain_set(texts[i]) & plain_set(texts[j])) >= 4 * len(plain_set(texts[i]) | plain_set(texts[j])))
    np.fill_diagonal(close, True)
    group = np.arange(2000)
    while True:
        least = np.array([min(group[i], group[np.flatnonzero(close[i])].min()) for i in range(2000)])
        if (least == group).all():
            break
        group = least
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(kept) == sorted(set(group.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")
def test_pipeline_drops_all_similar_documents(spark):
    """As test_pipeline, whose plain version links by 3 bits, but linking by similarity."""
    from test_quality import plain_kept

    documents = read_table(spark, SF, "documents")
    rules = quality_rules.fit(documents, read_table(spark, SF, "labels"))
    good = [r for r in documents.collect() if plain_kept(r["text"], rules)[1]]
    least = {}
    for r, g in zip(good, group := plain_groups([r["text"] for r in good])):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    single = spark.createDataFrame([r for r, g in zip(good, group) if least[g] == r["doc_id"]], documents.schema)
    copies = {r["key"]: r["copies"] for r in mixing.take(single).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == copies
