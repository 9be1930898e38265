import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import maxent_lm as lm


def plain_tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in text.encode().split()] + [b""]


def is_held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 10 == 0


def check_base(rows, documents):
    counts = Counter()
    for key, text in documents:
        if not is_held_out(key):
            counts.update(plain_tokens(text))
    total = sum(counts.values())
    texts = {}
    for key, text in documents:
        texts.setdefault(key, text)
    assert len(rows) == len(documents)
    for r in rows:
        t = plain_tokens(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in t)
        assert r["held_out"] == is_held_out(r["doc_id"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(2)
    vocabularies = [[a + b + e for a in x for b in x for e in x] for x in ("abc", "mno", "xyz")]
    rows = []
    for i in range(1200):
        words = vocabularies[i % 3]
        weights = [1 / (k + 1) for k in range(len(words))]
        rows.append((i, " ".join(draw.choices(words, weights, k=draw.randrange(20, 60)) + [f"rare{i}"])))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_base_counts_are_exact_and_the_model_learns(corpus):
    df, documents = corpus
    rows = lm.train_and_score(df, head=40).collect()  # most words come by the join
    check_base(rows, documents)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_head_size_does_not_change_base_scores(corpus):
    df, documents = corpus
    check_base(lm.train_and_score(df, head=100_000).collect(), documents)


@pytest.fixture(scope="module")
def learned_model(corpus):
    df, _ = corpus
    learned = lm.train_documents(df, "doc_id", "text")
    words = lm.count_words(learned).cache()
    vocabulary = lm.read_vocabulary(words, 60)
    return learned, words, vocabulary, lm.train(learned, vocabulary)


def inside(model, vocabulary, word, count, code, context):
    """log10 of P(word | class, context), class by class over plain numbers."""
    place, kind, _ = (int(v[0]) for v in lm.unpack(code))
    if kind < lm.SINGLES:
        return 0.0
    weight = float(model.pairs[context, place]) if place >= 0 else 0.0
    return math.log10(count + lm.SMOOTH) + weight / math.log(10) - model.sums[context, kind]


def test_probabilities_sum_to_one(learned_model):
    """Over the vocabulary and each class's unseen word, for any history."""
    _, words, vocabulary, model = learned_model
    assert np.abs(model.pairs).max() > 0.5
    history = [[b"abc", b"bca"], [b"mno"], [], [b"never seen", b"xyz"]]
    encoder = lm.Encoder(vocabulary.head)
    counts = {bytes(r["word"]): r["count"] for r in words.collect()}
    for before in history:
        codes = encoder.codes([*before, b"x"])
        start = np.arange(len(codes)) == 0
        _, kinds, row = lm.unpack(codes)
        context = int(lm.contexts(kinds, start)[-1])
        classes = np.exp(lm.log_classes(model.weights, lm.features(lm.histories(row, start)[-1:])))[0]
        assert classes.sum() == pytest.approx(1, abs=1e-5)
        total = 0.0
        for word, n in counts.items():
            code = encoder.codes([word])
            total += classes[int(lm.unpack(code)[1][0])] * 10 ** inside(model, vocabulary, word, n, code, context)
        total += sum(classes[k] * lm.SMOOTH / 10 ** model.sums[context, k] for k in range(lm.SINGLES, lm.CLASSES))
        assert total == pytest.approx(1, abs=1e-5)


def test_steps_lower_the_loss_and_do_not_depend_on_partitions(learned_model):
    learned, _, vocabulary, model = learned_model
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])), model.losses
    again = lm.train(learned.repartition(7), vocabulary)
    assert (model.weights == again.weights).all() and (model.pairs == again.pairs).all()


def test_pair_weights_climb_to_the_observed_shares():
    draw = np.random.default_rng(5)
    mass, met = draw.integers(20, 200, 12) + 0.1, np.array([900.0, 0.0, 300.0])
    observed = np.stack([draw.multinomial(800, draw.dirichlet(np.ones(12) * 3)), np.zeros(12), draw.multinomial(250, np.ones(12) / 12)])
    weights = lm.pair_weights(observed.astype(float), mass, met, mass.sum() + 50)
    risen = mass * np.exp(weights)
    share = risen / (mass.sum() + 50 + (risen - mass).sum(axis=1, keepdims=True))
    usual = mass / (mass.sum() + 50)
    for c in (0, 2):
        before, after = (np.abs(met[c] * p - observed[c]).sum() for p in (usual, share[c]))
        assert after < 0.4 * before
    assert (weights[1] == 0).all()


def test_scores_match_direct_evaluation(spark, corpus, learned_model):
    """Texts of the corpus, and one that is read in several pieces."""
    _, documents = corpus
    _, words, vocabulary, model = learned_model
    counts = {bytes(r["word"]): r["count"] for r in words.collect()}
    encoder = lm.Encoder(vocabulary.head)
    texts = dict(documents[:20])
    texts[5000] = " ".join(text for _, text in documents * 20) + " unseen words here" + " \t" * 9
    assert len(list(lm.pieces(texts[5000].encode()))) > 2
    assert [w for p in lm.pieces(texts[5000].encode()) for w in p] == plain_tokens(texts[5000])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in lm.score(df, words, vocabulary, model).collect():
        t = plain_tokens(texts[r["doc_id"]])
        codes = encoder.codes(t)
        start = np.arange(len(t)) == 0
        _, kind, row = lm.unpack(codes)
        context = lm.contexts(kind, start)
        logs = lm.log_classes(model.weights, lm.features(lm.histories(row, start)))
        wanted = 0.0
        for i, w in enumerate(t):
            wanted += logs[i, kind[i]] / math.log(10)
            wanted += inside(model, vocabulary, w, counts.get(w, 0), codes[i : i + 1], context[i])
        assert r["score"] == pytest.approx(wanted, rel=1e-5)


def test_odd_rows(odd_documents, no_documents, spark):
    documents = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    rows = lm.query(odd_documents).collect()
    check_base(rows, documents)
    assert all(math.isfinite(r["score"]) for r in rows)
    assert lm.query(no_documents).count() == 0
    held = next(i for i in range(100) if is_held_out(i))
    only_held = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert [r["n_known"] for r in lm.query(only_held).collect()] == [0]
