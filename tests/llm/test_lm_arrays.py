import random
import sys
import zlib

import pytest

from weftline.llm import maxent_lm as lm


def test_endings_are_checksums_of_the_last_three_bytes():
    draw = random.Random(4)
    words = [bytes(draw.randrange(256) for _ in range(draw.randrange(6))) for _ in range(2000)]
    found = lm.endings(lm.pa.array(words, lm.pa.binary())[7:])
    assert found.tolist() == [zlib.crc32(w[-3:]) & 0xFFFFFF for w in words[7:]]
    assert lm.endings(lm.pa.array([b""], lm.pa.binary())).tolist() == [0]


def test_spans_split_at_the_six_characters_only():
    draw = random.Random(6)
    spaces = [bytes([b]) for b in b" \t\n\x0b\x0c\r"]
    texts = [b"", b" \t", b"x", b" X ", "É\x85  Ab\x1c\x1f\x00 　Q".encode()]
    texts += [b"".join(draw.choice([*spaces, b"aB", bytes([k])]) for k in range(256)) for _ in range(20)]
    for text in texts:
        assert [w for p in lm.pieces(text) for w in p] == [*text.lower().split(), b""], text


def test_counts_are_merged_whenever_many_words_are_held(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNT_ENTRIES", 20)  # of the function that is sent to workers
    texts = [(f"same w{k} w{k % 7} w{k} w{k % 50}",) for k in range(2000)]
    df = spark.createDataFrame(texts, "text string").repartition(1)
    counts = {bytes(r["word"]): r["count"] for r in lm.count_words(df.selectExpr("cast(text as binary) text")).collect()}
    plain = lm.np.unique([w for t, in texts for w in t.split()], return_counts=True)
    assert counts == {**{w.encode(): int(n) for w, n in zip(*plain)}, b"": 2000}


def calls(work):
    """Python functions called by ``work``."""
    met = 0

    def tell(frame, event, arg):
        nonlocal met
        met += event == "call"

    sys.setprofile(tell)
    try:
        work()
    finally:
        sys.setprofile(None)
    return met


@pytest.mark.parametrize("known", [0, 20_000])
def test_words_cost_no_python_call_each(known):
    """The CPU seconds of training and scoring were mostly calls for words that a worker had not met."""
    encoder = lm.Encoder({b"w%d" % k: k for k in range(known)})
    texts = [b" ".join(b"w%d" % (40 * t + k) for k in range(40)) for t in range(500)]
    assert calls(lambda: list(lm._slabs(texts, encoder))) < 10_000
