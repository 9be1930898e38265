import random
import sys

import numpy as np
import pytest

from weftline.llm import bpe_automaton

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def codec():
    return bpe_automaton.WordCodec(bpe_automaton.word_model_path())


def test_new_words_and_identifiers_cost_few_python_calls(codec):
    """The CPU seconds of the query were mostly those of chunks that a worker had not met."""
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("ABCdefghinorst") for _ in range(9)) for _ in range(3000)})
    met = 0

    def tell(frame, event, arg):
        nonlocal met
        met += event == "call"

    sys.setprofile(tell)
    try:
        bpe_automaton._digests(codec, [" ".join(words).encode()])
    finally:
        sys.setprofile(None)
    assert met < 6 * len(words)


def test_names_are_joined_over_any_size(codec, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "PACKED_BYTES", 40)
    draw = np.random.default_rng(3)
    for sizes in ([0], [0, 0], [10], [11], [25, 0, 3, 7, 1, 10, 30], [1] * 50, []):
        lists = [draw.integers(0, 40_000, n).tolist() for n in sizes]
        packed = [np.array(ids, "<i4").tobytes() for ids in lists]
        assert bpe_automaton.joined(codec.written, packed) == [" ".join(map(str, ids)).encode() for ids in lists]
        assert bpe_automaton.joined(codec.labels, packed) == [codec.decode(ids).encode() for ids in lists]


def test_latin_chunks_split_as_the_library_does(codec):
    library = tokenizers.Tokenizer.from_file(bpe_automaton.word_model_path())
    draw = random.Random(12)
    for _ in range(3000):
        chunk = "".join(draw.choice("aBsTrevmlLd'''09.-_<|>~é²") for _ in range(draw.randrange(1, 12)))
        ids = library.encode(chunk, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode_text(chunk.encode())[1], "<i4").tolist() == ids, chunk
