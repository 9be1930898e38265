import hashlib
import random
import zlib

import numpy as np
import pytest

from weftline.llm import bpe_automaton, token_count, token_files
from weftline.llm.common import scratch_path

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

CASES = [
    "", " ", "  ", "   a", "a  b", "a ", "\n", "\n\na", " \n ", "a \n b", "▁a▁▁b", "日本語 テキスト", "🙂🙂 a🙂", "<s> </s> <unk>",
    "a" * 300, " " * 90 + "x", "\x00a \x1f", "\x1cx\x85y", "it's we'll I'Ve x's", "İstanbul ǅ ß ŉ", "<|endoftext|>x<|startoftext|>",
    "é  x", "²³¼ 12 x9", "ΑΣ ΟΔΟΣ", "...... ----- !!!!!!", "mississippi banana " * 3, "ﬁ Å K", "a\r\nb\x0bc",
]


def random_texts(n):
    draw = random.Random(5)
    letters = "abehilnrst'éñ🙂<|>.!? \n09́ ß▁"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe_automaton.word_model_path())


def test_counts_match_the_library():
    path = token_count.piece_model_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_count.PieceCounter(path, cache_bytes=16_000)
    for text in CASES + random_texts(1500):
        assert counter.count(text.encode()) == len(model.encode(text)), repr(text)


def test_automaton_matches_the_library(library):
    codec = bpe_automaton.WordCodec(bpe_automaton.word_model_path(), cache_bytes=16_000)
    for text in CASES + random_texts(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        found, packed = codec.encode_text(text.encode())
        assert [int(i) for i in found.split()] == ids, repr(text)
        assert np.frombuffer(packed, "<i4").tolist() == ids
        assert codec.decode_packed(packed).decode() == library.decode(ids, skip_special_tokens=False), repr(text)


def merged_by_gadgets(merges, vocabulary):
    """The arcs of the automaton, gadget by gadget on a full matrix."""
    arcs = np.ones((len(vocabulary), len(vocabulary)), dtype=bool)
    live = [i for t, i in vocabulary.items() if len(t) == 1]
    for u, v in merges:
        i, j, k = vocabulary[u], vocabulary[v], vocabulary[u + v]
        arcs[k, live] = arcs[j, live]
        arcs[i, j] = False
        live.append(k)
        arcs[live, k] = arcs[live, i]
    return arcs


def test_compiled_arcs_are_those_of_the_gadgets():
    draw = random.Random(3)
    for _ in range(40):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 40:
            pair = (draw.choice(tokens), draw.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        vocabulary = {t: i for i, t in enumerate(draw.sample(tokens, len(tokens)))}
        automaton = bpe_automaton.TokenizationAutomaton(vocabulary, merges)
        arcs = merged_by_gadgets(merges, vocabulary)
        found = [[automaton.arc(x, y) for y in range(len(tokens))] for x in range(len(tokens))]
        assert np.array_equal(found, arcs)


def test_caches_are_bounded_in_bytes(library):
    """Long chunks are not kept, and many short ones take no more than the bound."""
    codec = bpe_automaton.WordCodec(bpe_automaton.word_model_path(), cache_bytes=100_000)
    counter = token_count.PieceCounter(token_count.piece_model_path(), cache_bytes=100_000)
    encoder = token_files.LibraryEncoder(token_files.word_model_path(), cache_bytes=100_000)
    draw = random.Random(9)
    for _ in range(30):
        chunk = "".join(draw.choice("abcdefghij") for _ in range(10_000))
        ids = library.encode(chunk, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode_text(chunk.encode())[1], "<i4").tolist() == ids
        assert np.frombuffer(encoder.ids(chunk.encode()), "<u2").tolist() == ids
        counter.count(chunk.encode())
    for memo in (codec.chunk, codec.word, counter.spaced, encoder.chunk):
        assert not memo and not memo.old
    for k in range(5000):
        for work in (codec.encode_text, counter.count, encoder.ids):
            work(b"w%d" % k)
    for memo in (codec.chunk, codec.word, counter.spaced, encoder.chunk):
        assert 0 < len(memo) + len(memo.old) < 1000


def test_automaton_on_small_vocabularies():
    """Against plain merging by rank, for merges of equal halves and overlapping pairs."""
    merges = [("a", "a"), ("b", "a"), ("aa", "b"), ("aa", "aa"), ("ba", "ba"), ("aab", "a"), ("b", "ba")]
    vocabulary = {t: i for i, t in enumerate(["a", "b", *[u + v for u, v in merges]])}
    automaton = bpe_automaton.TokenizationAutomaton(vocabulary, merges)
    rank = {m: r for r, m in enumerate(merges)}
    for bits in range(1 << 11):
        word = bin(bits)[2:].replace("1", "a").replace("0", "b")
        parts = list(word)
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not pairs:
                break
            at = min(pairs)[1]
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        assert automaton.encode(word) == [vocabulary[p] for p in parts], word


def test_count_query_on_odd_rows(odd_documents, no_documents):
    rows = token_count.query(odd_documents).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=token_count.piece_model_path())
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_bytes"] == len(text.encode())
        assert r["n_tokens"] == len(model.encode(text))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_count.query(no_documents).count() == 0


def test_codec_query_on_odd_rows(odd_documents, no_documents, library):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    rows = bpe_automaton.query(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_automaton.query(no_documents).count() == 0


def test_encode_then_decode_columns(spark, library):
    df = spark.createDataFrame([("Hello there",), (None,)], "text string")
    rows = bpe_automaton.decode(bpe_automaton.encode(df)).collect()
    ids = library.encode("Hello there", add_special_tokens=False).ids
    assert [r["token_ids"] for r in rows] == [ids, []]
    assert [r["decoded_text"] for r in rows] == [library.decode(ids, skip_special_tokens=False), ""]


def test_token_files_hold_the_stream(odd_documents, no_documents, library):
    texts = [(r["doc_id"], r["text"] or "") for r in odd_documents.collect()]
    rows = token_files.query(odd_documents).collect()
    rows.sort(key=lambda r: r["start"])
    assert len(rows) == len(texts)
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    by_key = dict(texts)
    start = 0
    for r in rows:
        ids = [*library.encode(by_key[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert token_files.query(no_documents).count() == 0


def test_sequences_are_views_with_masks(spark, library):
    df = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string").coalesce(1)
    folder = scratch_path(spark, "sequences")
    index = token_files.write_token_files(df, folder, length=16)
    total = index.agg({"n_tokens": "sum"}).first()[0]
    seen = 0
    for row in index.select("file").distinct().collect():
        opened = token_files.SequenceFile(row["file"])
        count = sum(opened.reader.get_batch(i).num_rows for i in range(opened.reader.num_record_batches))
        for k in range(count):
            ids, mask = opened.sequence(k)
            assert len(ids) == len(mask) == 16
            assert not ids.flags.owndata
            seen += sum(mask.to_pylist())
    assert seen == total
