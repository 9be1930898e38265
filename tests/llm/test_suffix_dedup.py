"""Operator 12 against brute force, its sorter against plain sorting, and its SQL."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

from weftline.llm import suffix_dedup
from weftline.llm.deep_shallow import BlindTrie, deep_shallow_sort, words_of
from weftline.llm.queries import ORACLE_SQL, QUERIES


def plain(rows, length=100):
    """(key, bytes, removed, spans, digest, kept) of rows whose keys differ."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((repr(key), len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def found(df, **more):
    rows = suffix_dedup.dedup(df, keep_text=True, **more).collect()
    for r in rows:
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
    return sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows)


def passage(draw, n, letters="abcdefghijklmnop é"):
    return "".join(draw.choice(letters) for _ in range(n))


def corpus(seed, n=60):
    """Shared passages of about the least length, near copies, repeats within a text, copies."""
    draw = random.Random(seed)
    shared = [passage(draw, k) for k in (40, 80, 98, 99, 100, 101, 130, 250, 600)]
    rows = []
    for i in range(n):
        parts = [draw.choice([passage(draw, draw.randrange(60)), draw.choice(shared), draw.choice(shared)[draw.randrange(30) :]]) for _ in range(draw.randrange(7))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[i][1][: draw.randrange(400)] + "~" + rows[i][1][draw.randrange(40) :]) for i in range(20)]
    rows += [(200 + i, rows[3][1] + rows[4][1]) for i in range(5)] + [(300, None), (301, ""), (302, "x" * 99), (303, "x" * 5000), (None, shared[-1])]
    rows += [(304, "ab" * 700 + "abc" * 300), (305, "ab" * 40 + "abc" * 40), (306, passage(draw, 200) * 3)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, digest string, rows long").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(table(spark, rows)) == plain(rows)


def test_a_gram_of_many_contexts_is_dealt_into_blocks(spark, monkeypatch):
    """One passage in all documents, with borders of their own; blocks of few contexts."""
    draw = random.Random(3)
    line = passage(draw, 160)
    rows = [(i, passage(draw, 150 + i % 3) + line + passage(draw, 150)) for i in range(150)]
    rows += [(500 + i, rows[i][1][120:330]) for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 8)
    assert found(table(spark, rows)) == plain(rows)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "SLICE", 900)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 500)
    rows = [(i, t) for i, t in corpus(4, 30)] + [(400, "".join(t or "" for _, t in corpus(5, 20)))]
    assert found(table(spark, rows)) == plain(rows)


def test_another_length(spark):
    rows = corpus(6)
    assert found(table(spark, rows), length=64) == plain(rows, 64)


def test_rows_that_share_a_key(spark):
    """Equal rows: one is first.  Different texts under one key: in some fixed order, each once."""
    draw = random.Random(7)
    a, b = passage(draw, 300), passage(draw, 300)
    got = found(table(spark, [(1, a)] * 4 + [(2, a), (2, a), (None, b), (None, b), (3, "short"), (3, "short")]))
    assert [(k, n, gone) for k, n, gone, *_ in got] == sorted(
        [("1", len(a.encode()), 0)] + [("1", len(a.encode()), len(a.encode()))] * 3 + [("2", len(a.encode()), len(a.encode()))] * 2
        + [("None", len(b.encode()), 0), ("None", len(b.encode()), len(b.encode()))] + [("3", 5, 0)] * 2
    )
    shared = passage(draw, 200)
    got = found(table(spark, [(5, shared + a), (5, shared + b)]))
    assert sorted(r[2] for r in got) == [0, len(shared.encode())]


def test_odd_documents(spark, odd_documents, no_documents):
    assert suffix_dedup.query(no_documents).count() == 0
    distinct = odd_documents.dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in distinct.select("doc_id", "text").collect()]
    assert found(distinct) == plain(rows)


def test_sorter_matches_plain_sorting():
    draw = np.random.default_rng(1)
    for letters, length in ((2, 9), (2, 100), (4, 30), (250, 100)):
        buffer = draw.integers(0, letters, 3000).astype(np.uint8)
        buffer[1500:2500] = buffer[300:1300]
        starts = draw.integers(0, len(buffer) - length, 2000)
        sizes = np.array([500, 0, 1, 999, 500])
        data = buffer.tobytes()
        order, number = deep_shallow_sort(data, words_of(buffer), starts, length, sizes, shallow=16)
        for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            strings = [data[starts[i] : starts[i] + length] for i in order[a:b]]
            assert strings == sorted(strings) and sorted(order[a:b]) == list(range(a, b))
            assert [x == y for x, y in zip(strings, strings[1:])] == (np.diff(number[a:b]) == 0).tolist()


def test_blind_trie_orders_strings():
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab") for _ in range(12)).encode() for _ in range(500)]
    trie = BlindTrie()
    for i, text in enumerate(texts):
        trie.insert(text, i)
    leaves = [[texts[i] for i in members] for members in trie.leaves()]
    assert [m[0] for m in leaves] == sorted(set(texts)) and all(len(set(m)) == 1 for m in leaves) and sum(map(len, leaves)) == 500


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    result = con.execute(ORACLE_SQL["op12_suffix_dedup"])
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES["op12_suffix_dedup"](spark, sf_dir).select(*names).collect()) == expected
