import random
import re
from collections import Counter

import numpy as np

from weftline.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(repeated))


def test_counts_match_plain_code():
    draw = random.Random(8)
    texts = ["", "a", "a b", "a b c", "a b c a b c", "x x x x", "é\n\né\n é\né", "<a> & b|c #$%*", "a\rb\x0bc\x0cd\x1ce\x85f"]
    texts += ["".join(draw.choice("ab \n#é") for _ in range(draw.randrange(80))) for _ in range(500)]
    for text in texts:
        assert q.text_counts(text.encode())[:5] == plain_counts(text), repr(text)


def test_rules_find_planted_conjunctions():
    draw = np.random.default_rng(3)
    rows = {name: draw.random(6000) for name in ("a", "b", "c")}
    bad = (rows["a"] > 0.7) & (rows["b"] < 0.3) | (rows["c"] > 0.95)
    rules = q.learn_rules(rows, bad)
    found = np.logical_or.reduce([q.covered(r, rows, 6000) for r in rules])
    assert (found & bad).sum() > 0.97 * bad.sum()
    assert (found & ~bad).sum() < 0.01 * (~bad).sum()
    assert q.learn_rules(rows, np.zeros(6000, bool)) == []
    noise = draw.random(6000) < 0.1
    assert len(q.learn_rules(rows, noise)) <= 1


def plain_kept(text, rules):
    n_words, _, _, _, repeated = plain_counts(text)
    if n_words < 50 or 100 * repeated > 50 * n_words:
        return True, False
    c = dict(zip(q.COUNTS, q.text_counts((text or "").encode())))
    over = lambda a, b: c[a] / max(c[b], 1)
    values = {
        "chars_a_word": over("word_chars", "n_words"), "symbols_a_word": over("n_symbols", "n_words"),
        "marks_a_word": over("n_marks", "n_words"), "capitals_a_char": over("n_capitals", "word_chars"),
        "duplicate_lines": over("n_dup_lines", "n_lines"), "repeated_words": over("n_repeat_words", "n_words"),
        "stutters_a_word": over("n_stutters", "n_words"), "distinct_a_word": over("n_distinct", "n_words"),
        "words_a_line": over("n_words", "n_lines"),
    }
    values = {k: np.array([v]) for k, v in values.items()}
    return False, not any(q.covered(r, values, 1)[0] for r in rules)


def labelled(spark, n=600):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(draw.randrange(60, 120))]
        bad = i % 6 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words), "en", "s", 1))
        labels.append((i, 1 - bad, 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_query_on_odd_rows(spark, odd_documents, no_documents):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows, no_documents.schema)
    rules = q.fit(docs, labels)
    assert rules
    every = docs.unionByName(odd_documents.select(docs.columns))
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    found = q.judge(odd_documents, rules).collect()
    assert len(found) == len(odd_documents.collect())
    for r in found:
        text = texts[r["doc_id"]]
        assert tuple(r[c] for c in q.COUNTS[:5]) == plain_counts(text)
        assert (r["base_failed"], r["kept"]) == plain_kept(text, rules)
    for r in q.query(every, labels).where("doc_id >= 100").collect():
        assert r["kept"] == (r["doc_id"] % 6 != 0)
    kept = q.keep_good(odd_documents, rules)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(r["kept"] for r in found)
    assert q.query(no_documents, labels).count() == 0
    assert q.fit(docs, labels.where("quality = 1")) == []
    conflicting = labels.unionByName(labels.selectExpr("doc_id", "1 AS quality", "toxic"))
    assert q.fit(docs, conflicting.unionByName(spark.createDataFrame([(None, 0, 0)], labels.schema))) == []


def test_a_learned_list_of_conjunctions_is_emitted_as_it_was_learned(spark):
    """Documents are bad where two ratios meet; each alone is common among good ones."""
    draw = random.Random(12)
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(draw.randrange(60, 90))]
        symbols, shouts = i % 2 == 0, i // 2 % 2 == 0
        words = [w[:-1] + "#" if symbols and k % 3 == 0 else w for k, w in enumerate(words)]
        words = ["!" + w[1:] if shouts and k % 4 == 0 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if symbols and shouts else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    third = [r for r in labels if r[0] % 3]
    rules = q.fit(df, spark.createDataFrame(third, "doc_id long, quality int"))
    assert any(len(rule) > 1 for rule in rules), rules
    kept = {r["doc_id"]: r["kept"] for r in q.judge(df, rules).collect()}
    assert all(kept[i] == plain_kept(text, rules)[1] for i, text in rows)
    held = [(quality == 0, not kept[i]) for i, quality in labels if i % 3 == 0]
    right = sum(a and b for a, b in held)
    assert right >= 0.95 * sum(a for a, _ in held) and right >= 0.95 * sum(b for _, b in held)
