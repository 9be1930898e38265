"""Quality rules: base checks and a learned decision list.

Counts of every whole text feed ratios; sequential covering learns, from labelled documents, an
ordered list of conjunctions of thresholds on these ratios that reject documents.  A rule is grown
on two thirds of the labelled rows by the condition with the highest information gain, pruned on
the others by cutting its last conditions, and accepted while it is precise there; what it covers
is set aside and the next rule is grown.  The list is emitted as one Spark conditional expression.

Fitting reads a bounded sample of labelled rows (SAMPLE, the smallest hashes); counting and
applying cover every document, without any shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import WORD_SPACE, append_columns, read_table, text_bytes

#: Labelled rows that a fit may read.
SAMPLE = 20_000
SEED = 17
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50
MOST_RULES, MOST_CONDITIONS, CUTS = 24, 6, 64
#: Share of its pruning rows that an accepted rule must rightly reject, and how many at least.
PRECISION, SUPPORT = 0.97, 4

CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_marks", "n_stutters", "n_distinct",
)


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of a UTF-8 text.

    Words are runs of characters other than x20 and x09-x0D; n_lines are the lines with a word;
    n_capitals counts A-Z, n_marks ! and ?, n_stutters words equal to the word before.
    """
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, CONTINUATION + WORD_SPACE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, CAPITALS)),
        text.count(b"!") + text.count(b"?"),
        sum(map(eq, words, words[1:])),
        len(set(words)),
    )


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    parts = [words[k:] for k in range(window)]
    if len(set(zip(*parts))) == n:
        return 0
    found = Counter(zip(*parts))
    total = end = 0
    for i, w in enumerate(zip(*parts)):
        if found[w] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


def with_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``df`` with COUNTS (names after ``prefix``) for every row; a null text counts as empty."""

    def start():
        return lambda texts: list(zip(*map(text_counts, texts))) or [()] * len(COUNTS)

    return append_columns(df, [text_bytes(text)], [(prefix + c, T.LongType()) for c in COUNTS], start, keep)


def ratios(prefix: str = "") -> dict[str, Column]:
    """The features that rules put thresholds on."""
    c = {name: F.col(prefix + name).cast("double") for name in COUNTS}
    words, lines, chars = (F.greatest(c[n], F.lit(1.0)) for n in ("n_words", "n_lines", "word_chars"))
    return {
        "chars_a_word": c["word_chars"] / words,
        "symbols_a_word": c["n_symbols"] / words,
        "marks_a_word": c["n_marks"] / words,
        "capitals_a_char": c["n_capitals"] / chars,
        "duplicate_lines": c["n_dup_lines"] / lines,
        "repeated_words": c["n_repeat_words"] / words,
        "stutters_a_word": c["n_stutters"] / words,
        "distinct_a_word": c["n_distinct"] / words,
        "words_a_line": c["n_words"] / lines,
    }


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < LEAST_WORDS) | (repeated * 100 > words * MOST_REPEATED)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def covers(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def column(self, prefix: str = "") -> Column:
        x = ratios(prefix)[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for condition in rule:
        out &= condition.covers(rows)
    return out


def grow(rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition of highest gain until only bad rows are covered or nothing gains."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        before = np.log2(p / (p + n)) if p else 0.0
        best, best_gain = None, 1e-9
        for name, values in rows.items():
            x, y = values[inside], bad[inside]
            order = np.argsort(x, kind="stable")
            x, hits = x[order], np.cumsum(y[order])
            ends = np.flatnonzero(x[1:] > x[:-1])
            if len(ends) > CUTS:
                # Equal shares of the rows, and of the bad ones.
                shares = [np.linspace(0, len(ends) - 1, CUTS).astype(int)]
                shares.append(np.searchsorted(hits[ends], np.linspace(0, p, CUTS)).clip(0, len(ends) - 1))
                ends = ends[np.unique(np.concatenate(shares))]
            if not len(ends):
                continue
            below_all, below_bad = ends + 1, hits[ends]
            for at_least, total, right in ((False, below_all, below_bad), (True, p + n - below_all, p - below_bad)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(right > 0, right * (np.log2(right / total) - before), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best_gain = gain[k]
                    best = Condition(name, at_least, float((x[ends[k]] + x[ends[k] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.covers(rows)
    return tuple(rule)


def prune(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The beginning of ``rule`` that is worth most on other rows, with its right and wrong rows."""
    best = (-2.0, (), 0, 0)
    for k in range(len(rule), 0, -1):
        inside = covered(rule[:k], rows, len(bad))
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0] or (worth == best[0] and p > best[2]):
            best = (worth, rule[:k], p, n)
    return best[1:]


def learn_rules(rows: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """An ordered list of conjunctions that reject; rows should be in a random order."""
    index = np.arange(len(bad))
    growing, pruning = index[index % 3 != 0], index[index % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and bad[growing].any() and bad[pruning].any():
        part = lambda at: ({k: v[at] for k, v in rows.items()}, bad[at])
        rule = grow(*part(growing))
        if not rule:
            break
        rule, right, wrong = prune(rule, *part(pruning))
        if right < SUPPORT or right < PRECISION * (right + wrong):
            break
        rules.append(rule)
        growing = growing[~covered(rule, part(growing)[0], len(growing))]
        pruning = pruning[~covered(rule, part(pruning)[0], len(pruning))]
    return rules


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules from ``labels`` (key, quality 0 or 1) of ``documents``.

    Reads the ``sample`` labelled keys with the smallest hashes.  A key labelled both ways counts
    as good; other labels, null keys and keys without a document play no part; of rows that repeat a
    key one is read.  Without bad rows the list is empty.
    """
    named = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
    picked = (
        named.agg(F.max("quality").alias("__quality"))
        .orderBy(F.xxhash64("__key", F.lit(SEED)), "__key")
        .limit(sample)
    )
    found = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    found = found.join(F.broadcast(picked), "__key")
    counted = with_counts(found, "__text", keep=["__key", "__quality"]).where(~base_failed())
    values = ratios()
    rows = (
        counted.select("__key", "__quality", *[v.alias(k) for k, v in values.items()])
        .groupBy("__key")
        .agg(F.min(F.struct("__quality", *values)).alias("r"))
        .orderBy(F.xxhash64("__key", F.lit(SEED)), "__key")
        .select("r.*")
        .toPandas()
    )
    return learn_rules({k: rows[k].to_numpy(dtype=float) for k in values}, rows["__quality"].to_numpy() == 0)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True to keep: base failures first, then the rules in order, else keep."""
    out = F.when(base_failed(prefix), F.lit(False))
    for rule in rules:
        condition = rule[0].column(prefix)
        for more in rule[1:]:
            condition = condition & more.column(prefix)
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(df: DataFrame, rules: list[Rule], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with COUNTS, base_failed and kept for every row (columns so named are replaced).

    A null, empty or blank text has no words and fails.  Repeated rows are judged each; an empty
    table gives an empty one.
    """
    counted = with_counts(df, text, keep)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def keep_good(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with its own columns."""
    prefix = "__count_"
    counted = with_counts(df, text, prefix=prefix)
    return counted.where(verdict(rules, prefix)).select(*[F.col(f"`{c}`") for c in df.columns])


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge(documents, fit(documents, labels), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    return keep_good(docs, fit(docs, read_table(spark, sf_dir, "labels")))
