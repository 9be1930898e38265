"""LM scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class, context).  The class of a word is a softmax
over hashed features of the history: the word before (bigram), the one before that (skip), and the
pair (trigram).  The SINGLES most frequent tokens are classes of their own; any other word falls
into a class by a hash of its ending, so unseen words have a class, too.  Within a class words are
drawn by a softmax of two features: the word itself, whose weight is the log of its smoothed count,
and the pair of the word and the class of the word before (its context).  A class keeps one
smoothed place for all unseen words, so probabilities sum to 1 over the vocabulary and it.

Training: exact token counts first; then one pass over all training texts sums up what the
gradient needs: how often each feature meets each class, how often each history occurs, and how
often each of the PAIR_WORDS most frequent words follows each context.  A history is a pair of weight rows, so there are at
most HISTORIES of them, however large the corpus; the table of words grows with it.
Weights start from the counts and take full-batch gradient steps.  A step of the classes' weights is
distributed over the histories; the pairs' weights are trained class by class.  Every task adds up
its part in fixed point and parts are summed by weight row, so the result does not depend on how
documents are dealt.  What is broadcast has a fixed size: the classes' weights, and the weights of
pairs.

Scoring: a task handles the HEAD most frequent words with broadcast tables.  The counts of all other
words come from a join on the word: each document sends its tail words once.  Both base and model
need only the sum of log(count + 0.1) over them.

A long text is read piece by piece; a piece takes along the two tokens before it.
"""

from __future__ import annotations

import gc
import math
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, saved, scratch_path, text_bytes

SMOOTH = 0.1
#: Words whose counts are broadcast; the others are joined.
HEAD = 1 << 17
SINGLES, ENDINGS = 32, 32
CLASSES = SINGLES + ENDINGS
#: Rows of the weights of each feature: ids of the most frequent words, then hashes.
OWN_ROWS = 3072
ROWS = (4096, 4096, 8192)
HISTORIES = ROWS[0] * ROWS[1]
STEPS = 4
RATE = 0.6
PRIOR = 30.0
#: Units of a gradient part.
FIXED = 1 << 16
#: Sums sent at once, bytes of text handled at once, and histories whose classes are worked out at once.
SLAB = 1 << 18
SLAB_BYTES = 1 << 21
CUT = 1 << 14
#: Bound of a weight: scores stay within what 32-bit exponentials hold.
BOUND = 20.0
#: Contexts of the second factor: the class of the word before, or none.
CONTEXTS = CLASSES + 1
#: Words, by frequency, whose pairs with contexts have weights; rarer ones are met too seldom to tell.
PAIR_WORDS = 1 << 14
#: Steps, smoothing and shrinking of the weights of pairs.
PAIR_STEPS = 8
PAIR_PRIOR = 2.0
PAIR_SHRINK = 0.05
#: Histories whose normalisers a worker keeps, and rows that it reads at once.
NORMS = 1 << 21
ROWS_AT_ONCE = 512
#: Bytes of a text that are split into tokens at once.
PIECE = 1 << 20
#: Distinct words that a task counts before it sends them on.
COUNT_ENTRIES = 300_000
SPACE = re.compile(rb"[ \t-\r]")
END = b""  # no word is empty, so the end token takes this name


def spans(text: bytes):
    """Stretches of a text in lower case without outer white space, cut at white space every PIECE
    bytes or so; the last ends with a space if it has words, so the end token follows."""
    at = 0
    while len(text) - at > PIECE:
        space = SPACE.search(text, at + PIECE)
        if space is None:
            break
        if span := text[at : space.end()].lower().strip():
            yield span
        at = space.end()
    span = text[at:].lower().strip()
    yield span + b" " if span else span


def split(spans_: list[bytes]) -> pa.ListArray:
    """The tokens of each span; what follows a last space is the empty word, the end token."""
    # The kernel knows the same six characters and does not look at the encoding.
    found = pc.ascii_split_whitespace(pa.array(spans_, pa.binary()).view(pa.string()))
    return pa.ListArray.from_arrays(found.offsets, found.values.view(pa.binary()))


def pieces(text: bytes):
    """The tokens of a text, at most about PIECE bytes at a time."""
    for span in spans(text):
        yield split([span])[0].as_py()


#: crc32 of a few zero bytes, and what a byte at the end, or one or two before it, changes.
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(4)], dtype=np.uint32)
CHANGES = [
    np.array([zlib.crc32(bytes([b, *bytes(p)])) for b in range(256)], dtype=np.uint32) ^ ZEROS[p + 1] for p in range(3)
]


def endings(words: pa.BinaryArray) -> np.ndarray:
    """crc32 of the last three bytes of each word, of which 24 bits are kept."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    size, stop = np.diff(offsets), offsets[1:]
    mark = ZEROS[np.minimum(size, 3)]
    for p, change in enumerate(CHANGES):
        long = np.flatnonzero(size > p)
        mark[long] ^= change[data[stop[long] - 1 - p]]
    return (mark & 0xFFFFFF).astype(np.int64)


def held_out(key: bytes | None) -> bool:
    return key is not None and zlib.crc32(key) % 10 == 0


@dataclass
class Vocabulary:
    """The bounded table of the most frequent words, and sums over all."""

    head: dict[bytes, int]  # word -> place by frequency
    counts: np.ndarray  # of the head
    total: int
    distinct: int
    class_log: np.ndarray  # log10 of each class's denominator


@dataclass
class Model:
    """What training learns: weights of the classes (feature rows and a last row of biases, by
    classes), weights of pairs (contexts by head places), log10 of what the words of a class sum to
    (contexts by classes), and the mean negative log10 probability of a class before each step."""

    weights: np.ndarray
    pairs: np.ndarray
    sums: np.ndarray
    losses: list[float]


#: What this Python worker keeps between tasks: the state of one model, by its name.
_KEPT: dict[str, object] = {}


def kept(name: str, make):
    """The state ``name`` of this worker, made once; that of an earlier model goes first.

    Its parts refer to each other, so without the collector they would stay until it happens to run.
    """
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        _KEPT[name] = make()
    return _KEPT[name]


class Encoder:
    """Maps words to head places; words beyond the head to codes below 0 that hash their endings.

    A code carries all that the model needs: class and feature row.
    """

    def __init__(self, head: dict[bytes, int]):
        self.head = pa.array(sorted(head, key=head.get), pa.binary())

    def codes(self, words: list[bytes] | pa.BinaryArray) -> np.ndarray:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        place = pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy().astype(np.int64)
        mark = endings(words)
        return np.where(place < 0, -1 - mark, place << 24 | mark)


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place (-1 beyond the head), class and feature row of each code."""
    tail = codes < 0
    place = np.where(tail, -1, codes >> 24)
    mark = np.where(tail, -1 - codes, codes & 0xFFFFFF)
    single = (place >= 0) & (place < SINGLES)
    kind = np.where(single, place, SINGLES + mark % ENDINGS)
    spread = ROWS[0] - OWN_ROWS
    row = np.where((place >= 0) & (place < OWN_ROWS), place, OWN_ROWS + mark // ENDINGS % spread)
    return place, kind, row


def histories(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The history of each token (one number) from the tokens' own rows; ``start`` marks the first
    tokens of texts.  What lies before a text has a fixed row of its own."""
    n = len(row)
    index = np.arange(n)
    first = np.maximum.accumulate(np.where(start, index, 0))
    edge = np.int64(OWN_ROWS)
    one = np.where(index - first >= 1, np.concatenate(([edge], row[:-1])), edge)
    two = np.where(index - first >= 2, np.concatenate(([edge, edge], row[:-2]))[:n], edge)
    return one * ROWS[1] + two


def features(history: np.ndarray) -> np.ndarray:
    """Weight rows (by 3) of histories: bigram, skip, trigram."""
    one, two = history // ROWS[1], history % ROWS[1]
    pair = (one * np.int64(2_654_435_761) + two * np.int64(40_503)) % 4_294_967_291 % ROWS[2]
    return np.stack([one, ROWS[0] + two, ROWS[0] + ROWS[1] + pair], axis=1)


def log_classes(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log of P(class | features), histories by classes."""
    scores = weights[rows[:, 0]]
    scores += weights[rows[:, 1]]
    scores += weights[rows[:, 2]]
    scores += weights[-1]
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores


class Scorer:
    """log P(class | history) for single classes; normalisers of recent histories are kept."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.history = np.full(NORMS, -1, dtype=np.int32)
        self.norm = np.zeros(NORMS, dtype=np.float32)

    def norms(self, history: np.ndarray) -> np.ndarray:
        """Logs of the normalisers of distinct histories."""
        w, place = self.weights, history % NORMS
        out = self.norm[place]
        new = np.flatnonzero(self.history[place] != history)
        for a in range(0, len(new), CUT):
            rows = features(history[new[a : a + CUT]])
            scores = w[rows[:, 0]]
            for part in (w[rows[:, 1]], w[rows[:, 2]], w[-1]):
                scores += part
            out[new[a : a + CUT]] = np.log(np.exp(scores).sum(axis=1))
        self.history[place[new]], self.norm[place[new]] = history[new], out[new]
        return out

    def __call__(self, history: np.ndarray, kind: np.ndarray) -> np.ndarray:
        w = self.weights
        rows = features(history)
        chosen = w[rows[:, 0], kind]
        for part in (w[rows[:, 1], kind], w[rows[:, 2], kind], w[-1, kind]):
            chosen = chosen + part
        met, place = np.unique(history, return_inverse=True)
        return (chosen - self.norms(met)[place]).astype(np.float64)


def _rows_sum(rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """out[rows] += values, for repeated rows."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    out[sorted_rows[starts]] += np.add.reduceat(values[order], starts, axis=0)


@dataclass
class Slab:
    """Codes of pieces of texts, put together; ``start`` marks the first token of each piece."""

    codes: np.ndarray
    start: np.ndarray
    counted: np.ndarray  # False for the tokens that a piece takes along
    text: np.ndarray  # the text of each piece
    first: np.ndarray  # where each piece starts
    words: pa.BinaryArray  # the tokens without those taken along


def _groups(texts: list[bytes]):
    """The spans of all texts in groups of about SLAB_BYTES: texts, whether one starts, spans."""
    group, size = [], 0
    for k, text in enumerate(texts):
        starts = True
        for span in spans(text):
            group.append((k, starts, span))
            starts = False
            size += len(span)
            if size >= SLAB_BYTES:
                yield zip(*group)
                group, size = [], 0
    if group:
        yield zip(*group)


def _slabs(texts: list[bytes], encoder: Encoder):
    """Slabs of about SLAB_BYTES over all texts."""
    before = np.zeros(0, np.int64)
    for where, starts, group in _groups(texts):
        found = split(group)
        codes = np.split(encoder.codes(found.values), found.offsets.to_numpy()[1:-1])
        lead = np.zeros(len(codes), dtype=np.int64)
        for p, fresh in enumerate(starts):
            if not fresh:
                lead[p] = len(before)
                codes[p] = np.concatenate([before, codes[p]])
            before = codes[p][-2:]
        lengths = np.array([len(c) for c in codes])
        first = np.cumsum(lengths) - lengths
        start = np.zeros(lengths.sum(), dtype=bool)
        start[first] = True
        counted = np.ones(len(start), dtype=bool)
        for p in np.flatnonzero(lead):
            counted[first[p] : first[p] + lead[p]] = False
        yield Slab(np.concatenate(codes), start, counted, np.array(where), first, found.values)


def small_batches(batches):
    """Batches of few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def contexts(kind: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The context of each token from the tokens' own classes."""
    return np.where(start, CLASSES, np.concatenate(([CLASSES], kind[:-1])))


def train_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """The texts that the model learns from: crc32 of the key as text is no multiple of 10."""
    name = F.col(f"`{key}`").cast("string").cast("binary")
    learned = F.coalesce(F.crc32(name) % 10 != 0, F.lit(True))
    return df.where(learned).select(text_bytes(f"`{text}`").alias("text"))


def _word_sums(held: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("count", "sum")])
    return sums.select(["word", "count_sum"]).rename_columns(["word", "count"])


def count_words(train: DataFrame) -> DataFrame:
    """(word, count) over all training tokens; the end token is the empty word."""

    def run(batches):
        held, size = [], 0
        for batch in small_batches(batches):
            for *_, group in _groups(batch.column(0).to_pylist()):
                met, times = split(group).values.value_counts().flatten()
                held.append(pa.table([met, times], names=["word", "count"]))
                size += len(met)
                if size > 2 * COUNT_ENTRIES:
                    held = [_word_sums(held)]
                    size = held[0].num_rows
                    if size > COUNT_ENTRIES:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from _word_sums(held).to_batches()

    return train.mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def read_vocabulary(words: DataFrame, head: int = HEAD) -> Vocabulary:
    """The most frequent words, at most ``head``, and the sums over all of ``words``.

    A histogram of counts on a log scale (a few thousand steps at most) says from which step on
    the words fit the table, so no more than ``head`` of them go to the driver.
    """
    step = F.floor(F.log2("count") * 64).cast("int")
    fits, least = 0, None
    for row in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        fits += row["n"]
        if fits > head:
            break
        least = row["step"]
    top = words.where(step >= least if least is not None else F.lit(False)).toPandas()
    top = top.sort_values("word", kind="stable").sort_values("count", ascending=False, kind="stable")
    top_words = [bytes(w) for w in top["word"]]
    singles = pa.array(top_words[:SINGLES], pa.binary())

    def by_class(batches):
        sums = np.zeros((CLASSES, 2), dtype=np.int64)
        for batch in batches:
            word, count = batch.column(0), batch.column(1).to_numpy()
            others = np.flatnonzero(~pc.is_in(word, value_set=singles).to_numpy(zero_copy_only=False))
            kind = SINGLES + endings(word)[others] % ENDINGS
            np.add.at(sums[:, 0], kind, count[others])
            sums[:, 1] += np.bincount(kind, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CLASSES), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["k", "n", "v"]
        )

    rows = words.mapInArrow(by_class, "k int, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect()
    size, kinds = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for k, n, v in rows:
        size[k], kinds[k] = n, v
    counts = top["count"].to_numpy(dtype=np.int64) if len(top) else np.zeros(0, dtype=np.int64)
    total = int(size.sum() + counts[:SINGLES].sum())
    class_log = np.zeros(CLASSES)
    class_log[SINGLES:] = np.log10(size[SINGLES:] + SMOOTH * (kinds[SINGLES:] + 1))
    head_places = {w: k for k, w in enumerate(top_words)}
    return Vocabulary(head_places, counts, total, int(kinds.sum()) + len(singles), class_log)


def _add_parts(parts: DataFrame, rows: int) -> np.ndarray:
    """The sum of (at, part) blocks of weight rows; what reaches the driver has a fixed size."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.frombuffer(pdf["part"].iloc[0], np.int64).copy()
        for more in pdf["part"].iloc[1:]:
            found += np.frombuffer(more, np.int64)
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "part": [found.tobytes()]})

    # Two rounds, so that no task gets the parts of all.
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = salted.groupBy("at", "salt").applyInPandas(add, "at int, part binary")
    out = np.zeros((rows, CLASSES), dtype=np.int64)
    for at, data in once.groupBy("at").applyInPandas(add, "at int, part binary").collect():
        found = np.frombuffer(data, np.int64).reshape(-1, CLASSES)
        out[at : at + len(found)] = found
    return out


def _parts(total: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Blocks of weight rows that hold anything, with the place of their first row."""
    block = 256
    starts = [at for at in range(0, len(total), block) if total[at : at + block].any()]
    return starts, [total[at : at + block].tobytes() for at in starts]


N_ROWS = sum(ROWS) + 1


def _added(sums: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with how often they were met, ``values`` added."""
    met, often = np.unique(values, return_counts=True)
    both = np.concatenate([sums[0], met])
    order = np.argsort(both, kind="stable")
    both, times = both[order], np.concatenate([sums[1], often])[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    return both[first], np.add.reduceat(times, first) if len(first) else times


def gather_statistics(train: DataFrame, vocabulary: Vocabulary, name: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Over all training tokens: counts of (weight row, class) and, below them, of (context, class);
    a table (history, times); a table (pair, times) of contexts and frequent words."""
    shared = train.sparkSession.sparkContext.broadcast(vocabulary.head)
    n_rows = N_ROWS + CONTEXTS
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches):
        encoder = kept(f"{name}-words", lambda: Encoder(shared.value))
        seen = np.zeros(n_rows * CLASSES, dtype=np.int64)
        sums = {"history": nothing, "pair": nothing}

        def sent():
            for column, (values, times) in sums.items():
                for a in range(0, len(values), SLAB):
                    some, often = values[a : a + SLAB], times[a : a + SLAB]
                    empty = pa.nulls(len(some), pa.int32())
                    keys = {"history": empty, "pair": empty, column: pa.array(some, pa.int32())}
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary()), *keys.values(), pa.array(often)],
                        names=["at", "part", "history", "pair", "times"],
                    )

        for batch in small_batches(batches):
            for slab in _slabs(batch.column(0).to_pylist(), encoder):
                place, kind, row = unpack(slab.codes)
                context = contexts(kind, slab.start)[slab.counted]
                history = histories(row, slab.start)[slab.counted]
                place, kind = place[slab.counted], kind[slab.counted]
                rows = features(history)
                for f in range(rows.shape[1]):
                    seen += np.bincount(rows[:, f] * CLASSES + kind, minlength=len(seen))
                seen[(N_ROWS - 1) * CLASSES : N_ROWS * CLASSES] += np.bincount(kind, minlength=CLASSES)
                seen += np.bincount((N_ROWS + context) * CLASSES + kind, minlength=len(seen))
                sums["history"] = _added(sums["history"], history)
                inner = (place >= SINGLES) & (place < PAIR_WORDS)
                sums["pair"] = _added(sums["pair"], context[inner] * PAIR_WORDS + place[inner])
                if max(len(v) for v, _ in sums.values()) > 16 * SLAB:
                    yield from sent()
                    sums = {"history": nothing, "pair": nothing}
        starts, parts = _parts(seen.reshape(n_rows, CLASSES))
        empty = pa.nulls(len(starts), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int32()), pa.array(parts, pa.binary()), empty, empty, pa.nulls(len(starts), pa.int64())],
            names=["at", "part", "history", "pair", "times"],
        )
        yield from sent()

    path = scratch_path(train.sparkSession, "lm-statistics")
    both = saved(train.mapInArrow(run, "at int, part binary, history int, pair int, times long"), "lm-statistics", path)
    shared.unpersist()
    observed = _add_parts(both.where("at IS NOT NULL").select("at", "part"), n_rows)
    tables = []
    for column in ("history", "pair"):
        found = both.where(f"{column} IS NOT NULL").groupBy(column).agg(F.sum("times").alias("times"))
        tables.append(saved(found, column))
    discard(train.sparkSession, path)
    return observed, *tables


def train_classes(spark, seen: np.ndarray, found: DataFrame, steps: int, rate: float) -> tuple[np.ndarray, list[float]]:
    """Weights of the classes from the counts of (weight row, class) and the histories; the losses."""
    uses = seen.sum(axis=1, keepdims=True)
    usual = (seen[-1] + 1.0) / (seen[-1].sum() + CLASSES)
    weights = np.log((seen + PRIOR * usual) / (uses + PRIOR)) - np.log(usual)
    weights *= 0.5  # the three features overlap
    weights[-1] = np.log(usual)
    losses = []

    for _ in range(steps):
        current = spark.sparkContext.broadcast(np.clip(weights, -BOUND, BOUND).astype(np.float32))

        def expected(batches, current=current):
            # The last row sums the logs of the normalisers.
            total = np.zeros((N_ROWS + 1, CLASSES), dtype=np.int64)
            for batch in batches:
                history, times = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
                for a in range(0, len(history), CUT):
                    rows = features(history[a : a + CUT])
                    logs = log_classes(current.value, rows)
                    often = times[a : a + CUT]
                    norm = np.rint((current.value[rows].sum(axis=1) + current.value[-1] - logs)[:, 0] * FIXED)
                    total[-1, 0] += int(norm.astype(np.int64) @ often)
                    # Fixed point makes sums free of order.
                    chance = np.rint(np.exp(logs) * FIXED).astype(np.int64)
                    chance *= often[:, None]
                    for f in range(rows.shape[1]):
                        _rows_sum(rows[:, f], chance, total)
                    total[N_ROWS - 1] += chance.sum(axis=0)
            starts, parts = _parts(total)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array(parts, pa.binary())], names=["at", "part"])

        model = _add_parts(found.mapInArrow(expected, "at int, part binary"), N_ROWS + 1) / FIXED
        norms, model = model[-1, 0], model[:-1]
        losses.append(float((norms - (seen * current.value).sum()) / max(seen[-1].sum(), 1) / math.log(10)))
        current.unpersist()
        # The gradient, scaled row by row by how often the feature is used.
        weights += rate * (seen - model - weights * 0.01) / (model + PRIOR)
    return np.clip(weights, -BOUND, BOUND).astype(np.float32), losses


def pair_weights(observed: np.ndarray, mass: np.ndarray, met: np.ndarray, whole: float) -> np.ndarray:
    """Weights of the pairs of one class, contexts by words, by full-batch gradient steps.

    ``observed`` counts the pairs, ``mass`` has the smoothed count of each word, ``met`` how often
    each context meets the class, ``whole`` what all words of the class sum to.
    """
    usual = met[:, None] * (mass / whole)
    weights = np.log((observed + PAIR_PRIOR) / (usual + PAIR_PRIOR))
    weights[observed == 0] = 0.0
    for _ in range(PAIR_STEPS):
        risen = mass * np.exp(weights)
        sums = whole + (risen - mass).sum(axis=1, keepdims=True)
        model = met[:, None] * risen / sums
        step = (observed - model - PAIR_SHRINK * weights) / (model + PAIR_PRIOR)
        # A pair never met keeps weight 0, so that weights are as many as pairs.
        weights = np.where(observed > 0, np.clip(weights + RATE * step, -BOUND, BOUND), 0.0)
    return weights


def train_pairs(found: DataFrame, vocabulary: Vocabulary, met: np.ndarray) -> np.ndarray:
    """Weights of pairs, contexts by head places; each class is trained by a task of its own."""
    spark = found.sparkSession
    head = vocabulary.head
    kind = unpack(Encoder(head).codes(list(head)))[1].astype(np.int32)
    whole = 10.0**vocabulary.class_log
    shared = spark.sparkContext.broadcast((kind, vocabulary.counts + SMOOTH, met, whole))

    def of_class(batches):
        """Adds the class of each pair."""
        for batch in batches:
            place = batch.column(0).to_numpy() % PAIR_WORDS
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[0][place]), *batch.columns], names=["kind", "pair", "times"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        _, counts, met_, whole_ = shared.value
        k = int(pdf["kind"].iloc[0])
        pair = pdf["pair"].to_numpy()
        places, column = np.unique(pair % PAIR_WORDS, return_inverse=True)
        observed = np.zeros((CONTEXTS, len(places)))
        observed[pair // PAIR_WORDS, column] = pdf["times"]
        weights = pair_weights(observed, counts[places], met_[:, k].astype(float), whole_[k])
        values = weights[pair // PAIR_WORDS, column].astype("<f4")
        return pd.DataFrame({"pair": [pair.astype("<i8").tobytes()], "weight": [values.tobytes()]})

    out = np.zeros((CONTEXTS, min(max(len(head), 1), PAIR_WORDS)), dtype=np.float32)
    learned = found.mapInArrow(of_class, "kind int, pair int, times long")
    # At most CONTEXTS x PAIR_WORDS pairs.
    for row in learned.groupBy("kind").applyInPandas(learn, "pair binary, weight binary").toLocalIterator():
        pair = np.frombuffer(row["pair"], "<i8")
        out[pair // PAIR_WORDS, pair % PAIR_WORDS] = np.frombuffer(row["weight"], "<f4")
    shared.unpersist()
    return out


def class_sums(vocabulary: Vocabulary, pairs: np.ndarray) -> np.ndarray:
    """log10 of what the words of each class sum to in each context."""
    kind = unpack(Encoder(vocabulary.head).codes(list(vocabulary.head)[:PAIR_WORDS]))[1]
    mass = vocabulary.counts[:PAIR_WORDS] + SMOOTH
    sums = np.tile(10.0**vocabulary.class_log, (CONTEXTS, 1))
    for context in range(CONTEXTS if len(kind) else 0):
        sums[context] += np.bincount(kind, mass * np.expm1(pairs[context].astype(np.float64)), minlength=CLASSES)
    sums[:, :SINGLES] = 1.0
    return np.log10(sums)


def train(df: DataFrame, vocabulary: Vocabulary, steps: int = STEPS, rate: float = RATE, name: str = "") -> Model:
    """The model of ``df`` (text)."""
    seen, histories_, pairs_ = gather_statistics(df, vocabulary, name or uuid.uuid4().hex)
    weights, losses = train_classes(df.sparkSession, seen[:N_ROWS], histories_, steps, rate)
    pairs = train_pairs(pairs_, vocabulary, seen[N_ROWS:])
    return Model(weights, pairs, class_sums(vocabulary, pairs), losses)


def score(
    df: DataFrame, words: DataFrame, vocabulary: Vocabulary, model: Model, key: str = "doc_id", text: str = "text", name: str = ""
) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``df``."""
    spark = df.sparkSession
    parts_ = (vocabulary.head, vocabulary.counts, model.weights, model.pairs, model.sums)
    shared = spark.sparkContext.broadcast(parts_)
    total, distinct = vocabulary.total, vocabulary.distinct
    name = name or uuid.uuid4().hex

    def state():
        head, counts, weights, pairs, sums = shared.value
        return Encoder(head), np.log10(counts + SMOOTH), pairs, sums, Scorer(weights)

    def run(batches):
        """A row with part sums for every text, and one for each of its distinct tail words (for a
        long text, of those in each slab)."""
        for batch in small_batches(batches):
            encode, log_count, pairs, sums, scorer = kept(f"{name}-scores", state)
            texts = batch.column(1).to_pylist()
            n_known = np.zeros(len(texts), dtype=np.int64)
            n_tokens = np.zeros(len(texts), dtype=np.int64)
            base, model_ = np.zeros(len(texts)), np.zeros(len(texts))
            tails: list[tuple[np.ndarray, pa.BinaryArray, np.ndarray]] = []
            for slab in _slabs(texts, encode):
                place, kind, row = unpack(slab.codes)
                context, counted = contexts(kind, slab.start), slab.counted
                chosen = scorer(histories(row, slab.start), kind)
                known = place >= 0
                head_log = np.zeros(len(place))
                head_log[known] = log_count[place[known]]
                # Within its class a single word is sure; others have their share.
                inside = np.where(kind < SINGLES, 0.0, head_log - sums[context, kind])
                inner = (place >= SINGLES) & (place < PAIR_WORDS)
                inside[inner] += pairs[context[inner], place[inner]] / math.log(10)
                for out, value in ((n_tokens, counted), (n_known, known & counted)):
                    np.add.at(out, slab.text, np.add.reduceat(value.astype(np.int64), slab.first))
                for out, value in ((base, head_log), (model_, chosen / math.log(10) + inside)):
                    np.add.at(out, slab.text, np.add.reduceat(np.where(counted, value, 0.0), slab.first))
                tail = np.flatnonzero(~known & counted)
                if len(tail):
                    of = slab.text[np.searchsorted(slab.first, tail, side="right") - 1]
                    found = slab.words.take(pa.array(np.cumsum(counted)[tail] - 1)).dictionary_encode()
                    distinct_ = len(found.dictionary)
                    met, often = np.unique(of * distinct_ + found.indices.to_numpy(), return_counts=True)
                    tails.append((met // distinct_, found.dictionary.take(pa.array(met % distinct_)), often))
            n, m = len(texts), sum(len(often) for *_, often in tails)
            tail_row = pa.array(np.concatenate([np.zeros(0, np.int64), *[of for of, *_ in tails]]))
            row_of = pa.concat_arrays([batch.column(0), batch.column(0).take(tail_row)])
            # No UTF-8 word starts with this byte; a name of its own keeps a text's row from
            # meeting all others in the join.
            names = [b"\xff%d" % r for r in batch.column(0).to_pylist()]
            nothing = np.zeros(m)
            yield pa.RecordBatch.from_arrays(
                [
                    row_of,
                    pa.concat_arrays([batch.column(2), batch.column(2).take(tail_row)]),
                    pa.concat_arrays([pa.array(names, pa.binary()), *[found for _, found, _ in tails]]),
                    pa.array(np.concatenate([np.zeros(n, np.int64), *[often for *_, often in tails]])),
                    pa.array(np.concatenate([n_tokens, nothing]).astype(np.int64)),
                    pa.array(np.concatenate([n_known, nothing]).astype(np.int64)),
                    pa.array(np.concatenate([base, nothing])),
                    pa.array(np.concatenate([model_, nothing])),
                ],
                names=["row", "key", "word", "times", "n_tokens", "n_known", "base", "model"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), text_bytes(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key")
    )
    parts = rows.mapInArrow(
        run, f"row long, key {kind}, word binary, times long, n_tokens long, n_known long, base double, model double"
    )
    met = parts.join(words, "word", "left")
    log_count = F.log10(F.coalesce(F.col("count"), F.lit(0)) + SMOOTH) * F.col("times")
    is_known = F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0)
    sums = met.groupBy("row").agg(
        F.first("key").alias(key),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + is_known).alias("n_known"),
        F.sum(F.col("base") + log_count).alias("base"),
        F.sum(F.col("model") + log_count).alias("model"),
    )
    whole = math.log10(total + SMOOTH * (distinct + 1))
    name = F.col(key).cast("string").cast("binary")
    return sums.select(
        key,
        F.coalesce(F.crc32(name) % 10 == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * whole).alias("base_score"),
        F.col("model").alias("score"),
    )


def train_and_score(df: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Learns from the training rows of ``df`` and scores all of its rows.

    A null text counts as empty (one end token); a null key counts as a training row; repeated rows
    are learned from and scored each; texts are taken whole.  Without training rows all counts are 0.
    An empty table gives an empty result; other columns play no part.
    """
    learned = train_documents(df, key, text)
    words = saved(count_words(learned), "word-counts")
    vocabulary = read_vocabulary(words, min(head, HEAD))
    name = uuid.uuid4().hex
    model = train(learned, vocabulary, name=name)
    return score(df, words, vocabulary, model, key, text, name)


def query(documents: DataFrame) -> DataFrame:
    return train_and_score(documents)
