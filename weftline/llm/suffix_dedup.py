"""Removal of repeated passages by deep-shallow sorting of suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier.  Only suffixes that can
have such a string are sorted.  Every window of LENGTH bytes is represented by its anchor, the
32-byte gram with the least hash in it (the first at a tie): equal windows have equal anchors at
the same place, so a window whose anchor occurs once repeats nothing.

1. Each text gives runs of successive windows with one anchor.  Grams are counted; those with two
   places in different texts, or in one, are kept, and the runs around them.
2. A run's context is all bytes of its windows.  Equal contexts are pre-aggregated to the earliest:
   the windows of all others repeat it.
3. Different contexts of one anchor meet in a task, which sorts the suffixes at their windows with
   the deep-shallow method, bucket by bucket (an anchor and a place in the window), and finds for
   each class of equal windows the earliest.  An anchor with very many contexts is dealt into blocks
   by a hash of the context; each block's first windows then meet by their bytes, at most one of a
   kind from each block.
4. The places found are merged for each text and the other bytes are kept.

Nothing is compared pair by pair, and no group has to fit into a task: a passage that every
document shares is one context in step 2, and its borders, which differ, are dealt into blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import discard, saved, scratch_path, text_bytes
from weftline.llm.deep_shallow import deep_shallow_sort, words_of

#: Bytes of a gram, and of the pieces in which texts are hashed.
GRAM = 32
PIECE = 1 << 18
#: Bytes of contexts sent at once.
SLICE = 4 << 20
#: Contexts of an anchor that one block holds, and windows sorted at once (a block is sorted by buckets).
BLOCK = 1 << 15
WINDOWS = 1 << 19
#: Copies of one row that are unrolled at once.
RUN = 65_536
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BASE, _MIX, _ODD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place, by doubling the length that a hash covers."""
    found, power, covered = (data.astype(np.uint64) + np.uint64(1)) * _ODD, _BASE, 1
    with np.errstate(over="ignore"):
        while covered < GRAM:
            found = found[:-covered] * power + found[covered:]
            power, covered = power * power, 2 * covered
        found ^= found >> np.uint64(32)
        found *= _MIX
        found ^= found >> np.uint64(29)
    return found


def runs_of(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, anchors' hashes, their places, first windows, last windows) of texts
    that have a window; a long text gives several pieces in order."""
    held, spans, size = [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            if size and size + len(piece) > 2 * PIECE:
                yield from _piece_runs(held, spans, length)
                held, spans, size = [], [], 0
            held.append(piece)
            spans.append((number, at, size, size + len(piece)))
            size += len(piece)
    if held:
        yield from _piece_runs(held, spans, length)


def _piece_runs(held: list[bytes], spans: list[tuple[int, int, int, int]], length: int):
    hashes = gram_hashes(np.frombuffer(b"".join(held), np.uint8))
    # The high bits of the hash, then the place: the least is the first of the least hashes.
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    reach, wanted = 1, length - GRAM + 1
    while 2 * reach <= wanted:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if reach < wanted:
        least = np.minimum(least[: -(wanted - reach)], least[wanted - reach :])
    anchor = (least & _PLACE).astype(np.int64)
    changes = np.flatnonzero(np.diff(anchor, prepend=-1))
    for number, at, begin, end in spans:
        last = end - length  # of the windows inside the piece
        a, b = np.searchsorted(changes, [begin, last], side="right")
        first = np.concatenate([[begin], changes[a:b]])
        place = anchor[first]
        yield number, hashes[place].view(np.int64), place - begin + at, first - begin + at, np.append(first[1:] - 1, last) - begin + at


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, length in bytes, text) of every row."""
    data = text_bytes(f"`{text}`")
    return df.select(
        F.col(f"`{key}`").alias("id"), F.unhex(F.sha2(data, 256)).alias("digest"), F.octet_length(data).cast("long").alias("n"), data.alias("text")
    )


def _run_lists(rows: DataFrame, length: int) -> DataFrame:
    """(doc, runs: array of (gram, place, first, last)) of the texts with a window, in pieces."""
    kinds = [("gram", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]

    def run(batches):
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            # Equal rows of a batch are hashed once.
            first_of = dict(zip(reversed(docs.to_pylist()), range(len(docs) - 1, -1, -1)))
            which = sorted(first_of.values())
            numbers, parts = [], []
            for number, *columns in runs_of([texts[i] for i in which], length):
                numbers.append(which[number])
                parts.append(columns)
            for a in range(0, len(parts), 512):
                some = parts[a : a + 512]
                offsets = np.cumsum([0, *[len(p[0]) for p in some]])
                fields = [pa.array(np.concatenate([p[i] for p in some]), t) for i, (_, t) in enumerate(kinds)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=[n for n, _ in kinds]))
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(numbers[a : a + 512])), lists], names=["doc", "runs"])

    schema = "doc long, runs array<struct<gram long, place int, first int, last int>>"
    return rows.select("doc", "text").mapInArrow(run, schema)


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """Texts (no_id, id, doc, text_no, text, runs) as contexts, a row for each run; ``offset`` is the
    anchor's place in the context, which the context's bytes determine."""
    keep = ["no_id", "id", "doc", "text_no"]

    def run(batches):
        for batch in batches:
            text, lists = batch.column(len(keep)), batch.column(len(keep) + 1)
            places = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            runs = lists.flatten()
            gram, place, first, last = (runs.field(c).to_numpy(zero_copy_only=False) for c in range(4))
            row = np.repeat(np.arange(len(text)), lists.value_lengths().to_numpy(zero_copy_only=False))
            size = (last - first + length).astype(np.int64)
            # A run of another text with the same short hash can lie beyond the end.
            fits = np.flatnonzero(first + size <= np.diff(places)[row])
            slices = np.searchsorted(np.cumsum(size[fits]), np.arange(0, size[fits].sum(), SLICE))
            for a, b in zip(slices, [*slices[1:], len(fits)]):
                some = fits[a:b]
                if not len(some):
                    continue
                offsets = np.concatenate([[0], np.cumsum(size[some])])
                take = np.arange(offsets[-1]) + np.repeat(places[row[some]] + first[some] - offsets[:-1], size[some])
                buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes())]
                context = pa.Array.from_buffers(pa.binary(), len(some), buffers)
                whose = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[some]), context, *[batch.column(c).take(whose) for c in range(len(keep))],
                        pa.array(first[some], pa.int32()), pa.array(place[some] - first[some], pa.int32()),
                    ],
                    names=["gram", "context", *keep, "start", "offset"],
                )

    kinds = texts.select(*keep, F.lit(0).alias("start"), F.lit(0).alias("offset")).schema
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("context", T.BinaryType()), *kinds])
    return texts.select(*keep, "text", "runs").mapInArrow(run, schema)


def _sorted_windows(contested: DataFrame, length: int) -> DataFrame:
    """(kind, text_no, begin, end, window, row) of contested contexts, in order of (gram, block).

    Kind 0: bytes ``begin`` to ``end`` of a text repeat an earlier window.  Kind 1: the first window
    of its kind in a block of a gram that has several blocks, with the row that orders it.
    """

    def windows_of(batch: pa.RecordBatch) -> int:
        return (pc.sum(pc.binary_length(batch.column("context"))).as_py() or 0) - batch.num_rows * (length - 1)

    def run(batches):
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            held.append(batch)
            windows += windows_of(batch)
            if windows < WINDOWS:
                continue
            table = pa.Table.from_batches(held)
            # All but the last group, which may go on.
            gram, block = table["gram"].to_numpy(), table["block"].to_numpy()
            borders = np.flatnonzero((np.diff(gram) != 0) | (np.diff(block) != 0))
            if len(borders):
                cut = int(borders[-1]) + 1
                yield from _sort_table(table.slice(0, cut), length)
                held = table.slice(cut).to_batches()
                windows = sum(map(windows_of, held))
        if held:
            yield from _sort_table(pa.Table.from_batches(held), length)

    place = contested.select("earliest.no_id", "earliest.id", "earliest.doc", "earliest.text_no", "earliest.start").schema
    schema = T.StructType(
        [
            *[T.StructField(n, k()) for n, k in (("kind", T.IntegerType), ("text_no", T.LongType), ("begin", T.IntegerType), ("end", T.IntegerType))],
            T.StructField("window", T.BinaryType()), T.StructField("place", place),
        ]
    )
    return contested.select("gram", "block", "blocks", "context", "earliest").mapInArrow(run, schema)


def _sort_table(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Sorts the windows of whole groups of contexts; ``earliest`` orders equal windows."""
    context, earliest = (pa.concat_arrays(table[c].chunks) for c in ("context", "earliest"))
    offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
    data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    gram, block, blocks = (table[c].to_numpy() for c in ("gram", "block", "blocks"))
    order_by = [earliest.field(c) for c in range(5)]
    anchor = earliest.field(5).to_numpy().astype(np.int64)
    # The rank of each context in the order of documents and places.
    ranked = pa.table([*order_by, pa.array(np.arange(len(gram)))], names=["a", "b", "c", "d", "e", "at"])
    rank = np.empty(len(gram), np.int64)
    rank[ranked.sort_by([(c, "ascending") for c in "abcde"])["at"].to_numpy()] = np.arange(len(gram))
    place_type = pa.struct(list(zip(["no_id", "id", "doc", "text_no", "start"], [f.type for f in order_by])))

    n_windows = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(gram), dtype=np.int32), n_windows)
    step = (np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)).astype(np.int32)
    group = np.cumsum((np.diff(gram, prepend=gram[0] - 1) != 0) | (np.diff(block, prepend=block[0] - 1) != 0)) - 1
    # A bucket: windows of a group that have the anchor at the same place.
    bucket = (group * length + anchor)[owner] - step
    by_bucket = np.argsort(bucket, kind="stable")
    owner, step, bucket = owner[by_bucket], step[by_bucket], bucket[by_bucket]
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    del bucket, by_bucket
    data_bytes, words, classes = data.tobytes(), words_of(data), 0
    number = np.empty(len(owner), np.int32)
    # Buckets are sorted by themselves, as many at once as hold WINDOWS.
    cuts = np.searchsorted(bounds, np.arange(0, len(owner), WINDOWS))
    for i, j in zip(cuts, [*cuts[1:], len(bounds) - 1]):
        if i < j:
            a, b = bounds[i], bounds[j]
            order, found = deep_shallow_sort(data_bytes, words, offsets[owner[a:b]] + step[a:b], length, np.diff(bounds[i : j + 1]))
            owner[a:b], step[a:b], number[a:b] = owner[a:b][order], step[a:b][order], found + classes
            classes += int(found[-1]) + 1
    first = np.flatnonzero(np.diff(number, prepend=-1))
    least = np.minimum.reduceat(rank[owner], first)[number]
    later = rank[owner] > least

    text_no, start = earliest.field(3).to_numpy(), earliest.field(4).to_numpy().astype(np.int64)
    at, where = owner[later], step[later]
    sort = np.lexsort((where, at))
    at, where = at[sort], where[sort]
    if len(at):
        begins = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(where, prepend=-2) != 1))
        ends = np.append(begins[1:] - 1, len(at) - 1)
        yield _found(0, text_no[at[begins]], start[at[begins]] + where[begins], start[at[ends]] + where[ends] + length, None, pa.nulls(len(begins), place_type))
    # Of each class in a block of several, the first goes on.
    open_ = np.flatnonzero(~later & (blocks[owner] > 1))
    for a in range(0, len(open_), 1 << 14):
        some = open_[a : a + (1 << 14)]
        own, begin = owner[some], start[owner[some]] + step[some]
        base = offsets[own] + step[some]
        windows = pa.array([data_bytes[b : b + length] for b in base.tolist()], pa.binary())
        take = pa.array(own)
        place = pa.StructArray.from_arrays(
            [*[order_by[c].take(take) for c in range(4)], pa.array(begin, pa.int32())], names=["no_id", "id", "doc", "text_no", "start"]
        )
        yield _found(1, text_no[own], begin, begin + length, windows, place)


def _found(kind: int, text_no: np.ndarray, begin: np.ndarray, end: np.ndarray, windows, place) -> pa.RecordBatch:
    n = len(text_no)
    names = ["kind", "text_no", "begin", "end"]
    columns = [pa.array(np.full(n, kind), pa.int32()), pa.array(text_no, pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
    windows = pa.nulls(n, pa.binary()) if windows is None else windows
    return pa.RecordBatch.from_arrays([*columns, windows, place], names=[*names, "window", "place"])


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the intervals cover; those that touch are one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return begin[new], reach[np.append(new[1:], len(begin)) - 1]


def _kept(texts: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """Texts with their candidate runs, the places where they come first and the repeated bytes."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_buffer()
                runs = batch.column("runs")[i].values
                first, last = (runs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                own = batch.column("own")[i].values
                own = own.to_numpy(zero_copy_only=False) if own is not None else np.zeros(0, np.int64)
                repeats = ~np.isin(first, own) & (last + length <= text.size)
                begin, end = first[repeats], last[repeats] + length
                if (more := batch.column("repeated")[i].values) is not None:
                    begin = np.concatenate([begin, more.field(0).to_numpy(zero_copy_only=False)])
                    end = np.concatenate([end, more.field(1).to_numpy(zero_copy_only=False)])
                begin, end = merged(begin, end)
                digest, parts, at = hashlib.sha256(), [], 0
                for a, b in zip([*begin.tolist(), text.size], [*end.tolist(), text.size]):
                    piece = memoryview(text)[at:a]
                    digest.update(piece)
                    if keep_text:
                        parts.append(bytes(piece))
                    at = b
                out[0].append(int((end - begin).sum()))
                out[1].append(len(begin))
                out[2].append(digest.hexdigest())
                out[3].append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
                out[4].append(b"".join(parts) if keep_text else None)
            spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), spans, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_no"), *[pa.array(v, t) for v, t in zip(out, kinds, strict=True)]],
                names=["text_no", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    schema = "text_no long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: bigint, end: bigint>>, kept binary"
    return texts.select("text_no", "text", "runs", "own", "repeated").mapInArrow(run, schema)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _repeated_grams(lists: DataFrame) -> DataFrame:
    """Grams with two places, in one text or in different ones; copies of a text count as one."""
    spot = F.xxhash64("doc", "place")
    runs = lists.select("doc", F.inline("runs"))
    counted = runs.groupBy("gram").agg(F.min(spot).alias("__a"), F.max(spot).alias("__b"))
    return counted.where(F.col("__a") != F.col("__b")).select("gram")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, keep_text: bool = False) -> DataFrame:
    """One row for each row of ``df``: key, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    Of a text's UTF-8 bytes (a null text is empty) those go that lie in a string of ``length``
    bytes which also starts earlier: in a row with a smaller key, or further ahead in the same text.
    Matches never cross rows and are judged on the input.  A null key comes after all others;
    rows that share a key come in the order of a hash of their texts, and of rows that are equal
    one counts as the first, so that the others lose all their bytes.  A text shorter than
    ``length`` stays whole.  ``spans`` lists the runs of bytes that go, ``kept`` has the other
    bytes if ``keep_text`` (else null).  Keys are of any type that can be ordered; other columns
    are ignored.
    """
    spark = df.sparkSession
    if length < 2 * GRAM:
        raise ValueError(f"at least {2 * GRAM} bytes are needed")
    before = spark.conf.get(CLEANUP, "false")
    # Each step is written; the shuffle files behind it go at once.
    spark.conf.set(CLEANUP, "true")
    try:
        return _dedup(spark, df, key, text, length, keep_text)
    finally:
        spark.conf.set(CLEANUP, before)


def _dedup(spark: SparkSession, df: DataFrame, key: str, text: str, length: int, keep_text: bool) -> DataFrame:
    rows = _rows(df, key, text).withColumn("doc", F.xxhash64("digest"))
    # Rows by key and text, without the text: copies are counted here.
    thin = saved(rows.groupBy("id", "digest").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("least")
    texts = thin.groupBy("digest").agg(first, F.first("n").alias("n"))
    texts = texts.select("digest", "least.no_id", "least.id", "n", F.xxhash64("digest").alias("doc"))
    texts = saved(texts.withColumn("text_no", F.monotonically_increasing_id()), "texts")
    long_texts = texts.where(F.col("n") >= length)

    lists_path = scratch_path(spark, "runs")
    lists = saved(_run_lists(rows.where(F.col("n") >= length), length), "runs", lists_path)
    grams = saved(_repeated_grams(lists), "grams")
    runs = lists.select("doc", F.inline("runs")).join(grams, "gram")
    runs = runs.groupBy("doc").agg(F.collect_set(F.struct("gram", "place", "first", "last")).alias("runs"))
    wanted = saved(long_texts.drop("n").join(runs, "doc"), "wanted")
    discard(spark, lists_path)

    there = rows.where(F.col("n") >= length).select("id", "digest", "text")

    def with_texts(found: DataFrame) -> DataFrame:
        found = found.withColumnsRenamed({"id": "__id", "digest": "__digest"})
        return there.join(found, (there["digest"] == found["__digest"]) & _same(there["id"], found["__id"])).drop("__id", "__digest")

    contexts = _contexts(with_texts(wanted), length)
    earliest = F.min(F.struct("no_id", "id", "doc", "text_no", "start", "offset")).alias("earliest")
    classes = saved(contexts.groupBy("gram", "context").agg(earliest), "contexts")
    # An anchor's contexts are told apart by sorting only where there are several.
    sizes = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > 1)
    blocks = F.ceil(F.col("contexts") / BLOCK).cast("int")
    contested = classes.join(sizes, "gram").withColumn("blocks", blocks)
    contested = contested.withColumn("block", F.pmod(F.xxhash64("context"), F.col("blocks")).cast("int"))
    contested = contested.repartition("gram", "block").sortWithinPartitions("gram", "block")
    found = saved(_sorted_windows(contested, length), "windows")
    # Between blocks: at most one window of a kind from each.
    in_order = Window.partitionBy("window").orderBy("place")
    across = found.where("kind = 1").withColumn("__nth", F.row_number().over(in_order)).where("__nth > 1")
    span = F.struct(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))
    repeated = found.where("kind = 0").unionByName(across.drop("__nth")).groupBy("text_no").agg(F.collect_list(span).alias("repeated"))
    own = classes.groupBy("earliest.text_no").agg(F.collect_list(F.col("earliest.start").cast("long")).alias("own"))
    marked = saved(wanted.join(own, "text_no", "left").join(repeated, "text_no", "left"), "marked")

    kept = _kept(with_texts(marked), length, keep_text)
    # Rows equal in key and text are all here; they give the same result.
    kept = saved(kept.groupBy("text_no").agg(*[F.first(c).alias(c) for c in kept.columns[1:]]), "kept")
    done = texts.join(kept, "text_no", "left").select(
        F.col("digest").alias("__digest"), F.col("id").alias("__id"), *[F.col(c) for c in kept.columns[1:]]
    )
    placed = thin.join(done, thin["digest"] == done["__digest"])
    leads = _same(F.col("id"), F.col("__id"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RUN).cast("long"))
    unrolled = placed.withColumn("__run", F.explode(starts)).withColumn(
        "__nth", F.explode(F.sequence(F.col("__run"), F.least(F.col("rows"), F.col("__run") + RUN) - 1))
    )
    empty = hashlib.sha256(b"").hexdigest()
    is_first = leads & (F.col("__nth") == 0)
    gone = ~is_first & (F.col("n") >= length)

    def value(name: str, whole: Column, removed: Column) -> Column:
        return F.when(gone, removed).when(is_first & F.col("n_spans").isNotNull(), F.col(name)).otherwise(whole)

    whole_span = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    result = unrolled.select(
        F.col("id").alias(key), F.col("n").alias("n_bytes"), F.col("digest").alias("__digest"),
        value("n_removed", F.lit(0).cast("long"), F.col("n")).alias("n_removed"),
        value("n_spans", F.lit(0).cast("long"), F.lit(1).cast("long")).alias("n_spans"),
        value("kept_sha256", F.lower(F.hex("digest")), F.lit(empty)).alias("kept_sha256"),
        value("spans", none, whole_span).alias("spans"),
        value("kept", F.lit(None).cast("binary"), F.lit(b"" if keep_text else None).cast("binary")).alias("kept"),
    )
    if not keep_text:
        return result.drop("__digest")
    # Texts that stay whole come from the input, once for each key and text.
    plain = rows.groupBy("id", "digest").agg(F.first("text").alias("__text")).withColumnsRenamed({"id": "__id", "digest": "__own"})
    result = result.join(plain, (F.col("__digest") == F.col("__own")) & _same(F.col(f"`{key}`"), F.col("__id")))
    return result.withColumn("kept", F.when(F.col("n_removed") == 0, F.col("__text")).otherwise(F.col("kept"))).drop("__digest", "__own", "__id", "__text")


def query(documents: DataFrame) -> DataFrame:
    return dedup(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, s, b[s + 1 : s + 100] AS k
  FROM (SELECT doc_id, b, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)
), r AS (
  SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), i AS (
  SELECT doc_id, s, sum(starts) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS starts FROM r)
), p AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY doc_id, run
), g AS (
  SELECT p.doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY p.doc_id ORDER BY a), 0) AS from_,
         lead(a) OVER (PARTITION BY p.doc_id ORDER BY a) IS NULL AS is_last
  FROM p
), c AS (
  SELECT g.doc_id, sum(e - a) AS n_removed, count(*) AS n_spans,
         string_agg(hex(b[from_ + 1 : a]) || CASE WHEN is_last THEN hex(b[e + 1 : n]) ELSE '' END, '' ORDER BY a) AS kept
  FROM g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN n_spans IS NULL THEN sha256(d.b) ELSE sha256(unhex(c.kept)) END AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
