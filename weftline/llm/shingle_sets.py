"""Near duplicates by the Jaccard similarity of shingle sets: operator 9 as the pipeline's stage.

Two texts are near duplicates if their sets of five-word shingles have a similarity of at least
0.8.  Candidates come from two places.  The first is the grid of ``simhash`` over fingerprints of
the five-word shingles; it reaches three bits.  At a similarity of 0.8 fingerprints differ in about
ten of 64 bits, and no grid of popcounts reaches that far with cells that still tell texts apart.
So the others come from BANDS bands of DEPTH MinHash values each; a pair at the bound meets in some
band with a chance of 1 - (1 - 0.8 ** DEPTH) ** BANDS, all but one in ten million.

Equal sets are put together before.  Sets that candidates join form a family, and within a family
sets are verified exactly: a family is dealt into blocks, and each pair of blocks goes to one task
that works out all similarities at once and yields a spanning forest of the links.  So no pair is
a row, and a large group of near copies makes no square of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import append_columns, join_counted, saved, text_bytes
from weftline.llm.simhash import components, first_rows, majority, near_links, text_digest

SHINGLE = 5
#: Least similarity, as a fraction.
ALIKE = (4, 5)
#: Sets of a block, from small families to large ones, and shingles of a block.
BLOCK, LARGEST, WEIGHT = 512, 4096, 1 << 21
#: Families up to this size are verified pair by pair.
TINY = 8
#: Shingles that similarities are worked out over at once.
COLUMNS = 2048
BANDS, DEPTH = 40, 5
#: Shingles of one text whose MinHash values are worked out at once.
SLAB = 1 << 12
_DRAWS = np.random.default_rng(42)
_PLACES = _DRAWS.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _DRAWS.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAWS.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ values >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ values >> np.uint64(33)


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, a blank one none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    total = len(words) - width + 1
    sums = np.full(total, width, dtype=np.uint64)
    for k in range(width):
        sums += hashes[k : k + total] * _PLACES[k]
    return np.unique(mixed(sums))


def cells(found: np.ndarray) -> np.ndarray:
    """The cell of each band: a hash of the band's number and its MinHash values."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), SLAB):
        part = found[None, at : at + SLAB] * _FACTORS[:, None]
        part += _SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEPTH).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def sketches(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with set_id (equal for equal sets), n (shingles), fingerprint and cells; a blank text has no cell."""

    def start():
        from xxhash import xxh64_intdigest

        def work(texts: list[bytes]):
            ids, sizes, prints, where = [], [], [], []
            for t in texts:
                found = shingles(t)
                ids.append(xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                prints.append(majority((found[a : a + SLAB] for a in range(0, len(found), SLAB)), len(found)))
                where.append(cells(found) if len(found) else found)
            ends = np.cumsum([0, *map(len, where)])
            flat = np.concatenate(where).view(np.int64) if where else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            ids, prints = (np.array(v, dtype=np.uint64).view(np.int64).tolist() for v in (ids, prints))
            return ids, sizes, prints, lists

        return work

    fields = [("set_id", T.LongType()), ("n", T.LongType()), ("fingerprint", T.LongType()), ("cells", T.ArrayType(T.LongType()))]
    return append_columns(df, [text_bytes(text)], fields, start, keep)


def shingle_arrays(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with shingles, the set as an array."""

    def start():
        return lambda texts: ([shingles(t).view(np.int64) for t in texts],)

    return append_columns(df, [text_bytes(text)], [("shingles", T.ArrayType(T.LongType()))], start, keep)


def alike_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets (sorted shingles) ``left`` by ``right`` are similar enough, for all of them."""
    size = np.array([len(s) for s in sets])
    bound = (size[left][:, None] + size[right][None, :]) * ALIKE[0]
    shared = np.zeros(bound.shape, dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(first) - 1
    # Only shingles that occur twice count towards any intersection.
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    row_left, row_right = (np.full(len(sets), -1) for _ in range(2))
    row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        sides = []
        for rows, n in ((row_left, len(left)), (row_right, len(right))):
            side = np.zeros((n, min(COLUMNS, width - a)), dtype=np.float32)
            mine = rows[owner[part]]
            side[mine[mine >= 0], (column[part] - a)[mine >= 0]] = 1
            sides.append(side)
        shared += (sides[0] @ sides[1].T).astype(np.int64)
    return shared * sum(ALIKE) >= bound


def verified(sets: list[np.ndarray], own: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of a task that join what all of their links join; ``own`` tells the
    blocks apart: within one block all pairs count, between two those of different blocks."""
    low, high = int(own.min()), int(own.max())
    n = len(sets)
    if n <= TINY and low == high:
        close = np.zeros((n, n), dtype=bool)
        for i in range(n):
            for j in range(i):
                a, b = sets[i], sets[j]
                if min(len(a), len(b)) * ALIKE[1] >= max(len(a), len(b)) * ALIKE[0]:
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    close[i, j] = shared * sum(ALIKE) >= (len(a) + len(b)) * ALIKE[0]
    else:
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        close = np.zeros((n, n), dtype=bool)
        close[np.ix_(left, right)] = alike_pairs(sets, left, right)
    close |= close.T
    links, free = [], np.ones(n, dtype=bool)
    for i in range(n):
        reached = np.flatnonzero(close[i] & free) if free[i] else []
        free[i] = False
        while len(reached):
            reached = reached[reached != i]
            free[reached] = False
            links += [(i, int(j)) for j in reached]
            reached = np.flatnonzero(close[reached].any(axis=0) & free) if len(reached) else []
    return links


def _verify(batches):
    """Rows (family, i, j, own, set_id, shingles) sorted by family, i and j, to links (a, b)."""
    name, ids, owns, sets = None, [], [], []

    def links():
        # A task of two blocks of which one has no set here has nothing to compare.
        if len(sets) < 2 or (name[1] < name[2] and len(set(owns)) < 2):
            return []
        return [(ids[i], ids[j]) for i, j in verified(sets, np.array(owns))]

    for batch in batches:
        out = []
        keys = zip(*[batch.column(i).to_pylist() for i in range(5)])
        lists = batch.column(5)
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        for k, (family, i, j, own, set_id) in enumerate(keys):
            if (family, i, j) != name:
                out += links()
                name, ids, owns, sets = (family, i, j), [], [], []
            ids.append(set_id)
            owns.append(own)
            sets.append(flat[ends[k] : ends[k + 1]].copy())
        yield _pairs(out)
    yield _pairs(links())


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def candidate_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that join sets into families: similar sets are in one family.

    ``sets`` has set_id, fingerprint and cells; a cell or a fingerprint gives a link less than it
    has members.
    """
    worded = sets.where(F.size("cells") > 0)
    member = saved(worded.select(F.explode("cells").alias("cell"), "set_id"), "cells")
    met = member.groupBy("cell").agg(F.min("set_id").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    banded = member.join(met.select("cell", "a").hint("merge"), "cell").select("a", F.col("set_id").alias("b"))
    prints = saved(worded.groupBy("fingerprint").agg(F.min("set_id").alias("a")), "prints")
    equal = worded.select("fingerprint", F.col("set_id").alias("b")).join(prints.hint("merge"), "fingerprint").select("a", "b")
    near = near_links(prints.select("fingerprint"))
    for side in ("a", "b"):
        near = near.join(prints.select(F.col("fingerprint").alias(side), F.col("a").alias(f"set_{side}")).hint("merge"), side)
    near = near.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    return banded.unionByName(equal).unionByName(near).where("a <> b")


def similar_links(df: DataFrame, text: str, rows: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly the set_ids that links of similar sets join.

    ``rows`` has digest, set_id, n, fingerprint and cells of each text of ``df``.
    """
    one = F.min_by(F.struct("digest", "n", "fingerprint", "cells"), "digest").alias("s")
    sets = saved(rows.groupBy("set_id").agg(one).select("set_id", "s.*"), "sets")
    family = saved(components(candidate_links(sets)), "families").select(F.col("node").alias("set_id"), F.col("root").alias("family"))
    family = saved(family.join(sets.select("set_id", "digest", "n").hint("merge"), "set_id"), "families")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST), F.col("members") / 8))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    placed = (
        join_counted(family, saved(sizes.select("family", blocks.alias("blocks"), "members"), "sizes"), "family", "members")
        .withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
        .select("set_id", "digest", "family", "blocks", "own")
    )
    texts = df.select(text_digest(text).alias("of"), F.col(f"`{text}`").alias("text"))
    # Always a shuffle, so that the plan is the same at every size; copies of a text go after it.
    held = texts.join(placed.hint("merge"), F.col("digest") == F.col("of"))
    held = held.groupBy("set_id").agg(F.first(F.struct("text", "family", "blocks", "own")).alias("s")).select("set_id", "s.*")
    dealt = (
        shingle_arrays(held, "text", ["set_id", "family", "blocks", "own"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "shingles")
        .repartition("family", "i", "j")
        .sortWithinPartitions("family", "i", "j")
    )
    return saved(dealt.mapInArrow(_verify, "a long, b long"), "links")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component of similar texts one row stays.

    That is a row with the smallest key (null last), of several such texts the one with the least
    digest.  Texts without words are alike.
    """
    named = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), text_digest(text).alias("digest")
    )
    rows = saved(sketches(named, "text", ["key", "digest"]), "sketches")
    roots = saved(components(similar_links(df, text, rows)), "roots")
    return first_rows(df, rows.select("key", "digest", F.col("set_id").alias("group")), roots, key, text)
