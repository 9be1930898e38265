"""SimHash near-duplicate detection by segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments.  The Manhattan distance of
two such vectors never exceeds the Hamming distance of the fingerprints, so fingerprints that
differ in at most ``distance`` bits lie within that Manhattan distance.  The grid: segments form
``groups``; at most ``distance`` groups can differ, so for every pair some choice of the other
groups has equal bit counts.  Each choice is one grid; a fingerprint has one cell in each.  Members
of a cell are held against each other by Manhattan distance, then exactly.

Only distinct fingerprints meet: exact copies were joined before by an aggregation.  A cell yields
a spanning forest of its links, at most one fewer than its members, so a large group of near
copies makes no square of rows.  A cell beyond ``CELL`` members is dealt into blocks, and every
pair of blocks is compared by a task of its own.  Components come from contracting the links round
by round; no link, component or fingerprint goes to the driver.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import append_columns, join_counted, saved, text_bytes

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fewest groups; more of them mean fewer chance candidates and more grids (6 give 20, 8 give 56).
GROUPS = 6
#: Bits of information in the count of a two-bit segment of a random fingerprint, and chance members
#: of a cell that cost as much as the row that brings a fingerprint there.
COUNT_BITS = 1.5
CHANCE = 16
#: Members of a grid cell that one task compares at once.
CELL = 4096
#: Cells up to this size are compared many at a time.
TINY = 8
#: Shingles of one text whose bits are unpacked at once.
SLAB = 1 << 15
LOW_BITS = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as an unsigned 64-bit integer; 0 where there is no word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    total = len(words) - shingle + 1

    def slabs():
        for at in range(0, total, SLAB):
            slab = words[at : at + SLAB + shingle - 1]
            yield np.array(
                [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*[slab[k:] for k in range(shingle)])], dtype="<u8"
            )

    return majority(slabs(), total)


def majority(slabs, total: int) -> int:
    """The bits set in over half of ``total`` 64-bit hashes, which come in arrays."""
    ones = np.zeros(64, dtype=np.int64)
    for hashes in slabs:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with fingerprint (long, the 64 bits) for every row; a null text has no word."""

    def start():
        def work(texts: list[bytes]):
            found = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            return (found.view(np.int64).tolist(),)

        return work

    return append_columns(df, [text_bytes(text)], [("fingerprint", T.LongType())], start, keep)


def bit_counts(print_: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in the two bits of its segment."""
    upper = F.shiftrightunsigned(print_, 1)
    both = print_.bitwiseAND(upper).bitwiseAND(F.lit(LOW_BITS))
    one = print_.bitwiseXOR(upper).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(both, 1).bitwiseOR(one)


def grid_masks(distance: int = DISTANCE, groups: int = GROUPS) -> list[int]:
    """For each grid, the bits of the segments whose counts name a cell (as signed 64 bits)."""
    if not distance < groups <= 32:
        raise ValueError("there must be more groups than differing bits, and at most 32")
    edges = [32 * g // groups for g in range(groups + 1)]
    masks = []
    for kept in combinations(range(groups), groups - distance):
        mask = 0
        for g in kept:
            for segment in range(edges[g], edges[g + 1]):
                mask |= 3 << 2 * segment
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def groups_for(prints: int, distance: int = DISTANCE) -> int:
    """The number of groups that takes the least work for so many fingerprints."""

    def work(groups: int) -> float:
        edges = [32 * g // groups for g in range(groups + 1)]
        kept = sorted(b - a for a, b in zip(edges, edges[1:]))[: groups - distance]
        return comb(groups, distance) * (1 + prints / 2 ** (COUNT_BITS * sum(kept)) / CHANCE)

    return min(range(max(GROUPS, distance + 1), 17), key=work)


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether fingerprints are within ``distance`` bits: the Manhattan bound, then exactly."""
    low = np.uint64(LOW_BITS)
    x, y = (((v & v >> np.uint64(1)) & low) << np.uint64(1) | (v ^ v >> np.uint64(1)) & low for v in (a, b))
    x = x ^ y
    odd = x & low
    bound = np.bitwise_count(odd) + 2 * np.bitwise_count((x >> np.uint64(1)) & low & ~odd)
    return (bound <= distance) & (np.bitwise_count(a ^ b) <= distance)


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between members that suffice to join what links join: at most one fewer than members."""
    n = len(prints)
    group = np.arange(n)
    links = []
    step = max(1, (1 << 20) // n)
    for at in range(0, n - 1, step):
        close = near(prints[at : at + step, None], prints[None, :], distance)
        for i, row in enumerate(close, at):
            others = np.flatnonzero(row[i + 1 :]) + i + 1
            others = others[group[others] != group[i]]
            while len(others):
                j = others[0]
                links.append((i, int(j)))
                group[group == group[j]] = group[i]
                others = others[group[others] != group[i]]
    return links


def _cell_links(distance: int, limit: int | None):
    """Rows (cell columns..., print) sorted by cell to links; cells over ``limit`` are passed on."""

    def run(batches):
        key: tuple | None = None
        members: list[np.ndarray] = []
        size, over = 0, False

        def ended():
            if size > 1 and not over:
                prints = np.unique(np.concatenate(members))
                if len(prints) > 1:
                    return [(prints[i], prints[j]) for i, j in forest(prints, distance)]
            return []

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cells = [c.to_numpy() for c in batch.columns[:-1]]
            prints = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            new = np.ones(n, dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cells])
            starts = np.append(np.flatnonzero(new), n)
            sizes = np.diff(starts)
            links, passed_cells, passed = [], [], []
            # All but the first and last run of the batch are whole cells.
            whole = np.ones(len(sizes), dtype=bool)
            whole[[0, -1]] = False
            for k in range(2, TINY + 1):
                at = starts[:-1][whole & (sizes == k)]
                for i, j in combinations(range(k), 2):
                    if len(at):
                        a, b = prints[at + i], prints[at + j]
                        hit = near(a, b, distance) & (a != b)
                        links += zip(a[hit], b[hit])
            rest = np.flatnonzero(~whole | (sizes > TINY))
            for r in rest:
                now = tuple(int(c[starts[r]]) for c in cells)
                part = prints[starts[r] : starts[r + 1]]
                if now != key:
                    links += ended()
                    key, members, size, over = now, [], 0, False
                members.append(part)
                size += len(part)
                if limit is not None and size > limit:
                    over = True
                    joined = np.concatenate(members)
                    passed.append(joined)
                    passed_cells.append(np.full(len(joined), key[0]))
                    members = []
            yield _link_batch(links, passed_cells, passed)
        if key is not None and (links := ended()):
            yield _link_batch(links, [], [])

    return run


def _link_batch(links, cells, passed) -> pa.RecordBatch:
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    n = len(pairs)
    more = np.concatenate(passed).view(np.int64) if passed else np.zeros(0, np.int64)
    cell = np.concatenate(cells) if cells else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(pairs[:, 0], more)),
            pa.array(np.append(pairs[:, 1], more)),
            pa.array(np.append(np.zeros(n, np.int64), cell), mask=np.arange(n + len(more)) < n),
        ],
        names=["a", "b", "cell"],
    )


def near_links(
    prints: DataFrame, distance: int = DISTANCE, groups: int | None = None, cell: int = CELL
) -> DataFrame:
    """Links (a, b) that join exactly what all links between distinct fingerprints join.

    ``prints`` has each fingerprint once; ``groups`` is chosen by their number if not given.
    """
    groups = groups or groups_for(prints.count(), distance)
    counts = bit_counts(F.col("fingerprint"))
    cells = F.array(
        *[F.xxhash64(F.lit(k), counts.bitwiseAND(F.lit(m))) for k, m in enumerate(grid_masks(distance, groups))]
    )
    dealt = (
        prints.select(F.explode(cells).alias("cell"), "fingerprint")
        .repartition("cell")
        .sortWithinPartitions("cell")
    )
    schema = "a long, b long, cell long"
    found = saved(dealt.mapInArrow(_cell_links(distance, cell), schema), "links")
    links = found.where("cell IS NULL").select("a", "b")
    large = found.where("cell IS NOT NULL").select("cell", F.col("a").alias("fingerprint"))
    sizes = large.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
    if sizes.isEmpty():
        return links
    blocks = F.ceil(F.col("members") * 2 / cell).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    dealt = (
        join_counted(large, sizes.withColumn("blocks", blocks), "cell", "members")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
        .repartition("cell", "i", "j")
        .sortWithinPartitions("cell", "i", "j")
    )
    return links.unionByName(dealt.mapInArrow(_cell_links(distance, None), schema).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): nodes that links join share a root.

    Each round points every node at its smallest neighbour if that is smaller, follows the
    pointers once more, and keeps the links between what they point at.  A node's rows of a round
    are summed up before they move, and rounds shrink the links until none is left.
    """
    edges = saved(links.where("a <> b").select("a", "b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("least"))
            .select("node", F.least("node", "least").alias("root")),
            "pointers",
        )
        higher = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = saved(up.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "pointers")
        rounds.append(jumped)
        for side in ("a", "b"):
            edges = edges.join(jumped.withColumnsRenamed({"node": side, "root": f"{side}_root"}), side)
        edges = saved(
            edges.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
            .where("a <> b")
            .distinct(),
            "edges",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        found = found.join(later.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")
        )
    return found


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, groups: int | None = None
) -> DataFrame:
    """key, fingerprint (long) and component_id for every row of ``df``.

    component_id is the smallest key that can be reached over rows whose fingerprints differ in at
    most ``distance`` bits.  Rows with no word (null, empty or blank texts) have fingerprint 0 and
    link like any other.  Null keys count only where a component has no other key.  Repeated rows
    stay; an empty table gives an empty result; other columns of ``df`` play no part.
    """
    named = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = saved(fingerprints(named, keep=["key"]), "fingerprints")
    prints = saved(
        rows.groupBy("fingerprint").agg(F.min("key").alias("least_key"), F.count(F.lit(1)).alias("rows")), "prints"
    )
    roots = saved(components(near_links(prints.select("fingerprint"), distance, groups)), "roots")
    rooted = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    linked = rooted.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("least_key").alias("component_id"))
    placed = (
        linked.join(least, "root")
        .select("fingerprint", "component_id", "rows")
        .unionByName(
            rooted.where("root IS NULL").select("fingerprint", F.col("least_key").alias("component_id"), "rows")
        )
    )
    return join_counted(rows, saved(placed, "placed"), "fingerprint", "rows").withColumnRenamed("key", key)


def text_digest(text: str) -> Column:
    """64 bits that stand for a text; a null text has one of its own."""
    return F.xxhash64(F.col(f"`{text}`"))


def first_rows(df: DataFrame, rows: DataFrame, roots: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``df`` for each component of groups.

    ``rows`` has key, digest (of the text) and group of every row of ``df``; ``roots`` (node, root)
    joins groups to components.  The row with the smallest key stays, null last, then with the
    least digest; rows that agree in both are told apart by the hash of all columns.
    """
    told = rows.groupBy("group", "key", "digest").agg(F.count(F.lit(1)).alias("rows"))
    place = F.struct(F.col("key").isNull().alias("last"), "key", "digest", "rows")
    best = told.groupBy("group").agg(F.min(place).alias("best"))
    rooted = best.join(roots.withColumnRenamed("node", "group").hint("merge"), "group", "left")
    kept = rooted.groupBy(F.coalesce("root", "group").alias("root")).agg(F.min("best").alias("best"))
    kept = saved(
        kept.select(F.col("best.key").alias("__key"), F.col("best.digest").alias("__digest"), F.col("best.rows").alias("__rows")),
        "kept",
    )
    # Always a shuffle: the kept rows grow with the input, so the plan is the same at every size.
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (text_digest(text) == F.col("__digest"))
    stay = df.join(kept.hint("merge"), same, "inner")
    once = stay.where("__rows = 1").drop("__key", "__digest", "__rows")
    row = [F.col(f"`{c}`") for c in df.columns]
    picked = (
        stay.where("__rows > 1")
        .groupBy("__key", "__digest")
        .agg(F.min_by(F.struct(*row), F.xxhash64(*row)).alias("__row"))
        .select("__row.*")
    )
    return once.unionByName(picked)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component one row with the smallest key.

    Null keys come last; where several rows have that key, the one with the least text digest stays.
    """
    named = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), text_digest(text).alias("digest")
    )
    rows = saved(fingerprints(named, keep=["key", "digest"]), "fingerprints")
    roots = saved(components(near_links(rows.select("fingerprint").distinct())), "roots")
    return first_rows(df, rows.select("key", "digest", F.col("fingerprint").alias("group")), roots, key, text)


def query(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
