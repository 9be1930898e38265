"""Mixing sources to target weights by balanced sampling (the cube method, Deville and Tille, 2004).

Every document gets an inclusion number: its source's target divided by its source's size.  The
whole part is taken for sure; the fractional parts are settled by the cube method.  The flight
phase holds three open documents at a time and moves their probabilities along the null-space of
two constraints (the number of documents and the number of tokens), in a random direction that
leaves every probability right on average, until one of them is 0 or 1.  Flights run in blocks of
one source; at most two documents a block stay open, and these fly again in larger blocks, level
by level, until one block a source is left.  Its last documents land with the token constraint
dropped, then with a plain draw.

All draws come from a seed, the source and the block, and blocks are dealt by a hash of the key
and size, so reruns agree whatever the partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import append_columns, join_counted, saved, text_bytes

WEIGHTS = (1, 2, 3)
#: Most copies of a document.
REPEAT = 3
SEED = 20_240_229
BLOCK = 4096
#: Probabilities this close to 0 or 1 are settled.
CLOSE = 1e-9


def word_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with size: the words of each text (runs of characters other than x20, x09-x0D)."""
    start = lambda: lambda texts: ([len(t.split()) for t in texts],)
    return append_columns(df, [text_bytes(text)], [("size", T.LongType())], start, keep)


def source_targets(
    sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT
) -> DataFrame:
    """One row a source: source_number, source_size, target, rows, documents with probability.

    Sources in code point order, null last, weigh ``weights`` in turn and share the total of all
    sizes; a target stops at ``repeat`` times the source's size and the excess is shared again.
    The water level comes in closed form: with sources in the order in which they are capped, it
    is the highest of the levels that result from capping the first few.
    """
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    # One row for each source from here on.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_number") % len(weights)) + 1).cast("int")
    )
    numbered = by_source.withColumn("source_number", F.row_number().over(named) - 1).withColumn("weight", weight)
    capped = Window.orderBy(F.col("source_size") / F.col("weight"), "source_number")
    before, on = (
        capped.rowsBetween(Window.unboundedPreceding, -1),
        capped.rowsBetween(0, Window.unboundedFollowing),
    )
    everything = Window.partitionBy()
    cap = F.lit(float(repeat)) * F.col("source_size")
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    ) / F.sum("weight").over(on)
    return (
        numbered.withColumn("level", level)
        .withColumn("target", F.least(F.max("level").over(everything) * F.col("weight"), cap))
        .select("source", "source_number", "source_size", "target", "rows")
    )


def flight(chance: np.ndarray, size: np.ndarray, draws: np.random.Generator, land: bool) -> np.ndarray:
    """Settled probabilities: all 0 or 1 but at most two (none if ``land``).

    ``chance`` lies within 0 and 1 and is not changed; ``size`` has the balanced totals' terms.
    """
    out = chance.tolist()
    sizes = size.tolist()
    random = draws.random(2 * len(out) + 2).tolist()
    held: list[int] = []
    waiting = [i for i, p in enumerate(out) if CLOSE < p < 1 - CLOSE]
    for i, p in enumerate(out):
        if not CLOSE < p < 1 - CLOSE:
            out[i] = float(p >= 0.5)
    waiting.reverse()
    while True:
        while waiting and len(held) < 3:
            held.append(waiting.pop())
        if len(held) == 3:
            i, j, k = held
            a, b, c = sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j]
            if a or b or c:
                move = ((i, a), (j, b), (k, c))
            else:  # equal sizes: two documents balance both totals
                move = ((i, 1.0), (j, -1.0))
        elif len(held) == 2 and (land or sizes[held[0]] == sizes[held[1]]):
            move = ((held[0], 1.0), (held[1], -1.0))
        elif len(held) == 1 and land:
            move = ((held[0], 1.0),)
        else:
            return np.array(out)
        ahead = back = math.inf
        for i, u in move:
            p = out[i]
            if u > 0:
                ahead, back = min(ahead, (1 - p) / u), min(back, p / u)
            elif u < 0:
                ahead, back = min(ahead, -p / u), min(back, (p - 1) / u)
        step = ahead if random.pop() * (ahead + back) < back else -back
        for i, u in move:
            p = out[i] + step * u
            out[i] = 0.0 if p < CLOSE else 1.0 if p > 1 - CLOSE else p
        held = [i for i in held if 0.0 < out[i] < 1.0]


def _fly(rows: DataFrame, size_of_block: int, level: int, land: bool, seed: int) -> DataFrame:
    """One level: ``rows`` (key, source_number, block, size, chance, ...) with chances settled in blocks."""
    schema = rows.schema

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        by = ["key", "size", "number", "chance", *(["digest"] if "digest" in pdf else [])]
        pdf = pdf.sort_values(by, kind="stable", na_position="first")
        number, block = int(pdf["source_number"].iloc[0]), int(pdf["block"].iloc[0])
        draws = np.random.default_rng([seed, level, number, block])
        found = flight(pdf["chance"].to_numpy(), pdf["size"].to_numpy(dtype=np.float64), draws, land)
        return pdf.assign(chance=found, block=block // size_of_block)

    return rows.groupBy("source_number", "block").applyInPandas(settle, schema)


def mix_units(units: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``units`` (key, source, size) with source_size, target and copies (int).

    A column digest, where there is one, tells apart documents of one key and is kept with the source.
    """
    told = ["digest", "source"] if "digest" in units.columns else []
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.lit(1)).cast("long")
    names = [c for c in ("key", "source", "size", "digest") if c in units.columns]
    equal = saved(units.groupBy(*names).agg(F.count(F.lit(1)).alias("times")), "equal-units")
    # Equal units are told apart by a number, so that they spread over blocks like any others.
    units = _unrolled(equal, "times", "number")
    joined = join_counted(units, targets.withColumns({"share": share, "blocks": blocks}), "source", "rows")
    rows = joined.select(
        F.col("key"),
        "size",
        "source_size",
        "target",
        "source_number",
        "number",
        F.pmod(F.xxhash64("key", "size", "number"), F.col("blocks")).alias("block"),
        F.floor("share").cast("int").alias("whole"),
        (F.col("share") - F.floor("share")).alias("chance"),
        *told,
    )
    most = targets.agg(F.max("rows")).first()[0] or 0
    blocks_left = -(-most // block)
    step = block // 2
    settled, level = [], 0
    while True:
        land = blocks_left <= 1
        rows = saved(_fly(rows, step, level, land, seed), "flight")
        is_open = (F.col("chance") > 0.0) & (F.col("chance") < 1.0)
        settled.append(rows.where(~is_open))
        if land:
            break
        rows = rows.where(is_open)
        blocks_left, level = -(-blocks_left // step), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select(
        "key", "size", "source_size", "target", (F.col("whole") + F.col("chance").cast("int")).alias("copies"), *told
    )


def take(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    repeat: int = REPEAT,
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every row of ``df``: key, size, source_size, target, copies.

    A null text has size 0; a null source is a source of its own, named last; null keys and
    repeated rows are documents like any other and are drawn one by one; a source without words
    has target 0; an empty table gives an empty result; other columns of ``df`` play no part.
    """
    named = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")
    )
    return _taken(named, ["key", "source"], weights, repeat, seed)


def _taken(named: DataFrame, keep: list[str], weights: tuple[int, ...], repeat: int, seed: int) -> DataFrame:
    units = saved(word_counts(named, keep=keep), "sizes")
    targets = saved(source_targets(units, "source", weights, repeat), "targets")
    return mix_units(units, targets, seed=seed)


def mix(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    repeat: int = REPEAT,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken.

    Draws are joined back by key, source and the text's digest.  Rows that share all three share
    their copies as evenly as whole numbers allow.
    """
    digest = F.xxhash64(F.col(f"`{text}`"))
    named = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"),
        digest.alias("digest"),
    )
    taken = _taken(named, ["key", "source", "digest"], weights, repeat, seed)
    identity = ["__key", "__source", "__digest"]
    by_row = saved(
        taken.groupBy(*[F.col(c.strip("_")).alias(c) for c in identity]).agg(
            F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")
        ).where("__copies > 0"),
        "copies",
    )
    # Always a shuffle: the rows grow with the input, so the plan is the same at every size.
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & F.col(f"`{source}`").eqNullSafe(F.col("__source"))
    rows = df.join(by_row.hint("merge"), same & (digest == F.col("__digest")), "inner")
    once = _repeated(rows.where("__rows = 1"), F.col("__copies")).select(*[F.col(f"`{c}`") for c in df.columns])
    # Rows that agree in all columns are counted; the kinds share the copies, and the first take the spare.
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kinds = (
        rows.where("__rows > 1")
        .withColumn("__kind", F.xxhash64(row))
        .groupBy(*identity, "__kind")
        .agg(F.first(row).alias("__row"), F.count(F.lit(1)).alias("__times"), F.first("__copies").alias("__copies"), F.first("__rows").alias("__rows"))
    )
    before = Window.partitionBy(*identity).orderBy("__kind").rowsBetween(Window.unboundedPreceding, -1)
    share = F.floor(F.col("__copies") / F.col("__rows"))
    spare = F.col("__copies") - share * F.col("__rows") - F.coalesce(F.sum("__times").over(before), F.lit(0))
    extra = F.least(F.greatest(spare, F.lit(0)), F.col("__times"))
    kinds = kinds.withColumn("__taken", share * F.col("__times") + extra).where("__taken > 0")
    often = _unrolled(kinds, "__taken", "__number").select("__row.*")
    return once.unionByName(often)


#: Copies that one row gives in one task.
RUN = 1024


def _unrolled(df: DataFrame, times: str, number: str) -> DataFrame:
    """Each row of ``df`` ``times`` (dropped) times, with ``number`` from 0; many copies of one row
    are made by many tasks."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    few = df.where(F.col(times) <= RUN).withColumn("__run", zero)
    many = df.where(F.col(times) > RUN)
    many = many.withColumn("__run", F.explode(F.sequence(zero, F.col(times) - 1, F.lit(RUN).cast("long")))).repartition("__run")
    last = F.least(F.col(times), F.col("__run") + RUN) - one
    both = few.unionByName(many).withColumn(number, F.explode(F.sequence(F.col("__run"), last)))
    return both.drop("__run", times)


def _repeated(df: DataFrame, copies: Column) -> DataFrame:
    return df.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))


def query(documents: DataFrame) -> DataFrame:
    return take(documents).select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )
