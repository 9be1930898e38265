"""Vectors of whole numbers: reading them from Arrow batches, exact sums over all tasks.

Components become floor(scale * x).  A row of moderate components is held in 64-bit integers; a row
with a component too wide for exact 64-bit distances is held in Python integers, so that every
finite vector has exact results.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components below this keep squared distances of up to 64 dimensions within 63 bits.
NARROW = 1 << 27
#: Exact sums travel as limbs of so many bits, each well within a 64-bit sum over all tasks.
LIMB = 40
MOST = (1 << 63) - 1


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole(vectors: np.ndarray, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x)): the narrow rows as 64-bit integers, the wide ones as Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
        narrow = (np.abs(scaled) < narrow_limit(vectors.shape[1])).all(axis=1)
    found = [(np.flatnonzero(narrow), scaled[narrow].astype(np.int64))]
    if not narrow.all():
        at = np.flatnonzero(~narrow)
        values = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in vectors[at].ravel().tolist()]
        exact = np.empty(len(values), dtype=object)
        exact[:] = values
        found.append((at, exact.reshape(len(at), -1)))
    return [part for part in found if len(part[0])]


def narrow_limit(width: int) -> int:
    """Components below it keep squared distances of ``width`` dimensions within 63 bits."""
    return max(1, math.isqrt(NARROW * NARROW * 64 // max(1, width)))


def alike(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python integers if one of them is."""
    if x.dtype == table.dtype:
        return x, table
    return x.astype(object), table.astype(object)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


def fitted(values: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit ones; what is beyond becomes the largest that fits."""
    return np.array([min(int(v), MOST) for v in values], dtype=np.int64) if values.dtype == object else values


class Sums:
    """Exact sums and counts of vectors by (part, entry), merged over batches of a task."""

    def __init__(self, parts: int, entries: int, width: int):
        self.counts = np.zeros((parts, entries), dtype=np.int64)
        self.narrow = np.zeros((parts, entries, width), dtype=np.int64)
        self.wide: dict[tuple[int, int], np.ndarray] = {}

    def add(self, part: int, entry: np.ndarray, vectors: np.ndarray) -> None:
        self.counts[part] += np.bincount(entry, minlength=self.counts.shape[1])
        if vectors.dtype == object:
            for e, v in zip(entry.tolist(), vectors):
                self.wide[part, e] = self.wide[part, e] + v if (part, e) in self.wide else v
        elif len(entry):
            order = np.argsort(entry, kind="stable")
            first = np.flatnonzero(np.diff(entry[order], prepend=-1))
            self.narrow[part][entry[order[first]]] += np.add.reduceat(vectors[order], first, axis=0)

    def rows(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(part, entry, position, limb, total); position -1 has the count."""
        for part, entry in np.argwhere(self.counts).tolist():
            yield part, entry, -1, 0, int(self.counts[part, entry])
            total = self.narrow[part, entry].astype(object)
            if (part, entry) in self.wide:
                total = total + self.wide[part, entry]
            for position, value in enumerate(total):
                limb = 0
                while True:
                    high = value >> LIMB
                    last = high in (0, -1) or abs(value) < 1 << LIMB
                    low = value if last else value - (high << LIMB)
                    if low:
                        yield part, entry, position, limb, low
                    if last:
                        break
                    value, limb = high, limb + 1


def gathered(df: DataFrame, add: Callable[[pa.RecordBatch, Sums], None], parts: int, entries: int, width: int) -> tuple[dict, dict]:
    """Counts and exact sums over all tasks: {(part, entry): count}, {(part, entry): [total, ...]}.

    ``add`` puts a batch of ``df`` into a task's sums.  The driver receives at most
    parts x entries x (width + 1) sums, in a few limbs each, at any number of rows.
    """

    def run(batches):
        sums = Sums(parts, entries, width)
        for batch in batches:
            add(batch, sums)
        rows = list(sums.rows())
        if rows:
            columns = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            names = ["part", "entry", "position", "limb", "total"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = df.mapInArrow(run, "part int, entry int, position int, limb int, total long")
    counts: dict[tuple[int, int], int] = {}
    totals: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0] * width)
    for part, entry, position, limb, total in (
        found.groupBy("part", "entry", "position", "limb").agg(F.sum("total")).collect()
    ):
        if position < 0:
            counts[part, entry] = total
        else:
            totals[part, entry][position] += total << (LIMB * limb)
    return counts, totals


def table_of(entries: list[list[int]], width: int, of: int | None = None) -> np.ndarray:
    """Entries as a matrix: of 64-bit integers if all are narrow (for vectors of ``of`` components,
    of which entries hold ``width``), else of Python integers."""
    limit = narrow_limit(of or width)
    fits = all(abs(v) < limit for entry in entries for v in entry)
    table = np.empty((len(entries), width), dtype=np.int64 if fits else object)
    for i, entry in enumerate(entries):
        table[i] = entry
    return table
