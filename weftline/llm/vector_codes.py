"""Vector code compression: a codebook for each part of the vectors, encoded by partial distances.

The nearest entry of a codebook is found dimension by dimension, those of the largest codebook
variance first.  Every entry accumulates its integer distance; after a few dimensions the entry
that is least so far gets its complete distance, and from then on a mask drops, after each
dimension, all entries whose accumulated distance strictly exceeds the best complete one.
Accumulated distances only grow, so no entry that could be nearest, or tie, is dropped.

A round of fitting is one pass over the vectors; tasks send exact sums by entry, and the driver
holds the codebooks only, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import join_counted, saved
from weftline.llm.whole_vectors import alike, fitted, gathered, is_finite, matrix, squared, table_of, whole

#: Vectors searched at once; wide ones take Python integers, fewer at a time.
ROWS, WIDE_ROWS = 1024, 16
#: Share of the dimensions that all entries accumulate before a first complete distance.
HEAD = 0.25


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` (ties: the lowest) and the exact squared distance."""
    x, book = alike(x, book)
    variance = book.astype(np.float64).var(axis=0) if book.dtype != object else np.array([_spread(c) for c in book.T])
    order = np.argsort(-variance, kind="stable")
    book = book[:, order]
    numbers, distances = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
    step = WIDE_ROWS if x.dtype == object else ROWS
    for a in range(0, len(x), step):
        numbers[a : a + step], distances[a : a + step] = _search(x[a : a + step, order], book)
    return numbers, distances


def _spread(column: np.ndarray) -> float:
    """Variance of Python integers of any size, up to rounding; it only sets the order."""
    values = [int(v) for v in column]
    n, total = len(values), sum(values)
    spread = sum((n * v - total) ** 2 for v in values) // n**3
    return float(min(spread, 10**300))


def _search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = book.shape[1]
    head = min(width, max(1, round(width * HEAD)))
    so_far = np.zeros((len(x), len(book)), dtype=x.dtype)
    for d in range(head):
        gap = x[:, d, None] - book[None, :, d]
        so_far += gap * gap
    best = squared(x, book[so_far.argmin(axis=1)])
    row, entry = np.nonzero(so_far <= best[:, None])
    part = so_far[row, entry]
    for d in range(head, width):
        gap = x[row, d] - book[entry, d]
        part = part + gap * gap
        stays = part <= best[row]
        row, entry, part = row[stays], entry[stays], part[stays]
        if d == (head + width) // 2 and d + 1 < width:
            # Halfway, what is least now is likely the nearest: its complete distance drops more.
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(part, first)
            hit = np.flatnonzero(part == least[row])
            guess = entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
            best = np.minimum(best, squared(x, book[guess]))
            stays = part <= best[row]
            row, entry, part = row[stays], entry[stays], part[stays]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(part, first)
    hit = np.flatnonzero(part == least[row])
    # Pairs stand in the order of entries, so the first hit of a row has the lowest index.
    return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], least


class Codebooks:
    """``tables[part]`` holds the entries of a part position."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.parts, self.width = len(tables), tables[0].shape[1]

    def digest(self) -> str:
        """SHA-256 of all components as decimals by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for t in self.tables for v in t.ravel().tolist()).encode()).hexdigest()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (rows by parts) and squared error of each row."""
        codes = np.zeros((len(x), self.parts), dtype=np.int64)
        errors = np.zeros(len(x), dtype=np.int64)
        for part, book in enumerate(self.tables):
            codes[:, part], away = nearest(x[:, part * self.width : (part + 1) * self.width], book)
            errors = errors + away
        return codes, errors

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of indexes stand for."""
        return np.concatenate([t[codes[:, part]] for part, t in enumerate(self.tables)], axis=1)


def usual_width(df: DataFrame, parts: int) -> int:
    """The most frequent length that ``parts`` divides (ties: the longest); 0 without any."""
    found = (
        df.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
        .where((F.col("n") > 0) & (F.col("n") % parts == 0))
        .orderBy(F.desc("rows"), F.desc("n")).first()
    )
    return found["n"] if found else 0


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = 4,
    entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> tuple[DataFrame, Codebooks | None]:
    """(key, ``keep``, code, error) of every vector that takes part, and the codebooks.

    Vectors that are there, have finite components only and the usual length (the most frequent one
    that ``parts`` divides) take part, each as floor(``scale`` * x); all other rows have no row in
    the result.  A part's codebook starts with the vectors of the smallest keys: a null key comes
    after all others, equal keys go by their vectors, and repeated rows count one by one.  With
    fewer vectors than ``entries`` there are as many entries; without any the codebooks are None.
    Each round moves every entry to the exact floor of the mean of the parts nearest to it (ties:
    the lower index); an unused one stays.  ``code`` has two hexadecimal digits for each part,
    ``error`` is the exact squared distance to what the code stands for; one beyond 64 bits is
    given as the largest that fits.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    columns = [F.col(f"`{c}`").alias(c) for c in (key, *keep)]
    rows = df.select(*columns, x.alias("x")).where(is_finite(F.col("x")))
    width = usual_width(rows, parts)
    rows = rows.where(F.size("x") == width)
    starts = rows.orderBy(F.col(f"`{key}`").asc_nulls_last(), "x").limit(entries).select("x").collect() if width else []
    schema = rows.drop("x").schema.add("code", "string").add("error", "long")
    if not starts:
        return rows.sparkSession.createDataFrame([], schema), None
    part_width = width // parts
    vectors: list[list[int]] = [[]] * len(starts)
    for at, found in whole(np.array([r["x"] for r in starts], dtype=np.float64), scale):
        for i, entry in zip(at.tolist(), found.tolist()):
            vectors[i] = entry
    books = [[v[p * part_width : (p + 1) * part_width] for v in vectors] for p in range(parts)]
    for _ in range(rounds):
        made = Codebooks([table_of(b, part_width, width) for b in books])

        def add(batch, sums, made=made):
            for _, x in whole(matrix(batch.column(0), width), scale):
                codes, _ = made.encode(x)
                for p in range(parts):
                    sums.add(p, codes[:, p], x[:, p * part_width : (p + 1) * part_width])

        counts, totals = gathered(rows.select("x"), add, parts, len(vectors), part_width)
        books = [
            [[t // counts[p, e] for t in totals[p, e]] if (p, e) in counts else entry for e, entry in enumerate(book)]
            for p, book in enumerate(books)
        ]
    final = Codebooks([table_of(b, part_width, width) for b in books])
    n_keep = len(columns)

    def run(batches):
        for batch in batches:
            code, error = np.empty(batch.num_rows, dtype=object), np.zeros(batch.num_rows, np.int64)
            for at, x in whole(matrix(batch.column(n_keep), width), scale):
                codes, errors = final.encode(x)
                code[at] = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                error[at] = fitted(errors)
            made = [*batch.columns[:n_keep], pa.array(code, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return rows.mapInArrow(run, schema), final


def query(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    found, books = compress(embeddings, keep=("label",))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    found = saved(found, "codes")
    total = F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = saved(
        found.groupBy("label").agg(F.least(total, most).cast("long").alias("label_error"), F.count(F.lit(1)).alias("rows")),
        "label-errors",
    )
    return join_counted(found, by_label, "label", "rows").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _round(before: str, after: str) -> str:
    """SQL of one round: assigns the parts v to the entries ``before`` and moves these."""
    return f"""
near_{after} AS MATERIALIZED (
  SELECT v.n, v.p, arg_min(b.e, (list_sum(list_transform(list_zip(v.x, b.x), lambda g: (g[1] - g[2]) * (g[1] - g[2]))), b.e)) AS e,
         min(list_sum(list_transform(list_zip(v.x, b.x), lambda g: (g[1] - g[2]) * (g[1] - g[2])))) AS d
  FROM v JOIN {before} b USING (p) GROUP BY v.n, v.p
), moved_{after} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY pos) AS x FROM (
    SELECT p, e, pos, sum(c) // count(*) - CASE WHEN sum(c) % count(*) < 0 THEN 1 ELSE 0 END AS m
    FROM (SELECT a.p, a.e, unnest(v.x) AS c, unnest(range(len(v.x))) AS pos FROM near_{after} a JOIN v USING (n, p))
    GROUP BY p, e, pos
  ) GROUP BY p, e
), {after} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {before} b LEFT JOIN moved_{after} m USING (p, e)
)"""


ORACLE_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label,
         list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), v AS MATERIALIZED (
  SELECT n, p, list_slice(x, p * len(x) // 4 + 1, (p + 1) * len(x) // 4) AS x
  FROM k, (SELECT unnest(range(4)) AS p)
), b0 AS MATERIALIZED (SELECT p, n - 1 AS e, x FROM v WHERE n <= 256
), {", ".join(_round(f"b{i}", f"b{i + 1}") for i in range(5))}
, coded AS (
  SELECT n, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near_b5 GROUP BY n
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4
)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN k USING (n), books
"""
