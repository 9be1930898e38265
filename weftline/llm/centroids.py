"""Centroid clustering of whole-number vectors, exact at the speed of float32 products.

A batch of vectors is multiplied with all centroids in float32.  Every score has an interval that
the true value cannot leave: the rounding of a sum of n products is at most gamma(n) times the sum
of their sizes, which the two lengths bound (Cauchy-Schwarz).  A centroid whose interval starts
above the end of another one is out.  Where one is left it is the nearest; the others, whose
intervals overlap, are compared by exact squared distances, the smaller number first at a tie.

A round is one pass over the vectors; tasks send exact sums by centroid, and the driver holds the
centroids only, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved
from weftline.llm.whole_vectors import MOST, alike, fitted, gathered, is_finite, matrix, squared, table_of, whole

#: Vectors screened at once; wide ones take Python integers, fewer at a time.
ROWS, WIDE_ROWS = 16_384, 64
#: Unit roundoffs of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53


def gamma(n: int, u: float) -> float:
    return n * u / (1 - n * u)


def screened(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest (rows by centroids), by float32 products and their intervals.

    For 64-bit integers whose squared distances fit 63 bits.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (x.astype(np.float32) @ centroids.T.astype(np.float32)).astype(np.float64)
    # Squared lengths are exact integers of 63 bits; as floats they are off by one part in 2^53.
    length = np.sqrt((x * x).sum(axis=1).astype(np.float64)) * (1 + 4 * U64)
    squares = (centroids * centroids).sum(axis=1).astype(np.float64)
    reach = np.sqrt(squares) * (1 + 4 * U64)
    # Two conversions to float32 and n products and sums in any order.
    off = 2 * gamma(x.shape[1] + 4, U32) * length[:, None] * reach[None, :]
    score = squares[None, :] - 2 * dots
    off = off + 8 * U64 * (squares[None, :] + 2 * np.abs(dots) + off)
    return score - off <= (score + off).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and the exact squared distance to it."""
    x, centroids = alike(x, centroids)
    numbers, distances = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
    step = WIDE_ROWS if x.dtype == object else ROWS
    for a in range(0, len(x), step):
        some = x[a : a + step]
        if x.dtype == object:
            maybe = np.ones((len(some), len(centroids)), dtype=bool)
        else:
            maybe = screened(some, centroids)
        number = maybe.argmax(axis=1)
        open_ = np.flatnonzero(maybe.sum(axis=1) > 1)
        if len(open_):
            row, other = np.nonzero(maybe[open_])
            exact = squared(some[open_[row]], centroids[other])
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[row])
            # Pairs stand in the order of numbers, so the first hit of a row has the smallest.
            number[open_] = other[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
        numbers[a : a + step] = number
        distances[a : a + step] = squared(some, centroids[number])
    return numbers, distances


def assigned(rows: DataFrame, centroids: np.ndarray, width: int, scale: int) -> DataFrame:
    """``rows`` (columns, then x) with cluster and distance in place of x."""
    keep = rows.columns[:-1]
    schema = rows.select(*keep).schema.add("cluster", "integer").add("distance", "long")

    def run(batches):
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, x in whole(matrix(batch.column(len(keep)), width), scale):
                found, away = nearest(x, centroids)
                cluster[at], distance[at] = found, fitted(away)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(cluster), pa.array(distance)], names=[*keep, "cluster", "distance"]
            )

    return rows.mapInArrow(run, schema)


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
    width: int = 64, scale: int = 256, seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector that takes part, and the final centroids.

    Vectors with exactly ``width`` components, none null or non-finite, take part, each as
    floor(``scale`` * x); all other rows have no row in the result.  The first centroids are the
    vectors whose key has the smallest SHA-256 of "seed:key"; a null key comes after all others,
    equal keys go by their vectors, and repeated rows are vectors of their own.  With fewer than
    ``k`` vectors there are as many centroids.  In each round every vector goes to the nearest
    centroid (ties: the smaller number), and a centroid moves to the exact floor of its vectors'
    mean; one without vectors stays.  A squared distance beyond 64 bits is given as the largest
    that fits.  Other columns are ignored.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").alias(key), x.alias("x")).where(is_finite(F.col("x")) & (F.size("x") == width))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256)
    starts = rows.orderBy(drawn.asc_nulls_last(), "x").limit(k).select("x").collect()
    if not starts:
        return rows.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), table_of([], width)
    first = np.array([r["x"] for r in starts], dtype=np.float64)
    entries: list[list[int]] = [[]] * len(first)
    for at, found in whole(first, scale):
        for i, entry in zip(at.tolist(), found.tolist()):
            entries[i] = entry
    for _ in range(rounds):
        centroids = table_of(entries, width)

        def add(batch, sums, centroids=centroids):
            for _, x in whole(matrix(batch.column(0), width), scale):
                sums.add(0, nearest(x, centroids)[0], x)

        counts, totals = gathered(rows.select("x"), add, 1, len(entries), width)
        entries = [
            [t // counts[0, e] for t in totals[0, e]] if (0, e) in counts else entry for e, entry in enumerate(entries)
        ]
    final = table_of(entries, width)
    return assigned(rows, final, width, scale), final


def query(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(embeddings)
    found = saved(found, "clusters")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("own")).collect()
    own = {r["cluster"]: int(r["own"]) for r in by_cluster}
    total = min(sum(own.values()), MOST)
    rows = [
        (i, min(own[i], MOST), hashlib.sha256(",".join(str(v) for v in c.tolist()).encode()).hexdigest())
        for i, c in enumerate(centroids)
        if i in own
    ]
    # At most k rows.
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(total).cast("long").alias("inertia"), "centroid_sha256",
    )


def _round(before: str, after: str) -> str:
    """SQL of one round: assigns the vectors v to the centroids ``before`` and moves these."""
    return f"""
near_{after} AS MATERIALIZED (
  SELECT v.n, arg_min(c.c, (list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c)) AS c,
         min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
  FROM v, {before} c GROUP BY v.n
), moved_{after} AS MATERIALIZED (
  SELECT c, list(m ORDER BY pos) AS x FROM (
    SELECT c, pos, sum(e) // count(*) - CASE WHEN sum(e) % count(*) < 0 THEN 1 ELSE 0 END AS m
    FROM (SELECT a.c, unnest(v.x) AS e, unnest(range(64)) AS pos FROM near_{after} a JOIN v USING (n)) GROUP BY c, pos
  ) GROUP BY c
), {after} AS MATERIALIZED (
  SELECT b.c, coalesce(m.x, b.x) AS x FROM {before} b LEFT JOIN moved_{after} m USING (c)
)"""


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
         list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x
  FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 40)
), {", ".join(_round(f"c{i}", f"c{i + 1}") for i in range(6))}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM near_c6 a JOIN v USING (n) JOIN c5 ON c5.c = a.c
"""
