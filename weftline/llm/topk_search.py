"""Exact top-k search by inner product with KD-trees over spatial shards.

The space is split at medians of a bounded sample, one dimension after the other, into at most
LEAVES cells; a cell's rows are a shard, or several where there are many.  Every cell's tight box
over all of its rows goes into a routing table.  Queries run in two waves: first each visits the
cell whose box allows the largest inner product, which gives a good k-th score; then it visits the
cells whose bound still reaches that score, and no others.  A shard's task builds a tree of median
splits with tight boxes and visits its nodes best first; a node is opened only while its bound beats
the k-th score known so far (at equal score, while it may hold a smaller identifier).

A shard's candidates and the queries that visit it meet in one shuffle, candidates first, so that a
task reads its candidates once, builds the tree and lets the queries stream past.  A shard that
many queries visit is given to several tasks.

Scores are exact.  Rows whose squared length is below 2^52 have products that 64-bit floats hold
exactly; all other rows take Python integers.  Bounds have an outward margin.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import saved

#: Candidates of one shard (the tree of one task) and of a tree's leaf; queries held against a tree at once.
SHARD = 8192
LEAF = 256
QUERIES = 512
#: Queries of one task of a shard.
VISITS = 1 << 16
#: Rows and bytes of the sample that places the splits, and cells and bytes of the routing table.
SAMPLE, SAMPLE_BYTES = 1 << 14, 16 << 20
LEAVES, ROUTE_BYTES = 2048, 16 << 20
SCALE = 1024
#: Squared lengths below this have exact products in 64-bit floats.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite floats: as floats where all rows are short enough, else as
    Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
        if (np.einsum("ij,ij->i", scaled, scaled) < EXACT).all():
            return scaled
    whole = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    out = np.empty(len(whole), dtype=object)
    out[:] = whole
    return out.reshape(vectors.shape)


def alike(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as Python integers if one of them is."""
    if not any(a.dtype == object for a in arrays):
        return list(arrays)
    return [a if a.dtype == object else np.vectorize(int, otypes=[object])(a) for a in arrays]


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At least the largest inner product that each box allows, queries by boxes."""
    queries, low, high = alike(queries, low, high)
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)
    found = above @ high.T + below @ low.T
    if found.dtype == object:
        return found
    # Corners of boxes can leave the exact range; the margin covers what rounding takes.
    return found + np.abs(found).max(axis=1, keepdims=True, initial=0.0) * 1e-15 * (queries.shape[1] + 2)


class KdTree:
    """Median splits with tight boxes over integer vectors; leaves hold rows in identifier order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.first, self.last = [], [], [], []
        self.child: list[tuple[int, int] | None] = []
        order = np.argsort(ids, kind="stable")
        self._vectors, self._order = vectors, []
        self._grow(order, leaf, 0)
        order = np.concatenate(self._order)
        self.ids, self.vectors = ids[order], vectors[order]
        self.least_id = [int(self.ids[a:b].min()) for a, b in zip(self.first, self.last)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, leaf: int, at: int) -> int:
        part = self._vectors[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        me = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.first.append(at)
        self.last.append(at + len(rows))
        self.child.append(None)
        wide = int(np.argmax(high - low))
        if len(rows) <= leaf or high[wide] == low[wide]:
            self._order.append(rows)
            return me
        half = len(rows) // 2
        split = np.argsort(part[:, wide], kind="stable")
        left, right = np.sort(split[:half]), np.sort(split[half:])
        a = self._grow(rows[left], leaf, at)
        b = self._grow(rows[right], leaf, at + half)
        self.child[me] = (a, b)
        return me

    def search(self, query_id, query: np.ndarray, bounds: np.ndarray, k: int, kth) -> list[tuple[int, int]]:
        """At most ``k`` (score, id), best first, among those that score ``kth`` at least."""
        best: list[tuple[int, int]] = []  # a heap with the worst in front: (score, -id)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            bound = -bound
            if bound < kth:
                break
            if len(best) == k and (bound, -self.least_id[node]) <= best[0]:
                continue
            if self.child[node] is not None:
                for child in self.child[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.first[node], self.last[node]
            scores = self.vectors[a:b] @ query
            for i in np.flatnonzero(scores >= kth):
                score, other = int(scores[i]), int(self.ids[a + i])
                if other == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -other))
                elif (score, -other) > best[0]:
                    heapq.heapreplace(best, (score, -other))
                if len(best) == k and best[0][0] > kth:
                    kth = best[0][0]
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x array<double>) of the rows whose vector is whole and finite."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & fine
    )


class Cells:
    """The top splits for vectors of one length: a vector's cell by a walk from the first split."""

    def __init__(self, sample: np.ndarray, cells: int, first: int):
        self.first, self.cells = first, 0
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, the two sides
        self.root = self._split(sample, cells)

    def _split(self, sample: np.ndarray, cells: int) -> int:
        """The number of a split, or of a cell as its complement."""
        if cells > 1 and len(sample) > 1:
            low, high = sample.min(axis=0), sample.max(axis=0)
            wide = int(np.argmax(high / 2 - low / 2))
            value = float(np.sort(sample[:, wide])[len(sample) // 2])
            left = sample[:, wide] < value
            if left.any():
                me = len(self.splits)
                self.splits.append((wide, value, 0, 0))
                a = self._split(sample[left], cells // 2)
                b = self._split(sample[~left], cells - cells // 2)
                self.splits[me] = (wide, value, a, b)
                return me
        self.cells += 1
        return -self.cells

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector, numbered from ``first`` on."""
        at = np.full(len(vectors), self.root)
        while (open_ := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[open_]):
                wide, value, a, b = self.splits[node]
                here = open_[at[open_] == node]
                at[here] = np.where(vectors[here, wide] < value, a, b)
        return self.first - 1 - at


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_width(batch: pa.RecordBatch, column: int):
    """(width, rows) of a batch's vectors, one for each length."""
    widths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        if width:
            yield int(width), np.flatnonzero(widths == width)


def split_space(rows: DataFrame, shard: int) -> dict[int, Cells]:
    """Top splits for every length of vectors in a bounded sample of ``rows`` (id, x)."""
    count, widest = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not widest:
        return {}
    take = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))
    drawn = rows.select("x").sample(fraction=min(1.0, take / count), seed=1).limit(2 * take).toArrow()
    vectors = {w: [] for w in set(drawn.column(0).combine_chunks().value_lengths().to_pylist())}
    for batch in drawn.to_batches():
        for width, at in _by_width(batch, 0):
            vectors[width].append(_matrix(batch.column(0).take(pa.array(at)), width))
    most = max(1, min(LEAVES, ROUTE_BYTES // (16 * widest)))
    found, first = {}, 0
    for width in sorted(vectors):
        sample = np.concatenate(vectors[width])
        share = len(sample) / len(drawn)
        cells = max(1, min(math.ceil(count * share / shard), int(most * share), len(sample) // 8))
        found[width] = Cells(sample, cells, first)
        first += found[width].cells
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), id, score: the ``k`` best candidates of every query.

    ``vectors`` has id and x (array of double, as from ``whole_vectors``), of which floor(scale * x)
    is scored; ``is_query`` picks the queries by id.  Candidates of a query are all rows with
    another id and as many components, repeated rows one by one; rows of one id that are queries
    share one list of ranks.  Ties go to the smaller id.  Without candidates a query has no row.
    Scores are ranked as whole numbers of any size; one beyond 64 bits is returned as the nearest
    number that fits.
    """
    spark = vectors.sparkSession
    rows = saved(vectors.where(F.size("x") > 0), "vectors")
    spaces = split_space(rows, shard)

    def place(batches):
        for batch in batches:
            # A length that the sample missed has a cell of its own, below 0.
            cell = -batch.column(1).value_lengths().to_numpy().astype(np.int64)
            for width, at in _by_width(batch, 1):
                if width in spaces:
                    cell[at] = spaces[width].place(_matrix(batch.column(1).take(pa.array(at)), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "x", "cell"])

    placed = saved(rows.mapInArrow(place, "id long, x array<double>, cell long"), "placed")

    def boxes(batches):
        """Box and number of rows of each cell in a task; cells are many only where rows are."""
        seen: dict[int, list] = {}
        for batch in batches:
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells):
                v = batch.column(1).take(pa.array(np.flatnonzero(cells == cell)))
                v = _matrix(v, len(v[0]))
                low, high, n = v.min(axis=0), v.max(axis=0), len(v)
                if cell in seen:
                    low, high, n = np.minimum(low, seen[cell][0]), np.maximum(high, seen[cell][1]), n + seen[cell][2]
                seen[int(cell)] = [low, high, n]
        names = ["cell", "low", "high", "rows"]
        columns = [list(seen), *[[v[i] for v in seen.values()] for i in range(3)]]
        types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def joined(pdf):
        low, high = np.stack(pdf["low"].to_list()).min(axis=0), np.stack(pdf["high"].to_list()).max(axis=0)
        return pdf.iloc[:1].assign(low=[low], high=[high], rows=pdf["rows"].sum())

    schema = "cell long, low array<double>, high array<double>, rows long"
    # One row for each cell: at most LEAVES and one for each length beyond the sample.
    table = placed.mapInArrow(boxes, schema).groupBy("cell").applyInPandas(joined, schema).collect()
    routes: dict[int, tuple] = {}
    for width in sorted({len(r["low"]) for r in table}):
        own = sorted((r for r in table if len(r["low"]) == width), key=lambda r: r["cell"])
        low, high = np.array([r["low"] for r in own]), np.array([r["high"] for r in own])
        routes[width] = (np.array([r["cell"] for r in own]), integers(low, scale), integers(high, scale))
    shards = {r["cell"]: -(-r["rows"] // shard) for r in table}
    route = spark.sparkContext.broadcast(routes)

    def visits(wave: int):
        def run(batches):
            """The cells that each query of (row, id, x, kth, home) visits; home was visited before."""
            for batch in batches:
                kth, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                out_row, out_cell = [], []
                for width, at in _by_width(batch, 2):
                    cells, low, high = route.value[width]
                    for a in range(0, len(at), QUERIES):
                        some = at[a : a + QUERIES]
                        q = integers(_matrix(batch.column(2).take(pa.array(some)), width), scale)
                        allowed = bounds(q, low, high)
                        if wave == 1:
                            out_row.append(some)
                            out_cell.append(cells[np.argmax(allowed, axis=1)])
                        else:
                            i, j = np.nonzero((allowed >= kth[some, None]) & (cells[None, :] != home[some, None]))
                            out_row.append(some[i])
                            out_cell.append(cells[j])
                take = np.concatenate(out_row) if out_row else np.zeros(0, np.int64)
                cell = np.concatenate(out_cell) if out_cell else np.zeros(0, np.int64)
                for a in range(0, len(take), 4 * QUERIES):  # vectors are repeated a few at a time
                    some = batch.take(pa.array(take[a : a + 4 * QUERIES]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[a : a + 4 * QUERIES]), *some.columns[:4]], names=["cell", "row", "id", "x", "kth"]
                    )

        return run

    def visit(batches):
        """Candidates (kind 0), then queries (kind 1), shard by shard, to hits."""
        name, kept, tree, trees = None, [], None, {}

        def hits(part):
            nonlocal tree, trees
            if tree is None:
                ids = np.concatenate([i for i, _ in kept]) if kept else np.zeros(0, np.int64)
                floats = np.concatenate([v for _, v in kept]) if kept else None
                tree, trees = (ids, floats), {}
                kept.clear()
            ids, floats = tree
            out = []
            if floats is not None:
                width = floats.shape[1]
                for a in range(0, part.num_rows, QUERIES):
                    some = part.slice(a, QUERIES)
                    q = integers(_matrix(some.column(6), width), scale)
                    kind = "whole" if q.dtype == object or "whole" in trees else "plain"
                    if kind not in trees:
                        found = integers(floats, scale)
                        kind = "whole" if found.dtype == object else kind
                        trees[kind] = KdTree(ids, alike(found, q)[0])
                    tree_ = trees[kind]
                    q = alike(q, tree_.vectors)[0]
                    allowed = bounds(q, tree_.low, tree_.high)
                    columns = [some.column(i).to_pylist() for i in (4, 5, 7)]
                    for row, i, kth, v, b in zip(*columns, q, allowed):
                        out += [(row, i, other, score) for score, other in tree_.search(i, v, b, k, kth)]
            wide = [None if LEAST <= s <= MOST else str(s) for _, _, _, s in out]
            columns = list(zip(*out)) if out else ([], [], [], [])
            narrow = [min(max(s, LEAST), MOST) for s in columns[3]]
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in (*columns[:3], narrow)], pa.array(wide, pa.string())],
                names=["row", "query_id", "id", "score", "whole"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(a, b - a)
                now, kind = tuple(keys[:3, a]), keys[3, a]
                if now != name:
                    name, tree, trees = now, None, {}
                    kept.clear()
                if kind == 0:
                    kept.append((part.column(5).to_numpy(), _matrix(part.column(6), len(part.column(6)[0]))))
                else:
                    yield hits(part)

    spread = spark.createDataFrame([(c, n) for c, n in shards.items()] or [(0, 0)], "cell long, shards long")

    def wave(queries: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """What the visits of a wave find, and the visits."""
        visiting = saved(
            queries.mapInArrow(visits(number), "cell long, row long, id long, x array<double>, kth double"), "visits"
        )
        tasks = F.ceil(F.count(F.lit(1)) / VISITS).cast("long")
        # One row for each cell, as in the routing table.
        met = F.broadcast(visiting.groupBy("cell").agg(tasks.alias("tasks")).join(F.broadcast(spread), "cell"))
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        asked = visiting.join(met, "cell").select(
            "cell",
            F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"),
            F.pmod(F.xxhash64("row"), F.col("tasks")).alias("task"),
            one.alias("kind"), "row", "id", "x", "kth",
        )
        searched = placed.join(met, "cell").select(
            "cell",
            F.pmod(F.xxhash64("id", "x", F.monotonically_increasing_id()), F.col("shards")).alias("shard"),
            F.explode(F.sequence(zero, F.col("tasks") - 1)).alias("task"),
            zero.alias("kind"), zero.alias("row"), "id", "x", F.lit(0.0).alias("kth"),
        )
        together = searched.unionByName(asked).repartition("cell", "shard", "task")
        together = together.sortWithinPartitions("cell", "shard", "task", "kind")
        found = together.mapInArrow(visit, "row long, query_id long, id long, score long, whole string")
        return saved(found, "hits"), visiting

    # Scores beyond 64 bits go by sign, length and digits.
    sign = F.when(F.col("whole").isNull(), F.lit(0)).when(F.col("whole").startswith("-"), F.lit(-1)).otherwise(1)
    best = [
        sign.desc(), (sign * F.coalesce(F.length("whole"), F.lit(0))).desc(), F.when(sign == 1, F.col("whole")).desc_nulls_last(),
        F.when(sign == -1, F.col("whole")).asc_nulls_last(), F.col("score").desc(), F.col("id").asc(),
    ]

    queries = saved(
        placed.where(is_query).select(
            F.monotonically_increasing_id().alias("row"), "id", "x", F.lit(float("-inf")).alias("kth"), F.lit(0).cast("long").alias("home"),
        ),
        "queries",
    )
    first, home = wave(queries, 1)
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(*best))).where(F.col("place") == k)
    # A step below the exact score, so that rounding never closes a cell.
    score = F.coalesce(F.col("whole").cast("double"), F.col("score").cast("double"))
    score = F.when(F.abs(score) < 1e300, score - F.abs(score) * 1e-15).otherwise(float("-inf"))
    known = ranked.select("row", score.alias("kth"))
    again = queries.drop("kth", "home").join(home.select("row", F.col("cell").alias("home")), "row").join(known, "row", "left")
    again = again.select("row", "id", "x", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), "home")
    found = first.unionByName(wave(again, 2)[0])
    ranks = Window.partitionBy("query_id").orderBy(*best)
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score"
    )


def query(embeddings: DataFrame) -> DataFrame:
    found = top_k(whole_vectors(embeddings, "vec_id", "embedding"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
