"""Shared plumbing: reading tables, scratch tables in the shared folder, Arrow batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that separate words in every contract of this subpackage.
WORD_SPACE = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a local one is made only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/weftline-scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed at the end of the enclosing ``scratch_scope``,
    or else when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    store, hadoop = _store(spark, path)
    store.deleteOnExit(hadoop)
    for made in _SCOPES[-1:]:
        made.append(path)
    return path


#: The paths made within each open ``scratch_scope``.
_SCOPES: list[list[str]] = []


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes what was written to scratch paths inside, for work whose result is written outside."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes the files at ``path``, which nothing reads any more."""
    store, hadoop = _store(spark, path)
    store.delete(hadoop, True)


def saved(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")).cast("binary")


def append_columns(
    df: DataFrame,
    inputs: Sequence[Column],
    fields: Sequence[tuple[str, T.DataType]],
    start: Callable[[], Callable[..., Sequence]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with ``fields`` appended, computed batch by batch from ``inputs`` as Python lists.

    ``start`` runs once in each task and returns the function of one batch, which gives a list or
    an Arrow array for each field.  Columns of ``df``
    that clash with a new field are replaced.  ``keep`` names the columns to carry along (all).
    """
    names = {name.lower() for name, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    kept = df.select(
        *[F.col(f"`{c}`") for c in keep],
        *[c.alias(f"__input_{i}") for i, c in enumerate(inputs)],
    )
    schema = T.StructType(
        [*kept.schema.fields[: len(keep)], *[T.StructField(n, t, True) for n, t in fields]]
    )
    n_keep = len(keep)
    types = [_arrow_type(t) for _, t in fields]
    out_names = [*keep, *[n for n, _ in fields]]

    def run(batches):
        work = None
        for batch in batches:
            if work is None:
                work = start()
            found = work(*[batch.column(i).to_pylist() for i in range(n_keep, batch.num_columns)])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(n_keep)],
                    *[v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(found, types, strict=True)],
                ],
                names=out_names,
            )

    return kept.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {
        "long": pa.int64(),
        "integer": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "string": pa.string(),
        "binary": pa.binary(),
    }[kind.typeName()]


#: Bytes of one generation of a chunk cache in a Python worker, and the longest key that is kept.
CACHE_BYTES = 40 << 20
LONGEST_KEY = 256
#: What an entry takes besides its key and value: headers of both and the table's slot.
ENTRY_BYTES = 220


class Memo(dict):
    """A cache of two generations, bounded in bytes: ``memo[key]`` computes what is missing.

    Keys are str or bytes.  When the new generation holds ``limit`` bytes, it becomes the old one
    and the former old one goes; an old entry that is asked for again moves to the new one.  Keys
    beyond LONGEST_KEY characters are worked out each time.  ``weigh`` gives the bytes of a value.
    """

    def __init__(self, compute: Callable, limit: int = CACHE_BYTES, weigh: Callable | None = None):
        super().__init__()
        self.compute, self.limit, self.weigh, self.old = compute, limit, weigh, {}
        self.held = 0

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if self.held >= self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += len(key) + ENTRY_BYTES + (self.weigh(value) if self.weigh else 0)
        return value


#: Rows of the right side below which ``join_counted`` broadcasts all of it, and the most keys that
#: can each hold over one in so many rows of the left side.
SMALL_SIDE = 10_000
HOT_KEYS = 1_000


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Null-safe inner join of ``left`` to ``right``, which has each ``key`` once and in ``rows``
    (dropped) how many rows of ``left`` have it.

    A right side of at most SMALL_SIDE rows is broadcast.  Otherwise the keys with over one in
    HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are broadcast, so that their rows
    stay spread, and the others meet in a shuffle.
    """
    total, count = right.agg(F.sum(rows), F.count(F.lit(1))).first()
    plain = right.drop(rows)
    if count <= SMALL_SIDE:
        return _null_safe(left, F.broadcast(plain), key)
    hot = F.col(rows) > F.lit((total or 0) / HOT_KEYS)
    warm = F.broadcast(right.where(hot).select(F.col(key).alias("__hot"), F.lit(True).alias("__is_hot")))
    marked = left.join(warm, left[key].eqNullSafe(warm["__hot"]), "left").drop("__hot")
    spread = marked.where("__is_hot").drop("__is_hot")
    rest = marked.where(F.col("__is_hot").isNull()).drop("__is_hot")
    return _null_safe(spread, F.broadcast(right.where(hot).drop(rows)), key).unionByName(
        _null_safe(rest, right.where(~hot).drop(rows), key)
    )


def _null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    right = right.withColumnRenamed(key, "__key")
    return left.join(right, left[key].eqNullSafe(right["__key"])).drop("__key")
