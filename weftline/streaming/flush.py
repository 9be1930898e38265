"""Method rows of scanned files as a stateful stream: rows wait by file until they are worth writing.

The state of a file holds its rows.  They leave when its scan marker comes, when there are ``most``
of them, or when the oldest has waited ``longest`` seconds, by a timer.  A file is complete with its
marker; parts of the same content that come later are dropped, parts of other content start anew.
State lies in the checkpoint: a query that starts again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from weftline.operators.ingest import FAILED, SCANNED, flush_due

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows and seconds after which a file's rows are written.
MOST, LONGEST = 10_000, 900.0
KEY = ["project", "file"]


class FileBuffer(StatefulProcessor):
    """Rows of one file; ``columns`` are those beside the key. Emits rows with why they left (reason)."""

    def __init__(self, schema: T.StructType, most: int, longest: float):
        self.schema, self.most, self.longest = schema, most, longest
        self.names = [f.name for f in schema.fields if f.name not in KEY]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = T.StructType([f for f in self.schema.fields if f.name not in KEY])
        self.rows = handle.getListState("rows", own)
        self.kept = handle.getValueState("kept", "count int, since long, timer long")
        self.done = handle.getValueState("done", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        count, since, timer = self.kept.get() if self.kept.exists() else (0, now, 0)
        done = self.done.get()[0] if self.done.exists() else None
        for frame in rows:
            # Names that start with an underscore arrive changed; the places stay.
            frame = frame.set_axis([f.name for f in self.schema.fields], axis=1)
            frame = frame.astype(object).where(frame.notna(), None)
            if done is not None:
                frame = frame[frame["hash"] != done]
                if not len(frame):
                    continue
                self.done.clear()
                done = None
            marks = frame["_flag"].isin([SCANNED, FAILED])
            # A marker ends the file whatever the order within a batch.
            if marks.any():
                done = frame.loc[marks, "hash"].iloc[-1]
            self.rows.appendList([tuple(r) for r in frame[self.names].itertuples(index=False, name=None)])
            since = now if count == 0 else since
            count += len(frame)
            if count >= self.most and done is None:
                yield from self._leave(key, "rows")
                count = 0
        if done is not None and count:
            yield from self._leave(key, "complete")
            count = 0
            self.done.update((done,))
        if count and not timer:
            timer = int(since + self.longest * 1000)
            self.handle.registerTimer(timer)
        if not count and timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if count:
            self.kept.update((count, since, timer))
        elif self.kept.exists():
            self.kept.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.kept.exists():
            return
        count, since, _ = self.kept.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        if flush_due(count, (now - since) / 1000, self.most, self.longest):
            yield from self._leave(key, "time")
        self.kept.clear()

    def _leave(self, key, reason: str) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        self.rows.clear()
        frame = pd.DataFrame(held, columns=self.names, dtype=object)
        for name, value in zip(KEY, key):
            frame[name] = value
        frame["reason"] = reason
        yield frame[[*[f.name for f in self.schema.fields], "reason"]]

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, most: int = MOST, longest: float = LONGEST) -> DataFrame:
    """A stream of scan rows (project, file, hash, _flag, _error, ...) that waits by file, with reason.

    Needs the RocksDB state store (``use_rocksdb``).
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("reason", T.StringType())])
    return rows.groupBy(*KEY).transformWithStateInPandas(
        FileBuffer(rows.schema, most, longest), outputStructType=schema, outputMode="append", timeMode="ProcessingTime"
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def scan_rows(sources: DataFrame, methods: DataFrame) -> DataFrame:
    """A stream of source files (project, file, hash, content) as method rows with code, and a marker each.

    ``methods`` is static: project, file, name, url, artifact, start_line, end_line.  A file without
    content is one FAILED row; its methods have no row.
    """
    own = ["project", "file", "name", "url", "artifact", "start_line", "end_line"]
    files = sources.select("project", "file", "hash", "content")
    there = files.where("content IS NOT NULL")
    known = methods.select(*own).withColumnsRenamed({"project": "__project", "file": "__file"})
    pairs = there.join(known, (there["project"] == known["__project"]) & (there["file"] == known["__file"])).drop("__project", "__file")
    coded = _with_code(pairs).withColumns({"_flag": F.lit(None).cast("string"), "_error": F.lit(None).cast("string")})
    flag = F.when(F.col("content").isNull(), FAILED).otherwise(SCANNED)
    marks = files.select("project", "file", "hash", flag.alias("_flag"), F.when(F.col("content").isNull(), "no content").alias("_error"))
    names = [*own, "code", "hash", "_flag", "_error"]
    kinds = dict(coded.dtypes)
    marks = marks.select(*[F.col(c) if c in marks.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])
    return coded.select(*names).unionByName(marks)


def _with_code(pairs: DataFrame) -> DataFrame:
    """Lines start_line to end_line of content; blank where they are not there."""
    first, lines = F.col("start_line"), F.split("content", r"\r?\n")
    fine = (first >= 1) & (F.col("end_line") >= first) & (first <= F.size(lines))
    code = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(F.col("end_line") - first + 1, F.lit(0))), "\n")
    return pairs.withColumn("code", F.when(fine, F.regexp_replace(code, r"\n$", "")).otherwise("")).drop("content")


def collect_method_code(
    sources: DataFrame, methods: DataFrame, table: str, checkpoint: str, most: int = MOST, longest: float = LONGEST, **trigger
) -> StreamingQuery:
    """Starts the stream that writes method code below ``table``: rows and done, a folder for each batch.

    A batch that runs again replaces its folders.  ``trigger`` goes to the writer:
    ``processingTime="1 minute"`` to run on, ``once=True`` for one batch of all that is there
    (timers that are due fire in it). With ``availableNow`` a stream with timers does not end.
    """
    rows = buffered(scan_rows(sources, methods), most, longest)

    def batch(found: DataFrame, number: int) -> None:
        found = found.persist()
        try:
            found.where("_flag IS NULL").drop("_flag", "_error").write.mode("overwrite").parquet(f"{table}/rows/batch={number}")
            marks = found.where("_flag IS NOT NULL").select(*KEY, "hash", "_flag", "_error").distinct()
            marks.write.mode("overwrite").parquet(f"{table}/done/batch={number}")
        finally:
            found.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
