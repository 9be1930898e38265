"""Incremental ingestion of scan rows with Structured Streaming.

A file stream with ``availableNow`` takes what is new.  Every micro-batch writes a folder of its
own, named by its number, so a batch that runs again replaces what it wrote before.  A file is
complete once its scan marker has come; rows of files that were complete in an earlier batch, with
the same content hash where there is one, are not taken again.  Rows of one file may come in
several batches; a file without rows is complete by its marker alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ingest import FAILED, SCANNED
from weftline.sources.config import exists


def ingest(
    spark: SparkSession, source: str, schema: T.StructType | str, table: str, errors: str, checkpoint: str, key: tuple[str, ...] = ("project", "file")
) -> None:
    """Appends what is new below ``source`` (Parquet) to ``table`` (Parquet by batch and project) and ends.

    Completed files are kept in ``table``_done.  Rows carry _flag: null for data, SCANNED or FAILED.
    """
    done = table.rstrip("/") + "_done"

    def batch(rows: DataFrame, number: int) -> None:
        names = [*key, *(["hash"] if "hash" in rows.columns else [])]
        rows = rows.persist()
        try:
            data = rows.where("_flag IS NULL")
            if exists(spark, done):
                earlier = spark.read.parquet(done).where(F.col("batch") < number).select(*names).distinct()
                data = data.join(earlier, names, "left_anti")
            data.drop("_flag", "_error").write.mode("overwrite").partitionBy(key[0]).parquet(f"{table}/batch={number}")
            marks = rows.where(F.col("_flag") == SCANNED).select(*names).distinct()
            marks.write.mode("overwrite").parquet(f"{done}/batch={number}")
            failed = rows.where(F.col("_flag") == FAILED).select(*key, "_error").distinct()
            failed.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def revision_counts(events: DataFrame, time: str = "ts", lateness: str = "1 day", window: str = "7 days") -> DataFrame:
    """Commits by change type and week over a stream of commit events; rows later than ``lateness`` drop out."""
    return (
        events.withWatermark(time, lateness).groupBy(F.window(time, window), "event_type")
        .agg(F.count(F.lit(1)).alias("commits")).select(F.col("window.start").alias("week"), "event_type", "commits")
    )
