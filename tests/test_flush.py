"""The stateful stream of method code: late parts, the timer, the row bound, restart from the checkpoint."""

import os
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftline.streaming import flush

METHODS = "project string, file string, name string, url string, artifact string, start_line int, end_line int"
SCAN = "project string, file string, hash string, _flag string, _error string, name string"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    flush.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def kept(spark, table, part="rows"):
    if not os.path.isdir(f"{table}/{part}"):
        return []
    try:
        return [r.asDict() for r in spark.read.parquet(f"{table}/{part}").collect()]
    except AnalysisException:  # nothing is written yet
        return []


def run(spark, folder, tmp_path, until=None, **options):
    """Runs the buffer over what lies in ``folder``; ``until`` waits for a condition of the rows written."""
    rows = flush.buffered(spark.readStream.schema(SCAN).parquet(folder), **options)
    table = str(tmp_path / "out")

    def batch(found, number):
        found.write.mode("overwrite").parquet(f"{table}/rows/batch={number}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "checkpoint"))
    if until is None:
        query = writer.trigger(once=True).start()
        assert query.awaitTermination(120)
    else:
        query = writer.trigger(processingTime="1 second").start()
        end = time.time() + 90
        while time.time() < end and not until(kept(spark, table)):
            time.sleep(0.5)
        query.stop()
    return kept(spark, table)


def test_late_parts_wait_for_the_marker_over_a_restart(rocksdb, tmp_path):
    spark, folder = rocksdb, str(tmp_path / "in")
    put(spark, folder, [("p", "a", "1", None, None, "m1"), ("p", "b", "1", None, None, "n1")], SCAN)
    assert run(spark, folder, tmp_path) == []
    put(spark, folder, [("p", "a", "1", None, None, "m2"), ("p", "a", "1", "__scan_marker__", None, None)], SCAN)
    found = run(spark, folder, tmp_path)
    assert {(r["file"], r["name"], r["reason"]) for r in found} == {("a", n, "complete") for n in ("m1", "m2", None)}
    # The same content again is dropped, other content starts anew; b still waits.
    put(spark, folder, [("p", "a", "1", None, None, "m3"), ("p", "a", "2", None, None, "k1"), ("p", "a", "2", "__error_marker__", "bad", None)], SCAN)
    found = run(spark, folder, tmp_path)
    assert sorted(r["name"] or "" for r in found if r["hash"] == "2") == ["", "k1"] and len(found) == 5


def test_rows_leave_by_number_and_by_time(rocksdb, tmp_path):
    spark, folder = rocksdb, str(tmp_path / "in")
    put(spark, folder, [("p", "a", "1", None, None, f"m{i}") for i in range(25)] + [("p", "b", "1", None, None, "n")], SCAN)
    found = run(spark, folder, tmp_path, until=lambda rows: len(rows) == 26, most=20, longest=3.0)
    assert {(r["file"], r["reason"]) for r in found} == {("a", "rows"), ("b", "time")} and len(found) == 26
    put(spark, folder, [("p", "b", "1", None, None, "late"), ("p", "b", "1", "__scan_marker__", None, None)], SCAN)
    found = run(spark, folder, tmp_path, most=20, longest=3.0)
    assert [r["reason"] for r in found if r["name"] == "late"] == ["complete"] and len(found) == 28


def test_method_code(rocksdb, tmp_path):
    spark, folder, table = rocksdb, str(tmp_path / "in"), str(tmp_path / "table")
    schema = "project string, file string, hash string, content string"
    methods = spark.createDataFrame(
        [("p", "a", "f", "u1", "", 1, 2), ("p", "a", "g", "u2", "", 3, 9), ("p", "a", "h", "u3", "", 0, 1), ("p", "b", "x", "u4", "", 1, 1)], METHODS
    )
    put(spark, folder, [("p", "a", "1", "one\r\ntwo\nthree"), ("p", "b", "1", None), ("p", "c", "1", "no methods")], schema)
    sources = spark.readStream.schema(schema).parquet(folder)
    query = flush.collect_method_code(sources, methods, table, str(tmp_path / "checkpoint"), once=True)
    assert query.awaitTermination(120)
    rows = {(r["url"], r["code"]) for r in kept(spark, table)}
    assert rows == {("u1", "one\ntwo"), ("u2", "three"), ("u3", "")}
    assert {(r["file"], r["_flag"]) for r in kept(spark, table, "done")} == {("a", "__scan_marker__"), ("b", "__error_marker__"), ("c", "__scan_marker__")}
    batch = spark.read.schema(schema).parquet(folder).where(F.col("file") == "a")
    assert flush.scan_rows(batch, methods).where("_flag IS NULL").count() == 3
