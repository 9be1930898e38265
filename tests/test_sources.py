"""Sources, sinks, stores and the stream, on small files."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from weftline.operators.ingest import FAILED, SCANNED
from weftline.sources import config, csv, history, store
from weftline.streaming import ingest


def test_csv_tree(spark, tmp_path):
    (tmp_path / "method").mkdir()
    (tmp_path / "method" / "alpha.csv").write_text('name,start_line,code\nNA,72.0,"a ""q""\n, b"\nnull,,x\n')
    (tmp_path / "method" / "beta.csv").write_text("name,start_line,code\nb,3,y\n")
    df = csv.read_relation(spark, str(tmp_path), "method", ["name", "start_line", "code"])
    found = sorted((r["name"], r["start_line"], r["code"]) for r in df.collect())
    assert found == [("NA", 72, 'a "q"\n, b'), ("b", 3, "y"), ("null", None, "x")]
    only = csv.read_relation(spark, str(tmp_path), "method", ["name", "start_line", "code"], ["beta"])
    assert [r["name"] for r in only.collect()] == ["b"]
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "method"), required=["missing"])


def test_separators_and_union(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "b.csv").write_text("x,z\n3,4\n")
    df = csv.union_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["x"], r["y"], r["z"]) for r in df.collect()) == [("1", "2", None), ("3", None, "4")]


def test_csv_round_trip_and_integers(spark, tmp_path):
    df = spark.createDataFrame([("a", "72.0", 'q"\nz'), ("b", "", "")], "n string, loc string, code string")
    new, counts = csv.normal_integers(df, ["loc"])
    assert tuple(counts.first()) == (1, 1)
    csv.write_csv(new, str(tmp_path / "out"))
    back = csv.read_csv(spark, str(tmp_path / "out"))
    assert sorted((r["n"], r["loc"], r["code"]) for r in back.collect()) == [("a", "72", 'q"\nz'), ("b", "", "")]


def make_archive(path, members):
    with tarfile.open(path, "w:gz") as archive:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))


def test_archives(spark, tmp_path):
    folder = tmp_path / "finder"
    folder.mkdir()
    body = {
        "functionName": "run", "sourceFilePath": "src/A.java", "changeHistory": ["c2", "c1"], "changeHistoryShort": {"c1": "Yintroduced"},
        "changeHistoryDetails": {"c1": {"type": "Yintroduced", "commitDate": "31/12/20, 1:05 PM", "diff": "+a"}, "c2": {"type": "Ybodychange", "subchanges": [{"diff": "+b"}]}},
    }
    make_archive(folder / "alpha.tar.gz", [("A--run--1.json", json.dumps(body).encode()), ("b.json", b" "), ("c.json", b"{"), ("d.txt", b"x")])
    (folder / "beta.tar.gz").write_bytes(b"broken")
    members = history.read_archives(spark, str(tmp_path))
    counts = {r["project"]: (r["tool"], r["ok"], r["blank"], r["invalid"], r["unreadable"]) for r in history.archive_counts(members).collect()}
    assert counts == {"alpha": ("finder", 1, 1, 1, 0), "beta": ("finder", 0, 0, 0, 1)}
    commits = history.commit_rows(history.parse_histories(members)).orderBy("place").collect()
    assert [(c["commit"], c["type"], c["diff"], c["subchange_diffs"]) for c in commits] == [("c2", "Ybodychange", None, ["+b"]), ("c1", "Yintroduced", "+a", None)]
    assert str(commits[1]["ts"]).startswith("2020-12-31")
    assert history.repaired_members(members).count() == 2


def test_oracles_and_code(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"repositoryName": "p", "repositoryUrl": "https://h/p.git/", "commits": [{"commitHash": "a", "changeTags": ["x"]}]}))
    oracles = history.read_oracles(spark, str(tmp_path))
    by_project, by_url = history.oracle_counts(oracles)
    assert tuple(by_project.first()) == ("p", 1)
    assert oracles.first()["commits"][0]["changeTags"] == ["x"]
    sources = spark.createDataFrame([("A.java", "one\ntwo\nthree\n")], "file string, content string")
    methods = spark.createDataFrame([("A.java", 2, 3), ("A.java", 9, 9), ("B.java", 1, 1)], "file string, start_line int, end_line int")
    assert [r["code"] for r in history.code_of_ranges(sources, methods).orderBy("file", "start_line").collect()] == ["two\nthree", "", ""]


def test_configuration(spark, tmp_path):
    text = "groups:\n  main:\n    - a\n    - b\n  one: c\nsmells:\n  Lazy Test: LT\n"
    assert config.parse_sections(text)["groups"] == {"main": ["a", "b"], "one": ["c"]}
    assert config._parse_plain(text)["groups"] == {"main": ["a", "b"], "one": ["c"]}
    assert config.smell_names({"x": "A", "y": "A"}) == {"A": "x"}
    counts = config.RunCounts()
    assert config.should_generate(spark, str(tmp_path / "none"), False, counts)
    assert not config.should_generate(spark, str(tmp_path), False, counts) and counts.skipped == 1
    (tmp_path / "old").mkdir()
    config.remove_stale(spark, str(tmp_path / "old"), "inputs are gone", counts)
    assert counts.deleted == 1 and not (tmp_path / "old").exists()
    assert config.job_ranges([1, 2, 3, 7, 8, 10_500], [2]) == [(1, 1), (3, 3), (7, 8)]
    (tmp_path / "s" / "method").mkdir(parents=True)
    (tmp_path / "s" / "method" / "p.csv").write_text("x")
    plan = config.plan_copies(spark.createDataFrame([("p",), ("q",)], "project string"), spark.createDataFrame([("method",)], "artifact string"), str(tmp_path / "s"), str(tmp_path / "t"))
    rows = plan.orderBy("project").collect()
    assert [s for _, s in config.run_copies(spark, rows, dry_run=True)] == ["planned", "missing"]
    assert [s for _, s in config.run_copies(spark, rows)] == ["copied", "missing"]
    assert [s for _, s in config.run_copies(spark, rows)] == ["skipped", "missing"]


def test_stores(spark):
    schema = "url string, prompt string, output_raw string, output_json string, error string, created_at string, updated_at string"
    old = spark.createDataFrame([("a", "p", "r", "{}", "", "t0", "t0")], schema)
    asked = spark.createDataFrame([("a", "new"), ("b", "q")], "url string, prompt string")
    once = {r["url"]: r for r in store.upsert_requests(old, asked, "t1").collect()}
    assert (once["a"]["prompt"], once["b"]["error"], once["b"]["created_at"]) == ("p", "unknown", "t1")
    over = {r["url"]: r for r in store.upsert_requests(old, asked, "t1", overwrite=True).collect()}
    assert (over["a"]["prompt"], over["a"]["created_at"], over["a"]["updated_at"]) == ("new", "t0", "t1")
    done = store.upsert_results(store.upsert_requests(old, asked, "t1"), spark.createDataFrame([("b", "raw", "{}", "")], "url string, output_raw string, output_json string, error string"), "t2")
    assert {r["url"]: r["output_raw"] for r in done.collect()} == {"a": "r", "b": "raw"}
    assert [r["url"] for r in store.pending(asked, old).collect()] == ["b"]


def test_stream_is_idempotent(spark, tmp_path):
    source, table, errors, checkpoint = (str(tmp_path / n) for n in ("in", "table", "errors", "state"))
    schema = "project string, file string, name string, _flag string, _error string"
    spark.createDataFrame([("p", "a", "m", None, None), ("p", "a", None, SCANNED, None), ("p", "b", None, FAILED, "boom"), ("p", "d", "early", None, None)], schema).write.parquet(source)
    ingest.ingest(spark, source, schema, table, errors, checkpoint)
    spark.createDataFrame([("p", "a", "again", None, None), ("p", "c", "n", None, None), ("p", "d", "late", None, None)], schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, schema, table, errors, checkpoint)
    assert sorted(r["name"] for r in spark.read.parquet(table).collect()) == ["early", "late", "m", "n"]
    assert [r["_error"] for r in spark.read.parquet(errors).collect()] == ["boom"]


def test_stream_windows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = ingest.revision_counts(stream).writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(commits) FROM weeks").first()[0] == events.count()
