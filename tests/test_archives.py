"""The archive source: planning by bytes, streamed members, an archive beyond 2 GB, odd and broken ones."""

import gzip
import io
import json
import os
import tarfile

from weftline.sources import archives


def write(path, files):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wb", compresslevel=1) as out, tarfile.open(fileobj=out, mode="w|") as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_statuses_pruning_and_counts(spark, tmp_path):
    body = json.dumps({"a": 1}).encode()
    write(f"{tmp_path}/x/one.tar.gz", [("one/a.json", body), ("one/b.json", b" \n"), ("one/c.json", b"{"), ("one/d.txt", b"no"), ("one/e.json", b"[" * 900 + b"]" * 900)])
    write(f"{tmp_path}/y/two.tar.gz", [("two/a.json", body)] * 3)
    write(f"{tmp_path}/y/cut.tar.gz", [(f"cut/{i}.json", os.urandom(2000).hex().encode()) for i in range(50)])
    data = open(f"{tmp_path}/y/cut.tar.gz", "rb").read()
    open(f"{tmp_path}/y/cut.tar.gz", "wb").write(data[: len(data) // 2])
    open(f"{tmp_path}/y/bad.tar.gz", "wb").write(b"no archive")
    rows = archives.read_archives(spark, str(tmp_path), longestBytes=1000)
    by = {r["project"]: (r["tool"], r["ok"], r["blank"], r["invalid"], r["oversize"], r["unreadable"]) for r in archives.counts(rows).collect()}
    assert by["one"] == ("x", 1, 1, 1, 1, 0) and by["two"] == ("y", 3, 0, 0, 0, 0) and by["bad"] == ("y", 0, 0, 0, 0, 1)
    assert by["cut"][5] == 1 and by["cut"][4] > 0
    assert {r["project"] for r in archives.whole_only(rows).collect()} == {"one", "two"}
    index = archives.archive_members(spark, f"file://{tmp_path}")
    assert index.columns == ["archive", "project", "tool", "member", "bytes"] and index.where("project = 'one'").count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert archives.read_archives(spark, str(tmp_path)).where("tool = 'x' AND status = 'ok'").count() == 2
        one = archives.read_archives(spark, str(tmp_path)).where("project IN ('two', 'none')")
        assert one.count() == 3 and one.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archives_are_packed_by_bytes(tmp_path):
    assert archives.packed([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10) == [["a", "b"], ["c"], ["d"]]
    assert archives.packed([], 10) == []
    reader = archives.ArchiveReader({"path": str(tmp_path)})
    assert [p.files for p in reader.partitions()] == [[]]


def test_an_archive_beyond_two_gigabytes_is_streamed(spark, tmp_path):
    """3 GB of members that compress to little: they come out in batches of bounded bytes."""
    blank = b" " * (100 << 20)
    write(f"{tmp_path}/t/big.tar.gz", [(f"big/{i}.json", blank) for i in range(30)] + [("big/last.json", b"{}")])
    rows = archives.read_archives(spark, str(tmp_path))
    found = archives.counts(rows).first()
    assert (found["blank"], found["ok"], found["unreadable"]) == (30, 1, 0)
    sizes = {r["bytes"] for r in archives.archive_members(spark, str(tmp_path)).collect()}
    assert sizes == {100 << 20, 2}
    with open(f"{tmp_path}/t/big.tar.gz", "rb") as stream:
        first = next(archives.members(stream))
        assert first[:2] == ("big/0.json", "blank") and stream.tell() < os.path.getsize(f"{tmp_path}/t/big.tar.gz") / 2
