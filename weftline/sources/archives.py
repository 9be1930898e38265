"""History archives (tar.gz of JSON) as a data source: planned by bytes, members streamed.

A partition holds archives of about ``partitionBytes`` together; an archive is read front to back as
a stream and its members leave in batches of at most ``batchBytes``, so neither an archive nor its
list of members has to fit into memory.  Filters on archive, project and tool keep whole archives
from being opened (with spark.sql.python.filterPushdown.enabled), and ``content=false`` lists members
without reading them.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "archive string, project string, tool string, member string, status string, bytes long, json string"
SUFFIX = ".tar.gz"
#: Compressed bytes of a partition, bytes of a batch of members, and bytes of the longest member that is read.
PARTITION, BATCH, LONGEST = 128 << 20, 16 << 20, 512 << 20
# What can become of a member, and of an archive that ends too early.
OK, BLANK, INVALID, UNREAD, OVERSIZE, UNREADABLE = "ok", "blank", "invalid", "unread", "oversize", "unreadable"


@dataclass
class Archives(InputPartition):
    """(URI, project, tool) of the archives that one task reads."""

    files: list[tuple[str, str, str]]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of every archive below ``path``, in order."""
    from pyarrow import fs

    store, base = _filesystem(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX))


def packed(files: Iterable[tuple[str, int]], most: int) -> list[list[str]]:
    """Files in groups of at most ``most`` bytes; a larger file is a group of its own."""
    groups, held = [], most + 1
    for name, size in files:
        if held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    return groups


def members(stream, content: bool = True, longest: int = LONGEST) -> Iterator[tuple[str | None, str, int, str | None]]:
    """(member, status, bytes, json) of an archive's JSON members, read once from front to back.

    An archive that cannot be read on ends with a row without member.  A member that a later one of
    the same name replaces is a row as well.
    """
    try:
        with tarfile.open(fileobj=stream, mode="r|gz") as archive:
            for member in archive:
                if not (member.isfile() and member.name.endswith(".json")):
                    continue
                if not content:
                    yield member.name, UNREAD, member.size, None
                elif member.size > longest:
                    yield member.name, OVERSIZE, member.size, None
                else:
                    body = archive.extractfile(member).read().decode("utf-8", "replace")
                    yield member.name, *_read(body, member.size)
    except (tarfile.TarError, EOFError, OSError):
        yield None, UNREADABLE, 0, None


def _read(body: str, size: int) -> tuple[str, int, str | None]:
    if not body.strip():
        return BLANK, size, None
    try:
        json.loads(body)
    except ValueError:
        return INVALID, size, None
    return OK, size, body


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION))
        self.batch = int(options.get("batchbytes", BATCH))
        self.longest = int(options.get("longestbytes", LONGEST))
        self.content = str(options.get("content", "true")).lower() == "true"
        self.wanted: list[tuple[int, frozenset]] = []

    def _named(self, path: str) -> tuple[str, str, str]:
        parts = path.split("/")
        return path, parts[-1].removesuffix(SUFFIX), parts[-2] if len(parts) > 1 else ""

    def partitions(self) -> list[Archives]:
        files = [(p, size) for p, size in archives_below(self.path) if all(self._named(p)[i] in names for i, names in self.wanted)]
        return [Archives([self._named(p) for p in group]) for group in packed(files, self.most)] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for path, project, tool in partition.files:
            rows, held = [], 0
            with store.open_input_stream(path, compression=None) as stream:
                for found in members(stream, self.content, self.longest):
                    rows.append((path, project, tool, *found))
                    held += 256 + len(found[3] or "")
                    if held >= self.batch:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)


class PruningReader(ArchiveReader):
    """Opens only the archives that filters name."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what names archives; every other filter stays with Spark."""
        places = {"archive": 0, "project": 1, "tool": 2}
        for f in filters:
            place = places.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if place is None:
                yield f
            else:
                self.wanted.append((place, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n == "bytes" else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)


class ArchiveSource(DataSource):
    """``spark.read.format("history_archive").load(path)`` after ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "history_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        options = dict(self.options)
        return (PruningReader if options.get("prune") == "true" else ArchiveReader)(options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """archive, project, tool, member, status, bytes, json of every ``*.tar.gz`` below ``path``.

    ``path`` is local or in a store that Arrow reads (hdfs, s3, gs).  project is the file's name,
    tool its folder.  Options: partitionBytes, batchBytes, longestBytes, content.
    """
    spark.dataSource.register(ArchiveSource)
    # Spark refuses a reader that takes filters unless the session allows it.
    options["prune"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("history_archive").options(**{k: str(v) for k, v in options.items()}).load(path)


def archive_members(spark: SparkSession, path: str, **options) -> DataFrame:
    """The index of archives: names and sizes of members, nothing of them read."""
    return read_archives(spark, path, content="false", **options).where("member IS NOT NULL").drop("json", "status")


def counts(rows: DataFrame) -> DataFrame:
    """Members of each archive by status; ``unreadable`` is 1 where it ends too early."""
    kinds = (OK, BLANK, INVALID, OVERSIZE, UNREADABLE)
    return rows.groupBy("archive", "project", "tool").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def whole_only(rows: DataFrame) -> DataFrame:
    """Rows of archives that could be read to their end, as one that ends too early counts for nothing."""
    broken = rows.where(F.col("status") == UNREADABLE).select("archive").distinct()
    return rows.join(broken, "archive", "left_anti")
