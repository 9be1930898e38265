"""Token files: Arrow IPC files of fixed-size-list batches.

The identifiers of all documents, in ascending order of the key and each followed by the end
identifier, form one stream.  Every file holds a contiguous stretch of it, cut into sequences of
equal length: ``ids`` is fixed_size_list<uint16|uint32>[length], ``mask`` is
fixed_size_list<bool>[length] and false only in the padding of a file's last sequence.  Nothing
is compressed, so a reader that maps a file gets any sequence or mask without copying.

One range shuffle orders the texts; the task that receives a range encodes it and writes its file
in the same pass, first under a name of its own attempt and then renamed, so a lost or repeated
task leaves exactly one whole file.  The index (which document starts where) is a small table.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe_automaton import PlainSplitter, word_model_path
from weftline.llm.common import Memo, append_columns, saved, scratch_path, text_bytes

CACHE_BYTES = 80 << 20
SEQUENCE = 2048
SEQUENCES_A_BATCH = 64


class LibraryEncoder:
    """Identifiers by the tokenizers library, called once for each chunk not in the cache.

    The tokenizer must drop white space, so that chunks between white space stand alone.  Plain
    Latin chunks go to the library's model word by word; all others, and those that could hold a
    special token, go through its whole encoder.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.kind = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        with open(path, encoding="utf-8") as file:
            self.plain = PlainSplitter(json.load(file))
        self.chunk = Memo(self._chunk, cache_bytes, len)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        words = None if b"<|" in chunk else self.plain.words(text)
        if words is None:
            ids = self.encode(text, add_special_tokens=False).ids
        else:
            ids = [t.id for w in words for t in self.tokenize(w)]
        packed = array(self.kind, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.chunk.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    """The encoder of this Python worker, with its cache."""
    return LibraryEncoder(path)


def sequence_schema(kind: str, length: int) -> pa.Schema:
    value = pa.uint16() if kind == "H" else pa.uint32()
    return pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of identifiers into fixed-size-list batches of one IPC file."""

    def __init__(self, sink, kind: str, length: int, batch: int = SEQUENCES_A_BATCH):
        self.schema = sequence_schema(kind, length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.kind, self.width = f"<u{array(kind).itemsize}", array(kind).itemsize
        self.length, self.full = length, length * batch
        self.waiting: list[bytes] = []
        self.waiting_ids = 0
        self.written = 0

    def add(self, ids: bytes) -> int:
        """Appends identifiers; returns their position in the file."""
        start = self.written + self.waiting_ids
        self.waiting.append(ids)
        self.waiting_ids += len(ids) // self.width
        if self.waiting_ids >= self.full:
            flat = np.frombuffer(b"".join(self.waiting), dtype=self.kind)
            whole = len(flat) // self.full * self.full
            for at in range(0, whole, self.full):
                self._batch(flat[at : at + self.full], self.full)
            self.waiting, self.waiting_ids = [flat[whole:].tobytes()], len(flat) - whole
        return start

    def _batch(self, flat: np.ndarray, valid: int) -> None:
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(v, type=f.type.value_type), type=f.type)
            for v, f in zip((flat, np.arange(len(flat)) < valid), self.schema, strict=True)
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.written += valid

    def close(self) -> None:
        if self.waiting_ids:
            flat = np.frombuffer(b"".join(self.waiting), dtype=self.kind)
            self._batch(np.append(flat, np.zeros(-len(flat) % self.length, flat.dtype)), len(flat))
        self.writer.close()


class SequenceFile:
    """Random access to a file by mapping it (or by ranged reads on a remote store)."""

    def __init__(self, uri: str):
        store, path = pafs.FileSystem.from_uri(uri)
        local = isinstance(store, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        first = self.reader.get_batch(0)
        self.length = first.column(0).type.list_size
        self.step = first.num_rows * self.length

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Identifiers (a view into the file) and mask of sequence ``k``."""
        batch = self.reader.get_batch(k * self.length // self.step)
        k -= k * self.length // self.step * (self.step // self.length)
        ids, mask = (batch.column(i)[k].values for i in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def stretches(self, start: int, count: int):
        """Views that together hold the ``count`` identifiers from ``start``."""
        while count > 0:
            flat = self.reader.get_batch(start // self.step).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[start % self.step : start % self.step + count]
            yield part
            start, count = start + len(part), count - len(part)


def write_token_files(
    df: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    model_path: str | None = None,
    length: int = SEQUENCE,
) -> DataFrame:
    """Writes the token files of ``df`` into ``folder``; returns their index.

    The index has a row for each input row: the key, part (files ascend by key), file,
    file_start (identifiers before it in the file) and n_tokens (with the end identifier).  A null
    text has only the end identifier; null keys come first; rows with one key are ordered by a
    hash of the text; an empty table writes no file.  Using the index writes the files, so it is
    saved before it is returned.
    """
    path = model_path or word_model_path()
    kind = df.schema[key].dataType
    ordered = (
        df.select(F.col(f"`{key}`").alias("key"), text_bytes(f"`{text}`").alias("text"))
        .repartitionByRange("key", F.xxhash64("text"))
        .sortWithinPartitions("key", F.xxhash64("text"))
    )

    def run(batches):
        encode = encoder(path)
        task = TaskContext.get()
        part = task.partitionId()
        end = end_id.to_bytes(encode.width, "little")
        store, root = pafs.FileSystem.from_uri(folder)
        name, own = f"ids-{part:06d}.arrow", f".ids-{part:06d}-{task.taskAttemptId()}"
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{own}")
                writer = SequenceWriter(sink, encode.kind, length)
            starts, counts = [], []
            for value in batch.column(1).to_pylist():
                ids = encode.ids(value) + end
                starts.append(writer.add(ids))
                counts.append(len(ids) // encode.width)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([f"{folder}/{name}"] * n),
                 pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=["key", "part", "file", "file_start", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            sink.close()
            store.move(f"{root}/{own}", f"{root}/{name}")

    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("part", T.IntegerType()),
            T.StructField("file", T.StringType()),
            T.StructField("file_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )
    return saved(ordered.mapInArrow(run, schema), "token-index").withColumnRenamed("key", key)


def read_token_files(index: DataFrame) -> DataFrame:
    """``index`` with start (identifiers of all rows before, over all files) and ids_crc32, the
    checksum of each row's identifiers as little-endian unsigned 32-bit integers, from the files."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file.
    offsets = (
        index.groupBy("part")
        .agg(F.sum("n_tokens").alias("__in_file"))
        .select("part", F.coalesce(F.sum("__in_file").over(order), F.lit(0)).alias("__offset"))
    )

    def start():
        opened: dict[str, SequenceFile] = {}

        def work(files: list[str], starts: list[int], counts: list[int]):
            sums = []
            for uri, at, n in zip(files, starts, counts, strict=True):
                if uri not in opened:
                    opened.clear()
                    opened[uri] = SequenceFile(uri)
                crc = 0
                for ids in opened[uri].stretches(at, n):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                sums.append(crc)
            return (sums,)

        return work

    columns = [F.col(c) for c in ("file", "file_start", "n_tokens")]
    read = append_columns(index, columns, [("ids_crc32", T.LongType())], start)
    return read.join(offsets, "part").withColumn("start", F.col("__offset") + F.col("file_start")).drop("__offset")


def query(documents: DataFrame) -> DataFrame:
    folder = scratch_path(documents.sparkSession, "token-files")
    index = write_token_files(documents.select("doc_id", "text"), folder)
    return read_token_files(index).select("doc_id", "start", "n_tokens", "ids_crc32")
