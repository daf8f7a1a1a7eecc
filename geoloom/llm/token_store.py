"""Token ids in Arrow IPC files of fixed-size-list batches.

All texts are encoded in ascending doc_id order into one stream of ids, each document ended
by ``end_id``. The stream is cut into sequences of equal length: every file holds record
batches with two fixed-size-list columns, ``input_ids`` and ``mask`` (true for ids, false for
the padding of the file's last sequence), so any sequence is a slice of a memory map. A
second file beside it lists the documents: doc_id, start within the file, number of ids.

Each task writes files of its own name, so a repeated or speculative attempt overwrites
nothing; the manifest lists those of the attempts that succeeded.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, shared_dir, table, written
from .tokens import encoder, public_path

LENGTH = 2048
#: Sequences in a record batch.
ROWS = 256
MANIFEST = "file string, first_id long, n_docs long, n_tokens long, part int"


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return where.open_output_stream(path)
    if isinstance(where, fs.LocalFileSystem):
        return pa.memory_map(path)
    return where.open_input_file(path)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def sequence_schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([pa.field("input_ids", pa.list_(dtype, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)], {b"sequence_length": str(length).encode()})


class SequenceWriter:
    """Appends ids of documents; keeps no more than a record batch of them."""

    def __init__(self, sink, dtype, length: int = LENGTH, rows: int = ROWS):
        self.dtype, self.length, self.size = np.dtype(dtype), length, length * rows
        self.schema = sequence_schema(pa.from_numpy_dtype(self.dtype), length)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.n = bytearray(), 0

    def add(self, ids: bytes) -> int:
        """Where the ids start in this file."""
        start = self.n
        self.n += len(ids) // self.dtype.itemsize
        self.held += ids
        whole = self.size * self.dtype.itemsize
        while len(self.held) >= whole:
            self._batch(np.frombuffer(bytes(self.held[:whole]), self.dtype), self.size)
            del self.held[:whole]
        return start

    def _batch(self, ids: np.ndarray, real: int):
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self):
        rest = np.frombuffer(bytes(self.held), self.dtype)
        if len(rest):
            self._batch(np.pad(rest, (0, -len(rest) % self.length)), len(rest))
        self.out.close()


class SequenceReader:
    """Random access to the ids of a file, a batch being a view of the map."""

    def __init__(self, uri: str):
        self.file = pa.ipc.open_file(_open(uri, "r"))
        self.length = int(self.file.schema.metadata[b"sequence_length"])
        self.at, self.batch = -1, None
        first = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 1
        self.size = first

    def ids(self, i: int) -> np.ndarray:
        if i != self.at:
            self.batch = self.file.get_batch(i)
            self.at = i
        return self.batch.column(0).flatten().to_numpy()

    def mask(self, i: int) -> np.ndarray:
        return self.file.get_batch(i).column(1).flatten().to_numpy(zero_copy_only=False)

    def read(self, start: int, n: int):
        """The ids from ``start`` on, in views of one batch each."""
        while n > 0:
            i, j = divmod(start, self.size)
            part = self.ids(i)[j:j + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_sequences(documents: DataFrame, tokenizer: str, folder: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Writes the files below ``folder`` and returns the manifest, a row a file in order.

    Null texts are empty ones: their ids are the end id alone. Rows that repeat a doc_id each
    keep their ids, in the order of their texts; null doc_ids come first. A text of any length
    is encoded whole. Columns other than doc_id and text are not looked at. An empty table
    writes no file. Ids are stored in the narrowest unsigned type that holds the vocabulary.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        name, sink, out, index, n = f"{_uri(folder)}/{uuid.uuid4().hex}", None, None, [], 0
        enc = None
        for b in (b for whole in batches for b in pieces(whole, "text", 1 << 20)):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if out is None:
                    enc = encoder(tokenizer, None)
                    end = np.array([end_id], enc_dtype(enc)).tobytes()
                    sink = _open(f"{name}.arrow", "w")
                    out = SequenceWriter(sink, enc_dtype(enc), length)
                    docs_sink = _open(f"{name}.docs.arrow", "w")
                    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    docs_out = pa.ipc.new_file(docs_sink, schema)
                    first = doc
                ids = enc.encode(text or "") + end
                index.append((doc, out.add(ids), len(ids) // len(end)))
                n += 1
                if len(index) == 1 << 16:
                    docs_out.write_batch(_index(index, schema))
                    index = []
        if out is not None:
            if index:
                docs_out.write_batch(_index(index, schema))
            out.close()
            docs_out.close()
            sink.close()
            docs_sink.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([out.n], pa.int64()), pa.array([part], pa.int32())], ["file", "first_id", "n_docs", "n_tokens", "part"])

    return written(docs.mapInArrow(write, MANIFEST))


def _index(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], schema=schema)


def enc_dtype(enc) -> np.dtype:
    return np.dtype({"B": np.uint8, "H": np.uint16, "I": np.uint32}[enc.code])


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; ``start``
    counts the ids of all documents before it, over all files in the manifest's order."""
    spark = manifest.sparkSession
    # one row a file, as many as partitions have written one: their totals fit the driver
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    base = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in files])]).tolist()
    todo = spark.createDataFrame([(i, r["file"], base[i]) for i, r in enumerate(files)], "i int, file string, before long").repartitionByRange(len(files), "i").select("file", "before")

    def read(batches):
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seq = SequenceReader(f"{name}.arrow")
                index = pa.ipc.open_file(_open(f"{name}.docs.arrow", "r"))
                for i in range(index.num_record_batches):
                    own = index.get_batch(i)
                    crcs = []
                    for start, n in zip(own.column("start").to_pylist(), own.column("n_tokens").to_pylist()):
                        crc = 0
                        for part in seq.read(start, n):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    start = pa.array(own.column("start").to_numpy() + before, pa.int64())
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), start, own.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_sequences(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), shared_dir(spark))
    return read_documents(manifest)
