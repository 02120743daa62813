"""Token files: Arrow streams of fixed-size lists.

A shard is an Arrow IPC stream file whose batches hold ``ids`` (fixed-size list of L ids) and
``mask`` (fixed-size list of L booleans).  Rows have equal length, so sequence i of a mapped
file is a view, found without parsing what is before it.  Documents follow each other without
gaps and may go over a row's end; the last row of a shard is filled up, with mask false.  A
second stream beside each shard lists doc_id, first id and number of ids of its documents.

Writing: documents are dealt by ranges of doc_id and sorted, each task streams one shard to
the given folder (any file system that Arrow opens) under a name of its attempt and renames
it at the end, so that a lost or repeated task leaves whole files only.  The manifest has one
row per shard.

Defined results: a null text is empty and has the end id alone; rows that repeat a doc_id
follow each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import scratch_path, ship, table
from .encode import CHUNK_BYTES, encoder

SEQUENCE = 1024
BATCH_ROWS = 256
END_ID = 1

MANIFEST = "shard int, path string, n_docs long, n_ids long, low long"


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Streams ids into a shard and its document list, in bounded memory."""

    def __init__(self, out, docs_out, kind: np.dtype, length: int, metadata: dict[str, str] | None = None):
        self.kind, self.length = kind, length
        self.schema = _schema(kind, length).with_metadata(metadata or {})
        self.sink = ipc.new_stream(out, self.schema)
        self.docs = ipc.new_stream(docs_out, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.parts: list[bytes] = []
        self.held = self.n_ids = self.n_docs = 0
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.index.append((doc_id, self.n_ids, n))
        self.parts.append(ids)
        self.held += n
        self.n_ids += n
        self.n_docs += 1
        if self.held >= self.length * BATCH_ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.kind)
        rows = -(-len(ids) // self.length) if last else len(ids) // self.length
        full = min(len(ids), rows * self.length)
        self.parts = [ids[full:].tobytes()]
        self.held = len(ids) - full
        values = np.zeros(rows * self.length, self.kind)
        values[:full] = ids[:full]
        mask = np.zeros(len(values), bool)
        mask[:full] = True
        for i in range(0, rows, BATCH_ROWS):
            s = slice(i * self.length, min(rows, i + BATCH_ROWS) * self.length)
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[s]), type=f.type) for x, f in zip((values, mask), self.schema, strict=True)]
            self.sink.write_batch(pa.record_batch(cols, schema=self.schema))
        if self.index:
            self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)], names=["doc_id", "start", "n_tokens"]))
            self.index = []

    def close(self) -> None:
        self._flush(True)
        self.sink.close()
        self.docs.close()


class TokenShard:
    """Random access to the equal-length sequences of a shard; a local file is mapped, not read."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(ipc.open_stream(source))
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        b = int(np.searchsorted(self.first, i, "right")) - 1
        row = i - int(self.first[b])
        ids, mask = self.batches[b].columns
        length = ids.type.list_size
        return ids.values.slice(row * length, length).to_numpy(), mask.values.slice(row * length, length).to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, length: int = SEQUENCE, spaced: bool = False) -> DataFrame:
    """Write (doc_id, text) in order of doc_id; the manifest, one row per shard."""
    spark = ship(docs.sparkSession)
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, spaced)
        fs, folder = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"{folder}/shard-{task.partitionId():06d}"
        temp = f"{name}.{task.taskAttemptId()}"
        writer, low = None, None
        for part, raw, off in W.chunks(batches, "text", CHUNK_BYTES):
            ids, bound = enc.encode(raw, off, end_id)
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                if writer is None:
                    outs = [fs.open_output_stream(temp + x) for x in (".arrows", ".docs")]
                    writer = ShardWriter(*outs, enc.kind, length, {"end_id": str(end_id)})
                    low = doc_id
                writer.add(doc_id, ids[bound[i] : bound[i + 1]].tobytes())
        if writer is not None:
            writer.close()
            for o in outs:
                o.close()
            for x in (".arrows", ".docs"):
                fs.move(temp + x, name + x)
            uri = f"{path}/shard-{task.partitionId():06d}"
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [uri], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids], "low": pa.array([low], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ordered.mapInArrow(run, MANIFEST).collect()  # one row per shard
    return spark.createDataFrame(rows, MANIFEST)


def _stream(fs: pafs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
    with (pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)) as f:
        yield from ipc.open_stream(f)


def read_documents(uri: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, first id in the shard, ids) of a shard's documents, one batch in memory at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    rows = _stream(fs, path + ".arrows")
    held, at = np.zeros(0, np.uint16), 0
    for index in _stream(fs, path + ".docs"):
        for doc_id, start, n in zip(*(c.to_pylist() for c in index.columns), strict=True):
            if len(held) - at < n:
                parts, have = [held[at:]], len(held) - at
                while have < n:
                    b = next(rows)
                    ids = b.column(0).flatten().to_numpy()
                    mask = b.column(1).flatten().to_numpy(zero_copy_only=False)
                    parts.append(ids if mask.all() else ids[mask])
                    have += len(parts[-1])
                held, at = np.concatenate(parts) if len(parts[0]) else (np.concatenate(parts[1:])), 0
            yield doc_id, start, held[at : at + n]
            at += n


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = ship(manifest.sparkSession)
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])  # bounded by the number of shards
    base, rows = 0, []
    for r in shards:
        rows.append((r["path"], base))
        base += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out: list[tuple] = []
                for doc_id, start, ids in read_documents(path):
                    out.append((doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the files, read back."""
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest)
