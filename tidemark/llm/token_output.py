"""Token-id files: one zstandard frame per document, an index frame and a trailing seek table.

A file is a chain of independent zstandard frames (RFC 8878), each with a content checksum and holding one
document's ids as little-endian unsigned 32-bit integers. Behind them stand an index (a skippable frame with the
documents' ids) and the seek table of the public "zstd seekable format": for every frame its compressed size, its
size and 32 bits of its XXH64. A reader loads the tail of a file, and then only the frames of the documents it needs.

Files are written by the tasks that hold a range of doc_id, under names of their own; the manifest (a Parquet table
that Spark commits) names the files of the tasks that counted, so a repeated task leaves no trace in the result.

Defined results: a null or empty text is the end id alone; a null doc_id comes first; rows with the same doc_id are
ordered by a hash of the text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.tokens import TOKEN_BYTES, encoder

# Fixed values of the zstd seekable format.
SEEK_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: A skippable frame of our own: the documents of a file.
INDEX_MAGIC = 0x184D2A51

MANIFEST = "part int, file string, n_docs long, n_tokens long, first_doc long, last_doc long, has_null boolean, n_bytes long"


class FrameWriter:
    """Appends documents to a stream; ``close`` writes the index and the seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream = stream
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries, self.docs, self.counts, self.n_bytes = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype("<u4", copy=False).tobytes()
        frame = self.compressor.compress(raw)
        self._put(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append(doc_id)
        self.counts.append(len(ids))

    def close(self) -> None:
        index = np.asarray([d or 0 for d in self.docs], "<i8").tobytes() + np.asarray([d is None for d in self.docs], "u1").tobytes()
        frame = struct.pack("<IQ", len(self.docs), len(index)) + self.compressor.compress(index)
        self._put(frame := struct.pack("<II", INDEX_MAGIC, len(frame)) + frame)
        self.entries.append((len(frame), 0, 0))
        table = np.asarray(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table)) + table)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)


class FrameReader:
    """Reads single documents of a file that supports seek; only the tail is loaded at first."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.decompressor = stream, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token file: its seek table is missing")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.ends = np.cumsum(self.table[:, 0].astype(np.int64))
        index = self._at(int(self.ends[-1]) - int(self.table[-1, 0]), int(self.table[-1, 0]))
        count, length = struct.unpack("<IQ", index[8:20])
        raw = self.decompressor.decompress(index[20:], max_output_size=length)
        absent = np.frombuffer(raw, "u1", count, 8 * count)
        self.docs = [None if a else int(d) for d, a in zip(np.frombuffer(raw, "<i8", count), absent, strict=True)]

    def __len__(self) -> int:
        return len(self.docs)

    def ids(self, k: int) -> np.ndarray:
        import xxhash

        packed, size, checksum = (int(x) for x in self.table[k])
        raw = self.decompressor.decompress(self._at(int(self.ends[k]) - packed, packed), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)


def open_store(path: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, keeps_space: bool = False, level: int = 3) -> DataFrame:
    """Writes all documents in ascending doc_id order under ``path`` and returns the manifest, one row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(f"{path}/data")
        part, writer, stream, n_tokens = TaskContext.get().partitionId(), None, None, 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens.zst"
        for batch in batches:
            for piece in slices(batch, size=TOKEN_BYTES):
                ids, at = encoder(tokenizer, keeps_space).encode(piece.column("text"))
                if writer is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                    writer = FrameWriter(stream, level)
                for k, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                    writer.add(doc_id, np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)))
                n_tokens += len(ids) + piece.num_rows
        if writer is None:
            return
        writer.close()
        stream.close()
        known = [d for d in writer.docs if d is not None]
        row = [part, f"{path}/data/{name}", len(writer.docs), n_tokens, min(known, default=None), max(known, default=None), len(known) < len(writer.docs), writer.n_bytes]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["part", "file", "n_docs", "n_tokens", "first_doc", "last_doc", "has_null", "n_bytes"])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
        .repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    )
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _over_files(files: DataFrame, per_file: Callable, schema: str) -> DataFrame:
    """Runs per_file(row) -> batches on each row of a file table, one file to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from per_file(row)

    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def _opened(file: str) -> FrameReader:
    store, name = open_store(file)
    return FrameReader(store.open_input_file(name), store.get_file_info(name).size)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """All documents of ``path`` in their order: doc_id, start (ids before it), n_tokens, ids_crc32 (and ids)."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def per_file(row: dict) -> Iterator[pa.RecordBatch]:
        reader, start, out = _opened(row["file"]), row["start"], []
        for k, doc_id in enumerate(reader.docs):
            ids = reader.ids(k)
            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())) + (ids.astype(np.int64),) * with_ids)
            start += len(ids)
            if len(out) == (500 if with_ids else 20_000) or k + 1 == len(reader):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])
                out = []

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return _over_files(files, per_file, schema)


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The ids of the documents in wanted.doc_id: only the files that may hold them are opened, only their frames read."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader, at = None, None, {}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, reader, at = row["file"], _opened(row["file"]), {}
                    for k, d in enumerate(reader.docs):
                        at.setdefault(d, []).append(k)
                found += [(row["doc_id"], reader.ids(k).astype(np.int64)) for k in at.get(row["doc_id"], [])]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    hits = ids.join(manifest, F.col("doc_id").between(F.col("first_doc"), F.col("last_doc"))).select("doc_id", "file")
    return hits.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(fetch, "doc_id long, ids array<long>")
