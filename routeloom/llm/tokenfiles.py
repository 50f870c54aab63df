"""Token files: independent zstandard frames, per-frame checksums, and a seek table at the end.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers in independent zstandard
frames of `FRAME` bytes, then one frame with the documents' ids and lengths, then a skippable frame with the seek
table: for each frame its compressed size, its size and the low 32 bits of the xxhash64 of its content, and a
footer. This is the public seekable layout, so any zstandard tool reads the files too. A reader fetches the table,
then the index frame, then only the frames that hold the documents asked for, and checks each.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, new_folder
from .tokens import ids_of

FRAME = 1 << 18  # bytes of ids a frame
FILE = 1 << 26  # bytes of ids a file, about: a task goes on in another file beyond it
#: Fixed values of the seekable layout: the skippable frame's and the footer's magic numbers, and "has checksums".
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
NULL_ID = np.iinfo(np.int64).min  # stands for a null doc_id in the index
MANIFEST = "path string, n_docs long, n_tokens long, partition long, number long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Writer:
    """One file; it takes its final name only when whole, so a task that runs again replaces it by the same bytes."""

    def __init__(self, path: str):
        self.fs, self.path = opened(path)
        self.temporary = f"{self.path}.{os.getpid()}.{os.urandom(4).hex()}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out, self.frames, self.pending = self.fs.open_output_stream(self.temporary), [], bytearray()
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.packer, self.bytes = zstandard.ZstdCompressor(level=1), 0

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // 4)
        self.pending += ids
        self.bytes += len(ids)
        done = len(self.pending) // FRAME * FRAME
        for i in range(0, done, FRAME):
            self._frame(bytes(self.pending[i : i + FRAME]))
        del self.pending[:done]

    def close(self) -> tuple[int, int]:
        if self.pending:
            self._frame(bytes(self.pending))
        self._frame(np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.docs), self.bytes // 4


class Reader:
    """Documents of one file."""

    def __init__(self, path: str):
        self.fs, name = opened(path)
        self.file = self.fs.open_input_file(name)
        self.path, size = path, self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.lengths, self.sums = table.T
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.begin = np.concatenate([[0], np.cumsum(self.lengths[:-1])])  # in ids' bytes; the index frame is left out
        index = np.frombuffer(self.frame(n - 1), "<i8")
        self.docs, self.counts = index[: len(index) // 2], index[len(index) // 2 :]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def frame(self, i: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.sizes[i]), int(self.at[i])), max_output_size=int(self.lengths[i]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"{self.path}: frame {i} has another checksum")
        return data

    def rows(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids) of the documents wanted (None: of all), in the file's order."""
        i, data = -1, b""
        for doc, start, count in zip(self.docs.tolist(), self.starts.tolist(), self.counts.tolist(), strict=False):
            if wanted is not None and doc not in wanted:
                continue
            lo, hi, parts = 4 * start, 4 * (start + count), []
            while lo < hi:
                k = int(np.searchsorted(self.begin, lo, side="right")) - 1
                if k != i:
                    i, data = k, self.frame(k)
                part = data[lo - int(self.begin[k]) : hi - int(self.begin[k])]
                parts.append(part)
                lo += len(part)
            yield None if doc == NULL_ID else doc, start, b"".join(parts)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0) -> list[tuple[str, int, int, int]]:
    """Write the ids of `docs` (doc_id, text), each with `end_id`, in ascending doc_id order.

    Returns (path, documents, ids, ids in the files before) for each file, in order: one row a file, not a document.
    Null doc_ids come first; rows with equal doc_id are ordered by their text, and may lie in different files; null
    texts are empty. One shuffle, of the texts by ranges of doc_id; a task streams its range through one open frame.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = ids_of(vocabulary), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        forget(encode.word, encode.part)
        out, done, name = None, [], lambda: f"{folder}/part-{part:06d}-{len(done):05d}.tok"
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = out or Writer(name())
                out.add(doc, encode(text) + end)
                if out.bytes >= FILE:
                    done.append((name(), *out.close(), part, len(done)))
                    out = None
        if out:
            done.append((name(), *out.close(), part, len(done)))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 5, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["path", "n_docs", "n_tokens", "partition", "number"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    files, before = [], 0
    for r in sorted(ordered.mapInArrow(write, MANIFEST).collect(), key=lambda r: (r["partition"], r["number"])):
        files.append((r["path"], r["n_docs"], r["n_tokens"], before))
        before += r["n_tokens"]
    return files


def read_tokens(spark, files: list[tuple[str, int, int, int]], wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, from the files.

    `wanted`: only these doc_ids; then only the frames that hold them are decompressed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(doc, before + start, len(ids) // 4, zlib.crc32(ids)) for doc, start, ids in Reader(path).rows(wanted)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(f[0], f[3]) for f in files], "path string, before long")
    return listed.repartition(max(1, min(len(files), 8 * spark.sparkContext.defaultParallelism))).mapInArrow(read, READ)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the ids of `docs` (doc_id, text), then read them back; nulls, ties and repeated rows as in write_tokens()."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, vocabulary, new_folder(spark, "tokens"), end_id))
