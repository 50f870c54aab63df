"""Best-fit packing planned over the histogram of lengths.

A plan is made for counts of lengths, never for documents: at most `capacity` distinct lengths go longest first
into the sequence with the least room that still holds them, many equal ones at a step. A plan is a few thousand
runs of slots at any corpus size. Pieces then take the slot of their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored
from .tokens import ids_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of whole documents: each document's ids and `end_id`, cut only where longer than `capacity`.

    doc_id, piece (from 0), start (ids of its document before it), length, ids_crc32 (of little-endian unsigned
    32-bit ids). Null and empty texts give one piece with the end id; repeated rows give repeated pieces.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        forget(encode.word, encode.part)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                rows += [(doc, i, i * capacity, len(x) // 4, zlib.crc32(x)) for i, x in enumerate(ids[j : j + 4 * capacity] for j in range(0, len(ids), 4 * capacity))]
            columns = [*zip(*rows, strict=True)] or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of slots (length, first rank, first sequence, pieces a sequence, offset), best fit, longest lengths first.

    Each step uses up a length or a group of equal sequences, and splits at most one group in three: runs number at
    most a few times the distinct lengths, whatever the counts.
    """
    runs, groups, rooms, sequences = [], defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                room, first, count = capacity, sequences, -(-left // each)
                sequences += count
            else:
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
                each = room // length
            full = min(count, left // each)
            parts = [(first, full, each)] if full else []
            if full < count:
                if rest := min(left - full * each, each):
                    parts.append((first + full, 1, rest))
                if untouched := count - full - bool(rest):
                    parts.append((first + count - untouched, untouched, 0))
            for begin, n, k in parts:
                if k:
                    runs.append((length, rank, begin, k, capacity - room))
                    rank, left = rank + n * k, left - n * k
                if new := room - k * length:
                    if not groups[new]:
                        insort(rooms, new)
                    groups[new].append((begin, n))
    return runs


def pack(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """sequence_id and offset for each row of `rows` (PIECES columns, lengths from 1 to `capacity`).

    Ranks within a length are counted in `salts` shares, so a length that a third of the rows have is spread over
    all tasks. To the driver goes one count for each distinct length, `capacity` rows at most. Equal rows take
    different slots. No rows give no rows.
    """
    spark = rows.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}
    lengths, ranks, firsts, each, offsets = (np.array(c, np.int64) for c in (zip(*sorted(plan(histogram, capacity)), strict=True) if histogram else [()] * 5))
    slots = spark.sparkContext.broadcast((lengths, ranks, firsts, each, offsets))  # a few runs for each length at most
    ranked = (
        salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
        .join(before, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, firsts, each, offsets = slots.value
        step = int(ranks.max(initial=0)) + 1
        keys = lengths * step + ranks  # 2048 * a rank below 2^50 fits
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1
            j = rank - ranks[i]
            yield pa.record_batch([*b.columns[:5], pa.array(firsts[i] + j // each[i]), pa.array(offsets[i] + j % each[i] * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(take, PACKED)


def best_fit(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of `docs` (doc_id, text) with their sequence and offset; nulls, repeated rows and no rows as in pieces() and pack().

    Other columns are not read; a document of any length is cut into as many pieces as it needs.
    """
    return pack(stored(pieces(docs, path, capacity, end_id), "pieces"), capacity)
