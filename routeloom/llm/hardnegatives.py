"""Hard negatives by distributed radix selection.

Scores are integers. Each anchor and positive has a window of scores for its negatives, each anchor one for its
positives. A pass over the rows counts, for every window, scores by the next digit of their distance from the window's
top; the digit at which the count reaches the wanted number is the bucket where the selection ends. Passes refine that
bucket digit by digit, then by vec_id among equal scores, until it holds a few rows. A last pass gathers rows above
the bucket and in it, which are few whatever the data, and ranks them.

Anchors are taken in blocks of bounded size. A task returns of each window no more counts than rows are wanted: its own
buckets up to the one where its own count is enough, since the selection can't end later. So nothing that is shuffled
or sent to the driver grows with the rows of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, new_folder, release, stored
from .vptree import matrix

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's
SCALE = 256
LARGEST = float(1 << 26)  # scaled entries from here on take no part: their products might leave 64 bits
BLOCK, ENTRIES = 2048, 1 << 22  # anchors of a block at most, and their entries
DIGIT = 6  # bits
FEW = 64  # a bucket with so many rows is gathered, not refined
CELLS = 1 << 20  # scores of a task at once
ALL = np.iinfo(np.int64).max
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame) -> DataFrame:
    """dim, vec_id, label, x (scaled integers) of the rows that take part; equal rows count once."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    return rows.where(fit).select(F.size("v").alias("dim"), "vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE).cast("int")).alias("x")).distinct()


class Windows:
    """Windows of one block, `slots` by anchor, and how far each selection has come. All arrays have that shape."""

    def __init__(self, top: np.ndarray, bottom: np.ndarray, k: int, same: bool, first_id: int, last_id: int):
        self.top, self.bottom, self.k, self.same = top.astype(np.int64), bottom.astype(np.int64), k, same
        self.first_id, self.id_shift = first_id, self._first_shift(np.array(max(1, last_id - first_id)))
        self.open = self.top >= self.bottom
        self.empty = ~self.open
        self.above, self.base = np.zeros_like(self.top), np.zeros_like(self.top)
        self.shift = self._first_shift(np.maximum(self.top - self.bottom, 1))
        self.by_id = np.zeros_like(self.open)
        self.far, self.last = np.where(self.empty, -1, self.top - self.bottom), np.full_like(self.top, ALL)  # what is gathered

    @staticmethod
    def _first_shift(most: np.ndarray) -> np.ndarray:
        bits = np.vectorize(lambda m: int(m).bit_length(), otypes=[np.int64])(most)
        return np.maximum(-(-bits // DIGIT) - 1, 0) * DIGIT

    def range(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score that a pass counts; none of windows that are done."""
        width = np.left_shift(np.int64(1), np.minimum(self.shift + DIGIT, 62))
        high = np.where(self.by_id, self.top - self.far, self.top - self.base)
        low = np.where(self.by_id, high, np.maximum(self.bottom, high - width + 1))
        return np.where(self.open, low, 1), np.where(self.open, high, 0)

    def located(self, slot: np.ndarray, anchor: np.ndarray, digit: np.ndarray, before: np.ndarray, count: np.ndarray) -> None:
        """The bucket where each selection ends. An open window without one has fewer rows than wanted: all are taken."""
        at, found = (slot, anchor), np.zeros_like(self.open)
        found[at] = True
        self.open &= found
        self.above[at] += before
        self.base[at] += np.left_shift(digit.astype(np.int64), self.shift[at])
        ids, scores = self.by_id & found, ~self.by_id & found
        end = self.base + np.left_shift(np.int64(1), self.shift) - 1
        self.far[scores] = np.minimum(end, self.top - self.bottom)[scores]
        self.last[ids] = (self.first_id + end)[ids]
        many = np.zeros_like(self.open)
        many[at] = count > FEW
        spent = self.shift == 0
        self.open &= many & ~(spent & self.by_id)
        turn = self.open & spent  # equal scores: by vec_id from now on
        self.by_id |= turn
        self.base[turn], self.shift[turn] = 0, self.id_shift
        self.shift[self.open & ~turn] -= DIGIT


class Block:
    """Anchors that a pass compares with every row."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.at: dict[int, list[int]] = {}
        for i, v in enumerate(ids.tolist()):
            self.at.setdefault(v, []).append(i)
        self.most = int(np.abs(x).max(initial=0))

    def scores(self, batch: pa.RecordBatch, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vec_ids, scores, which pairs count) of a batch's rows against all anchors, some rows at a time."""
        step = max(1, CELLS // max(1, len(self.ids)))
        for lo in range(0, len(batch), step):
            b = batch.slice(lo, step)
            ids, labels, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)).astype(np.int64)
            exact = self.most * int(np.abs(x).max(initial=0)) * x.shape[1] < 1 << 53  # then a product of doubles is exact, in any order
            found = x.astype(np.float64) @ self.x.T.astype(np.float64) if exact else x @ self.x.T
            fit = (labels[:, None] == self.labels) == same
            if same:
                for r in np.nonzero(np.isin(ids, self.ids))[0].tolist():
                    for c in self.at[int(ids[r])]:
                        if labels[r] == self.labels[c] and (x[r] == self.x[c]).all():
                            fit[r, c] = False  # the anchor itself
            yield ids, found, fit


def counted(rows: DataFrame, block, windows) -> list:
    """(slot, anchor, digit, before, count) of the bucket in which each open window's selection ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w = block.value, windows.value
        low, high = w.range()
        shape, many = w.top.shape, 1 << DIGIT
        counts = np.zeros(w.top.size * many, np.int64)
        for batch in batches:
            for ids, scores, fit in b.scores(batch, w.same):
                for slot in range(shape[0]):
                    r, c = np.nonzero((scores >= low[slot]) & (scores <= high[slot]) & fit)
                    key = np.where(w.by_id[slot, c], ids[r] - w.first_id, w.top[slot, c] - scores[r, c].astype(np.int64)) - w.base[slot, c]
                    digit = np.right_shift(key, w.shift[slot, c])
                    inside = (digit >= 0) & (digit < many)
                    counts += np.bincount((slot * shape[1] + c[inside]) * many + digit[inside], minlength=len(counts))
        counts = counts.reshape(-1, many)
        need = (w.k - w.above).ravel()
        enough = np.cumsum(counts, axis=1) - counts < need[:, None]
        at, digit = np.nonzero((counts > 0) & enough)
        yield pa.record_batch([pa.array(at), pa.array(digit), pa.array(need[at]), pa.array(counts[at, digit])], names=["w", "digit", "need", "n"])

    found = rows.select("vec_id", "label", "x").mapInArrow(run, "w long, digit long, need long, n long")
    found = found.groupBy("w", "need", "digit").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("w").orderBy("digit"))
    return found.withColumn("upto", upto).where("upto >= need and upto - n < need").select("w", "digit", (F.col("upto") - F.col("n")).alias("before"), "n").collect()


def gathered(rows: DataFrame, block, windows, k: int) -> DataFrame:
    """slot, anchor (place in the block), vec_id, score, rank of the first `k` rows of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w = block.value, windows.value
        low, high = np.where(w.empty, 1, w.top - w.far), np.where(w.empty, 0, w.top)
        for batch in batches:
            for ids, scores, fit in b.scores(batch, w.same):
                for slot in range(len(low)):
                    r, c = np.nonzero((scores >= low[slot]) & (scores <= high[slot]) & fit)
                    own = scores[r, c].astype(np.int64)
                    keep = (own > low[slot, c]) | (ids[r] <= w.last[slot, c])
                    r, c, own = r[keep], c[keep], own[keep]
                    if len(r):
                        yield pa.record_batch([pa.array(np.full(len(r), slot)), pa.array(c), pa.array(ids[r]), pa.array(own)], names=["slot", "anchor", "vec_id", "score"])

    found = rows.select("vec_id", "label", "x").mapInArrow(run, "slot long, anchor long, vec_id long, score long")
    order = Window.partitionBy("slot", "anchor").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def selected(rows: DataFrame, block, windows: Windows) -> DataFrame:
    """The first rows of each window, as gathered() has them."""
    send = rows.sparkSession.sparkContext.broadcast
    while windows.open.any():
        sent = send(windows)
        found = counted(rows, block, sent)
        sent.unpersist()
        cells = np.array([tuple(r) for r in found], np.int64).reshape(-1, 4)
        windows.located(*np.divmod(cells[:, 0], windows.top.shape[1]), *cells[:, 1:].T)
    return gathered(rows, block, send(windows), windows.k)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `vectors` (vec_id, label, embedding).

    Entries c count as floor(256 * c), a score is the inner product of such integers. Anchors are the rows whose
    vec_id is divisible by `every`; their positives the first others of their label, their negatives for a positive
    the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. First
    means higher scores, ties by smaller vec_id. Fewer are returned where there are fewer; an anchor without
    positives, or without negatives in a window (always so below zero), has no rows there.

    Rows with a null vec_id, label or vector, a null or non-finite entry, or one that scales to 2^26 or more take no
    part. Rows equal in all three columns count once; rows of one vec_id that differ are rows of their own. Vectors of
    different lengths don't meet. Other columns are not read; no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = stored(prepared(vectors), "rows")
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = rows.groupBy("dim").agg(F.count_if(F.col("vec_id") % every == 0).alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.max(norm).alias("most")).where("n > 0").collect()
    folder = new_folder(spark, "negatives")
    spark.createDataFrame([], OUT).write.parquet(f"{folder}/part=-1")
    made = 0
    for f in facts:
        own = rows.where(F.col("dim") == f["dim"])
        parts = -(-f["n"] // max(1, min(block, ENTRIES // max(1, f["dim"]))))
        number = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(parts))
        anchors = stored(own.where(F.col("vec_id") % every == 0).select("vec_id", "label", "x", number.alias("part")), "anchors")
        for part in range(parts):
            some = anchors.where(F.col("part") == part).orderBy("vec_id", "label", "x").collect()
            if some:
                one(own, some, f, positives, negatives, low, high).write.parquet(f"{folder}/part={made}")
                made += 1
        release(anchors)
    out = spark.read.schema(OUT).parquet(*[f"{folder}/part={i}" for i in range(-1, made)])
    drop(spark, rows.stored_at)
    return out


def one(rows: DataFrame, anchors: list, facts, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Hard negatives of the anchors of one block."""
    send = rows.sparkSession.sparkContext.broadcast
    ids, labels = (np.array([r[c] for r in anchors], np.int64) for c in ("vec_id", "label"))
    x = np.array([r["x"] for r in anchors], np.int64).reshape(len(anchors), -1)
    block = send(Block(ids, labels, x))
    most = np.ceil(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1) * facts["most"]) * (1 + 1e-9)).astype(np.int64)[None, :] + 1
    found = selected(rows, block, Windows(most, -most, positives, True, facts["first"], facts["last"])).collect()  # so many a block at most
    of, score = np.zeros((positives, len(anchors)), np.int64), np.full((positives, len(anchors)), -1)
    for r in found:
        of[r["rank"] - 1, r["anchor"]], score[r["rank"] - 1, r["anchor"]] = r["vec_id"], r["score"]
    top, bottom = high * score // 100, -(-low * score // 100)
    nothing = score < 0  # no such positive, or nothing can lie in its window
    windows = Windows(np.where(nothing, 0, top), np.where(nothing, 1, bottom), negatives, False, facts["first"], facts["last"])
    mined, shared = selected(rows, block, windows), send((ids, of, score))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of, score = shared.value
        for b in batches:
            slot, anchor = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.record_batch([pa.array(ids[anchor]), pa.array(of[slot, anchor]), b.column(4), b.column(2), pa.array(score[slot, anchor]), b.column(3)], names=[c.split(" ")[0] for c in OUT.split(", ")])

    return mined.select("slot", "anchor", "vec_id", "score", F.col("rank").cast("int").alias("rank")).mapInArrow(named, OUT)
