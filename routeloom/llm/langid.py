"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, ASCII non-letters become spaces, and every n-gram of one to three code points falls into
one of `BUCKETS` buckets. Learning counts buckets by language. Scoring broadcasts the log-probability matrix (its
size is fixed by buckets and languages) and adds up its rows for a batch of texts at once, as a sparse product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = 3
SAMPLE = 60_000  # labelled rows to learn from at most, about: whole texts, chosen by a hash of doc_id
PIECE = 1 << 18  # code points that are scored at a time
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint32)


def held_out(doc_id: Column) -> Column:
    """The test fold: crc32 of doc_id as text divisible by five. A null doc_id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def cut(text: str) -> list[str]:
    """A text, lower-cased and with spaces at its ends, in pieces: memory doesn't follow its length.

    Pieces overlap by the rest of an n-gram that begins at the last place of the one before, so none is lost or new.
    """
    padded = f"  {text.lower()}  "
    return [padded[i : i + PIECE + GRAMS - 1] for i in range(0, len(padded), PIECE)]


def buckets(piece: str) -> np.ndarray:
    """Bucket of every n-gram that begins in the first `PIECE` places of a piece."""
    codes = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4")
    codes = np.where(codes < 256, PLAIN[np.minimum(codes, 255)], codes).astype(np.uint32)
    grams, out = np.zeros(len(codes), np.uint32), []
    for n in range(GRAMS):
        if n < len(codes):
            grams = (grams[: len(codes) - n] * np.uint32(0x01000193)) ^ codes[n:]
            out.append(((grams[:PIECE] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(17))
    return np.concatenate(out)


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket) from `docs` (doc_id, text, lang) outside the test fold.

    Rows without text or lang are left out. Beyond `sample` rows, those whose hash falls into one of several equal
    classes are learned from. To the driver come bucket counts: buckets times languages at most.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    if (classes := -(-labelled.count() // sample)) > 1:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(classes)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in cut(text):
                    sums[lang] = sums.get(lang, 0) + np.bincount(buckets(piece), minlength=BUCKETS)
        for lang, n in sums.items():
            yield pa.record_batch([pa.array([lang]), pa.array([n.tolist()], pa.list_(pa.int64()))], names=["lang", "counts"])

    parts = labelled.where(F.col("text").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, counts array<long>")
    rows = parts.select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = rows.toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.ones((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)) if langs else counts


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text).

    `und` with score 0 where a text is null or has no letter, or nothing was learned. The score is the posterior of
    the predicted language with equal priors; ties go to the first in order. Repeated rows give repeated rows; other
    columns are not read. Texts of any length are scored whole, a piece of 2^18 code points at a time.
    """
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix.astype(np.float32)))  # 128 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            at = 0
            while at < len(known):
                some, size = [], 0
                while at < len(known) and (not some or size + len(texts[known[at]]) <= PIECE):
                    some.append(known[at])
                    size += len(texts[known[at]])
                    at += 1
                sums = np.zeros((len(some), len(langs)))
                if len(some) == 1:  # perhaps a very long text: one piece at a time
                    for piece in cut(texts[some[0]]):
                        sums[0] += logs[buckets(piece)].sum(axis=0, dtype=np.float64)
                else:
                    grams = [np.concatenate([*map(buckets, cut(texts[i]))]) for i in some]
                    starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])[:-1]]).astype(np.int64)
                    sums += np.add.reduceat(logs[np.concatenate(grams)], starts, axis=0, dtype=np.float64)
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                for i, row in zip(some, odds / odds.sum(axis=1, keepdims=True), strict=True):
                    pred[i], score[i] = langs[int(row.argmax())], float(row.max())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)
