"""Exact deduplication by a stateful stream.

Documents arrive as a file stream. Its keyed state, on the executors' disks (RocksDB) and in the checkpoint, has a row
for each digest of a normalised text and never expires: how many rows there are, the identifier of the one that stays
and where its content is (file and row). Rows of one digest are combined before they are shuffled to the state, so a
text with many copies reaches it as a row a task. A later run goes on from the state and reads new files only.

A digest that occurs again is a hit. Of hits, full texts are compared byte by byte, in groups that are combined before
the shuffle too; a fixed bitmap of hit digests keeps the other texts where they are. Texts that differ under one digest
are groups of their own.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import new_folder, once, release, stored

SPACES = " \t\n\x0b\x0c\r"  # deleted from a text before it is compared
DIGEST = 32  # bytes of SHA-256 that key the state
BITS = 1 << 26  # bitmap of hit digests: 2,048 rows of 4 KB, however many hits there are
PAGE = 1 << 15  # bits of one row of it
BATCH = 500 * 10**9  # bytes of a micro-batch, about
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # one bound for all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no disk is taken before it is written to
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # an executor holds the stores of its running tasks only
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def marked(rows: DataFrame, digest: int = DIGEST) -> DataFrame:
    """doc_id, body (normalised text), sha (hex), digest (its first bytes), rank of file rows (doc_id, text).

    The largest rank stays: most code points, then the smallest doc_id (null ones last), then the last file and row. Its
    last two fields are the content's place.
    """
    doc, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rank = F.struct(F.length(text).alias("n_chars"), doc.isNotNull().alias("known"), F.bitwise_not(doc).alias("down"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.select(doc.alias("doc_id"), once(F.translate(text, SPACES, ""), "body"), rank.alias("rank"))
    rows = rows.select("doc_id", "body", "rank", once(F.sha2("body", 256), "sha"))
    return rows.select("doc_id", "body", "sha", F.unhex(F.substring("sha", 1, 2 * digest)).alias("digest"), "rank")


def schema_of(docs: DataFrame) -> StructType:
    """doc_id and text as the files have them; other columns are not read."""
    return StructType([docs.schema["doc_id"], StructField("text", StringType())])


def observe(spark: SparkSession, path: str, schema: StructType, checkpoint: str, batch: int = BATCH, digest: int = DIGEST) -> None:
    """Take what is new under `path` (Parquet) into the state under `checkpoint`; ends when all files are in.

    A run that was stopped goes on from its last micro-batch; a file is counted once.
    """
    path = path.rstrip("/")
    glob = f"{path[:-1]}[{path[-1]}]"  # matches the path alone; as a pattern it may be one file as well as a folder
    stream = marked(spark.readStream.schema(schema).option("maxBytesPerTrigger", batch).parquet(glob), digest)
    groups = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("best"))
    with settings(spark, STATE):
        groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, n, best: the state as a table."""
    with settings(spark, STATE):
        rows = spark.read.format("statestore").load(checkpoint)
    n, best = (f"value.`{f}`" for f in rows.schema["value"].dataType.names)
    return rows.select("key.digest", F.col(n).alias("n"), F.col(best).alias("best"))


def sieve(digests: DataFrame) -> DataFrame:
    """page, bitmap: a bit for each digest, `BITS` in all."""
    at = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    return digests.select(F.floor(at / PAGE).alias("page"), (at % PAGE).alias("bit")).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def sifted(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """`rows` with body kept only where the sieve has the digest's bit, or another digest's."""
    at = F.pmod(F.xxhash64("digest"), F.lit(BITS))
    rows = rows.withColumns({"page": F.floor(at / PAGE), "bit": (at % PAGE).cast("int")}).join(F.broadcast(pages), "page", "left")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) > 0, F.lit(False))
    return rows.withColumn("body", F.when(hit, F.col("body"))).drop("page", "bit", "bitmap")


def groups(spark: SparkSession, path: str, checkpoint: str | None = None, batch: int = BATCH, digest: int = DIGEST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of the Parquet files under `path` (doc_id, text).

    Texts are equal when identical without white space (ASCII); null counts as empty, so null, empty and blank texts
    are one group. The row with the most code points stays, then the smallest doc_id, a null one last; of rows equal in
    both, the last by file and place. Repeated rows are rows of their own, one of a group stays. Other columns are not
    read; no rows give no rows. Texts of any length are compared whole.

    `checkpoint`: where the state is kept for later runs; a new folder if None. `digest`: bytes of SHA-256 in the keys;
    fewer cost time, not right results, as texts under one key are told apart by their bytes. Of such texts only those
    that collide are gathered, by digest.
    """
    files = spark.read.parquet(path)
    schema = schema_of(files)
    checkpoint = checkpoint or new_folder(spark, "stream")
    observe(spark, path, schema, checkpoint, batch, digest)
    hits = stored(held(spark, checkpoint).where("n > 1"), "hits")
    rows = marked(spark.read.schema(schema).parquet(path), digest)
    members = stored(sifted(rows, sieve(hits.select("digest"))), "members")

    # Full bytes of hits; equal ones are combined in the tasks that read them.
    texts = members.where("body is not null").groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    checked = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows"))
    lost = F.raise_error(F.concat(F.lit("the files under the digest "), F.hex("digest"), F.lit(" are not those of the state")))
    info = hits.join(checked, "digest", "left").select("digest", F.when(F.col("rows") == F.col("n"), F.col("n")).otherwise(lost).alias("n"), "best", "texts")
    info = stored(info, "checked")
    clash = info.where("texts > 1").select("digest")
    own = sifted(members.where("body is not null"), sieve(clash))  # bodies travel on only where digests clash
    apart = own.where("body is not null").join(clash, "digest", "left_semi").groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("best"))
    apart = apart.groupBy("digest").agg(F.collect_list(F.struct("body", "n", "best")).alias("variants"))

    alone = members.where("body is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    several = own.join(info.join(apart, "digest", "left").hint("merge"), "digest", "left")  # a hot digest's rows can be split
    variant = F.try_element_at(F.filter("variants", lambda v: v["body"] == F.col("body")), F.lit(1))
    n, best = (F.when(F.col("variants").isNull(), F.col(c)).otherwise(variant[c]) for c in ("n", "best"))
    several = several.select("doc_id", "sha", "rank", n.alias("n"), best.alias("best"))
    kept = F.col("best").isNull() | (F.col("rank") == F.col("best"))  # without a best it only shares a bit with a hit
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.bitwise_not("best.down"))
    out = stored(alone.union(several.select("doc_id", keep, F.coalesce("n", F.lit(1)), kept, "sha")), "groups")
    release(hits, members, info)
    return out


def deduplicate(docs: DataFrame, batch: int = BATCH, digest: int = DIGEST) -> DataFrame:
    """groups() of a frame, which is written first: a stream and its content places need files."""
    rows = stored(docs.select("doc_id", "text"), "documents")
    out = groups(docs.sparkSession, rows.stored_at, batch=batch, digest=digest)
    release(rows)
    return out

