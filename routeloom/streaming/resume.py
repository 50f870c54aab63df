"""Resume of an interrupted fleet run: keyed state over the stream of target results.

The state has a session for each target whose last complete result still holds; failures are never recorded, so they
are tried again. A complete result opens a session as long as it holds, later ones prolong it, and the watermark ends
it: a row is late exactly when it no longer holds, so what holds after all files is the same whatever their order and
batches, and whether the run was stopped and started in between. Failures have no length, so they open no session.
"""

from __future__ import annotations

import json
from contextlib import contextmanager
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.publish import Storage

#: Columns of a stream of results; others are not read.
RESULTS = "target string, attempt bigint, status string, complete boolean, commit string, scanned_at timestamp"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",  # a hot target is a few rows in the shuffle
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


def begin(spark: SparkSession, path: str, identity: dict[str, str]) -> None:
    """Bind the state under `path` to what it was made from; ValueError, which names what differs, if that is something else."""
    store, text = Storage(spark, path), json.dumps(identity, sort_keys=True)
    if not store.put(text, ("_identity",), "identity.json"):
        had = json.loads(store.read("identity.json"))
        differ = sorted(k for k in had.keys() | identity.keys() if had.get(k) != identity.get(k))
        if differ:
            raise ValueError("the state is of another run: " + ", ".join(differ))


def observe(results: DataFrame, path: str, identity: dict[str, str], keep: timedelta, delay: timedelta = timedelta(0)) -> None:
    """Take what is new in the stream `results` (RESULTS) into the state under `path`; ends when all of it is in.

    A result holds for `keep` after its scan; time is that of the latest scan seen, less `delay`. Results without
    target, attempt, status or time are not recorded; a null `complete` is false, a null commit is empty. Of a target's
    results the last by time, then attempt, then status and commit counts; repeated rows count as one. A path that
    belongs to another `identity` is refused.
    """
    spark = results.sparkSession
    begin(spark, path, identity)
    rows = results.select(
        "target", F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("commit", F.lit("")).alias("commit"), "scanned_at",
        (F.coalesce("complete", F.lit(False)) & F.col("target").isNotNull() & F.col("attempt").isNotNull() & F.col("status").isNotNull()).alias("complete"),
    ).where("scanned_at is not null")
    # Failures move time on too, so they are left out above the watermark, by the session's own filter on its length.
    rows = rows.withWatermark("scanned_at", f"{int(delay / timedelta(milliseconds=1))} milliseconds")
    length = F.when(F.col("complete"), F.make_interval(secs=F.lit(Decimal(keep // timedelta(microseconds=1)).scaleb(-6)))).otherwise(F.make_interval())
    last = F.max(F.struct(F.unix_micros("scanned_at").alias("scanned_us"), "attempt", "status", "commit")).alias("last")
    with settings(spark, STATE):
        ended = rows.groupBy("target", F.session_window("scanned_at", length)).agg(last)
        ended.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{path.rstrip('/')}/state").trigger(availableNow=True).start().awaitTermination()


def held(spark: SparkSession, path: str) -> DataFrame:
    """target, attempt, status, commit, scanned_at: the results that hold."""
    with settings(spark, STATE):
        rows = spark.read.format("statestore").load(f"{path.rstrip('/')}/state")
    rows = rows.groupBy("value.target").agg(F.max("value.max").alias("last"))  # with a delay a target's older session may still be there
    return rows.select("target", "last.attempt", "last.status", "last.commit", F.timestamp_micros("last.scanned_us").alias("scanned_at"))


def to_do(targets: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of `targets` (target) that an interrupted run has still to scan."""
    return targets.join(held.select("target"), "target", "left_anti")


def finish(spark: SparkSession, path: str) -> None:
    """Drop the state when a run's results are all published: it serves to resume and is no history."""
    store = Storage(spark, path)
    for name in store.names():
        store.drop(name)
