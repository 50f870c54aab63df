"""What the corpus operators share: reading tables, shared storage for intermediate results, small caches."""

from __future__ import annotations

import weakref
from typing import ClassVar

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.tables import drop, new_folder

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every machine has the package that ships it."""
    return public_tokenizers.path(name)


def once(value: Column, name: str) -> Column:
    """The value as a generated column: plans that refer to it in a lambda or a filter don't compute it again there."""
    return F.explode(F.array(value)).alias(name)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, keeps columns apart."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")  # the shuffles of this job end with it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of stored() that no later plan reads."""
    for t in tables:
        drop(t.sparkSession, t.stored_at)


class Memo(dict):
    """Results of a pure function by key, in two generations of at most `limit` keys; keys over `longest` aren't kept.

    Emptying a generation changes speed only, so memory stays bounded on any input.
    """

    every: ClassVar[list[weakref.ref]] = []

    def __init__(self, make, limit: int, longest: int = 48):
        super().__init__()
        Memo.every.append(weakref.ref(self))
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def forget(*keep: Memo) -> None:
    """Empty all memos of this worker but `keep`: a worker that runs several operators holds one's at a time."""
    for memo in filter(None, (ref() for ref in Memo.every)):
        if not any(memo is k for k in keep):
            memo.clear()
            memo.old = {}
