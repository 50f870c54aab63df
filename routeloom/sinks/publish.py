"""Several folders published as one: all of them are seen in their new state, or all in the old one.

Frames are staged under a folder of their transaction, which readers don't look at. What commits is one manifest file,
moved into place by a rename that doesn't replace; readers find the folders through the newest manifest. So a run that
dies before the rename has changed nothing, and one that died after it has nothing left to do: the same transaction can
be tried again either way. The number and size of data files is whatever Spark writes; the driver holds names only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

MANIFEST = re.compile(r"^(\d{12})\.json$")
NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


class Storage:
    """A folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.none = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *parts: str) -> str | None:
        at = self.path(*parts)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def put(self, text: str, staged: tuple[str, ...], *parts: str) -> bool:
        """Write a file whole or not at all; False where there is one already, which stays."""
        stream = self.fs.create(self.path(*staged), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(*parts).getParent())
        try:
            self.context.rename(self.path(*staged), self.path(*parts), self.none)
        except Exception as e:  # noqa: BLE001  py4j wraps whatever the store throws
            if "FileAlreadyExists" in str(e) or self.fs.exists(self.path(*parts)):
                return False
            raise
        return True

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


def _manifests(store: Storage) -> list[int]:
    return [int(m[1]) for n in store.names("commits") if (m := MANIFEST.match(n))]


def _manifest(store: Storage, version: int) -> dict:
    return json.loads(store.read("commits", f"{version:012d}.json"))


def stage(spark: SparkSession, root: str, transaction: str, frames: dict[str, DataFrame]) -> None:
    """Phase one: write each frame to the transaction's folder. A folder that is whole from an earlier try stays."""
    if not frames:
        raise ValueError("nothing to publish")
    for name in (transaction, *frames):
        if not NAME.match(name):
            raise ValueError(f"not a plain folder name: {name!r}")
    store = Storage(spark, root)
    for name, frame in frames.items():
        if "_SUCCESS" not in store.names("data", transaction, name):
            frame.write.mode("overwrite").parquet(f"{store.root}/data/{transaction}/{name}")


def commit(spark: SparkSession, root: str, transaction: str, names: list[str]) -> int:
    """Phase two: the version under which the staged folders are published; the earlier one if they already are.

    Folders that this transaction doesn't name stay as the version before has them.
    """
    store = Storage(spark, root)
    while True:
        versions = _manifests(store)
        last = max(versions, default=0)
        before = _manifest(store, last) if last else {"folders": {}, "transactions": {}}
        if transaction in before["transactions"]:
            return before["transactions"][transaction]
        for name in names:
            if "_SUCCESS" not in store.names("data", transaction, name):
                raise ValueError(f"{name} of {transaction} is not staged whole; nothing was published")
        folders = before["folders"] | {name: f"data/{transaction}/{name}" for name in names}
        in_use = {f.split("/")[1] for f in folders.values()}
        done = {t: v for t, v in before["transactions"].items() if t in in_use or v == last} | {transaction: last + 1}
        text = json.dumps({"folders": folders, "transactions": done}, indent=2, sort_keys=True)
        if store.put(text, ("data", transaction, f"_manifest-{last + 1}"), "commits", f"{last + 1:012d}.json"):
            return last + 1  # else another writer took this version: build on it


def publish(spark: SparkSession, root: str, transaction: str, frames: dict[str, DataFrame]) -> int:
    """Both phases; the published version. Repeating a transaction publishes nothing twice, whatever it gave before."""
    store = Storage(spark, root)
    versions = _manifests(store)
    done = _manifest(store, max(versions))["transactions"] if versions else {}
    if transaction not in done:
        stage(spark, root, transaction, frames)
    return commit(spark, root, transaction, list(frames))


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A folder as of `version` (the newest one if None)."""
    store = Storage(spark, root)
    version = version or max(_manifests(store), default=0)
    folders = _manifest(store, version)["folders"] if version else {}
    if name not in folders:
        raise ValueError(f"{name} is not published under {root}")
    return spark.read.parquet(f"{store.root}/{folders[name]}")


def rollback(spark: SparkSession, root: str, transaction: str) -> None:
    """Give up a transaction that isn't committed: its staged folders go. A committed one stays as it is."""
    store = Storage(spark, root)
    if not any(transaction in _manifest(store, v)["transactions"] or any(f.split("/")[1] == transaction for f in _manifest(store, v)["folders"].values()) for v in _manifests(store)):
        store.drop("data", transaction)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drop what only versions before the last `keep` use; names of the transactions whose data went.

    Transactions under way have no manifest and are left alone: end them with `rollback`.
    """
    store = Storage(spark, root)
    versions = sorted(_manifests(store))
    old, new = versions[: -max(1, keep)], versions[-max(1, keep) :]
    of = lambda vs: {f.split("/")[1] for v in vs for f in _manifest(store, v)["folders"].values()}
    gone = sorted(of(old) - of(new))
    for v in old:
        store.drop("commits", f"{v:012d}.json")
    for t in gone:
        store.drop("data", t)
    return gone
