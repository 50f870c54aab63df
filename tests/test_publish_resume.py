"""Publication survives death between its phases; resumed state equals what a batch gives."""

import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom.plans import fleets
from routeloom.sinks import publish
from routeloom.streaming import resume

DIES = """
import os, sys
from pyspark.sql import SparkSession
from routeloom.sinks import publish
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
publish.stage(spark, sys.argv[1], "t2", {"raw": spark.range(5), "html": spark.range(6)})
os._exit(9)
"""


def sizes(spark, root, version=None):
    return [publish.published(spark, root, n, version).count() for n in ("raw", "html")]


def test_killed_between_phases(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    assert publish.publish(spark, root, "t1", {"raw": spark.range(1), "html": spark.range(2)}) == 1
    died = subprocess.run([sys.executable, "-c", DIES, root], cwd=Path(__file__).resolve().parents[1], capture_output=True, check=False, timeout=120)
    assert died.returncode == 9
    assert sizes(spark, root) == [1, 2]
    assert publish.publish(spark, root, "t2", {"raw": spark.range(50), "html": spark.range(60)}) == 2  # what was staged whole stays
    assert sizes(spark, root) == [5, 6] and sizes(spark, root, 1) == [1, 2]
    assert publish.publish(spark, root, "t2", {"raw": spark.range(50)}) == 2 and sizes(spark, root) == [5, 6]


def test_half_staged_is_not_published(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    publish.publish(spark, root, "t1", {"raw": spark.range(1), "html": spark.range(2)})
    broken = spark.range(3).withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        publish.publish(spark, root, "t2", {"raw": spark.range(9), "html": broken})
    assert sizes(spark, root) == [1, 2]
    with pytest.raises(ValueError, match="html of t2 is not staged whole"):
        publish.commit(spark, root, "t2", ["raw", "html"])
    publish.rollback(spark, root, "t2")
    assert sizes(spark, root) == [1, 2] and publish.Storage(spark, root).names("data") == ["t1"]
    publish.rollback(spark, root, "t1")
    assert sizes(spark, root) == [1, 2]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/out"
    publish.stage(spark, root, "a", {"raw": spark.range(1)})
    publish.stage(spark, root, "b", {"html": spark.range(2)})
    seen, own = [], publish._manifests
    monkeypatch.setattr(publish, "_manifests", lambda s: seen.append(1) or ([] if len(seen) == 2 else own(s)))
    assert publish.commit(spark, root, "a", ["raw"]) == 1
    assert publish.commit(spark, root, "b", ["html"]) == 2  # it first looked before a's commit
    assert sizes(spark, root) == [1, 2]


def test_names_and_vacuum(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    for bad in ("../x", "", "a/b", ".hidden"):
        with pytest.raises(ValueError, match="plain folder name"):
            publish.publish(spark, root, "t", {bad: spark.range(1)})
    with pytest.raises(ValueError, match="nothing"):
        publish.publish(spark, root, "t", {})
    for i in (1, 2, 3):
        publish.publish(spark, root, f"t{i}", {"raw": spark.range(i)} | ({"html": spark.range(9)} if i == 1 else {}))
    publish.stage(spark, root, "t4", {"raw": spark.range(4)})
    assert publish.vacuum(spark, root, 1) == ["t2"]  # html is still of t1, t4 is under way
    assert sizes(spark, root) == [3, 9] and publish.commit(spark, root, "t4", ["raw"]) == 4


def expected(rows, keep, delay):
    end, last = max((r[5] for r in rows if r[5]), default=None), {}
    for r in rows:
        if r[0] and r[1] is not None and r[2] is not None and r[3] and r[5]:
            last[r[0]] = max(last.get(r[0], (datetime.min,)), (r[5], r[1], r[2], r[4] or ""))
    return {t: v for t, v in last.items() if v[0] + keep > end - delay}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_is_what_a_batch_gives(spark, tmp_path, seed):
    rng, keep, delay = random.Random(seed), timedelta(days=20), timedelta(days=1)
    rows = [(f"t{rng.randrange(40)}", i, rng.choice(["ok", "ok", "failed"]), rng.random() < 0.7, rng.choice(["c", None]), datetime(2024, 1, 1) + timedelta(days=rng.randrange(60))) for i in range(300)]
    rows += [(None, 1, "ok", True, "c", rows[0][5]), ("t1", None, "ok", True, "c", datetime(2024, 2, 29)), ("t2", 5, None, True, "c", rows[1][5]), ("t3", 5, "ok", None, "c", rows[2][5]), ("t4", 7, "ok", True, "c", None), rows[7]]
    rows += [("hot", i, "ok", True, "c", rows[i][5]) for i in range(150)]
    rng.shuffle(rows)
    src, path, who = f"file://{tmp_path}/in", f"file://{tmp_path}/run", {"manifest": "m", "config": "c"}
    for i in range(3):  # each part comes after the run before has ended, late rows too
        spark.createDataFrame(rows[i::3], resume.RESULTS).withColumn("target2", F.lit(1)).coalesce(1).write.mode("append").parquet(src)
        resume.observe(spark.readStream.schema(resume.RESULTS).option("maxFilesPerTrigger", 1).parquet(src), path, who, keep, delay)
    got = {r["target"]: (r["scanned_at"], r["attempt"], r["status"], r["commit"]) for r in resume.held(spark, path).collect()}
    assert got == expected(rows, keep, delay) and 5 < len(got) < 41
    targets = spark.createDataFrame([(f"t{i}",) for i in range(50)], "target string")
    assert resume.to_do(targets, resume.held(spark, path)).count() == 50 - len(got.keys() - {"hot"})
    with pytest.raises(ValueError, match="another run: config"):
        resume.observe(spark.readStream.schema(resume.RESULTS).parquet(src), path, who | {"config": "d"}, keep, delay)
    resume.finish(spark, path)
    resume.begin(spark, path, who | {"config": "d"})


def test_failures_move_time_on(spark, tmp_path):
    day, src, path = datetime(2024, 1, 1), f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    rows = [("old", 1, "ok", True, "c", day), ("edge", 1, "ok", True, "c", day + timedelta(days=2)), ("new", 1, "ok", True, "c", day + timedelta(days=3)), (None, 1, "failed", False, None, day + timedelta(days=12))]
    spark.createDataFrame(rows, resume.RESULTS).coalesce(1).write.parquet(src)
    resume.observe(spark.readStream.schema(resume.RESULTS).parquet(src), path, {}, timedelta(days=10))
    assert [r["target"] for r in resume.held(spark, path).collect()] == ["new"]


def test_no_results(spark, tmp_path):
    src, path = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    spark.createDataFrame([], resume.RESULTS).write.parquet(src)
    resume.observe(spark.readStream.schema(resume.RESULTS).parquet(src), path, {}, timedelta(days=1))
    assert resume.held(spark, path).count() == 0


def test_a_target_s_last_session_counts_and_no_step_is_python(spark, tmp_path):
    day, src, path = datetime(2024, 1, 1), f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    rows = [("t", 1, "ok", True, "a", day), ("t", 2, "ok", True, "b", day + timedelta(days=15)), ("t", 3, "failed", False, "c", day + timedelta(days=16)), ("u", 4, "ok", True, None, day - timedelta(days=1)), ("v", 5, "ok", True, "d", day - timedelta(days=9, microseconds=1))]
    spark.createDataFrame(rows, resume.RESULTS).coalesce(1).write.parquet(src)
    resume.observe(spark.readStream.schema(resume.RESULTS).parquet(src), path, {}, timedelta(days=10), timedelta(days=15))
    assert sorted(map(tuple, resume.held(spark, path).select("target", "attempt", "status", "commit", "scanned_at").collect())) == [("t", 2, "ok", "b", rows[1][5]), ("u", 4, "ok", "", rows[3][5])]
    assert [r[0] for r in spark.read.format("state-metadata").load(f"{path}/state").select("operatorName").distinct().collect()] == ["sessionWindowStateStoreSaveExec"]


def test_resumed_targets_by_value(spark):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    assert sorted(map(tuple, fleets.resumed_targets(spark, d).collect())) == sorted(con.sql(fleets.oracle_sql()["resumed_targets"]).fetchall())
