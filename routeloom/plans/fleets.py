"""Registered queries over saved fleets: customers are targets, their orders modules, items files; the same in DuckDB SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from ..sinks.tables import new_folder
from ..streaming import resume
from .rules import table


def saved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """TARGETS, MODULES and ARTIFACTS of the integrity module, some of them out of form."""
    targets = table(
        spark, d, "customer", target="CASE WHEN c_custkey % 61 = 8 THEN concat('..', c_custkey) WHEN c_custkey % 67 = 3 THEN 'svc-3' ELSE concat('svc-', c_custkey) END", status="CASE WHEN c_custkey % 59 = 2 THEN 'done' WHEN c_custkey % 7 = 5 THEN 'not-go-module' WHEN c_custkey % 13 = 1 THEN 'failed' ELSE 'ok' END", complete="c_custkey % 17 <> 4",
        ref="CASE c_custkey % 12 WHEN 0 THEN '' WHEN 1 THEN concat('rel/', c_custkey) WHEN 2 THEN 'a..b' WHEN 3 THEN 'x.lock/y' WHEN 4 THEN '/lead' ELSE 'main' END", commit="CASE WHEN c_custkey % 29 = 6 THEN 'ABC' ELSE substr(sha2(cast(c_custkey AS string), 256), 1, 40) END",
        source_fingerprint="concat('f', c_custkey)", inventory_complete="c_custkey % 5 <> 0", category="CASE WHEN c_custkey % 3 = 0 THEN 'gin-routes' ELSE 'non-gin' END",
    )
    module = "CASE WHEN o_orderkey % 101 = 5 THEN 'module-xyz' ELSE concat('module-', substr(sha2(cast(o_orderkey % 9 AS string), 256), 1, 16)) END"
    modules = table(spark, d, "orders", target="concat('svc-', o_custkey)", module_id=module, kind="CASE WHEN o_orderkey % 73 = 9 THEN 'library' WHEN o_orderkey % 2 = 0 THEN 'go-module' ELSE 'gin-application' END", status="CASE WHEN o_orderkey % 89 = 7 THEN '' ELSE 'ok' END", complete="true", report="''", api_html="''")
    artifacts = table(
        spark, d, "lineitem", target="concat('svc-', l_orderkey)", module_id="concat('m', l_linenumber)", tree="CASE WHEN l_partkey % 97 = 3 THEN 'raw' WHEN l_partkey % 2 = 0 THEN 'html' END",
        path="CASE l_partkey % 53 WHEN 1 THEN concat('/', l_partkey) WHEN 2 THEN '../x' WHEN 3 THEN 'a//b' WHEN 4 THEN 'a\\\\\\\\b' WHEN 5 THEN '' WHEN 6 THEN 'a/../b' ELSE concat('targets/', l_partkey, '/routes.json') END", bytes="CASE WHEN l_partkey % 71 = 11 THEN -1 ELSE l_partkey END", sha256="CASE WHEN l_suppkey % 43 = 7 THEN 'abc' WHEN l_suppkey % 43 = 8 THEN repeat('z', 64) ELSE sha2(cast(l_partkey AS string), 256) END",
    )
    return targets, modules, artifacts


def saved_fleet_problems(spark: SparkSession, d: str) -> DataFrame:
    targets, modules, artifacts = saved(spark, d)
    groups = table(spark, d, "customer", name="concat('svc-', c_custkey)", category="CASE WHEN c_custkey % 3 = 0 THEN 'gin-routes' WHEN c_custkey % 83 = 4 THEN 'failed' ELSE 'non-gin' END")
    return integrity.problems(targets, modules, artifacts, groups).groupBy("target", "module_id", "problem").agg(F.count(F.lit(1)).alias("n"))


def reuse_problems(spark: SparkSession, d: str) -> DataFrame:
    """Customers with one to several modules, each with a report and an API document on record; some files changed or went."""
    k = "c_custkey"
    targets = table(spark, d, "customer", target=f"concat('svc-', {k})", status=f"CASE WHEN {k} % 7 = 5 THEN 'not-go-module' WHEN {k} % 13 = 1 THEN 'failed' ELSE 'ok' END", complete=f"{k} % 17 <> 4", source_fingerprint=f"CASE WHEN {k} % 19 = 2 THEN '' ELSE concat('f', {k}) END", inventory_complete=f"{k} % 3 <> 0")
    current = table(spark, d, "customer", target=f"concat('svc-', {k})", fingerprint=f"CASE WHEN {k} % 23 = 5 THEN 'g' ELSE concat('f', {k}) END").where("target <> 'svc-8'")
    module = table(spark, d, "customer", k=k).where("k % 7 <> 5 or k % 5 = 0").selectExpr("k", "explode(CASE WHEN k % 29 = 9 THEN array() ELSE sequence(1, k % 3 + 1) END) AS i")
    module = module.selectExpr("k", "i", "concat('svc-', k) AS target", "CASE WHEN i = 1 THEN 'root' ELSE concat('module-', substr(sha2(cast(i AS string), 256), 1, 16)) END AS module_id")
    base = "concat('targets/', target, CASE WHEN k % 3 > 0 THEN concat('/modules/', module_id) ELSE '' END)"
    modules = module.selectExpr("target", "module_id", "'go-module' AS kind", "'ok' AS status", "k % 31 <> 3 OR i > 1 AS complete", f"CASE WHEN k % 37 = 7 THEN 'x.json' ELSE concat({base}, '/routes.json') END AS report", "CAST(NULL AS string) AS api_html")
    each = module.selectExpr("k", "i", "target", "module_id", f"{base} AS base", "explode(array('routes.json', 'openapi.json')) AS name").where("k % 41 <> 6 or i > 1 or name <> 'openapi.json'")
    each = each.selectExpr("*", "concat(base, '/', name) AS path", "k * 10 + i AS bytes", "sha2(concat(base, name), 256) AS sha256")
    parts = each.selectExpr("target", "module_id", "CAST(NULL AS string) AS tree", "path", "bytes", "sha256")
    whole = each.selectExpr("target", "CAST(NULL AS string) AS module_id", "'' AS tree", "path", "CASE WHEN k % 43 = 8 AND i = 1 THEN bytes + 1 ELSE bytes END AS bytes", "sha256")
    files = each.where("k % 47 <> 9").selectExpr("'' AS tree", "path", "CASE WHEN k % 43 = 8 AND i = 1 THEN bytes + 1 ELSE bytes END AS bytes", "CASE WHEN k % 53 = 10 AND i = 1 THEN sha2('changed', 256) ELSE sha256 END AS sha256")
    return integrity.reuse_problems(targets, modules, parts.unionByName(whole), files, current, ("json", "openapi"))


def tree_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each manufacturer's brand, with the types of its parts as folders."""
    return integrity.tree_hashes(table(spark, d, "part", root="p_brand", path="concat(p_type, '/', p_partkey, '.yaml')", sha256="sha2(p_name, 256)"), "root")


def resumed_targets(spark: SparkSession, d: str) -> DataFrame:
    """Orders as results of their customers, taken from a stream into state; each customer's result that holds, or none."""
    path = f"{d}/orders.parquet"
    files = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may be one file as well as a folder
    k = "o_orderkey"
    results = files.selectExpr(
        f"CASE WHEN {k} % 211 = 4 THEN NULL ELSE concat('svc-', o_custkey) END AS target", f"CASE WHEN {k} % 197 = 6 THEN NULL ELSE {k} END AS attempt", "CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'O' THEN 'not-go-module' ELSE 'ok' END AS status",
        f"CASE WHEN {k} % 193 = 7 THEN NULL ELSE o_orderstatus <> 'P' AND {k} % 5 <> 0 END AS complete", f"CASE WHEN {k} % 3 > 0 THEN concat('c', {k}) END AS commit", "CAST(o_orderdate AS timestamp) AS scanned_at",
    )
    state = new_folder(spark, "resume")
    resume.observe(results, state, {"table": "orders"}, timedelta(days=700), timedelta(hours=36))
    targets = table(spark, d, "customer", target="concat('svc-', c_custkey)")
    rows = targets.join(resume.held(spark, state), "target", "left")
    return rows.selectExpr("target", "attempt", "status", "commit", "cast(scanned_at as date) AS scanned", "attempt IS NULL AS to_do")


ALL = (saved_fleet_problems, reuse_problems, tree_hashes, resumed_targets)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


SAVED = r"""
t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 61 = 8 THEN '..' || c_custkey WHEN c_custkey % 67 = 3 THEN 'svc-3' ELSE 'svc-' || c_custkey END AS target, CASE WHEN c_custkey % 3 = 0 THEN 'gin-routes' ELSE 'non-gin' END AS category FROM customer),
g AS (SELECT 'svc-' || c_custkey AS target, CASE WHEN c_custkey % 3 = 0 THEN 'gin-routes' WHEN c_custkey % 83 = 4 THEN 'failed' ELSE 'non-gin' END AS category FROM customer),
m AS (SELECT o_orderkey AS k, 'svc-' || o_custkey AS target, CASE WHEN o_orderkey % 101 = 5 THEN 'module-xyz' ELSE 'module-' || substr(sha256(CAST(o_orderkey % 9 AS VARCHAR)), 1, 16) END AS module_id FROM orders),
a AS (SELECT 'svc-' || l_orderkey AS target, 'm' || l_linenumber AS module_id, CASE WHEN l_partkey % 97 = 3 THEN 'invalid tree' WHEN l_partkey % 53 IN (1, 2, 5) THEN 'invalid path' WHEN l_partkey % 53 IN (3, 4, 6) THEN 'non-canonical path' WHEN l_partkey % 71 = 11 OR l_suppkey % 43 = 7 THEN 'invalid integrity metadata' WHEN l_suppkey % 43 = 8 THEN 'invalid SHA-256' END AS problem FROM lineitem),
p AS (
  SELECT target, NULL AS module_id, 'invalid target name' AS problem FROM t WHERE target LIKE '..%'
  UNION ALL SELECT target, NULL, 'duplicate target name' FROM t GROUP BY target HAVING count(*) > 1
  UNION ALL SELECT target, NULL, 'invalid status' FROM t WHERE k % 59 = 2
  UNION ALL SELECT target, NULL, 'invalid repository ref' FROM t WHERE k % 12 IN (2, 3, 4)
  UNION ALL SELECT target, NULL, 'invalid scanned commit' FROM t WHERE k % 29 = 6
  UNION ALL SELECT target, module_id, 'invalid module id' FROM m WHERE module_id = 'module-xyz'
  UNION ALL SELECT target, module_id, 'duplicate module id' FROM m GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT target, module_id, 'invalid status' FROM m WHERE k % 89 = 7
  UNION ALL SELECT target, module_id, 'invalid module kind' FROM m WHERE k % 73 = 9
  UNION ALL SELECT target, module_id, problem FROM a WHERE problem IS NOT NULL
  UNION ALL SELECT DISTINCT target, NULL, 'repository groups do not match targets' FROM ((SELECT target, category FROM t EXCEPT ALL SELECT target, category FROM g) UNION ALL (SELECT target, category FROM g EXCEPT ALL SELECT target, category FROM t))
)"""
REUSE = """
t AS (SELECT c_custkey AS k, c_custkey % 3 + 1 AS n, CASE WHEN c_custkey % 7 = 5 THEN 'none' WHEN c_custkey % 13 = 1 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 17 = 4 THEN 'result is incomplete' WHEN c_custkey % 19 = 2 OR c_custkey % 23 = 5 OR c_custkey = 8 THEN 'source identity changed' WHEN c_custkey % 7 = 5 THEN CASE WHEN c_custkey % 3 = 0 THEN 'repository inventory is incomplete' END WHEN c_custkey % 13 = 1 THEN 'status is not reusable' END AS problem,
  (c_custkey % 7 <> 5 OR c_custkey % 5 = 0) AND c_custkey % 29 <> 9 AS modules FROM customer),
ok AS (SELECT * FROM t WHERE problem IS NULL AND status = 'ok'),
p AS (
  SELECT k, problem FROM t WHERE problem IS NOT NULL UNION ALL SELECT k, 'unexpected module artifacts' FROM t WHERE problem IS NULL AND status = 'none' AND modules
  UNION ALL SELECT k, 'no module inventory' FROM ok WHERE NOT modules UNION ALL SELECT k, 'a module is not complete' FROM ok WHERE modules AND k % 31 = 3 UNION ALL SELECT k, 'non-canonical report path' FROM ok WHERE modules AND k % 37 = 7
  UNION ALL SELECT k, 'a module''s artifact set is not complete' FROM ok WHERE modules AND k % 41 = 6 UNION ALL SELECT k, 'target artifacts do not match its modules' FROM ok WHERE modules AND k % 43 = 8
  UNION ALL SELECT k, 'an artifact failed integrity verification' FROM ok WHERE modules AND (k % 47 = 9 OR k % 53 = 10)
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "saved_fleet_problems": f"WITH {SAVED} SELECT target, module_id, problem, count(*) AS n FROM p GROUP BY ALL",
        "reuse_problems": f"WITH {REUSE} SELECT 'svc-' || k AS target, problem FROM p",
        "resumed_targets": """WITH o AS (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS seen, o_orderkey AS k FROM orders),
l AS (SELECT * FROM o WHERE o_orderstatus <> 'P' AND k % 5 <> 0 AND k % 211 <> 4 AND k % 197 <> 6 AND k % 193 <> 7 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY seen DESC, k DESC) = 1),
h AS (SELECT * FROM l WHERE seen + INTERVAL 700 DAY > (SELECT max(seen) FROM o) - INTERVAL 36 HOUR)
SELECT 'svc-' || c_custkey AS target, k AS attempt, CASE WHEN o_orderstatus = 'O' THEN 'not-go-module' WHEN o_orderstatus = 'F' THEN 'ok' END AS status, CASE WHEN k % 3 > 0 THEN 'c' || k WHEN k IS NOT NULL THEN '' END AS commit, CAST(seen AS DATE) AS scanned, k IS NULL AS to_do FROM customer LEFT JOIN h ON o_custkey = c_custkey""",
        "tree_hashes": "SELECT p_brand AS root, count(*) AS n_files, sha256(string_agg(path || chr(0) || sha256(p_name) || chr(10), '' ORDER BY path)) AS content_hash FROM (SELECT *, p_type || '/' || p_partkey || '.yaml' AS path FROM part) GROUP BY 1",
    }
