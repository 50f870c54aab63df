"""Summaries, scan coverage and gates of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import severity_rank

#: Diagnostics that make a scan incomplete (fixed values).
COVERAGE_CODES = ("gin-unresolved-path", "gin-unresolved-method", "gin-unresolved-methods", "gin-unresolved-handlers", "gin-no-handlers", "gin-unresolved-registrar", "gin-registrar-depth-exceeded", "gin-recursive-registrar", "gin-untracked-router-value", "gin-library-entry-point")


def summary(routes: DataFrame, *by: str) -> DataFrame:
    """Counts of routes by status, in one aggregate."""
    status = F.col("auth.authStatus")
    return routes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("routes"),
        *(F.count_if(F.coalesce(status == s, F.lit(False))).alias(s) for s in ("proven", "public", "unknown")),
        F.count_if(F.coalesce(F.col("auth.accepted"), F.lit(False))).alias("accepted_public"),
        F.count_if(F.coalesce(F.col("auth.classificationBasis") == "configured-guard-attested", F.lit(False))).alias("attested_unresolved"),
    )


def severities(findings: DataFrame, *by: str) -> DataFrame:
    """A map of findings by severity."""
    counts = findings.groupBy(*by, "severity").count()
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "count")))).alias("findingsBySeverity"))


def coverage(packages: DataFrame, diagnostics: DataFrame, *by: str, codes: tuple[str, ...] = COVERAGE_CODES) -> DataFrame:
    """Packages, files and completeness by report, of `packages` (files, errors, load_errors) and `diagnostics` (code).

    A package with errors has failed, with all its files. Complete: nothing failed, no load error, and no diagnostic
    of a code that leaves registrations unresolved.
    """
    bad = F.col("errors") > 0
    loaded = packages.groupBy(*by).agg(F.count(F.lit(1)).alias("discovered_packages"), F.count_if(bad).alias("failed_packages"), F.sum("files").alias("discovered_files"), F.sum(F.when(bad, F.col("files")).otherwise(0)).alias("failed_files"), F.coalesce(F.sum("load_errors"), F.lit(0)).alias("load_errors"))
    touched = diagnostics.groupBy(*by).agg(F.count_if(F.col("code").isin(*codes)).alias("unresolved_registrations"))
    rows = (loaded.join(touched, list(by), "left") if by else loaded.join(touched)).na.fill(0, ["unresolved_registrations"])
    return rows.withColumn("complete", (F.col("failed_packages") == 0) & (F.col("load_errors") == 0) & (F.col("unresolved_registrations") == 0))


def engine_findings(engines: DataFrame) -> DataFrame:
    """Engines (engine, mode, trusted array) set to trust every proxy or to debug mode; what was not set or not resolved (null) is no finding."""
    everyone = F.exists("trusted", lambda c: c.isin("0.0.0.0/0", "::/0"))
    rules = F.array(F.when(everyone, F.struct(F.lit("trust-all-proxies").alias("ruleId"), F.lit("medium").alias("severity"))), F.when(F.col("mode") == "debug", F.struct(F.lit("debug-mode").alias("ruleId"), F.lit("low").alias("severity"))))
    return engines.select("engine", F.explode(F.array_compact(rules)).alias("f")).select("engine", "f.*")


def gates(summary_row: DataFrame, findings: DataFrame, delta: DataFrame | None, complete: Column, conditions: list[str], new_findings: DataFrame | None = None) -> DataFrame:
    """gate, matched for each condition: public, unknown, attested-unresolved, incomplete, new, regression, policy, policy:ID."""
    wanted = [c.removeprefix("policy:") for c in conditions if c.startswith("policy:")]
    hits = findings.agg(F.count_if(F.col("ruleId") == "policy-violation").alias("policy"), *(F.count_if((F.col("ruleId") == "policy-violation") & (F.col("policyId") == w)).alias(f"policy_{i}") for i, w in enumerate(wanted)))
    rows = summary_row.crossJoin(hits)  # one row each
    if delta is not None:
        rows = rows.crossJoin(delta.agg(F.count_if(F.col("change") == "added").alias("new"), F.count_if(F.col("change") == "regression").alias("regression")))
    else:
        rows = rows.withColumns({"new": F.lit(0), "regression": F.lit(0)})
    if new_findings is not None:
        rows = rows.crossJoin(new_findings.agg(F.count_if(F.col("change") == "new").alias("found")))
    else:
        rows = rows.withColumn("found", F.lit(0))
    tests = {"public": F.col("public") > 0, "unknown": F.col("unknown") > 0, "attested-unresolved": F.col("attested_unresolved") > 0, "incomplete": ~complete, "new": F.col("new") + F.col("found") > 0, "regression": F.col("regression") > 0, "policy": F.col("policy") > 0}
    tests |= {f"policy:{w}": F.col(f"policy_{i}") > 0 for i, w in enumerate(wanted)}
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("gate"), tests[c].alias("matched")) for c in conditions))).alias("g")).select("g.*")


def ordered(findings: DataFrame) -> DataFrame:
    """Severity first, then fingerprint."""
    return findings.orderBy(severity_rank(F.col("severity")), "fingerprint")
