"""Registered queries over the adapter's facts, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, paths, symbols
from ..operators import candidates, compare, fleet, openapi, policy, specs, summary
from ..operators import classify as c
from ..operators.discovery import canonical_order, chains, expand
from ..sinks import render
from ..sinks.tables import written
from .adapter import CONFIG, METHOD, NOW, SHAPES, facts


def classified(spark: SparkSession, d: str, snapshot: int = 0) -> DataFrame:
    return c.classify(facts(spark, d, snapshot), CONFIG, SHAPES)


def shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SHAPES.items()), "symbol string, shape string")


def classify(spark: SparkSession, d: str) -> DataFrame:
    a = [F.col(f"auth.{k}").alias(k) for k in ("authStatus", "classificationBasis", "assurance", "enforcementAnalysis", "matchedEvidence", "confidence", "accepted")]
    return classified(spark, d).select(F.col("ord").alias("route_id"), "target", "method", "normalizedPath", *a, F.array_join("auth.tags", ",").alias("tags"))


def route_findings(spark: SparkSession, d: str) -> DataFrame:
    return c.findings_of(classified(spark, d)).select(F.col("ord").alias("route_id"), "ruleId", "severity", "fingerprint", "route")


def stale_config(spark: SparkSession, d: str) -> DataFrame:
    return c.stale_guards(facts(spark, d), CONFIG)


def stale_baseline(spark: SparkSession, d: str) -> DataFrame:
    return c.stale_baseline(classified(spark, d), CONFIG)


def verb_gaps(spark: SparkSession, d: str) -> DataFrame:
    return c.verb_gaps(classified(spark, d))


def policy_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return policy.evaluate(classified(spark, d), CONFIG, NOW).select(F.col("ord").alias("route_id"), "policyId", "route", "fingerprint")


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.summary(classified(spark, d), "target")


def finding_severities(spark: SparkSession, d: str) -> DataFrame:
    return c.findings_of(classified(spark, d), "target").groupBy("target", "severity").agg(F.count(F.lit(1)).alias("n"))


def gate(spark: SparkSession, d: str) -> DataFrame:
    routes = classified(spark, d)
    found = policy.evaluate(routes, CONFIG, NOW).select("ruleId", "policyId")
    return summary.gates(summary.summary(routes), found, compare.compare_routes(classified(spark, d, 1), routes), F.lit(True), ["public", "unknown", "attested-unresolved", "incomplete", "new", "regression", "policy", "policy:logged-first", "policy:none"], finding_diff(spark, d))


def report_diff(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_routes(classified(spark, d, 1), classified(spark, d))


def finding_diff(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_findings(c.findings_of(classified(spark, d, 1)), c.findings_of(classified(spark, d)))


def suggested(spark: SparkSession, d: str) -> DataFrame:
    return candidates.suggest(facts(spark, d), shapes(spark), "target")


def suggest_auth(spark: SparkSession, d: str) -> DataFrame:
    return suggested(spark, d).select("target", "id", "symbol", "route_count", "total_routes", "applies_to_all", "name_hint", "known_non_auth", "shape", F.array_join("samples", ",").alias("samples"), "fingerprint", F.col("rank").cast("long").alias("rank"))


def bundle_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.bundle(suggested(spark, d), "target")
    return rows.join(candidates.opaque_entries(facts(spark, d), "target"), "target")


def import_review(spark: SparkSession, d: str) -> DataFrame:
    own = candidates.suggest(facts(spark, d), shapes(spark))
    return candidates.import_review(own).select("symbol", "assurance")


def fleet_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates.fleet_candidates(suggested(spark, d))
    return rows.select("symbol", "route_count", "repo_count", "name_hint", "known_non_auth", "shape", F.array_join("repos", ",").alias("repos"), F.array_join("samples", ",").alias("samples"), F.col("rank").cast("long").alias("rank"))


def spec_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Specifications that document other paths than the code has, some operations twice."""
    specs_ = spark.createDataFrame([("s1", "authored"), ("s2", "generated"), ("s3", "unknown")], "spec_id string, authorship string")
    events = spark.read.parquet(f"{d}/events.parquet")
    k, method = F.get_json_object("props", "$.k").cast("long") % 25, F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in METHOD.items() for x in kv)), F.col("event_type")), F.lit("DELETE"))
    ops = events.select(F.concat(F.lit("s"), ((k + F.col("user_id") % 2) % 3 + 1).cast("string")).alias("spec_id"), F.when(k % 2 == 0, method).otherwise(F.lower(method)).alias("method"), F.concat(F.lit("/api/v1/r"), (k + 2).cast("string")).alias("path"))
    return specs_, ops.distinct()


def spec_reconcile(spark: SparkSession, d: str) -> DataFrame:
    specs_, ops = spec_tables(spark, d)
    return specs.reconcile(facts(spark, d), ops, specs_)


def spec_coverage(spark: SparkSession, d: str) -> DataFrame:
    return specs.documentation(spec_reconcile(spark, d))


def module_rows(routes: DataFrame, snapshot: int = 0) -> DataFrame:
    rows = summary.summary(routes, "target", "module_id")
    failed = F.concat("target", "module_id") == ("repo-1mod-2" if snapshot == 0 else "repo-2mod-0")
    late = F.concat("target", "module_id") == "repo-3mod-1"
    return rows.select("target", "module_id", F.when(F.col("module_id") == "mod-2", "go-module").otherwise("gin-application").alias("kind"), F.when(failed, "failed").otherwise("ok").alias("status"), (~late).alias("complete"), "routes", "proven", "public", "unknown")


def fleet_rollup(spark: SparkSession, d: str) -> DataFrame:
    return fleet.roll_up(module_rows(classified(spark, d)))


def fleet_totals(spark: SparkSession, d: str) -> DataFrame:
    return fleet.totals(fleet_rollup(spark, d))


def fleet_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot is classified and written once; what is read again are its columns for counts, keys and findings."""
    text = F.lit(None).cast("string")
    names = F.transform("middleware", lambda m: F.struct(m["displayName"].alias("displayName"))).alias("middleware")
    rules = F.transform("route_findings", lambda f: F.struct(f["ruleId"].alias("ruleId"), f["severity"].alias("severity"), text.alias("detail"), text.alias("recommendation"))).alias("route_findings")
    before, now = (written(classified(spark, d, s).select("target", "module_id", "ord", "method", "normalizedPath", names, text.alias("source"), "auth", rules), f"snapshot-{s}") for s in (1, 0))
    old, new = module_rows(before, 1), module_rows(now).where("target <> 'repo-4' or module_id <> 'mod-1'")
    return fleet.compare(old, new, before, now)


def repo_listing(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    name = F.concat(F.lit("svc-"), (k % 97).cast("string"), F.when(k % 31 == 0, F.lit("..x")).otherwise(""))
    return p.select(k.alias("ord"), name.alias("name"), F.concat(F.when(k % 2 == 0, F.lit("Acme/")).otherwise("acme/"), name, (k % 5).cast("string")).alias("full_name"), (k % 11 == 0).alias("disabled"), (k % 13).alias("size"), (k % 7 == 0).alias("archived"), (k % 9 == 0).alias("fork"), F.when(k % 17 != 0, "https://example.org/r.git").alias("clone_url"))


def org_dispositions(spark: SparkSession, d: str) -> DataFrame:
    return fleet.dispositions(repo_listing(spark, d), include=["svc-[1-8]*"], exclude=["*/svc-4?*"], archived=False, forks=False, most=60)


def disposition_tally(spark: SparkSession, d: str) -> DataFrame:
    return fleet.tally(org_dispositions(spark, d))


def openapi_operations(spark: SparkSession, d: str) -> DataFrame:
    routes = classified(spark, d).withColumn("ginPath", F.regexp_replace("ginPath", r"/r(\d)$", "/:r/$1"))
    rows = openapi.with_ids(openapi.operations(routes, CONFIG, "target"), routes, "target")
    return rows.select("target", "path", "method", F.col("ord").alias("first_id"), "registrations", "diagnostic", "tag", F.array_join("parameters", ",").alias("parameters"), "catch_all", "security", "operation_id")


def route_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path and glob functions over the addresses of pages."""
    p = F.coalesce(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), F.lit(""))
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", p.alias("path"))
    return rows.select("page_id", paths.normalize_path(F.col("path")).alias("normalized"), globs.glob_match(F.col("path"), "**/*1*").alias("has_one"), globs.glob_match(F.col("path"), "/*/*").alias("two_deep"), paths.tag_for(F.col("path")).alias("tag"))


def symbol_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).select(F.col("ord").alias("route_id"), F.explode("middleware").alias("m")).select("route_id", F.col("m.orderingIndex").alias("at"), F.col("m.canonicalSymbol").alias("symbol"))
    return rows.select("route_id", "at", symbols.package_of(F.col("symbol")).alias("package"), symbols.name_hint(F.col("symbol")).alias("hint"), symbols.candidate_id(F.col("symbol")).alias("id"))


def method_expansion(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("direct", "any", "match", "static", "static-file"))), (F.col("ord") % 5 + 1).cast("int"))
    rows = facts(spark, d).select(F.col("ord").alias("route_id"), "method", F.col("ginPath").alias("path"), kind.alias("registration"), F.array("method", F.lit("OPTIONS")).alias("methods"))
    return expand(rows).select("route_id", "method", "normalizedPath")


def chain_events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_id") % 10 == 0, "use").when(F.col("event_id") % 97 == 0, "fallback").otherwise("route")
    rows = e.select((F.col("user_id")).cast("string").alias("scope"), F.col("event_id").alias("ord"), kind.alias("kind"), F.concat(F.lit("acme/mw.M"), (F.col("event_id") % 7).cast("string")).alias("symbol"))
    return chains(rows).select("ord", F.array_join("chain", ",").alias("chain"))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    return canonical_order(facts(spark, d), "target").select("target", F.col("ord").alias("at"), F.col("source.line").cast("long").alias("route_id"))


def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    rows = render.sarif_results(c.findings_of(classified(spark, d)))
    return rows.select("at.fingerprint", F.col("at.severity").cast("long").alias("severity_rank"), F.get_json_object("result", "$.level").alias("level"), F.get_json_object("result", "$.ruleId").alias("rule"))


def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.markdown_routes(classified(spark, d)).withColumnRenamed("ord", "route_id")


ALL = (classify, route_findings, stale_config, stale_baseline, verb_gaps, policy_evaluate, report_summary, finding_severities, gate, report_diff, finding_diff, suggest_auth, bundle_fingerprint, import_review, fleet_candidates, spec_reconcile, spec_coverage, fleet_rollup, fleet_totals, fleet_delta, org_dispositions, disposition_tally, openapi_operations, route_paths, symbol_functions, method_expansion, chain_events, report_order, sarif_results, markdown_lines)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
