"""The commands: inventory, audit, suggest_auth, import_review, fleet, render, schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, classify, compare, discovery, fleet as fleets, openapi, policy, specs, summary
from ..operators.config import Config
from ..schema import BUILD_CONTEXT
from ..sinks import render as sinks


@dataclass
class Audit:
    routes: DataFrame
    findings: DataFrame
    engine_findings: DataFrame | None
    violations: DataFrame
    stale_guards: DataFrame
    stale_baseline: DataFrame
    verb_gaps: DataFrame
    summary: DataFrame
    coverage: DataFrame | None
    delta: DataFrame | None
    new_findings: DataFrame | None
    gates: DataFrame | None


def inventory(evidence: DataFrame, *by: str) -> DataFrame:
    """Routes in canonical order (of each report, with `by`), without classification."""
    return discovery.canonical_order(evidence.drop("auth"), *by)


def audit(
    evidence: DataFrame, config: Config, now: str, shapes: dict[str, str] | None = None, baseline: DataFrame | None = None, syntax_only: bool = False, *,
    engines: DataFrame | None = None, packages: DataFrame | None = None, diagnostics: DataFrame | None = None, envelopes: tuple[DataFrame, DataFrame] | None = None, fail_on: list[str] = (),
) -> Audit:
    """Classified routes and everything found about them.

    `baseline`: classified routes of an earlier audit; `envelopes`: the heads of both reports, which must be
    comparable before anything is compared. `packages` and `diagnostics` give the scan's coverage, `fail_on` the gates.
    """
    if envelopes is not None and (reasons := [r["reason"] for r in compare.incompatibilities(*envelopes).collect()]):
        raise ValueError(f"the baseline can't be compared: {', '.join(reasons)} differ")
    routes = classify.classify(evidence, config, shapes)
    found, violations, counts = classify.findings_of(routes), policy.evaluate(routes, config, now), summary.summary(routes)
    coverage = None if packages is None else summary.coverage(packages, diagnostics if diagnostics is not None else packages.limit(0).selectExpr("'' code"))
    delta = None if baseline is None else compare.compare_routes(baseline, routes)
    new = None if baseline is None else compare.compare_findings(classify.findings_of(baseline), found)
    complete = F.lit(True) if coverage is None else F.col("complete")
    gates = summary.gates(counts if coverage is None else counts.crossJoin(coverage.select("complete")), violations.select("ruleId", "policyId"), delta, complete, list(fail_on), new) if fail_on else None
    return Audit(
        routes,
        found,
        None if engines is None else summary.engine_findings(engines),
        violations,
        classify.stale_guards(routes, config, syntax_only),
        classify.stale_baseline(routes, config),
        classify.verb_gaps(routes),
        counts,
        coverage,
        delta,
        new,
        gates,
    )


def suggest_auth(evidence: DataFrame, shapes: DataFrame, *by: str) -> DataFrame:
    return candidates.suggest(evidence, shapes, *by)


def import_review(suggested: DataFrame, decisions: DataFrame | None = None, assessed: str | None = None) -> DataFrame:
    return candidates.import_review(suggested, decisions, assessed)


@dataclass
class Fleet:
    targets: DataFrame
    totals: DataFrame
    groups: DataFrame
    delta: DataFrame | None = None
    delta_summary: DataFrame | None = None


def fleet(modules: DataFrame, routes: DataFrame | None = None, baseline: tuple[DataFrame, DataFrame] | None = None, heads: tuple[DataFrame, DataFrame] | None = None) -> Fleet:
    """Roll-up, totals and groups of module rows; with `baseline` (module rows, classified routes) also what changed.

    `heads`: one row of fingerprints for the baseline and for this run; where they differ nothing is compared.
    """
    targets = fleets.roll_up(modules)
    out = Fleet(targets, fleets.totals(targets), fleets.groups(targets))
    if baseline is not None:
        if heads is not None and (kinds := [r["kind"] for r in fleets.mismatches(*heads).collect()]):
            raise ValueError(f"the {' and '.join(kinds)} fingerprint does not match the current run")
        out.delta = fleets.compare(baseline[0], modules, baseline[1], routes)
        out.delta_summary = fleets.delta_summary(out.delta)
    return out


def documentation(routes: DataFrame, spec_ops: DataFrame, spec_rows: DataFrame, *by: str) -> DataFrame:
    return specs.documentation(specs.reconcile(routes, spec_ops, spec_rows, *by), *by)


def render(routes: DataFrame, findings: DataFrame, config: Config, form: str, title: str = "routes") -> str:
    """A saved audit as json, pretty, markdown, sarif, openapi or html text."""
    if form == "openapi":
        return sinks.openapi(openapi.with_ids(openapi.operations(routes, config), routes), title)
    if form == "json":
        target = F.struct(F.lit(title).alias("module"), F.lit(None).cast(BUILD_CONTEXT).alias("buildContext"))
        return sinks.one(sinks.reports_json(routes, findings, target, policies=tuple(p.id for p in config.policies)), "report")
    return {"pretty": lambda: sinks.pretty(routes, findings=findings), "markdown": lambda: sinks.markdown(routes, title, findings=findings), "sarif": lambda: sinks.sarif(findings), "html": lambda: sinks.html(routes, title)}[form]()


def schema(kind: str) -> str:
    return sinks.schema(kind)
