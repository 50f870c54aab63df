"""Comparison of two classified snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import route_key
from ..functions.symbols import ordered_difference, same_multiset, schema_major


def risk(status: Column) -> Column:
    return F.when(status == "proven", 0).when(status == "unknown", 1).when(status == "public", 2)


def riskiest(routes: DataFrame, *by: str) -> DataFrame:
    """A row for each route key (within `by`): the riskiest; ties keep the first; no classification counts as no risk.

    One aggregate with map-side combining (the key's maximum by risk and reversed place).
    """
    names = F.transform("middleware", lambda m: m["displayName"])
    rows = routes.select(*by, route_key(F.col("method"), F.col("normalizedPath")).alias("route"), "method", "normalizedPath", F.coalesce(risk(F.col("auth.authStatus")), F.lit(0)).alias("risk"), "ord", "auth", names.alias("chain"))
    best = F.max_by(F.struct("method", "normalizedPath", "auth", "chain"), F.struct("risk", -F.col("ord")))
    return rows.groupBy(*by, "route").agg(best.alias("r")).select(*by, "route", "r.*")


#: What a changed classification is put down to (fixed output values).
EXPLANATIONS = {
    "tags lost": "Recognized auth tag(s) removed",
    "tags won": "Recognized auth tag(s) added",
    "grants lost": "Authorization grant(s) removed",
    "grants won": "Authorization grant(s) added",
    "chain": "Middleware removed from the route chain",
    "unconfirmed": "The route is now guarded only by middleware whose enforcement could not be confirmed.",
    "order": "The middleware chain order changed alongside the authentication classification.",
    "other": "Authentication classification changed without a visible route-level middleware difference; check authMiddleware configuration or shared mount wiring.",
}


def explanation(b: str, a: str) -> Column:
    """Why the classification changed, most telling first."""

    def diff(field: str, x: str, y: str) -> Column:
        return ordered_difference(F.col(f"{x}.auth.{field}"), F.col(f"{y}.auth.{field}"))

    lists = {
        "tags lost": diff("tags", b, a),
        "tags won": diff("tags", a, b),
        "grants lost": F.concat(diff("roles", b, a), diff("scopes", b, a)),
        "grants won": F.concat(diff("roles", a, b), diff("scopes", a, b)),
        "chain": ordered_difference(F.col(f"{b}.chain"), F.col(f"{a}.chain")),
    }
    was, now = F.col(f"{b}.auth.authStatus"), F.col(f"{a}.auth.authStatus")
    listed = [F.when(F.size(v) > 0, F.concat(F.lit(EXPLANATIONS[k] + ": "), F.array_join(v, ", "), F.lit("."))) for k, v in lists.items()]
    moved = same_multiset(F.col(f"{b}.chain"), F.col(f"{a}.chain")) & (F.col(f"{b}.chain") != F.col(f"{a}.chain"))
    plain = F.when((now == "unknown") & F.coalesce(was != "unknown", F.lit(True)), EXPLANATIONS["unconfirmed"]).when(moved, EXPLANATIONS["order"]).otherwise(EXPLANATIONS["other"])
    return F.coalesce(*listed, plain)


def compare_routes(baseline: DataFrame, current: DataFrame, *by: str) -> DataFrame:
    """route, change (added, removed, regression, improvement), from, to, explanation: one full outer join on the key.

    With `by` (module, target) keys meet only within it, and its columns come first.
    """
    side = lambda df, name: riskiest(df, *by).select(*by, "route", F.struct("auth", "chain").alias(name))
    rows = side(baseline, "b").join(side(current, "a"), [*by, "route"], "full_outer")
    old, new = risk(F.col("b.auth.authStatus")), risk(F.col("a.auth.authStatus"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(new > old, "regression").when(new < old, "improvement")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    return rows.select(*by, "route", change.alias("change"), F.when(both, F.col("b.auth.authStatus")).alias("from"), F.when(both, F.col("a.auth.authStatus")).alias("to"), F.when(both, explanation("b", "a")).alias("explanation")).where("change is not null")


def compare_findings(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """fingerprint, change (new, resolved): one aggregate that reads each side once. Fingerprints are never null."""
    sides = baseline.select("fingerprint", F.lit(False).alias("now")).unionByName(current.select("fingerprint", F.lit(True).alias("now")))
    found = sides.groupBy("fingerprint").agg(F.bool_or("now").alias("new"), F.bool_and("now").alias("only"))
    return found.where("not new or only").select("fingerprint", F.when(F.col("new"), "new").otherwise("resolved").alias("change"))


def incompatibilities(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Reasons why two report envelopes (one row each: schemaVersion, command, analysisProfile, buildContext) can't be compared."""
    b, a = baseline.limit(1).select(F.struct("*").alias("b")), current.limit(1).select(F.struct("*").alias("a"))
    both = b.withColumn("one", F.lit(1)).join(a.withColumn("one", F.lit(1)), "one")
    return incompatible(both).select("reason")


def incompatible(pairs: DataFrame) -> DataFrame:
    """`pairs` (heads of reports in the structs `b` and `a`) with `reason`, a row for each in which they can't be compared."""
    major = schema_major(F.col("b.schemaVersion")).eqNullSafe(schema_major(F.col("a.schemaVersion"))) & schema_major(F.col("a.schemaVersion")).isNotNull()
    reasons = F.array(
        F.when(~major, "schema version"),
        F.when((F.col("b.command") != "audit") | (F.col("a.command") != "audit"), "command"),
        F.when(~F.col("b.analysisProfile").eqNullSafe(F.col("a.analysisProfile")), "analysis profile"),
        F.when(~F.col("b.buildContext").eqNullSafe(F.col("a.buildContext")), "build context"),
    )
    return pairs.select("*", F.explode(F.array_compact(reasons)).alias("reason"))
