"""Policies compiled to one boolean column each; evaluating any number of them is one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import any_glob
from ..functions.paths import route_key
from ..functions.symbols import exception_active, fingerprint, package_of
from .classify import strings
from .config import Config, Requirement, Selector


def sure(c: Column) -> Column:
    """Unknown is false, before anything negates it."""
    return F.coalesce(c, F.lit(False))


def symbols() -> Column:
    return F.filter(F.transform("middleware", lambda m: m["canonicalSymbol"]), lambda s: s.isNotNull())


def overlap(have: Column, want) -> Column:
    return sure(F.arrays_overlap(have, strings(want)))


def holds_all(have: Column, want) -> Column:
    return sure(F.size(F.array_except(strings(want), have)) == 0)


def everything(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def selects(s: Selector) -> Column:
    """Methods compare without case; packages by plain prefix, over the final handler's and the chain's symbols."""
    packages = F.transform(F.concat(F.filter(F.array("finalHandler.canonicalSymbol"), lambda x: x.isNotNull()), symbols()), package_of)
    parts = []
    if s.method:
        parts.append(sure(F.upper("method").isin(*(m.upper() for m in s.method))))
    if s.path:
        parts.append(any_glob(F.col("normalizedPath"), list(s.path)))
    if s.status:
        parts.append(sure(F.col("auth.authStatus").isin(*s.status)))
    for values, name in ((s.tag, "tags"), (s.role, "roles"), (s.scope, "scopes")):
        if values:
            parts.append(overlap(F.col(f"auth.{name}"), values))
    if s.package:
        parts.append(sure(F.exists(packages, lambda p: F.exists(strings(s.package), lambda w: p.startswith(w)))))
    if s.surfaceKind:
        parts.append(sure(F.col("surfaceKind").isin(*s.surfaceKind)))
    return everything(parts)


def in_order(want: tuple[str, ...]) -> Column:
    """Each symbol is on the chain, further on than the one before; of a symbol that repeats, the last place counts."""

    def place(s: Column) -> Column:
        return F.array_max(F.transform(F.filter("middleware", lambda m: m["canonicalSymbol"] == s), lambda m: m["orderingIndex"]))

    end = F.aggregate(strings(want), F.lit(-1), lambda last, s: F.when(last.isNull() | place(s).isNull() | (place(s) <= last), F.lit(None).cast("int")).otherwise(place(s)))
    return end.isNotNull()


def satisfied(r: Requirement) -> Column:
    parts = []
    if r.status:
        parts.append(sure(F.col("auth.authStatus").isin(*r.status)))
    if r.middlewareAny:
        parts.append(overlap(symbols(), r.middlewareAny))
    if r.middlewarePresent:
        parts.append(holds_all(symbols(), r.middlewarePresent))
    if r.middlewareAbsent:
        parts.append(~overlap(symbols(), r.middlewareAbsent))
    if r.middlewareOrder:
        parts.append(in_order(r.middlewareOrder))
    if r.anyTag:
        parts.append(overlap(F.col("auth.tags"), r.anyTag))
    if r.allTags:
        parts.append(holds_all(F.coalesce("auth.tags", F.array().cast("array<string>")), r.allTags))
    if r.anyRole:
        parts.append(overlap(F.col("auth.roles"), r.anyRole))
    if r.anyScope:
        parts.append(overlap(F.col("auth.scopes"), r.anyScope))
    parts += map(satisfied, r.all)
    if r.any:
        one = F.lit(False)
        for x in r.any:
            one = one | satisfied(x)
        parts.append(one)
    if r.not_:
        parts.append(~satisfied(r.not_))
    return everything(parts)


def evaluate(routes: DataFrame, config: Config, now: str, *keep: str) -> DataFrame:
    """Violations (keep, ord, policy_ord, policyId, route, ruleId, severity, fingerprint): selected, not satisfied, not exempt.

    A route that violates several policies gives a row for each; equal keys give repeated rows. `now` decides expiry.
    """
    checks = []
    for i, p in enumerate(config.policies):
        exempt = F.lit(False)
        for e in p.exceptions:
            exempt = exempt | (exception_active(F.lit(e.expires), now) & selects(e.match))
        checks.append(F.when(selects(p.match) & ~satisfied(p.require) & ~exempt, F.struct(F.lit(i).alias("policy_ord"), F.lit(p.id).alias("policyId"))))
    violated = F.array(*checks) if checks else F.array().cast("array<struct<policy_ord:int,policyId:string>>")
    rows = routes.select(*keep, "ord", route_key(F.col("method"), F.col("normalizedPath")).alias("route"), "source", F.explode_outer(violated).alias("v")).where("v is not null")
    return rows.select(*keep, "ord", "v.policy_ord", "v.policyId", "route", "source", F.lit("policy-violation").alias("ruleId"), F.lit("high").alias("severity"), fingerprint(F.lit("policy-violation"), F.col("v.policyId"), F.col("route")).alias("fingerprint"))
