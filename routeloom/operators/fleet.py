"""Many repositories: roll-ups of modules and targets, groups, deltas, selection, and re-use of earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import any_glob
from ..functions.symbols import valid_target_name
from .classify import findings_of
from .compare import compare_routes

COUNTS = ("routes", "proven", "public", "unknown")


def roll_up(modules: DataFrame) -> DataFrame:
    """Targets of `modules` (target, module_id, kind, status, complete, counts): sums, status, completeness, category.

    failed: a module with routes in view (kind gin-application or gin-module-no-routes) failed, or none succeeded.
    """
    gin = F.col("kind").isin("gin-application", "gin-module-no-routes")
    good = F.col("status") == "ok"
    rows = modules.groupBy("target").agg(
        F.count(F.lit(1)).alias("modules"),
        *(F.sum(c).alias(c) for c in COUNTS),
        F.count_if(gin & (F.col("status") == "failed")).alias("broken"),
        F.count_if(good).alias("succeeded"),
        F.bool_and(good & F.col("complete")).alias("complete"),
        F.bool_or(gin).alias("any_gin"),
        F.bool_and(good & F.col("complete") & (gin | (F.col("kind") == "go-module"))).alias("verified"),
    )
    rows = rows.withColumn("status", F.when((F.col("broken") > 0) | (F.col("succeeded") == 0), "failed").otherwise("ok"))
    return rows.withColumn("category", category(F.col("routes"), F.col("status"), F.col("complete"), F.col("modules"), F.col("verified"), F.col("any_gin"))).drop("broken", "succeeded")


def category(routes: Column, status: Column, complete: Column, modules: Column, verified: Column, any_gin: Column) -> Column:
    return (
        F.when(routes > 0, "gin-routes")
        .when(status == "failed", "failed")
        .when(status == "not-go-module", F.when(complete, "not-go-module").otherwise("inconclusive"))
        .when(status != "ok", "inconclusive")
        .when(~complete | (F.coalesce(modules, F.lit(0)) == 0) | ~F.coalesce(verified, F.lit(False)), "no-routes-unverified")
        .when(any_gin, "gin-no-routes")
        .otherwise("non-gin")
    )


def totals(targets: DataFrame) -> DataFrame:
    """One row over all targets: sums, targets by status, completeness; with a column `specifications` (documents found) also theirs."""
    status = {"succeeded": "ok", "failed": "failed", "inconclusive": "inconclusive", "not_go_module": "not-go-module"}
    whole = F.col("complete") & ~F.col("status").isin("failed", "inconclusive")
    specs = [F.coalesce(F.sum("specifications"), F.lit(0)).alias("specifications"), F.count_if(F.col("specifications") > 0).alias("repositories_with_specifications")] if "specifications" in targets.columns else []
    return targets.agg(F.count(F.lit(1)).alias("targets"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), *(F.count_if(F.col("status") == v).alias(k) for k, v in status.items()), F.coalesce(F.bool_and(whole), F.lit(True)).alias("complete"), *specs)


def mismatches(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """kind of each fingerprint (scope, scan) in which two fleets (one row each: scope_fingerprint, scan_fingerprint) differ.

    Fleets that differ can't be compared; where neither has a fingerprint there is nothing to differ in.
    """
    b, a = (df.limit(1).select(F.struct("scope_fingerprint", "scan_fingerprint").alias(k)) for df, k in ((baseline, "b"), (current, "a")))
    both = b.withColumn("one", F.lit(1)).join(a.withColumn("one", F.lit(1)), "one")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    kinds = [F.when(empty(f"b.{k}_fingerprint") != empty(f"a.{k}_fingerprint"), k) for k in ("scope", "scan")]
    return both.select(F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def groups(targets: DataFrame) -> DataFrame:
    """name, category of each repository, those with routes first, then by name."""
    return targets.select(F.col("target").alias("name"), "category").orderBy((F.col("category") != "gin-routes"), "name")


def target_delta(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """target, status and whether it can be compared, of target rows (target, status, complete). First match wins."""
    b, a = baseline.select("target", F.col("status").alias("b_status"), F.col("complete").alias("b_complete")), current.select("target", F.col("status").alias("a_status"), F.col("complete").alias("a_complete"))
    rows = b.join(a, "target", "full_outer")
    status = (
        F.when(F.col("a_status").isNull(), "removed-target")
        .when(F.col("b_status").isNull(), "added-target")
        .when(F.col("b_status") != F.col("a_status"), "status-changed")
        .when(F.col("b_status") != "ok", "unchanged")
        .when(~F.col("b_complete") | ~F.col("a_complete"), "incomparable")
    )
    return rows.select("target", status.alias("status"))


def module_delta(baseline: DataFrame, current: DataFrame, routes: DataFrame, findings: DataFrame) -> DataFrame:
    """Modules of targets that go on to be compared (target, module_id, status, complete, routes on both sides).

    `routes`: (target, module_id, added, removed, regressions, improvements) and `findings`: (target, module_id,
    new, resolved) of report pairs that could be read and compared. An added module adds its routes.
    """
    b = baseline.select("target", "module_id", F.col("status").alias("b_status"), F.col("complete").alias("b_complete"), F.col("routes").alias("b_routes"))
    a = current.select("target", "module_id", F.col("status").alias("a_status"), F.col("complete").alias("a_complete"), F.col("routes").alias("a_routes"))
    key = ["target", "module_id"]
    rows = b.join(a, key, "full_outer").join(routes, key, "left").join(findings, key, "left")
    status = (
        F.when(F.col("b_status").isNull(), "added-module")
        .when(F.col("a_status").isNull(), "removed-module")
        .when(F.col("b_status") != F.col("a_status"), "status-changed")
        .when((F.col("b_status") != "ok") | ~F.col("b_complete") | ~F.col("a_complete") | F.col("added").isNull(), "incomparable")
        .otherwise("unchanged")
    )
    rows = rows.withColumn("status", status)
    same = F.col("status") == "unchanged"

    def n(c: str) -> Column:
        return F.when(same, F.coalesce(c, F.lit(0))).otherwise(0)

    return rows.select(
        *key,
        "status",
        (n("added") + F.when(F.col("status") == "added-module", F.col("a_routes")).otherwise(0)).alias("added_routes"),
        (n("removed") + F.when(F.col("status") == "removed-module", F.col("b_routes")).otherwise(0)).alias("removed_routes"),
        n("regressions").alias("regressions"),
        n("improvements").alias("improvements"),
        n("new").alias("new_findings"),
        n("resolved").alias("resolved_findings"),
    )


def fleet_delta(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """target, status after its modules are seen, and sums; a target whose status is decided adds nothing."""
    open_ = targets.where("status is null").select("target")
    sums = modules.join(open_, "target", "left_semi").groupBy("target").agg(
        *(F.sum(c).alias(c) for c in ("added_routes", "removed_routes", "regressions", "improvements", "new_findings", "resolved_findings")),
        F.bool_or(F.col("status").isin("status-changed", "incomparable")).alias("blocked"),
    )
    rows = targets.join(sums, "target", "left")
    status = F.coalesce("status", F.when(F.col("blocked"), "incomparable").otherwise("unchanged"))
    return rows.select("target", status.alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("added_routes", "removed_routes", "regressions", "improvements", "new_findings", "resolved_findings")))


def compare(old: DataFrame, new: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """fleet_delta() of two fleets: module rows (as for roll_up) and classified routes (with target, module_id) of each.

    Route keys and findings meet within their module only; both sides are reduced to a row for each key first.
    """
    key = ["target", "module_id"]
    counted = {"added": "added", "removed": "removed", "regression": "regressions", "improvement": "improvements"}
    diff = compare_routes(baseline, current, *key).groupBy(*key).agg(*(F.count_if(F.col("change") == k).alias(v) for k, v in counted.items()))
    both = old.select(key).join(new.select(key), key)
    diff = both.join(diff, key, "left").na.fill(0, [*counted.values()])
    prints = lambda routes, name: findings_of(routes, *key).select(*key, "fingerprint").distinct().withColumn(name, F.lit(1))
    found = prints(baseline, "was").join(prints(current, "is_now"), [*key, "fingerprint"], "full_outer").groupBy(*key).agg(F.count_if(F.col("was").isNull()).alias("new"), F.count_if(F.col("is_now").isNull()).alias("resolved"))
    return fleet_delta(target_delta(roll_up(old), roll_up(new)), module_delta(old, new, diff, found))


def delta_summary(delta: DataFrame) -> DataFrame:
    """One row: targets by status and all sums; complete unless something could not be compared."""
    kinds = {"added_targets": "added-target", "removed_targets": "removed-target", "status_changes": "status-changed"}
    loose = F.col("status").isin("incomparable", "status-changed")
    return delta.agg(*(F.count_if(F.col("status") == v).alias(k) for k, v in kinds.items()), F.count_if(loose).alias("incomparable_targets"), *(F.sum(c).alias(c) for c in ("added_routes", "removed_routes", "regressions", "improvements", "new_findings", "resolved_findings")), F.coalesce(~F.bool_or(loose), F.lit(True)).alias("complete"))


def dispositions(repos: DataFrame, include: list[str] = (), exclude: list[str] = (), archived: bool = True, forks: bool = True, most: int | None = None) -> DataFrame:
    """full_name, ord, status, reason of listed repositories; of equal names (without case) the first counts.

    `most` selected repositories at most, in listing order: a feature of the selection, later ones are `capped`.
    The running count goes over per-range sums, so no task holds the whole listing.
    """
    seen = Window.partitionBy(F.lower("full_name")).orderBy("ord")
    rows = repos.withColumn("again", F.row_number().over(seen) > 1)
    hit = lambda globs: any_glob(F.col("name"), list(globs)) | any_glob(F.col("full_name"), list(globs))
    reason = (
        F.when(F.col("again"), "duplicate API entry")
        .when(F.col("disabled"), "repository is disabled")
        .when(F.col("size") == 0, "repository is empty")
        .when(F.col("archived") & F.lit(not archived), "archived repositories were excluded")
        .when(F.col("fork") & F.lit(not forks), "forks were excluded")
        .when(F.lit(bool(include)) & ~hit(include), "repository did not match --repo-include")
        .when(hit(exclude), "repository matched --repo-exclude")
        .when(~valid_target_name(F.col("name")), "repository name is not a safe fleet target name")
        .when(F.coalesce("clone_url", F.lit("")) == "", "repository lacks clone URL")
        .otherwise("")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason") == "", "selected").when(F.col("reason").like("repository %match%"), "filtered").otherwise("skipped")
    rows = rows.withColumn("status", status)
    if most is not None:
        chosen = F.col("status") == "selected"
        rows = rows.withColumn("part", F.floor(F.col("ord") / 4096))
        before = rows.groupBy("part").agg(F.count_if(chosen).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        own = F.count_if(chosen).over(Window.partitionBy("part").orderBy("ord"))
        rows = rows.withColumn("own", own).join(before, "part")
        over = chosen & (F.col("before") + F.col("own") > most)
        rows = rows.withColumns({"status": F.when(over, "capped").otherwise(F.col("status")), "reason": F.when(over, F.lit(f"selected repository cap {most} reached")).otherwise(F.col("reason"))})
    return rows.select("full_name", "ord", "status", "reason")


def manifest_order(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """`results` (name) with `ord`, their place in `manifest` (name, ord); those it lacks come first, as place 0."""
    return results.join(manifest.select("name", "ord"), "name", "left").withColumn("ord", F.coalesce("ord", F.lit(0)))


def tally(dispositions_: DataFrame) -> DataFrame:
    return dispositions_.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status", "reason")


def reusable(earlier: DataFrame, current: DataFrame) -> DataFrame:
    """Targets of `current` (target, pushedAt, fingerprint) whose earlier result holds: complete, same push and fingerprint, ok or no Go module.

    The latter with a complete inventory, where `earlier` says so (inventory_complete). What was recorded of files is
    checked by integrity.reusable().
    """
    sure = F.coalesce("inventory_complete", F.lit(False)) if "inventory_complete" in earlier.columns else F.lit(True)
    good = earlier.where(F.col("complete") & ((F.col("status") == "ok") | (F.col("status") == "not-go-module") & sure)).select("target", "pushedAt", "fingerprint")
    return current.join(good, ["target", "pushedAt", "fingerprint"], "left_semi").where("pushedAt <> ''")


def overview(targets: DataFrame, catalogs: DataFrame) -> DataFrame:
    """docs (class of its documents) of each target and the share of observed operations that are documented.

    `catalogs`: a row for each module (target, status, dialects array, numerator, denominator); null status: no catalog.
    """
    has = lambda d: F.bool_or(F.exists(F.coalesce("dialects", F.array().cast("array<string>")), lambda x: F.replace(x, F.lit("-")) == d))  # noqa: E731  readers write openapi-3
    rows = catalogs.groupBy("target").agg(has("openapi3").alias("three"), has("swagger2").alias("two"), F.bool_or(F.coalesce(F.col("status") != "complete", F.lit(True))).alias("loose"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    docs = F.when(F.col("three") & F.col("two"), "both").when(F.col("three"), "openapi3").when(F.col("two"), "swagger2").when(F.coalesce("loose", F.lit(True)), "unavailable").otherwise("none")
    share = F.when(F.col("denominator") > 0, F.round(100.0 * F.col("numerator") / F.col("denominator"), 1))
    return targets.select("target").join(rows, "target", "left").select("target", docs.alias("docs"), share.alias("observed_percent"))


def review_queue(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """state and candidates to review of each target (target, status, complete, reviewed, enrichment_issues).

    Candidates are symbols whose name hints at authentication and that aren't known to do something else.
    """
    names = candidates.where("name_hint and not known_non_auth").groupBy("target").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    rows = targets.join(names, "target", "left")
    some = F.size(F.coalesce("symbols", F.array().cast("array<string>"))) > 0
    state = (
        F.when(F.col("status") == "not-go-module", "not-applicable")
        .when(F.col("status") != "ok", "scan-failed")
        .when(~F.col("complete"), "scan-incomplete")
        .when(F.col("reviewed"), "reviewed-config-applied")
        .when(F.col("enrichment_issues") > 0, "enrichment-failed")
        .when(some, "candidates-to-review")
        .otherwise("no-candidates")
    )
    shown = state.isin("scan-incomplete", "enrichment-failed", "candidates-to-review")
    return rows.select("target", state.alias("state"), F.when(shown, F.coalesce("symbols", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("symbols"))
