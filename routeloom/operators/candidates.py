"""Middleware symbols ranked for review, within a module and over a fleet, and the review of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import route_key
from ..functions.symbols import candidate_id, known_non_auth, name_hint
from ..sinks.tables import written


def suggest(routes: DataFrame, shapes: DataFrame, *by: str, samples: int = 5, globals_: DataFrame | None = None) -> DataFrame:
    """Candidates of each module: symbol, route_count (distinct keys), shape, hints, first samples, rank.

    Distinct (symbol, key) pairs are made and written before they are gathered; samples are the smallest few, kept while
    combining. applies_to_all compares distinct keys to all rows, so duplicates make it false. Ranked by shape
    (confirmed, other, contradicted), hint, known others last, symbols on all routes last, fewer routes first.
    `globals_` (by, symbol): global middleware, candidates without routes of their own. `shapes` may have an excerpt.
    """
    key = route_key(F.col("method"), F.col("normalizedPath"))
    pairs = routes.select(*by, key.alias("route"), F.explode_outer("middleware.canonicalSymbol").alias("symbol")).where("symbol is not null").distinct()
    pairs = written(pairs, "pairs")  # counts, samples and all who join the candidates read them; chains are opened once
    totals = routes.groupBy(*by).agg(F.count(F.lit(1)).alias("total_routes"))
    first = Window.partitionBy(*by, "symbol").orderBy("route")
    few = pairs.withColumn("at", F.row_number().over(first)).where(F.col("at") <= samples).groupBy(*by, "symbol").agg(F.array_sort(F.collect_list("route")).alias("samples"))
    counts = pairs.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("route_count"))
    if globals_ is not None:
        counts = counts.union(globals_.select(*by, "symbol", F.lit(0).cast("long")).where("symbol is not null")).groupBy(*by, "symbol").agg(F.sum("route_count").alias("route_count"))
    rows = counts.join(few, [*by, "symbol"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    rows = rows.join(totals, list(by)) if by else rows.join(totals)
    rows = rows.join(shapes.select("symbol", "shape", (F.col("excerpt") if "excerpt" in shapes.columns else F.lit(None).cast("string")).alias("excerpt")), "symbol", "left")
    rows = rows.withColumns({"id": candidate_id(F.col("symbol")), "name_hint": name_hint(F.col("symbol")), "known_non_auth": known_non_auth(F.col("symbol")), "applies_to_all": (F.col("total_routes") > 0) & (F.col("route_count") == F.col("total_routes"))})
    digits = [F.col("symbol"), *(F.col(c).cast("string") for c in ("route_count", "total_routes", "applies_to_all", "name_hint", "known_non_auth")), F.coalesce("shape", F.lit("")), F.coalesce("excerpt", F.lit("")), F.when(F.size("samples") > 0, F.array_join("samples", "\0"))]
    rows = rows.withColumn("fingerprint", F.sha2(F.concat_ws("\0", *digits), 256))
    order = Window.partitionBy(*by).orderBy(shape_rank(F.col("shape"), 1, 2), F.desc("name_hint"), "known_non_auth", "applies_to_all", "route_count", "symbol")
    return rows.withColumn("rank", F.row_number().over(order))


def shape_rank(shape: Column, other: int, contradicted: int) -> Column:
    return F.when(shape == "confirmed-shape", 0).when(shape == "contradicted", contradicted).otherwise(other)


def opaque_entries(routes: DataFrame, *by: str) -> DataFrame:
    """Chain entries without a symbol."""
    n = F.size(F.filter("middleware", lambda m: m["canonicalSymbol"].isNull()))
    return routes.groupBy(*by).agg(F.sum(n).alias("opaque"))


def bundle(candidates: DataFrame, *by: str) -> DataFrame:
    """One fingerprint over a module's candidates, in order of symbols."""
    parts = F.array_sort(F.collect_list(F.concat("symbol", F.lit(":"), "fingerprint")))
    return candidates.groupBy(*by).agg(F.sha2(F.array_join(parts, "\0"), 256).alias("bundle_fingerprint"))


def fleet_candidates(candidates: DataFrame, target: str = "target", repos: int = 20, samples: int = 5) -> DataFrame:
    """Candidates of all targets by symbol: counts, any hint, best shape (null unless confirmed or contradicted), rank.

    Here contradicted ranks before unresolved and more repositories and routes come first, unlike within a module.
    """
    rank = F.min(shape_rank(F.col("shape"), 2, 1))
    few = F.slice(F.array_sort(F.collect_set(target)), 1, repos)
    labelled = candidates.select("symbol", target, F.explode("samples").alias("s")).select("symbol", F.concat(target, F.lit(": "), "s").alias("s")).distinct()
    first = labelled.withColumn("at", F.row_number().over(Window.partitionBy("symbol").orderBy("s"))).where(F.col("at") <= samples).groupBy("symbol").agg(F.array_sort(F.collect_list("s")).alias("samples"))
    rows = candidates.groupBy("symbol").agg(F.sum("route_count").alias("route_count"), F.count_distinct(target).alias("repo_count"), F.bool_or("name_hint").alias("name_hint"), F.bool_or("known_non_auth").alias("known_non_auth"), rank.alias("r"), few.alias("repos"))
    rows = rows.withColumn("shape", F.when(F.col("r") == 0, "confirmed-shape").when(F.col("r") == 1, "contradicted")).join(first, "symbol")
    order = Window.orderBy("r", F.desc("name_hint"), "known_non_auth", F.desc("repo_count"), F.desc("route_count"), "symbol")
    return rows.withColumn("rank", F.row_number().over(order)).drop("r")  # one row a symbol is left


def draft_assessment(candidates: DataFrame) -> DataFrame:
    """Decisions proposed: a guard where a name hints at authentication and its shape is confirmed."""
    rows = candidates.where("name_hint and shape = 'confirmed-shape'")
    return rows.select("id", "fingerprint", F.lit(True).alias("is_auth_guard"), F.lit("analyze").alias("assurance"), F.lit("drafted: the name hints at authentication and the control flow confirms it; not verified by anyone").alias("rationale"))


def review(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, fingerprint, is_auth_guard, assurance, rationale) joined to candidates; `problem` says what is wrong, `eligible` what to suggest."""
    n = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rows = decisions.withColumnRenamed("fingerprint", "seen").join(candidates.select("id", "symbol", "fingerprint", F.lit(True).alias("known")), "id", "left").join(n, "id")
    problem = (
        F.when(F.col("n") > 1, "decided twice")
        .when(F.col("known").isNull(), "unknown candidate")
        .when(F.col("seen") != F.col("fingerprint"), "changed since the review")
        .when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "no rationale")
        .when(F.col("is_auth_guard") & ~F.coalesce(F.col("assurance").isin("analyze", "attested"), F.lit(False)), "unknown assurance")
    )
    return rows.select("id", "symbol", "is_auth_guard", "assurance", problem.alias("problem"), F.col("is_auth_guard").alias("eligible"))


#: What a decision may say about a guard besides its assurance, and what stands for nothing said.
GRANTS = {"tags": "array<string>", "roles": "array<string>", "scopes": "array<string>", "openapi_scheme": "string", "transparent_wrapper": "boolean"}
OUTCOMES = {"no guard": "reviewer marked this candidate as not an auth guard", "no symbol": "candidate has no canonical symbol to key a config entry by"}


def decided(candidates: DataFrame, decisions: DataFrame | None = None, assessed: str | None = None) -> DataFrame:
    """id, symbol, is_auth_guard, rationale, reason, eligible, assurance and grants of every decision, checked as a whole first.

    Any problem refuses all decisions before anything is returned, so it doesn't matter what is read of the result.
    `assessed`: the fingerprint of the bundle that was reviewed; another one than that of `candidates` refuses too.
    """
    decisions = draft_assessment(candidates) if decisions is None else decisions
    if assessed is not None and (now := bundle(candidates).first()["bundle_fingerprint"]) != assessed:
        raise ValueError(f"the review was made of another bundle: {assessed} is not {now}")
    checked = review(candidates, decisions)
    if bad := [f"{r['id']}: {r['problem']}" for r in checked.where("problem is not null").orderBy("id").limit(20).collect()]:
        raise ValueError(f"decisions are refused: {'; '.join(bad)}")
    grants = [(F.col(c) if c in decisions.columns else F.lit(None)).cast(t).alias(c) for c, t in GRANTS.items()]
    rows = checked.select("id", "symbol").join(decisions.select("id", "is_auth_guard", "assurance", "rationale", *grants), "id")
    reason = F.when(~F.col("is_auth_guard"), OUTCOMES["no guard"]).when(F.coalesce("symbol", F.lit("")) == "", OUTCOMES["no symbol"])
    rows = rows.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())
    return rows.select("id", "symbol", "is_auth_guard", "rationale", "reason", "eligible", *(F.when(F.col("eligible"), F.col(c)).alias(c) for c in ("assurance", *GRANTS)))


def import_review(candidates: DataFrame, decisions: DataFrame | None = None, assessed: str | None = None) -> DataFrame:
    """symbol, assurance, tags, roles, scopes, openapi_scheme, transparent_wrapper of the guards to configure; any problem refuses all decisions."""
    return decided(candidates, decisions, assessed).where("eligible").select("symbol", "assurance", *GRANTS)


def configuration(suggested: DataFrame) -> dict:
    """authMiddleware and authWrappers of import_review() as a configuration's sections; as many rows as were decided."""
    rows = suggested.orderBy("symbol").collect()
    said = lambda r: {"assurance": r["assurance"]} | {k: list(r[k]) for k in ("tags", "roles", "scopes") if r[k]} | ({"openapiScheme": r["openapi_scheme"]} if r["openapi_scheme"] else {})
    return {"authMiddleware": {r["symbol"]: said(r) for r in rows}, "authWrappers": [r["symbol"] for r in rows if r["transparent_wrapper"]]}


def review_summary(candidates: DataFrame, reviewed: DataFrame) -> DataFrame:
    """assessed, total_candidates, config_suggestions: one row."""
    return reviewed.agg(F.count(F.lit(1)).alias("assessed"), F.count_if("eligible").alias("config_suggestions")).crossJoin(candidates.agg(F.count(F.lit(1)).alias("total_candidates")))
