"""Classification of routes by their middleware chains (no shuffle: a chain is an array of its route's row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import route_key
from ..functions.symbols import fingerprint
from ..schema import AUTH
from .config import Config


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def is_opaque(m: Column) -> Column:
    return F.coalesce((m["resolutionStatus"] == "unresolved") | m["callableKind"].isin("anonymous", "unknown"), F.lit(False))


def among(value: Column, values) -> Column:
    """Whether a value is one of the driver's, of which there may be none."""
    return value.isin(*values) if values else F.lit(False)


def lookup(values: dict[str, str], kind: str = "string") -> Column:
    """A driver-side dictionary as a map constant."""
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v)))) if values else F.create_map().cast(f"map<string,{kind}>")


def shaped(routes: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """`routes` whose chain entries carry the enforcement shape of their symbol, computed once a symbol."""
    table = lookup(shapes)
    return routes.withColumn("middleware", F.transform("middleware", lambda m: m.withField("shape", F.coalesce(F.try_element_at(table, m["canonicalSymbol"]), m["shape"]))))


def shaped_by(routes: DataFrame, shapes: DataFrame, key: str = "ord") -> DataFrame:
    """As shaped(), for shapes (symbol, shape) too many for the driver: a join on symbols; `key` names a route's row."""
    parts = routes.select(key, F.posexplode("middleware").alias("at", "m"))
    parts = parts.join(shapes.select(F.col("symbol").alias("s"), F.col("shape").alias("known")), F.col("m.canonicalSymbol") == F.col("s"), "left")
    chains = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("m").withField("shape", F.coalesce("known", "m.shape")).alias("m")))), lambda x: x["m"]).alias("chain"))
    return routes.join(chains, key, "left").withColumn("middleware", F.coalesce("chain", "middleware")).drop("chain")


def classify(routes: DataFrame, config: Config, shapes: dict[str, str] | None = None) -> DataFrame:
    """`routes` with `auth` and `route_findings` (rule, severity, detail).

    First match wins: a guard that is confirmed, or attested where unresolved, proves; else a contradicted guard,
    then an unconfirmed one, then an opaque entry, then an unconfigured symbol of confirmed shape make the route
    unknown; else it is public. A contradicted guard is a finding of its own even on a proven route. Only direct
    symbols count, or the first configured guard inside a configured wrapper; the final handler never does.
    `shapes`: symbol to confirmed-shape, contradicted or unresolved (the default).
    """
    shapes = shapes or {}
    shape = {s: "unresolved" if shapes.get(s) is None else shapes[s] for s in config.guards}
    attested = [s for s, g in config.guards.items() if shape[s] == "unresolved" and g.assurance == "attested"]
    proving = attested + [s for s in shape if shape[s] == "confirmed-shape"]
    contradicted = [s for s in shape if shape[s] == "contradicted"]
    unconfirmed = [s for s, g in config.guards.items() if shape[s] == "unresolved" and g.assurance not in (None, "attested")]
    unlisted = [s for s, v in shapes.items() if v == "confirmed-shape" and s not in config.guards and s not in config.wrappers]

    def guard(m: Column) -> Column:
        """The configured guard that a chain entry stands for, or null."""
        s = m["canonicalSymbol"]
        inner = F.try_element_at(F.filter(F.coalesce(m["wrappedSymbols"], F.array().cast("array<string>")), lambda w: among(w, config.guards)), F.lit(1))
        return F.when(among(s, config.guards), s).when(among(s, config.wrappers), inner)

    def first(values) -> Column:
        return F.try_element_at(F.filter("guards", lambda s: among(s, values)), F.lit(1))

    # functions on arrays are interpreted, so chains are opened once: what a guard's symbol implies is looked up by symbol
    loose = F.filter("middleware", lambda m: among(m["canonicalSymbol"], unlisted) & ~is_opaque(m))
    rows = routes.withColumns({"guards": F.filter(F.transform("middleware", guard), lambda s: s.isNotNull()), "opaque": F.exists("middleware", is_opaque), "loose": F.try_element_at(loose, F.lit(1))["canonicalSymbol"]})
    rows = rows.withColumn("chosen", F.coalesce(*map(first, (proving, contradicted, unconfirmed))))
    key = route_key(F.col("method"), F.col("normalizedPath"))
    c = F.col("chosen")
    has, sure = c.isNotNull(), c.isNotNull() & among(c, proving)
    basis = (
        F.when(sure, F.when(among(c, attested), "configured-guard-attested").otherwise("configured-guard-confirmed"))
        .when(has, F.when(among(c, contradicted), "configured-guard-contradicted").otherwise("configured-guard-unconfirmed"))
        .when(F.col("opaque"), "opaque-middleware-present")
        .when(F.col("loose").isNotNull(), "unconfigured-guard-confirmed-shape")
        .otherwise("no-configured-guard-matched")
    )
    rows = rows.withColumn("basis", basis)
    public = F.col("basis") == "no-configured-guard-matched"
    accepted = public & F.array_contains(strings(config.accepted_public), key)

    def of_guard(what: str) -> Column:
        table = F.create_map(*(x for s, g in config.guards.items() for x in (F.lit(s), strings(getattr(g, what))))) if config.guards else F.create_map().cast("map<string,array<string>>")
        return F.when(has, F.try_element_at(table, c)).otherwise(F.array().cast("array<string>"))

    auth = F.struct(
        F.when(sure, "proven").when(public, "public").otherwise("unknown").alias("authStatus"),
        F.col("basis").alias("classificationBasis"),
        F.when(has, F.try_element_at(lookup({s: g.assurance for s, g in config.guards.items()}), c)).alias("assurance"),
        F.when(has, F.try_element_at(lookup(shape), c)).when(F.col("basis") == "unconfigured-guard-confirmed-shape", "confirmed-shape").alias("enforcementAnalysis"),
        F.when(has, c).when(F.col("basis") == "unconfigured-guard-confirmed-shape", F.col("loose")).alias("matchedEvidence"),
        F.when(sure | public, "high").otherwise("medium").alias("confidence"),
        of_guard("tags").alias("tags"),
        of_guard("roles").alias("roles"),
        of_guard("scopes").alias("scopes"),
        accepted.alias("accepted"),
    ).cast(AUTH)

    def found(rule: str, severity: str, detail: Column, advice: str | Column) -> Column:
        return F.struct(F.lit(rule).alias("ruleId"), F.lit(severity).alias("severity"), detail.alias("detail"), (F.lit(advice) if isinstance(advice, str) else advice).alias("recommendation"))

    broken = F.transform(F.filter("guards", lambda s: among(s, contradicted)), lambda s: found("matched-but-unenforced", "high", F.concat(F.lit('configured guard "'), s, F.lit('" is on the chain, but its control flow never ends it')), "Make this middleware deny, or take it out of authMiddleware."))
    one = (
        F.when(F.col("basis") == "opaque-middleware-present", F.array(found("opaque-middleware", "medium", F.lit("an unresolved or anonymous middleware of the chain may hide an authentication check"), "Give the middleware a name at package level, or configure it.")))
        .when(F.col("basis") == "unconfigured-guard-confirmed-shape", F.array(found("unconfigured-guard", "medium", F.concat(F.lit('middleware "'), F.col("loose"), F.lit('" is not configured, but its own control flow can abort the chain')), "Review it, and add it to authMiddleware if it authenticates.")))
        .when(public & ~accepted, F.array(found("public-route", "medium", F.lit("no configured guard is on the chain"), "Add authentication, or list the route in acceptedPublic.")))
        .otherwise(F.array())
    )
    return rows.withColumns({"auth": auth, "route_findings": F.concat(broken, one)}).drop("guards", "chosen", "opaque", "loose", "basis")


def findings_of(routes: DataFrame, *keep: str) -> DataFrame:
    """The per-route findings of classify() as rows: keep, ord, ruleId, severity, fingerprint, route, detail.

    Routes without findings are left out after they are opened: a filter on the list itself would be pushed below the
    classification, whose steps would then be computed over and over within it.
    """
    rows = routes.select(*keep, "ord", route_key(F.col("method"), F.col("normalizedPath")).alias("route"), "source", F.explode_outer("route_findings").alias("f")).where("f is not null")
    return rows.select(*keep, "ord", "f.ruleId", "f.severity", fingerprint(F.col("f.ruleId"), F.col("route")).alias("fingerprint"), "route", "source", "f.detail", "f.recommendation")


def stale_guards(routes: DataFrame, config: Config, syntax_only: bool = False) -> DataFrame:
    """Configured guards that no chain names directly (symbol, ruleId, severity, fingerprint). None for syntax-only scans.

    Symbols seen are reduced to those configured before the shuffle, so it moves a few rows a task.
    """
    spark = routes.sparkSession
    names = sorted(config.guards)
    known = spark.createDataFrame([(n,) for n in ([] if syntax_only else names)], "symbol string")
    seen = routes.select(F.explode("middleware.canonicalSymbol").alias("symbol")).where(F.col("symbol").isin(*names) if names else F.lit(False)).distinct()
    return known.join(seen, "symbol", "left_anti").select("symbol", F.lit("stale-auth-config").alias("ruleId"), F.lit("medium").alias("severity"), fingerprint(F.lit("stale-auth-config"), F.col("symbol")).alias("fingerprint"))


def stale_baseline(routes: DataFrame, config: Config) -> DataFrame:
    """Accepted entries whose route is missing or not public; of rows with an equal key the last counts."""
    spark = routes.sparkSession
    accepted = spark.createDataFrame([(a,) for a in config.accepted_public], "entry string")
    key = route_key(F.col("method"), F.col("normalizedPath"))
    wanted = routes.select(key.alias("entry"), "ord", F.col("auth.authStatus").alias("status")).where(F.col("entry").isin(*config.accepted_public) if config.accepted_public else F.lit(False))
    last = wanted.where("status is not null").groupBy("entry").agg(F.max_by("status", "ord").alias("status"))
    stale = accepted.join(last, "entry", "left").where("status is null or status <> 'public'")
    detail = F.when(F.col("status").isNull(), "missing").otherwise("not public")
    return stale.select("entry", F.lit("stale-baseline").alias("ruleId"), F.lit("low").alias("severity"), fingerprint(F.lit("stale-baseline"), F.col("entry")).alias("fingerprint"), detail.alias("reason"))


def verb_gaps(routes: DataFrame) -> DataFrame:
    """Paths whose routes differ in status; accepted routes and those without classification don't count.

    Equal (path, method, status) are counted before the shuffle, so a hot path gathers a few rows; `methods` lists
    METHOD=status with repetitions, in order. Routes that don't count are not counted, rather than filtered: a filter
    would be pushed below the classification and repeat its steps.
    """
    rows = routes.select("normalizedPath", "method", F.col("auth.authStatus").alias("status"), F.expr("auth is not null and not auth.accepted").alias("counts"))
    counts = rows.groupBy("normalizedPath", "method", "status").agg(F.count_if("counts").alias("n")).where("n > 0")
    paths = counts.groupBy("normalizedPath").agg(F.count_distinct("status").alias("kinds"), F.array_sort(F.collect_list(F.struct("method", "status", "n"))).alias("all")).where("kinds >= 2")
    methods = F.array_join(F.transform("all", lambda x: F.concat(x["method"], F.lit("="), x["status"])), ", ")
    return paths.select("normalizedPath", F.lit("per-verb-gap").alias("ruleId"), F.lit("high").alias("severity"), fingerprint(F.lit("per-verb-gap"), F.col("normalizedPath")).alias("fingerprint"), methods.alias("methods"), F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_routes"))
