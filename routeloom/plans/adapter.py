"""Route evidence derived from the `events` table, so that engine and oracle start from the same facts.

Every event is a route of the current snapshot (0) and of the baseline (1); what differs between them is its path and
its chain. The chain is a logger and, by k and a remainder of event_id, a guard, an opaque entry, a wrapper or an
unconfigured symbol; every 13th route has a broken guard after it. Facts are projections of one scan of all events,
which are dealt out by event first: a Parquet file is read by no more tasks than it has row groups, and one large group
would leave all further steps of a route to one task. Both snapshots read the same shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.config import Config, Exemption, Guard, Policy, Requirement, Selector
from ..schema import MIDDLEWARE

LOGGER, USER, ADMIN, LEGACY = "acme/log.Logger", "acme/auth.RequireUser", "acme/auth.RequireAdmin", "acme/auth.Legacy"
WRAP, CHECK, UNUSED = "acme/mw.Wrap", "acme/auth.CheckToken", "acme/auth.Unused"
SHAPES = {USER: "confirmed-shape", ADMIN: "unresolved", LEGACY: "contradicted", CHECK: "confirmed-shape", UNUSED: "confirmed-shape"}
NOW = "2024-06-01 00:00:00"
CONFIG = Config(
    guards={USER: Guard("analyze", ("user",), ("member",), ("read",), "bearer"), ADMIN: Guard("attested", ("admin", "user"), ("admin",), ("read", "write")), LEGACY: Guard(), UNUSED: Guard()},
    wrappers=(WRAP,),
    accepted_public=("GET /api/v1/r9", "POST /api/v1/r5", "GET /nope"),
    policies=(
        Policy("no-public-writes", Selector(method=("post", "PUT", "DELETE")), Requirement(status=("proven", "unknown")), (Exemption("migration", "2024-12-31", Selector(path=("/api/v1/r1*",))), Exemption("past", "2024-05-31", Selector(path=("/**",))))),
        Policy("logged-first", Selector(path=("/api/*/r?", "/api/**/r19"), package=("acme/auth",)), Requirement(middlewareOrder=(LOGGER, USER))),
        Policy("admin-or-public", Selector(status=("proven", "public")), Requirement(any=(Requirement(anyTag=("admin",)), Requirement(not_=Requirement(status=("proven",)))), middlewareAbsent=(LEGACY,))),
    ),
)
METHOD = {"click": "GET", "view": "GET", "signup": "POST", "purchase": "PUT"}


def facts(spark: SparkSession, sf_dir: str, snapshot: int = 0) -> DataFrame:
    """target, module_id and the ROUTE columns of one snapshot."""
    k, i = F.col("k"), F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "props").repartition("event_id", "props")
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    # each step has its own projection, so that JSON is read once a row and not once a use
    events = events.withColumns({"g": (k % 20 + (i % 2 * 3 if snapshot else i % 3)) % 11, "place": k % 20 + (F.when(i % 29 == 0, 40) if snapshot else F.when(i % 31 == 0, 20)).otherwise(0)})
    g, place = F.col("g"), F.col("place")

    def entry(symbol, ordering: int, opaque=None, wrapped=None):
        names = [f.split(" ")[0] for f in ("displayName", "canonicalSymbol")]
        return F.struct(
            F.coalesce(symbol, F.lit("func literal")).alias(names[0]), symbol.alias(names[1]), F.lit("function").alias("callableKind"),
            F.struct(F.lit("router.go").alias("file"), F.col("event_id").cast("int").alias("line")).alias("source"), F.lit("group").alias("registrationScope"), F.lit(ordering).alias("orderingIndex"),
            (F.when(opaque, "unresolved").otherwise("resolved") if opaque is not None else F.lit("resolved")).alias("resolutionStatus"),
            (F.when(wrapped, F.array(F.lit(LOGGER), F.lit(USER))).otherwise(F.array().cast("array<string>")) if wrapped is not None else F.array().cast("array<string>")).alias("wrappedSymbols"), F.lit(None).cast("string").alias("shape"),
        ).cast(MIDDLEWARE)

    symbol = F.when(g < 4, USER).when(g < 6, ADMIN).when(g == 6, LEGACY).when(g == 8, WRAP).when(g == 9, CHECK)
    none = F.array().cast(f"array<{MIDDLEWARE}>")
    chain = F.concat(F.array(entry(F.lit(LOGGER), 0)), F.when(g < 10, F.array(entry(F.col("symbol"), 1, g == 7, g == 8))).otherwise(none), F.when(i % 13 == 0, F.array(entry(F.lit(LEGACY), 2))).otherwise(none))
    method = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in METHOD.items() for x in kv)), F.col("event_type")), F.lit("DELETE"))
    path = F.concat(F.lit("/api/v1/r"), place.cast("string"))
    return events.withColumn("symbol", symbol).select(
        F.concat(F.lit("repo-"), (F.col("user_id") % 5).cast("string")).alias("target"), F.concat(F.lit("mod-"), (F.col("user_id") % 3).cast("string")).alias("module_id"),
        F.col("event_id").alias("ord"), method.alias("method"), path.alias("ginPath"), path.alias("normalizedPath"), F.lit("http").alias("surfaceKind"), F.lit("direct").alias("registrationKind"),
        chain.alias("middleware"), entry(F.concat(F.lit("acme/api.Handler"), (k % 10).cast("string")), 0).alias("finalHandler"),
        F.struct(F.lit("router.go").alias("file"), F.col("event_id").cast("int").alias("line")).alias("source"), F.lit("high").alias("pathConfidence"),
    )
