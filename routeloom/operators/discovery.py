"""From registration events to routes: scopes, groups, expansion over methods (evidence level, not source code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import join_paths, normalize_path
from ..sinks.tables import written

#: What a registration for any method expands to (fixed values).
ANY_METHODS = ("GET", "POST", "PUT", "PATCH", "HEAD", "OPTIONS", "DELETE", "CONNECT", "TRACE")


def group_paths(groups: DataFrame, depth: int = 32) -> DataFrame:
    """group_id, path, depth, lineage of nested groups (group_id, parent_id null at a root, prefix), `depth` levels at most.

    Levels are walked down by joins; each level moves only the groups found in the one before and is written, so none
    is computed again for the next. Cycles end where they close.
    """
    groups = written(groups.select("group_id", "parent_id", "prefix"), "groups")
    level = groups.where("parent_id is null").select("group_id", normalize_path(F.col("prefix")).alias("path"), F.lit(0).alias("depth"), F.array("group_id").alias("lineage"))
    out = level
    for d in range(1, depth + 1):
        level = groups.alias("g").join(level.alias("p"), F.col("g.parent_id") == F.col("p.group_id")).where(~F.array_contains("p.lineage", F.col("g.group_id")))
        level = level.select("g.group_id", join_paths(F.col("p.path"), F.col("g.prefix")).alias("path"), F.lit(d).alias("depth"), F.concat("p.lineage", F.array("g.group_id")).alias("lineage"))
        level = written(level, "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def chains(events: DataFrame) -> DataFrame:
    """Chains of registrations: a `use` event adds to those after it in its scope, never to earlier ones.

    `events`: scope, ord, kind (use or route), symbol, method, path. A fallback event gets the final chain.
    """
    before = Window.partitionBy("scope").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("scope").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    used = F.when(F.col("kind") == "use", F.col("symbol"))
    rows = events.withColumn("chain", F.when(F.col("kind") == "fallback", F.collect_list(used).over(every)).otherwise(F.collect_list(used).over(before)))
    return rows.where("kind <> 'use'")


def expand(registrations: DataFrame) -> DataFrame:
    """A row for each method: `any` all nine, `match` those listed, static files GET and HEAD (folders with a catch-all)."""
    methods = (
        F.when(F.col("registration") == "any", F.array(*map(F.lit, ANY_METHODS)))
        .when(F.col("registration") == "match", F.col("methods"))
        .when(F.col("registration").isin("static", "static-file"), F.array(F.lit("GET"), F.lit("HEAD")))
        .otherwise(F.array("method"))
    )
    path = F.when(F.col("registration") == "static", F.concat(F.regexp_replace("path", "/+$", ""), F.lit("/*filepath"))).otherwise(F.col("path"))
    return registrations.withColumn("path", path).withColumn("method", F.explode(methods)).withColumn("normalizedPath", normalize_path(F.col("path")))


def uncalled_registrars(registrars: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that take a router and that nothing calls."""
    return registrars.join(calls.select(F.col("callee").alias("symbol")).distinct(), "symbol", "left_anti")


def enrich(routes: DataFrame, docs: DataFrame) -> DataFrame:
    """Annotations (symbol, swag) of final handlers."""
    return routes.join(docs.select(F.col("symbol").alias("handler_symbol"), "swag"), F.col("finalHandler.canonicalSymbol") == F.col("handler_symbol"), "left").drop("handler_symbol")


def merge_globals(globals_: DataFrame) -> DataFrame:
    """field, value, conflict of module documentation (field, ord, value): the last that isn't empty, and whether values differ."""
    rows = globals_.where("value is not null and value <> ''")
    return rows.groupBy("field").agg(F.max_by("value", "ord").alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def relativize(rows: DataFrame, root: str, external: DataFrame | None = None) -> DataFrame:
    """`rows` with `file` relative to `root`; outside of it, module@version/path by `external` (file, module, version, dir).

    A file that nothing names becomes external:unresolved where `external` is given, and stays otherwise: no document
    shows where a module was kept. A file that `external` has twice is one of the least module. Rows keep their number
    and all other columns, whatever their names.
    """
    base = root.rstrip("/") + "/"
    inside = F.col("file").startswith(base)
    own, rest = [F.col(f"whole.`{c}`") for c in rows.columns], F.col("file")
    rows = rows.select("file", F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("whole"))
    if external is not None:
        named = external.groupBy("file").agg(F.min(F.struct("module", F.coalesce("version", F.lit("")).alias("version"), "dir")).alias("of"))
        rows = rows.join(named, "file", "left")
        label = F.concat("of.module", F.when(F.col("of.version") != "", F.concat(F.lit("@"), "of.version")).otherwise(""), F.lit("/"), F.expr("substr(file, length(of.dir) + 2)"))
        rest = F.coalesce(label, F.lit("external:unresolved"))
    inside = F.when(inside, F.substr("file", F.lit(len(base) + 1))).otherwise(rest)
    return rows.select(*[inside.alias("file") if c == "file" else own[i].alias(c) for i, c in enumerate(rows.schema["whole"].dataType.names)])


def canonical_order(routes: DataFrame, *by: str) -> DataFrame:
    """`ord` by method, path and source, no source first."""
    w = Window.partitionBy(*by).orderBy("method", "normalizedPath", F.col("source.file").asc_nulls_first(), F.col("source.line").asc_nulls_first())
    return routes.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
