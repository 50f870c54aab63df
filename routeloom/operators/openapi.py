"""Operations of an API document from classified routes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_catch_all, operation_base, path_parameters, tag_for, template_path
from .classify import lookup
from .config import Config
from .structs import rendered, shape

#: Methods that a document can show (fixed values).
SHOWN = ("GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH", "TRACE")


def security(auth: Column, config: Config) -> Column:
    """none for public routes, the declared scheme of a proven guard, else unrefined."""
    schemes = lookup({s: g.scheme for s, g in config.guards.items() if g.scheme})
    scheme = F.try_element_at(schemes, auth["matchedEvidence"])
    return F.when(auth["authStatus"] == "public", "none").when((auth["authStatus"] == "proven") & scheme.isNotNull(), scheme).otherwise("unrefined")


def operations(routes: DataFrame, config: Config, *by: str) -> DataFrame:
    """One operation for each (path template, method): the first registration, how many there are, and whether all agree.

    Combined before the shuffle; registrations are counted by evidence, so a hot operation stays small.
    """
    rows = routes.where(F.col("method").isin(*SHOWN)).withColumn("path", template_path(F.col("ginPath")))
    evidence = F.struct(F.col("finalHandler.displayName").alias("handler"), F.transform("middleware", lambda m: m["displayName"]).alias("chain"), F.col("auth.authStatus").alias("status"), F.col("auth.roles").alias("roles"), F.col("auth.scopes").alias("scopes"))
    rows = rows.select(*by, "path", "method", "ord", "ginPath", "auth", evidence.alias("evidence"))
    grouped = rows.groupBy(*by, "path", "method").agg(F.min_by(F.struct("ord", "ginPath", "auth"), "ord").alias("f"), F.count(F.lit(1)).alias("registrations"), F.count_distinct("evidence").alias("kinds"))
    base = operation_base(F.col("method"), F.col("path"))
    return grouped.select(
        *by, "path", "method", F.col("f.ord").alias("ord"), "registrations",
        F.when(F.col("registrations") == 1, None).when(F.col("kinds") == 1, "info").otherwise("warning").alias("diagnostic"),
        tag_for(F.col("path")).alias("tag"), path_parameters(F.col("path")).alias("parameters"), is_catch_all(F.col("f.ginPath")).alias("catch_all"),
        security(F.col("f.auth"), config).alias("security"), base.alias("base_id"),
    )


def hidden(routes: DataFrame) -> DataFrame:
    """Routes whose method a document can't show, as diagnostics."""
    return routes.where(~F.col("method").isin(*SHOWN)).select("ord", "method", "normalizedPath", F.lit("openapi-non-representable-method").alias("code"))


def with_ids(operations_: DataFrame, routes: DataFrame, *by: str) -> DataFrame:
    """operation_id: the base, with -2, -3, … where it repeats, by order of registration.

    Every registration uses up a number, also one that is merged into an earlier operation. Only routes whose base
    several operations share are numbered.
    """
    shared = operations_.groupBy(*by, "base_id").agg(F.count(F.lit(1)).alias("ops")).where("ops > 1").select(*by, "base_id")
    rows = routes.where(F.col("method").isin(*SHOWN)).select(*by, "ord", operation_base(F.col("method"), template_path(F.col("ginPath"))).alias("base_id"))
    numbers = rows.join(shared, [*by, "base_id"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*by, "base_id").orderBy("ord")))
    out = operations_.join(numbers, [*by, "base_id", "ord"], "left")
    return out.withColumn("operation_id", F.when(F.coalesce("n", F.lit(1)) == 1, F.col("base_id")).otherwise(F.concat("base_id", F.lit("-"), "n"))).drop("n")


def with_documented_ids(operations_: DataFrame, by: str) -> DataFrame:
    """As with_ids(), where `documented_id` replaces a generated one; both count on one table, in order, within `by`.

    The generated base is used up even where a documented id replaces it. Ordered state, so each group of `by` (one
    document) is walked in turn.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        out = []
        for base, documented in pdf.sort_values("ord")[["base_id", "documented_id"]].itertuples(index=False):
            used[base] = n = used.get(base, 0) + 1
            name = base if n == 1 else f"{base}-{n}"
            if isinstance(documented, str) and documented:
                used[documented] = k = used.get(documented, 0) + 1
                name = documented if k == 1 else f"{documented}{k}"
            out.append(name)
        return pdf.sort_values("ord").assign(operation_id=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in operations_.schema) + ", operation_id string"
    return operations_.groupBy(by).applyInPandas(walk, schema)


def overlay(operations_: DataFrame, documented: DataFrame, *by: str) -> DataFrame:
    """Annotations (path, method, documented_id, summary, routers) laid over operations; a claim of another path is a mismatch."""
    rows = operations_.join(documented.select(*by, "path", "method", "documented_id", "summary", "routers"), [*by, "path", "method"], "left")
    claim = F.concat(F.lower("method"), F.lit(" "), "path")
    return rows.withColumn("router_mismatch", F.coalesce((F.size("routers") > 0) & ~F.array_contains("routers", claim), F.lit(False)))


def described(operations_: DataFrame, params: DataFrame, responses: DataFrame, *by: str) -> DataFrame:
    """Operations with documented `all_parameters`, `body` and `responses`.

    `params`: path, method, ord, name, in, required, description, schema (JSON); `responses`: path, method, ord,
    status, description, schema. A parameter of the same name and place replaces an earlier one at its position, path
    parameters come first. The first body stays; without one, form fields make an object. The last response of a
    status stays; none at all give one default response.
    """
    key = [*by, "path", "method"]
    own = operations_.select(*key, F.posexplode("parameters").alias("at", "name")).select(*key, (F.col("at") - (1 << 20)).cast("long").alias("ord"), "name", F.lit("path").alias("in"), F.lit(True).alias("required"), F.lit(None).cast("string").alias("description"), F.lit('{"type":"string"}').alias("schema"))
    fields = [*key, F.col("ord").cast("long").alias("ord"), "name", "in", "required", "description", "schema"]
    plain = own.union(params.where("`in` not in ('body', 'formData')").select(fields))
    last = plain.groupBy(*key, "name", "in").agg(F.min("ord").alias("at"), F.max_by(F.struct("required", "description", "schema"), "ord").alias("p"))
    listed = last.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "name", "in", "p.required", "p.description", "p.schema"))).alias("all_parameters"))
    body = params.where("`in` = 'body'").groupBy(*key).agg(F.min_by(F.struct("description", "required", "schema"), "ord").alias("body"))
    form = params.where("`in` = 'formData'").groupBy(*key, "name").agg(F.max_by("schema", "ord").alias("schema"), F.bool_or("required").alias("required"))
    form = form.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "schema", "required"))).alias("form"))
    answers = responses.groupBy(*key, "status").agg(F.max_by(F.struct(F.when(F.col("description") != "", F.col("description")).otherwise("Response").alias("description"), "schema"), "ord").alias("r"))
    answers = answers.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("status", "r.description", "r.schema"))).alias("responses"))
    return operations_.join(listed, key, "left").join(body, key, "left").join(form, key, "left").join(answers, key, "left")


def description_conflicts(params: DataFrame, responses: DataFrame, *by: str) -> DataFrame:
    """path, method, code, n: bodies and responses that another declaration replaced or that can't be shown beside another."""
    key = [*by, "path", "method"]
    bodies = params.groupBy(*key).agg(F.count_if(F.col("in") == "body").alias("b"), F.count_if(F.col("in") == "formData").alias("f"))
    bodies = bodies.select(*key, F.lit("swag-request-body-conflict").alias("code"), (F.greatest(F.col("b") - 1, F.lit(0)) + F.when((F.col("b") > 0) & (F.col("f") > 0), 1).otherwise(0)).alias("n"))
    doubled = responses.groupBy(*key, "status").count().groupBy(*key).agg(F.sum(F.col("count") - 1).alias("n")).select(*key, F.lit("swag-response-conflict").alias("code"), "n")
    return bodies.union(doubled).where("n > 0")


def info(module: str, documentation: dict | None = None, title: str = "", version: str = "") -> dict:
    """The head of a document: the module's name unless documentation or, before that, the configuration names it."""
    d, name = documentation or {}, module.rstrip("/").rsplit("/", 1)[-1] if module else ""
    out = {"title": title or d.get("title") or (f"{name} API" if name else "Routes"), "version": version or d.get("version") or "0.0.0"}
    out |= {k: d[k] for k in ("description", "termsOfService") if d.get(k)}
    for part in ("contact", "license"):
        if given := {k: v for k, v in (d.get(part) or {}).items() if v}:
            out[part] = given
    return out


def last_wins(items: DataFrame, *key: str) -> DataFrame:
    """The last of items (ord, value) with a key, and whether another one was replaced: parameters, responses."""
    return items.groupBy(*key).agg(F.max_by("value", "ord").alias("value"), (F.count(F.lit(1)) > 1).alias("replaced"))


def components(schemas: DataFrame, *by: str) -> DataFrame:
    """Component schemas (id, ord, schema) merged: the first of an id; conflict where they differ."""
    return schemas.groupBy(*by, "id").agg(F.min_by("schema", "ord").alias("schema"), (F.count_distinct("schema") > 1).alias("conflict"))


def unknown_references(schemas: DataFrame) -> DataFrame:
    """References in component schemas (id, schema as JSON) to components that aren't there."""
    refs = schemas.select("id", F.explode(F.regexp_extract_all("schema", F.lit(r'"#/components/schemas/([^"]+)"'), F.lit(1))).alias("ref")).distinct()
    return refs.join(schemas.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")


def schema_json(types: DataFrame) -> DataFrame:
    """id, schema (JSON) of type descriptions (id, type such as []string, map[string]int, *pkg.User, time.Time); {} where nothing can be said."""
    return types.select("id", F.coalesce(rendered(shape(F.col("type"))), F.lit("{}")).alias("schema"))
