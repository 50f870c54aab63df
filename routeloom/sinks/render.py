"""Rendered reports.

Rows become text on the executors, with explicit order and explicit nulls; the driver sees text only in document(),
which is for one report at a time and refuses output over its limit.
"""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StringType, StructType

from ..functions.paths import route_key
from ..functions.symbols import severity_rank
from ..schema import AUTH_STATUS, RULESET_VERSION, SCHEMA_VERSION, SEVERITIES, TARGET_STATUS, TOOL_VERSION


def reports_json(routes: DataFrame, findings: DataFrame | None, target: Column, *by: str, command: str = "audit", profile: str = "typed", policies: tuple[str, ...] = (), delta: DataFrame | None = None, diagnostics: DataFrame | None = None, coverage: DataFrame | None = None, lists: bool = True) -> DataFrame:
    """`report`: the whole envelope of each report as JSON, which readers.reports() reads back.

    `target`: a struct with module and buildContext. Lists are there even when empty, in order; an audit has summary,
    findings, policyEvaluation and activeExceptions, an inventory has none of them. `delta` is compare_routes() with
    `by`, `coverage` summary.coverage(); without the latter the scan counts as complete. A report is one document, so its routes meet in one row; write_reports() has no such row.
    Without `lists` the envelope's routes and findings are empty lists and come by report_items() as rows, for reports of any size.
    """
    names = _route_fields(command)
    listed = lambda rows, at, value: F.transform(F.array_sort(F.collect_list(F.struct(at, value.alias("x")))), lambda e: e["x"])
    joined = lambda left, right: (left.join(right, list(by), "left") if by else left.join(right))
    whole = listed(routes, F.col("ord"), F.struct(*[c for c in names if c in routes.columns])) if lists else F.array()
    out = routes.groupBy(*by).agg(F.first(target).alias("report_target"), whole.alias("routes"))
    nothing = lambda kind: F.array().cast(f"array<{kind}>")
    if diagnostics is not None:
        rows = diagnostics.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("code", "severity", "message", "route"))).alias("diagnostics"))
        out = joined(out, rows)
    fields = {
        "schemaVersion": F.lit(SCHEMA_VERSION), "tool": F.lit("routeloom"), "toolVersion": F.lit(TOOL_VERSION), "classifierRulesetVersion": F.lit(RULESET_VERSION), "command": F.lit(command), "analysisProfile": F.lit(profile), "target": F.col("report_target"), "routes": F.col("routes"),
        "globalMiddleware": nothing("string"), "fallbackSurfaces": nothing("string"), "diagnostics": F.coalesce("diagnostics", nothing("struct<code string, severity string, message string, route string>")) if diagnostics is not None else nothing("string"),
    }
    if coverage is not None:
        scanned = coverage.select(*by, F.struct(
            F.col("discovered_packages").alias("discoveredPackages"), (F.col("discovered_packages") - F.col("failed_packages")).alias("analyzedPackages"), F.col("failed_packages").alias("failedPackages"), F.col("discovered_files").alias("discoveredFiles"),
            (F.col("discovered_files") - F.col("failed_files")).alias("analyzedFiles"), F.col("failed_files").alias("failedFiles"), F.col("unresolved_registrations").alias("unresolvedRegistrations"), F.lit(profile).alias("profile"), "complete",
        ).alias("scan_coverage"))
        out = joined(out, scanned)
    fields["scanCoverage"] = F.col("scan_coverage") if coverage is not None else F.struct(F.lit(profile).alias("profile"), F.lit(True).alias("complete"))
    if command == "audit":
        counts = {"totalRoutes": F.lit(True), "proven": F.col("auth.authStatus") == "proven", "provenByAttestedUnresolved": F.col("auth.classificationBasis") == "configured-guard-attested", "public": F.col("auth.authStatus") == "public", "unknown": F.col("auth.authStatus") == "unknown"}
        out = joined(out, routes.groupBy(*by).agg(F.struct(*(F.count_if(c).alias(k) for k, c in counts.items())).alias("n")))
        found = findings.groupBy(*by).agg((listed(findings, F.struct(severity_rank(F.col("severity")).alias("s"), "fingerprint", "ord"), _finding()) if lists else F.array()).alias("findings"))
        severities = findings.groupBy(*by, "severity").count().groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "count")))).alias("severities"))
        out = joined(joined(out, found), severities)
        n = F.col("n")
        fields |= {
            "summary": F.struct(n["totalRoutes"].alias("totalRoutes"), (n["proven"] - n["provenByAttestedUnresolved"]).alias("provenByConfirmedShape"), n["provenByAttestedUnresolved"].alias("provenByAttestedUnresolved"), n["public"].alias("public"), n["unknown"].alias("unknown"), F.coalesce("severities", F.create_map().cast("map<string,bigint>")).alias("findingsBySeverity")),
            "findings": F.coalesce("findings", F.array()), "policyEvaluation": F.struct(F.array(*map(F.lit, policies)).cast("array<string>").alias("evaluatedPolicies")), "activeExceptions": nothing("string"),
        }
    if delta is not None:
        of = lambda change: F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("route"))))
        moved = lambda change: F.array_sort(F.collect_list(F.when(F.col("change") == change, F.struct(F.substring_index("route", " ", 1).alias("method"), F.regexp_replace("route", "^[^ ]* ", "").alias("path"), "from", "to", "explanation"))))
        rows = delta.groupBy(*by).agg(F.struct(of("added").alias("addedRoutes"), of("removed").alias("removedRoutes"), moved("regression").alias("authRegressions"), moved("improvement").alias("authImprovements")).alias("delta"))
        out = joined(out, rows)
        fields["delta"] = F.col("delta")
    return out.select(*by, F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("report"))


def _route_fields(command: str = "audit") -> list[str]:
    return ["method", "ginPath", "normalizedPath", "surfaceKind", "registrationKind", "middleware", "finalHandler", "source", "pathConfidence"] + ["auth"] * (command == "audit")


def _finding() -> Column:
    return F.struct(F.col("fingerprint").alias("id"), "ruleId", "fingerprint", "severity", "route", "source", "detail", "recommendation")


def report_items(routes: DataFrame, findings: DataFrame | None, *by: str, command: str = "audit") -> DataFrame:
    """by, list (routes, findings), severity, fingerprint, ord, item: what stands in the lists of each report, an element a row.

    `item` is JSON as reports_json() has it; ordered by severity, fingerprint and ord (the first two are null for
    routes) the items of a list are those of the document.
    """
    rows = routes.select(*by, F.lit("routes").alias("list"), F.lit(None).cast("int").alias("severity"), F.lit(None).cast("string").alias("fingerprint"), "ord", F.to_json(F.struct(*[c for c in _route_fields(command) if c in routes.columns])).alias("item"))
    if findings is None:
        return rows
    return rows.unionByName(findings.select(*by, F.lit("findings").alias("list"), severity_rank(F.col("severity")).alias("severity"), "fingerprint", "ord", F.to_json(_finding()).alias("item")))


def digests(lines: DataFrame, by: list[str], order: list[str], line: str = "line", between: str = "between") -> DataFrame:
    """by, n, md5 of each group's lines in order with `between` (a column, one value a group) between them.

    A task reads its groups sorted and keeps a digest, not the lines; null lines count but have no text.
    """
    own = lines.select(*by, *order, line, between).repartition(*by).sortWithinPartitions(*by, *order).select(*by, F.col(line).alias("line"), F.col(between).alias("between"))
    kinds = own.select(*by).schema

    def run(batches):
        import hashlib
        from itertools import groupby

        import pyarrow as pa

        out = pa.schema(list(zip(named, types)))
        at, digest, n, empty = None, None, 0, True

        def done():
            return pa.record_batch([pa.array([v], t) for v, t in zip((*at, n, digest.hexdigest()), types)], schema=out)

        for b in batches:
            for key, rows in groupby(zip(*(c.to_pylist() for c in b.columns)), lambda r: r[:-2]):
                if at != key:
                    if at is not None:
                        yield done()
                    at, digest, n, empty = key, hashlib.md5(), 0, True
                for *_, text, gap in rows:
                    n += 1
                    if text is not None:
                        digest.update((text if empty else gap + text).encode())
                        empty = False
        if at is not None:
            yield done()

    types, named = [*(to_arrow_type(f.dataType) for f in kinds), to_arrow_type(LongType()), to_arrow_type(StringType())], [*by, "n", "md5"]
    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n long", "md5 string"]))


def write_reports(routes: DataFrame, path: str, report: str) -> None:
    """Evidence as JSON lines by report; Spark's committer publishes all files or none."""
    routes.write.partitionBy(report).mode("errorifexists").option("ignoreNullFields", "false").json(path)


def markdown_escape(text: Column) -> Column:
    """Text that stays inside a table cell: backslashes and bars are escaped, backticks become apostrophes, line breaks spaces, angle brackets entities."""
    out = F.regexp_replace(text, r"\r\n|\r|\n", " ")
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("`", "'"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def auth_label(auth: Column) -> Column:
    """[status/enforcement, accepted], as far as known; empty without classification."""
    label = F.concat(F.lit("["), auth["authStatus"], F.coalesce(F.concat(F.lit("/"), auth["enforcementAnalysis"]), F.lit("")), F.when(auth["accepted"], ", accepted").otherwise(""), F.lit("]"))
    return F.coalesce(label, F.lit(""))


def source_label(source: Column) -> Column:
    return F.coalesce(F.concat_ws(":", source["file"], source["line"].cast("string")), F.lit(""))


def markdown_code(text: Column) -> Column:
    return F.concat(F.lit("`"), markdown_escape(text), F.lit("`"))


def markdown_routes(routes: DataFrame, audit: bool = True) -> DataFrame:
    """ord, line: a table row for each route: method, path, authentication (audits), chain, handler, source."""
    name = lambda c: markdown_escape(F.coalesce(c, F.lit("?")))
    chain = F.when(F.size("middleware") > 0, F.array_join(F.transform("middleware", lambda m: name(m["displayName"])), " → ")).otherwise("—")
    cells = [markdown_escape(F.col("method")), markdown_code(F.col("normalizedPath")), *([markdown_escape(auth_label(F.col("auth")))] * audit), chain, name(F.col("finalHandler.displayName")), markdown_escape(source_label(F.col("source")))]
    return routes.select("ord", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_findings(findings: DataFrame) -> DataFrame:
    """at (severity, fingerprint, ord), line: a list item for each finding, with its recommendation below it."""
    route = F.coalesce(F.concat(F.lit(" · "), markdown_code(F.col("route"))), F.lit(""))
    advice = F.when(F.coalesce("recommendation", F.lit("")) != "", F.concat(F.lit("\n  - _Recommendation:_ "), markdown_escape(F.col("recommendation")))).otherwise("")
    line = F.concat(F.lit("- **"), "severity", F.lit("** `"), markdown_escape(F.col("ruleId")), F.lit("`"), route, F.lit(" — "), markdown_escape(F.coalesce("detail", F.lit(""))), advice)
    return findings.select(F.struct(severity_rank(F.col("severity")).alias("severity"), "fingerprint", "ord").alias("at"), line.alias("line"))


def pretty_routes(routes: DataFrame) -> DataFrame:
    """ord, line: aligned text."""
    chain = F.array_join(F.transform("middleware", lambda m: F.coalesce(m["displayName"], F.lit("?"))), ", ")
    handler = F.coalesce("finalHandler.displayName", F.lit("?"))
    return routes.select("ord", F.format_string("%-7s %-40s %-34s %s -> %s  %s", "method", "normalizedPath", auth_label(F.col("auth")), chain, handler, source_label(F.col("source"))).alias("line"))


def totals_line(routes: DataFrame) -> str:
    """Routes by status, one sentence."""
    status, attested = F.col("auth.authStatus"), F.coalesce(F.col("auth.classificationBasis") == "configured-guard-attested", F.lit(False))
    n = routes.agg(F.count(F.lit(1)), F.count_if((status == "proven") & ~attested), F.count_if(attested), F.count_if(status == "public"), F.count_if(status == "unknown")).first()
    return f"{n[0]} route(s): {n[1]} proven (confirmed-shape), {n[2]} proven (attested), {n[3]} public, {n[4]} unknown"


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """at (severity, fingerprint), result: a SARIF result for each finding."""
    result = F.struct(
        F.col("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("detail").alias("text")).alias("message"),
        F.struct(F.col("fingerprint").alias("routeFinding/v1")).alias("partialFingerprints"),
        F.when(F.col("source").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("source.file").alias("uri")).alias("artifactLocation"), F.struct(F.col("source.line").alias("startLine")).alias("region")).alias("physicalLocation")))).alias("locations"),
    )
    return findings.select(F.struct(severity_rank(F.col("severity")).alias("severity"), "fingerprint").alias("at"), F.to_json(result).alias("result"))


def sarif_notifications(diagnostics: DataFrame) -> DataFrame:
    """at, result: a notification for each diagnostic (code, severity, message, source): problems of the scan, not of the code."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    place = F.when(F.col("source").isNotNull(), F.array(F.struct(F.struct(F.struct(F.col("source.file").alias("uri")).alias("artifactLocation"), F.when(F.col("source.line").isNotNull(), F.struct(F.col("source.line").alias("startLine"))).alias("region")).alias("physicalLocation"))))
    note = F.struct(F.struct(F.col("code").alias("id")).alias("descriptor"), level.alias("level"), F.struct(markdown_escape(F.col("message")).alias("text")).alias("message"), place.alias("locations"))
    return diagnostics.select(F.struct("code", "message").alias("at"), F.to_json(note).alias("result"))


def sarif(findings: DataFrame, most: int = 64 << 20, diagnostics: DataFrame | None = None, complete: bool = True) -> str:
    """A SARIF log of findings as results, and of diagnostics and an incomplete scan as notifications of the run."""
    results = _ordered(sarif_results(findings).select("at", F.col("result").alias("line")), most)
    notes = [] if diagnostics is None else [json.loads(r) for r in _ordered(sarif_notifications(diagnostics).select("at", F.col("result").alias("line")), most)]
    if not complete:
        notes.append({"descriptor": {"id": "incomplete-analysis"}, "level": "warning", "message": {"text": "the scan is incomplete: scanCoverage in the JSON report says what could not be resolved"}})
    rules = sorted({json.loads(r)["ruleId"] for r in results})
    run = {"tool": {"driver": {"name": "routeloom", "rules": [{"id": r} for r in rules]}}, "results": [json.loads(r) for r in results], "invocations": [{"executionSuccessful": True} | ({"toolExecutionNotifications": notes} if notes else {})]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, sort_keys=True)


def openapi(operations: DataFrame, title: str, version: str = "0.0.0", most: int = 64 << 20, *, info: dict | None = None, servers: list[str] = (), tags: list[dict] = (), schemes: dict[str, dict] | None = None, schemas: DataFrame | None = None, accept: str = "application/json") -> str:
    """An OpenAPI 3.1 document of operations with ids (path, method, operation_id, tag, parameters, security).

    Also of what described() adds to them, of `info` (title and version unless given), `servers`, `tags`, security
    schemes and component schemas (id, schema as JSON).
    """
    more = [c for c in ("summary", "all_parameters", "body", "form", "responses") if c in operations.columns]
    op = F.struct("path", F.lower("method").alias("method"), "operation_id", "tag", "parameters", "security", "registrations", *more)
    paths: dict = {}
    for line in _ordered(operations.select(F.struct("path", "method").alias("at"), F.to_json(op).alias("line")), most):
        o = json.loads(line)
        item = {"operationId": o["operation_id"], "tags": [o["tag"]], "responses": {"default": {"description": "Not described"}}, "x-registrations": o["registrations"]}
        content = lambda schema: {"content": {accept: {"schema": json.loads(schema)}}} if schema else {}
        if o.get("summary"):
            item["summary"] = o["summary"]
        if o.get("responses"):
            item["responses"] = {r["status"]: {"description": r["description"]} | content(r.get("schema")) for r in o["responses"]}
        if o.get("body"):
            item["requestBody"] = {"required": bool(o["body"].get("required"))} | ({"description": o["body"]["description"]} if o["body"].get("description") else {}) | content(o["body"].get("schema"))
        elif o.get("form"):
            needed = [f["name"] for f in o["form"] if f.get("required")]
            schema = {"type": "object", "properties": {f["name"]: json.loads(f["schema"]) for f in o["form"]}} | ({"required": needed} if needed else {})
            item["requestBody"] = {"content": {"multipart/form-data": {"schema": schema}}}
        if o.get("all_parameters"):
            item["parameters"] = [{"name": p["name"], "in": p["in"], "required": bool(p.get("required")), "schema": json.loads(p["schema"])} | ({"description": p["description"]} if p.get("description") else {}) for p in o["all_parameters"]]
        elif o.get("parameters"):
            item["parameters"] = [{"name": p, "in": "path", "required": True, "schema": {"type": "string"}} for p in o["parameters"]]
        if o["security"] == "none":
            item["security"] = []
        elif o["security"] != "unrefined":
            item["security"] = [{o["security"]: []}]
        paths.setdefault(o["path"], {})[o["method"]] = item
    document: dict = {"openapi": "3.1.0", "info": info or {"title": title, "version": version}, "paths": paths}
    if servers:
        document["servers"] = [{"url": s} for s in servers]
    if tags:
        document["tags"] = list(tags)
    parts = {"securitySchemes": schemes or {}, "schemas": {}}
    if schemas is not None:
        line = F.to_json(F.struct("id", "schema"))
        parts["schemas"] = {s["id"]: json.loads(s["schema"]) for s in map(json.loads, _ordered(schemas.select(F.col("id").alias("at"), line.alias("line")), most))}
    if parts := {k: v for k, v in parts.items() if v}:
        document["components"] = parts
    return json.dumps(document, sort_keys=True)


def html(routes: DataFrame, title: str, most: int = 64 << 20) -> str:
    """A page with the routes as data; the data can't end its script element."""
    lines = _ordered(routes.select(F.col("ord").alias("at"), F.to_json(F.struct(route_key(F.col("method"), F.col("normalizedPath")).alias("route"), F.col("auth.authStatus").alias("status"))).alias("line")), most)
    data = ("[" + ",".join(lines) + "]").replace("</", "<\\/").replace("<!--", "<\\!--")
    return f'<!doctype html><meta charset="utf-8"><title>{_html.escape(title)}</title><h1>{_html.escape(title)}</h1><table id="t"></table><script type="application/json" id="d">{data}</script><script>for(const r of JSON.parse(d.textContent)){{const x=t.insertRow();x.insertCell().textContent=r.route;x.insertCell().textContent=r.status??"-"}}</script>'


def markdown(routes: DataFrame, title: str, most: int = 64 << 20, findings: DataFrame | None = None) -> str:
    lines = _ordered(markdown_routes(routes).select(F.col("ord").alias("at"), "line"), most)
    head = ["| Method | Path | Auth | Middleware | Handler | Source |", "| --- | --- | --- | --- | --- | --- |"] if lines else ["_None._"]
    out = [f"# {title}", "", "## Summary", "", totals_line(routes), "", f"## Routes ({len(lines)})", "", *head, *lines, ""]
    if findings is not None:
        found = _ordered(markdown_findings(findings), most)
        out += [f"## Findings ({len(found)})", "", *(found or ["_None._"]), ""]
    return "\n".join(out)


def pretty(routes: DataFrame, most: int = 64 << 20, findings: DataFrame | None = None) -> str:
    lines = _ordered(pretty_routes(routes).select(F.col("ord").alias("at"), "line"), most)
    out = ["SUMMARY", f"  {totals_line(routes)}", "", f"ROUTES ({len(lines)})", *(f"  {x}" for x in lines or ["(none)"]), ""]
    if findings is not None:
        text = F.format_string("%-8s %s %s", "severity", "ruleId", F.coalesce("route", F.lit("")))
        found = _ordered(findings.select(F.struct(severity_rank(F.col("severity")).alias("severity"), "fingerprint", "ord").alias("at"), text.alias("line")), most)
        out += [f"FINDINGS ({len(found)})", *(f"  {x}" for x in found or ["(none)"]), ""]
    return "\n".join(out)


def _ordered(lines: DataFrame, most: int) -> list[str]:
    """The lines of one document in order; an error beyond `most` bytes, told by the executors before any line moves."""
    size = lines.agg(F.coalesce(F.sum(F.octet_length("line")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the document would have {size} bytes; the limit is {most}")
    return [r["line"] for r in lines.orderBy("at").select("line").toLocalIterator()]


def one(documents: DataFrame, column: str, most: int = 64 << 20) -> str:
    """The only document of a frame, after its size was checked where it is."""
    return "".join(_ordered(documents.select(F.lit(0).alias("at"), F.col(column).alias("line")), most))


#: Fields with a closed set of values.
CLOSED = {"schemaVersion": (SCHEMA_VERSION,), "command": ("inventory", "audit"), "severity": SEVERITIES, "authStatus": AUTH_STATUS, "assurance": ("analyze", "attested"), "confidence": ("high", "medium", "low")}
#: What every document must have.
REQUIRED = {"report": ("schemaVersion", "tool", "toolVersion", "classifierRulesetVersion", "command", "analysisProfile", "target", "routes", "globalMiddleware", "fallbackSurfaces", "scanCoverage", "diagnostics"), "fleet": ("schemaVersion", "kind", "targets"), "config": ()}


def json_schema(kind: DataType, name: str = "", closed: dict = CLOSED) -> dict:
    """JSON Schema of a Spark type; fields in `closed` have only those values."""
    if isinstance(kind, StructType):
        return {"type": "object", "additionalProperties": False, "properties": {f.name: json_schema(f.dataType, f.name, closed) for f in kind}}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, "", closed)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType, "", closed)}
    plain = {"string": "string", "boolean": "boolean", "int": "integer", "bigint": "integer", "double": "number"}[kind.simpleString()]
    return {"type": plain} | ({"enum": list(closed[name])} if name in closed else {})


def schema(kind: str) -> str:
    """JSON Schema of a document (report, fleet, config), from the types that the readers have."""
    from ..sources.readers import AGGREGATE, CONFIGURATION, REPORT, REPORT_REST

    types = {"report": f"{REPORT}, {REPORT_REST}", "fleet": AGGREGATE, "config": CONFIGURATION}[kind]
    closed = CLOSED | ({"status": TARGET_STATUS} if kind == "fleet" else {})
    body = json_schema(StructType.fromDDL(types), "", closed) | ({"required": list(REQUIRED[kind])} if REQUIRED[kind] else {})
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": kind} | body, sort_keys=True)
