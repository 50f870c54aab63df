"""DuckDB SQL for the queries of rules.py, from the rules themselves."""

from __future__ import annotations

from .oracle import FLEET_DELTA, FP, both, modules, now, rolled, suggestions
from .rules import JOINED


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


SUMS = ("added_routes", "removed_routes", "regressions", "improvements", "new_findings", "resolved_findings")
DECIDED = """
own AS (SELECT * FROM c2),
each AS (SELECT id, CASE WHEN length(symbol) % 3 = 0 THEN 'old' ELSE fingerprint END AS seen, name_hint AS guard, CASE WHEN length(symbol) % 4 = 0 THEN 'trust' ELSE 'analyze' END AS assurance, CASE WHEN length(symbol) % 5 = 0 THEN ' ' ELSE 'read' END AS rationale, symbol FROM own),
dec AS (SELECT id, seen, guard, assurance, rationale FROM each UNION ALL SELECT id, seen, guard, assurance, rationale FROM each WHERE symbol LIKE '%Wrap' UNION ALL SELECT 'mw-none', seen, guard, assurance, rationale FROM each WHERE symbol LIKE '%Wrap'),
rev AS (SELECT d.id, o.symbol, d.assurance, CASE WHEN count(*) OVER (PARTITION BY d.id) > 1 THEN 'decided twice' WHEN o.symbol IS NULL THEN 'unknown candidate' WHEN seen <> o.fingerprint THEN 'changed since the review' WHEN trim(rationale) = '' THEN 'no rationale' WHEN guard AND d.assurance NOT IN ('analyze', 'attested') THEN 'unknown assurance' END AS problem, guard AS eligible
  FROM dec d LEFT JOIN own o ON o.id = d.id)"""
DESCRIBED = """
q AS (SELECT '/r' || (p_partkey % 20) || '/{id}' AS path, ['GET', 'POST', 'PUT'][p_partkey % 3 + 1] AS method, p_partkey AS ord, CASE WHEN p_partkey % 11 = 0 THEN 'id' ELSE 'p' || (p_partkey % 4) END AS name, CASE WHEN p_partkey % 11 = 0 THEN 'path' ELSE ['query', 'header', 'body', 'formData'][p_partkey % 7 % 4 + 1] END AS place, p_partkey % 2 = 0 AS required, 'd' || p_partkey AS description FROM part),
o AS (SELECT DISTINCT path, method FROM q),
p AS (SELECT path, method, name, place, min(ord) AS first_at, arg_max(description, ord) AS d FROM (SELECT path, method, ord, name, place, description FROM q WHERE place NOT IN ('body', 'formData') UNION ALL SELECT path, method, -1, 'id', 'path', '' FROM o) GROUP BY 1, 2, 3, 4),
pl AS (SELECT path, method, string_agg(place || ':' || name || ':' || d, ',' ORDER BY first_at) AS parameters FROM p GROUP BY 1, 2),
b AS (SELECT path, method, arg_min(description, ord) AS body FROM q WHERE place = 'body' GROUP BY 1, 2),
f AS (SELECT path, method, string_agg(name || ':' || required, ',' ORDER BY name) AS form FROM (SELECT path, method, name, bool_or(required) AS required FROM q WHERE place = 'formData' GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT path, method, ord, '20' || (ord % 5) AS status, CASE WHEN ord % 2 = 0 THEN 'Response' ELSE 'r' || ord END AS description FROM q),
r AS (SELECT path, method, string_agg(status || ':' || d, ',' ORDER BY status) AS responses FROM (SELECT path, method, status, arg_max(description, ord) AS d FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
#: The documented operations of openapi_overlay: a row for each (target, path, method).
OPS = """
ops AS (SELECT target, path, method, min(route_id) AS ord, CAST(regexp_extract(path, '\\d+$') AS INT) AS tail FROM cls GROUP BY 1, 2, 3),
docs AS (SELECT *, CASE WHEN tail % 3 = 0 AND tail % 2 = 0 THEN 'named' || (tail % 5) END AS documented_id, CASE WHEN tail % 3 = 0 THEN 'about ' || path END AS summary FROM ops)"""


def oracle_sql() -> dict[str, str]:
    head = lambda k, t, s: f"CASE WHEN {k} % 19 <> 7 THEN {k} % 3 // 2 + 1 END AS major{s}, {k} % 11 <> 4 AS audit{s}, {t} = 'F' AS syntax{s}, CASE WHEN {t} <> 'P' THEN substr({t}, 1, 1) END AS goos{s}"
    compatible = f"""WITH f AS (SELECT o_custkey AS c, min(o_orderkey) AS k0, arg_min(o_orderstatus, o_orderkey) AS t0 FROM orders GROUP BY 1), p AS (SELECT o_orderkey AS k, {head("o_orderkey", "o_orderstatus", "")}, {head("k0", "t0", "0")} FROM orders JOIN f ON c = o_custkey)
      SELECT k, 'schema version' AS reason FROM p WHERE coalesce(major <> major0, true) UNION ALL SELECT k, 'command' FROM p WHERE NOT (audit AND audit0) UNION ALL SELECT k, 'analysis profile' FROM p WHERE syntax <> syntax0 UNION ALL SELECT k, 'build context' FROM p WHERE goos IS DISTINCT FROM goos0"""
    cases = ", ".join(f"({i}, {text(p)})" for i, (b, r, p) in enumerate(JOINED))
    bases = ", ".join(f"({i}, {text(b)}, {text(r)})" for i, (b, r, _) in enumerate(JOINED))
    return {
        "text_rules": """WITH r AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '12.3.4' WHEN 2 THEN '.5' ELSE '7' END AS version, s_suppkey % 4 AS num, s_suppkey % 5 AS den, s_suppkey % 3 = 0 AS done,
            CASE WHEN s_suppkey % 5 = 0 THEN 'example.org/x' ELSE 'github.com/acme/svc' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '/v2' ELSE '' END END AS module, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'h' || s_suppkey END AS host, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/v1' WHEN 2 THEN 'v2' ELSE '' END AS base FROM supplier),
          s AS (SELECT *, CASE WHEN base LIKE '/%' THEN base ELSE '/' || base END AS b, CASE WHEN k % 6 = 0 THEN 'root' ELSE 'module-' || substr(sha256('mods/m' || k), 1, 16) END AS ident FROM r)
          SELECT k, CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '12' END AS major, CASE WHEN den = 0 THEN 'N/A' ELSE printf('%.1f%% (%d/%d)', 100.0 * num / den, num, den) || CASE WHEN done THEN '' ELSE ' · unknown' END END AS metric,
            CASE WHEN module LIKE '%/' THEN module ELSE list_last(string_split(module, '/')) END AS repo, CASE WHEN k % 5 <> 0 THEN 'https://github.com/acme/svc' || k END AS url,
            CASE WHEN host <> '' THEN CASE WHEN k % 2 = 0 THEN 'http://' || host || b || ',wss://' || host || b ELSE 'https://' || host || b END WHEN base = '' THEN '' ELSE b END AS servers, k % 4 = 2 AS safe, ident AS module_id, k % 2 = 1 AS valid_id FROM s""",
        "joined_paths": f"""WITH c(i, path) AS (VALUES {cases}), s(i, base, relative) AS (VALUES {bases}), n AS (SELECT lower(replace(n_name, ' ', '-')) AS n FROM nation)
          SELECT n, i, CASE WHEN relative = '' THEN '/' || n || base WHEN base = '/a/b' AND relative = '..' THEN '/' || n || '/a' WHEN base = '/api' AND relative = '../../x' THEN '/x' ELSE '/' || n || CASE WHEN base IN ('/', '') AND relative = '/' THEN '/' ELSE path END END AS path FROM n, c JOIN s USING (i)""",
        "template_rules": r"""WITH p AS (SELECT c_custkey AS k, c_custkey % 5 AS m FROM customer)
          SELECT k, CASE m WHEN 0 THEN '/' WHEN 1 THEN '/v' || k || '/users/{id}' WHEN 2 THEN '/files/{path}' WHEN 3 THEN '/a-b/c_d/{x}/{y}' ELSE '/{only}' END AS template, CASE m WHEN 0 THEN '' WHEN 1 THEN 'id' WHEN 2 THEN 'path' WHEN 3 THEN 'x,y' ELSE 'only' END AS parameters, m = 2 AS catch_all,
            CASE m WHEN 1 THEN 'v' || k WHEN 2 THEN 'files' WHEN 3 THEN 'a-b' ELSE 'default' END AS tag, CASE m WHEN 0 THEN 'getRoot' WHEN 1 THEN 'getV' || k || 'UsersById' WHEN 2 THEN 'getFilesByPath' WHEN 3 THEN 'getABCDByXByY' ELSE 'getByOnly' END AS operation FROM p""",
        "scope_filter": "SELECT p_partkey AS k, p_partkey % 5 BETWEEN 1 AND 3 AND p_partkey % 3 <> 2 AS inside FROM part",
        "markdown_cells": r"""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace('a|b`c\d' || chr(13) || chr(10) || html, '\', '\\'), '|', '\|'), '`', ''''), chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' '), '<', '&lt;'), '>', '&gt;')) AS cell FROM pages""",
        "markdown_findings": now(f"SELECT route_id, {FP} AS fingerprint, '- **' || severity || '** `' || rule || '` · `' || route || '` — x\\|y' || CASE WHEN route_id % 2 = 0 THEN chr(10) || '  - _Recommendation:_ &lt;b&gt;' ELSE '' END AS line FROM fnd"),
        "sarif_notifications": "SELECT 'c' || (s_suppkey % 3) AS code, ['error', 'warning', 'note'][s_suppkey % 3 + 1] AS level, 'm\\|' || s_suppkey AS message, CASE WHEN s_suppkey % 2 = 0 THEN 'a.go' END AS uri, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '-' END AS line FROM supplier",
        "engine_findings": "SELECT 'e' || s_suppkey AS engine, 'trust-all-proxies' AS \"ruleId\", 'medium' AS severity FROM supplier WHERE s_suppkey % 4 < 2 UNION ALL SELECT 'e' || s_suppkey, 'debug-mode', 'low' FROM supplier WHERE s_suppkey % 3 = 0",
        "scan_coverage": """WITH p AS (SELECT 'repo-' || (p_partkey % 5) AS target, p_size AS files, p_partkey % 45 = 1 AS bad, p_partkey % 50 = 2 AS lost FROM part), s AS (SELECT 'repo-' || (s_suppkey % 4) AS target, count(*) FILTER (s_suppkey % 8 IN (3, 6)) AS n FROM supplier GROUP BY 1)
          SELECT target, count(*) AS discovered_packages, count(*) FILTER (bad) AS failed_packages, CAST(sum(files) AS BIGINT) AS discovered_files, CAST(coalesce(sum(files) FILTER (bad), 0) AS BIGINT) AS failed_files, count(*) FILTER (lost) AS load_errors, coalesce(any_value(n), 0) AS unresolved_registrations, count(*) FILTER (bad) = 0 AND count(*) FILTER (lost) = 0 AND coalesce(any_value(n), 0) = 0 AS complete FROM p LEFT JOIN s USING (target) GROUP BY target""",
        "compatibility": compatible,
        "fingerprint_mismatch": "SELECT unnest(list_filter([CASE WHEN 'r0' <> 'r0' THEN 'scope' END, CASE WHEN a.n_nationkey <> b.n_nationkey THEN 'scan' END], lambda x: x IS NOT NULL)) AS kind FROM nation a, nation b WHERE a.n_nationkey = 1 AND b.n_nationkey = 2",
        "reuse": "SELECT 'svc-' || c_custkey AS target, c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 2 = 1 AND c_custkey % 6 <> 5 AND c_custkey % 10 = c_custkey % 20 AS held FROM customer",
        "review_queue": """WITH f AS (SELECT o_custkey AS k, string_agg(DISTINCT 'acme/auth.Require' || (o_orderkey % 4), ',' ORDER BY 'acme/auth.Require' || (o_orderkey % 4)) AS symbols FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 3 GROUP BY 1),
          t AS (SELECT c_custkey AS k, symbols, CASE WHEN c_custkey % 7 = 1 THEN 'not-applicable' WHEN c_custkey % 7 = 0 THEN 'scan-failed' WHEN c_custkey % 5 = 0 THEN 'scan-incomplete' WHEN c_custkey % 11 = 0 THEN 'reviewed-config-applied' WHEN c_custkey % 13 = 0 THEN 'enrichment-failed' WHEN symbols IS NOT NULL THEN 'candidates-to-review' ELSE 'no-candidates' END AS state FROM customer LEFT JOIN f ON k = c_custkey)
          SELECT 'svc-' || k AS target, state, CASE WHEN state IN ('scan-incomplete', 'enrichment-failed', 'candidates-to-review') THEN coalesce(symbols, '') ELSE '' END AS symbols FROM t""",
        "docs_overview": """WITH c AS (SELECT o_custkey AS k, bool_or(o_orderkey % 5 = 0) AS three, bool_or(o_orderkey % 5 = 1) AS two, bool_or(o_orderkey % 4 IN (1, 3)) AS loose, sum(o_orderkey % 3) AS n, sum(o_orderkey % 4) AS d FROM orders GROUP BY 1)
          SELECT 'svc-' || c_custkey AS target, CASE WHEN three AND two THEN 'both' WHEN three THEN 'openapi3' WHEN two THEN 'swagger2' WHEN coalesce(loose, true) THEN 'unavailable' ELSE 'none' END AS docs, CASE WHEN d > 0 THEN round(100.0 * n / d, 1) END AS observed_percent FROM customer LEFT JOIN c ON k = c_custkey""",
        "fleet_delta_summary": f"""WITH d AS ({both(FLEET_DELTA)}) SELECT count(*) FILTER (status = 'added-target') AS added_targets, count(*) FILTER (status = 'removed-target') AS removed_targets, count(*) FILTER (status = 'status-changed') AS status_changes, count(*) FILTER (status IN ('incomparable', 'status-changed')) AS incomparable_targets,
          {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in SUMS)}, NOT bool_or(status IN ('incomparable', 'status-changed')) AS complete FROM d""",
        "repo_groups": f"SELECT target AS name, category FROM ({now(f', {modules(0)} {rolled("m0")}')})",
        "review_decisions": now(f", {suggestions('')}, {DECIDED} SELECT * FROM rev"),
        "review_summary": now(f", {suggestions('')}, {DECIDED} SELECT count(*) AS assessed, count(*) FILTER (eligible) AS config_suggestions, (SELECT count(*) FROM own) AS total_candidates FROM rev"),
        "hidden_methods": now("SELECT route_id, 'CONNECT' AS method, path AS \"normalizedPath\", 'openapi-non-representable-method' AS code FROM e WHERE route_id % 5 = 1"),
        "openapi_overlay": now(f", {OPS} SELECT target, path, method, documented_id, summary, tail % 3 = 0 AND tail % 4 = 1 AND NOT (method = 'GET' AND path = '/elsewhere') AS router_mismatch FROM docs"),
        "documented_ids": now(f""", {OPS}, b AS (SELECT *, lower(method) || 'ApiV1R' || tail AS base FROM docs), n AS (SELECT *, row_number() OVER (PARTITION BY target, base ORDER BY ord) AS i, row_number() OVER (PARTITION BY target, documented_id ORDER BY ord) AS j FROM b)
          SELECT target, path, method, CASE WHEN documented_id IS NULL THEN base || CASE WHEN i > 1 THEN '-' || i ELSE '' END ELSE documented_id || CASE WHEN j > 1 THEN '' || j ELSE '' END END AS operation_id FROM n"""),
        "openapi_descriptions": f"""WITH {DESCRIBED} SELECT path, method, parameters, body, form, responses FROM o LEFT JOIN pl USING (path, method) LEFT JOIN b USING (path, method) LEFT JOIN f USING (path, method) LEFT JOIN r USING (path, method)""",
        "openapi_conflicts": f"""WITH {DESCRIBED}, n AS (SELECT path, method, count(*) FILTER (place = 'body') AS b, count(*) FILTER (place = 'formData') AS f FROM q GROUP BY 1, 2)
          SELECT path, method, 'swag-request-body-conflict' AS code, greatest(b - 1, 0) + CASE WHEN b > 0 AND f > 0 THEN 1 ELSE 0 END AS n FROM n WHERE greatest(b - 1, 0) + CASE WHEN b > 0 AND f > 0 THEN 1 ELSE 0 END > 0
          UNION ALL SELECT path, method, 'swag-response-conflict', count(*) - count(DISTINCT status) AS n FROM s GROUP BY 1, 2 HAVING n > 0""",
        "component_merge": """WITH s AS (SELECT 'repo-' || (p_partkey % 5) AS target, 'T' || (p_partkey % 40) AS id, p_partkey AS ord, CASE WHEN p_partkey % 40 < 20 THEN '{"type":"object"}' ELSE '{"minimum":' || (p_partkey % 3) || '}' END AS s FROM part) SELECT target, id, arg_min(s, ord) AS schema, count(DISTINCT s) > 1 AS conflict FROM s GROUP BY 1, 2""",
        "unknown_references": "SELECT 'T' || p_partkey AS id, 'T' || p_partkey * 3 AS ref FROM part WHERE p_partkey * 3 NOT IN (SELECT p_partkey FROM part)",
        "last_wins": "SELECT o_custkey AS operation, 'p' || (o_orderkey % 3) AS name, arg_max(o_orderstatus, o_orderkey) AS value, count(*) > 1 AS replaced FROM orders GROUP BY 1, 2",
        "type_schemas": r"""WITH k AS (SELECT c_custkey AS k, 'acme/m.T' || c_custkey AS r, CASE c_custkey % 5 WHEN 0 THEN '"type":"string"' WHEN 1 THEN '"format":"int64","type":"integer"' WHEN 2 THEN '"format":"float","type":"number"' END AS t FROM customer),
          b AS (SELECT *, CASE WHEN k % 5 = 3 THEN '{"$ref":"#/components/schemas/T' || k || '_' || substr(sha256(r), 1, 10) || '"}' ELSE '{' || t || '}' END AS b, CASE WHEN k % 5 = 3 THEN '{"$ref":"#/components/schemas/T' || k || '_' || substr(sha256(r), 1, 10) || '"}' ELSE '{' || regexp_replace(t, '"type":("\w+")', '"type":[\1,"null"]') || '}' END AS bn FROM k),
          i AS (SELECT *, coalesce('"items":' || b || ',', '') AS items FROM b), w AS (SELECT *, CASE k % 3 WHEN 0 THEN b WHEN 1 THEN '{' || items || '"type":"array"}' ELSE bn END AS s, CASE k % 3 WHEN 1 THEN '{' || items || '"type":["array","null"]}' ELSE bn END AS sn FROM i)
          SELECT CAST(k AS VARCHAR) AS id, coalesce(CASE k % 4 WHEN 0 THEN s WHEN 1 THEN sn WHEN 2 THEN '{' || coalesce('"items":' || s || ',', '') || '"type":"array"}' ELSE '{' || coalesce('"additionalProperties":' || s || ',', '') || '"type":"object"}' END, '{}') AS schema FROM w""",
        "global_merge": "WITH g AS (SELECT 'f' || (p_partkey % 6) AS field, p_partkey AS ord, CASE WHEN p_partkey % 6 < 3 THEN 'same' ELSE 'v' || (p_partkey % 7) END AS value FROM part WHERE p_partkey % 4 <> 0) SELECT field, arg_max(value, ord) AS value, count(DISTINCT value) > 1 AS conflict FROM g GROUP BY 1",
        "uncalled_registrars": "SELECT 'acme/routes.R' || c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)",
        "annotation_join": now("SELECT route_id, CASE WHEN k % 10 <> 3 THEN 'about ' || (k % 10) END AS swag FROM e"),
        "relative_sources": "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'pkg/f' || p_partkey || '.go' WHEN 1 THEN 'acme/lib' || CASE WHEN p_partkey % 2 = 0 THEN '@v1.2.0' ELSE '' END || '/f' || p_partkey || '.go' ELSE 'external:unresolved' END AS file FROM part",
        "manifest_order": "SELECT 'svc-' || c_custkey AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN c_custkey * 3 ELSE 0 END AS ord FROM customer",
        "nested_groups": """WITH RECURSIVE t(k, path, depth) AS (SELECT c_custkey, '/g' || (c_custkey % 10) || CASE WHEN c_custkey % 4 = 0 THEN '/' ELSE '' END, 0 FROM customer WHERE c_custkey < 10
          UNION ALL SELECT c_custkey, rtrim(path, '/') || '/g' || (c_custkey % 10) || CASE WHEN c_custkey % 4 = 0 THEN '/' ELSE '' END, depth + 1 FROM customer JOIN t ON k = c_custkey // 10 WHERE c_custkey >= 10) SELECT k AS group_id, path, CAST(depth AS BIGINT) AS depth FROM t""",
        "report_json": both(f""", {REPORT}"""),
    }


REPORT = f"""
rk AS (SELECT *, CASE status WHEN 'proven' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS risk FROM cls), rk1 AS (SELECT *, CASE status WHEN 'proven' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS risk FROM cls1),
a AS (SELECT target, route, max(risk) AS risk FROM rk GROUP BY 1, 2), b AS (SELECT target, route, max(risk) AS risk FROM rk1 GROUP BY 1, 2),
j AS (SELECT coalesce(a.target, b.target) AS target, coalesce(a.route, b.route) AS route, CASE WHEN b.route IS NULL THEN 'added' WHEN a.route IS NULL THEN 'removed' WHEN a.risk > b.risk THEN 'regression' WHEN a.risk < b.risk THEN 'improvement' END AS change FROM a FULL OUTER JOIN b ON a.target = b.target AND a.route = b.route),
dl AS (SELECT target, coalesce(string_agg(route, ',' ORDER BY route) FILTER (change = 'added'), '') AS added, coalesce(string_agg(route, ',' ORDER BY route) FILTER (change = 'removed'), '') AS removed, count(*) FILTER (change = 'regression') AS regressions,
  coalesce(string_agg(split_part(route, ' ', 2), ',' ORDER BY split_part(route, ' ', 1), split_part(route, ' ', 2)) FILTER (change = 'improvement'), '') AS improved FROM j GROUP BY 1),
n AS (SELECT route_id, count(*) AS n FROM mw GROUP BY 1),
rt AS (SELECT target, count(*) AS routes, md5(string_agg(method || ' ' || path || ' ' || status || ' ' || n, ';' ORDER BY route_id)) AS routes_md5, count(*) FILTER (status = 'proven') AS proven, count(*) FILTER (basis = 'configured-guard-attested') AS att, count(*) FILTER (status = 'public') AS public, count(*) FILTER (status = 'unknown') AS unknown FROM cls JOIN n USING (route_id) GROUP BY 1),
fd AS (SELECT target, md5(string_agg({FP}, ',' ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, {FP}, route_id)) AS findings_md5, nullif(count(*) FILTER (severity = 'high'), 0) AS high FROM fnd GROUP BY 1)
SELECT target, 'acme/' || target AS module, routes, routes_md5, findings_md5, routes AS "totalRoutes", proven - att AS "provenByConfirmedShape", att AS "provenByAttestedUnresolved", public, unknown, high, added, removed, regressions, improved FROM rt JOIN fd USING (target) JOIN dl USING (target)"""
