"""DuckDB SQL for the registered queries: the same facts, each operator written a second time as SQL."""

from __future__ import annotations

from .adapter import ADMIN, CHECK, LEGACY, LOGGER, UNUSED, USER, WRAP


def facts(snapshot: int, s: str = "") -> str:
    """CTEs e (routes), mw (chains), auth (classification) for one snapshot, named with suffix s."""
    g = "(k % 20 + event_id % 2 * 3) % 11" if snapshot else "(k % 20 + event_id % 3) % 11"
    place = "(k % 20 + CASE WHEN event_id % 29 = 0 THEN 40 ELSE 0 END)" if snapshot else "(k % 20 + CASE WHEN event_id % 31 = 0 THEN 20 ELSE 0 END)"
    return f"""
e{s} AS (
  SELECT event_id AS route_id, user_id, 'repo-' || (user_id % 5) AS target, 'mod-' || (user_id % 3) AS module_id, {g} AS g,
    CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'GET' WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS method,
    '/api/v1/r' || {place} AS path, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), mw{s} AS (
  SELECT route_id, 0 AS pos, '{LOGGER}' AS symbol, false AS opaque FROM e{s}
  UNION ALL
  SELECT route_id, 1, CASE WHEN g < 4 THEN '{USER}' WHEN g < 6 THEN '{ADMIN}' WHEN g = 6 THEN '{LEGACY}' WHEN g = 8 THEN '{WRAP}' WHEN g = 9 THEN '{CHECK}' END, g = 7 FROM e{s} WHERE g < 10
  UNION ALL
  SELECT route_id, 2, '{LEGACY}', false FROM e{s} WHERE route_id % 13 = 0
), cfg{s} AS (
  SELECT * FROM (VALUES ('{USER}', 'analyze', 'confirmed-shape', 'user', 'member', 'read'), ('{ADMIN}', 'attested', 'unresolved', 'admin,user', 'admin', 'read,write'), ('{LEGACY}', 'analyze', 'contradicted', '', '', ''), ('{UNUSED}', 'analyze', 'confirmed-shape', '', '', '')) c(symbol, assurance, shape, tags, roles, scopes)
), gm{s} AS (
  SELECT m.route_id, m.pos, c.symbol, c.assurance, c.shape FROM mw{s} m JOIN cfg{s} c ON c.symbol = CASE WHEN m.symbol = '{WRAP}' THEN '{USER}' ELSE m.symbol END
), pick{s} AS (
  SELECT e.route_id,
    min(gm.pos) FILTER (gm.shape = 'confirmed-shape' OR (gm.shape = 'unresolved' AND gm.assurance = 'attested')) AS p,
    min(gm.pos) FILTER (gm.shape = 'contradicted') AS c, min(gm.pos) FILTER (gm.shape = 'unresolved' AND gm.assurance <> 'attested') AS u
  FROM e{s} e LEFT JOIN gm{s} gm USING (route_id) GROUP BY 1
), side{s} AS (
  SELECT route_id, bool_or(opaque) AS opaque, bool_or(symbol = '{CHECK}') AS loose FROM mw{s} GROUP BY 1
), auth{s} AS (
  SELECT e.*, gm.assurance, gm.symbol AS guard, gm.shape AS gshape, coalesce(cf.tags, '') AS tags, coalesce(cf.roles, '') AS roles, coalesce(cf.scopes, '') AS scopes, p IS NOT NULL AS sure,
    e.method || ' ' || e.path AS route,
    CASE WHEN p IS NOT NULL THEN CASE WHEN gm.shape = 'unresolved' THEN 'configured-guard-attested' ELSE 'configured-guard-confirmed' END
         WHEN gm.symbol IS NOT NULL THEN CASE WHEN gm.shape = 'contradicted' THEN 'configured-guard-contradicted' ELSE 'configured-guard-unconfirmed' END
         WHEN s.opaque THEN 'opaque-middleware-present' WHEN s.loose THEN 'unconfigured-guard-confirmed-shape' ELSE 'no-configured-guard-matched' END AS basis
  FROM e{s} e JOIN pick{s} USING (route_id) JOIN side{s} s USING (route_id)
  LEFT JOIN gm{s} gm ON gm.route_id = e.route_id AND gm.pos = coalesce(p, c, u) LEFT JOIN cfg{s} cf ON cf.symbol = gm.symbol
), cls{s} AS (
  SELECT *, CASE WHEN sure THEN 'proven' WHEN basis = 'no-configured-guard-matched' THEN 'public' ELSE 'unknown' END AS status,
    basis = 'no-configured-guard-matched' AND route IN ('GET /api/v1/r9', 'POST /api/v1/r5', 'GET /nope') AS accepted
  FROM auth{s}
), fnd{s} AS (
  SELECT route_id, target, module_id, route, 'matched-but-unenforced' AS rule, 'high' AS severity FROM cls{s} JOIN gm{s} USING (route_id) WHERE gm{s}.shape = 'contradicted'
  UNION ALL SELECT route_id, target, module_id, route, 'opaque-middleware', 'medium' FROM cls{s} WHERE basis = 'opaque-middleware-present'
  UNION ALL SELECT route_id, target, module_id, route, 'unconfigured-guard', 'medium' FROM cls{s} WHERE basis = 'unconfigured-guard-confirmed-shape'
  UNION ALL SELECT route_id, target, module_id, route, 'public-route', 'medium' FROM cls{s} WHERE status = 'public' AND NOT accepted
)"""


FP = "sha256(rule || '|' || route)"
RISK = "CASE status WHEN 'proven' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END"


def now(body: str) -> str:
    return f"WITH {facts(0)} {body}"


def both(body: str) -> str:
    return f"WITH {facts(0)}, {facts(1, '1')} {body}"


def top(s: str, key: str = "route") -> str:
    return f"SELECT * FROM (SELECT *, {RISK} AS risk, row_number() OVER (PARTITION BY {key} ORDER BY {RISK} DESC, route_id) AS rn FROM cls{s}) WHERE rn = 1"


def chain(s: str, r: str) -> str:
    return f"(SELECT list(coalesce(symbol, 'func literal') ORDER BY pos) FROM mw{s} m WHERE m.route_id = {r}.route_id)"


def minus(a: str, b: str) -> str:
    return f"list_filter(string_split({a}, ','), lambda x: x <> '' AND NOT list_contains(string_split({b}, ','), x))"


DIFF = f"""
, b AS (SELECT t.*, {chain('1', 't')} AS chain FROM ({top('1')}) t), a AS (SELECT t.*, {chain('', 't')} AS chain FROM ({top('')}) t),
d AS (
  SELECT coalesce(a.route, b.route) AS route, a.route IS NOT NULL AND b.route IS NOT NULL AS paired, b.status AS s0, a.status AS s1,
    CASE WHEN b.route IS NULL THEN 'added' WHEN a.route IS NULL THEN 'removed' WHEN a.risk > b.risk THEN 'regression' WHEN a.risk < b.risk THEN 'improvement' END AS change,
    {minus('b.tags', 'a.tags')} AS lost, {minus('a.tags', 'b.tags')} AS won, list_concat({minus('b.roles', 'a.roles')}, {minus('b.scopes', 'a.scopes')}) AS less,
    list_concat({minus('a.roles', 'b.roles')}, {minus('a.scopes', 'b.scopes')}) AS more, list_filter(b.chain, lambda x: NOT list_contains(a.chain, x)) AS gone,
    list_sort(a.chain) = list_sort(b.chain) AND a.chain <> b.chain AS moved
  FROM b FULL OUTER JOIN a USING (route)
)
SELECT route, change, CASE WHEN paired THEN s0 END AS "from", CASE WHEN paired THEN s1 END AS "to",
  CASE WHEN NOT paired THEN NULL WHEN len(lost) > 0 THEN 'Recognized auth tag(s) removed: ' || array_to_string(lost, ', ') || '.' WHEN len(won) > 0 THEN 'Recognized auth tag(s) added: ' || array_to_string(won, ', ') || '.'
    WHEN len(less) > 0 THEN 'Authorization grant(s) removed: ' || array_to_string(less, ', ') || '.' WHEN len(more) > 0 THEN 'Authorization grant(s) added: ' || array_to_string(more, ', ') || '.'
    WHEN len(gone) > 0 THEN 'Middleware removed from the route chain: ' || array_to_string(gone, ', ') || '.'
    WHEN s1 = 'unknown' AND s0 <> 'unknown' THEN 'The route is now guarded only by middleware whose enforcement could not be confirmed.'
    WHEN moved THEN 'The middleware chain order changed alongside the authentication classification.'
    ELSE 'Authentication classification changed without a visible route-level middleware difference; check authMiddleware configuration or shared mount wiring.' END AS explanation
FROM d WHERE change IS NOT NULL"""

SHAPES = f"SELECT * FROM (VALUES ('{USER}', 'confirmed-shape'), ('{ADMIN}', 'unresolved'), ('{LEGACY}', 'contradicted'), ('{CHECK}', 'confirmed-shape'), ('{UNUSED}', 'confirmed-shape')) s(symbol, shape)"
HINT = "regexp_matches(regexp_extract(symbol, '[^/]*$'), '(?i)auth|login|token|guard|require|admin')"


def suggestions(by: str) -> str:
    """Candidates grouped by `by` ('' or 'target'); the adapter's symbols hold none of the known others."""
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""
pairs AS (SELECT DISTINCT {g}method || ' ' || path AS route, symbol FROM e JOIN mw USING (route_id) WHERE symbol IS NOT NULL),
tot AS (SELECT {g}count(*) AS total_routes FROM e {'GROUP BY ' + by if by else ''}), sh AS ({SHAPES}),
c0 AS (SELECT {g}symbol, count(*) AS route_count, list_slice(list(route ORDER BY route), 1, 5) AS samples FROM pairs GROUP BY {g}symbol),
c1 AS (SELECT c0.*, tot.total_routes, sh.shape, {HINT.replace('symbol', 'c0.symbol')} AS name_hint, false AS known_non_auth, route_count = total_routes AS applies_to_all, 'mw-' || substr(sha256(c0.symbol), 1, 12) AS id
  FROM c0 JOIN tot {on} LEFT JOIN sh ON sh.symbol = c0.symbol),
c2 AS (SELECT *, sha256(concat_ws(chr(0), symbol, route_count, total_routes, applies_to_all, name_hint, known_non_auth, coalesce(shape, ''), '', array_to_string(samples, chr(0)))) AS fingerprint,
  row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY CASE shape WHEN 'confirmed-shape' THEN 0 WHEN 'contradicted' THEN 2 ELSE 1 END, name_hint DESC, known_non_auth, applies_to_all, route_count, symbol) AS rank FROM c1)"""


SPECS = """
sp AS (SELECT * FROM (VALUES ('s1', 'authored'), ('s2', 'generated'), ('s3', 'unknown')) s(spec_id, authorship)),
ops AS (SELECT DISTINCT 's' || ((k % 25 + user_id % 2) % 3 + 1) AS spec_id, method || ' /api/v1/r' || (k % 25 + 2) AS operation FROM e),
docs AS (SELECT operation, count(*) AS owners, bool_or(authorship = 'authored') AS authored, bool_or(authorship = 'unknown') AS unsure FROM ops JOIN sp USING (spec_id) GROUP BY 1),
code AS (SELECT DISTINCT method || ' ' || path AS operation, true AS code FROM e),
rec AS (SELECT operation, coalesce(code, false) AS in_code, owners IS NOT NULL AS in_docs, coalesce(owners, 0) AS owners, coalesce(code AND authored, false) AS covered,
  coalesce(code AND unsure, false) AS unsure, coalesce(code AND owners > 1, false) AS ambiguous FROM code FULL OUTER JOIN docs USING (operation))"""


def modules(snapshot: int) -> str:
    s = "1" if snapshot else ""
    return f"""m{snapshot} AS (SELECT target, module_id, CASE WHEN module_id = 'mod-2' THEN 'go-module' ELSE 'gin-application' END AS kind,
    CASE WHEN target || module_id = '{'repo-2mod-0' if snapshot else 'repo-1mod-2'}' THEN 'failed' ELSE 'ok' END AS status, target || module_id <> 'repo-3mod-1' AS complete,
    count(*) AS routes, count(*) FILTER (status = 'proven') AS proven, count(*) FILTER (status = 'public') AS public, count(*) FILTER (status = 'unknown') AS unknown FROM cls{s} GROUP BY 1, 2)"""


def rolled(source: str) -> str:
    return f"""SELECT *, CASE WHEN routes > 0 THEN 'gin-routes' WHEN status = 'failed' THEN 'failed' WHEN NOT complete OR NOT verified THEN 'no-routes-unverified' WHEN any_gin THEN 'gin-no-routes' ELSE 'non-gin' END AS category FROM (
    SELECT target, count(*) AS modules, CAST(sum(routes) AS BIGINT) AS routes, CAST(sum(proven) AS BIGINT) AS proven, CAST(sum(public) AS BIGINT) AS public, CAST(sum(unknown) AS BIGINT) AS unknown,
    bool_and(status = 'ok' AND complete) AS complete, bool_or(kind LIKE 'gin-%') AS any_gin, bool_and(status = 'ok' AND complete AND kind IN ('gin-application', 'gin-module-no-routes', 'go-module')) AS verified,
    CASE WHEN count(*) FILTER (kind LIKE 'gin-%' AND status = 'failed') > 0 OR count(*) FILTER (status = 'ok') = 0 THEN 'failed' ELSE 'ok' END AS status FROM {source} GROUP BY target)"""


SUMS = ("added_routes", "removed_routes", "regressions", "improvements", "new_findings", "resolved_findings")
FLEET_DELTA = f"""
, {modules(0)}, {modules(1)}, n AS (SELECT * FROM m0 WHERE NOT (target = 'repo-4' AND module_id = 'mod-1')), t1 AS ({rolled('m1')}), t0 AS ({rolled('n')}),
td AS (SELECT target, CASE WHEN a.status IS NULL THEN 'removed-target' WHEN b.status IS NULL THEN 'added-target' WHEN a.status <> b.status THEN 'status-changed' WHEN b.status <> 'ok' THEN 'unchanged' WHEN NOT a.complete OR NOT b.complete THEN 'incomparable' END AS status FROM t1 b FULL OUTER JOIN t0 a USING (target)),
k1 AS ({top('1', 'target, module_id, route')}), k0 AS ({top('', 'target, module_id, route')}),
rd AS (SELECT target, module_id, count(*) FILTER (b.route IS NULL) AS added, count(*) FILTER (a.route IS NULL) AS removed, count(*) FILTER (a.risk > b.risk) AS regressions, count(*) FILTER (a.risk < b.risk) AS improvements FROM k1 b FULL OUTER JOIN k0 a USING (target, module_id, route) GROUP BY 1, 2),
f1 AS (SELECT DISTINCT target, module_id, rule, route, 1 AS x FROM fnd1), f0 AS (SELECT DISTINCT target, module_id, rule, route, 1 AS x FROM fnd),
fd AS (SELECT target, module_id, count(*) FILTER (b.x IS NULL) AS new, count(*) FILTER (a.x IS NULL) AS resolved FROM f1 b FULL OUTER JOIN f0 a USING (target, module_id, rule, route) GROUP BY 1, 2),
md AS (SELECT target, module_id, CASE WHEN b.status IS NULL THEN 'added-module' WHEN a.status IS NULL THEN 'removed-module' WHEN a.status <> b.status THEN 'status-changed' WHEN b.status <> 'ok' OR NOT a.complete OR NOT b.complete THEN 'incomparable' ELSE 'unchanged' END AS st, a.routes AS ra, b.routes AS rb FROM m1 b FULL OUTER JOIN n a USING (target, module_id)),
mm AS (SELECT md.target, st, CASE WHEN st = 'unchanged' THEN coalesce(added, 0) WHEN st = 'added-module' THEN ra ELSE 0 END AS added_routes, CASE WHEN st = 'unchanged' THEN coalesce(removed, 0) WHEN st = 'removed-module' THEN rb ELSE 0 END AS removed_routes,
  CASE WHEN st = 'unchanged' THEN coalesce(regressions, 0) ELSE 0 END AS regressions, CASE WHEN st = 'unchanged' THEN coalesce(improvements, 0) ELSE 0 END AS improvements, CASE WHEN st = 'unchanged' THEN coalesce(new, 0) ELSE 0 END AS new_findings, CASE WHEN st = 'unchanged' THEN coalesce(resolved, 0) ELSE 0 END AS resolved_findings
  FROM md LEFT JOIN rd USING (target, module_id) LEFT JOIN fd USING (target, module_id)),
ag AS (SELECT target, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in SUMS)}, bool_or(st IN ('status-changed', 'incomparable')) AS blocked FROM mm WHERE target IN (SELECT target FROM td WHERE status IS NULL) GROUP BY 1)
SELECT target, coalesce(status, CASE WHEN blocked THEN 'incomparable' ELSE 'unchanged' END) AS status, {', '.join(f'coalesce({c}, 0) AS {c}' for c in SUMS)} FROM td LEFT JOIN ag USING (target)"""

REPOS = """
r AS (SELECT c_custkey AS ord, 'svc-' || (c_custkey % 97) || CASE WHEN c_custkey % 31 = 0 THEN '..x' ELSE '' END AS name, c_custkey AS k FROM customer),
r1 AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Acme/' ELSE 'acme/' END || name || (k % 5) AS full_name FROM r),
r2 AS (SELECT *, row_number() OVER (PARTITION BY lower(full_name) ORDER BY ord) AS rn FROM r1),
r3 AS (SELECT full_name, ord, CASE WHEN rn > 1 THEN 'duplicate API entry' WHEN k % 11 = 0 THEN 'repository is disabled' WHEN k % 13 = 0 THEN 'repository is empty' WHEN k % 7 = 0 THEN 'archived repositories were excluded' WHEN k % 9 = 0 THEN 'forks were excluded'
  WHEN NOT regexp_matches(name, '^svc-[1-8][^/]*$') AND NOT regexp_matches(full_name, '^svc-[1-8][^/]*$') THEN 'repository did not match --repo-include' WHEN regexp_matches(full_name, '^[^/]*/svc-4[^/][^/]*$') THEN 'repository matched --repo-exclude'
  WHEN contains(name, '..') THEN 'repository name is not a safe fleet target name' WHEN k % 17 = 0 THEN 'repository lacks clone URL' ELSE '' END AS reason FROM r2),
r4 AS (SELECT *, CASE WHEN reason = '' THEN 'selected' WHEN reason LIKE 'repository %match%' THEN 'filtered' ELSE 'skipped' END AS status FROM r3),
r5 AS (SELECT full_name, ord, CASE WHEN status = 'selected' AND n > 60 THEN 'capped' ELSE status END AS status, CASE WHEN status = 'selected' AND n > 60 THEN 'selected repository cap 60 reached' ELSE reason END AS reason
  FROM (SELECT *, count(*) FILTER (status = 'selected') OVER (ORDER BY ord) AS n FROM r4))"""

VIOLATED = f"""
v AS (
  SELECT route_id, route, 'no-public-writes' AS policy FROM cls WHERE method IN ('POST', 'PUT', 'DELETE') AND status = 'public' AND NOT regexp_matches(path, '^/api/v1/r1[^/]*$')
  UNION ALL
  SELECT c.route_id, route, 'logged-first' FROM cls c WHERE (regexp_matches(path, '^/api/[^/]+/r[^/]$') OR path LIKE '/api/%/r19')
    AND EXISTS (SELECT 1 FROM mw WHERE mw.route_id = c.route_id AND starts_with(symbol, 'acme/auth.'))
    AND NOT EXISTS (SELECT 1 FROM mw WHERE mw.route_id = c.route_id AND symbol = '{USER}')
  UNION ALL
  SELECT c.route_id, route, 'admin-or-public' FROM cls c WHERE status IN ('proven', 'public')
    AND NOT ((tags LIKE '%admin%' OR status <> 'proven') AND NOT EXISTS (SELECT 1 FROM mw WHERE mw.route_id = c.route_id AND symbol = '{LEGACY}'))
)"""


def oracle_sql() -> dict[str, str]:
    count = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("proven", "public", "unknown"))
    out = {
        "classify": now("SELECT route_id, target, method, path AS \"normalizedPath\", status AS \"authStatus\", basis AS \"classificationBasis\", assurance, coalesce(gshape, CASE WHEN basis LIKE 'unconf%' THEN 'confirmed-shape' END) AS \"enforcementAnalysis\", coalesce(guard, CASE WHEN basis LIKE 'unconf%' THEN '" + CHECK + "' END) AS \"matchedEvidence\", CASE WHEN status = 'unknown' THEN 'medium' ELSE 'high' END AS confidence, accepted, tags FROM cls"),
        "route_findings": now(f'SELECT route_id, rule AS "ruleId", severity, {FP} AS fingerprint, route FROM fnd'),
        "stale_config": now("SELECT symbol, 'stale-auth-config' AS \"ruleId\", 'medium' AS severity, sha256('stale-auth-config|' || symbol) AS fingerprint FROM cfg WHERE symbol NOT IN (SELECT symbol FROM mw WHERE symbol IS NOT NULL)"),
        "stale_baseline": now("SELECT entry, 'stale-baseline' AS \"ruleId\", 'low' AS severity, sha256('stale-baseline|' || entry) AS fingerprint, CASE WHEN status IS NULL THEN 'missing' ELSE 'not public' END AS reason FROM (SELECT unnest(['GET /api/v1/r9', 'POST /api/v1/r5', 'GET /nope']) AS entry) x LEFT JOIN (SELECT route, arg_max(status, route_id) AS status FROM cls GROUP BY 1) y ON route = entry WHERE status IS NULL OR status <> 'public'"),
        "verb_gaps": now(", g AS (SELECT path, method, status, count(*) AS n FROM cls WHERE NOT accepted GROUP BY 1, 2, 3) SELECT path AS \"normalizedPath\", 'per-verb-gap' AS \"ruleId\", 'high' AS severity, sha256('per-verb-gap|' || path) AS fingerprint, string_agg(method || '=' || status, ', ' ORDER BY method, status) AS methods, CAST(sum(n) AS BIGINT) AS n_routes FROM g GROUP BY path HAVING count(DISTINCT status) >= 2"),
        "policy_evaluate": now(f", {VIOLATED} SELECT route_id, policy AS \"policyId\", route, sha256('policy-violation|' || policy || '|' || route) AS fingerprint FROM v"),
        "report_summary": now(f"SELECT target, count(*) AS routes, {count}, count(*) FILTER (accepted) AS accepted_public, count(*) FILTER (basis = 'configured-guard-attested') AS attested_unresolved FROM cls GROUP BY 1"),
        "finding_severities": now("SELECT target, severity, count(*) AS n FROM fnd GROUP BY 1, 2"),
        "gate": both(f""", {VIOLATED}, b AS ({top('1')}), a AS ({top('')}), j AS (SELECT a.route AS ra, b.route AS rb, a.risk > b.risk AS worse FROM a FULL OUTER JOIN b USING (route))
          SELECT 'public' AS gate, (SELECT count(*) FROM cls WHERE status = 'public') > 0 AS matched UNION ALL SELECT 'unknown', EXISTS (SELECT 1 FROM cls WHERE status = 'unknown') UNION ALL SELECT 'attested-unresolved', EXISTS (SELECT 1 FROM cls WHERE basis = 'configured-guard-attested')
          UNION ALL SELECT 'incomplete', false UNION ALL SELECT 'new', EXISTS (SELECT 1 FROM j WHERE rb IS NULL) OR EXISTS (SELECT rule, route FROM fnd EXCEPT SELECT rule, route FROM fnd1) UNION ALL SELECT 'regression', EXISTS (SELECT 1 FROM j WHERE worse) UNION ALL SELECT 'policy', EXISTS (SELECT 1 FROM v) UNION ALL SELECT 'policy:logged-first', EXISTS (SELECT 1 FROM v WHERE policy = 'logged-first') UNION ALL SELECT 'policy:none', false"""),
        "report_diff": both(DIFF),
        "finding_diff": both(f", a AS (SELECT DISTINCT {FP} AS fingerprint FROM fnd), b AS (SELECT DISTINCT {FP} AS fingerprint FROM fnd1) SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'new' ELSE 'resolved' END AS change FROM a FULL OUTER JOIN b ON a.fingerprint = b.fingerprint WHERE a.fingerprint IS NULL OR b.fingerprint IS NULL"),
        "suggest_auth": now(f", {suggestions('target')} SELECT target, id, symbol, route_count, total_routes, applies_to_all, name_hint, known_non_auth, shape, array_to_string(samples, ',') AS samples, fingerprint, rank FROM c2"),
        "bundle_fingerprint": now(f", {suggestions('target')} SELECT target, sha256(string_agg(symbol || ':' || fingerprint, chr(0) ORDER BY symbol || ':' || fingerprint)) AS bundle_fingerprint, any_value(opaque) AS opaque FROM c2 JOIN (SELECT target, count(*) FILTER (symbol IS NULL) AS opaque FROM e JOIN mw USING (route_id) GROUP BY 1) o USING (target) GROUP BY target"),
        "import_review": now(f", {suggestions('')} SELECT symbol, 'analyze' AS assurance FROM c2 WHERE name_hint AND shape = 'confirmed-shape'"),
        "fleet_candidates": now(f", {suggestions('target')}, l AS (SELECT DISTINCT symbol, target || ': ' || unnest(samples) AS s FROM c2), f AS (SELECT symbol, CAST(sum(route_count) AS BIGINT) AS route_count, count(DISTINCT target) AS repo_count, bool_or(name_hint) AS name_hint, bool_or(known_non_auth) AS known_non_auth, CASE WHEN bool_or(shape = 'confirmed-shape') THEN 'confirmed-shape' WHEN bool_or(shape = 'contradicted') THEN 'contradicted' END AS shape, array_to_string(list_slice(list_sort(list(DISTINCT target)), 1, 20), ',') AS repos, (SELECT array_to_string(list_slice(list(s ORDER BY s), 1, 5), ',') FROM l WHERE l.symbol = c2.symbol) AS samples FROM c2 GROUP BY symbol) SELECT *, row_number() OVER (ORDER BY CASE shape WHEN 'confirmed-shape' THEN 0 WHEN 'contradicted' THEN 1 ELSE 2 END, name_hint DESC, known_non_auth, repo_count DESC, route_count DESC, symbol) AS rank FROM f"),
        "spec_reconcile": now(f", {SPECS} SELECT * FROM rec"),
        "spec_coverage": now(f", {SPECS} SELECT count(*) FILTER (covered) AS numerator, count(*) FILTER (in_code) AS denominator, count(*) FILTER (in_code AND NOT covered) AS code_only, count(*) FILTER (NOT in_code) AS docs_only, count(*) FILTER (ambiguous) AS ambiguous, CASE WHEN count(*) FILTER (in_code) = 0 OR bool_or(unsure) THEN 'unknown' ELSE 'complete' END AS status FROM rec"),
        "fleet_rollup": now(f", {modules(0)} {rolled('m0')}"),
        "fleet_totals": now(f", {modules(0)}, t AS ({rolled('m0')}) SELECT count(*) AS targets, CAST(sum(routes) AS BIGINT) AS routes, CAST(sum(proven) AS BIGINT) AS proven, CAST(sum(public) AS BIGINT) AS public, CAST(sum(unknown) AS BIGINT) AS unknown, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'inconclusive') AS inconclusive, count(*) FILTER (status = 'not-go-module') AS not_go_module, bool_and(complete AND status NOT IN ('failed', 'inconclusive')) AS complete FROM t"),
        "fleet_delta": both(FLEET_DELTA),
        "org_dispositions": f"WITH {REPOS} SELECT * FROM r5",
        "disposition_tally": f"WITH {REPOS} SELECT status, reason, count(*) AS n FROM r5 GROUP BY 1, 2",
        "openapi_operations": now(r""", o AS (SELECT *, regexp_replace(path, '/r(\d)$', '/{r}/\1') AS p, EXISTS (SELECT 1) AS one, (SELECT list(coalesce(symbol, '') ORDER BY pos) FROM mw WHERE mw.route_id = cls.route_id) AS chain FROM cls),
          g AS (SELECT target, p AS path, method, min(route_id) AS first_id, count(*) AS registrations, count(DISTINCT array_to_string(chain, '|') || '#' || (k % 10)) AS kinds, arg_min(status, route_id) AS st, arg_min(guard, route_id) AS gd FROM o GROUP BY 1, 2, 3),
          b AS (SELECT *, lower(method) || 'ApiV1' || CASE WHEN p LIKE '%{r}%' THEN 'ByR' || regexp_extract(p, '\d$') ELSE 'R' || regexp_extract(p, '\d+$') END AS base FROM o),
          u AS (SELECT route_id, base, row_number() OVER (PARTITION BY target, base ORDER BY route_id) AS nth FROM b), h AS (SELECT g.*, base, nth FROM g JOIN u ON route_id = first_id)
          SELECT target, path, method, first_id, registrations, CASE WHEN registrations = 1 THEN NULL WHEN kinds = 1 THEN 'info' ELSE 'warning' END AS diagnostic, 'api' AS tag, CASE WHEN path LIKE '%{r}%' THEN 'r' ELSE '' END AS parameters, false AS catch_all,
            CASE WHEN st = 'public' THEN 'none' WHEN st = 'proven' AND gd = 'acme/auth.RequireUser' THEN 'bearer' ELSE 'unrefined' END AS security, base || CASE WHEN nth = 1 THEN '' ELSE '-' || nth END AS operation_id FROM h"""),
        "route_paths": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages), q AS (SELECT *, regexp_replace(path, '/+', '/', 'g') AS n, regexp_replace(path, '^/+|/+$', '', 'g') AS t FROM p)
          SELECT page_id, CASE WHEN n = '' THEN '/' WHEN n LIKE '/%' THEN n ELSE '/' || n END AS normalized, regexp_matches(t, '(^|/)[^/]*1[^/]*$') AS has_one, regexp_matches(t, '^[^/]*/[^/]*$') AS two_deep, coalesce(list_filter(string_split(path, '/'), lambda x: x <> '' AND x NOT LIKE '{%')[1], 'default') AS tag FROM q""",
        "symbol_functions": now(f"SELECT route_id, pos AS at, regexp_replace(symbol, '\\.[^.]*$', '') AS package, {HINT} AS hint, 'mw-' || substr(sha256(symbol), 1, 12) AS id FROM mw"),
        "method_expansion": now("""SELECT route_id, unnest(CASE route_id % 5 WHEN 1 THEN ['GET','POST','PUT','PATCH','HEAD','OPTIONS','DELETE','CONNECT','TRACE'] WHEN 2 THEN [method, 'OPTIONS'] WHEN 0 THEN [method] ELSE ['GET', 'HEAD'] END) AS method, path || CASE WHEN route_id % 5 = 3 THEN '/*filepath' ELSE '' END AS "normalizedPath" FROM e"""),
        "chain_events": """WITH k AS (SELECT user_id, event_id, CASE WHEN event_id % 10 = 0 THEN 'use' WHEN event_id % 97 = 0 THEN 'fallback' ELSE 'route' END AS kind, 'acme/mw.M' || (event_id % 7) AS symbol FROM events)
          SELECT event_id AS ord, coalesce(array_to_string(CASE WHEN kind = 'fallback' THEN list(symbol ORDER BY event_id) FILTER (kind = 'use') OVER (PARTITION BY user_id) ELSE list(symbol ORDER BY event_id) FILTER (kind = 'use') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, ','), '') AS chain FROM k QUALIFY kind <> 'use'""",
        "report_order": now("SELECT target, row_number() OVER (PARTITION BY target ORDER BY method, path, route_id) - 1 AS at, route_id FROM e"),
        "sarif_results": now(f"SELECT {FP} AS fingerprint, CASE severity WHEN 'high' THEN 1 ELSE 2 END AS severity_rank, CASE severity WHEN 'high' THEN 'error' ELSE 'warning' END AS level, rule FROM fnd"),
        "markdown_lines": now("SELECT route_id, '| ' || method || ' | `' || path || '` | [' || status || coalesce('/' || coalesce(gshape, CASE WHEN basis LIKE 'unconf%' THEN 'confirmed-shape' END), '') || CASE WHEN accepted THEN ', accepted' ELSE '' END || '] | ' || (SELECT string_agg(coalesce(symbol, 'func literal'), ' → ' ORDER BY pos) FROM mw WHERE mw.route_id = cls.route_id) || ' | acme/api.Handler' || (k % 10) || ' | router.go:' || route_id || ' |' AS line FROM cls"),
    }
    return out
