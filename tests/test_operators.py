"""Rules of the operators on small evidence, with the cases that the adapter's facts don't reach."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from routeloom.functions import globs, paths, symbols
from routeloom.operators import candidates, classify, compare, discovery, fleet, openapi, policy, specs, summary
from routeloom.operators.config import Config, Exemption, Guard, Policy, Requirement, Selector, decode
from routeloom.plans import commands
from routeloom.schema import AUTH, ROUTE
from routeloom.sinks import render
from routeloom.sources import annotations, readers
from routeloom.streaming import incremental


def mw(symbol, at=0, kind="function", status="resolved", wrapped=()):
    return (symbol or "func literal", symbol, kind, None, "group", at, status, list(wrapped), None)


def route(ord_, method, path, chain, handler="acme/api.H"):
    return (ord_, method, path, path, "http", "direct", chain, mw(handler), None, "high")


def frame(spark, rows):
    return spark.createDataFrame(rows, ROUTE)


SHAPES = {"a.Yes": "confirmed-shape", "a.No": "contradicted", "a.Loose": "confirmed-shape"}
CONFIG = Config({"a.Yes": Guard(tags=("t",)), "a.No": Guard(), "a.Word": Guard("attested"), "a.Maybe": Guard()}, ("a.Wrap",), ("GET /open", "GET /gone"))


def statuses(spark, rows):
    out = classify.classify(frame(spark, rows), CONFIG, SHAPES)
    return {r["ord"]: (r["auth"]["authStatus"], r["auth"]["classificationBasis"], [f["ruleId"] for f in r["route_findings"]]) for r in out.collect()}


def test_classification(spark):
    got = statuses(
        spark,
        [
            route(0, "GET", "/a", [mw("a.Yes")]),
            route(1, "GET", "/b", [mw("a.No"), mw("a.Word", 1)]),
            route(2, "GET", "/c", [mw("a.No"), mw("a.Maybe", 1)]),
            route(3, "GET", "/d", [mw("a.Maybe")]),
            route(4, "GET", "/e", [mw(None, kind="anonymous"), mw("a.Loose", 1)]),
            route(5, "GET", "/f", [mw("a.Loose")]),
            route(6, "GET", "/open", []),
            route(7, "GET", "/g", [mw("a.Wrap", wrapped=["x.Y", "a.Yes", "a.No"])]),
            route(8, "GET", "/h", [mw("b.Wrap", wrapped=["a.Yes"])]),
            route(9, "GET", "/i", [], "a.Yes"),
            route(10, "GET", "/j", [mw("a.No"), mw("a.No", 1), mw("a.Yes", 2)]),
        ],
    )
    assert got[0] == ("proven", "configured-guard-confirmed", [])
    assert got[1] == ("proven", "configured-guard-attested", ["matched-but-unenforced"])
    assert got[2] == ("unknown", "configured-guard-contradicted", ["matched-but-unenforced"])
    assert got[3] == ("unknown", "configured-guard-unconfirmed", [])
    assert got[4] == ("unknown", "opaque-middleware-present", ["opaque-middleware"])
    assert got[5] == ("unknown", "unconfigured-guard-confirmed-shape", ["unconfigured-guard"])
    assert got[6] == ("public", "no-configured-guard-matched", [])
    assert got[7][0] == "proven"
    assert got[8][0] == got[9][0] == "public"
    assert got[10] == ("proven", "configured-guard-confirmed", ["matched-but-unenforced"] * 2)


def test_shapes_by_join(spark):
    rows = frame(spark, [route(0, "GET", "/a", [mw("a.Yes"), mw("x.Y", 1)]), route(1, "GET", "/b", [])])
    shapes = spark.createDataFrame([("a.Yes", "confirmed-shape")], "symbol string, shape string")
    got = {r["ord"]: [m["shape"] for m in r["middleware"]] for r in classify.shaped_by(rows, shapes).collect()}
    assert got == {0: ["confirmed-shape", None], 1: []}


def test_stale(spark):
    rows = classify.classify(frame(spark, [route(0, "GET", "/open", []), route(1, "GET", "/open", [mw("a.Yes")]), route(2, "GET", "/x", [mw("a.Wrap", wrapped=["a.Word"])])]), CONFIG, SHAPES)
    assert {r["symbol"] for r in classify.stale_guards(rows, CONFIG).collect()} == {"a.No", "a.Word", "a.Maybe"}
    assert classify.stale_guards(rows, CONFIG, syntax_only=True).count() == 0
    assert {(r["entry"], r["reason"]) for r in classify.stale_baseline(rows, CONFIG).collect()} == {("GET /open", "not public"), ("GET /gone", "missing")}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [
        ("/api/*", "/api/x", True), ("/api/*", "/api/x/y", False), ("/api/**", "/api", True), ("/api/**", "/api/x/y", True), ("**/admin", "/admin", True), ("**/admin", "/a/b/admin", True),
        ("**/admin", "/a/b/admins", False), ("/a/**/z", "/a/z", True), ("/a/**/z", "/a/b/c/z", True), ("/a/**/z", "/a/b/c", False), ("/r?", "/r1", True), ("/r?", "/r12", False),
        ("/r[0-3]", "/r2", True), ("/r[^0-3]", "/r2", False), ("/r[", "/r[", False), ("api/x/", "/api/x", True), ("**", "/", True), ("/v*/x", "/v1/x", True),
        ("/admin/**", "/admin/users/123", True), ("/admin/**", "/other", False), ("/health", "/healthz", False), ("/*/users", "/admin/sub/users", False), ("**/*.go", "internal/analyzer/loader.go", True),
        ("**/*.go", "main.go", True), ("**/*.go", "a/b.txt", False), ("**/generated/**", "internal/api/generated/routes.go", True), ("**/generated/**", "internal/api/routes.go", False),
    ],
)
def test_globs(spark, pattern, path, want):
    assert one(spark, globs.glob_match(F.lit(path), pattern)) is want


def test_paths_and_symbols(spark):
    for base, rel, want in [("/a", "/b", "/a/b"), ("/a", "b/", "/a/b/"), ("/a/", "", "/a/"), ("/a/b", "../c", "/a/c"), ("/", "/", "/"), ("/a", "./x//y", "/a/x/y")]:
        assert one(spark, paths.join_paths(F.lit(base), F.lit(rel))) == want
    for path, want in [("", "/"), ("//a//b/", "/a/b/"), ("a/:id", "/a/:id"), ("/", "/"), ("//", "/")]:
        assert one(spark, paths.normalize_path(F.lit(path))) == want
    assert one(spark, paths.template_path(F.lit("/a/:id/*rest"))) == "/a/{id}/{rest}"
    assert one(spark, paths.path_parameters(F.lit("/a/{id}/{rest}"))) == ["id", "rest"]
    assert one(spark, paths.pascal_case(F.lit("/api/v1/user-list"))) == "ApiV1UserList"
    for s, want in [("acme/x.(*T).M", "acme/x"), ("acme/x.F", "acme/x"), ("main", "main"), ("github.com/a/b.F", "github.com/a/b")]:
        assert one(spark, symbols.package_of(F.lit(s))) == want
    for day, now, want in [("2024-01-31", "2024-01-31 23:59:59", True), ("2024-01-31", "2024-02-01 00:00:00", False), ("soon", "2024-01-01", False)]:
        assert one(spark, symbols.exception_active(F.lit(day), now)) is want
    assert one(spark, symbols.name_hint(F.lit("acme/auth/x.Log"))) is False
    assert one(spark, symbols.name_hint(F.lit("acme/x.RequireUser"))) is True
    assert one(spark, symbols.metric_text(F.lit(1), F.lit(3), F.lit("partial"))) == "33.3% (1/3) · partial"
    assert one(spark, symbols.metric_text(F.lit(0), F.lit(0), F.lit(""))) == "N/A"
    assert one(spark, paths.operation_base(F.lit("GET"), F.lit("/users/{id}"))) == "getUsersById" and one(spark, paths.operation_base(F.lit("GET"), F.lit("/"))) == "getRoot"
    assert one(spark, symbols.repo_url(F.lit("github.com/a/b/c"))) == "https://github.com/a/b" and one(spark, symbols.repo_name(F.lit("github.com/a/b"))) == "b"
    assert one(spark, symbols.servers(F.lit("h"), F.lit("/v1"), F.array(F.lit("http"), F.lit("https")))) == ["http://h/v1", "https://h/v1"]


def test_policy(spark):
    rows = classify.classify(frame(spark, [route(0, "GET", "/a", [mw("x.L"), mw("a.Yes", 1)]), route(1, "GET", "/b", [mw("a.Yes"), mw("x.L", 1)]), route(2, "POST", "/c", []), route(3, "GET", "/d", [mw("x.L"), mw("a.Yes", 1), mw("x.L", 2)])]), CONFIG, SHAPES)

    def violated(p, now="2024-01-01"):
        return sorted(r["ord"] for r in policy.evaluate(rows, Config(policies=(p,)), now).collect())

    assert violated(Policy("o", require=Requirement(middlewareOrder=("x.L", "a.Yes")))) == [1, 2, 3]
    assert violated(Policy("s", Selector(method=("post",)), Requirement(status=("proven",)))) == [2]
    assert violated(Policy("n", require=Requirement(not_=Requirement(anyTag=("t",))))) == [0, 1, 3]
    assert violated(Policy("e", require=Requirement(status=("proven",)), exceptions=(Exemption("r", "2024-01-01", Selector(path=("/c",))),))) == []
    assert violated(Policy("e", require=Requirement(status=("proven",)), exceptions=(Exemption("r", "2023-12-31", Selector(path=("/c",))),))) == [2]
    assert violated(Policy("p", Selector(package=("acme/ap",)), Requirement(any=(Requirement(status=("public",)), Requirement(allTags=("t", "u")))))) == [0, 1, 3]


def test_config():
    with pytest.raises(ValueError, match="unknown fields"):
        decode('{"version": 1, "nope": 1}')
    with pytest.raises(ValueError, match="twice"):
        decode('{"version": 1, "version": 2}')
    with pytest.raises(ValueError, match="assurance.*not METHOD"):
        decode('{"authMiddleware": {"a": {"assurance": "x"}}, "acceptedPublic": ["/x"]}')
    got = decode('{"policies": [{"id": "p", "match": {"path": ["/**"]}, "require": {"any": [{"status": ["proven"]}, {"not": {"anyTag": ["t"]}}]}}]}')
    assert got.policies[0].require.any[1].not_.anyTag == ("t",)


def test_compare(spark):
    b = classify.classify(frame(spark, [route(0, "GET", "/a", [mw("a.Yes")]), route(1, "GET", "/a", []), route(2, "GET", "/b", [mw("a.Yes")]), route(3, "GET", "/z", [])]), CONFIG, SHAPES)
    a = classify.classify(frame(spark, [route(0, "GET", "/a", [mw("a.Yes")]), route(1, "GET", "/b", [mw("a.Loose")]), route(2, "GET", "/n", [])]), CONFIG, SHAPES)
    got = {r["route"]: (r["change"], r["from"], r["to"], r["explanation"]) for r in compare.compare_routes(b, a).collect()}
    assert got["GET /a"][:3] == ("improvement", "public", "proven")
    assert got["GET /b"][:3] == ("regression", "proven", "unknown") and got["GET /b"][3].startswith("Recognized auth tag(s) removed: t")
    assert got["GET /z"][0] == "removed" and got["GET /n"][0] == "added"
    env = "schemaVersion string, command string, analysisProfile string, buildContext struct<goos string, goarch string, moduleMode string, workspaceMode string, tags array<string>>"
    x = spark.createDataFrame([("1.0", "audit", "typed", ("linux", "amd64", "", "", ["a", "b"]))], env)
    y = spark.createDataFrame([("1.4", "audit", "typed", ("linux", "amd64", "", "", ["b", "a"]))], env)
    assert compare.incompatibilities(x, x).count() == 0
    assert [r["reason"] for r in compare.incompatibilities(x, y).collect()] == ["build context"]


def test_candidates_rank_differently(spark):
    one_ = spark.createDataFrame([("r", "s.A", 2, "contradicted", False, False, ["x"]), ("r", "s.B", 1, "unresolved", False, False, ["x"])], "target string, symbol string, route_count long, shape string, name_hint boolean, known_non_auth boolean, samples array<string>")
    assert [(r["symbol"], r["shape"]) for r in candidates.fleet_candidates(one_).orderBy("rank").collect()] == [("s.A", "contradicted"), ("s.B", None)]
    shapes = spark.createDataFrame([("s.A", "contradicted")], "symbol string, shape string")
    rows = frame(spark, [route(0, "GET", "/a", [mw("s.A"), mw("s.B", 1)]), route(1, "GET", "/a", [mw("s.A"), mw("s.B", 1)])])
    got = candidates.suggest(rows, shapes).orderBy("rank").collect()
    assert [(r["symbol"], r["applies_to_all"]) for r in got] == [("s.B", False), ("s.A", False)]


def test_review(spark):
    c = spark.createDataFrame([("mw-1", "s.Auth", "f1", True, "confirmed-shape"), ("mw-2", "s.B", "f2", False, "confirmed-shape")], "id string, symbol string, fingerprint string, name_hint boolean, shape string")
    assert [r["symbol"] for r in candidates.import_review(c).collect()] == ["s.Auth"]
    kind = "id string, fingerprint string, is_auth_guard boolean, assurance string, rationale string"
    bad = spark.createDataFrame([("mw-1", "old", True, "analyze", "r"), ("mw-9", "x", True, "analyze", "r"), ("mw-2", "f2", True, "maybe", "r")], kind)
    assert {(r["id"], r["problem"]) for r in candidates.review(c, bad).collect()} == {("mw-1", "changed since the review"), ("mw-9", "unknown candidate"), ("mw-2", "unknown assurance")}
    good = spark.createDataFrame([("mw-1", "f1", True, "attested", "r"), ("mw-2", "f2", False, "", "r")], kind)
    assert [tuple(r)[:2] for r in candidates.import_review(c, good).collect()] == [("s.Auth", "attested")]
    assert candidates.review_summary(c, candidates.review(c, good)).first().asDict() == {"assessed": 2, "config_suggestions": 1, "total_candidates": 2}
    with pytest.raises(Exception, match="mw-"):
        candidates.import_review(c, bad).collect()


def test_discovery(spark):
    g = spark.createDataFrame([("r", None, "/api"), ("a", "r", "/v1/"), ("b", "a", "x"), ("l", "m", "q"), ("m", "l", "q")], "group_id string, parent_id string, prefix string")
    assert {r["group_id"]: r["path"] for r in discovery.group_paths(g).collect()} == {"r": "/api", "a": "/api/v1/", "b": "/api/v1/x"}
    m = spark.createDataFrame([("title", 0, "A"), ("title", 1, ""), ("title", 2, "B"), ("host", 0, "h")], "field string, ord int, value string")
    assert {(r["field"], r["value"], r["conflict"]) for r in discovery.merge_globals(m).collect()} == {("title", "B", True), ("host", "h", False)}
    x = spark.createDataFrame([("f",), ("g",)], "symbol string")
    assert [r["symbol"] for r in discovery.uncalled_registrars(x, spark.createDataFrame([("g",)], "callee string")).collect()] == ["f"]


def test_coverage_and_engines(spark):
    p = spark.createDataFrame([("r", 2, 0, 0), ("r", 3, 1, 0), ("s", 1, 0, 0)], "report string, files long, errors long, load_errors long")
    d = spark.createDataFrame([("s", "note")], "report string, code string")
    assert {r["report"]: r["complete"] for r in summary.coverage(p, d, "report").collect()} == {"r": False, "s": True}
    e = spark.createDataFrame([("e", "debug", ["10.0.0.0/8", "::/0"]), ("f", "release", None)], "engine string, mode string, trusted array<string>")
    assert {(r["engine"], r["ruleId"]) for r in summary.engine_findings(e).collect()} == {("e", "trust-all-proxies"), ("e", "debug-mode")}


def test_documents(spark):
    o = spark.createDataFrame([("d", 0, "getA", "getB"), ("d", 1, "getA", None), ("d", 2, "getB", None), ("d", 3, "x", "getB")], "doc string, ord int, base_id string, documented_id string")
    assert [r["operation_id"] for r in openapi.with_documented_ids(o, "doc").orderBy("ord").collect()] == ["getB", "getA-2", "getB-2", "getB3"]
    t = spark.createDataFrame([("a", "[]*pkg.User"), ("b", "map[string]int64")], "id string, type string")
    s = openapi.schema_json(t)
    assert json.loads(s.where("id = 'a'").first()["schema"]) == {"type": "array", "items": {"$ref": "#/components/schemas/User_" + hashlib.sha256(b"pkg.User").hexdigest()[:10]}}
    assert [r["ref"] for r in openapi.unknown_references(s).collect()] == ["User_" + hashlib.sha256(b"pkg.User").hexdigest()[:10]]
    c = spark.createDataFrame([("X", 0, "1"), ("X", 1, "2")], "id string, ord int, schema string")
    assert openapi.components(c).first().asDict() == {"id": "X", "schema": "1", "conflict": True}


def test_annotations(spark):
    text = '// List users\n// @Summary List\n// @Tags a, b\n// @Param id path int false "The id"\n// @Success 200,201 {object} pkg.User "ok"\n// @Router /users/{id} [GET]\n// @Param broken\n// @x-rate 5'
    got = annotations.annotations(spark.createDataFrame([("h", text), ("n", None)], "symbol string, comment string")).where("symbol = 'h'").first()
    assert got["summary"] == "List" and got["tags"] == ["a", "b"] and got["routers"] == ["get /users/{id}"]
    assert got["parameters"][0]["required"] is True and [r["status"] for r in got["responses"]] == ["200", "201"]
    assert len(got["issues"]) == 1 and json.loads(got["extensions"]) == {"x-rate": 5}


def test_specs(spark):
    routes = frame(spark, [route(0, "GET", "/u/:id", []), route(1, "GET", "/u/:id", []), route(2, "PUT", "/v", []), route(3, "GET", "/w", [])])
    ops = spark.createDataFrame([("a", "get", "/u/{id}"), ("u", "PUT", "/v"), ("u", "GET", "/x"), ("g", "GET", "/w")], "spec_id string, method string, path string")
    s = spark.createDataFrame([("a", "authored"), ("u", "unknown"), ("g", "generated")], "spec_id string, authorship string")
    got = specs.reconcile(routes, ops, s)
    assert {r["operation"]: (r["in_code"], r["covered"], r["unsure"]) for r in got.collect()} == {"GET /u/{id}": (True, True, False), "PUT /v": (True, False, True), "GET /x": (False, False, False), "GET /w": (True, False, False)}
    assert specs.documentation(got).first()["status"] == "unknown"


def test_fleet_reuse(spark):
    e = spark.createDataFrame([("a", "p", "f", "ok", True), ("b", "p", "f", "failed", True)], "target string, pushedAt string, fingerprint string, status string, complete boolean")
    c = spark.createDataFrame([("a", "p", "f"), ("b", "p", "f"), ("c", "p", "f")], "target string, pushedAt string, fingerprint string")
    assert [r["target"] for r in fleet.reusable(e, c).collect()] == ["a"]
    held, todo = incremental.resume(e, c, spark.createDataFrame([("a", 1), ("b", 2)], "target string, n int"))
    assert held.count() == 1 and {r["target"] for r in todo.collect()} == {"b", "c"}


def test_reports_round_trip(spark, tmp_path):
    rows = classify.classify(frame(spark, [route(1, "GET", "/b|x", [mw("a.Yes")]), route(0, "GET", "/a", [])]), CONFIG, SHAPES)
    text = commands.render(rows, classify.findings_of(rows), CONFIG, "json")
    assert [r["normalizedPath"] for r in json.loads(text)["routes"]] == ["/a", "/b|x"] and "source" not in json.loads(text)["routes"][0]
    (tmp_path / "r.json").write_text(text)
    assert readers.routes_of(readers.reports(spark, str(tmp_path / "r.json"))).orderBy("ord").first()["auth"]["authStatus"] == "public"
    assert "/b\\|x" in commands.render(rows, None, CONFIG, "markdown")
    assert json.loads(commands.render(rows, classify.findings_of(rows), CONFIG, "sarif"))["runs"][0]["results"][0]["level"] == "warning"
    assert "/b|x" in json.loads(commands.render(rows, None, CONFIG, "openapi"))["paths"]
    assert "</script><script>" in commands.render(rows, None, CONFIG, "html") and "GET     /" in commands.render(rows, None, CONFIG, "pretty")
    with pytest.raises(ValueError, match="limit"):
        render.markdown(rows, "t", most=3)
    (tmp_path / "bad.json").write_text('{"schemaVersion": "1.0", "command": "audit", "routes": [{"method": "GET", "auth": {"authStatus": "maybe"}}]}')
    with pytest.raises(Exception, match="auth status"):
        readers.reports(spark, str(tmp_path / "bad.json")).collect()
    assert AUTH


def test_manifest_and_spec_documents(spark, tmp_path):
    assert len(readers.manifest('{"targets": [{"name": "a", "src": "x"}, {"name": "b", "git": {"url": "u"}}]}')) == 2
    for bad in ('{"targets": [{"name": "a", "src": "x", "git": {}}, {"name": "a", "src": "y"}]}', '{"targets": [{"name": "a", "name": "b"}]}', '{"targets": [{"name": "a"}]}'):
        with pytest.raises(ValueError):
            readers.manifest(bad)
    (tmp_path / "s.json").write_text('{"swagger": "2.0", "basePath": "/v1/", "paths": {"/u": {"get": {}, "x-y": 1}}}')
    (tmp_path / "n.json").write_text("{}")
    got = readers.spec_documents(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["dialect"] == "swagger-2" and got[0]["operations"][0]["path"] == "/u"


def test_specifications(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor/v.yaml").write_text("openapi: 3.0.0")
    (tmp_path / "a.yaml").write_text("openapi: 3.0.1\nx-acme-authorship: authored\npaths:\n  /a:\n    GET: {x: {$ref: 'b.YML#/x'}, y: {$ref: 'no.json'}, z: {$ref: 'https://h/x'}, w: {$ref: '../../o.json'}}\n")
    (tmp_path / "b.YML").write_text("swagger: 2.0\nx-generated: true\n")
    (tmp_path / "c.json").write_text('{"openapi": "3.1.0", "info": {"description": "Generated"}}')
    (tmp_path / "d.json").write_text('{"openapi": "3.1.0", ')
    (tmp_path / "e.yml").write_text("openapi: 4.0.0")
    (tmp_path / "f.yml").write_text("openapi: 3.0.0\nopenapi: 3.0.0")
    got = {r["spec_id"].rsplit("/", 1)[1]: r for r in readers.spec_documents(spark, str(tmp_path)).collect()}
    assert {k: (r["dialect"], r["authorship"]) for k, r in got.items()} == {"a.yaml": ("openapi-3", "authored"), "b.YML": ("swagger-2", "generated"), "c.json": ("openapi-3", "unknown"), **dict.fromkeys(("d.json", "e.yml", "f.yml"), (None, None))}
    assert [tuple(o) for o in got["a.yaml"]["operations"]] == [("GET", "/a")] and len(got["a.yaml"]["local_refs"]) == 4
    assert got["a.yaml"]["problem"] == "spec-ref-escape-rejected: ../../o.json; spec-remote-ref-rejected: https://h/x; spec-local-ref-unavailable: no.json"
    assert [got[k]["problem"].split(":")[0] for k in ("d.json", "e.yml", "f.yml")] == ["spec-parse-invalid", "spec-version-unsupported", "spec-parse-limit"]


def test_source_inventory(spark, tmp_path):
    for p in ("a/go.mod", "a/x.go", "a/vendor/v/y.go", "b/y.go", "b/notes.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    got = {r["repo"]: (r["modules"], r["files"]) for r in readers.source_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a": (1, 1), "b": (0, 1)}


def test_stream(spark, tmp_path):
    frame(spark, [route(0, "GET", "/a", [mw("a.Yes")])]).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ROUTE).parquet(str(tmp_path / "in"))
    incremental.classify_stream(rows, CONFIG, SHAPES, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["auth"]["authStatus"] == "proven"


def test_overview_and_review_queue(spark):
    t = spark.createDataFrame([("a", "ok", True, False, 0), ("b", "failed", True, False, 0), ("c", "ok", False, False, 0), ("d", "ok", True, True, 0), ("e", "ok", True, False, 0)], "target string, status string, complete boolean, reviewed boolean, enrichment_issues long")
    c = spark.createDataFrame([("a", "s.Auth", True, False), ("a", "s.Log", False, False), ("d", "s.Auth", True, False)], "target string, symbol string, name_hint boolean, known_non_auth boolean")
    got = {r["target"]: (r["state"], r["symbols"]) for r in fleet.review_queue(t, c).collect()}
    assert got == {"a": ("candidates-to-review", ["s.Auth"]), "b": ("scan-failed", []), "c": ("scan-incomplete", []), "d": ("reviewed-config-applied", []), "e": ("no-candidates", [])}
    k = spark.createDataFrame([("a", "complete", ["openapi3"], 1, 3), ("a", "complete", ["swagger2"], 1, 1), ("b", "complete", [], 0, 0), ("c", None, None, None, None)], "target string, status string, dialects array<string>, numerator long, denominator long")
    assert {r["target"]: (r["docs"], r["observed_percent"]) for r in fleet.overview(t, k).collect()} == {"a": ("both", 50.0), "b": ("none", None), "c": ("unavailable", None), "d": ("unavailable", None), "e": ("unavailable", None)}


def test_yaml_configuration():
    text = """
version: "1"
authMiddleware:
  a.Yes: {assurance: attested, tags: [t]}
acceptedPublic: [GET /open]
policies:
  - id: p
    match: {method: [GET]}
    exceptions: [{reason: r, expires: 2024-12-31}]
"""
    config = decode(text)
    assert config == decode(json.dumps({"version": "1", "authMiddleware": {"a.Yes": {"assurance": "attested", "tags": ["t"]}}, "acceptedPublic": ["GET /open"], "policies": [{"id": "p", "match": {"method": ["GET"]}, "exceptions": [{"reason": "r", "expires": "2024-12-31"}]}]}))
    for bad in ("authMiddleware: !x {}", "a: &b {}\nauthWrappers: *b", "acceptedPublic: []\nacceptedPublic: []", "nope: 1", "- a", "{a: 1", "acceptedPublic: []\n---\nacceptedPublic: []"):
        with pytest.raises(ValueError):
            decode(bad)


def test_audit_as_a_whole(spark):
    rows = frame(spark, [route(0, "GET", "/a", [mw("a.Yes")]), route(1, "POST", "/b", [])])
    earlier = classify.classify(frame(spark, [route(0, "GET", "/a", [mw("a.Yes")]), route(1, "POST", "/b", [mw("a.Yes")])]), CONFIG, SHAPES)
    head = lambda profile: spark.createDataFrame([("1.0", "audit", profile, None)], "schemaVersion string, command string, analysisProfile string, buildContext string")
    more = dict(
        engines=spark.createDataFrame([("e", "debug", ["0.0.0.0/0"])], "engine string, mode string, trusted array<string>"),
        packages=spark.createDataFrame([(3, 0, 0), (2, 1, 0)], "files int, errors int, load_errors int"),
        fail_on=["public", "regression", "incomplete", "new", "policy:none"],
    )
    got = commands.audit(rows, CONFIG, "2024-06-01 00:00:00", SHAPES, earlier, envelopes=(head("typed"), head("typed")), **more)
    assert {r["gate"]: r["matched"] for r in got.gates.collect()} == {"public": True, "regression": True, "incomplete": True, "new": True, "policy:none": False}
    assert {r["ruleId"] for r in got.engine_findings.collect()} == {"trust-all-proxies", "debug-mode"}
    assert [(r["failed_files"], r["complete"]) for r in got.coverage.collect()] == [(2, False)]
    with pytest.raises(ValueError, match="analysis profile"):
        commands.audit(rows, CONFIG, "2024-06-01 00:00:00", SHAPES, earlier, envelopes=(head("typed"), head("syntax")))


def test_fleet_with_baseline(spark):
    fields = "target string, module_id string, kind string, status string, complete boolean, routes long, proven long, public long, unknown long"
    modules = spark.createDataFrame([("r", "root", "gin-application", "ok", True, 1, 0, 1, 0)], fields)
    of = lambda chain: classify.classify(frame(spark, [route(0, "GET", "/a", chain)]).selectExpr("'r' target", "'root' module_id", "*"), CONFIG, SHAPES)
    head = lambda s: spark.createDataFrame([("x", s)], "scope_fingerprint string, scan_fingerprint string")
    got = commands.fleet(modules, of([]), (modules, of([mw("a.Yes")])), (head("1"), head("1")))
    assert [(r["status"], r["regressions"], r["new_findings"]) for r in got.delta.collect()] == [("unchanged", 1, 1)]
    assert got.delta_summary.first()["complete"] is True and got.totals.first()["not_go_module"] == 0
    with pytest.raises(ValueError, match="scan fingerprint"):
        commands.fleet(modules, of([]), (modules, of([])), (head("1"), head("2")))


def test_report_is_read_back(spark, tmp_path):
    rows = classify.classify(frame(spark, [route(1, "POST", '/b|"x"', [mw(None)]), route(0, "GET", "/a", [mw("a.Yes")])]), CONFIG, SHAPES)
    (tmp_path / "r.json").write_text(commands.render(rows, classify.findings_of(rows), CONFIG, "json", "acme/m"))
    back = readers.reports(spark, f"file://{tmp_path}/r.json")
    got = [tuple(r) for r in readers.routes_of(back).orderBy("ord").select("method", "normalizedPath", "auth", "middleware", "source").collect()]
    assert got == [tuple(r) for r in rows.orderBy("ord").select("method", "normalizedPath", "auth", "middleware", "source").collect()]
    assert sorted(r["fingerprint"] for r in readers.findings_of(back).collect()) == sorted(r["fingerprint"] for r in classify.findings_of(rows).collect())
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["activeExceptions"] == [] and report["summary"]["findingsBySeverity"] == {"medium": 1} and report["target"]["module"] == "acme/m"
    assert "summary" not in json.loads(render.one(render.reports_json(rows, None, F.struct(F.lit("m").alias("module")), command="inventory"), "report"))


def test_openapi_document(spark):
    ops = spark.createDataFrame([("/u/{id}", "GET", "getUById", "u", ["id"], "bearer", 1)], "path string, method string, operation_id string, tag string, parameters array<string>, security string, registrations long")
    params = spark.createDataFrame([("/u/{id}", "GET", k, n, p, k == 1, f"d{k}", '{"type":"integer"}') for k, (n, p) in enumerate([("q", "query"), ("id", "path"), ("q", "query"), ("f", "formData")])], "path string, method string, ord long, name string, in string, required boolean, description string, schema string")
    answers = spark.createDataFrame([("/u/{id}", "GET", 0, "200", "", '{"$ref":"#/components/schemas/U"}')], "path string, method string, ord long, status string, description string, schema string")
    schemas = spark.createDataFrame([("U", '{"type":"object"}')], "id string, schema string")
    doc = json.loads(render.openapi(openapi.described(ops, params, answers), "", info=openapi.info("acme/users", {"version": "2", "license": {"name": "MIT"}}), servers=["/v1"], tags=[{"name": "u"}], schemes={"bearer": {"type": "http", "scheme": "bearer"}}, schemas=schemas))
    item = doc["paths"]["/u/{id}"]["get"]
    assert [(p["name"], p["in"], p["schema"]["type"], p.get("description")) for p in item["parameters"]] == [("id", "path", "integer", "d1"), ("q", "query", "integer", "d2")]
    assert item["responses"] == {"200": {"description": "Response", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/U"}}}}}
    assert item["requestBody"]["content"]["multipart/form-data"]["schema"]["properties"] == {"f": {"type": "integer"}}
    assert doc["info"] == {"title": "users API", "version": "2", "license": {"name": "MIT"}} and doc["servers"] == [{"url": "/v1"}] and set(doc["components"]) == {"securitySchemes", "schemas"}


def test_markdown_cells_stay_in_their_table(spark):
    rows = spark.createDataFrame([("a|b", 0), ("\\", 1), ("`x`<b>\r\ny\nz", 2), (None, 3)], "t string, i int")
    assert [r[0] for r in rows.orderBy("i").select(render.markdown_escape(F.col("t"))).collect()] == ["a\\|b", "\\\\", "'x'&lt;b&gt; y z", None]


def test_schemas_name_every_field():
    report = json.loads(commands.schema("report"))
    assert set(report["required"]) <= set(report["properties"]) and report["additionalProperties"] is False
    assert report["properties"]["routes"]["items"]["properties"]["auth"]["properties"]["authStatus"]["enum"] == ["proven", "public", "unknown"]
    assert json.loads(commands.schema("fleet"))["properties"]["targets"]["items"]["properties"]["status"]["enum"][0] == "ok"
    assert "policies" in json.loads(commands.schema("config"))["properties"]
