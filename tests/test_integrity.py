"""Saved fleets: each rule has a row that it refuses; files that changed concern their own target only; checks can't be pruned."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from routeloom.operators import candidates, discovery, fleet, integrity
from routeloom.sources import annotations, readers

GOOD = "0" * 64


def frames(spark, targets=(), modules=(), artifacts=()):
    return spark.createDataFrame(list(targets), integrity.TARGETS), spark.createDataFrame(list(modules), integrity.MODULES), spark.createDataFrame(list(artifacts), integrity.ARTIFACTS)


def target(name="a", status="ok", complete=True, ref="main", commit="a" * 40, fingerprint="f", inventory=True, category="non-gin"):
    return (name, status, complete, ref, commit, fingerprint, inventory, category)


def module(name="a", id_="root", kind="go-module", status="ok", complete=True, report=None, html=None):
    return (name, id_, kind, status, complete, report or f"targets/{name}/routes.json", html)


@pytest.mark.parametrize(
    ("problem", "rows"),
    [
        ("invalid target name", {"targets": [target("../a")]}), ("invalid target name", {"targets": [target(None)]}), ("duplicate target name", {"targets": [target(), target(ref="")]}), ("invalid status", {"targets": [target(status="done")]}), ("invalid status", {"targets": [target(status=None)]}),
        *[("invalid repository ref", {"targets": [target(ref=r)]}) for r in ("@", "-x", "x.", "x/", "a..b", "a@{1", "a//b", "a b", "a~b", "a^b", "a:b", "a?b", "a*b", "a[b", "a\\b", ".x", "a/.x", "x.lock", "x.lock/y", "/x", "a\nb")],
        *[("invalid scanned commit", {"targets": [target(commit=c)]}) for c in ("abc", "A" * 40, "g" * 40, "a" * 41)],
        *[("invalid module id", {"modules": [module(id_=i)]}) for i in ("module-1", "root2", None, "module-" + "g" * 16)], ("duplicate module id", {"modules": [module(), module()]}), ("invalid status", {"modules": [module(status="x")]}), ("invalid module kind", {"modules": [module(kind="library")]}),
        *[(p, {"artifacts": [("a", m, t, path, n, s)]}) for m in (None, "root") for p, t, path, n, s in (
            ("invalid tree", "raw", "x", 1, GOOD), ("invalid path", None, "", 1, GOOD), ("invalid path", None, None, 1, GOOD), ("invalid path", "", "/x", 1, GOOD), ("invalid path", "", "..", 1, GOOD), ("invalid path", "", "a/../..", 1, GOOD), ("invalid path", "", "../x", 1, GOOD), ("invalid path", "", ".", 1, GOOD),
            ("non-canonical path", "html", "a//b", 1, GOOD), ("non-canonical path", "html", "a\\b", 1, GOOD), ("non-canonical path", "html", "./a", 1, GOOD), ("non-canonical path", "", "a/", 1, GOOD), ("invalid integrity metadata", "", "x", -1, GOOD), ("invalid integrity metadata", "", "x", 1, "ab"), ("invalid integrity metadata", "", "x", None, GOOD), ("invalid SHA-256", "", "x", 1, "z" * 64),
        )],
    ],
)
def test_each_rule_refuses(spark, problem, rows):
    t, m, a = frames(spark, **rows)
    found = integrity.problems(t, m, a)
    assert [r["problem"] for r in found.collect()] == [problem]
    with pytest.raises(ValueError, match=problem):
        integrity.verified(t, found)


def test_what_is_in_form(spark):
    t, m, a = frames(spark, [target(), target("b", ref=None, commit=None), target("c", ref="rel/1.x", commit="b" * 64)], [module(), module("a", "module-0123456789abcdef"), module("b")], [("a", None, "", "targets/a/routes.json", 0, GOOD), ("a", "root", "html", "x", 1, "AB" * 32)])
    groups = spark.createDataFrame([(n, "non-gin") for n in "abc"], "name string, category string")
    assert integrity.problems(t, m, a, groups).count() == 0 and integrity.verified(t, integrity.problems(t, m, a, groups)).count() == 3
    for other in ([("a", "non-gin"), ("b", "non-gin")], [(n, "non-gin") for n in "abcc"], [("a", "failed"), ("b", "non-gin"), ("c", "non-gin")]):
        assert {r["problem"] for r in integrity.problems(t, m, a, spark.createDataFrame(other, "name string, category string")).collect()} == {"repository groups do not match targets"}
    assert integrity.problems(*frames(spark)).count() == 0


def held(spark, change=None, formats=("json", "md", "openapi"), html=True):
    """Reusable targets of a fleet of three (one module, two modules, no Go module) after `change` of its tables."""
    two = ["root", "module-0123456789abcdef"]
    base = lambda n, i, many: f"targets/{n}" + (f"/modules/{i}" if many else "")
    mods = [module("one", report="targets/one/routes.json", html="targets/one/api.html"), *(module("two", i, report=f"{base('two', i, True)}/routes.json", html=f"{base('two', i, True)}/api.html") for i in two)]
    each = [(n, i, tree, f"{base(n, i, n == 'two')}/{f}", 5, hashlib.sha256(f"{n}{i}{f}".encode()).hexdigest()) for n, i in [("one", "root"), *(("two", i) for i in two)] for tree, f in (("", "routes.json"), ("", "routes.md"), ("", "openapi.json"), ("html", "api.html"))]
    tables = {"targets": [target("one"), target("two"), target("none", "not-go-module"), target("bad", "failed"), target("late", fingerprint="old")], "modules": mods, "artifacts": each + [(n, None, *r) for n, _, *r in each], "files": [tuple(r[2:]) for r in each], "current": [(n, "f") for n in ("one", "two", "none", "bad", "late")]}
    tables = copy.deepcopy(tables)
    if change:
        change(tables)
    t, m, a = frames(spark, tables["targets"], tables["modules"], tables["artifacts"])
    f = spark.createDataFrame(tables["files"], "tree string, path string, bytes bigint, sha256 string")
    c = spark.createDataFrame(tables["current"], "target string, fingerprint string")
    return {r["target"] for r in integrity.reusable(t, m, a, f, c, formats=formats, html=html).collect()}


def replace(table, where, **new):
    def change(tables):
        names = {"targets": integrity.TARGETS, "modules": integrity.MODULES, "artifacts": integrity.ARTIFACTS, "files": "tree string, path string, bytes bigint, sha256 string"}[table]
        keys = [c.split()[0] for c in names.split(", ")]
        tables[table] = [tuple(new.get(k, v) for k, v in zip(keys, r, strict=True)) if where(dict(zip(keys, r, strict=True))) else r for r in tables[table]]

    return change


def without(table, where):
    def change(tables):
        tables[table] = [r for r in tables[table] if not where(r)]

    return change


def test_a_fleet_is_reused(spark):
    assert held(spark) == {"one", "two", "none"}


@pytest.mark.parametrize(
    ("lost", "change"),
    [
        ("two", replace("files", lambda r: r["path"].startswith("targets/two/modules/root/routes.md"), sha256=GOOD)), ("one", replace("files", lambda r: r["path"] == "targets/one/api.html", bytes=6)), ("one", without("files", lambda r: r[1] == "targets/one/openapi.json")),
        ("one", without("artifacts", lambda r: r[0] == "one" and r[1] == "root" and r[3].endswith("md"))), ("two", without("artifacts", lambda r: r[0] == "two" and r[1] is None and r[3].endswith("root/routes.md"))), ("one", lambda t: t["artifacts"].append(("one", None, "", "targets/one/more", 1, GOOD))), ("one", lambda t: t["artifacts"].append(("one", "root", "", "targets/one/more", 1, GOOD))),
        ("two", replace("modules", lambda r: r["module_id"] == "module-0123456789abcdef", complete=False)), ("one", replace("modules", lambda r: r["target"] == "one", status="failed")), ("one", replace("modules", lambda r: r["target"] == "one", report="routes.json")), ("one", replace("modules", lambda r: r["target"] == "one", api_html=None)), ("one", without("modules", lambda r: r[0] == "one")),
        ("none", replace("targets", lambda r: r["target"] == "none", inventory_complete=False)), ("none", lambda t: t["modules"].append(module("none"))), ("none", replace("targets", lambda r: r["target"] == "none", complete=False)), ("two", replace("targets", lambda r: r["target"] == "two", source_fingerprint="")), ("one", lambda t: t["current"].remove(("one", "f"))), ("two", lambda t: t["modules"].append(t["modules"][-1])),
    ],
)
def test_what_changed_concerns_its_target_only(spark, lost, change):
    assert held(spark, change) == {"one", "two", "none"} - {lost}


def test_formats_decide_what_is_expected(spark):
    assert held(spark, formats=("json", "md", "openapi", "sarif")) == {"none"} and held(spark, formats=("openapi", "md"), html=False) == {"none"}
    earlier = spark.createDataFrame([("a", "not-go-module", True, "p", "f", True), ("b", "not-go-module", True, "p", "f", False), ("c", "ok", True, "p", "f", None)], "target string, status string, complete boolean, pushedAt string, fingerprint string, inventory_complete boolean")
    assert {r["target"] for r in fleet.reusable(earlier, earlier.select("target", "pushedAt", "fingerprint")).collect()} == {"a", "c"}


def test_tree_hashes(spark):
    files = [("x", "b/a", "1"), ("x", "a", "2"), ("x", "b-a", "3"), ("y", "a", "2")]
    got = {r["root"]: (r["n_files"], r["content_hash"]) for r in integrity.tree_hashes(spark.createDataFrame(files, "root string, path string, sha256 string"), "root").collect()}
    assert got == {k: (n, hashlib.sha256(t.encode()).hexdigest()) for k, n, t in (("x", 3, "a\0" "2\nb-a\0" "3\nb/a\0" "1\n"), ("y", 1, "a\0" "2\n"))}


AGGREGATE = {"kind": "fleet", "schemaVersion": "1.0", "tool": "x", "toolVersion": "1", "scanFingerprint": "s", "targets": [{"name": "a", "status": "ok", "complete": True, "repository": {"ref": "main", "scannedCommit": "a" * 40}, "modules": [{"id": "root", "kind": "go-module", "status": "ok", "complete": True, "artifacts": [{"path": "targets/a/routes.json", "bytes": 1, "sha256": GOOD}]}]}, {"name": "b", "status": "failed", "complete": False}]}


def saved(tmp_path, document):
    (tmp_path / "fleet.json").write_text(document if isinstance(document, str) else json.dumps(document))
    return f"file://{tmp_path}/fleet.json"


def edited(path, value):
    out = copy.deepcopy(AGGREGATE)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


def test_aggregates(spark, tmp_path):
    assert sorted(r["name"] for r in readers.aggregates(spark, saved(tmp_path, AGGREGATE)).collect()) == ["a", "b"]
    plain = {k: v for k, v in AGGREGATE.items() if k in ("targets",)}
    assert readers.aggregates(spark, saved(tmp_path, plain), legacy=True).count() == 2


@pytest.mark.parametrize(
    ("problem", "document"),
    [
        ("envelope", edited(["schemaVersion"], "2.0")), ("envelope", edited(["kind"], "report")), ("envelope", edited(["toolVersion"], "")), ("unversioned", {"targets": []}), ("targets must be", {k: v for k, v in AGGREGATE.items() if k != "targets"}), ("named twice", edited(["targets", 1, "name"], "a")), ("target name", edited(["targets", 1, "name"], "../b")),
        ("invalid status", edited(["targets", 0, "status"], "x")), ("ref", edited(["targets", 0, "repository", "ref"], "a..b")), ("commit", edited(["targets", 0, "repository", "scannedCommit"], "abc")), ("module id", edited(["targets", 0, "modules", 0, "id"], "m")), ("module status", edited(["targets", 0, "modules", 0, "status"], "x")), ("module kind", edited(["targets", 0, "modules", 0, "kind"], "x")),
        ("invalid path", edited(["targets", 0, "modules", 0, "artifacts", 0, "path"], "/x")), ("integrity metadata", edited(["targets", 0, "artifacts"], [{"path": "x", "bytes": 1, "sha256": "a"}])), ("unknown field", edited(["targets", 0, "surprise"], 1)), ("key comes twice", '{"kind": "fleet", "kind": "fleet"}'), ("Extra data", json.dumps(AGGREGATE) + "{}"), ("duplicate module id", edited(["targets", 0, "modules"], AGGREGATE["targets"][0]["modules"] * 2)),
    ],
)
def test_aggregates_are_refused_whatever_is_read(spark, tmp_path, problem, document):
    rows = readers.aggregates(spark, saved(tmp_path, document))
    for use in (lambda: rows.count(), lambda: rows.select("status").collect()):
        with pytest.raises(Exception, match=problem):
            use()


@pytest.mark.parametrize("change", [{"schemaVersion": "9.0"}, {"schemaVersion": None}, {"command": "nonsense"}, {"routes": [{"method": "GET", "auth": {"authStatus": "bogus"}}]}])
def test_reports_are_refused_whatever_is_read(spark, tmp_path, change):
    good = {"schemaVersion": "1.2", "command": "audit", "routes": [{"method": "GET", "auth": {"authStatus": "proven"}}], "findings": [{"id": "x"}]}
    (tmp_path / "r.json").write_text(json.dumps(good))
    assert readers.routes_of(readers.reports(spark, f"file://{tmp_path}/r.json")).count() == 1
    (tmp_path / "q.json").write_text(json.dumps(good | change))
    rows = readers.reports(spark, f"file://{tmp_path}/q.json")
    for use in (rows.count, readers.routes_of(rows).count, readers.findings_of(rows).select("id").collect, rows.select("tool").collect):
        with pytest.raises(Exception, match="bad "):
            use()


def test_a_review_is_refused_as_a_whole(spark):
    c = spark.createDataFrame([("mw-1", "s.Auth", "f1", True, "confirmed-shape"), ("mw-2", "s.B", "f2", False, None), ("mw-3", None, "f3", False, None)], "id string, symbol string, fingerprint string, name_hint boolean, shape string")
    kind = "id string, fingerprint string, is_auth_guard boolean, assurance string, rationale string, tags array<string>, roles array<string>, openapi_scheme string, transparent_wrapper boolean"
    good = [("mw-1", "f1", True, "attested", "r", ["t"], ["admin"], "bearer", False), ("mw-2", "f2", True, "analyze", "r", None, None, None, True)]
    rows = candidates.import_review(c, spark.createDataFrame(good, kind))
    assert [tuple(r) for r in rows.orderBy("symbol").collect()] == [("s.Auth", "attested", ["t"], ["admin"], None, "bearer", False), ("s.B", "analyze", None, None, None, None, True)]
    assert candidates.configuration(rows) == {"authMiddleware": {"s.Auth": {"assurance": "attested", "tags": ["t"], "roles": ["admin"], "openapiScheme": "bearer"}, "s.B": {"assurance": "analyze"}}, "authWrappers": ["s.B"]}
    now = candidates.bundle(c).first()["bundle_fingerprint"]
    assert candidates.import_review(c, spark.createDataFrame(good, kind), now).count() == 2
    with pytest.raises(ValueError, match="another bundle"):
        candidates.import_review(c, spark.createDataFrame(good, kind), "old")
    for bad in ([("mw-9", "f", False, "", "r", *[None] * 4)], [good[0], good[0]], [("mw-1", "old", False, "", "r", *[None] * 4)], [("mw-1", "f1", False, "", " ", *[None] * 4)], [("mw-1", "f1", True, "trust", "r", *[None] * 4)]):
        with pytest.raises(ValueError, match="mw-"):
            candidates.import_review(c, spark.createDataFrame([good[1], *bad], kind))
    said = candidates.decided(c, spark.createDataFrame([("mw-1", "f1", False, "", "r", *[None] * 4), ("mw-3", "f3", True, "analyze", "r", *[None] * 4)], kind)).collect()
    assert {r["id"]: (r["eligible"], r["reason"]) for r in said} == {"mw-1": (False, candidates.OUTCOMES["no guard"]), "mw-3": (False, candidates.OUTCOMES["no symbol"])}


def test_relative_files_keep_rows_and_columns(spark):
    rows = spark.createDataFrame([("/src/app/x.go", "m", "v", "d", "o", 1), ("/mod/a.go", "m", "v", "d", "o", 2), ("/else/b.go", "m", "v", "d", "o", 3)], "file string, module string, module_version string, dir string, of string, k int")
    external = spark.createDataFrame([("/mod/a.go", "acme/b", "v2", "/mod"), ("/mod/a.go", "acme/a", None, "/mod")], "file string, module string, version string, dir string")
    got = discovery.relativize(rows, "/src/app/", external)
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == [("x.go", "m", "v", "d", "o", 1), ("acme/a/a.go", "m", "v", "d", "o", 2), ("external:unresolved", "m", "v", "d", "o", 3)]
    assert [tuple(r) for r in discovery.relativize(rows, "/src/app").orderBy(F.desc("k")).limit(1).collect()] == [("/else/b.go", "m", "v", "d", "o", 3)]


def test_literals_and_media_types():
    for text, want in [("true", True), ("T", True), ("False", False), ("1", 1), (" 1.5 ", 1.5), (".5", 0.5), ("+2", 2.0), ('"x"', "x"), ("[1]", [1]), ("NaN", "NaN"), ("word", "word"), ("t x", "t x"), ("", "")]:
        got = annotations.literal(text)
        assert got == want and type(got) is type(want)
    got = annotations.parse("@Accept json,XML,json-api,json\n@Produce gif , mpfd")
    assert got["accepts"] == ["application/json", "application/xml", "application/vnd.api+json"] and got["produces"] == ["gif", "multipart/form-data"]
