"""Reports, manifests, specifications, repositories and listings as frames."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.globs import in_scope
from ..functions.symbols import valid_module_id, valid_target_name
from ..operators.integrity import KINDS, artifact_problem, commit_problem, ref_problem
from ..schema import AUTH, AUTH_STATUS, BUILD_CONTEXT, FINDING, MIDDLEWARE, SOURCE, TARGET_STATUS

REPORT = (
    "schemaVersion string, tool string, command string, analysisProfile string, "
    f"target struct<module string, buildContext {BUILD_CONTEXT}>, "
    f"routes array<struct<method string, ginPath string, normalizedPath string, surfaceKind string, registrationKind string, middleware array<{MIDDLEWARE}>, finalHandler {MIDDLEWARE}, source {SOURCE}, pathConfidence string, auth {AUTH}>>, "
    f"findings array<struct<{FINDING.replace(' string', ':string').replace(' struct<', ':struct<')}>>, diagnostics array<struct<code string, severity string, message string, route string>>"
)

#: What a written report has besides, and the other documents.
REPORT_REST = (
    "toolVersion string, classifierRulesetVersion string, globalMiddleware array<string>, fallbackSurfaces array<string>, activeExceptions array<string>, policyEvaluation struct<evaluatedPolicies array<string>>, "
    "scanCoverage struct<discoveredPackages bigint, analyzedPackages bigint, failedPackages bigint, discoveredFiles bigint, analyzedFiles bigint, failedFiles bigint, unresolvedRegistrations bigint, profile string, complete boolean>, "
    "summary struct<totalRoutes bigint, provenByConfirmedShape bigint, provenByAttestedUnresolved bigint, public bigint, unknown bigint, findingsBySeverity map<string, bigint>>, "
    "delta struct<addedRoutes array<string>, removedRoutes array<string>, authRegressions array<struct<method string, path string, `from` string, `to` string, explanation string>>, authImprovements array<struct<method string, path string, `from` string, `to` string, explanation string>>>"
)
ARTIFACT = "struct<tree string, path string, bytes long, sha256 string>"
AGGREGATE = (
    "kind string, schemaVersion string, tool string, toolVersion string, scanFingerprint string, "
    f"targets array<struct<name string, status string, complete boolean, pushedAt string, sourceFingerprint string, repository struct<ref string, scannedCommit string>, inventory struct<complete boolean>, artifacts array<{ARTIFACT}>, routes long, proven long, public long, unknown long, "
    f"modules array<struct<id string, kind string, status string, complete boolean, report string, apiHtml string, artifacts array<{ARTIFACT}>, routes long, proven long, public long, unknown long>>>>, "
    "repositoryGroups struct<withRoutes array<string>, reference array<struct<name string, category string>>>"
)
SELECTOR = "struct<method array<string>, path array<string>, status array<string>, tag array<string>, role array<string>, scope array<string>, package array<string>, surfaceKind array<string>>"
CONFIGURATION = (
    "version string, authMiddleware map<string, struct<assurance string, tags array<string>, roles array<string>, scopes array<string>, openapiScheme string>>, authWrappers array<string>, acceptedPublic array<string>, "
    f"policies array<struct<id string, match {SELECTOR}, exceptions array<struct<reason string, expires string, match {SELECTOR}>>>>"
)

#: The field of a document that says who wrote it.
AUTHORSHIP = r"x-[\w.-]+-authorship"


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports, a file each, with `report_id`; an unknown version, command or status refuses the read of its row."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("report_id", F.input_file_name())
    odd = F.exists(F.coalesce("routes", F.array()), lambda r: r["auth"].isNotNull() & ~F.coalesce(r["auth"]["authStatus"].isin(*AUTH_STATUS), F.lit(False)))
    bad = F.when(F.col("schemaVersion").isNull() | ~F.col("schemaVersion").startswith("1."), "schema version").when(~F.col("command").isin("audit", "inventory"), "command").when(odd, "auth status")
    return refused(rows, F.concat("report_id", F.lit(": bad "), bad))


def refused(rows: DataFrame, problem: Column) -> DataFrame:
    """`rows`, or an error that names the first problem: a filter, so it holds whatever columns are read, and for counts."""
    return rows.where(F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.lit(True)))


def routes_of(reports_: DataFrame) -> DataFrame:
    """Routes of reports, with their place as `ord`."""
    return reports_.select("report_id", F.posexplode("routes").alias("ord", "r")).select("report_id", F.col("ord").cast("long").alias("ord"), "r.*")


def findings_of(reports_: DataFrame) -> DataFrame:
    return reports_.select("report_id", F.posexplode("findings").alias("ord", "f")).select("report_id", F.col("ord").cast("long").alias("ord"), "f.*")


def manifest(text: str) -> list[dict]:
    """Targets of a manifest: no double keys, unique safe names, exactly one of src and git."""

    def once(pairs: list) -> dict:
        keys = [k for k, _ in pairs]
        if double := {k for k in keys if keys.count(k) > 1}:
            raise ValueError(f"double keys {sorted(double)}")
        return dict(pairs)

    targets = json.loads(text, object_pairs_hook=once)["targets"]
    names = [t.get("name", "") for t in targets]
    for t in targets:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", t.get("name", "")) or names.count(t["name"]) > 1:
            raise ValueError(f"bad or repeated target name {t.get('name')!r}")
        if bool(t.get("src")) == bool(t.get("git")):
            raise ValueError(f"target {t['name']!r} needs exactly one of src and git")
    return targets


def aggregates(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """Targets of saved fleet aggregates, a file each; one whose envelope or records are out of form refuses the read.

    Checked are the envelope (none is `legacy`), names, statuses, refs, commits, module ids and kinds, artifact records,
    names and ids that come twice, keys that a JSON object has twice and fields that aren't known.
    """
    texts = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))

    def strict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(problem=[json_problem(t, fields) for t in pdf["value"]])

    fields = fields_of(StructType.fromDDL(AGGREGATE))
    rows = texts.mapInPandas(strict, "value string, file string, problem string").withColumn("a", F.from_json("value", AGGREGATE, {"mode": "PERMISSIVE"}))
    a = F.col("a")
    current = F.coalesce(a["schemaVersion"] != "", F.lit(False)) | F.coalesce(a["kind"] != "", F.lit(False))
    envelope = F.when(current, F.when(~F.coalesce((a["schemaVersion"] == "1.0") & (a["kind"] == "fleet") & (a["toolVersion"] != ""), F.lit(False)), "invalid fleet aggregate envelope")).otherwise(F.lit(None if legacy else "unversioned fleet aggregate"))
    no = lambda test: ~F.coalesce(test, F.lit(False))
    twice = lambda values: F.size(F.array_distinct(values)) < F.size(values)
    none = F.array().cast(f"array<{ARTIFACT}>")
    record = lambda r: artifact_problem(r["tree"], r["path"], r["bytes"], r["sha256"])
    records = lambda rs: F.get(F.filter(F.transform(F.coalesce(rs, none), record), lambda p: p.isNotNull()), 0)
    first = lambda values: F.get(F.filter(values, lambda p: p.isNotNull()), 0)
    module = lambda m: F.coalesce(F.when(no(valid_module_id(m["id"])), "invalid module id"), F.when(no(m["status"].isin(*TARGET_STATUS)), "invalid module status"), F.when(current & no(m["kind"].isin(*KINDS)), "invalid module kind"), records(m["artifacts"]))
    target = lambda t: F.coalesce(
        F.when(no(valid_target_name(t["name"])), "invalid target name"), F.when(no(t["status"].isin(*TARGET_STATUS)), "invalid status"),
        F.when(current, F.coalesce(ref_problem(t["repository"]["ref"]), commit_problem(t["repository"]["scannedCommit"]))), F.when(twice(t["modules"]["id"]), "duplicate module id"),
        first(F.transform(t["modules"], module)), records(t["artifacts"]),
    )
    none_at_all = F.when(a["targets"].isNull(), "targets must be an array")
    bad = F.coalesce(F.col("problem"), envelope, none_at_all, F.when(twice(a["targets"]["name"]), "a target is named twice"), first(F.transform(a["targets"], target)))
    return refused(rows, F.concat("file", F.lit(": "), bad)).select("a.scanFingerprint", F.explode("a.targets").alias("t")).select("scanFingerprint", "t.*")


def fields_of(kind: DataType) -> dict | None:
    """Names of a type's fields and of theirs; None where there are none."""
    if isinstance(kind, ArrayType):
        return fields_of(kind.elementType)
    return {f.name: fields_of(f.dataType) for f in kind.fields} if isinstance(kind, StructType) else None


def json_problem(text: str, fields: dict) -> str | None:
    """What is wrong with a JSON document: a key twice, a field that isn't among `fields`, or more after its end."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key comes twice")
        return dict(pairs)

    try:
        todo = [(json.loads(text, object_pairs_hook=once), fields)]
    except ValueError as e:
        return f"invalid fleet aggregate: {e}"
    while todo:
        value, known = todo.pop()
        if isinstance(value, list):
            todo += [(v, known) for v in value]
        elif isinstance(value, dict) and known is not None:
            if lost := sorted(set(value) - set(known)):
                return f"unknown field {lost[0]}"
            todo += [(v, known[k]) for k, v in value.items()]
    return None


def spec_documents(spark: SparkSession, folder: str, most_bytes: int = 2 << 20) -> DataFrame:
    """spec_id, dialect, version, authorship, operations (method, path), problem, local_refs of API documents in JSON or YAML under a folder.

    Documents over `most_bytes`, that don't parse or have an unsupported version are reported, not read; problems of
    references are reported beside what was read. Vendored and hidden folders don't count. Files are read on the
    executors.
    """
    root = folder.rstrip("/").removeprefix("file:")
    root = "/" + root.lstrip("/") if "://" not in root else root.split("://", 1)[1]
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = every.option("pathGlobFilter", "*.{[jJ][sS][oO][nN],[yY][aA][mM][lL],[yY][mM][lL]}").load(folder)
    files = files.where(~F.substring_index("path", root + "/", -1).rlike(r"(^|/)(vendor|node_modules|\.[^/]+)/"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [specification(p, c, n, most_bytes, root) for p, c, n in zip(pdf["path"], pdf["content"], pdf["length"], strict=True)]
            yield pd.DataFrame([r for r in rows if r], columns=["spec_id", "dialect", "version", "authorship", "operations", "problem", "local_refs", "targets"])

    schema = "spec_id string, dialect string, version string, authorship string, operations array<struct<method:string,path:string>>, problem string, local_refs array<string>, targets array<struct<ref:string,file:string>>"
    specs = files.select("path", "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content")).mapInPandas(parse, schema)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^[a-z0-9]+:/+", "/").alias("file"))
    lost = specs.select("spec_id", F.explode("targets").alias("t")).select("spec_id", "t.*").join(there, "file", "left_anti")
    lost = lost.groupBy("spec_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("spec-local-ref-unavailable: "), "ref"))), "; ").alias("lost"))
    problem = F.concat_ws("; ", "problem", "lost")
    return specs.join(lost, "spec_id", "left").withColumn("problem", F.when(problem != "", problem)).drop("lost", "targets")


def loaded(text: str) -> object:
    """The document of JSON, or the first one of YAML. ValueError: not to be parsed, or refused as the reference does."""
    import yaml

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("spec-parse-limit: duplicate mapping keys are unsupported")
        return dict(pairs)

    try:
        if text.lstrip().startswith("{"):
            try:
                json.loads(text)
            except ValueError:
                pass  # perhaps YAML in braces
            else:
                return json.loads(text, object_pairs_hook=once)
        loader = yaml.SafeLoader(text)
        node = loader.get_node() if loader.check_node() else None
        seen, todo = set(), [(node, 0)] if node else []
        while todo:
            n, depth = todo.pop()
            if id(n) in seen:
                raise ValueError("spec-parse-limit: YAML aliases are unsupported")
            seen.add(id(n))
            if len(seen) > 100_000 or depth > 64:
                raise ValueError("spec-parse-limit: YAML node or depth limit exceeded")
            if isinstance(n, yaml.MappingNode):
                keys = [str(k.value) for k, _ in n.value]
                if len(set(keys)) < len(keys):
                    raise ValueError("spec-parse-limit: duplicate mapping keys are unsupported")
                todo += [(c, depth + 1) for kv in n.value for c in kv]
            elif isinstance(n, yaml.SequenceNode):
                todo += [(c, depth + 1) for c in n.value]
        return loader.construct_document(node) if node else None
    except (yaml.YAMLError, RecursionError) as e:
        raise ValueError(f"spec-parse-invalid: {e}") from None


def references(doc: object) -> list[str]:
    """The distinct `$ref` of a document, sorted."""
    refs, todo = set(), [doc]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            refs |= {x["$ref"]} if isinstance(x.get("$ref"), str) else set()
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(refs)


def specification(path: str, content: bytes | None, length: int, most: int, root: str) -> tuple | None:
    if length > most:
        return path, None, None, None, [], "too large", [], []
    text = content.decode("utf-8", "replace").removeprefix("\ufeff")
    try:
        doc = loaded(text)
    except ValueError as e:
        named = re.search('"(openapi|swagger)"', text) if text.lstrip().startswith("{") else re.search(r"(?im)^(openapi|swagger):", text)
        return (path, None, None, None, [], str(e), [], []) if named or str(e).startswith("spec-parse-limit") else None
    if not isinstance(doc, dict) or (doc.get("openapi") is None and doc.get("swagger") is None):
        return None
    three, two = (str(doc.get(k)) if doc.get(k) is not None else "" for k in ("openapi", "swagger"))
    if not three.startswith("3.") and two not in ("2", "2.0"):
        return path, None, None, None, [], f"spec-version-unsupported: {three or two}", [], []
    dialect, version = ("openapi-3", three) if three.startswith("3.") else ("swagger-2", "2.0")
    said = next((v for k, v in doc.items() if re.fullmatch(AUTHORSHIP, str(k))), None)
    authorship = said if said in ("authored", "generated") else "generated" if doc.get("x-generated") is True else "unknown"
    verbs = {"get", "put", "post", "delete", "options", "head", "patch", "trace"}
    paths = doc.get("paths") if isinstance(doc.get("paths"), dict) else {}
    operations = [{"method": str(v).upper(), "path": str(p)} for p, item in paths.items() if isinstance(item, dict) for v in item if str(v).lower() in verbs]
    refs, bad, targets = references(doc), [], []
    here = re.sub("^[a-z0-9]+:/+", "/", path)
    for r in refs:
        file = posixpath.normpath(posixpath.join(posixpath.dirname(here), r.split("#")[0]))
        if r.startswith("#"):
            continue
        if "://" in r or r.startswith("//"):
            bad.append(f"spec-remote-ref-rejected: {r}")
        elif not file.startswith(root + "/"):
            bad.append(f"spec-ref-escape-rejected: {r}")
        else:
            targets.append({"ref": r, "file": file})
    return path, dialect, version, authorship, sorted(operations, key=lambda o: (o["path"], o["method"])), "; ".join(bad) or None, refs, targets


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """A saved listing of repositories (one JSON object a line), with its order."""
    schema = "id long, full_name string, name string, archived boolean, fork boolean, disabled boolean, size long, clone_url string, pushed_at string, ord long"
    return spark.read.schema(schema).json(path)


def source_inventory(spark: SparkSession, folder: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """repo (first folder), modules, files, source_hash of Go sources under a folder of repositories; vendored files don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").removeprefix("file:").removeprefix("//")
    relative = F.substring_index("path", root + "/", -1)
    rows = files.select(relative.alias("file"), "content").withColumn("repo", F.substring_index("file", "/", 1)).withColumn("inside", F.regexp_replace("file", "^[^/]*/", ""))
    rows = rows.where(~F.col("inside").rlike(r"(^|/)(vendor|node_modules|\.[^/]+)/")).where(in_scope(F.col("inside"), list(include), list(exclude)))
    rows = rows.where(F.col("inside").rlike(r"\.go$|(^|/)go\.(mod|sum|work)$")).withColumn("digest", F.sha2("content", 256))
    marks = F.array_sort(F.collect_list(F.concat("inside", F.lit(":"), "digest")))
    return rows.groupBy("repo").agg(F.count_if(F.col("inside").rlike(r"(^|/)go\.mod$")).alias("modules"), F.count_if(F.col("inside").endswith(".go")).alias("files"), F.sha2(F.array_join(marks, "\n"), 256).alias("source_hash"))
