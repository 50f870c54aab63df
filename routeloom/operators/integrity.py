"""What a saved fleet must satisfy before it is used again: records that are in form, and files that are still what was recorded.

Targets, modules, artifacts and files are tables. Every check is a row (target, module_id, problem), made by
projections, counts and joins on keys; derived state is made again and compared both ways with multiplicity. The barrier
`verified` counts all problems before it hands anything on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import clean_path
from ..functions.symbols import valid_module_id, valid_target_name
from ..schema import TARGET_STATUS
from ..sinks.tables import written

TARGETS = "target string, status string, complete boolean, ref string, commit string, source_fingerprint string, inventory_complete boolean, category string"
MODULES = "target string, module_id string, kind string, status string, complete boolean, report string, api_html string"
#: module_id is null in a target's own list.
ARTIFACTS = "target string, module_id string, tree string, path string, bytes bigint, sha256 string"
#: Kinds of modules, and the files that a format leaves (fixed values).
KINDS = ("go-module", "gin-module-no-routes", "gin-application")
FILES = {"json": "routes.json", "md": "routes.md", "openapi": "openapi.json", "sarif": "results.sarif", "pretty": "routes.txt"}


def ref_problem(ref: Column) -> Column:
    """Null for a usable name of a branch, tag or commit; none is usable."""
    bad = ref.rlike(r"^[-/]|\.$|/$|\.\.|@\{|//|[\x00\r\n ~^:?*\[\\]") | (ref == "@") | ref.rlike(r"(^|/)(\.|$)") | ref.rlike(r"\.lock(/|$)")
    return F.when((F.coalesce(ref, F.lit("")) != "") & bad, "invalid repository ref")


def commit_problem(commit: Column) -> Column:
    return F.when((F.coalesce(commit, F.lit("")) != "") & ~commit.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), "invalid scanned commit")


def artifact_problem(tree: Column, path: Column, size: Column, sha256: Column) -> Column:
    """Null for a record in form: a clean relative path that stays inside, a size, a digest."""
    path, clean = F.coalesce(path, F.lit("")), clean_path(F.coalesce(path, F.lit("")))
    return (
        F.when(~F.coalesce(tree, F.lit("")).isin("", "html"), "invalid tree")
        .when((path == "") | path.startswith("/") | clean.isin(".", "..") | clean.startswith("../"), "invalid path")
        .when(path.contains("\\") | (clean != path), "non-canonical path")
        .when(~F.coalesce(size >= 0, F.lit(False)) | ~F.coalesce(F.length(sha256) == 64, F.lit(False)), "invalid integrity metadata")
        .when(~sha256.rlike("^[0-9a-fA-F]{64}$"), "invalid SHA-256")
    )


def _rows(frame: DataFrame, problem: Column, module: Column | None = None) -> DataFrame:
    module = F.lit(None).cast("string") if module is None else module
    return frame.select("target", module.alias("module_id"), problem.alias("problem")).where("problem is not null")


def _double(frame: DataFrame, *key: str) -> DataFrame:
    """A row for each key that comes more than once; counts are combined before they are shuffled."""
    return frame.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _differ(one: DataFrame, other: DataFrame) -> DataFrame:
    """The rows that aren't as often in one frame as in the other: one aggregate, counts combined before they are shuffled."""
    sides = one.withColumn("side", F.lit(1)).unionByName(other.withColumn("side", F.lit(-1)))
    return sides.groupBy(*one.columns).agg(F.sum("side").alias("more")).where("more <> 0").drop("more")


def problems(targets: DataFrame, modules: DataFrame, artifacts: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """target, module_id, problem: everything wrong with the records of a saved fleet; null names and sets are wrong too.

    `groups` (name, category): the stated groups of repositories; they must be the targets' names and categories, each
    as often. A row that differs is a problem of its target, whichever side it is on.
    """
    module = F.col("module_id")
    out = _rows(targets, F.when(~F.coalesce(valid_target_name(F.col("target")), F.lit(False)), "invalid target name"))
    more = [
        _rows(_double(targets, "target"), F.lit("duplicate target name")),
        _rows(targets, F.when(~F.coalesce(F.col("status").isin(*TARGET_STATUS), F.lit(False)), "invalid status")),
        _rows(targets, ref_problem(F.col("ref"))),
        _rows(targets, commit_problem(F.col("commit"))),
        _rows(modules, F.when(~F.coalesce(valid_module_id(module), F.lit(False)), "invalid module id"), module),
        _rows(_double(modules, "target", "module_id"), F.lit("duplicate module id"), module),
        _rows(modules, F.when(~F.coalesce(F.col("status").isin(*TARGET_STATUS), F.lit(False)), "invalid status"), module),
        _rows(modules, F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "invalid module kind"), module),
        _rows(artifacts, artifact_problem(*map(F.col, ("tree", "path", "bytes", "sha256"))), module),
    ]
    if groups is not None:
        own, stated = targets.select("target", "category"), groups.select(F.col("name").alias("target"), "category")
        differ = _differ(own, stated).select("target").distinct()
        more.append(_rows(differ, F.lit("repository groups do not match targets")))
    for m in more:
        out = out.unionByName(m)
    return out


def verified(targets: DataFrame, found: DataFrame, most: int = 20) -> DataFrame:
    """`targets`, or ValueError with the first problems: nothing of a fleet with a problem is handed on."""
    bad = found.orderBy("target", "module_id", "problem").limit(most).collect()
    if bad:
        raise ValueError("the saved fleet is refused: " + "; ".join(f"{r['target']} {r['module_id'] or ''}: {r['problem']}".replace(" :", ":") for r in bad))
    return targets


def expected(modules: DataFrame, formats: tuple[str, ...] = ("json",), html: bool = False) -> DataFrame:
    """target, module_id, tree, path of the files that a complete scan of `modules` leaves. Targets with several modules have a folder each.

    `n`, the modules of a row's target, is counted unless it is there.
    """
    names = [FILES[f] for f in dict.fromkeys(("json", *formats)) if f in FILES]
    if "n" not in modules.columns:
        modules = modules.join(modules.groupBy("target").agg(F.count(F.lit(1)).alias("n")), "target")
    base = F.concat(F.lit("targets/"), "target", F.when(F.col("n") > 1, F.concat(F.lit("/modules/"), "module_id")).otherwise(""))
    files = [F.struct(F.lit("").alias("tree"), F.lit(f).alias("name")) for f in names]
    if html and "openapi" in formats:
        files.append(F.struct(F.lit("html").alias("tree"), F.lit("api.html").alias("name")))
    rows = modules.select("target", "module_id", base.alias("base"), F.explode(F.array(*files)).alias("f"))
    return rows.select("target", "module_id", "f.tree", F.concat("base", F.lit("/"), "f.name").alias("path"))


def reuse_problems(targets: DataFrame, modules: DataFrame, artifacts: DataFrame, files: DataFrame, current: DataFrame, formats: tuple[str, ...] = ("json",), html: bool = False) -> DataFrame:
    """target, problem: why the earlier result of a target can't stand for it now; targets without a row can.

    `current` (target, fingerprint): the sources as they are. `files` (tree, path, bytes, sha256): the files as they
    are. A result holds if it is complete and its source is the same; one that is no Go module if its inventory is
    complete and it has no modules and files; one that is ok if all its modules are, if modules and target record
    exactly the files expected, alike, and if each of them is unchanged. No other status holds. A changed, lost or
    surplus file therefore concerns its own target only.
    """
    of = lambda frame, problem: frame.select("target", F.lit(problem).alias("problem")).distinct()
    meet = lambda left, right, on, how: left.join(right.hint("merge"), on, how)  # noqa: E731  sides grow with the fleet: sorted and merged, never sent to the driver
    rows = meet(targets, current.select("target", F.col("fingerprint").alias("now")), "target", "left")
    state = (
        F.when(~F.coalesce("complete", F.lit(False)), "result is incomplete")
        .when((F.coalesce("source_fingerprint", F.lit("")) == "") | ~F.col("source_fingerprint").eqNullSafe(F.col("now")), "source identity changed")
        .when(F.col("status") == "not-go-module", F.when(~F.coalesce("inventory_complete", F.lit(False)), "repository inventory is incomplete"))
        .when(~F.coalesce(F.col("status") == "ok", F.lit(False)), "status is not reusable")
    )
    rows = written(rows.select("target", "status", state.alias("problem")), "states")
    good, foreign = rows.where("problem is null and status = 'ok'").select("target"), rows.where("problem is null and status = 'not-go-module'").select("target")
    inside = modules.select("target").unionByName(artifacts.select("target"))
    own = meet(modules, good, "target", "left_semi")
    own = written(meet(own, own.groupBy("target").agg(F.count(F.lit(1)).alias("n")), "target", "inner"), "modules")
    record = written(meet(artifacts, good, "target", "left_semi").withColumn("tree", F.coalesce("tree", F.lit(""))), "records")
    want, key = expected(own, formats, html), ["target", "tree", "path"]
    whole, parts = record.where("module_id is null").select(*key, "bytes", "sha256"), record.where("module_id is not null")
    listed = parts.select("target", "module_id", "tree", "path")
    there = files.select(F.coalesce("tree", F.lit("")).alias("tree"), "path", "bytes", "sha256")
    report = F.concat(F.lit("targets/"), "target", F.when(F.col("n") > 1, F.concat(F.lit("/modules/"), "module_id")).otherwise(""), F.lit("/routes.json"))
    page = F.regexp_replace(report, "routes.json$", "api.html") if html and "openapi" in formats else F.lit("")
    checks = [
        rows.where("problem is not null").select("target", "problem"),
        of(meet(foreign, inside, "target", "left_semi"), "unexpected module artifacts"),
        of(meet(good, modules, "target", "left_anti"), "no module inventory"),
        of(own.where(~F.coalesce(valid_module_id(F.col("module_id")), F.lit(False))), "invalid module id"),
        of(_double(own, "target", "module_id"), "duplicate module id"),
        of(own.where("not (coalesce(status = 'ok', false) and coalesce(complete, false))"), "a module is not complete"),
        of(own.where(~F.coalesce(F.col("report"), F.lit("")).eqNullSafe(report)), "non-canonical report path"),
        of(own.where(F.coalesce(F.col("api_html"), F.lit("")) != page), "unexpected HTML path"),
        of(record.where(artifact_problem(*map(F.col, ("tree", "path", "bytes", "sha256"))).isNotNull()), "an artifact record is not in form"),
        of(_differ(want, listed), "a module's artifact set is not complete"),
        of(_differ(whole, parts.select(*key, "bytes", "sha256")), "target artifacts do not match its modules"),
        of(meet(whole, there, ["tree", "path", "bytes", "sha256"], "left_anti"), "an artifact failed integrity verification"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def reusable(targets: DataFrame, *more: DataFrame, formats: tuple[str, ...] = ("json",), html: bool = False) -> DataFrame:
    """target of the earlier results that hold; arguments as of reuse_problems()."""
    return targets.select("target").distinct().join(reuse_problems(targets, *more, formats=formats, html=html), "target", "left_anti")


def tree_hashes(files: DataFrame, *root: str) -> DataFrame:
    """root, n_files, content_hash: one identity for the files (root, path, sha256) of each folder tree, whatever their order.

    SHA-256 over lines of path, zero byte and digest, by path. Names and digests of one tree meet in its row, contents don't.
    """
    line = F.concat("path", F.lit("\0"), "sha256", F.lit("\n"))
    return files.groupBy(*root).agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), ""), 256).alias("content_hash"))
