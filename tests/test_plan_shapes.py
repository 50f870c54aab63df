"""Plans that compute a step once a row: nothing is pushed below the classification, JSON is read once, sides are read once."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from routeloom.operators import candidates, classify, compare, enforcement, integrity, policy, structs
from routeloom.plans import fleets, programs, rules
from routeloom.plans import queries as q
from routeloom.plans.adapter import CONFIG, NOW, facts
from routeloom.sinks import render

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["findings", "policies", "gaps"])
def test_no_filter_repeats_the_classification(spark, name):
    routes = q.classified(spark, DATA)
    frame = {"findings": lambda: classify.findings_of(routes), "policies": lambda: policy.evaluate(routes, CONFIG, NOW), "gaps": lambda: classify.verb_gaps(routes)}[name]()
    assert not [line for line in plan(frame).splitlines() if "Filter" in line and "lambda" in line]


@pytest.mark.parametrize("snapshot", [0, 1])
def test_facts_read_json_once(spark, snapshot):
    assert plan(facts(spark, DATA, snapshot)).count("get_json_object") == 1


@pytest.mark.parametrize("snapshot", [0, 1])
def test_routes_of_one_row_group_are_dealt_out(spark, snapshot):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # else this small table would be put together again
    try:
        assert facts(spark, DATA, snapshot).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset(name)


def test_snapshots_share_the_shuffle_of_events(spark):
    rows = q.finding_diff(spark, DATA)
    rows.collect()
    text = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_chains_are_opened_by_one_projection(spark):
    text = plan(classify.findings_of(q.classified(spark, DATA)))
    assert len([line for line in text.splitlines() if "lambdafunction" in line and ".canonicalSymbol" in line]) == 1


def test_findings_are_compared_in_one_pass(spark):
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "fingerprint string")
    got = compare.compare_findings(of("a", "b", "b", "c"), of("b", "d", "d"))
    assert plan(got).count("LogicalRDD") + plan(got).count("LocalRelation") == 2
    assert sorted(map(tuple, got.collect())) == [("a", "resolved"), ("c", "resolved"), ("d", "new")]


def test_candidates_open_chains_once(spark):
    rows = candidates.suggest(facts(spark, DATA), q.shapes(spark))
    assert "Generate" not in plan(rows) and rows.agg(F.sum("route_count")).first()[0] > 0


def test_reuse_sends_nothing_to_the_driver(spark):
    assert "Broadcast" not in fleets.reuse_problems(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_sets_that_differ(spark):
    of = lambda *rows: spark.createDataFrame(rows, "target string, path string")
    got = integrity._differ(of(("a", "x"), ("a", "x"), ("b", None), ("c", "z")), of(("a", "x"), ("b", None), ("d", "z")))
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("c", "z"), ("d", "z")]


def test_a_report_s_lists_never_meet_in_a_row(spark):
    text = plan(rules.report_json(spark, DATA))
    assert "collect_list(struct(ord" not in text and "collect_list(struct(col1" not in text


def test_digests_of_ordered_lines(spark):
    rows = [(g, i, None if i % 50 == 7 else f"é{i}", g + ";") for g in "abc" for i in range(3000)] + [("d", 0, None, ",")]
    frame = spark.createDataFrame(rows, "g string, i int, line string, between string").orderBy(F.rand(3))
    want = {g: (len([r for r in rows if r[0] == g]), hashlib.md5(f"{g};".join(r[2] for r in rows if r[0] == g and r[2] is not None).encode()).hexdigest()) for g in "abcd"}
    assert {r["g"]: (r["n"], r["md5"]) for r in render.digests(frame, ["g"], ["i"]).collect()} == want


def test_items_are_the_elements_of_the_document(spark):
    routes = q.classified(spark, DATA)
    found = classify.findings_of(routes, "target")
    head = F.struct(F.lit("m").alias("module"))
    whole = {r["target"]: json.loads(r["report"]) for r in render.reports_json(routes, found, head, "target").collect()}
    bare = {r["target"]: json.loads(r["report"]) for r in render.reports_json(routes, found, head, "target", lists=False).collect()}
    for r in render.report_items(routes, found, "target").orderBy("severity", "fingerprint", "ord").collect():
        bare[r["target"]][r["list"]].append(json.loads(r["item"]))
    assert bare == whole


def test_a_field_s_tag_is_read_once(spark):
    fields = spark.createDataFrame([("m.A", 0, "X", "*string", 'json:"x" default:"1"', False)], structs.FIELDS)
    text = plan(structs.properties(fields))
    assert [text.count(f'(?:^|\\s){key}:"') for key in ("example", "default", "enums", "binding", "validate")] == [1] * 5
    assert [(r["property"], json.loads(r["schema"]), r["required"]) for r in structs.properties(fields).collect()] == [("x", {"type": ["string", "null"], "default": 1}, False)]


def test_statements_are_projections_of_what_is_written(spark):
    assert not [frame for frame in programs.code(spark, DATA) if any(step in plan(frame) for step in ("Join", "Window", "Aggregate"))]


def test_functions_are_not_joined_with_themselves(spark):
    functions, returns = spark.createDataFrame([("f", "p", "b", True, False)], enforcement.FUNCTIONS), spark.createDataFrame([], enforcement.RETURNS)
    text = []
    held, enforcement.written = enforcement.written, lambda df, name: text.append(plan(df)) or held(df, name)
    try:
        assert list(map(tuple, enforcement.bodies(functions, returns, 0).collect())) == [("f", "b", "p")]
    finally:
        enforcement.written = held
    assert "Join" not in text[-1]
