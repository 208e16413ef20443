"""The engine's questions and the enrichment of relations, on a program of a few methods."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thicket.engine import Engine
from thicket.operators import enrich

A, I, X, B, D = "a.web.AController:list()", "a.svc.S:find(long)", "a.svc.SImpl:find(long)", "b.api.BClient:load(long)", "b.dao.DMapper:select(long)"


@pytest.fixture(scope="module")
def eng(spark):
    edges = [(1, A, I, "INT", True, 5, 1), (1, X, B, "VIR", True, 9, 2), (1, "a.svc.SImpl", "a.svc.S", "IMPLEMENTS", True, None, 3), (2, B, D, "VIR", True, 3, 4), (1, X, "a.M:getId()", "VIR", True, 10, 5), (1, A, D, "VIR", False, 6, 6)]
    e = spark.createDataFrame(edges, "repo_id long, caller string, callee string, call_type string, enabled boolean, line_number int, call_id int")
    methods = [(1, A, "a.web.AController", "A.java", 2, 3, "lists orders"), (1, X, "a.svc.SImpl", "S.java", 1, 2, None), (2, B, "b.api.BClient", "B.java", 1, 1, None), (2, D, "b.dao.DMapper", None, None, None, None), (1, I, "a.svc.S", None, None, None, None)]
    m = spark.createDataFrame(methods, "repo_id long, full_method string, class_name string, file_path string, start_line int, end_line int, call_summary string")
    ep = spark.createDataFrame([(1, A, "CONTROLLER", "GET", "/orders/list", "a.web.AController")], "repo_id long, full_method string, endpoint_type string, http_method string, url_path string, class_name string")
    b = spark.createDataFrame([(2, D, "DB", "select", None)], "repo_id long, full_method string, boundary_type string, context string, callee_method string")
    r = spark.createDataFrame([(1, "one", "git", "x"), (2, "two", "git", "y"), (3, "three", "git", "z")], "id long, name string, git_url string, url_path_identifier string")
    lines = spark.createDataFrame([(1, "A.java", i, f"line {i}") for i in range(1, 6)], "repo_id long, file_path string, line_no int, text string")
    v = spark.createDataFrame([(A, [1.0, 0.1]), (D, [1.0, 0.0])], "full_method string, embedding array<double>")
    return Engine(spark, e, m, ep, b, r, lines, v)


def test_listings(eng):
    assert {r.id: (r.n_methods, r.n_classes) for r in eng.list_repositories().collect()} == {1: (3, 3), 2: (2, 2), 3: (0, 0)}
    assert eng.list_api_endpoints(1, "controller", "ORDERS").count() == 1 and eng.list_api_endpoints(text="zzz").count() == 0
    assert [r.full_method for r in eng.resolve_method("SImpl.find").collect()] == [X]


def test_graph_questions(eng):
    assert {(r.callee, r.call_type) for r in eng.callees(I).collect()} == {(X, "IMPL")}
    assert {(r.caller, r.callee, r.depth) for r in eng.call_tree(A, 5).collect()} == {(A, I, 0), (I, X, 1), (X, B, 2), (B, D, 3)}
    assert [r["node"] for r in eng.call_tree_rows(A, 2)] == [A, I, X] and eng.call_tree_rows(A, 2)[-1]["lazy"]
    assert {(r.node, r.depth) for r in eng.callers(D, 2).collect()} == {(D, 0), (B, 1), (A, 1), (X, 2)}
    assert {(r.full_method, r.repo_id, r.endpoint_type) for r in eng.impact(I).collect()} == {(I, 1, None), (A, 1, "CONTROLLER")}
    assert {(r.caller, r.callee) for r in eng.cross_repo_tree(A).where("crosses").collect()} == {(X, B)}
    assert [(r.full_method, r.boundary_type, r.depth) for r in eng.external_calls(A).collect()] == [(D, "DB", 4)]
    out = eng.chain_outline(A, 2)
    assert [r["node"] for r in out] == [A, I] and out[-1]["truncated"]
    assert {"<".join(r.path) for r in eng.upstream_tree(I).collect()} == {I, f"{I}<{A}"}
    assert {(r.from_repo, r.to_repo) for r in eng.topology().collect()} == {(1, 2)}


def test_source_search_and_log(eng):
    assert [r.text for r in eng.method_source(A).collect()] == ["line 2", "line 3"]
    got = {r.full_method: r.snippet for r in eng.impact_with_source(I, radius=1).collect()}
    assert got[A] == "  1: line 1\n> 2: line 2\n  3: line 3" and got[I] is None
    assert [r.full_method for r in eng.keyword_search(["orders"]).collect()] == [A]
    assert [(r.full_method, r.score) for r in eng.semantic_search([1.0, 0.0], k=2).collect()] == [(A, 99), (D, 80)]
    log = "x\n at b.api.BClient.load(B.java:1)\n"
    assert {r.class_name: r.status for r in eng.analyze_log(A, log).collect()}["b.api.BClient"] == "ERROR"


def test_enrichment(spark):
    calls = spark.createDataFrame([("1", "1", "p.A:f()", "(VIR)java.sql.Statement:execute()", "7"), ("2", "0", "p.A:f()", "(INT)p.XMapper:get(int)", "x"), ("3", "1", "io.grpc.Q:f()", "(VIR)p.B:g()", "1"), ("4", "1", "p.A:f()", "(VIR)java.sql.Statement:execute()", "5")], "call_id string, enabled string, caller string, callee string, line string")
    c = enrich.import_calls(calls)
    assert {(r.call_id, r.enabled, r.call_type, r.line_number) for r in c.collect()} == {("1", True, "VIR", 7), ("2", False, "INT", None), ("4", True, "VIR", 5)}
    assert {(r.callee, r.boundary_type, r.line_number) for r in enrich.detect_boundaries(c).collect()} == {("java.sql.Statement:execute()", "DB", 5), ("p.XMapper:get(int)", "DB", None)}
    info = spark.createDataFrame([("p.A:f(int)", 9, "void"), ("p.A:f(int)", 9, "void"), ("p.T$Builder:build()", 1, "p.T"), (None, 1, "x")], "full_method string, flags int, return_type string")
    assert [(r.full_method, r.access, r.package_name) for r in enrich.import_methods(info).collect()] == [("p.A:f(int)", "public static", "p")]
    ex = enrich.exception_boundaries(
        spark.createDataFrame([("m", "E1", "", 3), ("m", "E2", "switch", 4), ("m", "E1", None, 2)], "full_method string, exception_type string, flag string, line int"),
        spark.createDataFrame([("m", "E3", 9)], "full_method string, exception_type string, line int"),
    )
    assert {(r.context, r.line_number) for r in ex.collect()} == {("catch E1", 2), ("throw E3", 9)}


def test_endpoints_from_annotations(spark):
    rows = [("p.C:a()", "x.GetMapping", "value", "{/list}"), ("p.C:a()", "x.RequestMapping", "value", "/other"), ("p.C:b(int)", "x.PostMapping", None, None), ("p.K:on(m)", "x.KafkaListener", "topics", '["t1"]'), ("p.K:tick()", "x.Scheduled", "cron", "0 * *"), ("p.C:c()", "x.Other", None, None)]
    ann = enrich.annotation_attributes(spark.createDataFrame(rows, "full_method string, annotation_class string, attr_name string, attr_value string"))
    paths = spark.createDataFrame([("p.C", "/base/")], "class_name string, base_path string")
    got = {(r.full_method, r.endpoint_type, r.http_method, r.url_path, r.target) for r in enrich.endpoints(ann, paths).collect()}
    assert got == {("p.C:a()", "CONTROLLER", "GET", "/base/list", None), ("p.C:b(int)", "CONTROLLER", "POST", "/base", None), ("p.K:on(m)", "KAFKA", None, None, "topic:t1"), ("p.K:tick()", "SCHEDULED", None, None, "cron:0 * *")}
    inh = spark.createDataFrame([("p.Q", "z.JobConsumer"), ("p.Q", "z.Job"), ("p.R", "z.Thing")], "child string, parent string")
    methods = spark.createDataFrame([("p.Q", "p.Q:run()", 1), ("p.Q", "p.Q:x()", 2), ("p.R", "p.R:y()", 1)], "class_name string, full_method string, flags int")
    known = spark.createDataFrame([], "full_method string, endpoint_type string")
    assert [tuple(r) for r in enrich.inherited_endpoints(inh, methods, known).collect()] == [("p.Q:run()", "MQ")]


def test_lists_and_enums(spark):
    rows = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "b", 3), ("k", None, 0), ("k", "c", 4)], "k string, v string, o int")
    assert [r["values"] for r in enrich.json_lists(rows, ["k"], "v", "o", 2).collect()] == ['["b","a"]']
    args = spark.createDataFrame([("E", "ONE", 0, 3, "x"), ("E", "ONE", 0, 4, "name"), ("E", "ONE", 0, 5, "7"), ("E", "ONE", 0, 6, "9"), ("E", "TWO", 1, 3, "text")], "enum_class string, const_name string, ordinal int, arg_seq int, value string")
    got = {(r.const_name, r.ordinal, r.code, r.description) for r in enrich.enum_constants(args).collect()}
    assert got == {("ONE", 0, "7", "name"), ("TWO", 1, None, "text")}
    assert enrich.enum_constants(args).where(F.col("code") == "9").count() == 0
