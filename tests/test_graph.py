"""Graph operators on small graphs whose rows are written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thicket.operators import graph, topology

EDGE = "caller string, callee string, call_type string, enabled boolean, call_id int"


def m(x):
    return f"p.{x}:run(int)"


def edges(spark, pairs, kind="VIR", enabled=True):
    return spark.createDataFrame([(m(a), m(b), kind, enabled, i) for i, (a, b) in enumerate(pairs)], EDGE)


def starts(spark, *names):
    return spark.createDataFrame([(m(n),) for n in names], "node string")


def reached(df):
    return {r.node[2:-9]: r.depth for r in df.collect()}


@pytest.mark.parametrize(
    ("pairs", "depth", "want"),
    [
        ([("a", "b"), ("b", "c"), ("c", "d")], 2, {"a": 0, "b": 1, "c": 2}),
        ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], None, {"a": 0, "b": 1, "c": 1, "d": 2}),
        ([("a", "a")], None, {"a": 0}),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x")], None, {"a": 0, "b": 1, "c": 2, "x": 3}),
        ([], None, {"a": 0}),
        ([("a", "b"), ("a", "b")], None, {"a": 0, "b": 1}),
    ],
)
def test_reach(spark, pairs, depth, want):
    assert reached(graph.reach(graph.arrows(edges(spark, pairs)), starts(spark, "a"), depth)) == want


def test_reach_upward_with_stops(spark):
    steps = graph.arrows(edges(spark, [("e2", "e1"), ("e1", "b"), ("b", "a"), ("c", "a")]), upward=True)
    assert reached(graph.reach(steps, starts(spark, "a"), None, starts(spark, "e1"))) == {"a": 0, "b": 1, "c": 1, "e1": 2}
    assert reached(graph.reach(steps, starts(spark, "e1"), None, starts(spark, "e1"))) == {"e1": 0, "e2": 1}


def test_valid_edges(spark):
    rows = [
        (m("a"), m("b"), "VIR", True), (m("a"), m("c"), "VIR", False), (m("a"), m("d"), "IMPLEMENTS", True), (m("a"), "p.X:getName()", "VIR", True),
        (m("a"), "p.X:getName(int)", "VIR", True), (m("a"), "p.X:setName(int)", "VIR", True), (m("a"), "p.X:setName(int,int)", "VIR", True),
        (m("a"), "p.X:<init>(int)", "SPE", True), (m("a"), "io.grpc.Channel:call(int)", "VIR", True), (m("a"), "q.Y:run(int)", "VIR", True),
        (m("a"), "p.XGrpc:go(int)", "VIR", True), (m("a"), "p.XGrpc$XBlockingStub:load(int)", "VIR", True), (m("a"), "p.XGrpc$XBlockingStub:withOption(int)", "VIR", True),
    ]
    e = spark.createDataFrame(rows, "caller string, callee string, call_type string, enabled boolean")
    got = {r.callee for r in graph.valid_edges(e, ["p."]).collect()}
    assert got == {m("b"), "p.X:getName(int)", "p.X:setName(int,int)", "p.XGrpc$XBlockingStub:load(int)"}


def test_tree_rules(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")])
    rows = graph.assemble_tree(e, m("a"), 5)
    assert [(r["node"][2:-9], r["depth"], r["recursive"]) for r in rows] == [("a", 0, False), ("b", 1, False), ("d", 2, False), ("a", 3, True), ("e", 3, False), ("c", 1, False)]
    lazy = graph.assemble_tree(e, m("a"), 1)
    assert [(r["node"][2:-9], r["lazy"]) for r in lazy] == [("a", False), ("b", True), ("c", True)]


def test_simple_paths(spark):
    steps = graph.arrows(edges(spark, [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")]))
    got = {"".join(x[2:-9] for x in r.path) for r in graph.simple_paths(steps, starts(spark, "a"), 3).collect()}
    assert got == {"a", "ab", "ac", "abc"}
    assert graph.simple_paths(steps, starts(spark, "a"), 3, max_rows=1).count() <= 4


def inh(spark, rows):
    return spark.createDataFrame(rows, "child string, parent string, kind string")


def test_bridge_and_callees(spark):
    e = spark.createDataFrame([("p.A:go()", "p.I:run(int)", "INT", True), ("p.Impl1:run(int)", "p.X:do(int)", "VIR", True)], "caller string, callee string, call_type string, enabled boolean")
    i = inh(spark, [("p.Impl1", "p.I", "IMPLEMENTS"), ("p.Impl2", "p.I", "IMPLEMENTS"), ("p.Impl3", "p.I", "IMPLEMENTS")])
    methods = spark.createDataFrame([("p.Impl2:run(int)",)], "full_method string")
    want = {("p.I:run(int)", "p.Impl1:run(int)"), ("p.I:run(int)", "p.Impl2:run(int)")}
    assert {tuple(r) for r in graph.bridge(i, e, methods).collect()} == want
    s = spark.createDataFrame([("p.I:run(int)",), ("p.A:go()",)], "node string")
    got = {tuple(r) for r in graph.callees(e, s, i, methods).collect()}
    assert got == {(*w, "IMPL") for w in want} | {("p.A:go()", "p.I:run(int)", "INT")}


def test_propagate(spark):
    steps = graph.arrows(edges(spark, [("f", "e"), ("e", "d"), ("d", "c"), ("c", "b"), ("b", "a"), ("g", "f"), ("b", "x")]))
    own = spark.createDataFrame([(m("a"), "DB"), (m("x"), "MQ"), (m("d"), "HTTP")], "node string, mark string")
    got = {(r.node[2:-9], r.mark) for r in graph.propagate(steps, own, 5).collect()}
    assert got == {("b", "DB"), ("c", "DB"), ("e", "DB"), ("f", "DB"), ("b", "MQ"), ("c", "MQ"), ("e", "MQ"), ("f", "MQ"), ("e", "HTTP"), ("f", "HTTP"), ("g", "HTTP")}


def test_inheritance(spark):
    i = inh(spark, [("c", "b", "EXTENDS"), ("b", "a", "EXTENDS"), ("c", "i", "IMPLEMENTS"), ("i", "j", "EXTENDS")])
    got = {tuple(r) for r in graph.ancestors(i.select("child", "parent")).collect()}
    assert got == {("c", "b", 1), ("b", "a", 1), ("c", "i", 1), ("i", "j", 1), ("c", "a", 2), ("c", "j", 2)}
    assert {r.node for r in graph.inheritance_roots(i).collect()} == {"a", "j"}
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    assert graph.ancestors(loop).count() == 4


def test_polymorphic_edges(spark):
    i = inh(spark, [("Impl", "Api", "IMPLEMENTS"), ("Sub", "Base", "EXTENDS"), ("Sub2", "Base", "EXTENDS")])
    methods = spark.createDataFrame(
        [("Api", "go()", True), ("Impl", "go()", False), ("Base", "run()", True), ("Base", "log()", False), ("Sub", "run()", False), ("Sub2", "log()", False)],
        "class_name string, method_key string, abstract boolean",
    )
    got = {tuple(r) for r in graph.polymorphic_edges(i, methods).collect()}
    assert got == {("Api:go()", "Impl:go()", "_ITF"), ("Base:run()", "Sub:run()", "_SCC"), ("Sub:log()", "Base:log()", "_CCS")}


def test_topology_priorities(spark):
    calls = spark.createDataFrame([(1, "a.b.C:x()", 5), (1, "a.b.D:y()", 2), (1, "a.b.E:z()", 1), (1, "q.r.S:t()", 9), (2, "a.b.C:x()", 3)], "repo_id long, callee string, n long")
    ep = spark.createDataFrame([("a.b.C:x()", 2, "CONTROLLER"), ("a.b.C:x()", 3, "KAFKA_LISTENER")], "full_method string, repo_id long, endpoint_type string")
    methods = spark.createDataFrame([(3, "a.b.D:y()"), (4, "a.b.F:f()"), (4, "a.b.G:g()"), (3, "a.b.C:x()"), (4, "a.b.C:x()")], "repo_id long, full_method string")
    got = {(r.repo_id, r.callee, r.to_repo, r.level) for r in topology.resolve(calls, ep, methods, 2).collect()}
    assert got == {(1, "a.b.C:x()", 2, 1), (1, "a.b.C:x()", 3, 1), (1, "a.b.D:y()", 3, 2), (1, "a.b.E:z()", 4, 3), (2, "a.b.C:x()", 3, 1)}
    kinds = {(r.from_repo, r.to_repo): r.call_type for r in topology.service_edges(calls, ep, methods, 2).collect()}
    assert kinds == {(1, 2): "HTTP", (1, 3): "MQ", (1, 4): "RPC", (2, 3): "MQ"}


def test_package_tree_merges_single_children(spark):
    c = spark.createDataFrame([(1, "a.b.c", "a.b.c.X"), (1, "a.b.c", "a.b.c.Y"), (1, "a.b.d", "a.b.d.Z")], "repo_id long, package_name string, class_name string")
    got = {(r.name, r.n_classes) for r in graph.package_tree(c, ["repo_id"]).collect()}
    assert got == {("a.b", 3), ("a.b.c", 2), ("a.b.d", 1)}


def test_null_nodes_are_not_entered(spark):
    e = spark.createDataFrame([("a", None), (None, "b"), ("a", "b")], "caller string, callee string")
    s = spark.createDataFrame([("a",), (None,)], "node string")
    assert {tuple(r) for r in graph.reach(graph.arrows(e), s).select("node", F.col("depth")).collect()} == {("a", 0), ("b", 1)}


def test_ancestors_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(100)], "child string, parent string")
    got = graph.ancestors(chain)
    assert got.count() == 100 * 101 // 2 and got.agg({"distance": "max"}).first()[0] == 100
    assert graph.ancestors(chain, 3).count() == 100 + 99 + 98
