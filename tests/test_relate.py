"""Relations between extracted facts, on rows written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket.operators import relate


def test_config_values(spark):
    a = spark.createDataFrame([(1, "p.A", "u", "${svc.base-url:http://d}"), (1, "p.A", "v", "${x.y:dflt}"), (1, "p.A", "w", "plain"), (1, "p.A", "z", "${only.key}")], "repo_id long, class_name string, field_name string, attr_value string")
    u = spark.createDataFrame([(1, "p.A:f()", x) for x in "uvwz"] + [(1, "p.B:f()", "u")], "repo_id long, full_method string, field_name string")
    c = spark.createDataFrame([(1, "svc.base.url", "http://h"), (1, "x.y", " "), (2, "only.key", "other")], "repo_id long, config_key string, config_value string")
    assert {(r.config_key, r.config_value) for r in relate.config_values(a, u, c).collect()} == {("svc.base-url", "http://h"), ("x.y", "dflt"), ("only.key", None)}


def test_beans(spark):
    ann = spark.createDataFrame([("p.OneImpl", "x.Service", None), ("p.BImpl", "x.Component", "b"), ("p.URLThing", "x.Repository", ""), ("p.No", "x.Other", None)], "class_name string, annotation_class string, bean_name string")
    beans = relate.spring_beans(ann).cache()
    assert {tuple(r) for r in beans.collect()} == {("oneImpl", "p.OneImpl"), ("b", "p.BImpl"), ("URLThing", "p.URLThing")}
    inh = spark.createDataFrame([("p.OneImpl", "p.Base"), ("p.Base", "p.Api"), ("p.BImpl", "p.Api")], "child string, parent string")
    fields = spark.createDataFrame([("p.C", "one", "p.Api", None), ("p.C", "two", "p.Api", "b"), ("p.C", "three", "p.BImpl", None)], "class_name string, field_name string, field_type string, qualifier string")
    got = {(r.field_name, r.bean_class) for r in relate.bean_types(fields, beans, inh).collect()}
    assert got == {("one", "p.OneImpl"), ("one", "p.BImpl"), ("two", "p.BImpl"), ("three", "p.BImpl")}


def test_init_pairs(spark):
    calls = spark.createDataFrame([("m1", "p.R:<init>(int)"), ("m2", "p.R:<init>()"), ("m1", "p.X:<init>()"), ("m1", "p.R:go()")], "caller string, callee string")
    inh = spark.createDataFrame([("p.R", "p.Base"), ("p.Base", "java.lang.Runnable")], "child string, parent string")
    got = {tuple(r) for r in relate.init_pairs(calls, inh).collect()}
    assert got == {("m1", "p.R:<init>(int)", "_RIR1"), ("m2", "p.R:<init>()", "_RIR1"), ("p.R:<init>()", "p.R:run()", "_RIR2")}


def test_citations_risks_fields_extensions(spark):
    lines = spark.createDataFrame([(1, "A", i, t) for i, t in enumerate(["x", 'a = "K1"', "y", 'b = "K1"'], 1)], "repo_id long, file_path string, line_no int, text string")
    m = spark.createDataFrame([(1, "f", "A", 1, 4), (1, "g", "A", 3, 4)], "repo_id long, full_method string, file_path string, start_line int, end_line int")
    c = spark.createDataFrame([(1, "f", "K1"), (1, "g", "K1"), (1, "g", "K2")], "repo_id long, full_method string, value string")
    assert {tuple(r) for r in relate.citations(lines, m, c).collect()} == {("f", "K1", 2), ("g", "K1", 4)}
    changed = spark.createDataFrame([(1, "/orders"), (1, "t_order")], "from_repo long, what string")
    b = spark.createDataFrame([(2, "m", "HTTP", "GET /orders/1"), (1, "own", "HTTP", "/orders"), (3, "n", "MQ", "/orders"), (3, "o", "DB", "from t_order x")], "repo_id long, full_method string, boundary_type string, context string")
    assert {(r.what, r.full_method) for r in relate.release_risks(changed, b).collect()} == {("/orders", "m"), ("t_order", "o")}
    java = spark.createDataFrame([(1, "D.java", "class D { @NotNull(message=\"x\")\n private Long id;\n private final List<String> tags = new X();\n public int z; }")], "repo_id long, file_path string, text string")
    assert {(r.field_name, r.field_type, r.required) for r in relate.dto_fields(java).collect()} == {("id", "Long", True), ("tags", "List<String>", False)}
    calls = spark.createDataFrame([("a", "b", "VIR")], "caller string, callee string, call_type string")
    got = relate.extended(calls, [("_MA", lambda e: e.select(F.col("callee").alias("caller"), F.lit("c").alias("callee")))])
    assert {tuple(r) for r in got.collect()} == {("a", "b", "VIR"), ("b", "c", "_MA")}
    assert relate.mermaid([{"node": "a", "parent": None}, {"node": "b", "parent": "a"}]) == 'flowchart TD\n  n0["a"]\n  n1["b"]\n  n0 --> n1'
