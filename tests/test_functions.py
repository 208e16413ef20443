"""Column functions, the expression language, joins, search and logs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thicket.functions import el, predicates as pr, sig
from thicket.operators import joins, logs, search

ROWS = [("com.acme.OrderService", "save", "com.acme.OrderService:save(int,long)", 2), ("com.acme.OrderDto", "getId", "com.acme.OrderDto:getId()", 0), ("org.x.Job", "run", None, None)]
VARS = {"class_name": "class_name", "method_name": "method_name", "full_method": "full_method", "method_arg_num": "n"}


@pytest.fixture(scope="module")
def methods(spark):
    return spark.createDataFrame(ROWS, "class_name string, method_name string, full_method string, n int").cache()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_signature_parts(spark):
    full = F.lit("a.b.C$D:do(int,x.Y[])")
    got = [value(spark, f(full)) for f in (sig.class_name, sig.method_name, sig.params, sig.short_ref, sig.n_args)]
    assert got == ["a.b.C$D", "do", "int,x.Y[]", "C$D.do", 2]
    bare = F.lit("a.b.C")
    assert [value(spark, f(bare)) for f in (sig.class_name, sig.params)] == ["a.b.C", None]
    assert value(spark, sig.params(F.lit("a.C:f()"))) == "" and value(spark, sig.n_args(F.lit("a.C:f()"))) == 0
    assert value(spark, sig.access_words(F.lit(1 | 8 | 16))) == "public static final"
    assert value(spark, sig.camel_words(F.lit("parseHTTPUrlNow"))) == "parse http url now"
    assert value(spark, sig.placeholder_key(F.lit("x ${a.b:c} y"))) == "a.b" and value(spark, sig.placeholder_default(F.lit("${a.b:c}"))) == "c"
    assert value(spark, sig.placeholder_key(F.lit("plain"))) is None
    assert value(spark, sig.jar_display_name(F.lit("/x\\y/app-1.0.WAR"))) == "app-1.0"
    assert value(spark, sig.join_url(F.lit("http://h//"), F.lit("/a"))) == "http://h/a"


@pytest.mark.parametrize(
    ("text", "dropped"),
    [
        ("", 0), ("  ", 0), ("true", 3), ("false", 0), ("class_name == 'org.x.Job'", 1), ("class_name != 'org.x.Job'", 2),
        ("class_name == 'org.x.Job' || method_name == \"save\"", 2), ("string.startsWith(class_name, 'com.') && !string.endsWith(class_name, 'Dto')", 1),
        ("string.containsAny(class_name, 'Job', 'Dto')", 2), ("string.equalsIC(method_name, 'SAVE')", 1), ("string.startsWithAnyIC(class_name, 'ORG', 'NET')", 1),
        ("method_arg_num > 1", 1), ("method_arg_num + 1 <= 1", 1), ("full_method == nil", 1), ("string.contains(full_method, '(')", 2), ("!(method_arg_num == 0)", 2),
        ("string.length(method_name) == 3", 1), ("string.endsWithAny(method_name, 'n')", 1), ("string.containsIC(class_name, 'order')", 2), ("class_name == 'it\\'s'", 0),
    ],
)
def test_el_predicates(methods, text, dropped):
    kept, out = el.split_by(methods, text, {k: F.col(v) for k, v in VARS.items()}, "ignore_method")
    assert (out.count(), kept.count()) == (dropped, 3 - dropped)


@pytest.mark.parametrize(
    "text",
    ["class_nam == 'a'", "class_name", "class_name == ", "(true", "true)", "foo(class_name)", "class_name && true", "string.contains(class_name)", "1 + 1", "class_name = 'a'", "__import__('os')", "'a' == 'b' ; drop"],
)
def test_el_errors_name_the_setting(text):
    with pytest.raises(el.ElError, match="ignore_class"):
        el.translate(text, {k: F.col(v) for k, v in VARS.items()}, "ignore_class")


def test_path_templates(spark):
    rows = [("/a/1/b", "/a/{id}/b"), ("/a/1/b", "/a/{id}"), ("/a/1/c", "/a/{id}/b"), (None, "/a"), ("/a", "/a")]
    df = spark.createDataFrame(rows, "p string, t string")
    assert [r.v for r in df.select(F.coalesce(pr.path_matches(F.col("p"), F.col("t")), F.lit(False)).alias("v")).collect()] == [True, False, False, False, True]


def test_file_kinds(spark):
    names = ["src/main/resources/application-dev.yml", "config/a.properties", "db/migration/V1.sql", "pom.xml", "Dockerfile", "src/OrderController.java", "src/Order.java", "README.md"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.v for r in df.select(pr.file_kind(F.col("p")).alias("v")).collect()] == ["dev_config", "config", "sql", "dependency", "deploy", "api", "code", "other"]


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "reorder list"), (2, "ab"), (3, None), (4, ""), (5, "order order")], "id int, text string")
    needles = spark.createDataFrame([("order",), ("b",), ("ab",), ("zz",), (None,), ("",)], "w string")
    got = sorted((r.id, r.w) for r in joins.contains_join(texts, "text", needles, "w").collect())
    assert got == [(1, "order"), (2, "ab"), (2, "b"), (5, "order")]


def test_contains_join_beyond_the_automaton(spark):
    """The way of the rarest piece gives what the automaton gives, also where all needles begin alike."""
    held = [(i, f"com.shop.order.O{i % 7}:run com/path/{i}", "x") for i in range(60)] + [(99, "ab", "x")]
    words = [("com", 1), ("com.shop", 2), ("com.shop.order.O3", 3), ("path/5", 4), ("b", 5), ("com.none", 6), ("path/5", 7)]
    texts, needles = spark.createDataFrame(held, "id int, text string, other string"), spark.createDataFrame(words, "w string, k int")
    one, two = (sorted((r.id, r.w, r.k) for r in joins.contains_join(texts, "text", needles, "w", n).collect()) for n in (10_000, 0))
    assert one == two == sorted((i, w, k) for i, t, _ in held for w, k in words if w in t)


def test_template_join(spark):
    requests = spark.createDataFrame([(1, "GET", "/a/1/b"), (2, "GET", "/a/1/c"), (3, "PUT", "/a/1/b"), (4, "GET", None), (5, "GET", "/x"), (1, "GET", "/a/1/b")], "id int, m string, p string")
    templates = spark.createDataFrame([("GET", "/a/{id}/b", 1), ("GET", "/a/{id}/{x}", 2), ("GET", "{r}/{s}/{t}/{u}", 3), ("PUT", "/a/{id}", 4), ("GET", "/x", 5), ("GET", None, 6), ("GET", "/x", 7)], "m string, t string, k int")
    got = sorted((r.id, r.k) for r in joins.template_join(requests, "p", templates, "t", ["m"]).collect())
    assert got == sorted([(1, 1), (1, 2), (1, 3)] * 2 + [(2, 2), (2, 3), (5, 5), (5, 7)])


def test_asof_join_of_a_hot_key(spark):
    """One key over many ranges finds what a loop finds."""
    at = lambda h: datetime(2025, 1, 1) + timedelta(hours=h)
    right = [("k", at(7 * i), f"v{i}", i) for i in range(100)]
    left = [(i, "k", at(i)) for i in range(700)]
    a, b = spark.createDataFrame(left, "id int, k string, at timestamp"), spark.createDataFrame(right, "k string, at timestamp, v string, seq int")
    got = {r.id: r.v for r in joins.asof_join(a, b, ["k"], "at", ["v"], "seq", partitions=9).collect()}
    assert got == {i: f"v{i // 7}" for i in range(700)}


def test_generated_stubs(spark):
    rows = [("a.B$CStub:<init>(x)", True), ("a.B$CStub:withDeadline(x)", True), ("a.B$CStub:call(x)", False), ("a.BGrpc:<clinit>()", True), ("a.B:<init>()", False), (None, None)]
    df = spark.createDataFrame(rows, "m string, w boolean")
    assert all(r.g == r.w for r in df.select("w", pr.is_generated_method(F.col("m")).alias("g")).collect())


def test_business_constants(spark):
    rows = [("Order.PAID", True), ("12.5", False), ("调用支付", False), ("订单", False), ("订单号", False), ("订单号 A", True), ("a:bc", True), ("a:b", False), ("a: bc", False), ("warn it failed", False), ("it failed", True), ("x" * 40, True), ("x" * 41, False), ("/api/x y", True), ("is empty {}", False), ("--_", False), (None, False)]
    df = spark.createDataFrame(rows, "c string, w boolean")
    assert [(r.c, r.g) for r in df.select("c", "w", pr.is_business_constant(F.col("c")).alias("g")).collect() if r.g != rows[[x[0] for x in rows].index(r.c)][1]] == []


def test_asof_join(spark):
    d = lambda mo, da: datetime(2025, mo, da)
    left = spark.createDataFrame([(1, "k", d(1, 5)), (2, "k", d(3, 1)), (3, "k", d(1, 1)), (4, "x", d(3, 1)), (5, None, d(3, 1)), (6, "k", None)], "id int, k string, at timestamp")
    right = spark.createDataFrame([("k", d(1, 2), "a", 1), ("k", d(1, 5), "b", 1), ("k", d(1, 5), "c", 2), ("k", d(4, 1), "z", 1)], "k string, at timestamp, v string, seq int")
    got = {r.id: r.v for r in joins.asof_join(left, right, ["k"], "at", ["v"], "seq").collect()}
    assert got == {1: "c", 2: "c", 3: None, 4: None, 5: None, 6: None}


def test_priority_lookup(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    got = {r.k: r.o for r in joins.priority_lookup(df, [(one, ["k"], "v"), (two, ["k"], "v")], "o").collect()}
    assert got == {"a": 1, "b": 2, "c": None}


def test_log_diagnosis(spark):
    log = "ERROR boom\n\tat a.b.One.x(One.java:1)\n\tat a.b.Two.y(Two.java:2)\n\tat a.b.Three.z(Three.java:3)\n\tat a.b.Four.w(Four.java:4)\nCaused by: q\n\tat a.b.Four.w(Four.java:9)\n\tat Five.v(Five.java:1)"
    found = logs.frames(spark.createDataFrame([(1, log), (2, None), (3, "")], "id int, t string"), "id", "t").cache()
    assert [(r.method_name, r.line, r.near_top) for r in found.orderBy("line_no").collect()] == [("x", 1, True), ("y", 2, True), ("z", 3, True), ("w", 4, False), ("w", 9, True), ("v", 1, True)]
    chain = spark.createDataFrame([("a.b.One", "x"), ("a.b.Four", "w"), ("a.b.Five", "v"), ("a.b.Six", "u")], "class_name string, method_name string")
    assert {r.class_name: r.status for r in logs.diagnose(chain, found).collect()} == {"a.b.One": "ERROR", "a.b.Four": "ERROR", "a.b.Five": "ERROR", "a.b.Six": "UNKNOWN"}


def test_field_check(spark):
    got = value(spark, logs.field_check(F.lit('{"a": 1, "x": {"b": 2}}'), ["a", "c"], ["b", "d"]))
    assert (got.present, got.missing, got.not_supplied, got.unknown) == (["a", "b"], ["c"], ["d"], ["x"])
    kinds = [value(spark, logs.content_type(F.lit(t))) for t in ('{"code": 1}', "[1]", " at a.B.c(B.java:1)", "INFO x")]
    assert kinds == ["JSON_RESPONSE", "JSON_REQUEST", "STACK_TRACE", "MIXED_LOG"]


def test_search_scores(spark):
    df = spark.createDataFrame([(1, "Order list", None), (2, "x", "order"), (3, "y", "z")], "id int, a string, b string")
    got = search.best(df, search.keyword_score(["ORDER", "q"], [(F.col("a"), 10, 1), (F.col("b"), 5, 1)]), 10, "id").collect()
    assert [(r.id, r.score) for r in got] == [(1, 10), (2, 5)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "id int, v array<double>")
    assert [(r.id, round(r.similarity, 6)) for r in search.nearest(v, "v", [2.0, 0.0], 5, "id").collect()] == [(1, 1.0), (3, 0.707107)]
    repos = spark.createDataFrame([("fleet-hub", "订单服务"), ("other", "x")], "name string, text string")
    assert [r.name for r in search.route(repos, "订单 in fleet", "name", "text").collect()] == ["fleet-hub"]
    assert search.route(repos, "nothing", "name", "text").count() == 2
    assert search.route(repos, "订单 in fleet", "name", "text", whole=2).count() == 2
    assert search.route(repos, "订单 in fleet", "name", "text", whole=1).count() == 1
