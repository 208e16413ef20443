"""Readers, writers and streams on files of their own."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from thicket.sources import capture, relations
from thicket.streaming import windows


def test_relation_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb", True, None), (2, None, False, 7)], "id long, s string, f boolean, n int")
    relations.write_relation(df.coalesce(1), str(tmp_path / "r"))
    back = relations.read_relation(spark, str(tmp_path / "r"), [("id", "long"), ("s", "string"), ("f", "boolean"), ("n", "int")])
    assert sorted(map(tuple, back.collect())) == [(1, "a b", True, None), (2, "", False, 7)]


def test_relation_ragged_and_missing(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1\tA\n2\n3\tB\tQUI=\textra\nz\tC\tQg==\n")
    cols = [("id", "int"), ("s", "string"), ("b", "base64")]
    got = relations.read_relation(spark, str(tmp_path / "x.txt"), cols, least=2).collect()
    assert [tuple(r) for r in got] == [(1, "A", None), (3, "B", "AB"), (None, "C", "B")]
    assert relations.read_relation(spark, str(tmp_path / "none"), cols).count() == 0


def test_replace_repositories(spark, tmp_path):
    path = str(tmp_path / "t")
    relations.replace_repositories(spark.createDataFrame([(1, "a"), (2, "b")], "repo_id long, v string"), path)
    relations.replace_repositories(spark.createDataFrame([(2, "c")], "repo_id long, v string"), path)
    assert sorted((r.repo_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_upsert_config(spark):
    kv = "repo_id long, config_key string, config_value string, source string"
    old = spark.createDataFrame([(1, "a", "u", "USER"), (1, "b", "f", "FILE"), (1, "d", "x", "FILE")], kv)
    new = spark.createDataFrame([(1, "a", "n", "FILE"), (1, "b", "n", "FILE"), (1, "c", "n", "FILE")], kv)
    got = {r.config_key: (r.config_value, r.source) for r in relations.upsert_config(old, new).collect()}
    assert got == {"a": ("u", "USER"), "b": ("n", "FILE"), "c": ("n", "FILE"), "d": ("x", "FILE")}


def test_select_release(spark):
    df = spark.createDataFrame([("A", None), ("A", 9), ("A", 11), ("A", 21), ("B", None), ("C", 11)], "class_path string, version int")
    pick = lambda v: {r.class_path: r.version for r in relations.select_release(df, v).collect()}
    assert pick(8) == {"A": None, "B": None} and pick(11) == {"A": 11, "B": None, "C": 11} and pick(15) == {"A": 11, "B": None, "C": 11}


def test_properties_last_wins(spark, tmp_path):
    (tmp_path / "a.properties").write_text("# c\nk = 1\nu=http://h?x=y\nbroken\n")
    (tmp_path / "b.properties").write_text("k=2\r\nk = 3\n! z=1\n")
    got = relations.read_properties(spark, [str(tmp_path / "a.properties"), str(tmp_path / "b.properties")])
    assert {r.config_key: r.config_value for r in got.collect()} == {"k": "3", "u": "http://h?x=y"}


YAML = """# base
server:
  port: 8080   # main
  "host name": 'a: b'
spring:
  datasource:
    url: jdbc:x://h/db?a=1
  profiles:
    - dev
    - "test"
empty:
top: 1
"""


def test_yaml(spark, tmp_path):
    got = relations.flatten_yaml(YAML)
    assert got == [("server.port", "8080"), ("server.host name", "a: b"), ("spring.datasource.url", "jdbc:x://h/db?a=1"), ("spring.profiles[0]", "dev"), ("spring.profiles[1]", "test"), ("top", "1")]
    (tmp_path / "application.yml").write_text(YAML)
    (tmp_path / "application-dev.yml").write_text("---\nserver:\n  port: 9090\n")
    read = relations.read_yaml(spark, [str(tmp_path / "application.yml"), str(tmp_path / "application-dev.yml")])
    assert {r.config_key: r.config_value for r in read.collect()} == dict(got) | {"server.port": "9090"}


def test_curl(spark):
    texts = [
        "curl 'https://h.x/v1/a?b=1'",
        "curl -X POST https://h.x/v1/orders -H 'Content-Type: application/json' -d '{\"productId\": 1}'",
        "curl 'https://h.x' \\\n  -H 'a: b' \\\n  --data-raw 'x=1'",
        "curl nothing",
        None,
    ]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(capture.parse_curl(F.col("t")).alias("c")).collect()]
    assert (got[0].method, got[0].url, got[0].full_url, got[0].request_body) == ("GET", "/v1/a?b=1", "https://h.x/v1/a?b=1", None)
    assert (got[1].method, got[1].url, got[1].headers, got[1].request_body) == ("POST", "/v1/orders", {"Content-Type": "application/json"}, '{"productId": 1}')
    assert (got[2].method, got[2].url, got[2].headers, got[2].request_body) == ("POST", "/", {"a": "b"}, "x=1")
    assert got[3] is None and got[4] is None


def test_curl_words(spark):
    texts = [
        "curl\t--header \"A: b \\\"c\\\"\" -XPUT --url 'https://h.x/a b' -d 'it'\\''s' -d y=2 -o /tmp/x://y",
        "curl -H 'k: 1' -H k:2 -H bad https://h.x",
        "curl 'https://h.x/open",
    ]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(capture.parse_curl(F.col("t")).alias("c")).collect()]
    assert tuple(got[0]) == ("PUT", "/a b", "https://h.x/a b", {"A": 'b "c"'}, "it's&y=2")
    assert tuple(got[1]) == ("GET", "/", "https://h.x", {"k": "2"}, None)
    assert got[2].url == "/open"
    df = spark.createDataFrame([(texts[0],), ("[" * 1200 + "]" * 1200,), ('{"a": 1, "a": 2}',), ('{"a": 1, "a": 2',)], "t string")
    assert [tuple(r) for r in df.select(capture.is_curl(F.col("t")), capture.is_json(F.col("t"))).collect()] == [(True, False), (False, True), (False, True), (False, False)]


def test_sniffing(spark):
    rows = ["curl -X GET x", '{"a": 1}', "[1]", '{"a": 1} x', "text", "", None, "3"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [tuple(r) for r in df.select(capture.is_curl(F.col("t")), capture.is_json(F.col("t"))).collect()] == [
        (True, False), (False, True), (False, True), (False, False), (False, False), (False, False), (False, False), (False, False)
    ]


SESSION = {"session_id": 1, "request_chain": [{"seq": 1, "url": "/a", "duration": 5}, {"url": "/b", "request_headers": {"h": "v"}}]}


def test_sessions_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(SESSION) + "\n")
    rows = capture.requests_of(capture.read_sessions(spark, str(tmp_path / "in"))).select("url", "order_no").collect()
    assert [tuple(r) for r in rows] == [("/a", 1), ("/b", 2)]
    got = windows.finish(capture.requests_of(capture.stream_sessions(spark, str(tmp_path / "in"))).select("url"), "append")
    assert sorted(r.url for r in got.collect()) == ["/a", "/b"]


def test_closed_sessions_drop_late_rows(spark, tmp_path):
    at = lambda mi: datetime(2025, 1, 1, mi // 60, mi % 60)
    schema = "u int, ts timestamp"
    src = str(tmp_path / "events")
    for rows in [(1, at(0)), (1, at(5))], [(1, at(200))], [(2, at(205))], [(1, at(6)), (2, at(206))], [(3, at(400))]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    events = windows.closed_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "ts", "u", "10 minutes", "5 minutes")
    got = windows.finish(events, "append").where("u = 1 and n > 1").collect()
    assert [(r.first_at, r.last_at, r.n) for r in got] == [(at(0), at(5), 2)]  # minute 6 came after minute 200
