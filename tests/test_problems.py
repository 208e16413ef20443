"""The general data problems on small fixtures, and against brute force."""

from __future__ import annotations

import json
import random
import re
from datetime import datetime

import brute
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from thicket.functions import json_text
from thicket.operators import nested, orphans, packed, skew
from thicket.plans import problems
from thicket.session import table


def ts(day: int, hour: int = 0) -> datetime:
    return datetime(2025, 1, day, hour)


# --- orphans -----------------------------------------------------------------------------

REFS = "id long, repo_id long, method string, imported_at timestamp, table_name string"
LIVES = "repo_id long, method string, born timestamp, died timestamp, id string"


def refs(spark, rows):
    return orphans.references(spark.createDataFrame(rows, REFS), "t", ["repo_id", "method"], "imported_at")


def lives(spark, rows):
    return orphans.lifetimes(spark.createDataFrame(rows, LIVES), ["repo_id", "method"], "born", "died")


def lost(spark, r, p):
    return sorted((x.row_id for x in orphans.orphan_rows(refs(spark, r), lives(spark, p)).collect()), key=str)


def test_orphans_by_lifetime(spark):
    parents = [(1, "a", ts(5), ts(10), "x"), (1, "a", ts(12), None, "y"), (1, "a", ts(12), None, "z"), (2, "b", ts(3), ts(3), "q")]
    rows = [
        (1, 1, "a", ts(4), ""), (2, 1, "a", ts(5), ""), (3, 1, "a", ts(9), ""), (4, 1, "a", ts(10), ""), (5, 1, "a", ts(20), ""),
        (6, 2, "a", ts(20), ""), (7, 2, "b", ts(3), ""), (8, None, "a", ts(4), ""), (9, 1, None, ts(4), ""), (10, 1, "A", ts(6), ""),
    ]
    assert lost(spark, rows, parents) == [1, 10, 4, 6, 7]


def test_orphans_repeats_nulls_and_empty_tables(spark):
    row = (1, 1, "a", ts(4), "")
    assert lost(spark, [row, (2, *row[1:]), (None, 1, "a", None, "")], []) == [1, 2, None]
    assert lost(spark, [], [(1, "a", ts(1), None, "")]) == []
    assert lost(spark, [(3, 1, "x" * 100_000, ts(2), "")], [(1, "x" * 100_000, ts(1), None, ""), (1, "b", None, None, "")]) == []


def test_orphan_report_counts(spark):
    r, p = refs(spark, [(1, 1, "a", ts(4), ""), (2, 1, "b", ts(4), "")]), lives(spark, [(1, "a", ts(1), None, "")])
    assert [tuple(x) for x in orphans.orphan_report(r, orphans.orphan_rows(r, p)).collect()] == [("t", "2025-01", 2, 1, 0.5)]


def test_orphans_split_a_hot_key(spark, tmp_path):
    """A third of all references name one method: adaptive execution splits its partition of the anti-join."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "24",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        i = F.col("id")
        name = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("p.C"), i % 20_000))
        at = F.timestamp_seconds(F.lit(1_735_689_600) + i)
        rows = spark.range(300_000, numPartitions=6).select("id", F.lit(1).cast("long").alias("repo_id"), name.alias("method"), at.alias("imported_at"))
        born = F.timestamp_seconds(F.lit(1_735_689_600) + F.when(i == 0, 150_000).otherwise(0))
        parents = spark.range(20_000).select(F.lit(1).cast("long").alias("repo_id"), F.when(i == 0, "hot").otherwise(F.concat(F.lit("p.C"), i)).alias("method"), born.alias("born"), F.lit(None).cast("timestamp").alias("died"))
        r = orphans.references(rows, "t", ["repo_id", "method"], "imported_at")
        p = orphans.lifetimes(parents, ["repo_id", "method"], "born", "died")
        n = orphans.orphan_rows(r, p).agg(F.count("*"))
        lost_hot, lost_zero = 50_000, sum(1 for x in range(0, 300_000, 20_000) if x % 3)
        assert n.collect()[0][0] == lost_hot + lost_zero
        assert "LeftAnti" in (plan := n._jdf.queryExecution().executedPlan().toString()) and "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_orphans_read_only_what_they_need(spark, data):
    plan = problems.p1_found(spark, data)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and not any("field_class" in r or "annotations" in r for r in read)


def test_periods_are_in_utc(spark):
    at = datetime(2025, 1, 31, 23, 30)  # in the session's zone, UTC
    df = spark.createDataFrame([(at,), (None,), (datetime(1969, 12, 31, 23),)], "at timestamp")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert {r.p for r in df.select(orphans.period(F.col("at")).alias("p")).collect()} == {"2025-01", None, "1969-12"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# --- packed fields -----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "blanks", "items"),
    [
        ("", True, []), ("  \t", True, []), ("[]", True, []), ('""', True, []), (",;|", True, []), ("a", True, ["a"]),
        ("a,b", True, ["a", "b"]), ("a; b | c", True, ["a", "b", "c"]), ("int a, long b", False, ["int a", "long b"]),
        ("int a\r\n  long b,", False, ["int a", "long b"]), ("{x, y}", True, ["x", "y"]), ("(a)", True, ["a"]), ("(a),(b)", True, ["(a)", "(b)"]),
        ("Map<K, List<V[]>> m,int n", False, ["Map<K, List<V[]>> m", "int n"]),
        ('["@X(v=\\"p|q\\", n=1)", "y"]', True, ['@X(v="p|q", n=1)', "y"]), ('"@X(v=""p|q"", n=1)", y', True, ['@X(v="p|q", n=1)', "y"]),
        ("`a;b`\n 'c d'", True, ["a;b", "c d"]), ("a，b、c；d", True, ["a", "b", "c", "d"]), ("o'brien, x", True, ["o'brien", "x"]),
        ("{a, b", True, ["{a", "b"]), ("a), b", True, ["a)", "b"]), ('say "hi, b', False, ['say "hi', "b"]),
    ],
)
def test_split_one_field(spark, text, blanks, items):
    df = spark.createDataFrame([(7, text, "clash")], "id long, f string, item string")
    got = packed.split_packed([(df, "t", "id", "f", blanks)]).orderBy("pos").collect()
    assert [r.item for r in got] == items
    assert [r.pos for r in got] == list(range(1, len(items) + 1))


def test_split_nulls_repeats_empty_and_long(spark):
    long = ",".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, None), (2, "a,b"), (2, "a,b"), (None, "a,b"), (3, long)], "id long, f string")
    got = packed.split_packed([(df, "t", "id", "f", True)])
    assert got.groupBy("row_id").count().orderBy("row_id").collect() == [(None, 2), (2, 4), (3, 20_000)]
    assert packed.split_packed([(df.limit(0), "t", "id", "f", True)]).count() == 0


def test_split_whole_tables_as_brute_force(spark, data):
    want = set()
    for name, col, blanks in (("chunks", "annotations", True), ("chunks", "parameters", False), ("api_endpoints", "table_names", True)):
        for r in table(spark, data, name).select("id", col).where(f"{col} is not null").collect():
            want |= {(name, col, r.id, i, x) for i, x in enumerate(brute.split_field(r[1], blanks), 1)}
    got = {tuple(r) for r in problems.p2_found(spark, data).select("table_name", "column_name", "row_id", "pos", "item").collect()}
    assert got == want


def test_code_lengths_alone_decide(spark):
    """The same text is divided at its commas in one column and not in another, by what recurs there."""
    rnd = random.Random(5)
    last = [a + b for a in ("Smith", "Doe", "Kral", "Novak", "Ito") for b in ("", "son", "ez", "ova")]
    people = [f"{x}, {y}" for x in last for y in rnd.sample(["John", "Jane", "Ann", "Bo", "Cyd", "Dee", "Eve", "Finn"], 2)]
    names = ["; ".join(rnd.sample(people, rnd.randint(1, 4))) for _ in range(400)]
    words = [*last, "John", "Jane", "Ann", "Bo"]
    lists = [rnd.choice([", ", "; "]).join(rnd.sample(words, rnd.randint(1, 5))) for _ in range(400)]
    same = "; ".join(people[:2])
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*zip(names, lists), (same, same)])], "id long, names string, words string")
    got = {}
    for r in packed.split_packed([(df, "t", "id", c, True) for c in ("names", "words")]).orderBy("row_id", "pos").collect():
        got.setdefault((r.column_name, r.row_id), []).append(r.item)
    assert all(got["names", i] == x.split("; ") for i, x in enumerate([*names, same]))
    assert all(got["words", i] == re.split("[,;] ", x) for i, x in enumerate([*lists, same]))


def test_every_set_of_classes_is_tried():
    """Six classes of delimiters: all 64 sets, made at once or twice, the same parses; texts as long as wished."""
    text = "a, b; c|d\te\nf、g"
    found = list(packed.parses(text, False))
    assert found[0][2] == ["a", "b", "c", "d", "e", "f", "g"] and found[0][-1] == len(found) == 64
    assert ["a, b", "c|d\te\nf、g"] in [p[2] for p in found]
    at_once, packed._AT_ONCE = packed._AT_ONCE, 9
    try:
        assert sorted(map(str, packed.parses(text, False))) == sorted(map(str, found))
    finally:
        packed._AT_ONCE = at_once


def test_parses_are_weighed_by_sets_of_classes(spark):
    """The cheapest parse is that of the least sum over all classes; sets of classes are looked up, and values and parses meet in one shuffle."""
    rnd, classes = random.Random(3), range(len(packed.CLASSES))
    bits = {(i, c, how): 9 * rnd.random() for i in range(2) for c in classes for how in packed.PRIOR}
    free, loose, rows = [1.5, 2.0], [3.0, 1.0], []
    for n in range(200):
        div = [rnd.getrandbits(len(classes)) for _ in range(4)]
        rows.append((n % 2, [(i, d, rnd.getrandbits(len(classes)) & ~d, 20 * rnd.random(), float(rnd.randint(0, 3)), rnd.randint(0, 2)) for i, d in enumerate(div)]))
    weighed = spark.createDataFrame(rows, "field int, parses array<struct<parse int, div int, text int, bits double, free double, loose int>>")
    won = weighed.select("field", "parses", packed._winner(bits, free, loose, 2).alias("w"))
    for r in won.collect():
        own = {how: [bits[r.field, c, how] for c in classes] for how in packed.PRIOR}
        cost = {p.parse: p.bits + p.free * free[r.field] + p.loose * loose[r.field] + sum(own[how][c] for how in own for c in classes if p[how] >> c & 1) for p in r.parses}
        assert r.w.parse == min(cost, key=cost.get) and r.w.bits == pytest.approx(min(cost.values()), abs=1e-5)
    assert "getbit" not in won._jdf.queryExecution().optimizedPlan().toString()
    plan = packed.weights(spark.createDataFrame([], packed._PARSED), {}, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k1") == 1, plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab.( )<>\"'x", min_size=0, max_size=8), max_size=6), st.sampled_from([",", ";", " | ", "\n"]))
def test_first_parse_keeps_quoted_values(values, between):
    """Values written between quotes come back whatever they hold."""
    values = [v.strip() for v in values if v.strip()]
    text = between.join('"' + v.replace('"', '""') + '"' for v in values)
    best = min(packed.parses(text, True), key=lambda p: p[0])
    assert [v for v in best[2]] == values


# --- heavy keys --------------------------------------------------------------------------

USE = "id long, k string, n long, at timestamp, who string, key_value string"


def usage(spark, n=4000, hot=0.4):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        k = "hot" if rnd.random() < hot else rnd.choice(["a", "b", "c", None, "d" * 40])
        at = datetime(2025, 1, 1 + rnd.randrange(20), rnd.randrange(24), rnd.randrange(60)) if rnd.random() > 0.02 else None
        rows.append((i if rnd.random() > 0.01 else None, k, rnd.randrange(3), at, rnd.choice(["x", None]), "clash"))
    return spark.createDataFrame(rows, USE).repartition(5)


def expected(df, key):
    rows, out = df.collect(), {}
    for r in rows:
        out.setdefault(None if r[key] is None else str(r[key]), []).append(r)
    want = {}
    for k, g in out.items():
        times = sorted(r.at for r in g if r.at)
        gaps = [int((b - a).total_seconds() * 1e6) for a, b in zip(times, times[1:])]
        want[k] = (len(g), sum(r.who is not None for r in g), times[0] if times else None, times[-1] if times else None, max([0, *gaps]))
    return want


@pytest.mark.parametrize("partitions", [1, 7])
def test_per_key_as_brute_force_and_spread(spark, partitions):
    df = usage(spark).cache()
    got = skew.per_key(df, ["k", "n"], "at", "id", "who", partitions=partitions).collect()
    for key in ("k", "n"):
        have = {r.key_value: (r.n_rows, r.n_marked, r.first_at, r.last_at, r.max_gap_us) for r in got if r.key_column == key}
        assert have == expected(df, key)
    hot = next(r for r in got if r.key_value == "hot")
    assert hot.n_pieces > 1 or partitions == 1
    assert {r.key_value for r in skew.heavy_keys(skew.per_key(df, ["k"], "at", "id"), 0.3).collect()} == {"hot"}


def test_per_key_empty(spark):
    assert skew.per_key(spark.createDataFrame([], USE), ["k"], "at", "id").count() == 0


def test_hot_key_partitions_are_even(spark):
    states = skew.boundary_states(usage(spark, 20_000, 0.9), ["k"], "at", "id", partitions=8)
    sizes = [r.n for r in states.groupBy(F.spark_partition_id()).agg(F.sum("n_rows").alias("n")).collect()]
    assert max(sizes) < 2.5 * 20_000 / 8


# --- nested bodies -----------------------------------------------------------------------

BODIES = [
    None, "", " ", "null", "3", '"x"', "[]", "{}", "[1, 2]", '[{"a": 1}]', '{"a": [{"b": [{"c": 1}, 2, {}]}, [{"d": 1}]]}',
    '{"a": "[{\\"b\\": {\\"c\\": [{}]}}]"}', '"[{\\"a\\": 1}]"', '"{\\"a\\": [{}]}"', '{"a.b": [{"": 1}], "c[0]": [{}]}', '{"a": [{"b": 1}]',
    '[{"a": 1}] x', '[{"a": 1}]] x', '{"a": [{}]}} x', "<html>[{}]</html>", "[hold] wait", '{"a": "lot [3] of 4", "b": "[3]"}', '{"a": "x", "b": [null, {"c": null}]}',
    '{"a": "[{\\"b\\": \\"[{}]\\"}]"}', "[" * 40 + "{}" + "]" * 40, '{"u": "\\u005b{}\\u005d"}', '[{"a": 1e400}, {"b": 12345678901234567890123}]',
    json.dumps({"t": "y" * 200_000, "l": [{"i": i} for i in range(3000)]}),
]


def test_nested_as_brute_force(spark):
    rows = [(i, b, b, "clash") for i, b in enumerate(BODIES)] + [(3, BODIES[10], None, "")]
    df = spark.createDataFrame(rows, "id long, q string, p string, path string")
    got = nested.flatten_bodies(df, ["id"], {"request": "q", "response": "p"}).collect()
    want = sorted((i, side, *x) for i, q, p, _ in rows for side, b in (("request", q), ("response", p)) for x in brute.list_objects(b))
    assert sorted((r.id, r.side, r.path, r.owner_path) for r in got) == want


def test_fields_of_nested_objects(spark):
    body = '{"a": 1, "n": null, "o": {"b": "x", "l": [{"c": true, "p": {"d": 1.5}}, 7]}, "t": "[{\\"e\\": 2}]", "u": "[no"}'
    df = spark.createDataFrame([(1, body), (2, None), (3, "{"), (4, "[]")], "id long, q string")
    got = {(r.id, r.object_path, r.owner_path, r.name, r.value) for r in nested.flatten_fields(df, ["id"], {"request": "q"}).collect()}
    assert got == {
        (1, "$", "$", "a", "1"), (1, "$", "$", "n", None), (1, "$", "$", "u", "[no"), (1, "$.o", "$", "b", "x"), (1, "$.o.l[0]", "$.o.l[0]", "c", "true"),
        (1, "$.o.l[0].p", "$.o.l[0]", "d", "1.5"), (1, "$.t[0]", "$.t[0]", "e", "2"),
    }


def test_nested_whole_table_as_brute_force(spark, data):
    want = set()
    for r in problems._bodies(spark, data).collect():
        for side, body in (("request", r.request_body), ("response", r.response_body)):
            want |= {(r.session_id, r.seq, side, *x) for x in brute.list_objects(body)}
    assert {tuple(r) for r in problems.p5_found(spark, data).collect()} == want and want


def _deep(n: int) -> str:
    """Lists of objects nested ``n`` deep."""
    return '[{"a": ' * n + "1" + "}]" * n


def test_bodies_the_parser_refuses(spark):
    repeated = '{"a": [{"x": 1}], "a": [{"x": 2}, {"y": 3, "y": [{}]}]}'
    inside = json.dumps({"t": repeated, "l": [{"d": _deep(600)}]})
    rows = [(1, _deep(600)), (2, repeated), (3, inside), (4, _deep(600)[:-1]), (5, '{"a": [{}], "a": '), (6, json.dumps(repeated)), (7, "[{}] " + "1" * 1200),
            (8, '[{"n": ' + "1" * 1200 + "}]"), (9, '[{"' + "k" * 60_000 + '": {}}]'), (10, "[{}]")]
    df = spark.createDataFrame([(i, b, "x") for i, b in rows], "id long, q string, __b0 string")
    got = {}
    for r in nested.flatten_bodies(df, ["id"], {"request": "q"}).collect():
        got.setdefault(r.id, []).append((r.path, r.owner_path, r.n_members))
    assert {i: len(v) for i, v in got.items()} == {1: 600, 2: 4, 3: 4 + 1 + 600, 6: 4, 8: 1, 9: 1, 10: 1}
    assert sorted(got[2]) == [("$.a[0]", "$", 1), ("$.a[0]", "$", 1), ("$.a[1]", "$", 2), ("$.a[1].y[0]", "$.a[1]", 0)]
    assert ("$[0]" + ".a[0]" * 599, "$[0]" + ".a[0]" * 598, 1) in got[1]
    assert ("$.l[0].d[0].a[0]", "$.l[0].d[0]", 1) in got[3] and ("$.t.a[1].y[0]", "$.t.a[1]", 0) in got[3]
    fields = nested.flatten_fields(df, ["id"], {"request": "q"}).where("id = 2").collect()
    assert sorted((r.object_path, r.owner_path, r.name, r.value) for r in fields) == [
        ("$.a[0]", "$.a[0]", "x", "1"), ("$.a[0]", "$.a[0]", "x", "2"), ("$.a[1]", "$.a[1]", "y", "3"),
    ]


def test_leaf_values(spark):
    body = '{"a": 1, "l": [1, "x", null, [true], {"b": "c"}], "t": "[7]"}'
    twice = '{"a": 1, "a": {"b": [2]}}'
    df = spark.createDataFrame([(1, body), (2, twice), (3, None), (4, "[")], "id long, q string")
    got = {}
    for r in nested.leaf_values(df, ["id"], "q").collect():
        got.setdefault(r.id, set()).add((r.path, r.value))
    assert got == {
        1: {("$.a", "1"), ("$.l[0]", "1"), ("$.l[1]", "x"), ("$.l[2]", None), ("$.l[3][0]", "true"), ("$.l[4].b", "c"), ("$.t[0]", "7")},
        2: {("$.a", "1"), ("$.a.b[0]", "2")},
    }


def test_exact_reader_as_the_library():
    good = ["0", "-1.5e+3", '"a\\u00e9\\n"', "[]", "{}", ' {"a" : [1, "b", null, {"c": {}}], "": true} ', '["\\ud800"]', "[[[[]]]]"]
    bad = ["", " ", "01", "1.", "-", "+1", '"\t"', '"\\x"', "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "{,}", "{1:2}", "]", "[}", "{]", "[1] 2", "nul", "NaN", "[", '{"a":1', "'a'", ":", '{"a"::1}']

    def plain(v):
        if isinstance(v, json_text.Members):
            return {k: plain(x) for k, x in v}
        return [plain(x) for x in v] if isinstance(v, list) else json.loads(v) if isinstance(v, json_text.Plain) else v

    for t in good:
        assert plain(json_text.parse(t)) == json.loads(t), t
    for t in bad:
        with pytest.raises(ValueError):
            json_text.parse(t)
    for b in BODIES:
        assert sorted(x[:2] for x in json_text.list_objects(b or "")) == sorted(brute.list_objects(b)), b


def test_nested_empty(spark):
    df = spark.createDataFrame([], "id long, q string")
    assert nested.flatten_bodies(df, ["id"], {"request": "q"}).count() == 0
