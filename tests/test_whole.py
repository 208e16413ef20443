"""Queries that must answer the whole question, not its first rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thicket.engine import Engine
from thicket.operators import graph, search


def test_best_without_k_keeps_every_hit_in_order(spark):
    df = spark.range(100).withColumn("text", F.when(F.col("id") % 2 == 0, "order list").otherwise("order"))
    got = [r.id for r in search.best(df, search.keyword_score(["order", "list"], [(F.col("text"), 1, 1)]), None, "id").collect()]
    assert got == [*range(0, 100, 2), *range(1, 100, 2)]


@pytest.mark.parametrize("name", ["R01_endpoint_search", "O05_routes_first"])
def test_every_row_is_in_the_result(spark, tmp_path, name):
    rows = [(i, f"/order/{i}", f"a.C{i:03}", f"a.C{i:03}:run()") for i in range(100)]
    spark.createDataFrame(rows, "id long, url_path string, class_name string, full_method string").write.parquet(str(tmp_path / "api_endpoints.parquet"))
    every = [r[0] for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert every == [r[0 if name.startswith("R01") else 2] for r in rows]


def test_text_budget_of_the_reference(spark, tmp_path):
    def by_hand(names):
        text = ""
        for n in sorted(set(names)):
            if len(text) + len(n) > 800:
                break
            text += " " * bool(text) + n
        return text

    # a: under 800; b: over it; c: the last name just fits; d: one name alone is too long
    groups = {"a": [f"method{i:02}" for i in range(30)], "b": [f"method{i:04}" for i in range(200)], "c": ["a" * 400, "b" * 399, "c"], "d": ["x" * 801]}
    rows = [(1, c, n) for c, names in groups.items() for n in names * 2]
    spark.createDataFrame(rows, "repo_id long, class_name string, method_name string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.class_name: r.summary for r in entry.queries()["A18_W07_text_budget"](spark, str(tmp_path)).collect()}
    assert got == {c: by_hand(names) for c, names in groups.items()}
    assert len(got["a"]) > 80 and len(got["c"]) == 800


@pytest.mark.parametrize("per", [None, "label"])
def test_batched_search_equals_single_searches(spark, monkeypatch, per):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "ROW_BLOCK", 20)
    # repeated vectors give ties; null, zero and short vectors and a null label are there too
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3 if i % 10 else None) for i in range(100)] + [(100, [0.0, 0.0, 0.0], 1), (101, None, 1), (102, [1.0, 2.0], 1)]
    v = spark.createDataFrame(rows, "id long, e array<float>, label int")
    q = v.where("id % 10 = 0 and id < 100").select(F.col("id").alias("query"), F.col("e").alias("qv"))
    cols = ["id", "similarity", *([per] if per else [])]
    want = {(i, *r) for i, e, _ in rows[:100:10] for r in search.nearest(v, "e", e, 4, "id", per).select(*cols).collect()}
    got = {tuple(r) for r in search.nearest_batch(v, "e", q, "query", "qv", 4, "id", per).select("query", *cols).collect()}
    assert got == want and len({r[0] for r in got}) == 10


def test_shared_callees_do_not_use_up_the_tree(spark):
    """A root, 20 services that all call the same 20 repositories, each with 20 leaves of its own: 441 nodes, 820 edges."""
    s, r = [f"p.S{i:02}:run(int)" for i in range(20)], [f"p.R{i:02}:run(int)" for i in range(20)]
    pairs = [("p.A:run(int)", x) for x in s] + [(x, y) for x in s for y in r] + [(y, f"{y[:5]}L{i:02}:run(int)") for y in r for i in range(20)]
    e = spark.createDataFrame([(1, a, b, "VIR", True, 1, i) for i, (a, b) in enumerate(pairs)], "repo_id long, caller string, callee string, call_type string, enabled boolean, line_number int, call_id int")
    m = spark.createDataFrame([], "repo_id long, full_method string, class_name string")
    eng = Engine(spark, e, m, m, m, m)
    whole = eng.call_tree_rows("p.A:run(int)", cap=500)
    assert len(whole) == len({x["node"] for x in whole}) == 441 and not any(x["lazy"] for x in whole)
    outline = eng.chain_outline("p.A:run(int)", 300)
    assert [x["node"] for x in outline[:30]] == [x["node"] for x in whole[:30]]
    assert len(outline) == 300 and outline[-1]["truncated"]
    assert not any(x["truncated"] for x in eng.chain_outline("p.A:run(int)", 441))
    few = {x["node"]: x for x in eng.call_tree_rows("p.A:run(int)", cap=50)}
    assert set(r) <= set(few) and all(few[x]["lazy"] for x in r) and not few[s[0]]["cut"]


@pytest.mark.parametrize(("pairs", "want"), [("ab bc cd de ea ax", (True, 5)), ("ab bc cb ad", (False, None)), ("aa ab", (True, 1)), ("", (False, None))])
def test_cycle(spark, pairs, want):
    steps = spark.createDataFrame([(p[0], p[1]) for p in pairs.split()], "src string, dst string")
    assert [tuple(r)[1:] for r in graph.cycle(steps, "a").collect()] == [want]
