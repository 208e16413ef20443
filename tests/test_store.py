"""Changes of stored tables: nulls, repeats, empty sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket.operators import store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (None, "z", 1), (3, None, 1)], "k int, v string, at int")
    assert rows(store.upsert(old, new, ["k"], "at")) == sorted([(1, "a", 1), (2, "y", 3), (None, "z", 1), (3, None, 1)], key=str)
    assert rows(store.upsert(old, new.limit(0), ["k"])) == rows(old) and rows(store.upsert(old.limit(0), old, ["k"])) == rows(old)


def test_point_ids_are_fixed_and_shaped(spark):
    df = spark.createDataFrame([(1, "m"), (1, "m"), (1, None)], "r long, m string").select(store.point_id(F.col("r"), F.col("m")).alias("id"))
    a, b, c = (r.id for r in df.collect())
    assert a == b and c is None and [len(x) for x in a.split("-")] == [8, 4, 4, 4, 12]


def test_deletion_with_children(spark):
    kids = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, repo_id int")
    gone = spark.createDataFrame([(10,), (10,), (None,)], "id int")
    assert rows(store.without_parents(kids, "repo_id", gone, "id")) == [(2, 20), (3, None)]


def test_mark_and_truncate_and_find(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "é日本語x", "DONE"), (2, None, None)], "id int, t string, s string")
    assert rows(store.mark(df, spark.createDataFrame([(2,), (2,), (9,), (None,)], "id int"), "id", "s", "NEW")) == sorted([(1, "abc", None), (2, "é日本語x", "NEW"), (2, None, "NEW")], key=str)
    assert rows(store.truncated(df, {"t": 2}).select("t")) == sorted([("ab",), ("é日",), (None,)], key=str)
    assert store.find_by(df, id=[2], t=None).count() == 1 and store.find_by(df).count() == 3


def test_markdown(spark):
    df = spark.createDataFrame([("a|b\nc", None, 3)], "a string, b string, n int")
    assert df.select(store.markdown_row(F.col("a"), F.col("b"), F.col("n")).alias("m")).first().m == "| a\\|b c |  | 3 |"
