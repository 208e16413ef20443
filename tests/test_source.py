"""Source lines and diffs on texts written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thicket.operators import source

JAVA = """package a.b;
import java.util.List;
import static a.c.Util.max;
import a.d.*;
/**
 * Keeps orders.
 * @author x
 */
class A {
  void one() {
    if (x) { y(); }
  }
  void two()
  {
  }
  String u = "http://h/x" + "${base.url:z}" + getProperty("p.q");
}"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, "A.java", JAVA), (2, "E.java", ""), (3, "N.java", None)], "repo_id long, file_path string, text string").cache()


def test_lines_snippets_and_extents(spark, files):
    lines = source.lines_of(files).cache()
    assert lines.where("repo_id = 1").count() == len(JAVA.split("\n"))
    at = spark.createDataFrame([(1, "A.java", 10), (1, "A.java", 13), (1, "A.java", 1), (1, "A.java", 17)], "repo_id long, file_path string, line int")
    assert {r.line: r.end_line for r in source.extents(lines, at).collect()} == {10: 12, 13: 15, 1: 17, 17: None}
    s = source.snippets(lines, at.where("line = 1"), 1).first().snippet
    assert s == "> 1: package a.b;\n  2: import java.util.List;"


def test_imports(spark, files):
    classes = spark.createDataFrame([(1, "a.d.X"), (1, "a.d.Y$Z"), (1, "a.d.e.W"), (2, "a.d.Q")], "repo_id long, class_name string")
    got = {r.target_class for r in source.import_edges(source.lines_of(files), classes).collect()}
    assert got == {"java.util.List", "a.c.Util.max", "a.d.X"}


def test_addresses_comments_and_json(spark, files):
    r = files.where("repo_id = 1").select(source.addresses(F.col("text")).alias("a"), source.comments(F.col("text")).alias("c")).first()
    assert r.a == "http://h/x | base.url:z | p.q" and r.c == ["Keeps orders."]
    df = spark.createDataFrame([('x {a} {"k": {"v": 123}} y',), ("none",), (None,), ("{" * 3,)], "t string")
    assert [x.j for x in df.select(source.embedded_json(F.col("t")).alias("j")).collect()] == ['{"k": {"v": 123}}', None, None, None]


def test_diffs(spark):
    text = ["--- a", "+++ b", "-k.a=1", "+k.a=2", "+k.b: x", "-k.c=3", " same", "+<artifactId>lib</artifactId>", "+ <scope>x</scope>", "+ <version>1.2</version>", "+<artifactId>far</artifactId>", "+1", "+2", "+3", "+4", "+<version>9</version>"]
    d = spark.createDataFrame([(1, "f", i, t) for i, t in enumerate(text)], "repo_id long, file_path string, line_no int, text string")
    assert tuple(source.diff_stats(d).first())[2:] == (11, 2)
    assert {(r.key, r.change, r.old, r.new) for r in source.diff_config(d).collect()} == {("k.a", "modified", "1", "2"), ("k.b", "added", None, "x"), ("k.c", "removed", "3", None)}
    assert [(r.artifact, r.version) for r in source.diff_artifacts(d).collect()] == [("lib", "1.2")]


def test_descriptors(spark):
    pom = "<project><properties><v.x>2.0</v.x></properties><dependencies><dependency><groupId>g</groupId> <artifactId>a</artifactId><version>${v.x}</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId></dependency></dependencies></project>"
    df = spark.createDataFrame([(1, "pom.xml", pom)], "repo_id long, file_path string, text string")
    assert {(r.artifact_id, r.version) for r in source.dependencies(df).collect()} == {("a", "2.0"), ("b", None)}
    xml = '<mapper namespace="a.M"><select id="one" resultType="x">\n select 1\n from t </select><update id="two">u</update></mapper>'
    df = spark.createDataFrame([(1, "m.xml", xml)], "repo_id long, file_path string, text string")
    assert {(r.namespace, r.statement_id, r.verb, r.sql) for r in source.mapper_sql(df).collect()} == {("a.M", "one", "select", "select 1 from t"), ("a.M", "two", "update", "u")}


def test_changed_files(spark):
    s = "repo_id long, file_path string, hash string"
    old, new = spark.createDataFrame([(1, "a", "1"), (1, "b", "1"), (1, "c", "1")], s), spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "d", "1")], s)
    assert {(r.file_path, r.change) for r in source.changed_files(old, new).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
