"""Class files: a library that comes with Spark, and archives made here."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import pyspark
import pytest

from thicket.operators import graph
from thicket.sources import archives, relations

JARS = Path(pyspark.__file__).parent / "jars"


@pytest.fixture(scope="module")
def small():
    found = sorted(JARS.glob("minlog-*.jar"))
    if not found:
        pytest.skip("no library at hand")
    return found[0]


def test_types():
    assert archives.type_names("I[[JLa/b/C;[Ljava/lang/String;") == ["int", "long[][]", "a.b.C", "java.lang.String[]"]
    assert archives.signature("p.C", "f", "(I[B)V") == "p.C:f(int,byte[])"


def test_relations_of_a_library(spark, small):
    facts = archives.read_classes(archives.read_entries(spark, str(small))).cache()
    log = "com.esotericsoftware.minlog.Log"
    assert {r.class_name for r in facts.where("relation = 'class_info'").collect()} == {log, f"{log}$Logger"}
    calls = {(r.name, r.target, r.call_type) for r in facts.where("relation = 'method_call'").collect()}
    assert (f"{log}:error(java.lang.String)", f"{log}$Logger:log(int,java.lang.String,java.lang.String,java.lang.Throwable)", "VIR") in calls
    assert any(t == "SPE" and c == "java.lang.Object:<init>()" for _, c, t in calls)
    assert any(t == "STA" for *_, t in calls)
    edges = archives.call_edges(facts)
    start = spark.createDataFrame([(f"{log}:error(java.lang.String)",)], "node string")
    assert graph.reach(graph.arrows(edges), start, 2).count() > 5


def test_all_instructions_of_a_larger_library(spark):
    found = sorted(JARS.glob("commons-lang3-*.jar"))
    if not found:
        pytest.skip("no library at hand")
    entries = archives.read_entries(spark, str(found[0]))
    n = entries.where("entry like '%.class'").count()
    facts = archives.read_classes(entries).cache()
    assert facts.where("relation = 'class_info'").count() == n > 100
    kinds = {r.call_type for r in facts.where("relation = 'method_call'").select("call_type").distinct().collect()}
    assert {"VIR", "SPE", "STA", "INT", "_LM", "_BSM"} <= kinds


def test_nested_archives_versions_and_rubbish(spark, tmp_path, small):
    cls = zipfile.ZipFile(small).read("com/esotericsoftware/minlog/Log.class")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("A.class", cls)
        z.writestr("META-INF/versions/11/A.class", cls)
        z.writestr("B.class", b"no class")
    with zipfile.ZipFile(tmp_path / "app.war", "w") as z:
        z.writestr("WEB-INF/lib/in.jar", inner.getvalue())
        z.writestr("x.properties", "a=b")
    (tmp_path / "note.txt").write_text("no archive")
    entries = archives.read_entries(spark, str(tmp_path)).cache()
    got = {(r.archive, r.entry, r.version) for r in entries.collect()}
    assert got == {("app.war", "x.properties", None), ("app.war!WEB-INF/lib/in.jar", "A.class", None), ("app.war!WEB-INF/lib/in.jar", "A.class", 11), ("app.war!WEB-INF/lib/in.jar", "B.class", None)}
    picked = relations.select_release(entries.withColumnRenamed("entry", "class_path"), 17).where("class_path = 'A.class'").collect()
    assert [r.version for r in picked] == [11]
    assert archives.read_classes(entries).where("relation = 'class_info'").count() == 2
