"""Relations of classes compiled here: fields, annotations, arguments, generics, inner classes, guarded ranges; other files; damage."""

from __future__ import annotations

import shutil
import subprocess
import zipfile

import pytest

from thicket.sources import archives

SOURCE = """
package p;
import java.lang.annotation.*;
import java.util.*;
public class A<T extends Number> {
  @Retention(RetentionPolicy.CLASS) @interface Mark { String value() default ""; int[] n() default {}; Class<?> of() default Object.class; RetentionPolicy how() default RetentionPolicy.CLASS; boolean on() default false; }
  static class B { static int count; String name; }
  @Deprecated private List<String> all = new ArrayList<>();
  @Mark(value = "a b", n = {1, -2}, of = String.class, how = RetentionPolicy.SOURCE, on = true)
  public long add(long first, B b, T[] rest) {
    B.count++;
    b.name = "x";
    try { Integer.parseInt(b.name); System.out.println(all); }
    catch (NumberFormatException e) { throw new IllegalStateException(e); }
    finally { b.name.trim(); }
    switch ((int) first) { case 1: return 2; case 2: return 3; case 900: return 4; default: return first; }
  }
}
"""


@pytest.fixture(scope="module")
def jar(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    at = tmp_path_factory.mktemp("src")
    (at / "A.java").write_text(SOURCE)
    subprocess.run(["javac", "-g", "-d", str(at / "out"), str(at / "A.java")], check=True, timeout=120)
    (at / "one").mkdir()
    (at / "two").mkdir()
    for folder in ("one", "two"):
        with zipfile.ZipFile(at / folder / "app.jar", "w") as z:
            for f in sorted((at / "out").rglob("*.class")):
                z.write(f, str(f.relative_to(at / "out")))
            z.writestr("beans.xml", '<beans xmlns="http://x"><bean id="a" name="b, c" class="p.A"/><bean class="p.D"/><other class="x"/></beans>')
            z.writestr("broken.xml", "<beans>")
            z.writestr("p/Bad.class", b"\xca\xfe\xba\xbe\0\0")
    (at / "two" / "bad.jar").write_bytes((at / "two" / "app.jar").read_bytes()[:-200])
    return at


ADD = "p.A:add(long,p.A$B,java.lang.Number[])"


def test_relations(spark, jar):
    facts = archives.read_classes(archives.read_entries(spark, str(jar / "one"))).cache()
    of = lambda relation, *cols: sorted({tuple(r[c] for c in cols) for r in facts.where(f"relation = '{relation}'").collect()}, key=str)
    uses = of("field_use", "name", "target", "call_type", "value")
    assert (ADD, "p.A$B:count", "GET_STATIC", "int") in uses and (ADD, "p.A$B:count", "PUT_STATIC", "int") in uses and (ADD, "p.A$B:name", "PUT", "java.lang.String") in uses
    assert not any(x[1] == "p.A:all" for x in uses)
    assert of("method_annotation", "name", "target", "call_type", "value") == sorted(
        [(ADD, "p.A$Mark", k, v) for k, v in (("value", "a b"), ("n", "[1, -2]"), ("of", "java.lang.String"), ("how", "SOURCE"), ("on", "true"))], key=str
    )
    assert ("all", "java.lang.Deprecated", None, None) in of("field_annotation", "name", "target", "call_type", "value")
    args = [x for x in of("method_argument", "name", "seq", "target", "value") if x[0] == ADD]
    assert args == [(ADD, 1, "long", "first"), (ADD, 2, "p.A$B", "b"), (ADD, 3, "java.lang.Number[]", "rest")]
    assert ("p.A$B", "p.A") in of("inner_class", "name", "target")
    assert {(r.name or r.class_name): r.value for r in facts.where("relation = 'field_info' and name = 'all'").collect()} == {"all": "Ljava/util/List<Ljava/lang/String;>;"}
    catches = of("method_catch", "name", "target", "seq", "flags")
    calls = {r.seq: r.target for r in facts.where(f"relation = 'method_call' and name = '{ADD}'").collect()}
    first, last = next((a, b) for n, t, a, b in catches if n == ADD and t == "java.lang.NumberFormatException")
    assert calls[first] == "java.lang.Integer:parseInt(java.lang.String)" and calls[last] == "java.io.PrintStream:println(java.lang.Object)"
    assert any(n == ADD and t is None for n, t, _, _ in catches)  # the finally block


def test_formatter(spark, jar):
    facts = archives.read_classes(archives.read_entries(spark, str(jar / "one")), lambda cls, name, value: f"{name}<{value}>")
    assert "n<[1, -2]>" in {r.value for r in facts.where("relation = 'method_annotation'").collect()}


def test_paths_tell_archives_apart_and_duplicates(spark, jar):
    entries = archives.read_entries(spark, str(jar)).cache()
    assert entries.where("archive = 'app.jar'").select("path").distinct().count() == 2
    n = entries.where("archive = 'app.jar'").count() // 2
    assert archives.duplicates(entries.where("archive = 'app.jar'")).where("n = 2").count() == n


def test_other_files(spark, jar):
    entries = archives.read_entries(spark, str(jar / "one"))
    got = {(r.entry, r.key, r.value) for r in archives.read_others(entries, {".xml": archives.xml_beans}).collect()}
    assert got == {("beans.xml", "a", "p.A"), ("beans.xml", "b", "p.A"), ("beans.xml", "c", "p.A"), ("beans.xml", "p.D", "p.D")}


def test_damage_is_named(spark, jar):
    got = {(r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[-1], r.entry) for r in archives.archive_errors(spark, str(jar)).collect()}
    assert got == {("one/app.jar", "p/Bad.class"), ("two/app.jar", "p/Bad.class"), ("two/bad.jar", None)}
