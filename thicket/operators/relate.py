"""Relations between extracted facts: configuration, beans, start-up pairs, citations, release risks, extensions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from thicket.functions import sig
from thicket.operators import graph, joins
from thicket.operators.source import FILE


def config_values(annotated: DataFrame, uses: DataFrame, config: DataFrame) -> DataFrame:
    """(repo_id, full_method, config_key, config_value) of methods that use fields filled from configuration.

    ``annotated`` is (repo_id, class_name, field_name, attr_value with ``${key:default}``), ``uses`` (repo_id, full_method,
    field_name; the field is of the method's own class), ``config`` (repo_id, config_key, config_value). A key is also looked
    up with its dashes as dots; blank values count as missing, and the default fills in.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    a = annotated.select("repo_id", "class_name", "field_name", sig.placeholder_key(F.col("attr_value")).alias("config_key"), sig.placeholder_default(F.col("attr_value")).alias("default_value"))
    u = uses.select("repo_id", "full_method", sig.class_name(F.col("full_method")).alias("class_name"), "field_name").distinct()
    used = u.join(a.where("config_key is not null"), ["repo_id", "class_name", "field_name"]).withColumn("k2", F.translate("config_key", "-", "."))
    v = config.select("repo_id", "config_key", blank(F.col("config_value")).alias("v1"))
    found = used.join(v, ["repo_id", "config_key"], "left").join(v.select("repo_id", F.col("config_key").alias("k2"), F.col("v1").alias("v2")), ["repo_id", "k2"], "left")
    return found.select("repo_id", "full_method", "config_key", F.coalesce("v1", "v2", blank(F.col("default_value"))).alias("config_value"))


def spring_beans(class_annotations: DataFrame) -> DataFrame:
    """(bean_name, class_name) of classes annotated as components; without a name of its own the class's in lower camel case."""
    simple = sig.simple_class(F.col("annotation_class"))
    c = class_annotations.where(simple.isin("Component", "Service", "Repository", "Controller", "RestController", "Configuration"))
    own = sig.simple_class(F.col("class_name"))
    default = F.when(own.rlike("^[A-Z]{2}"), own).otherwise(F.concat(F.lower(F.left(own, F.lit(1))), F.substring(own, 2, 1 << 20)))
    return c.groupBy("class_name").agg(F.max(F.nullif(F.trim("bean_name"), F.lit(""))).alias("n")).select(F.coalesce("n", default).alias("bean_name"), "class_name")


def bean_types(fields: DataFrame, beans: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(class_name, field_name, bean_class) of injected fields (class_name, field_name, field_type, qualifier: null for none).

    A bean fits by its name where a qualifier is given, else by being the field's type or a subtype of it.
    """
    up = graph.ancestors(inheritance.select("child", "parent")).select(F.col("child").alias("bean_class"), F.col("ancestor").alias("field_type"))
    b = beans.select("bean_name", F.col("class_name").alias("bean_class"))
    fits = up.join(b.select("bean_class"), "bean_class", "left_semi").unionByName(b.select("bean_class", F.col("bean_class").alias("field_type"))).distinct()
    named = fields.where("qualifier is not null").join(b.withColumnRenamed("bean_name", "qualifier"), "qualifier")
    typed = fields.where("qualifier is null").join(fits, "field_type")
    keep = ["class_name", "field_name", "bean_class"]
    return named.select(*keep).unionByName(typed.select(*keep)).distinct()


#: Interfaces whose construction leads to a call later: (interface, method, first and second call type); fixed values.
STARTED = [
    ("java.lang.Runnable", "run()", "_RIR1", "_RIR2"),
    ("java.util.concurrent.Callable", "call()", "_CIC1", "_CIC2"),
    ("org.springframework.transaction.support.TransactionCallback", "doInTransaction(org.springframework.transaction.TransactionStatus)", "_TCID1", "_TCID2"),
]


def init_pairs(calls: DataFrame, inheritance: DataFrame) -> DataFrame:
    """Edges (caller, callee, call_type) for constructions of started classes: caller to constructor, and once per class constructor to its method."""
    up = graph.ancestors(inheritance.select("child", "parent"))
    kinds = F.create_map(*[x for i, m, a, b in STARTED for x in (F.lit(i), F.struct(F.lit(m).alias("m"), F.lit(a).alias("a"), F.lit(b).alias("b")))])
    started = up.where(F.col("ancestor").isin([s[0] for s in STARTED])).select(F.col("child").alias("cls"), F.element_at(kinds, F.col("ancestor")).alias("k"))
    made = calls.where(F.contains("callee", F.lit(":<init>("))).withColumn("cls", sig.class_name(F.col("callee"))).join(started, "cls")
    one = made.select("caller", "callee", F.col("k.a").alias("call_type"))
    two = made.groupBy("cls", "k").agg(F.min("callee").alias("caller")).select("caller", F.concat_ws(":", "cls", "k.m").alias("callee"), F.col("k.b").alias("call_type"))
    return one.unionByName(two).distinct()


def citations(lines: DataFrame, methods: DataFrame, constants: DataFrame) -> DataFrame:
    """(full_method, value, line_no): the first line of the method (repo_id, full_method, file_path, start_line, end_line) that holds the literal (repo_id, full_method, value)."""
    m = methods.select("repo_id", "full_method", "file_path", "start_line", "end_line").join(constants.select("repo_id", "full_method", "value").distinct(), ["repo_id", "full_method"])
    hit = lines.join(m, FILE).where(F.col("line_no").between(F.col("start_line"), F.col("end_line")) & F.contains("text", F.col("value")))
    return hit.groupBy("full_method", "value").agg(F.min("line_no").alias("line_no"))


def release_risks(changed: DataFrame, boundaries: DataFrame, most: int | None = 20) -> DataFrame:
    """Methods of other repositories whose boundary names a changed address or table.

    ``changed`` is (from_repo, what), ``boundaries`` (repo_id, full_method, boundary_type, context); HTTP and DB count. At most
    ``most`` per changed thing (none: all), in name order.
    """
    b = boundaries.where(F.col("boundary_type").isin("HTTP", "DB")).select("repo_id", "full_method", "boundary_type", "context").distinct()
    hit = joins.contains_join(b, "context", changed.select("from_repo", "what").distinct(), "what").where("repo_id <> from_repo")
    once = hit.select("from_repo", "what", "repo_id", "full_method", "boundary_type").distinct()
    if most is None:
        return once
    w = Window.partitionBy("from_repo", "what").orderBy("repo_id", "full_method", "boundary_type")
    return once.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def dto_fields(classes: DataFrame, text: str = "text") -> DataFrame:
    """(repo_id, file_path, field_name, field_type, required) of private fields; an annotation NotNull, NotBlank or NotEmpty before it requires one."""
    pattern = F.lit(r"((?:@\w+(?:\([^)]*\))?\s*)*)private\s+(?:final\s+)?([\w.<>\[\], ]+?)\s+(\w+)\s*(?:=[^;]*)?;")
    part = lambda g, n: F.regexp_extract_all(text, pattern, F.lit(g)).alias(n)
    rows = classes.select(*FILE, F.explode(F.arrays_zip(part(1, "a"), part(2, "field_type"), part(3, "field_name"))).alias("x"))
    return rows.select(*FILE, "x.field_name", "x.field_type", F.col("x.a").rlike("@(NotNull|NotBlank|NotEmpty)").alias("required"))


def extended(calls: DataFrame, extensions: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Call edges (caller, callee, call_type) with those that the extensions (call type, function of the edges) add."""
    out = calls.select("caller", "callee", "call_type")
    for kind, f in extensions:
        out = out.unionByName(f(calls).select("caller", "callee").withColumn("call_type", F.lit(kind)))
    return out


def mermaid(rows: Sequence[dict]) -> str:
    """A call tree's rows (node, parent) as flow-chart text."""
    names: dict[str, str] = {}
    out = ["flowchart TD"]
    for r in rows:
        if r["node"] not in names:
            names[r["node"]] = f"n{len(names)}"
            label = r["node"].replace('"', "'")
            out.append(f'  {names[r["node"]]}["{label}"]')
        if r.get("parent") in names:
            out.append(f"  {names[r['parent']]} --> {names[r['node']]}")
    return "\n".join(out)
