"""Questions to source lines (repo_id, file_path, line_no, text) and to unified diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

FILE = ["repo_id", "file_path"]


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """Numbered lines (from 1) of files (repo_id, file_path, ``text``)."""
    return files.where(F.col(text).isNotNull()).select(*FILE, F.posexplode(F.split(text, r"\r?\n")).alias("i", "t")).select(
        *FILE, (F.col("i") + 1).alias("line_no"), F.col("t").alias("text")
    )


def snippets(lines: DataFrame, hits: DataFrame, radius: int) -> DataFrame:
    """(repo_id, file_path, line, snippet): the lines within ``radius`` of each hit (repo_id, file_path, line), the hit itself marked."""
    near = lines.join(hits.select(*FILE, "line").distinct(), FILE).where(F.col("line_no").between(F.col("line") - radius, F.col("line") + radius))
    row = F.concat(F.when(F.col("line_no") == F.col("line"), "> ").otherwise("  "), F.col("line_no"), F.lit(": "), F.col("text"))
    parts = near.groupBy(*FILE, "line").agg(F.array_sort(F.collect_list(F.struct("line_no", row.alias("r")))).alias("p"))
    return parts.select(*FILE, "line", F.array_join("p.r", "\n").alias("snippet"))


def extents(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, end_line): where the block that opens at or after each start line closes; null if it doesn't."""
    opened = F.length("text") - F.length(F.translate("text", "{", ""))
    closed = F.length("text") - F.length(F.translate("text", "}", ""))
    upto = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.select(*FILE, "line_no", F.sum(opened).over(upto).alias("o"), F.sum(closed).over(upto).alias("c"))
    before = run.select(*FILE, (F.col("line_no") + 1).alias("line"), F.col("o").alias("o0"), F.col("c").alias("c0"))
    at = starts.select(*FILE, "line").distinct().join(before, [*FILE, "line"], "left").na.fill({"o0": 0, "c0": 0})
    end = run.join(at, FILE).where((F.col("line_no") >= F.col("line")) & (F.col("o") > F.col("o0")) & (F.col("o") - F.col("o0") <= F.col("c") - F.col("c0")))
    return at.select(*FILE, "line").join(end.groupBy(*FILE, "line").agg(F.min("line_no").alias("end_line")), [*FILE, "line"], "left")


def import_edges(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(repo_id, file_path, target_class) of import lines; wildcards mean all ``classes`` (repo_id, class_name) of the package."""
    name = F.regexp_extract("text", r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", 1)
    star = F.regexp_extract("text", r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", 2)
    found = lines.select(*FILE, name.alias("n"), star.alias("s")).where("n <> ''").distinct()
    one = found.where("s = ''").select(*FILE, F.col("n").alias("target_class"))
    known = classes.select("repo_id", F.col("class_name").alias("target_class"), F.regexp_extract("class_name", r"^(.*)\.", 1).alias("n")).where(~F.col("target_class").contains("$")).distinct()
    return one.unionByName(found.where("s <> ''").join(known, ["repo_id", "n"]).select(*FILE, "target_class")).distinct()


def addresses(text: Column, most: int | None = 3) -> Column:
    """The first ``most`` addresses (none: all) a source text names: literals, ``${key}`` placeholders and property look-ups, joined by `` | ``."""
    pattern = r'"(https?://[^"]+)"|\$\{([^}]+)\}|getProperty\s*\(\s*"([^"]+)"\s*\)'
    each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2, 3)]
    merged = F.zip_with(F.zip_with(each[0], each[1], lambda a, b: F.concat(a, b)), each[2], lambda a, b: F.concat(a, b))
    found = F.array_distinct(merged)
    return F.array_join(found if most is None else F.slice(found, 1, most), " | ")


def comments(text: Column) -> Column:
    """Documentation comments of a source text, stars and tags off, one line each."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)/\*\*(.*?)\*/"), F.lit(1))
    flat = F.transform(raw, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?m)^\s*\*\s?@.*$", ""), r"(?m)^\s*\*", " "), r"\s+", " ")))
    return F.filter(flat, lambda c: c != "")


def embedded_json(text: Column, least: int = 10) -> Column:
    """The first block between matching braces of more than ``least`` characters; null if there is none."""

    @F.pandas_udf("string")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _block(t, least) if isinstance(t, str) else None)

    return first(text)


def _block(text: str, least: int) -> str | None:
    depth = start = 0
    for i, c in enumerate(text):
        if c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth and i + 1 - start > least:
                return text[start : i + 1]
    return None


def diff_stats(diff: DataFrame) -> DataFrame:
    """Lines added and removed per (repo_id, file_path) of unified diffs."""
    plus = F.col("text").startswith("+") & ~F.col("text").startswith("+++")
    minus = F.col("text").startswith("-") & ~F.col("text").startswith("---")
    return diff.groupBy(*FILE).agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("removed"))


def diff_config(diff: DataFrame) -> DataFrame:
    """Keys added, removed or modified in diffs of key-value files: (repo_id, file_path, key, change, old, new)."""
    kv = diff.select(*FILE, F.substring("text", 1, 1).alias("sign"), F.regexp_extract("text", r"^[+-]\s*([\w.\-]+)\s*[=:]\s*(.*)$", 1).alias("key"), F.trim(F.regexp_extract("text", r"^[+-]\s*([\w.\-]+)\s*[=:]\s*(.*)$", 2)).alias("v"))
    kv = kv.where("key <> ''")
    g = kv.groupBy(*FILE, "key").agg(F.max(F.when(F.col("sign") == "-", F.col("v"))).alias("old"), F.max(F.when(F.col("sign") == "+", F.col("v"))).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return g.where(~F.col("old").eqNullSafe(F.col("new"))).select(*FILE, "key", change.alias("change"), "old", "new")


def diff_artifacts(diff: DataFrame, ahead: int = 4) -> DataFrame:
    """(repo_id, file_path, line_no, artifact, version): added artifacts with the version in the next ``ahead`` lines."""
    w = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(1, ahead)
    version = F.nullif(F.regexp_extract("text", r"^\+\s*<version>([^<]+)</version>", 1), F.lit(""))
    artifact = F.regexp_extract("text", r"^[+ ]?\s*<artifactId>([^<]+)</artifactId>", 1)
    rows = diff.select(*FILE, "line_no", artifact.alias("artifact"), F.first(version, ignorenulls=True).over(w).alias("version"))
    return rows.where("artifact <> '' and version is not null")


def dependencies(poms: DataFrame, text: str = "text") -> DataFrame:
    """(repo_id, file_path, group_id, artifact_id, version) of build descriptors, ``${property}`` versions resolved in the same file."""
    block = F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("b")
    tag = lambda t: F.nullif(F.regexp_extract("b", rf"<{t}>\s*([^<]*?)\s*</{t}>", 1), F.lit(""))
    deps = poms.select(*FILE, block).select(*FILE, tag("groupId").alias("group_id"), tag("artifactId").alias("artifact_id"), tag("version").alias("v"))
    deps = deps.withColumn("key", F.nullif(F.regexp_extract("v", r"^\$\{([^}]+)\}$", 1), F.lit("")))
    section = F.regexp_extract(text, r"(?s)<properties>(.*?)</properties>", 1)
    pattern = F.lit(r"<([\w.\-]+)>\s*([^<]*?)\s*</\1>")
    props = poms.select(*FILE, F.explode(F.arrays_zip(F.regexp_extract_all(section, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(section, pattern, F.lit(2)).alias("p"))).alias("x"))
    props = props.groupBy(*FILE, F.col("x.k").alias("key")).agg(F.max("x.p").alias("p"))
    return deps.join(props, [*FILE, "key"], "left").select(*FILE, "group_id", "artifact_id", F.coalesce("p", "v").alias("version"))


def mapper_sql(mappers: DataFrame, text: str = "text") -> DataFrame:
    """(repo_id, file_path, namespace, statement_id, verb, sql) of mapper files."""
    space = F.regexp_extract(text, r'<mapper\s+namespace="([^"]+)"', 1).alias("namespace")
    pattern = F.lit(r'(?s)<(select|insert|update|delete)\s+[^>]*?id="([^"]+)"[^>]*>(.*?)</\1>')
    parts = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(g)).alias(n) for g, n in ((1, "verb"), (2, "statement_id"), (3, "sql"))])
    rows = mappers.select(*FILE, space, F.explode(parts).alias("x")).select(*FILE, "namespace", "x.statement_id", "x.verb", F.col("x.sql").alias("q"))
    return rows.select(*FILE, "namespace", "statement_id", "verb", F.trim(F.regexp_replace("q", r"\s+", " ")).alias("sql"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, file_path, change) between two listings (repo_id, file_path, hash)."""
    a, b = old.select(*FILE, F.col("hash").alias("a")), new.select(*FILE, F.col("hash").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return a.join(b, FILE, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*FILE, change.alias("change"))
