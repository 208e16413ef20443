"""Tab-separated relation files and repository-wise tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def read_relation(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], least: int | None = None) -> DataFrame:
    """A relation without header whose rows are divided by tabs, typed by ``columns`` (name, type).

    Rows with fewer than ``least`` columns (default: all) are dropped, missing ones beyond that are null, and
    values that don't fit their type become null. A missing file is an empty relation.
    """
    schema = StructType.fromDDL(", ".join(f"`{n}` {'string' if t == 'base64' else t}" for n, t in columns))
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], schema)
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p"))
    kept = parts.where(F.size("p") >= (len(columns) if least is None else least))
    return kept.select(*[typed(F.get("p", F.lit(i)), t).alias(n) for i, (n, t) in enumerate(columns)])


def typed(value: Column, kind: str) -> Column:
    """Text as ``kind``: flags are 1 or 0, numbers null where they are none, base64 texts decoded (kind ``base64``)."""
    if kind == "boolean":
        return value == "1"
    if kind == "base64":
        return F.decode(F.unbase64(value), "UTF-8")
    return value if kind == "string" else F.nullif(F.trim(value), F.lit("")).try_cast(kind)


def write_relation(df: DataFrame, path: str) -> None:
    """Write rows divided by tabs, without header or quotes; flags as 1 and 0, nulls empty, tabs and line ends as blanks."""
    flat = [
        F.when(F.col(n), "1").otherwise("0") if t == "boolean" else F.coalesce(F.translate(F.col(n).cast("string"), "\t\r\n", "   "), F.lit(""))
        for n, t in df.dtypes
    ]
    df.select(F.concat_ws("\t", *flat).alias("value")).write.mode("overwrite").text(path)


def replace_repositories(df: DataFrame, path: str, key: str = "repo_id") -> None:
    """Write ``df`` partitioned by ``key``; only partitions that it has rows of are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))


def upsert_config(old: DataFrame, new: DataFrame) -> DataFrame:
    """Configuration (repo_id, config_key, config_value, source) after a scan: USER rows stay, FILE rows follow ``new``."""
    key = ["repo_id", "config_key"]
    o = old.select(*key, F.col("config_value").alias("ov"), F.col("source").alias("os"))
    n = new.select(*key, F.col("config_value").alias("nv"))
    both = o.join(n, key, "full_outer")
    keep = (F.col("os") == "USER") | F.col("nv").isNull()
    return both.select(*key, F.when(keep, F.col("ov")).otherwise(F.col("nv")).alias("config_value"), F.when(keep, F.col("os")).otherwise("FILE").alias("source"))


def select_release(entries: DataFrame, runtime: int) -> DataFrame:
    """Of multi-release entries (class_path, version: null for the root) the highest version not above ``runtime``; 8 takes the root only."""
    v = F.coalesce("version", F.lit(0))
    fit = entries.where((v == 0) | ((v <= runtime) & F.lit(runtime > 8)))
    w = Window.partitionBy("class_path").orderBy(v.desc())
    return fit.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def flatten_yaml(text: str) -> list[tuple[str, str]]:
    """(dotted key, value) of a YAML text of nested maps and lists of scalars, in order; list places follow as ``[i]``.

    Comments, document marks and keys without a value of their own are left out; quotes around keys and values are removed.
    """
    out: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    counts: dict[str, int] = {}
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw) if "'" not in raw and '"' not in raw else raw
        body = line.strip()
        if not body or body.startswith(("#", "---", "...")):
            continue
        indent = len(line) - len(line.lstrip())
        item = body.startswith("- ")
        while path and (path[-1][0] > indent or (path[-1][0] == indent and not item)):
            path.pop()
        if item:
            base = ".".join(k for _, k in path)
            n = counts.get(base, 0)
            counts[base] = n + 1
            out.append((f"{base}[{n}]", body[2:].strip().strip("'\"")))
            continue
        m = re.match(r"""("[^"]*"|'[^']*'|[^:]+?)\s*:(?:\s+(.*))?$""", body)
        if not m:
            continue
        key, value = m[1].strip("'\""), (m[2] or "").strip()
        if value and value not in ("|", ">"):
            out.append((".".join([*(k for _, k in path), key]), value.strip("'\"")))
        else:
            path.append((indent, key))
    return out


def read_yaml(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(config_key, config_value) of YAML files with dotted keys; of equal keys the last file, then the last line, wins.

    Base files come before the files of a profile in ``paths``.
    """
    order = {p.rsplit("/", 1)[-1]: i for i, p in enumerate(paths)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(order[f], n, k, v) for f, t in zip(pdf["f"], pdf["value"]) for n, (k, v) in enumerate(flatten_yaml(t))]
            yield pd.DataFrame(rows, columns=["f", "n", "config_key", "config_value"])

    files = spark.read.text(list(paths), wholetext=True).select(F.substring_index(F.col("_metadata.file_name"), "/", -1).alias("f"), "value")
    kv = files.mapInPandas(run, "f int, n int, config_key string, config_value string")
    return kv.groupBy("config_key").agg(F.max_by("config_value", F.struct("f", "n")).alias("config_value"))


def read_properties(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(config_key, config_value) of .properties files; of equal keys the last file, then the last line, wins.

    Comment lines and lines without ``=`` are left out; keys and values are trimmed.
    """
    order = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p.rsplit("/", 1)[-1]), F.lit(i))])
    lines = spark.read.text(list(paths), wholetext=True).select(
        F.element_at(order, F.substring_index(F.col("_metadata.file_name"), "/", -1)).alias("f"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "t")
    )
    kv = lines.where(~F.ltrim("t").rlike("^[#!]") & F.contains("t", F.lit("="))).select(
        "f", "n", F.trim(F.split_part("t", F.lit("="), F.lit(1))).alias("config_key"), F.trim(F.regexp_extract("t", "^[^=]*=(.*)$", 1)).alias("config_value")
    )
    return kv.groupBy("config_key").agg(F.max_by("config_value", F.struct("f", "n")).alias("config_value"))
