"""Log diagnosis and comparison of JSON input with known fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A stack frame: class, method, file, line; fixed format of Java stack traces.
FRAME = r"^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.]+):(\d+)\)"


def frames(logs: DataFrame, key: str, text: str, top: int = 3) -> DataFrame:
    """Stack frames of each text: key, line_no, class_name, method_name, line, near_top.

    The first ``top`` frames of every unbroken run of frame lines are near the top, so each cause has its own.
    """
    lines = logs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "t"))
    whole = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("is_frame", F.col("t").rlike(FRAME)).withColumn("run", F.count_if(~F.col("is_frame")).over(whole))
    w = Window.partitionBy(key, "run").orderBy("line_no")
    return runs.where("is_frame").select(
        key,
        "line_no",
        F.regexp_extract("t", FRAME, 1).alias("class_name"),
        F.regexp_extract("t", FRAME, 2).alias("method_name"),
        F.regexp_extract("t", FRAME, 4).cast("int").alias("line"),
        (F.row_number().over(w) <= top).alias("near_top"),
    )


def diagnose(chain: DataFrame, found: DataFrame) -> DataFrame:
    """Status of each (class_name, method_name) of a call chain: ERROR near the top of a trace, OK deeper in one, else UNKNOWN.

    A frame is met by full class name, or by simple class name where the log has no package.
    """
    f = found.groupBy("class_name", "method_name").agg(F.max("near_top").alias("hot"))
    s = found.groupBy(F.substring_index("class_name", ".", -1).alias("simple"), "method_name").agg(F.max("near_top").alias("hot_s"))
    c = chain.withColumn("simple", F.substring_index("class_name", ".", -1))
    met = c.join(f, ["class_name", "method_name"], "left").join(s, ["simple", "method_name"], "left")
    hot = F.coalesce("hot", "hot_s")
    return met.select("class_name", "method_name", F.when(hot.isNull(), "UNKNOWN").when(hot, "ERROR").otherwise("OK").alias("status"))


def json_keys(body: Column) -> Column:
    """Distinct keys at all levels of a JSON text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r'"(\w+)"\s*:'), F.lit(1)))


def field_check(body: Column, required: list[str], optional: list[str]) -> Column:
    """struct<present, missing, not_supplied, unknown> of a JSON text against a type's fields."""
    keys, req, opt = json_keys(body), F.array(*map(F.lit, required)), F.array(*map(F.lit, optional))
    known = F.array_union(req, opt)
    return F.struct(
        F.array_intersect(keys, known).alias("present"),
        F.array_except(req, keys).alias("missing"),
        F.array_except(opt, keys).alias("not_supplied"),
        F.array_except(keys, known).alias("unknown"),
    )


def content_type(text: Column) -> Column:
    """JSON_RESPONSE, JSON_REQUEST, STACK_TRACE or MIXED_LOG."""
    t = F.trim(text)
    json = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    trace = text.rlike("(?m)" + FRAME) & ~(text.contains("{") & text.contains("}"))
    return (
        F.when(json & text.rlike('"(code|status|message|error)"'), "JSON_RESPONSE").when(json, "JSON_REQUEST").when(trace, "STACK_TRACE").otherwise("MIXED_LOG")
    )
