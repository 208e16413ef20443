"""Queries p1, p2, p3 and p5: the general data-quality problems over this project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.operators import nested, orphans, packed, skew
from thicket.session import table

#: Share of all rows from which a key counts as heavy.
HEAVY_SHARE = 0.04


# --- 1: references to records that do not exist ---------------------------------------------


def _method_refs(spark: SparkSession, d: str) -> DataFrame:
    key = ["repo_id"]
    return (
        orphans.references(table(spark, d, "static_field_usage"), "static_field_usage", [*key, "caller_method"], "imported_at")
        .unionByName(orphans.references(table(spark, d, "boundaries"), "boundaries", [*key, "full_method"], "imported_at"))
        .unionByName(
            orphans.references(table(spark, d, "method_return_const"), "method_return_const", [*key, "full_method"], "imported_at")
        )
    )


def _repo_refs(spark: SparkSession, d: str) -> DataFrame:
    return orphans.references(table(spark, d, "jar_info"), "jar_info", ["repo_id"], "imported_at")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    chunks = orphans.lifetimes(table(spark, d, "chunks"), ["repo_id", "full_method"], "imported_at", "deleted_at")
    repos = orphans.lifetimes(table(spark, d, "repositories"), ["id"], "created_at", "deleted_at")
    return orphans.orphan_rows(_method_refs(spark, d), chunks).unionByName(
        orphans.orphan_rows(_repo_refs(spark, d), repos)
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    refs = _method_refs(spark, d).select("table_name", "at").unionByName(_repo_refs(spark, d).select("table_name", "at"))
    return orphans.orphan_report(refs, _orphans(spark, d))


_P1_REFS = """
refs AS (
  SELECT 'static_field_usage' AS table_name, id, repo_id, caller_method AS m, imported_at FROM static_field_usage
  UNION ALL SELECT 'boundaries', id, repo_id, full_method, imported_at FROM boundaries
  UNION ALL SELECT 'method_return_const', id, repo_id, full_method, imported_at FROM method_return_const
), all_refs AS (
  SELECT table_name, strftime(imported_at, '%Y-%m') AS period, id AS row_id,
         NOT EXISTS (SELECT 1 FROM chunks c WHERE c.repo_id = r.repo_id AND c.full_method = r.m
                     AND c.imported_at <= r.imported_at AND (c.deleted_at IS NULL OR r.imported_at < c.deleted_at)) AS lost
  FROM refs r WHERE repo_id IS NOT NULL AND m IS NOT NULL
  UNION ALL
  SELECT 'jar_info', strftime(imported_at, '%Y-%m'), id,
         NOT EXISTS (SELECT 1 FROM repositories p WHERE p.id = j.repo_id AND p.created_at <= j.imported_at
                     AND (p.deleted_at IS NULL OR j.imported_at < p.deleted_at))
  FROM jar_info j WHERE repo_id IS NOT NULL
)
"""

# --- 2: several values packed in one field --------------------------------------------------


def _values(spark: SparkSession, d: str) -> DataFrame:
    chunks, endpoints = table(spark, d, "chunks"), table(spark, d, "api_endpoints")
    return packed.split_packed(
        [
            (chunks, "chunks", "id", "annotations", True),
            (chunks, "chunks", "id", "parameters", False),  # type and name stay together
            (endpoints, "api_endpoints", "id", "table_names", True),
        ]
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d)


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """How many fields hold each value, and at how many places at most."""
    return (
        _values(spark, d)
        .groupBy("table_name", "column_name", "item")
        .agg(F.count(F.lit(1)).alias("n_uses"), F.max("pos").alias("last_pos"))
    )


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fields ``NATION, REGION; NATION, REGION`` of the nations a customer's parts come from: the comma must come out as text.

    Nothing but code lengths can tell: a nation always stands with its region, so the pairs are cheaper values than their halves.
    """
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(", ", "n_name", "r_name").alias("place"))
    supplied = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("n_nationkey"))
    fields = supplied.distinct().join(place, "n_nationkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("place")), "; ").alias("places"))
    return packed.split_packed([(fields, "orders", "l_orderkey", "places", True)]).select("row_id", "pos", "item")


# --- 3: a few keys holding most records -----------------------------------------------------


def _usage_per_key(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_key(
        table(spark, d, "static_field_usage"), ["repo_id", "field_class"], "imported_at", "id", mark="caller_method"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_usage_per_key(spark, d), HEAVY_SHARE).select("key_column", "key_value")


def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _usage_per_key(spark, d).select(
        "key_column", "key_value", "n_rows", F.col("n_marked").alias("n_callers_known"), "first_at", "last_at", "max_gap_us"
    )


# --- 5: deeply nested semi-structured records -----------------------------------------------


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    part = F.arrays_zip("request_chain.seq", "request_chain.request_body", "request_chain.response_body")
    return (
        table(spark, d, "request_chains")
        .select("session_id", F.explode(part).alias("r"))
        .select("session_id", "r.seq", "r.request_body", "r.response_body")
    )


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_bodies(
        _bodies(spark, d), ["session_id", "seq"], {"request": "request_body", "response": "response_body"}
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).select("session_id", "seq", "side", "path", "owner_path").distinct()


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each flat table: plain members by side, table and name, with the rows that have them and the values that are null.

    A member of an object inside a row's object belongs to that row; ``$`` is the table of the bodies themselves.
    """
    members = nested.flatten_fields(
        _bodies(spark, d), ["session_id", "seq"], {"request": "request_body", "response": "response_body"}
    )
    path = lambda c: F.regexp_replace(c, r"\[[0-9]+\]", "[]")
    return members.groupBy("side", path("owner_path").alias("table_path"), path("object_path").alias("object_path"), "name").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("value").isNull()).alias("n_null")
    )


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each flat table: list-element objects by side and list name, with how many have no owner but the body."""
    name = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    return (
        _objects(spark, d)
        .groupBy("side", name.alias("table_path"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("owner_path") == "$").alias("n_top"),
            F.sum("n_members").alias("n_fields"),
        )
    )


# SQL of problem 2: the divided parts are runs of quoted texts, brackets (nested up to four times) and other characters
_QUOTED = r"""\"(?:[^\"\\]|\\.|\"\")*\"|''(?:[^''\\]|\\.)*''|`[^`]*`"""


def _brackets(depth: int) -> str:
    inner = f"{_brackets(depth - 1)}|" if depth else ""
    return rf"""[\[({{<](?:{_QUOTED}|{inner}[^\[\](){{}}<>\"''`])*[\])}}>]"""


def _items(column: str, blanks: bool) -> str:
    parts = rf"""(?:{_QUOTED}|{_brackets(3)}|[^,;|\n\r\t，；、{" " if blanks else ""}\[\](){{}}<>\"''`])+"""
    whole = f"regexp_full_match(trim({column}, E' \\t\\r\\n'), '(?s){_brackets(4)}')"
    body = f"CASE WHEN {whole} THEN trim({column}, E' \\t\\r\\n')[2:-2] ELSE {column} END"
    cut = "trim(x, E' \\t\\r\\n')"
    plain = f"""CASE WHEN regexp_full_match({cut}, '(?s){_QUOTED}') THEN replace(replace({cut}[2:-2], '\\' || {cut}[1], {cut}[1]), {cut}[1] || {cut}[1], {cut}[1]) ELSE {cut} END"""
    return f"list_filter(list_transform(regexp_extract_all({body}, '{parts}'), lambda x: {plain}), lambda y: y <> '')"


def _split_sql(name: str, column: str, blanks: bool) -> str:
    return f"""SELECT '{name}' AS table_name, '{column}' AS column_name, row_id, unnest(generate_series(1, len(v))) AS pos, unnest(v) AS item
FROM (SELECT id AS row_id, {_items(column, blanks)} AS v FROM {name} WHERE {column} IS NOT NULL)"""


_P2 = " UNION ALL ".join(_split_sql(*x) for x in (("chunks", "annotations", True), ("chunks", "parameters", False), ("api_endpoints", "table_names", True)))

# SQL of problem 5: one level after the other
OPENED = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') AND json_type({0} ->> '$') IN ('OBJECT', 'ARRAY') THEN ({0} ->> '$')::JSON ELSE {0} END"
_P5 = f"""
r AS (SELECT session_id, received_at, unnest(request_chain) AS r FROM request_chains),
b AS (SELECT session_id, received_at, r.seq AS seq, 'request' AS side, r.request_body AS body FROM r UNION ALL SELECT session_id, received_at, r.seq, 'response', r.response_body FROM r),
t AS (
 SELECT session_id, received_at, seq, side, '$' AS path, '$' AS owner_path, false AS element, {OPENED.format("body::JSON")} AS v FROM b WHERE json_valid(body)
 UNION ALL
 SELECT session_id, received_at, seq, side, x.path, x.owner, x.element, {OPENED.format("x.v")} FROM (
  SELECT session_id, received_at, seq, side, unnest(CASE json_type(v)
    WHEN 'OBJECT' THEN list_transform(map_entries(v::MAP(VARCHAR, JSON)), lambda e: {{'path': path || '.' || e.key, 'owner': CASE WHEN element THEN path ELSE owner_path END, 'element': false, 'v': e.value}})
    ELSE list_transform(v::JSON[], lambda c, i: {{'path': path || '[' || (i - 1) || ']', 'owner': owner_path, 'element': true, 'v': c}}) END) AS x
  FROM t WHERE json_type(v) IN ('OBJECT', 'ARRAY'))),
found AS (SELECT * FROM t WHERE element AND json_type(v) = 'OBJECT')"""

QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_items": p2_items,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p3_per_key": p3_per_key,
    "p5_found": p5_found,
    "p5_fields": p5_fields,
    "p5_tables": p5_tables,
}

SQL = {
    "p1_found": f"WITH {_P1_REFS} SELECT table_name, period, row_id FROM all_refs WHERE lost",
    "p1_report": f"""WITH {_P1_REFS}
SELECT table_name, period, count(*) AS n_references, count(*) FILTER (WHERE lost) AS n_orphans,
       round(count(*) FILTER (WHERE lost) / count(*), 6) AS orphan_share
FROM all_refs GROUP BY ALL""",
    "p2_found": _P2,
    "p2_items": f"SELECT table_name, column_name, item, count(*) AS n_uses, max(pos) AS last_pos FROM ({_P2}) GROUP BY 1, 2, 3",
    "p2_pairs": """SELECT l_orderkey AS row_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS pos, place AS item
FROM (SELECT DISTINCT l_orderkey, n_name || ', ' || r_name AS place FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)""",
    "p5_found": f"WITH RECURSIVE {_P5} SELECT DISTINCT session_id, seq, side, path, owner_path FROM found",
    "p5_fields": f"""WITH RECURSIVE {_P5}, m AS (SELECT side, CASE WHEN element THEN path ELSE owner_path END AS o, path AS p, unnest(map_entries(v::MAP(VARCHAR, JSON))) AS e FROM t WHERE json_type(v) = 'OBJECT'),
n AS (SELECT side, o, p, e.key AS name, {OPENED.format("e.value")} AS v FROM m)
SELECT side, regexp_replace(o, '\\[[0-9]+\\]', '[]', 'g') AS table_path, regexp_replace(p, '\\[[0-9]+\\]', '[]', 'g') AS object_path, name, count(*) AS n_values, count(*) FILTER (WHERE v IS NULL OR json_type(v) = 'NULL') AS n_null
FROM n WHERE v IS NULL OR json_type(v) NOT IN ('OBJECT', 'ARRAY') GROUP BY 1, 2, 3, 4""",
    "p5_tables": f"""WITH RECURSIVE {_P5} SELECT side, regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS table_path, count(*) AS n_rows, count(*) FILTER (WHERE owner_path = '$') AS n_top,
CAST(sum(len(json_keys(v))) AS BIGINT) AS n_fields FROM found GROUP BY 1, 2""",
    "p3_found": f"""
SELECT 'repo_id' AS key_column, CAST(repo_id AS VARCHAR) AS key_value FROM static_field_usage
WHERE repo_id IS NOT NULL GROUP BY repo_id HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM static_field_usage)
UNION ALL
SELECT 'field_class', field_class FROM static_field_usage
WHERE field_class IS NOT NULL GROUP BY field_class HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM static_field_usage)""",
    "p3_per_key": """
WITH r AS (
  SELECT 'repo_id' AS key_column, CAST(repo_id AS VARCHAR) AS key_value, imported_at, id, caller_method FROM static_field_usage
  UNION ALL SELECT 'field_class', field_class, imported_at, id, caller_method FROM static_field_usage
), g AS (
  SELECT *, epoch_us(imported_at) - epoch_us(lag(imported_at) OVER (PARTITION BY key_column, key_value ORDER BY imported_at, id)) AS gap FROM r
)
SELECT key_column, key_value, count(*) AS n_rows, count(caller_method) AS n_callers_known, min(imported_at) AS first_at,
       max(imported_at) AS last_at, coalesce(max(gap), 0) AS max_gap_us
FROM g GROUP BY key_column, key_value""",
}
