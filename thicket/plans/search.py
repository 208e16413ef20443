"""Search, request-chain and log queries (R, S, T) over this project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket.functions import sig
from thicket.operators import logs, search
from thicket.plans.aggregates import REQ, requests
from thicket.plans.registry import Registry
from thicket.plans.scalars import METHOD
from thicket.session import table
from thicket.sources import capture
from thicket.streaming import windows

R = Registry()
QUERIES, SQL = R.queries, R.sql

_LAST = "regexp_extract(class_name, '([^.]*)$', 1)"


def _hits(col: str, words, weight: int) -> str:
    return " + ".join(f"CASE WHEN contains(lower({col}), '{w}') THEN {weight} ELSE 0 END" for w in words)


@R.query(
    "R01_endpoint_search",
    f"SELECT id, score FROM (SELECT id, {_hits('url_path', ['order', 'list'], 10)} + {_hits(_LAST, ['order', 'list'], 5)} + {_hits(METHOD, ['order', 'list'], 5)} AS score FROM api_endpoints) WHERE score > 0 ORDER BY score DESC, id",
)
def r01(spark, d):
    fields = [(F.col("url_path"), 10, 1), (sig.simple_class(F.col("class_name")), 5, 1), (sig.method_name(F.col("full_method")), 5, 1)]
    return search.best(table(spark, d, "api_endpoints"), search.keyword_score(["order", "list"], fields), None, "id").select("id", "score")


@R.query(
    "R02_layered_search",
    f"""SELECT id, score FROM (SELECT c.id, {_hits('e.url_path', ['ticket', 'sync'], 50)} + {_hits("regexp_extract(c.class_name, '([^.]*)$', 1)", ['ticket', 'sync'], 30)} + {_hits('c.method_name', ['ticket', 'sync'], 20)} + {_hits('c.call_summary', ['ticket', 'sync'], 5)} AS score
FROM chunks c LEFT JOIN (SELECT repo_id, full_method, min(url_path) AS url_path FROM api_endpoints GROUP BY 1, 2) e ON e.repo_id = c.repo_id AND e.full_method = c.full_method) WHERE score > 0 ORDER BY score DESC, id LIMIT 50""",
)
def r02(spark, d):
    key = ["repo_id", "full_method"]
    e = table(spark, d, "api_endpoints").groupBy(*key).agg(F.min("url_path").alias("url_path"))
    pool = table(spark, d, "chunks").join(e, key, "left")
    fields = [(F.col("url_path"), 50, 1), (sig.simple_class(F.col("class_name")), 30, 1), (F.col("method_name"), 20, 1), (F.col("call_summary"), 5, 3)]
    return search.best(pool, search.keyword_score(["ticket", "sync", "x"], fields), 50, "id").select("id", "score")


_COS = """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 9) AS similarity FROM embeddings, q)"""


def _nearest_of_all(spark, d, k, per=None):
    """Neighbours of every row whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return search.nearest_batch(e, "embedding", q, "query_id", "qv", k, "vec_id", per)


@R.query("R03_O03_vector_top_k", f"{_COS} SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 20")
def r03(spark, d):
    return _nearest_of_all(spark, d, 20)


@R.query("R04_vector_top_k_per_group", f"{_COS} SELECT query_id, vec_id, label, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, vec_id) <= 5")
def r04(spark, d):
    return _nearest_of_all(spark, d, 5, "label")


@R.query(
    "R05_repo_routing",
    f"SELECT id, score FROM (SELECT id, name, {_hits('git_url', ['fleet', 'git', 'hub'], 3)} + {_hits('name', ['fleet', 'git', 'hub'], 20)} AS score FROM repositories) WHERE score > 0 ORDER BY score DESC, name LIMIT 5",
)
def r05(spark, d):
    return search.route(table(spark, d, "repositories"), "Which fleet hub keeps its git?".replace("Which ", "").replace(" keeps its", ""), "name", "git_url", whole=5).select("id", "score")


@R.query("R06_bigrams", "SELECT id, len(list_distinct(list_transform(generate_series(1, length(name) - 1), lambda i: substr(name, i, 2)))) AS n_bigrams FROM repositories WHERE length(name) >= 2")
def r06(spark, d):
    return table(spark, d, "repositories").where("length(name) >= 2").select("id", F.size(search.bigrams(F.col("name"))).cast("long").alias("n_bigrams"))


@R.query(
    "R12_log_frames",
    r"""WITH l AS (SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS line_no, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, regexp_matches(t, '^\s*at\s+[\w.$]+\.[\w$<>]+\([\w.]+:\d+\)') AS is_frame FROM l), r AS (SELECT *, sum(CASE WHEN is_frame THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM f)
SELECT doc_id, line_no, regexp_extract(t, 'at\s+([\w.$]+)\.([\w$<>]+)\(', 1) AS class_name, regexp_extract(t, 'at\s+([\w.$]+)\.([\w$<>]+)\(', 2) AS method_name, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) <= 3 AS near_top FROM r WHERE is_frame""",
)
def r12(spark, d):
    return logs.frames(table(spark, d, "documents"), "doc_id", "text").drop("line").withColumn("line_no", F.col("line_no").cast("long"))


@R.query(
    "R13_field_check",
    r"""SELECT session_id, seq, received_at, len(list_intersect(k, ['orderRef', 'total', 'lines', 'channel', 'note'])) AS n_present, len(list_filter(['orderRef', 'total', 'lines'], lambda x: NOT list_contains(k, x))) AS n_missing,
 len(list_filter(k, lambda x: NOT list_contains(['orderRef', 'total', 'lines', 'channel', 'note'], x))) AS n_unknown FROM (SELECT session_id, received_at, r.seq AS seq, list_distinct(regexp_extract_all(r.request_body, '"(\w+)"\s*:', 1)) AS k
 FROM (SELECT session_id, received_at, unnest(request_chain) AS r FROM request_chains) WHERE r.request_body IS NOT NULL)""",
)
def r13(spark, d):
    r = requests(spark, d, "seq", "request_body").where("request_body is not null")
    c = logs.field_check(F.col("request_body"), ["orderRef", "total", "lines"], ["channel", "note"])
    n = lambda f: F.size(c[f]).cast("long")
    return r.select("session_id", "seq", "received_at", n("present").alias("n_present"), n("missing").alias("n_missing"), n("unknown").alias("n_unknown"))


@R.query(
    "R14_chain_comparison",
    f"""WITH k AS (SELECT session_id, received_at, CAST(sum(duration) AS BIGINT) AS total, count(*) AS n FROM {REQ} WHERE duration >= 0 GROUP BY 1, 2)
SELECT session_id, count(*) AS n_deliveries, min(total) AS least, max(total) AS most, round(stddev_pop(total) / nullif(avg(total), 0), 6) AS cv, max(n) - min(n) AS n_diff FROM k GROUP BY 1""",
)
def r14(spark, d):
    k = requests(spark, d, "duration").where("duration >= 0").groupBy("session_id", "received_at").agg(F.sum("duration").alias("total"), F.count("*").alias("n"))
    cv = F.stddev_pop("total") / F.nullif(F.avg("total"), F.lit(0.0))
    return k.groupBy("session_id").agg(
        F.count("*").alias("n_deliveries"), F.min("total").alias("least"), F.max("total").alias("most"), F.round(cv, 6).alias("cv"), (F.max("n") - F.min("n")).alias("n_diff")
    )


@R.query(
    "R17_preset_report",
    """SELECT full_method, string_agg(DISTINCT boundary_type, ',' ORDER BY boundary_type) AS types, count(*) AS n FROM boundaries WHERE boundary_type IN ('HTTP', 'GRPC', 'DB') AND full_method IS NOT NULL GROUP BY 1""",
)
def r17(spark, d):
    b = table(spark, d, "boundaries").where("boundary_type in ('HTTP', 'GRPC', 'DB') and full_method is not null")
    return b.groupBy("full_method").agg(F.array_join(F.array_sort(F.collect_set("boundary_type")), ",").alias("types"), F.count("*").alias("n"))


@R.query(
    "R18_summary_backfill",
    """SELECT id, CASE WHEN length(s) > 45 OR contains(s, method_name) THEN s WHEN s = '' THEN method_name ELSE s || ' | ' || method_name END AS summary FROM (SELECT id, method_name, coalesce(trim(call_summary), '') AS s FROM chunks)""",
)
def r18(spark, d):
    s, m = F.coalesce(F.trim("call_summary"), F.lit("")), F.col("method_name")
    return table(spark, d, "chunks").select("id", F.when((F.length(s) > 45) | F.contains(s, m), s).when(s == "", m).otherwise(F.concat_ws(" | ", s, m)).alias("summary"))


@R.query("R19_config_search", "SELECT id, name FROM repositories WHERE contains(lower(name), 'core') OR contains(lower(git_url), 'core')")
def r19(spark, d):
    hit = F.contains(F.lower("name"), F.lit("core")) | F.contains(F.lower("git_url"), F.lit("core"))
    return table(spark, d, "repositories").where(hit).select("id", "name")


@R.query("R20_jar_listing", "SELECT DISTINCT jar_name FROM (SELECT jar_name FROM jar_info UNION ALL SELECT 'module-' || jar_num FROM chunks) WHERE jar_name IS NOT NULL ORDER BY 1")
def r20(spark, d):
    a = table(spark, d, "jar_info").select("jar_name")
    return a.unionByName(table(spark, d, "chunks").select(F.concat(F.lit("module-"), "jar_num").alias("jar_name"))).where("jar_name is not null").distinct().orderBy("jar_name")


@R.query(
    "S11_curl",
    """SELECT session_id, received_at, r.seq AS seq, r.method AS method, regexp_replace(r.full_url, '^[a-z]+://[^/]+', '') AS path, r.full_url AS full_url FROM (SELECT session_id, received_at, unnest(request_chain) AS r FROM request_chains) WHERE r.full_url IS NOT NULL AND r.method IS NOT NULL""",
)
def s11(spark, d):
    r = requests(spark, d, "seq", "method", "full_url").where("full_url is not null and method is not null")
    curl = F.format_string("curl '%s' \\\n -X %s -H 'accept: application/json'", "full_url", "method")
    c = capture.parse_curl(F.col("c"))
    return r.select("session_id", "received_at", "seq", curl.alias("c")).select("session_id", "received_at", "seq", c["method"].alias("method"), c["url"].alias("path"), c["full_url"].alias("full_url"))


@R.query("S12_sniff", "SELECT count(*) FILTER (WHERE json_valid(b) AND regexp_matches(b, '^\\s*[\\[{]')) AS n_json, count(*) FILTER (WHERE starts_with(ltrim(b), 'curl ')) AS n_curl, count(*) AS n FROM (SELECT unnest(request_chain).request_body AS b FROM request_chains) WHERE b IS NOT NULL")
def s12(spark, d):
    r = requests(spark, d, "request_body").where("request_body is not null")
    b = F.col("request_body")
    return r.agg(F.count_if(capture.is_json(b)).alias("n_json"), F.count_if(capture.is_curl(b)).alias("n_curl"), F.count("*").alias("n"))


@R.query("T01_tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t01(spark, d):
    """Hourly counts of the event stream, run to its end."""
    return windows.tumbling(spark, d, "events", "ts", "event_type", "value", "1 hour")


@R.query(
    "T02_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def t02(spark, d):
    return windows.sessions(spark, d, "events", "ts", "user_id", "30 minutes")


@R.query("T04_resumable", "SELECT repo_id, count(*) AS n FROM chunks WHERE embedding_status IS DISTINCT FROM 'DONE' GROUP BY 1")
def t04(spark, d):
    c = table(spark, d, "chunks")
    done = c.where("embedding_status = 'DONE'").select("id")
    return c.join(done, "id", "left_anti").groupBy("repo_id").agg(F.count("*").alias("n"))
