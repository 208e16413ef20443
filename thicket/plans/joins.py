"""Join queries (J) over the code tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from thicket.functions import sig
from thicket.operators import joins, nested
from thicket.plans.problems import OPENED
from thicket.plans.registry import Registry
from thicket.plans.scalars import PARAMS
from thicket.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: Rules of this data: owner of a callee by prefix, kind of client by ending; first match wins.
OWNERS = [("com.hexbarn.", "hexbarn"), ("com.", "com"), ("io.", "io"), ("org.", "org")]
CLIENTS = [("Client", "client"), ("Session", "session"), ("Pool", "pool"), ("Template", "template")]


def _case(col: str, rules, like: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} LIKE '{like.format(p)}' THEN '{v}'" for p, v in rules) + " END"


@R.query(
    "J01_last_line_update",
    """WITH l AS (SELECT repo_id, full_method, max_by(line_number, (imported_at, id)) AS line FROM boundaries WHERE line_number IS NOT NULL AND full_method IS NOT NULL GROUP BY 1, 2)
SELECT c.id, coalesce(l.line, c.start_line) AS line FROM chunks c LEFT JOIN l ON l.repo_id = c.repo_id AND l.full_method = c.full_method""",
)
def j01(spark, d):
    b = table(spark, d, "boundaries").where("line_number is not null and full_method is not null")
    last = b.groupBy("repo_id", "full_method").agg(F.max_by("line_number", F.struct("imported_at", "id")).alias("line"))
    c = table(spark, d, "chunks").select("id", "repo_id", "full_method", "start_line")
    return c.join(last, ["repo_id", "full_method"], "left").select("id", F.coalesce("line", "start_line").alias("line"))


@R.query(
    "J03_full_outer_enrichment",
    """WITH u AS (SELECT repo_id, caller_method AS m, list_sort(list(DISTINCT field_name)) AS fields FROM static_field_usage WHERE caller_method IS NOT NULL GROUP BY 1, 2),
v AS (SELECT repo_id, full_method AS m, list_sort(list(DISTINCT value)) AS consts FROM method_return_const WHERE full_method IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
SELECT c.id, array_to_string(u.fields, ',') AS fields, array_to_string(v.consts, ',') AS consts FROM (SELECT coalesce(u.repo_id, v.repo_id) AS repo_id, coalesce(u.m, v.m) AS m, u.fields, v.consts FROM u FULL JOIN v ON u.repo_id = v.repo_id AND u.m = v.m) x
JOIN chunks c ON c.repo_id = x.repo_id AND c.full_method = x.m LEFT JOIN u ON u.repo_id = x.repo_id AND u.m = x.m LEFT JOIN v ON v.repo_id = x.repo_id AND v.m = x.m""",
)
def j03(spark, d):
    def texts(name, method, value, out):
        t = table(spark, d, name).where(f"{method} is not null and {value} is not null")
        return t.groupBy("repo_id", F.col(method).alias("full_method")).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(out))

    both = texts("static_field_usage", "caller_method", "field_name", "fields").join(
        texts("method_return_const", "full_method", "value", "consts"), ["repo_id", "full_method"], "full_outer"
    )
    return table(spark, d, "chunks").select("id", "repo_id", "full_method").join(both, ["repo_id", "full_method"]).select("id", "fields", "consts")


@R.query(
    "J05_field_values",
    """SELECT DISTINCT u.field_class, u.field_name, v.value FROM static_field_usage u JOIN method_return_const v ON v.repo_id = u.repo_id AND v.full_method = u.caller_method WHERE v.value IS NOT NULL""",
)
def j05(spark, d):
    key = ["repo_id", "full_method"]
    u = table(spark, d, "static_field_usage").select("repo_id", F.col("caller_method").alias("full_method"), "field_class", "field_name").distinct()
    v = table(spark, d, "method_return_const").where("value is not null").select(*key, "value").distinct()
    return u.join(v, key).select("field_class", "field_name", "value").distinct()


@R.query(
    "J06_parameter_types",
    f"""SELECT p AS arg_type, count(DISTINCT full_method) AS n_methods FROM (SELECT full_method, unnest(string_split({PARAMS}, ',')) AS p FROM chunks WHERE ({PARAMS}) <> '') GROUP BY 1""",
)
def j06(spark, d):
    p = sig.params(F.col("full_method"))
    types = table(spark, d, "chunks").where(p != "").select("full_method", F.explode(F.split(p, ",")).alias("arg_type"))
    return types.groupBy("arg_type").agg(F.count_distinct("full_method").alias("n_methods"))


@R.query(
    "J09_endpoint_base_path",
    """SELECT e.id, coalesce('/' || r.url_path_identifier, '') || e.url_path AS full_path FROM api_endpoints e LEFT JOIN repositories r ON r.id = e.repo_id AND r.deleted_at IS NULL WHERE e.url_path IS NOT NULL""",
)
def j09(spark, d):
    r = table(spark, d, "repositories").where("deleted_at is null").select(F.col("id").alias("repo_id"), "url_path_identifier")
    base = F.coalesce(F.concat(F.lit("/"), "url_path_identifier"), F.lit(""))
    return table(spark, d, "api_endpoints").where("url_path is not null").join(r, "repo_id", "left").select("id", F.concat(base, "url_path").alias("full_path"))


@R.query(
    "J10_semi_service_methods",
    "SELECT id FROM chunks c WHERE access_flags & 1 <> 0 AND EXISTS (SELECT 1 FROM api_endpoints e WHERE e.endpoint_type = 'MQ' AND e.class_name = c.class_name AND e.repo_id = c.repo_id)",
)
def j10(spark, d):
    e = table(spark, d, "api_endpoints").where("endpoint_type = 'MQ'").select("repo_id", "class_name")
    c = table(spark, d, "chunks").where(F.col("access_flags").bitwiseAND(F.lit(1)) != 0)
    return c.join(e, ["repo_id", "class_name"], "left_semi").select("id")


@R.query(
    "J11_J14_containment",
    """SELECT DISTINCT b.repo_id, s.word, b.boundary_type FROM boundaries b JOIN (SELECT DISTINCT unnest(string_split(url_path, '/')) AS word FROM api_endpoints) s ON s.word <> '' AND contains(b.context, s.word)""",
)
def j11(spark, d):
    words = table(spark, d, "api_endpoints").select(F.explode(F.split("url_path", "/")).alias("word")).distinct()
    b = table(spark, d, "boundaries").select("repo_id", "boundary_type", "context").distinct()
    return joins.contains_join(b, "context", words, "word").select("repo_id", "word", "boundary_type").distinct()


@R.query(
    "J12_J13_first_rule",
    f"""SELECT id, {_case("callee_method", OWNERS, "{}%")} AS owner, {_case("regexp_extract(callee_method, '^(.*):', 1)", CLIENTS, "%{}")} AS client FROM boundaries WHERE callee_method IS NOT NULL""",
)
def j12(spark, d):
    m = F.col("callee_method")
    return table(spark, d, "boundaries").where(m.isNotNull()).select(
        "id", joins.first_rule(m, OWNERS).alias("owner"), joins.first_rule(sig.class_name(m), CLIENTS, "suffix").alias("client")
    )


@R.query(
    "J15_url_templates",
    """WITH q AS (SELECT DISTINCT http_method, url_path FROM api_endpoints WHERE url_path IS NOT NULL), t AS (
 SELECT min(id) AS tid, http_method, string_split(url_path, '/')[1:len(string_split(url_path, '/')) - 1] || ['{x}'] AS tpl FROM api_endpoints WHERE url_path IS NOT NULL GROUP BY 2, 3)
SELECT q.http_method, q.url_path, count(*) AS n_templates, min(t.tid) AS first_id FROM q JOIN t ON q.http_method = t.http_method AND len(string_split(q.url_path, '/')) = len(t.tpl)
 AND string_split(q.url_path, '/')[1:len(t.tpl) - 1] = t.tpl[1:len(t.tpl) - 1] GROUP BY ALL""",
)
def j15(spark, d):
    e = table(spark, d, "api_endpoints").where("url_path is not null and http_method is not null")
    q = e.select("http_method", "url_path").distinct()
    t = e.groupBy("http_method", F.regexp_replace("url_path", "[^/]*$", "{x}").alias("tpl")).agg(F.min("id").alias("tid"))
    return joins.template_join(q, "url_path", t, "tpl", ["http_method"]).groupBy("http_method", "url_path").agg(
        F.count("*").alias("n_templates"), F.min("tid").alias("first_id")
    )


@R.query(
    "J16_anti_uncalled",
    "SELECT DISTINCT class_name FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM static_field_usage u WHERE u.repo_id = c.repo_id AND u.caller_method = c.full_method)",
)
def j16(spark, d):
    u = table(spark, d, "static_field_usage").select("repo_id", F.col("caller_method").alias("full_method"))
    return table(spark, d, "chunks").join(u, ["repo_id", "full_method"], "left_anti").select("class_name").distinct()


@R.query(
    "J19_same_signature",
    """WITH m AS (SELECT DISTINCT repo_id, class_name, regexp_extract(full_method, '([^:]*)$', 1) AS sig FROM chunks)
SELECT a.repo_id, a.sig, count(*) AS n_pairs FROM m a JOIN m b ON a.repo_id = b.repo_id AND a.sig = b.sig AND a.class_name < b.class_name GROUP BY ALL""",
)
def j19(spark, d):
    m = table(spark, d, "chunks").select("repo_id", "class_name", F.substring_index("full_method", ":", -1).alias("sig")).distinct()
    # pairs of one group are counted, not made
    return m.groupBy("repo_id", "sig").agg(F.count("*").alias("n")).where("n > 1").select("repo_id", "sig", F.expr("n * (n - 1) div 2").alias("n_pairs"))


@R.query(
    "J21_owner_priority",
    """WITH calls AS (SELECT DISTINCT caller_method AS m, repo_id FROM static_field_usage WHERE caller_method IS NOT NULL),
ep AS (SELECT full_method AS m, min(repo_id) AS r FROM api_endpoints WHERE full_method IS NOT NULL GROUP BY 1),
ch AS (SELECT full_method AS m, min(repo_id) AS r FROM chunks GROUP BY 1 HAVING count(DISTINCT repo_id) = 1),
px AS (SELECT p, min_by(repo_id, (-n, repo_id)) AS r FROM (SELECT array_to_string(string_split(class_name, '.')[1:3], '.') AS p, repo_id, count(*) AS n FROM chunks GROUP BY ALL) GROUP BY 1)
SELECT m, repo_id, coalesce(ep.r, ch.r, px.r) AS owner FROM calls LEFT JOIN ep USING (m) LEFT JOIN ch USING (m) LEFT JOIN px ON px.p = array_to_string(string_split(split_part(m, ':', 1), '.')[1:3], '.')""",
)
def j21(spark, d):
    calls = table(spark, d, "static_field_usage").where("caller_method is not null").select(F.col("caller_method").alias("m"), "repo_id").distinct()
    calls = calls.withColumn("p", sig.first_segments(sig.class_name(F.col("m")), 3))
    ep = table(spark, d, "api_endpoints").where("full_method is not null").groupBy(F.col("full_method").alias("m")).agg(F.min("repo_id").alias("r"))
    chunks = table(spark, d, "chunks")
    ch = chunks.groupBy(F.col("full_method").alias("m")).agg(F.min("repo_id").alias("r"), F.max("repo_id").alias("r2")).where("r = r2")
    px = chunks.groupBy(sig.first_segments(F.col("class_name"), 3).alias("p"), "repo_id").agg(F.count("*").alias("n"))
    px = px.groupBy("p").agg(F.min_by("repo_id", F.struct(-F.col("n"), F.col("repo_id"))).alias("r"))
    return joins.priority_lookup(calls, [(ep, ["m"], "r"), (ch, ["m"], "r"), (px, ["p"], "r")], "owner").drop("p")


@R.query(
    "J25_W01_request_pairs",
    """WITH r AS (SELECT session_id, received_at, unnest(request_chain) AS r FROM request_chains),
w AS (SELECT session_id, received_at, r.seq AS seq, r.url AS url, lead(r.url) OVER (PARTITION BY session_id, received_at ORDER BY r.seq) AS next_url, lead(r.seq) OVER (PARTITION BY session_id, received_at ORDER BY r.seq) AS next_seq FROM r)
SELECT url, next_url, count(*) AS n FROM w WHERE next_seq IS NOT NULL GROUP BY ALL""",
)
def j25(spark, d):
    part = F.arrays_zip("request_chain.seq", "request_chain.url")
    r = table(spark, d, "request_chains").select("session_id", "received_at", F.explode(part).alias("r")).select("session_id", "received_at", "r.*")
    w = Window.partitionBy("session_id", "received_at").orderBy("seq")
    pairs = r.select("url", F.lead("url").over(w).alias("next_url"), F.lead("seq").over(w).alias("next_seq")).where("next_seq is not null")
    return pairs.groupBy("url", "next_url").agg(F.count("*").alias("n"))


_LEAVES = """CASE json_type({0}) WHEN 'OBJECT' THEN list_transform(map_entries({0}::MAP(VARCHAR, JSON)), lambda e: {{'path': path || '.' || e.key, 'v': e.value}})
 WHEN 'ARRAY' THEN list_transform({0}::JSON[], lambda c, i: {{'path': path || '[' || (i - 1) || ']', 'v': c}}) END"""


@R.query(
    "J26_shared_fields",
    f"""WITH RECURSIVE r AS (SELECT DISTINCT session_id, r.seq AS seq, r.request_body AS q, r.response_body AS p FROM (SELECT session_id, unnest(request_chain) AS r FROM request_chains) WHERE r.success),
b AS (SELECT session_id, seq, 'p' AS side, {OPENED.format('p::JSON')} AS v FROM r WHERE json_valid(p) UNION ALL SELECT session_id, seq - 1, 'q', {OPENED.format('q::JSON')} FROM r WHERE json_valid(q)),
t AS (SELECT session_id, seq, side, '$' AS path, v FROM b UNION ALL SELECT session_id, seq, side, x.path, {OPENED.format('x.v')} FROM (SELECT session_id, seq, side, unnest({_LEAVES.format('v')}) AS x FROM t WHERE json_type(v) IN ('OBJECT', 'ARRAY'))),
l AS (SELECT DISTINCT session_id, seq, side, path, v ->> '$' AS v FROM t WHERE v IS NOT NULL AND json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL'))
SELECT a.session_id, a.seq, count(*) AS n_shared FROM l a JOIN l b USING (session_id, seq, path, v) WHERE a.side = 'p' AND b.side = 'q' GROUP BY ALL""",
)
def j26(spark, d):
    """Equal values at equal paths of a successful request's answer and of the next successful request's body."""
    part = F.arrays_zip("request_chain.seq", "request_chain.success", "request_chain.request_body", "request_chain.response_body")
    r = table(spark, d, "request_chains").select("session_id", F.explode(part).alias("r")).select("session_id", "r.*").where("success").drop("success").distinct()

    def leaves(body, seq):
        rows = r.where(F.col(body).isNotNull()).select("session_id", seq.alias("seq"), F.col(body).alias("body"))
        return nested.leaf_values(rows, ["session_id", "seq"], "body").where("value is not null").distinct()

    a, b = leaves("response_body", F.col("seq")), leaves("request_body", F.col("seq") - 1)
    return a.join(b, ["session_id", "seq", "path", "value"]).groupBy("session_id", "seq").agg(F.count("*").alias("n_shared"))


@R.query(
    "J28_jar_names",
    """SELECT c.repo_id, coalesce(j.jar_name, 'module-' || c.jar_num) AS jar, count(DISTINCT c.class_name) AS n_classes, count(*) AS n_methods FROM chunks c
LEFT JOIN (SELECT repo_id, jar_num, min(jar_name) AS jar_name FROM jar_info GROUP BY 1, 2) j ON j.repo_id = c.repo_id AND j.jar_num = c.jar_num GROUP BY ALL""",
)
def j28(spark, d):
    j = table(spark, d, "jar_info").groupBy("repo_id", "jar_num").agg(F.min("jar_name").alias("jar_name"))
    name = F.coalesce("jar_name", F.concat(F.lit("module-"), F.col("jar_num")))
    return table(spark, d, "chunks").join(j, ["repo_id", "jar_num"], "left").groupBy("repo_id", name.alias("jar")).agg(
        F.count_distinct("class_name").alias("n_classes"), F.count("*").alias("n_methods")
    )


_STATE = "SELECT repo_id, full_method, max_by(method_hash, (imported_at, id)) AS h FROM chunks WHERE imported_at <= TIMESTAMP '{0} 00:00:00' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{0} 00:00:00') GROUP BY 1, 2"


@R.query(
    "J29_snapshot_diff",
    f"""SELECT CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change, repo_id, count(*) AS n
FROM ({_STATE.format("2025-03-01")}) a FULL JOIN ({_STATE.format("2025-09-01")}) b USING (repo_id, full_method) WHERE a.h IS DISTINCT FROM b.h GROUP BY ALL""",
)
def j29(spark, d):
    def state(day, name):
        at = F.lit(f"{day} 00:00:00").cast("timestamp")
        c = table(spark, d, "chunks").where((F.col("imported_at") <= at) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > at)))
        return c.groupBy("repo_id", "full_method").agg(F.max_by("method_hash", F.struct("imported_at", "id")).alias(name))

    both = state("2025-03-01", "a").join(state("2025-09-01", "b"), ["repo_id", "full_method"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy(change.alias("change"), "repo_id").agg(F.count("*").alias("n"))


@R.query(
    "J30_asof_version",
    """SELECT u.id, c.method_hash AS version FROM static_field_usage u ASOF LEFT JOIN (SELECT repo_id, full_method, imported_at, max_by(method_hash, id) AS method_hash FROM chunks GROUP BY 1, 2, 3) c
ON u.repo_id = c.repo_id AND u.caller_method = c.full_method AND u.imported_at >= c.imported_at""",
)
def j30(spark, d):
    u = table(spark, d, "static_field_usage").select("id", "repo_id", F.col("caller_method").alias("full_method"), "imported_at")
    c = table(spark, d, "chunks").select("repo_id", "full_method", "imported_at", "method_hash", F.col("id").alias("tie"))
    return joins.asof_join(u, c, ["repo_id", "full_method"], "imported_at", ["method_hash"], "tie").select("id", F.col("method_hash").alias("version"))


@R.query(
    "J30_range_lines",
    """SELECT DISTINCT u.id FROM static_field_usage u JOIN chunks c ON u.repo_id = c.repo_id AND u.caller_method = c.full_method AND u.line_num BETWEEN c.start_line AND c.end_line""",
)
def j30r(spark, d):
    u, c = table(spark, d, "static_field_usage").alias("u"), table(spark, d, "chunks").select("repo_id", "full_method", "start_line", "end_line").distinct().alias("c")
    on = (F.col("u.repo_id") == F.col("c.repo_id")) & (F.col("u.caller_method") == F.col("c.full_method")) & F.col("u.line_num").between(F.col("c.start_line"), F.col("c.end_line"))
    return u.join(c, on, "left_semi").select("id")
