"""Aggregation, window, ordering and set queries (A, W, O, U)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from thicket.functions import sig
from thicket.plans.registry import Registry
from thicket.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

REQ = "(SELECT session_id, received_at, r.seq AS seq, r.url AS url, r.method AS method, r.duration AS duration, r.success AS success, r.ts_ms AS ts_ms FROM (SELECT session_id, received_at, unnest(request_chain) AS r FROM request_chains))"


def requests(spark, d, *cols):
    """Captured requests, one row each; only the named parts of the capture are read."""
    part = F.arrays_zip(*[f"request_chain.{c}" for c in cols])
    return table(spark, d, "request_chains").select("session_id", "received_at", F.explode(part).alias("r")).select("session_id", "received_at", "r.*")


@R.query(
    "A01_group_to_set",
    "SELECT repo_id, class_name, array_to_string(list_sort(list(DISTINCT return_type)), ',') AS types FROM chunks WHERE return_type IS NOT NULL GROUP BY 1, 2",
)
def a01(spark, d):
    c = table(spark, d, "chunks").where("return_type is not null")
    return c.groupBy("repo_id", "class_name").agg(F.array_join(F.array_sort(F.collect_set("return_type")), ",").alias("types"))


@R.query("A02_A03_counts", "SELECT repo_id, count(*) AS n, count(DISTINCT caller_method) AS n_callers, count(DISTINCT field_class) AS n_classes FROM static_field_usage GROUP BY 1")
def a02(spark, d):
    return table(spark, d, "static_field_usage").groupBy("repo_id").agg(
        F.count("*").alias("n"), F.count_distinct("caller_method").alias("n_callers"), F.count_distinct("field_class").alias("n_classes")
    )


@R.query(
    "A04_pair_totals",
    """SELECT u.repo_id AS from_repo, c.repo_id AS to_repo, count(*) AS n_uses, count(DISTINCT u.caller_method) AS n_callers FROM static_field_usage u
JOIN (SELECT full_method, min(repo_id) AS repo_id FROM chunks GROUP BY 1) c ON c.full_method = u.caller_method GROUP BY ALL""",
)
def a04(spark, d):
    c = table(spark, d, "chunks").groupBy(F.col("full_method").alias("caller_method")).agg(F.min("repo_id").alias("to_repo"))
    u = table(spark, d, "static_field_usage").groupBy(F.col("repo_id").alias("from_repo"), "caller_method").agg(F.count("*").alias("n"))
    # uses are counted per method before the join, so that hot methods cost one row
    return u.join(c, "caller_method").groupBy("from_repo", "to_repo").agg(F.sum("n").alias("n_uses"), F.count("*").alias("n_callers"))


@R.query(
    "A05_dominant_package",
    """SELECT repo_id, min_by(p, (-n, p)) AS prefix FROM (SELECT repo_id, array_to_string(string_split(package_name, '.')[1:3], '.') AS p, count(*) AS n FROM chunks GROUP BY ALL) GROUP BY 1""",
)
def a05(spark, d):
    c = table(spark, d, "chunks").groupBy("repo_id", sig.first_segments(F.col("package_name"), 3).alias("p")).agg(F.count("*").alias("n"))
    return c.groupBy("repo_id").agg(F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("prefix"))


@R.query(
    "A06_W03_hot_methods",
    """SELECT repo_id, caller_method, n, rk FROM (SELECT repo_id, caller_method, count(*) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, caller_method) AS rk
FROM static_field_usage WHERE caller_method IS NOT NULL GROUP BY 1, 2) WHERE rk <= 20""",
)
def a06(spark, d):
    g = table(spark, d, "static_field_usage").where("caller_method is not null").groupBy("repo_id", "caller_method").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "caller_method")
    return g.withColumn("rk", F.row_number().over(w)).where("rk <= 20")


@R.query(
    "A07_call_type_of_class",
    """SELECT class_name, CASE WHEN count(DISTINCT t) > 1 THEN 'MIXED' ELSE min(t) END AS call_type FROM (SELECT class_name, CASE endpoint_type WHEN 'HTTP' THEN 'HTTP' WHEN 'MQ' THEN 'MQ' ELSE 'RPC' END AS t FROM api_endpoints) GROUP BY 1""",
)
def a07(spark, d):
    t = F.when(F.col("endpoint_type").isin("HTTP", "MQ"), F.col("endpoint_type")).otherwise("RPC")
    kinds = table(spark, d, "api_endpoints").groupBy("class_name").agg(F.collect_set(t).alias("k"))
    return kinds.select("class_name", F.when(F.size("k") > 1, "MIXED").otherwise(F.get("k", F.lit(0))).alias("call_type"))


@R.query("A08_unique_owner", "SELECT full_method, CASE WHEN count(DISTINCT repo_id) = 1 THEN min(repo_id) ELSE -1 END AS owner FROM chunks GROUP BY 1")
def a08(spark, d):
    g = table(spark, d, "chunks").groupBy("full_method").agg(F.min("repo_id").alias("a"), F.max("repo_id").alias("b"))
    return g.select("full_method", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(-1).alias("owner"))


@R.query(
    "A09_ambiguous_methods",
    "SELECT full_method, count(DISTINCT repo_id) AS n_repos, array_to_string(list_sort(list(DISTINCT repo_id)), ',') AS repos FROM chunks GROUP BY 1 HAVING count(DISTINCT repo_id) > 1",
)
def a09(spark, d):
    g = table(spark, d, "chunks").groupBy("full_method").agg(F.array_sort(F.collect_set("repo_id")).alias("r"))
    return g.where(F.size("r") > 1).select("full_method", F.size("r").cast("long").alias("n_repos"), F.array_join(F.col("r").cast("array<string>"), ",").alias("repos"))


@R.query(
    "A11_session_kpis",
    f"""SELECT session_id, received_at, count(*) AS n, CAST(sum(duration) AS BIGINT) AS total, count(*) FILTER (WHERE duration > 500) AS n_slow, count(*) FILTER (WHERE NOT success) AS n_failed
FROM {REQ} WHERE duration >= 0 GROUP BY ALL""",
)
def a11(spark, d):
    return requests(spark, d, "duration", "success").where("duration >= 0").groupBy("session_id", "received_at").agg(
        F.count("*").alias("n"), F.sum("duration").alias("total"), F.count_if(F.col("duration") > 500).alias("n_slow"), F.count_if(~F.col("success")).alias("n_failed")
    )


@R.query(
    "A12_metric_variation",
    f"""SELECT url, min(duration) AS least, max(duration) AS most, round(avg(duration), 4) AS mean, round(stddev_pop(duration) / nullif(avg(duration), 0), 6) AS cv FROM {REQ} WHERE duration >= 0 AND url IS NOT NULL GROUP BY 1""",
)
def a12(spark, d):
    r = requests(spark, d, "url", "duration").where("duration >= 0 and url is not null")
    cv = F.stddev_pop("duration") / F.nullif(F.avg("duration"), F.lit(0.0))
    return r.groupBy("url").agg(F.min("duration").alias("least"), F.max("duration").alias("most"), F.round(F.avg("duration"), 4).alias("mean"), F.round(cv, 6).alias("cv"))


@R.query(
    "A15_boundary_groups",
    """SELECT repo_id, boundary_type, count(*) AS n, count(*) > 5 AND boundary_type = 'DB' AS n_plus_one, array_to_string(list_sort(list(DISTINCT context))[1:3], '|') AS examples
FROM boundaries WHERE boundary_type IS NOT NULL GROUP BY 1, 2""",
)
def a15(spark, d):
    b = table(spark, d, "boundaries").where("boundary_type is not null")
    # the three least contexts need no list of all of them
    few = b.where("context is not null").select("repo_id", "boundary_type", "context").distinct()
    w = Window.partitionBy("repo_id", "boundary_type").orderBy("context")
    few = few.withColumn("rk", F.row_number().over(w)).where("rk <= 3").groupBy("repo_id", "boundary_type").agg(F.array_join(F.array_sort(F.collect_list("context")), "|").alias("examples"))
    n = b.groupBy("repo_id", "boundary_type").agg(F.count("*").alias("n"))
    return n.join(few, ["repo_id", "boundary_type"], "left").select(
        "repo_id", "boundary_type", "n", ((F.col("n") > 5) & (F.col("boundary_type") == "DB")).alias("n_plus_one"), "examples"
    )


@R.query(
    "A16_first_by_kind",
    """SELECT repo_id, full_method, min_by(value, id) FILTER (WHERE TRY_CAST(value AS BIGINT) IS NOT NULL AND regexp_full_match(value, '-?\\d+')) AS code, min_by(value, id) FILTER (WHERE NOT regexp_full_match(value, '-?\\d+') AND length(value) >= 2) AS description
FROM method_return_const WHERE full_method IS NOT NULL GROUP BY 1, 2""",
)
def a16(spark, d):
    v = table(spark, d, "method_return_const").where("full_method is not null")
    return v.groupBy("repo_id", "full_method").agg(
        F.expr("min_by(value, id) FILTER (WHERE value rlike '^-?\\\\d+$' AND try_cast(value AS BIGINT) IS NOT NULL)").alias("code"),
        F.expr("min_by(value, id) FILTER (WHERE NOT value rlike '^-?\\\\d+$' AND length(value) >= 2)").alias("description"),
    )


@R.query("A17_ordered_vector", "SELECT session_id, received_at, array_to_string(list(method ORDER BY seq), '>') AS methods FROM " + REQ + " GROUP BY 1, 2")
def a17(spark, d):
    r = requests(spark, d, "seq", "method").groupBy("session_id", "received_at").agg(F.array_sort(F.collect_list(F.struct("seq", "method"))).alias("v"))
    return r.select("session_id", "received_at", F.array_join("v.method", ">").alias("methods"))


@R.query(
    "A18_W07_text_budget",
    """SELECT repo_id, class_name, coalesce(string_agg(method_name, ' ' ORDER BY method_name) FILTER (WHERE before + length(method_name) <= 800), '') AS summary
FROM (SELECT repo_id, class_name, method_name, coalesce(sum(length(method_name) + 1) OVER (PARTITION BY repo_id, class_name ORDER BY method_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS before
FROM (SELECT DISTINCT repo_id, class_name, method_name FROM chunks WHERE method_name IS NOT NULL)) GROUP BY 1, 2""",
)
def a18(spark, d):
    """A name is added while the text so far and the name have at most 800 characters, the blank between them aside."""
    m = table(spark, d, "chunks").where("method_name is not null").select("repo_id", "class_name", "method_name").distinct()
    w = Window.partitionBy("repo_id", "class_name").orderBy("method_name").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("method_name") + 1).over(w) - 1, F.lit(0))
    fits = m.withColumn("name", F.when(before + F.length("method_name") <= 800, F.col("method_name")))
    return fits.groupBy("repo_id", "class_name").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("summary"))


@R.query(
    "A19_repo_profile",
    """WITH p AS (SELECT repo_id, array_to_string(string_split(package_name, '.')[1:3], '.') AS p, count(*) AS n FROM chunks GROUP BY ALL),
t AS (SELECT repo_id, string_agg(p, ',' ORDER BY rk) AS packages FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, p) AS rk FROM p) WHERE rk <= 3 GROUP BY 1),
u AS (SELECT repo_id, count(DISTINCT split_part(url_path, '/', 2)) AS n_modules FROM api_endpoints WHERE url_path IS NOT NULL GROUP BY 1)
SELECT t.repo_id, t.packages, coalesce(u.n_modules, 0) AS n_modules FROM t LEFT JOIN u USING (repo_id)""",
)
def a19(spark, d):
    p = table(spark, d, "chunks").groupBy("repo_id", sig.first_segments(F.col("package_name"), 3).alias("p")).agg(F.count("*").alias("n"))
    rk = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "p"))
    top = p.withColumn("rk", rk).where("rk <= 3").groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "p"))), lambda x: x["p"]), ",").alias("packages"))
    u = table(spark, d, "api_endpoints").where("url_path is not null").groupBy("repo_id").agg(F.count_distinct(F.split_part("url_path", F.lit("/"), F.lit(2))).alias("n_modules"))
    return top.join(u, "repo_id", "left").na.fill({"n_modules": 0})


@R.query("A20_file_tree", "SELECT repo_id, jar_num, class_name, count(*) AS n_methods, min(start_line) AS first_line, max(end_line) AS last_line FROM chunks GROUP BY 1, 2, 3")
def a20(spark, d):
    return table(spark, d, "chunks").groupBy("repo_id", "jar_num", "class_name").agg(
        F.count("*").alias("n_methods"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")
    )


@R.query(
    "A21_G21_class_edges",
    """SELECT DISTINCT repo_id, regexp_extract(caller_method, '^(.*):', 1) AS source_class, field_class AS target_class FROM static_field_usage WHERE caller_method IS NOT NULL AND field_class IS NOT NULL
UNION SELECT DISTINCT repo_id, regexp_extract(full_method, '^(.*):', 1), regexp_extract(callee_method, '^(.*):', 1) FROM boundaries WHERE full_method IS NOT NULL AND callee_method IS NOT NULL""",
)
def a21(spark, d):
    u = table(spark, d, "static_field_usage").where("caller_method is not null and field_class is not null")
    b = table(spark, d, "boundaries").where("full_method is not null and callee_method is not null")
    e = u.select("repo_id", sig.class_name(F.col("caller_method")).alias("source_class"), F.col("field_class").alias("target_class"))
    f = b.select("repo_id", sig.class_name(F.col("full_method")).alias("source_class"), sig.class_name(F.col("callee_method")).alias("target_class"))
    return e.unionByName(f).distinct()


@R.query("A22_dependency_lines", "SELECT repo_id, boundary_type, count(DISTINCT callee_method) AS n_callees, count(DISTINCT line_number) AS n_lines FROM boundaries GROUP BY 1, 2")
def a22(spark, d):
    return table(spark, d, "boundaries").groupBy("repo_id", "boundary_type").agg(
        F.count_distinct("callee_method").alias("n_callees"), F.count_distinct("line_number").alias("n_lines")
    )


@R.query(
    "A24_progress",
    "SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE embedding_status = 'DONE') AS done, count(*) FILTER (WHERE embedding_status = 'FAILED') AS failed, count(*) FILTER (WHERE embedding_status IS NULL) AS pending FROM chunks GROUP BY 1",
)
def a24(spark, d):
    s = F.col("embedding_status")
    return table(spark, d, "chunks").groupBy("repo_id").agg(
        F.count("*").alias("total"), F.count_if(s == "DONE").alias("done"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s.isNull()).alias("pending")
    )


@R.query(
    "A29_data_flow_verbs",
    """SELECT regexp_extract(full_method, '^(.*):', 1) AS class_name, verb, count(*) AS n FROM (SELECT full_method, CASE WHEN regexp_matches(t, 'insert|save|add') THEN 'insert' WHEN regexp_matches(t, 'update|merge') THEN 'update'
 WHEN regexp_matches(t, 'delete|remove') THEN 'delete' WHEN regexp_matches(t, 'select|query|find|list') THEN 'select' END AS verb FROM (SELECT full_method, lower(context) AS t FROM boundaries WHERE boundary_type = 'DB' AND full_method IS NOT NULL)) WHERE verb IS NOT NULL GROUP BY ALL""",
)
def a29(spark, d):
    t = F.lower("context")
    verb = F.when(t.rlike("insert|save|add"), "insert").when(t.rlike("update|merge"), "update").when(t.rlike("delete|remove"), "delete").when(t.rlike("select|query|find|list"), "select")
    b = table(spark, d, "boundaries").where("boundary_type = 'DB' and full_method is not null")
    return b.groupBy(sig.class_name(F.col("full_method")).alias("class_name"), verb.alias("verb")).agg(F.count("*").alias("n")).where("verb is not null")


@R.query(
    "A31_id_ranges",
    """SELECT c.id, min(u.id) AS first_use, max(u.id) AS last_use FROM chunks c JOIN static_field_usage u ON u.repo_id = c.repo_id AND u.caller_method = c.full_method AND u.line_num >= c.start_line AND u.line_num <= c.end_line GROUP BY 1""",
)
def a31(spark, d):
    c = table(spark, d, "chunks").select("id", "repo_id", "full_method", "start_line", "end_line").alias("c")
    u = table(spark, d, "static_field_usage").groupBy("repo_id", "caller_method", "line_num").agg(F.min("id").alias("a"), F.max("id").alias("b")).alias("u")
    on = (F.col("u.repo_id") == F.col("c.repo_id")) & (F.col("u.caller_method") == F.col("c.full_method")) & F.col("u.line_num").between(F.col("c.start_line"), F.col("c.end_line"))
    return c.join(u, on).groupBy("c.id").agg(F.min("a").alias("first_use"), F.max("b").alias("last_use"))


@R.query(
    "A32_duplicates",
    "SELECT id, rn > 1 AS dup FROM (SELECT id, row_number() OVER (PARTITION BY repo_id, full_method ORDER BY imported_at, id) AS rn FROM chunks)",
)
def a32(spark, d):
    w = Window.partitionBy("repo_id", "full_method").orderBy("imported_at", "id")
    return table(spark, d, "chunks").select("id", (F.row_number().over(w) > 1).alias("dup"))


@R.query(
    "A33_rollup_cube",
    """SELECT repo_id, boundary_type, count(*) AS n, count(DISTINCT full_method) AS n_methods, grouping(repo_id) AS g1, grouping(boundary_type) AS g2 FROM boundaries GROUP BY CUBE (repo_id, boundary_type)""",
)
def a33(spark, d):
    return table(spark, d, "boundaries").cube("repo_id", "boundary_type").agg(
        F.count("*").alias("n"), F.count_distinct("full_method").alias("n_methods"),
        F.grouping("repo_id").cast("long").alias("g1"), F.grouping("boundary_type").cast("long").alias("g2"),
    )


@R.query("A33_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a33g(spark, d):
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@R.query("W02_sequence", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value FROM events")
def w02(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("seq"), "value")


@R.query("W04_W05_first_last", "SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def w04(spark, d):
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@R.query(
    "W06_near_top_of_run",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) <= 3 AS near_top FROM (SELECT *, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) WHERE event_type = 'view'""",
)
def w06(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("island", F.count_if(F.col("event_type") != "view").over(w)).where("event_type = 'view'")
    run = Window.partitionBy("user_id", "island").orderBy("ts", "event_id")
    return e.select("event_id", (F.row_number().over(run) <= 3).alias("near_top"))


@R.query(
    "W08_running_depth",
    """SELECT doc_id, CAST(max(depth) AS BIGINT) AS deepest FROM (SELECT doc_id, sum(d) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS depth FROM (
 SELECT doc_id, unnest(generate_series(1, len(l))) AS i, unnest(list_transform(l, lambda x: length(x) - length(replace(x, '(', '')) - length(x) + length(replace(x, ')', '')))) AS d FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))) GROUP BY 1""",
)
def w08(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    delta = F.length(F.replace("line", F.lit(")"), F.lit(""))) - F.length(F.replace("line", F.lit("("), F.lit("")))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return docs.select("doc_id", F.sum(delta).over(w).alias("depth")).groupBy("doc_id").agg(F.max("depth").alias("deepest"))


@R.query(
    "W09_contiguous_next",
    "SELECT event_id, CASE WHEN n_type <> 'view' AND n_id = event_id + 1 THEN n_id END AS next_id FROM (SELECT event_id, event_type, lead(event_type) OVER (ORDER BY event_id) AS n_type, lead(event_id) OVER (ORDER BY event_id) AS n_id FROM events) WHERE event_type = 'view'",
)
def w09(spark, d):
    # the next row is contiguous or none: a join on id + 1 needs no global order
    e = table(spark, d, "events")
    nxt = e.where("event_type <> 'view'").select(F.col("event_id").alias("next_id"), (F.col("event_id") - 1).alias("event_id"))
    return e.where("event_type = 'view'").select("event_id").join(nxt, "event_id", "left")


@R.query(
    "W10_look_ahead",
    """SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS soon FROM events""",
)
def w10(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 4)
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, d, "events").select("event_id", F.first(v, ignorenulls=True).over(w).alias("soon"))


@R.query(
    "W11_P25_layout",
    """WITH c AS (SELECT DISTINCT repo_id, package_name, class_name FROM chunks), r AS (SELECT repo_id, class_name, dense_rank() OVER (PARTITION BY repo_id ORDER BY package_name) - 1 AS p,
 row_number() OVER (PARTITION BY repo_id, package_name ORDER BY class_name) - 1 AS k, count(*) OVER (PARTITION BY repo_id, package_name) AS n FROM c)
SELECT repo_id, class_name, round(p * 100 + 40 * cos(2 * pi() * k / n), 6) AS x, round(40 * sin(2 * pi() * k / n), 6) AS y FROM r""",
)
def w11(spark, d):
    c = table(spark, d, "chunks").select("repo_id", "package_name", "class_name").distinct()
    p = F.dense_rank().over(Window.partitionBy("repo_id").orderBy("package_name")) - 1
    of = Window.partitionBy("repo_id", "package_name")
    r = c.select("repo_id", "class_name", p.alias("p"), (F.row_number().over(of.orderBy("class_name")) - 1).alias("k"), F.count("*").over(of).alias("n"))
    angle = 2 * F.pi() * F.col("k") / F.col("n")
    return r.select("repo_id", "class_name", F.round(F.col("p") * 100 + 40 * F.cos(angle), 6).alias("x"), F.round(40 * F.sin(angle), 6).alias("y"))


@R.query("O01_O02_top_k", "SELECT full_method, n FROM (SELECT full_method, count(*) AS n FROM boundaries WHERE full_method IS NOT NULL GROUP BY 1) ORDER BY n DESC, full_method LIMIT 20")
def o01(spark, d):
    b = table(spark, d, "boundaries").where("full_method is not null").groupBy("full_method").agg(F.count("*").alias("n"))
    return b.orderBy(F.desc("n"), "full_method").limit(20)


@R.query("O05_routes_first", "SELECT class_name, n_routes FROM (SELECT class_name, count(url_path) AS n_routes FROM api_endpoints GROUP BY 1) ORDER BY CASE WHEN n_routes = 0 THEN 1 ELSE 0 END, class_name")
def o05(spark, d):
    c = table(spark, d, "api_endpoints").groupBy("class_name").agg(F.count("url_path").alias("n_routes"))
    return c.orderBy(F.when(F.col("n_routes") == 0, 1).otherwise(0), "class_name")


@R.query("O06_O07_ordered_tail", "SELECT id, name FROM (SELECT id, name, row_number() OVER (ORDER BY created_at, id) - 1 AS idx FROM repositories) WHERE idx >= 50")
def o06(spark, d):
    r = table(spark, d, "repositories")  # 64 rows, fixed
    return r.withColumn("idx", F.row_number().over(Window.orderBy("created_at", "id")) - 1).where("idx >= 50").select("id", "name")


@R.query(
    "U01_U05_key_union",
    "SELECT repo_id, full_method FROM boundaries WHERE full_method IS NOT NULL UNION SELECT repo_id, full_method FROM method_return_const WHERE full_method IS NOT NULL",
)
def u01(spark, d):
    b, m = (table(spark, d, t).where("full_method is not null").select("repo_id", "full_method") for t in ("boundaries", "method_return_const"))
    return b.union(m).distinct()


@R.query(
    "U03_except",
    "SELECT repo_id, full_method FROM boundaries WHERE full_method IS NOT NULL EXCEPT SELECT repo_id, full_method FROM chunks",
)
def u03(spark, d):
    b, c = (table(spark, d, t).where("full_method is not null").select("repo_id", "full_method") for t in ("boundaries", "chunks"))
    return b.subtract(c)


@R.query(
    "U04_intersect",
    "SELECT repo_id, full_method FROM boundaries WHERE full_method IS NOT NULL INTERSECT SELECT repo_id, full_method FROM method_return_const",
)
def u04(spark, d):
    b, m = (table(spark, d, t).where("full_method is not null").select("repo_id", "full_method") for t in ("boundaries", "method_return_const"))
    return b.intersect(m)


@R.query("U06_composite_dedup", "SELECT repo_id, full_method, boundary_type, min(id) AS id FROM boundaries GROUP BY 1, 2, 3")
def u06(spark, d):
    return table(spark, d, "boundaries").groupBy("repo_id", "full_method", "boundary_type").agg(F.min("id").alias("id"))


@R.query(
    "U07_except_all",
    "SELECT repo_id, full_method FROM boundaries WHERE full_method IS NOT NULL EXCEPT ALL SELECT repo_id, full_method FROM method_return_const",
)
def u07(spark, d):
    b, m = (table(spark, d, t).where("full_method is not null").select("repo_id", "full_method") for t in ("boundaries", "method_return_const"))
    return b.exceptAll(m)
