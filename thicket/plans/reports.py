"""Report and relation queries: the rest of P, F, J, A, G, R and X over this project's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from thicket.functions import predicates as pr, sig
from thicket.operators import enrich, graph, logs, search, source
from thicket.plans import graph as G
from thicket.plans.registry import Registry
from thicket.plans.scalars import METHOD, words
from thicket.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query(
    "P20_listener_target",
    """SELECT id, coalesce('topic:' || nullif(split_part(url_path, '/', 3), ''), 'class:' || regexp_extract(class_name, '([^.]*)$', 1)) AS target FROM api_endpoints""",
)
def p20(spark, d):
    topic = F.concat(F.lit("topic:"), F.nullif(F.split_part("url_path", F.lit("/"), F.lit(3)), F.lit("")))
    return table(spark, d, "api_endpoints").select("id", F.coalesce(topic, F.concat(F.lit("class:"), sig.simple_class(F.col("class_name")))).alias("target"))


@R.query(
    "P23_A25_features",
    """SELECT split_part(url_path, '/', 2) AS module, CASE WHEN regexp_matches(url_path, 'list|find|page|query') THEN 'read' WHEN regexp_matches(url_path, 'save|add|submit|update') THEN 'write' ELSE 'other' END AS feature, count(*) AS n, count(DISTINCT class_name) AS n_classes
FROM api_endpoints WHERE url_path IS NOT NULL GROUP BY 1, 2""",
)
def p23(spark, d):
    u = F.col("url_path")
    feature = F.when(u.rlike("list|find|page|query"), "read").when(u.rlike("save|add|submit|update"), "write").otherwise("other")
    e = table(spark, d, "api_endpoints").where(u.isNotNull())
    return e.groupBy(F.split_part(u, F.lit("/"), F.lit(2)).alias("module"), feature.alias("feature")).agg(F.count("*").alias("n"), F.count_distinct("class_name").alias("n_classes"))


@R.query(
    "F13_outline_noise",
    f"""SELECT id, (full_method LIKE '%Logger:%' OR full_method LIKE '%LogFactory:%' OR starts_with(full_method, 'java.') OR regexp_matches({METHOD}, '^(get|set|is)[A-Z]')) AS noise FROM chunks""",
)
def f13(spark, d):
    m = F.col("full_method")
    noise = m.contains("Logger:") | m.contains("LogFactory:") | m.startswith("java.") | sig.method_name(m).rlike("^(get|set|is)[A-Z]")
    return table(spark, d, "chunks").select("id", noise.alias("noise"))


@R.query(
    "F18_content_type",
    r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN ((starts_with(t, '{') AND ends_with(t, '}')) OR (starts_with(t, '[') AND ends_with(t, ']'))) THEN CASE WHEN regexp_matches(b, '"(code|status|message|error)"') THEN 'JSON_RESPONSE' ELSE 'JSON_REQUEST' END
 ELSE 'MIXED_LOG' END AS kind FROM (SELECT b, trim(b) AS t FROM (SELECT unnest(request_chain).response_body AS b FROM request_chains) WHERE b IS NOT NULL)) GROUP BY 1""",
)
def f18(spark, d):
    b = table(spark, d, "request_chains").select(F.explode("request_chain.response_body").alias("b")).where("b is not null")
    return b.groupBy(logs.content_type(F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


@R.query("F21_related_settings", "SELECT id, name FROM repositories WHERE contains(lower(name), 'fleet') OR contains(lower(name), 'clinic') OR contains(lower(name), 'ward')")
def f21(spark, d):
    n = F.lower("name")
    return table(spark, d, "repositories").where(pr.any_of([F.contains(n, F.lit(w)) for w in ("fleet", "clinic", "ward")])).select("id", "name")


@R.query(
    "F25_slow_failures",
    "SELECT r.url AS url, count(*) AS n_slow, count(*) FILTER (WHERE NOT r.success) AS n_failed FROM (SELECT unnest(request_chain) AS r FROM request_chains) WHERE r.duration >= 500 GROUP BY 1",
)
def f25(spark, d):
    part = F.arrays_zip("request_chain.url", "request_chain.duration", "request_chain.success")
    r = table(spark, d, "request_chains").select(F.inline(part)).where("duration >= 500")
    return r.groupBy("url").agg(F.count("*").alias("n_slow"), F.count_if(~F.col("success")).alias("n_failed"))


@R.query(
    "J02_annotation_join",
    """WITH a AS (SELECT repo_id, full_method, list_sort(list(DISTINCT annotation_class)) AS own FROM api_endpoints WHERE annotation_class IS NOT NULL GROUP BY 1, 2),
b AS (SELECT repo_id, class_name, list_sort(list(DISTINCT annotation_class)) AS near FROM api_endpoints WHERE annotation_class IS NOT NULL GROUP BY 1, 2)
SELECT c.id, array_to_string(a.own, ',') AS own, len(b.near) AS n_class FROM chunks c LEFT JOIN a ON a.repo_id = c.repo_id AND a.full_method = c.full_method LEFT JOIN b ON b.repo_id = c.repo_id AND b.class_name = c.class_name""",
)
def j02(spark, d):
    e = table(spark, d, "api_endpoints").where("annotation_class is not null")
    a = e.groupBy("repo_id", "full_method").agg(F.array_join(F.array_sort(F.collect_set("annotation_class")), ",").alias("own"))
    b = e.groupBy("repo_id", "class_name").agg(F.count_distinct("annotation_class").alias("n_class"))
    c = table(spark, d, "chunks").select("id", "repo_id", "full_method", "class_name")
    return c.join(a, ["repo_id", "full_method"], "left").join(b, ["repo_id", "class_name"], "left").select("id", "own", "n_class")


@R.query(
    "J07_J08_relatives",
    """WITH u AS (SELECT DISTINCT repo_id, regexp_extract(caller_method, '^(.*):', 1) AS c, field_class AS f FROM static_field_usage WHERE caller_method IS NOT NULL AND field_class IS NOT NULL)
SELECT c.id, count(DISTINCT r.other) AS n_relatives FROM chunks c JOIN (SELECT repo_id, c AS class_name, f AS other FROM u UNION SELECT repo_id, f, c FROM u) r ON r.repo_id = c.repo_id AND r.class_name = c.class_name GROUP BY 1""",
)
def j07(spark, d):
    u = table(spark, d, "static_field_usage").where("caller_method is not null and field_class is not null")
    u = u.select("repo_id", sig.class_name(F.col("caller_method")).alias("class_name"), F.col("field_class").alias("other")).distinct()
    both = u.unionByName(u.select("repo_id", F.col("other").alias("class_name"), F.col("class_name").alias("other"))).groupBy("repo_id", "class_name").agg(F.count_distinct("other").alias("n_relatives"))
    return table(spark, d, "chunks").select("id", "repo_id", "class_name").join(both, ["repo_id", "class_name"]).select("id", "n_relatives")


@R.query("A14_boundaries_of_tree", f"WITH RECURSIVE {G._NODES}, {G._reach('caller', 'callee', 'valid', G.START_ORDER, 4)} SELECT b.mark, count(*) AS n, min(r.depth) AS nearest FROM reached r JOIN bounds b ON b.node = r.node GROUP BY 1")
def a14(spark, d):
    near = graph.reach(graph.arrows(graph.valid_edges(G.edges(spark, d))), G.start(spark, G.START_ORDER), 4)
    return near.join(G.bounds(spark, d), "node").groupBy("mark").agg(F.count("*").alias("n"), F.min("depth").alias("nearest"))


@R.query("A23_status_counts", "SELECT source, count(*) FILTER (WHERE contains(text, ' ERROR ')) AS n_error, count(*) FILTER (WHERE NOT contains(text, ' ERROR ')) AS n_ok, count(*) FILTER (WHERE text IS NULL) AS n_unknown FROM documents GROUP BY 1")
def a23(spark, d):
    hit = F.contains("text", F.lit(" ERROR "))
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(hit).alias("n_error"), F.count_if(~hit).alias("n_ok"), F.count_if(F.col("text").isNull()).alias("n_unknown"))


@R.query(
    "A26_first_constants",
    """SELECT field_class, string_agg(field_name, ',' ORDER BY field_name) AS names FROM (SELECT field_class, field_name, row_number() OVER (PARTITION BY field_class ORDER BY field_name) AS rk FROM (SELECT DISTINCT field_class, field_name FROM static_field_usage WHERE field_class IS NOT NULL AND field_name IS NOT NULL)) WHERE rk <= 30 GROUP BY 1""",
)
def a26(spark, d):
    u = table(spark, d, "static_field_usage").where("field_class is not null and field_name is not null").select("field_class", "field_name").distinct()
    w = Window.partitionBy("field_class").orderBy("field_name")
    return u.withColumn("rk", F.row_number().over(w)).where("rk <= 30").groupBy("field_class").agg(F.array_join(F.array_sort(F.collect_list("field_name")), ",").alias("names"))


@R.query(
    "A28_bullet_stats",
    """SELECT doc_id AS file_path, count(*) FILTER (WHERE l LIKE '+%' AND NOT l LIKE '+++%') AS added, count(*) FILTER (WHERE l LIKE '-%' AND NOT l LIKE '---%') AS removed FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
)
def a28(spark, d):
    docs = table(spark, d, "documents").select(F.lit(0).alias("repo_id"), F.col("doc_id").alias("file_path"), "text")
    return source.diff_stats(source.lines_of(docs)).drop("repo_id")


@R.query("A30_line_ranges", "SELECT repo_id, caller_method, min(line_num) AS first_line, max(line_num) AS last_line, count(DISTINCT line_num) AS n_lines FROM static_field_usage WHERE caller_method IS NOT NULL GROUP BY 1, 2")
def a30(spark, d):
    return table(spark, d, "static_field_usage").where("caller_method is not null").groupBy("repo_id", "caller_method").agg(
        F.min("line_num").alias("first_line"), F.max("line_num").alias("last_line"), F.count_distinct("line_num").alias("n_lines")
    )


@R.query(
    "O08_capped_levels",
    f"""WITH RECURSIVE {G._NODES}, {G._reach('callee', 'caller', 'edges', G.START_SUPPLIER, 3)}, c AS (SELECT depth, count(*) AS n FROM reached GROUP BY 1)
SELECT depth, n, CAST(sum(n) OVER (ORDER BY depth) AS BIGINT) AS upto, sum(n) OVER (ORDER BY depth) > 500 AS truncated FROM c""",
)
def o08(spark, d):
    near = graph.reach(graph.arrows(G.edges(spark, d), upward=True), G.start(spark, G.START_SUPPLIER), 3)
    levels = near.groupBy("depth").agg(F.count("*").alias("n"))  # one row per level
    upto = F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    return levels.select("depth", "n", upto.alias("upto"), (upto > 500).alias("truncated"))


@R.query(
    "G05_boundary_load",
    """SELECT repo_id, full_method, boundary_type AS kind, context AS what FROM boundaries WHERE full_method IS NOT NULL AND boundary_type IN ('HTTP', 'GRPC', 'DB', 'MQ', 'CACHE', 'FILE')
UNION SELECT c.repo_id, c.full_method, 'HTTP', c.resolved_urls FROM chunks c WHERE c.resolved_urls IS NOT NULL AND NOT EXISTS (SELECT 1 FROM boundaries b WHERE b.repo_id = c.repo_id AND b.full_method = c.full_method AND contains(b.context, c.resolved_urls))""",
)
def g05(spark, d):
    b = table(spark, d, "boundaries").where("full_method is not null")
    own = b.where(F.col("boundary_type").isin("HTTP", "GRPC", "DB", "MQ", "CACHE", "FILE")).select("repo_id", "full_method", F.col("boundary_type").alias("kind"), F.col("context").alias("what"))
    c, o = table(spark, d, "chunks").where("resolved_urls is not null").alias("c"), b.alias("o")
    same = (F.col("c.repo_id") == F.col("o.repo_id")) & (F.col("c.full_method") == F.col("o.full_method")) & F.contains("o.context", F.col("c.resolved_urls"))
    urls = c.join(o, same, "left_anti").select("repo_id", "full_method", F.lit("HTTP").alias("kind"), F.col("resolved_urls").alias("what"))
    return own.unionByName(urls).distinct()


@R.query(
    "G14_G16_paths_and_cycles",
    f"""WITH RECURSIVE {G._NODES}, s AS (SELECT DISTINCT caller, callee FROM valid), p AS (SELECT '{G.START_ORDER}' AS node, ['{G.START_ORDER}'] AS path, 0 AS depth UNION ALL SELECT s.callee, list_append(p.path, s.callee), p.depth + 1 FROM p JOIN s ON s.caller = p.node WHERE p.depth < 3 AND NOT list_contains(p.path, s.callee))
SELECT depth, count(*) AS n_paths, count(DISTINCT node) AS n_nodes FROM p GROUP BY 1""",
)
def g14(spark, d):
    paths = graph.simple_paths(graph.arrows(graph.valid_edges(G.edges(spark, d))), G.start(spark, G.START_ORDER), 3)
    return paths.groupBy("depth").agg(F.count("*").alias("n_paths"), F.count_distinct("node").alias("n_nodes"))


@R.query(
    "G20_constants_of_methods",
    """SELECT repo_id, full_method, array_to_string(list_sort(list(DISTINCT v)), ',') AS constants FROM (SELECT repo_id, full_method, unnest(string_split(constants, chr(10))) AS v FROM chunks WHERE constants IS NOT NULL) WHERE v <> '' GROUP BY 1, 2""",
)
def g20(spark, d):
    c = table(spark, d, "chunks").where("constants is not null").select("repo_id", "full_method", F.explode(F.split("constants", "\n")).alias("v")).where("v <> ''")
    return c.groupBy("repo_id", "full_method").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("constants"))


@R.query(
    "J03_C6_json_lists",
    """SELECT repo_id, caller_method, CAST(to_json(list(field_name ORDER BY rk)) AS VARCHAR) AS fields FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, caller_method ORDER BY o, field_name) AS rk FROM (SELECT repo_id, caller_method, field_name, min(id) AS o FROM static_field_usage WHERE field_name IS NOT NULL AND caller_method IS NOT NULL GROUP BY 1, 2, 3)) WHERE rk <= 30 GROUP BY 1, 2""",
)
def c6(spark, d):
    u = table(spark, d, "static_field_usage").where("caller_method is not null")
    return enrich.json_lists(u, ["repo_id", "caller_method"], "field_name", "id", 30).select("repo_id", "caller_method", F.col("values").alias("fields"))


@R.query(
    "R07_candidate_pool",
    """WITH seed AS (SELECT DISTINCT repo_id, class_name, split_part(url_path, '/', 2) AS seg FROM api_endpoints WHERE contains(url_path, 'order'))
SELECT DISTINCT e.id FROM api_endpoints e WHERE EXISTS (SELECT 1 FROM seed s WHERE s.seg = split_part(e.url_path, '/', 2)) OR EXISTS (SELECT 1 FROM seed s WHERE s.repo_id = e.repo_id AND s.class_name = e.class_name)""",
)
def r07(spark, d):
    e = table(spark, d, "api_endpoints").withColumn("seg", F.split_part("url_path", F.lit("/"), F.lit(2)))
    seed = e.where(F.contains("url_path", F.lit("order")))
    near = e.join(seed.select("seg").where("seg is not null"), "seg", "left_semi").select("id")
    return near.union(e.join(seed.select("repo_id", "class_name"), ["repo_id", "class_name"], "left_semi").select("id")).distinct()


@R.query(
    "R08_confidence_gates",
    f"""WITH s AS (SELECT id, CASE WHEN contains(lower(url_path), 'list') THEN 50 ELSE 0 END + CASE WHEN contains(lower(regexp_extract(class_name, '([^.]*)$', 1)), 'ticket') THEN 30 ELSE 0 END AS score FROM api_endpoints), t AS (SELECT score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10)
SELECT max(score) >= 80 AS sure, coalesce(max(score), 0) < 30 AS ask, min(score) >= 0.6 * max(score) AS alike FROM t""",
)
def r08(spark, d):
    c = search.keyword_score(["list"], [(F.col("url_path"), 50, 1)]) + search.keyword_score(["ticket"], [(sig.simple_class(F.col("class_name")), 30, 1)])
    top = search.best(table(spark, d, "api_endpoints"), c, 10, "id")
    most, least = F.max("score"), F.min("score")
    return top.agg((most >= 80).alias("sure"), (F.coalesce(most, F.lit(0)) < 30).alias("ask"), (least >= 0.6 * most).alias("alike"))


@R.query("R21_folder_listing", "SELECT DISTINCT repo_id, regexp_extract(file_path, '^(.*)/', 1) AS folder, regexp_extract(file_path, '([^/]*)$', 1) AS name FROM chunks WHERE file_path IS NOT NULL")
def r21(spark, d):
    f = F.col("file_path")
    return table(spark, d, "chunks").where(f.isNotNull()).select("repo_id", F.regexp_extract(f, "^(.*)/", 1).alias("folder"), F.regexp_extract(f, "([^/]*)$", 1).alias("name")).distinct()


@R.query(
    "X24_X31_boundary_rules",
    f"""WITH c AS (SELECT full_method AS caller, callee_method AS callee, line_number, regexp_extract(callee_method, '^(.*):', 1) AS cls FROM boundaries WHERE callee_method IS NOT NULL AND full_method IS NOT NULL)
SELECT caller, callee, CASE WHEN cls LIKE '%Client' THEN 'HTTP' WHEN cls LIKE '%Mapper' THEN 'DB' END AS boundary_type, min(line_number) AS line_number FROM c WHERE (cls LIKE '%Client' OR cls LIKE '%Mapper') GROUP BY 1, 2, 3""",
)
def x31(spark, d):
    calls = table(spark, d, "boundaries").where("callee_method is not null and full_method is not null").select(F.col("full_method").alias("caller"), F.col("callee_method").alias("callee"), "line_number")
    return enrich.detect_boundaries(calls)


@R.query(
    "X23_method_import",
    f"""SELECT DISTINCT full_method, regexp_extract(full_method, '^(.*):', 1) AS class_name, {METHOD} AS method_name FROM chunks WHERE NOT (class_name LIKE '%$Builder' OR class_name LIKE '%OrBuilder' OR {METHOD} IN {words(pr.GENERATED_METHODS)})""",
)
def x23(spark, d):
    c = table(spark, d, "chunks").select("full_method", F.col("access_flags").alias("flags"))
    return enrich.import_methods(c).select("full_method", "class_name", "method_name")


@R.query(
    "T03_changed_since",
    """SELECT repo_id, full_method, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT repo_id, full_method, max(method_hash) AS a FROM chunks WHERE imported_at < TIMESTAMP '2025-06-01 00:00:00' GROUP BY 1, 2) FULL JOIN
(SELECT repo_id, full_method, max(method_hash) AS b FROM chunks WHERE deleted_at IS NULL GROUP BY 1, 2) USING (repo_id, full_method) WHERE a IS DISTINCT FROM b""",
)
def t03(spark, d):
    c = table(spark, d, "chunks").select("repo_id", F.col("full_method").alias("file_path"), "method_hash", "imported_at", "deleted_at")
    state = lambda df: df.groupBy("repo_id", "file_path").agg(F.max("method_hash").alias("hash"))
    old, new = c.where(F.col("imported_at") < F.lit("2025-06-01 00:00:00").cast("timestamp")), c.where("deleted_at is null")
    return source.changed_files(state(old), state(new)).withColumnRenamed("file_path", "full_method")
