"""Stored tables and reports over them (S, K, J, A, G, R and X): scans by key, upserts, deletions, marks, overviews, rows of trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket.functions import sig
from thicket.operators import graph, store
from thicket.plans import graph as G
from thicket.plans.registry import Registry
from thicket.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

_SPLIT = "2025-07-01 00:00:00"
_ID = "md5(c.repo_id || ':' || c.full_method)"
_UUID = f"substr({_ID}, 1, 8) || '-' || substr({_ID}, 9, 4) || '-' || substr({_ID}, 13, 4) || '-' || substr({_ID}, 17, 4) || '-' || substr({_ID}, 21, 12)"


@R.query("S17_find_by", "SELECT id FROM boundaries WHERE boundary_type IN ('DB', 'HTTP') AND line_number IS NULL")
def s17(spark, d):
    return store.find_by(table(spark, d, "boundaries"), boundary_type=["DB", "HTTP"], line_number=None).select("id")


@R.query(
    "K02_K05_vector_upsert",
    f"""SELECT {_UUID} AS point_id, max_by(method_hash, imported_at) AS method_hash, count(*) - 1 AS n_replaced FROM (SELECT repo_id, full_method, method_hash, imported_at, id,
 row_number() OVER (PARTITION BY repo_id, full_method, imported_at >= TIMESTAMP '{_SPLIT}' ORDER BY imported_at DESC, id DESC) AS rk FROM chunks) c WHERE rk = 1 GROUP BY 1""",
)
def k05(spark, d):
    """Points of the methods known before an import, and of those that it brings: ids follow from the key, so that a method replaces itself."""
    c = table(spark, d, "chunks").select(store.point_id(F.col("repo_id"), F.col("full_method")).alias("point_id"), "method_hash", F.struct("imported_at", "id").alias("at"))
    late = F.col("at.imported_at") >= F.lit(_SPLIT).cast("timestamp")
    last = lambda df: df.groupBy("point_id").agg(F.max_by("method_hash", "at").alias("method_hash"), F.max("at").alias("at"))
    old, new = last(c.where(~late)).withColumn("n_replaced", F.lit(0).cast("long")), c.where(late)
    known = old.select("point_id", F.lit(1).alias("k"))
    fresh = last(new).join(known, "point_id", "left").select("point_id", "method_hash", "at", F.coalesce("k", F.lit(0)).cast("long").alias("n_replaced"))
    return store.upsert(old, fresh, ["point_id"]).select("point_id", "method_hash", "n_replaced")


@R.query(
    "K06_J27_cascade",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t} WHERE repo_id IS NULL OR repo_id NOT IN (SELECT id FROM repositories WHERE deleted_at IS NOT NULL)" for t in ("chunks", "boundaries", "api_endpoints", "jar_info")),
)
def k06(spark, d):
    """Rows per table that stay when the removed repositories take theirs along."""
    gone = table(spark, d, "repositories").where("deleted_at is not null")
    parts = [store.without_parents(table(spark, d, t), "repo_id", gone, "id").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("chunks", "boundaries", "api_endpoints", "jar_info")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@R.query(
    "K07_status_update",
    """SELECT id, CASE WHEN EXISTS (SELECT 1 FROM boundaries b WHERE b.repo_id = c.repo_id AND b.full_method = c.full_method) THEN 'PENDING' ELSE embedding_status END AS embedding_status FROM chunks c""",
)
def k07(spark, d):
    """Methods with boundaries are to be embedded again."""
    c, key = table(spark, d, "chunks"), ["repo_id", "full_method"]
    ids = c.join(table(spark, d, "boundaries").select(*key), key, "left_semi").select("id")
    return store.mark(c, ids, "id", "embedding_status", "PENDING").select("id", "embedding_status")


@R.query("K11_truncation", "SELECT id, left(annotations, 40) AS annotations, left(parameters, 20) AS parameters FROM chunks")
def k11(spark, d):
    return store.truncated(table(spark, d, "chunks").select("id", "annotations", "parameters"), {"annotations": 40, "parameters": 20})


@R.query(
    "K10_markdown_rows",
    r"""SELECT id, '| ' || coalesce(endpoint_type, '') || ' | ' || coalesce(http_method, '') || ' | ' || coalesce(regexp_replace(replace(url_path, '|', '\|'), '[\r\n]+', ' ', 'g'), '') || ' |' AS line FROM api_endpoints""",
)
def k10(spark, d):
    return table(spark, d, "api_endpoints").select("id", store.markdown_row(F.col("endpoint_type"), F.col("http_method"), F.col("url_path")).alias("line"))


@R.query(
    "A27_overview",
    """SELECT repo_id, 'endpoint' AS section, coalesce(endpoint_type, '') AS item, count(*) AS n FROM api_endpoints GROUP BY ALL
UNION ALL SELECT repo_id, 'boundary', coalesce(boundary_type, ''), count(DISTINCT coalesce(full_method, '') || '>' || coalesce(context, '')) FROM boundaries GROUP BY ALL
UNION ALL SELECT repo_id, 'package', coalesce(package_name, ''), count(DISTINCT class_name) FROM chunks GROUP BY ALL""",
)
def a27(spark, d):
    """Per repository: endpoints by type, external systems by type, classes by package."""
    item = lambda c: F.coalesce(c, F.lit(""))
    e = table(spark, d, "api_endpoints").groupBy("repo_id", item("endpoint_type").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("endpoint"))
    what = F.concat(item("full_method"), F.lit(">"), item("context"))
    b = table(spark, d, "boundaries").groupBy("repo_id", item("boundary_type").alias("item")).agg(F.count_distinct(what).alias("n")).withColumn("section", F.lit("boundary"))
    p = table(spark, d, "chunks").groupBy("repo_id", item("package_name").alias("item")).agg(F.count_distinct("class_name").alias("n")).withColumn("section", F.lit("package"))
    return e.unionByName(b).unionByName(p).select("repo_id", "section", "item", "n")


@R.query(
    "A34_endpoints_by_class",
    """SELECT class_name, regexp_extract(class_name, '([^.]*)$', 1) AS short_name, string_agg(id, ',' ORDER BY id) AS endpoint_ids FROM api_endpoints WHERE class_name IS NOT NULL GROUP BY ALL ORDER BY 2, 1""",
)
def a34(spark, d):
    e = table(spark, d, "api_endpoints").where("class_name is not null").groupBy("class_name").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("endpoint_ids"))
    return e.select("class_name", sig.simple_class(F.col("class_name")).alias("short_name"), "endpoint_ids").orderBy("short_name", "class_name")


@R.query(
    "X29_error_codes",
    """SELECT id, (i)::INT AS pos, x ->> '$.code' AS code, coalesce(x ->> '$.message', x ->> '$') AS message FROM (
 SELECT id, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM (SELECT id, CASE json_type(error_codes) WHEN 'ARRAY' THEN error_codes::JSON[] ELSE [error_codes::JSON] END AS v FROM chunks WHERE json_valid(error_codes)))""",
)
def x29(spark, d):
    """Error codes and messages of methods, whether a list, one object or one text."""
    v = F.try_parse_json("error_codes")
    each = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    rows = table(spark, d, "chunks").withColumn("v", v).where("v is not null").select("id", F.posexplode(each).alias("i", "x"))
    text = lambda path: F.try_variant_get("x", path, "string")
    whole = F.coalesce(text("$"), F.to_json("x"))
    return rows.select("id", (F.col("i") + 1).alias("pos"), text("$.code").alias("code"), F.coalesce(text("$.message"), whole).alias("message"))


_TREE = G._reach("caller", "callee", "valid", G.START_ORDER, 5)


@R.query(
    "R17_tree_reports",
    f"""WITH RECURSIVE {G._NODES}, {_TREE} SELECT r.node, count(*) FILTER (WHERE mark IN ('EXCEPTION', 'HTTP', 'GRPC', 'DB')) AS n_risks, count(*) FILTER (WHERE mark = 'DB') AS n_db, count(*) FILTER (WHERE mark <> 'DB') AS n_external
FROM reached r JOIN bounds b ON b.node = r.node GROUP BY 1""",
)
def r17(spark, d):
    """Preset reports over a method's tree of depth 5: risks, database operations, external calls of each of its methods."""
    near = graph.reach(graph.arrows(graph.valid_edges(G.edges(spark, d))), G.start(spark, G.START_ORDER), 5)
    b = near.select("node").join(G.bounds(spark, d), "node")
    risk = F.col("mark").isin("EXCEPTION", "HTTP", "GRPC", "DB")
    return b.groupBy("node").agg(F.count_if(risk).alias("n_risks"), F.count_if(F.col("mark") == "DB").alias("n_db"), F.count_if(F.col("mark") != "DB").alias("n_external"))


@R.query(
    "G06_impact_rows",
    f"""WITH RECURSIVE {G._NODES}, {G._reach('callee', 'caller', 'valid', G.START_SUPPLIER, 4, "AND (r.depth = 0 OR NOT EXISTS (SELECT 1 FROM endpoints x WHERE x.full_method = r.node))")}
SELECT n.repo_id, r.node AS full_method, r.depth, p.endpoint_type FROM reached r JOIN nodes n ON n.node = r.node LEFT JOIN endpoints p ON p.full_method = r.node""",
)
def g06(spark, d):
    """Every method that a change reaches, with its repository and, where the way ends there, its endpoint."""
    ep = G.endpoints(spark, d)
    up = graph.arrows(graph.valid_edges(G.edges(spark, d)), upward=True)
    hit = graph.reach(up, G.start(spark, G.START_SUPPLIER), 4, stops=ep.select(F.col("full_method").alias("node"))).withColumnRenamed("node", "full_method")
    return hit.join(G.nodes(spark, d), "full_method").join(ep.select("full_method", "endpoint_type"), "full_method", "left").select("repo_id", "full_method", "depth", "endpoint_type")


@R.query(
    "G08_cross_repo_rows",
    f"""WITH RECURSIVE {G._NODES}, {G._reach('caller', 'callee', 'valid', G.START_ORDER, 3)}
SELECT v.caller, v.callee, r.depth, a.repo_id AS from_repo, b.repo_id AS to_repo, a.repo_id <> b.repo_id AS crosses FROM (SELECT DISTINCT caller, callee FROM valid) v JOIN reached r ON r.node = v.caller JOIN nodes a ON a.node = v.caller JOIN nodes b ON b.node = v.callee""",
)
def g08(spark, d):
    """Every edge of the tree with the repositories of its ends."""
    t = graph.tree_edges(graph.valid_edges(G.edges(spark, d)).select("caller", "callee").distinct(), G.start(spark, G.START_ORDER), 4)
    n = G.nodes(spark, d)
    side = lambda end, repo: n.select(F.col("full_method").alias(end), F.col("repo_id").alias(repo))
    both = t.join(side("caller", "from_repo"), "caller").join(side("callee", "to_repo"), "callee")
    return both.select("caller", "callee", "depth", "from_repo", "to_repo", (F.col("from_repo") != F.col("to_repo")).alias("crosses"))
