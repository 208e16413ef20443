"""Graph queries (G) over a call graph derived from the driver's tables.

Regions call nations, nations customers, customers orders, orders parts, parts
suppliers, and suppliers nations again, which closes cycles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket.functions import sig
from thicket.operators import graph, topology
from thicket.plans.registry import Registry
from thicket.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

START_ORDER = "oms.order.O1:place(int,int)"
START_SUPPLIER = "scm.supplier.S1:ship(int)"

_NODES = """
part_n AS (SELECT p_partkey, 'cat.part.P' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ':getPrice()' ELSE ':pack(int)' END AS node FROM part),
cust_n AS (SELECT c_custkey, c_nationkey, c_mktsegment, n_regionkey AS repo_id, 'crm.customer.C' || c_custkey || ':handle(int)' AS node FROM customer JOIN nation ON n_nationkey = c_nationkey),
ord_n AS (SELECT o_orderkey, o_orderpriority, repo_id, cust_n.node AS cust, 'oms.order.O' || o_orderkey || ':place(int,int)' AS node FROM orders JOIN cust_n ON c_custkey = o_custkey),
sup_n AS (SELECT s_suppkey, s_nationkey, n_regionkey AS repo_id, 'scm.supplier.S' || s_suppkey || ':ship(int)' AS node FROM supplier JOIN nation ON n_nationkey = s_nationkey),
line AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS line, max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
ps AS (SELECT l_partkey, l_suppkey, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2),
nodes AS (
 SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS repo_id, 'geo.region.R' || n_regionkey || ':open()' AS node FROM nation
 UNION ALL SELECT n_regionkey, 'geo.nation.N' || n_nationkey || ':route(int)' FROM nation
 UNION ALL SELECT repo_id, node FROM cust_n UNION ALL SELECT repo_id, node FROM ord_n UNION ALL SELECT p_partkey % 5, node FROM part_n UNION ALL SELECT repo_id, node FROM sup_n),
edges AS (
 SELECT CAST(n_regionkey AS BIGINT) AS repo_id, 'geo.region.R' || n_regionkey || ':open()' AS caller, 'geo.nation.N' || n_nationkey || ':route(int)' AS callee, 'VIR' AS call_type, true AS enabled, n_nationkey AS line FROM nation
 UNION ALL SELECT repo_id, 'geo.nation.N' || c_nationkey || ':route(int)', node, 'VIR', true, 1 FROM cust_n
 UNION ALL SELECT repo_id, cust, node, 'VIR', true, 1 FROM ord_n
 UNION ALL SELECT o.repo_id, o.node, p.node, CASE f WHEN 'A' THEN 'VIR' WHEN 'N' THEN 'INT' ELSE 'IMPLEMENTS' END, s = 'F', line FROM line JOIN ord_n o ON o_orderkey = l_orderkey JOIN part_n p ON p_partkey = l_partkey
 UNION ALL SELECT l_partkey % 5, p.node, s.node, 'VIR', true, line FROM ps JOIN part_n p ON p_partkey = l_partkey JOIN sup_n s ON s_suppkey = l_suppkey
 UNION ALL SELECT repo_id, node, 'geo.nation.N' || s_nationkey || ':route(int)', 'VIR', true, 1 FROM sup_n),
valid AS (SELECT * FROM edges WHERE enabled AND call_type NOT IN ('EXTENDS', 'IMPLEMENTS') AND callee NOT LIKE '%:get%()'),
endpoints AS (SELECT repo_id, node AS full_method, 'CONTROLLER' AS endpoint_type FROM ord_n WHERE o_orderpriority LIKE '1%' UNION ALL SELECT repo_id, node, 'KAFKA' FROM sup_n WHERE s_suppkey % 10 = 0),
bounds AS (SELECT node, 'DB' AS mark FROM part_n UNION ALL SELECT node, 'HTTP' FROM sup_n UNION ALL SELECT node, 'CACHE' FROM cust_n WHERE c_mktsegment = 'BUILDING')"""


def _with(spark, d):
    """The derived relations as DataFrames."""
    t = lambda name: table(spark, d, name)
    cat = F.concat
    part = t("part").select("p_partkey", cat(F.lit("cat.part.P"), "p_partkey", F.when(F.col("p_size") % 2 == 0, ":getPrice()").otherwise(":pack(int)")).alias("node"))
    nation = t("nation").withColumn("repo_id", F.col("n_regionkey").cast("long"))
    nnode = lambda c: cat(F.lit("geo.nation.N"), c, F.lit(":route(int)"))
    cust = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_nationkey", "c_mktsegment", "repo_id", cat(F.lit("crm.customer.C"), "c_custkey", F.lit(":handle(int)")).alias("node")
    )
    order = t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderpriority", "repo_id", F.col("node").alias("cust"), cat(F.lit("oms.order.O"), "o_orderkey", F.lit(":place(int,int)")).alias("node")
    )
    sup = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_nationkey", "repo_id", cat(F.lit("scm.supplier.S"), "s_suppkey", F.lit(":ship(int)")).alias("node")
    )
    return part, nation, nnode, cust, order, sup


def edges(spark, d):
    """Call edges: repo_id, caller, callee, call_type, enabled, line."""
    part, nation, nnode, cust, order, sup = _with(spark, d)
    l = table(spark, d, "lineitem")
    vir, on = F.lit("VIR").alias("call_type"), F.lit(True).alias("enabled")
    region = F.concat(F.lit("geo.region.R"), "n_regionkey", F.lit(":open()"))
    line = l.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"), F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))
    ps = l.groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))
    kind = F.when(F.col("f") == "A", "VIR").when(F.col("f") == "N", "INT").otherwise("IMPLEMENTS").alias("call_type")
    o, p, s = order.alias("o"), part.alias("p"), sup.alias("s")
    parts = [
        nation.select("repo_id", region.alias("caller"), nnode(F.col("n_nationkey")).alias("callee"), vir, on, F.col("n_nationkey").alias("line")),
        cust.select("repo_id", nnode(F.col("c_nationkey")).alias("caller"), F.col("node").alias("callee"), vir, on, F.lit(1).alias("line")),
        order.select("repo_id", F.col("cust").alias("caller"), F.col("node").alias("callee"), vir, on, F.lit(1).alias("line")),
        line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
            "o.repo_id", F.col("o.node").alias("caller"), F.col("p.node").alias("callee"), kind, (F.col("s") == "F").alias("enabled"), "line"
        ),
        ps.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
            (F.col("l_partkey") % 5).alias("repo_id"), F.col("p.node").alias("caller"), F.col("s.node").alias("callee"), vir, on, "line"
        ),
        sup.select("repo_id", F.col("node").alias("caller"), nnode(F.col("s_nationkey")).alias("callee"), vir, on, F.lit(1).alias("line")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def nodes(spark, d):
    part, nation, nnode, cust, order, sup = _with(spark, d)
    region = F.concat(F.lit("geo.region.R"), "n_regionkey", F.lit(":open()"))
    out = nation.select("repo_id", region.alias("full_method")).distinct().unionByName(nation.select("repo_id", nnode(F.col("n_nationkey")).alias("full_method")))
    for x in (cust, order, part.withColumn("repo_id", F.col("p_partkey") % 5), sup):
        out = out.unionByName(x.select("repo_id", F.col("node").alias("full_method")))
    return out


def endpoints(spark, d):
    *_, order, sup = _with(spark, d)
    a = order.where("o_orderpriority like '1%'").select("repo_id", F.col("node").alias("full_method"), F.lit("CONTROLLER").alias("endpoint_type"))
    return a.unionByName(sup.where("s_suppkey % 10 = 0").select("repo_id", F.col("node").alias("full_method"), F.lit("KAFKA").alias("endpoint_type")))


def bounds(spark, d):
    part, _, _, cust, _, sup = _with(spark, d)
    out = part.select("node", F.lit("DB").alias("mark")).unionByName(sup.select("node", F.lit("HTTP").alias("mark")))
    return out.unionByName(cust.where("c_mktsegment = 'BUILDING'").select("node", F.lit("CACHE").alias("mark")))


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def _reach(src: str, dst: str, frm: str, begin: str, depth: int, stop: str = "") -> str:
    return f"""r AS (SELECT '{begin}' AS node, 0 AS depth UNION SELECT e.{dst}, r.depth + 1 FROM r JOIN {frm} e ON e.{src} = r.node WHERE r.depth < {depth} {stop}),
reached AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)"""


@R.query("G01_callees", f"WITH {_NODES} SELECT DISTINCT caller, callee, call_type FROM valid WHERE caller IN ('{START_ORDER}', '{START_SUPPLIER}')")
def g01(spark, d):
    e = edges(spark, d)
    inheritance = e.where("call_type = 'IMPLEMENTS'").select(sig.class_name(F.col("caller")).alias("child"), sig.class_name(F.col("callee")).alias("parent"))
    return graph.callees(e, start(spark, START_ORDER, START_SUPPLIER), inheritance, nodes(spark, d))


@R.query("G02_callers_depth", f"WITH RECURSIVE {_NODES}, {_reach('callee', 'caller', 'edges', START_SUPPLIER, 3)} SELECT node, depth FROM reached")
def g02(spark, d):
    return graph.reach(graph.arrows(edges(spark, d), upward=True), start(spark, START_SUPPLIER), 3)


@R.query("G03_call_tree_edges", f"WITH RECURSIVE {_NODES}, {_reach('caller', 'callee', 'valid', START_ORDER, 3)} SELECT DISTINCT v.caller, v.callee, v.call_type, r.depth FROM valid v JOIN reached r ON r.node = v.caller")
def g03(spark, d):
    return graph.tree_edges(graph.valid_edges(edges(spark, d)), start(spark, START_ORDER), 4).select("caller", "callee", "call_type", "depth").distinct()


@R.query("G03_call_tree")
def g03t(spark, d):
    """The same tree in visiting order, as rows; its shape follows the depth-first rules, which SQL has no words for."""
    rows = graph.assemble_tree(graph.valid_edges(edges(spark, d)), START_ORDER, 3, cap=500, order=("line",))
    return spark.createDataFrame([(i, r["node"], r["parent"], r["depth"], r["recursive"], r["lazy"]) for i, r in enumerate(rows)], "pos int, node string, parent string, depth int, recursive boolean, lazy boolean")


@R.query("G04_reachable_boundaries", f"WITH RECURSIVE {_NODES}, {_reach('caller', 'callee', 'valid', START_ORDER, 4)} SELECT r.node, r.depth, b.mark FROM reached r JOIN bounds b ON b.node = r.node")
def g04(spark, d):
    near = graph.reach(graph.arrows(graph.valid_edges(edges(spark, d))), start(spark, START_ORDER), 4)
    return near.join(bounds(spark, d), "node")


@R.query(
    "G06_A10_impact",
    f"""WITH RECURSIVE {_NODES}, {_reach('callee', 'caller', 'valid', START_SUPPLIER, 4, "AND (r.depth = 0 OR NOT EXISTS (SELECT 1 FROM endpoints x WHERE x.full_method = r.node))")}
SELECT n.repo_id, count(*) AS n_methods, count(p.full_method) AS n_endpoints, max(depth) AS deepest FROM reached r JOIN nodes n ON n.node = r.node LEFT JOIN endpoints p ON p.full_method = r.node GROUP BY 1""",
)
def g06(spark, d):
    return _impact(spark, d, 4)


def _impact(spark, d, depth):
    ep = endpoints(spark, d)
    up = graph.arrows(graph.valid_edges(edges(spark, d)), upward=True)
    hit = graph.reach(up, start(spark, START_SUPPLIER), depth, stops=ep.select(F.col("full_method").alias("node")))
    hit = hit.withColumnRenamed("node", "full_method").join(nodes(spark, d), "full_method").join(ep.select("full_method", "endpoint_type"), "full_method", "left")
    return hit.groupBy("repo_id").agg(F.count("*").alias("n_methods"), F.count("endpoint_type").alias("n_endpoints"), F.max("depth").alias("deepest"))


@R.query(
    "G08_cross_repo_hops",
    f"""WITH RECURSIVE {_NODES}, {_reach('caller', 'callee', 'valid', START_ORDER, 3)}
SELECT r.depth, a.repo_id AS from_repo, b.repo_id AS to_repo, count(*) AS n FROM (SELECT DISTINCT caller, callee FROM valid) v JOIN reached r ON r.node = v.caller JOIN nodes a ON a.node = v.caller JOIN nodes b ON b.node = v.callee WHERE a.repo_id <> b.repo_id GROUP BY ALL""",
)
def g08(spark, d):
    t = graph.tree_edges(graph.valid_edges(edges(spark, d)).select("caller", "callee").distinct(), start(spark, START_ORDER), 4)
    n = nodes(spark, d)
    a, b = n.select(F.col("full_method").alias("caller"), F.col("repo_id").alias("from_repo")), n.select(F.col("full_method").alias("callee"), F.col("repo_id").alias("to_repo"))
    return t.join(a, "caller").join(b, "callee").where("from_repo <> to_repo").groupBy("depth", "from_repo", "to_repo").agg(F.count("*").alias("n"))


@R.query(
    "G09_upstream_paths",
    f"""WITH RECURSIVE {_NODES}, p AS (SELECT '{START_ORDER}' AS node, 0 AS depth, ['{START_ORDER}'] AS path UNION ALL
SELECT e.caller, p.depth + 1, list_append(p.path, e.caller) FROM p JOIN (SELECT DISTINCT caller, callee FROM edges) e ON e.callee = p.node WHERE p.depth < 3 AND NOT list_contains(p.path, e.caller))
SELECT node, depth, array_to_string(path, '<') AS path FROM p""",
)
def g09(spark, d):
    paths = graph.simple_paths(graph.arrows(edges(spark, d), upward=True), start(spark, START_ORDER), 3)
    return paths.select("node", "depth", F.array_join("path", "<").alias("path"))


@R.query("G02_callers_depth_10", f"WITH RECURSIVE {_NODES}, {_reach('callee', 'caller', 'edges', START_SUPPLIER, 10)} SELECT node, depth FROM reached")
def g02_10(spark, d):
    return graph.reach(graph.arrows(edges(spark, d), upward=True), start(spark, START_SUPPLIER), 10)


@R.query("G03_call_tree_10")
def g03t_10(spark, d):
    """G03_call_tree with the engine's depth and cap; it meets the graph's cycles."""
    rows = graph.assemble_tree(graph.valid_edges(edges(spark, d)), START_ORDER, 10, cap=8000, order=("line",))
    return spark.createDataFrame([(i, r["node"], r["parent"], r["depth"], r["recursive"], r["lazy"]) for i, r in enumerate(rows)], "pos int, node string, parent string, depth int, recursive boolean, lazy boolean")


@R.query("G04_reachable_boundaries_all", f"WITH RECURSIVE {_NODES}, r AS (SELECT '{START_ORDER}' AS node UNION SELECT e.callee FROM r JOIN valid e ON e.caller = r.node) SELECT r.node, b.mark FROM r JOIN bounds b ON b.node = r.node")
def g04_all(spark, d):
    near = graph.reach(graph.arrows(graph.valid_edges(edges(spark, d))), start(spark, START_ORDER))
    return near.join(bounds(spark, d), "node").select("node", "mark")


@R.query(
    "G06_A10_impact_15",
    f"""WITH RECURSIVE {_NODES}, {_reach('callee', 'caller', 'valid', START_SUPPLIER, 15, "AND (r.depth = 0 OR NOT EXISTS (SELECT 1 FROM endpoints x WHERE x.full_method = r.node))")}
SELECT n.repo_id, count(*) AS n_methods, count(p.full_method) AS n_endpoints, max(depth) AS deepest FROM reached r JOIN nodes n ON n.node = r.node LEFT JOIN endpoints p ON p.full_method = r.node GROUP BY 1""",
)
def g06_15(spark, d):
    return _impact(spark, d, 15)


@R.query(
    "G16_cycle",
    f"""WITH RECURSIVE {_NODES}, r AS (SELECT callee AS node, 1 AS depth FROM valid WHERE caller = '{START_ORDER}' UNION SELECT e.callee, r.depth + 1 FROM r JOIN valid e ON e.caller = r.node WHERE r.depth < 15)
SELECT '{START_ORDER}' AS node, count(*) > 0 AS has_cycle, min(depth) AS length FROM r WHERE node = '{START_ORDER}'""",
)
def g16(spark, d):
    """Whether the start calls itself by way of others, and the least number of steps; no limit of depth."""
    return graph.cycle(graph.arrows(graph.valid_edges(edges(spark, d))), START_ORDER)


_INH = """inh AS (SELECT DISTINCT 'geo.nation.N' || n_nationkey AS child, 'geo.region.R' || n_regionkey AS parent, 'IMPLEMENTS' AS kind FROM nation
 UNION SELECT 'crm.customer.C' || c_custkey, 'geo.nation.N' || c_nationkey, 'EXTENDS' FROM customer),
meth AS (SELECT DISTINCT 'geo.region.R' || n_regionkey AS c, 'open()' AS k, true AS abstract FROM nation UNION SELECT 'geo.nation.N' || n_nationkey, 'route(int)', n_nationkey % 2 = 0 FROM nation
 UNION SELECT 'geo.nation.N' || n_nationkey, 'open()', false FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'crm.customer.C' || c_custkey, 'route(int)', false FROM customer WHERE c_custkey % 4 = 0),
anc AS (SELECT child, parent AS a, 1 AS dist FROM inh UNION SELECT anc.child, inh.parent, dist + 1 FROM anc JOIN inh ON inh.child = anc.a)"""


def inheritance(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    nation = F.concat(F.lit("geo.nation.N"), "n_nationkey")
    a = n.select(nation.alias("child"), F.concat(F.lit("geo.region.R"), "n_regionkey").alias("parent"), F.lit("IMPLEMENTS").alias("kind"))
    b = c.select(F.concat(F.lit("crm.customer.C"), "c_custkey").alias("child"), F.concat(F.lit("geo.nation.N"), "c_nationkey").alias("parent"), F.lit("EXTENDS").alias("kind"))
    return a.unionByName(b)


def class_methods(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    nation = F.concat(F.lit("geo.nation.N"), "n_nationkey").alias("class_name")
    rows = n.select(F.concat(F.lit("geo.region.R"), "n_regionkey").alias("class_name"), F.lit("open()").alias("method_key"), F.lit(True).alias("abstract")).distinct()
    rows = rows.unionByName(n.select(nation, F.lit("route(int)").alias("method_key"), (F.col("n_nationkey") % 2 == 0).alias("abstract")))
    rows = rows.unionByName(n.where("n_nationkey % 3 = 0").select(nation, F.lit("open()").alias("method_key"), F.lit(False).alias("abstract")))
    own = c.where("c_custkey % 4 = 0").select(F.concat(F.lit("crm.customer.C"), "c_custkey").alias("class_name"), F.lit("route(int)").alias("method_key"), F.lit(False).alias("abstract"))
    return rows.unionByName(own)


@R.query(
    "G10_polymorphic_edges",
    f"""WITH RECURSIVE {_INH}, ev AS (SELECT c AS child, c AS a, k, 0 AS dist FROM meth WHERE NOT abstract UNION SELECT anc.child, anc.a, k, dist FROM anc JOIN meth ON c = a AND NOT abstract),
body AS (SELECT child, k, min_by(a, (dist, a)) AS holder, min(dist) AS dist FROM ev GROUP BY 1, 2)
SELECT child || ':' || k AS caller, holder || ':' || k AS callee, '_CCS' AS call_type FROM body WHERE dist > 0 AND NOT EXISTS (SELECT 1 FROM meth WHERE c = child AND meth.k = body.k)
UNION SELECT anc.a || ':' || m.k, anc.child || ':' || m.k, CASE WHEN (SELECT max(kind) FROM inh WHERE parent = anc.a) = 'IMPLEMENTS' THEN '_ITF' ELSE '_SCC' END FROM anc JOIN meth m ON m.c = anc.a AND m.abstract JOIN body b ON b.child = anc.child AND b.k = m.k""",
)
def g10(spark, d):
    return graph.polymorphic_edges(inheritance(spark, d), class_methods(spark, d))


@R.query("G11_inheritance_closure", f"WITH RECURSIVE {_INH} SELECT child, a AS ancestor, min(dist) AS distance FROM anc GROUP BY 1, 2")
def g11(spark, d):
    return graph.ancestors(inheritance(spark, d).select("child", "parent"))


@R.query("G12_roots", f"WITH RECURSIVE {_INH} SELECT DISTINCT parent AS node FROM inh WHERE parent NOT IN (SELECT child FROM inh)")
def g12(spark, d):
    return graph.inheritance_roots(inheritance(spark, d))


@R.query(
    "G13_propagation",
    f"""WITH RECURSIVE {_NODES}, s AS (SELECT DISTINCT caller, callee FROM edges), p AS (SELECT node, mark, 0 AS depth FROM bounds UNION SELECT s.caller, p.mark, p.depth + 1 FROM p JOIN s ON s.callee = p.node WHERE p.depth < 5)
SELECT DISTINCT node, mark FROM p WHERE node NOT IN (SELECT node FROM bounds)""",
)
def g13(spark, d):
    return graph.propagate(graph.arrows(edges(spark, d)), bounds(spark, d), 5)


@R.query(
    "G15_ambiguous_nodes",
    """WITH a AS (SELECT full_method, count(DISTINCT repo_id) AS n FROM chunks GROUP BY 1 HAVING count(DISTINCT repo_id) > 1)
SELECT b.id, coalesce(a.n, 1) AS n_owners FROM boundaries b LEFT JOIN a ON a.full_method = b.full_method WHERE b.full_method IS NOT NULL""",
)
def g15(spark, d):
    n = table(spark, d, "chunks").select("full_method", "repo_id").distinct().groupBy("full_method").agg(F.count("*").alias("n")).where("n > 1")
    b = table(spark, d, "boundaries").where("full_method is not null")
    return b.join(n, "full_method", "left").select("id", F.coalesce("n", F.lit(1)).alias("n_owners"))


@R.query("G18_tree_methods", f"WITH RECURSIVE {_NODES}, {_reach('caller', 'callee', 'valid', START_ORDER, 4)} SELECT DISTINCT split_part(node, ':', 1) AS class_name FROM reached")
def g18(spark, d):
    near = graph.reach(graph.arrows(graph.valid_edges(edges(spark, d))), start(spark, START_ORDER), 4)
    return near.select(sig.class_name(F.col("node")).alias("class_name")).distinct()


_TOPO = """
calls AS (SELECT repo_id, callee, count(*) AS n FROM edges GROUP BY 1, 2),
owner AS (SELECT node, repo_id FROM nodes WHERE node NOT LIKE 'scm.%'),
px AS (SELECT p, min_by(repo_id, (-n, repo_id)) AS repo_id FROM (SELECT array_to_string(string_split(split_part(node, ':', 1), '.')[1:2], '.') AS p, repo_id, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY 1),
res AS (SELECT c.repo_id, c.callee, c.n, e.repo_id AS to_repo, e.endpoint_type AS t FROM calls c JOIN endpoints e ON e.full_method = c.callee
 UNION ALL SELECT c.repo_id, c.callee, c.n, px.repo_id, NULL FROM calls c LEFT JOIN px ON px.p = array_to_string(string_split(split_part(c.callee, ':', 1), '.')[1:2], '.') WHERE c.callee LIKE 'scm.%' AND c.callee NOT IN (SELECT full_method FROM endpoints)
 UNION ALL SELECT c.repo_id, c.callee, c.n, o.repo_id, NULL FROM calls c JOIN owner o ON o.node = c.callee WHERE c.callee NOT IN (SELECT full_method FROM endpoints)),
far AS (SELECT *, CASE t WHEN 'CONTROLLER' THEN 'HTTP' WHEN 'KAFKA' THEN 'MQ' END AS k FROM res WHERE to_repo <> repo_id)"""


def _topology(spark, d):
    calls = edges(spark, d).groupBy("repo_id", "callee").agg(F.count("*").alias("n"))
    n = nodes(spark, d)
    # suppliers are held twice, so that their prefix decides
    twice = n.where("full_method like 'scm.%'")
    return calls, endpoints(spark, d), n.unionByName(twice.withColumn("repo_id", F.col("repo_id") + 100)), n


@R.query(
    "G19_topology",
    f"""WITH {_NODES}, {_TOPO} SELECT repo_id AS from_repo, to_repo, CAST(sum(n) AS BIGINT) AS n_calls, count(DISTINCT callee) AS n_callees, CASE WHEN count(DISTINCT k) > 1 THEN 'MIXED' ELSE coalesce(min(k), 'RPC') END AS call_type FROM far GROUP BY 1, 2""",
)
def g19(spark, d):
    calls, ep, twice, _ = _topology(spark, d)
    return topology.service_edges(calls, ep, twice, 2)


@R.query(
    "G19_hot_methods",
    f"""WITH {_NODES}, {_TOPO} SELECT from_repo, to_repo, callee, n, rk FROM (SELECT repo_id AS from_repo, to_repo, callee, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY repo_id, to_repo ORDER BY sum(n) DESC, callee) AS rk FROM far GROUP BY 1, 2, 3) WHERE rk <= 20""",
)
def g19h(spark, d):
    calls, ep, twice, _ = _topology(spark, d)
    return topology.hot_methods(calls, ep, twice, 2, 20)


@R.query(
    "G22_short_refs",
    f"""WITH k AS (SELECT DISTINCT full_method, regexp_extract(class_name, '([^.]*)$', 1) || '.' || method_name AS ref FROM chunks)
SELECT ref, full_method, row_number() OVER (PARTITION BY ref ORDER BY full_method) AS rank FROM k WHERE ref IN (SELECT regexp_extract(split_part(full_method, ':', 1), '([^.]*)$', 1) || '.' || split_part(split_part(full_method, ':', 2), '(', 1) FROM boundaries) QUALIFY rank <= 10""",
)
def g22(spark, d):
    refs = table(spark, d, "boundaries").where("full_method is not null").select(sig.short_ref(F.col("full_method")).alias("ref"))
    return graph.short_ref_targets(table(spark, d, "chunks"), refs)


@R.query(
    "G24_package_tree",
    """WITH c AS (SELECT DISTINCT repo_id, package_name, class_name FROM chunks), l AS (SELECT *, unnest(generate_series(1, len(string_split(package_name, '.')))) AS level FROM c),
n AS (SELECT repo_id, array_to_string(string_split(package_name, '.')[1:level], '.') AS name, level, count(DISTINCT class_name) AS n_classes, max(array_to_string(string_split(package_name, '.')[1:level], '.') = package_name) AS own FROM l GROUP BY 1, 2, 3)
SELECT repo_id, name, level, n_classes FROM n WHERE own OR n_classes IS DISTINCT FROM (SELECT max(k.n_classes) FROM n k WHERE k.repo_id = n.repo_id AND k.level = n.level + 1 AND starts_with(k.name, n.name || '.'))""",
)
def g24(spark, d):
    return graph.package_tree(table(spark, d, "chunks"), ["repo_id"]).withColumn("level", F.col("level").cast("long"))
