"""Projections and predicates (P, F, N) over the code tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket.functions import el, predicates as pr, sig
from thicket.plans.registry import Registry
from thicket.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

CLS = "regexp_extract(full_method, '^(.*):', 1)"
METHOD = "split_part(regexp_extract(full_method, '([^:]*)$', 1), '(', 1)"
PARAMS = "CASE WHEN contains(regexp_extract(full_method, '([^:]*)$', 1), '(') THEN regexp_extract(full_method, '\\(([^)]*)', 1) END"
SIMPLE = f"regexp_extract({CLS}, '([^.]*)$', 1)"


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


@R.query(
    "P01_signature_split",
    f"""SELECT id, {CLS} AS class_name, {METHOD} AS method_name, {PARAMS} AS params,
       regexp_extract({CLS}, '^(.*)\\.', 1) AS package_name,
       CASE WHEN ({PARAMS}) = '' THEN 0 ELSE len(string_split({PARAMS}, ',')) END AS n_args FROM chunks""",
)
def p01(spark, d):
    m = F.col("full_method")
    return table(spark, d, "chunks").select(
        "id", sig.class_name(m).alias("class_name"), sig.method_name(m).alias("method_name"), sig.params(m).alias("params"),
        sig.package_name(sig.class_name(m)).alias("package_name"), sig.n_args(m).alias("n_args"),
    )


@R.query("P02_short_ref", f"SELECT id, {SIMPLE} || '.' || {METHOD} AS short_ref FROM chunks")
def p02(spark, d):
    return table(spark, d, "chunks").select("id", sig.short_ref(F.col("full_method")).alias("short_ref"))


@R.query(
    "P03_P04_class_prefixes",
    """SELECT DISTINCT class_name, split_part(class_name, '$', 1) AS top_class,
       array_to_string(string_split(class_name, '.')[1:3], '.') AS prefix3, array_to_string(string_split(class_name, '.')[1:2], '.') AS org_root FROM chunks""",
)
def p03(spark, d):
    c = F.col("class_name")
    return (
        table(spark, d, "chunks")
        .select("class_name", sig.top_class(c).alias("top_class"), sig.first_segments(c, 3).alias("prefix3"), sig.first_segments(c, 2).alias("org_root"))
        .distinct()
    )


@R.query(
    "P05_access_flags",
    "SELECT access_flags, concat_ws(' ', " + ", ".join(f"CASE WHEN access_flags & {b} <> 0 THEN '{w}' END" for b, w in sig.ACCESS_FLAGS.items()) + ") AS words, count(*) AS n FROM chunks GROUP BY 1, 2",
)
def p05(spark, d):
    f = F.col("access_flags")
    return table(spark, d, "chunks").groupBy("access_flags", sig.access_words(f).alias("words")).agg(F.count("*").alias("n"))


@R.query(
    "P06_call_type_tag",
    """SELECT id, boundary_type AS call_type, callee_method AS callee FROM boundaries WHERE callee_method IS NOT NULL""",
)
def p06(spark, d):
    tagged = F.concat(F.lit("("), F.col("boundary_type"), F.lit(")"), F.col("callee_method"))
    return table(spark, d, "boundaries").where("callee_method is not null").select("id", tagged.alias("t")).select(
        "id", sig.call_type(F.col("t")).alias("call_type"), sig.untagged(F.col("t")).alias("callee")
    )


@R.query(
    "P07_camel_words",
    """SELECT DISTINCT method_name, lower(regexp_replace(regexp_replace(method_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')) AS words FROM chunks""",
)
def p07(spark, d):
    return table(spark, d, "chunks").select("method_name", sig.camel_words(F.col("method_name")).alias("words")).distinct()


@R.query("P08_jar_display_name", "SELECT id, jar_name AS display FROM jar_info")
def p08(spark, d):
    path = F.concat(F.lit("/opt/libs\\x/"), F.col("jar_name"), F.lit(".JAR"))
    return table(spark, d, "jar_info").select("id", sig.jar_display_name(path).alias("display"))


@R.query(
    "P09_P10_placeholders",
    """WITH k AS (SELECT id, url_path_identifier AS p, name FROM repositories)
SELECT id, p AS key, CASE WHEN id % 3 = 0 THEN NULL ELSE name END AS default_value,
       coalesce((SELECT min(r.branch) FROM repositories r WHERE r.url_path_identifier = k.p), CASE WHEN id % 3 = 0 THEN NULL ELSE name END) AS value FROM k WHERE p IS NOT NULL""",
)
def p09(spark, d):
    repos = table(spark, d, "repositories").where("url_path_identifier is not null")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("${"), "url_path_identifier", F.lit("}"))).otherwise(
        F.concat(F.lit("${"), "url_path_identifier", F.lit(":"), "name", F.lit("}"))
    )
    asked = repos.select("id", text.alias("v")).select("id", sig.placeholder_key(F.col("v")).alias("key"), sig.placeholder_default(F.col("v")).alias("default_value"))
    config = repos.groupBy(F.col("url_path_identifier").alias("key")).agg(F.min("branch").alias("config_value"))
    return asked.join(config, "key", "left").select("id", "key", "default_value", F.coalesce("config_value", "default_value").alias("value"))


@R.query(
    "P11_join_url",
    "SELECT e.id, 'http://' || r.url_path_identifier || '.invalid/' || regexp_replace(e.url_path, '^/+', '') AS url FROM api_endpoints e JOIN repositories r ON r.id = e.repo_id WHERE e.url_path IS NOT NULL",
)
def p11(spark, d):
    e, r = table(spark, d, "api_endpoints"), table(spark, d, "repositories")
    base = F.concat(F.lit("http://"), F.col("r.url_path_identifier"), F.lit(".invalid/"))
    return e.alias("e").where("url_path is not null").join(r.alias("r"), F.col("r.id") == F.col("e.repo_id")).select("e.id", sig.join_url(base, F.col("e.url_path")).alias("url"))


@R.query(
    "P12_system_name",
    f"""SELECT id, list_filter(regexp_split_to_array(url_path, '[./\\-_]'), lambda x: length(trim(x)) >= 2 AND lower(trim(x)) NOT IN {words(pr.GENERIC_SEGMENTS)}
  AND NOT regexp_matches(x, '^\\d+$') AND NOT contains(x, '{{'))[1] AS system FROM api_endpoints WHERE url_path IS NOT NULL""",
)
def p12(spark, d):
    system = sig.first_business_segment(F.col("url_path"), pr.GENERIC_SEGMENTS)
    return table(spark, d, "api_endpoints").where("url_path is not null").select("id", system.alias("system"))


@R.query("P13_base64", "SELECT id, to_base64(encode(value)) AS coded, value AS back FROM method_return_const WHERE value IS NOT NULL")
def p13(spark, d):
    return table(spark, d, "method_return_const").where("value is not null").select("id", F.base64(F.encode("value", "UTF-8")).alias("coded")).select(
        "id", "coded", F.decode(F.unbase64("coded"), "UTF-8").alias("back")
    )


@R.query(
    "P14_one_line",
    r"""SELECT id, CASE WHEN length(t) > 24 THEN substr(t, 1, 24) || '...' ELSE t END AS line
FROM (SELECT id, regexp_replace(trim(call_summary), '\s+', ' ', 'g') AS t FROM chunks WHERE call_summary IS NOT NULL)""",
)
def p14(spark, d):
    return table(spark, d, "chunks").where("call_summary is not null").select("id", sig.one_line(F.col("call_summary"), 24).alias("line"))


@R.query(
    "P15_mask_secrets",
    """SELECT id, CASE WHEN regexp_matches(lower(field_name), 'password|passwd|secret|token|credential|private|access.?key')
 THEN CASE WHEN length(field_class) <= 4 THEN '****' ELSE left(field_class, 2) || '****' || right(field_class, 2) END ELSE field_class END AS shown FROM static_field_usage WHERE field_class IS NOT NULL AND field_name IS NOT NULL""",
)
def p15(spark, d):
    u = table(spark, d, "static_field_usage").where("field_class is not null and field_name is not null")
    return u.select("id", sig.mask_secret(F.col("field_name"), F.col("field_class")).alias("shown"))


@R.query(
    "P16_package_levels",
    """SELECT repo_id, level, array_to_string(string_split(package_name, '.')[1:level], '.') AS name, count(DISTINCT class_name) AS n_classes
FROM (SELECT repo_id, package_name, class_name, unnest(generate_series(1, len(string_split(package_name, '.')))) AS level FROM chunks) GROUP BY ALL""",
)
def p16(spark, d):
    c = table(spark, d, "chunks").select("repo_id", "class_name", F.inline(sig.package_levels(F.col("package_name"))))
    return c.groupBy("repo_id", F.col("level").cast("long").alias("level"), "name").agg(F.count_distinct("class_name").alias("n_classes"))


@R.query("P17_md5", "SELECT id, md5(full_method) AS h FROM chunks")
def p17(spark, d):
    return table(spark, d, "chunks").select("id", F.md5("full_method").alias("h"))


@R.query(
    "P19_http_verb",
    """SELECT annotation_class, CASE WHEN s LIKE 'Get%' THEN 'GET' WHEN s LIKE 'Post%' THEN 'POST' WHEN s LIKE 'Put%' THEN 'PUT' WHEN s LIKE 'Delete%' THEN 'DELETE'
 WHEN s LIKE 'Patch%' THEN 'PATCH' ELSE 'ALL' END AS verb, count(*) AS n FROM (SELECT *, regexp_extract(annotation_class, '([^.]*)$', 1) AS s FROM api_endpoints) WHERE annotation_class IS NOT NULL GROUP BY ALL""",
)
def p19(spark, d):
    e = table(spark, d, "api_endpoints").where("annotation_class is not null")
    return e.groupBy("annotation_class", sig.http_verb(F.col("annotation_class")).alias("verb")).agg(F.count("*").alias("n"))


@R.query(
    "P21_F19_sql_smells",
    """SELECT id, length(sql_statement) - length(replace(upper(sql_statement), 'WHERE', 'WHER')) AS n_where,
 array_to_string(list_filter([CASE WHEN contains(u, 'SELECT *') THEN 'select_all' END, CASE WHEN contains(u, 'SELECT') AND NOT contains(u, 'WHERE') AND NOT contains(u, 'LIMIT') THEN 'full_scan' END,
 CASE WHEN len(string_split(u, 'JOIN')) > 3 THEN 'many_joins' END, CASE WHEN len(string_split(u, 'SELECT')) > 2 THEN 'subquery' END], lambda x: x IS NOT NULL), ',') AS smells
FROM (SELECT *, upper(sql_statement) AS u FROM api_endpoints WHERE sql_statement IS NOT NULL)""",
)
def p21(spark, d):
    s = F.col("sql_statement")
    return table(spark, d, "api_endpoints").where("sql_statement is not null").select("id", F.regexp_count(F.upper(s), F.lit("WHERE")).cast("long").alias("n_where"), F.array_join(pr.sql_smells(s), ",").alias("smells"))


_TYPE = "CASE " + " ".join(f"WHEN l LIKE '%{e}' THEN '{k}'" for e, k in pr.CLASS_TYPES) + " ELSE 'Class' END"


@R.query(
    "P22_class_types",
    f"SELECT repo_id, {_TYPE} AS class_type, count(*) AS n FROM (SELECT DISTINCT repo_id, class_name, lower(regexp_extract(class_name, '([^.]*)$', 1)) AS l FROM chunks) GROUP BY ALL",
)
def p22(spark, d):
    c = table(spark, d, "chunks").select("repo_id", "class_name").distinct()
    return c.groupBy("repo_id", pr.class_type(sig.simple_class(F.col("class_name"))).alias("class_type")).agg(F.count("*").alias("n"))


@R.query(
    "P24_common_package",
    """WITH p AS (SELECT repo_id, min(string_split(package_name, '.')) AS a, max(string_split(package_name, '.')) AS b FROM chunks GROUP BY 1),
x AS (SELECT repo_id, a, coalesce(list_min(list_filter(generate_series(1, len(a)), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(a)) AS n FROM p)
SELECT repo_id, array_to_string(a[1:n], '.') AS prefix FROM x""",
)
def p24(spark, d):
    # the longest common prefix of a set is that of its least and greatest member
    parts = F.split("package_name", r"\.")
    g = table(spark, d, "chunks").groupBy("repo_id").agg(F.min(parts).alias("a"), F.max(parts).alias("b"))
    differ = F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: ~F.get("a", i - 1).eqNullSafe(F.get("b", i - 1)))
    n = F.coalesce(F.array_min(differ) - 1, F.size("a"))
    return g.select("repo_id", F.array_join(F.slice("a", F.lit(1), n), ".").alias("prefix"))


@R.query(
    "P30_log_extract",
    r"""SELECT doc_id, len(regexp_extract_all(text, 'at\s+([\w.$]+)\.([\w$<>]+)\(([\w.]+):(\d+)\)')) AS n_frames,
 len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\b(ERROR|FATAL|SEVERE)\b'))) AS n_errors,
 nullif(regexp_extract(text, '(\S*(Exception|Error|Throwable)): ', 1), '') AS first_exception FROM documents WHERE text IS NOT NULL""",
)
def p30(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.regexp_count(t, F.lit(r"at\s+([\w.$]+)\.([\w$<>]+)\(([\w.]+):(\d+)\)")).cast("long").alias("n_frames"),
        F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\b(ERROR|FATAL|SEVERE)\b"))).cast("long").alias("n_errors"),
        F.nullif(F.regexp_extract(t, r"(\S*(Exception|Error|Throwable)): ", 1), F.lit("")).alias("first_exception"),
    )


@R.query(
    "P32_json_keys",
    """SELECT DISTINCT key FROM (SELECT unnest(regexp_extract_all(r.request_body, '"(\\w+)"\\s*:', 1)) AS key FROM (SELECT unnest(request_chain) AS r FROM request_chains) WHERE r.request_body IS NOT NULL)""",
)
def p32(spark, d):
    bodies = table(spark, d, "request_chains").select(F.explode("request_chain.request_body").alias("b")).where("b is not null")
    return bodies.select(F.explode(F.regexp_extract_all("b", F.lit(r'"(\w+)"\s*:'), F.lit(1))).alias("key")).distinct()


@R.query(
    "F01_el_predicate",
    """SELECT id FROM chunks WHERE NOT ((starts_with(class_name, 'com.') AND len(string_split(class_name, '.')) > 3 AND ends_with(full_method, ')') AND contains(method_name, 'Order'))
 OR lower(method_name) LIKE 'get%' OR starts_with(package_name, 'io.lumpen') OR starts_with(package_name, 'net.osterly'))""",
)
def f01(spark, d):
    chunks = table(spark, d, "chunks")
    allowed = {c: F.col(c) for c in ("class_name", "method_name", "full_method", "package_name")} | {"n_segments": F.size(F.split("class_name", r"\."))}
    text = (
        "string.startsWith(class_name, 'com.') && n_segments > 3 && string.endsWith(full_method, ')') && string.contains(method_name, \"Order\")"
        " || string.startsWithIC(method_name, 'GET') || string.startsWithAny(package_name, 'io.lumpen', 'net.osterly')"
    )
    return el.split_by(chunks, text, allowed, "ignore_method")[0].select("id")


@R.query(
    "F06_el_rejects",
    "SELECT 'ignore_call' AS predicate, boundary_type, count(*) AS n FROM boundaries WHERE boundary_type <> 'DB' AND NOT callee_method LIKE '%Client%' GROUP BY ALL",
)
def f06(spark, d):
    b = table(spark, d, "boundaries").where("callee_method is not null and boundary_type is not null")
    v = {"method_call_type": F.col("boundary_type"), "ee_full_method": F.col("callee_method")}
    drop = el.split_by(b, "method_call_type != 'DB' && !string.contains(ee_full_method, 'Client')", v, "ignore_call")[1]
    return drop.groupBy(F.lit("ignore_call").alias("predicate"), "boundary_type").agg(F.count("*").alias("n"))


_BOILER = f"""(({METHOD}) IN ('equals','hashCode','toString') OR full_method LIKE '%$Builder:%' OR ({METHOD}) IN {words(pr.GENERATED_METHODS)}
 OR (({PARAMS}) = '' AND (({METHOD}) LIKE 'get%' OR ({METHOD}) LIKE 'is%')) OR (({PARAMS}) <> '' AND NOT contains({PARAMS}, ',') AND ({METHOD}) LIKE 'set%'))"""


@R.query("F08_boilerplate", f"SELECT repo_id, count(*) FILTER (WHERE {_BOILER}) AS n_boilerplate, count(*) AS n FROM chunks GROUP BY 1")
def f08(spark, d):
    return table(spark, d, "chunks").groupBy("repo_id").agg(F.count_if(pr.is_boilerplate(F.col("full_method"))).alias("n_boilerplate"), F.count("*").alias("n"))


@R.query(
    "F09_generated_classes",
    r"""SELECT DISTINCT class_name FROM chunks WHERE class_name LIKE 'io.grpc.%' OR class_name LIKE 'com.google.protobuf.%' OR class_name LIKE '%$Builder' OR class_name LIKE '%OrBuilder'
 OR class_name LIKE '%.proto.%' OR regexp_matches(class_name, '\.[^.$]*Grpc\d*$') OR class_name LIKE '%$MethodHandlers' OR class_name LIKE '%ImplBase'""",
)
def f09(spark, d):
    return table(spark, d, "chunks").where(pr.is_generated_class(F.col("class_name"))).select("class_name").distinct()


@R.query(
    "F10_F12_business_prefix",
    """SELECT id FROM chunks WHERE starts_with(class_name, 'com.hexbarn') OR starts_with(class_name, 'org.veldra') OR starts_with(class_name, 'io.lumpen')""",
)
def f10(spark, d):
    return table(spark, d, "chunks").where(pr.starts_with_any(F.col("class_name"), pr.prefix_list("com.hexbarn; org.veldra,\n io.lumpen"))).select("id")


@R.query(
    "F11_class_roles",
    f"""SELECT data_carrier, structural, count(*) AS n FROM (SELECT DISTINCT class_name,
 (contains(class_name, '$') OR {" OR ".join(f"ends_with(class_name, '{e}')" for e in pr.CARRIER_ENDINGS)} OR {" OR ".join(f"contains(lower(class_name), '.{p}.')" for p in pr.CARRIER_PACKAGES)}) AS data_carrier,
 ({" OR ".join(f"ends_with(class_name, '{e}')" for e in pr.STRUCTURAL_ENDINGS)}) AS structural FROM chunks) GROUP BY ALL""",
)
def f11(spark, d):
    c = table(spark, d, "chunks").select("class_name").distinct()
    return c.groupBy(pr.is_data_carrier(F.col("class_name")).alias("data_carrier"), pr.is_structural(F.col("class_name")).alias("structural")).agg(F.count("*").alias("n"))


@R.query(
    "F14_business_constants",
    r"""SELECT value, count(*) AS n FROM method_return_const WHERE length(value) > 2 AND length(value) <= 100 AND NOT regexp_full_match(value, '-?\d+(\.\d+)?') AND NOT contains(value, '{}')
 AND NOT regexp_matches(lower(value), '^(call |response|调用|debug\b|info\b|warn\b|error\b|trace\b)') AND NOT regexp_full_match(value, '[\W\s_]+')
 AND (regexp_full_match(value, '[A-Z]\w+\.[A-Z][A-Z0-9_]+') OR regexp_matches(value, '^(http://|https://|/api/)') OR (contains(value, ':') AND NOT contains(value, ' ') AND length(value) >= 4)
 OR (regexp_full_match(value, '[a-zA-Z][a-zA-Z0-9_]*') AND length(value) <= 40) OR regexp_matches(value, '[一-鿿]') OR regexp_matches(lower(value), 'is empty|not found|invalid|error|failed')) GROUP BY 1""",
)
def f14(spark, d):
    return table(spark, d, "method_return_const").where(pr.is_business_constant(F.col("value"))).groupBy("value").agg(F.count("*").alias("n"))


@R.query("F16_anonymous_classes", r"SELECT count(DISTINCT class_name) AS n FROM chunks WHERE NOT regexp_matches(class_name, '\$\d+$')")
def f16(spark, d):
    return table(spark, d, "chunks").where(~F.col("class_name").rlike(r"\$\d+$")).agg(F.count_distinct("class_name").alias("n"))


@R.query(
    "F20_file_kinds",
    """SELECT file_path, CASE WHEN contains(file_path, 'Controller') OR contains(file_path, 'controller/') THEN 'api' ELSE 'code' END AS kind FROM (SELECT DISTINCT file_path FROM chunks WHERE file_path LIKE '%.java' AND NOT contains(file_path, 'test/')
 AND NOT regexp_matches(file_path, 'sql/|db/migration|Dockerfile|docker-compose|k8s|helm'))""",
)
def f20(spark, d):
    c = table(spark, d, "chunks").where("file_path like '%.java' and not file_path like '%test/%'").select("file_path").distinct()
    return c.select("file_path", pr.file_kind(F.col("file_path")).alias("kind")).where("kind in ('api', 'code')")


@R.query("F22_pending", "SELECT repo_id, count(*) AS n FROM chunks WHERE embedding_status IS NULL OR embedding_status <> 'DONE' GROUP BY 1")
def f22(spark, d):
    return table(spark, d, "chunks").where(~F.col("embedding_status").eqNullSafe("DONE")).groupBy("repo_id").agg(F.count("*").alias("n"))


@R.query(
    "F23_F24_endpoint_filter",
    """SELECT id FROM api_endpoints WHERE lower(endpoint_type) = 'http' AND (contains(lower(url_path), 'list') OR contains(lower(regexp_extract(class_name, '([^.]*)$', 1)), 'list')
 OR contains(lower(split_part(regexp_extract(full_method, '([^:]*)$', 1), '(', 1)), 'list'))""",
)
def f23(spark, d):
    hit = pr.any_of([F.coalesce(F.contains(F.lower(c), F.lit("list")), F.lit(False)) for c in (F.col("url_path"), sig.simple_class(F.col("class_name")), sig.method_name(F.col("full_method")))])
    return table(spark, d, "api_endpoints").where((F.lower("endpoint_type") == "http") & hit).select("id")


@R.query(
    "N08_json_access",
    """SELECT id, e->>'code' AS code, e->>'message' AS message FROM (SELECT id, unnest(CAST(error_codes AS JSON)::JSON[]) AS e FROM chunks WHERE error_codes IS NOT NULL AND json_valid(error_codes))""",
)
def n08(spark, d):
    c = table(spark, d, "chunks").where("error_codes is not null")
    return c.select("id", F.inline(F.from_json("error_codes", "array<struct<code: string, message: string>>")))


@R.query(
    "N10_null_handling",
    """SELECT id, coalesce(nullif(trim(value), ''), 'none') AS shown, TRY_CAST(value AS DOUBLE) AS number, CASE WHEN value IS NULL OR trim(value) = '' THEN 1 ELSE 0 END AS blank FROM method_return_const""",
)
def n10(spark, d):
    v = F.col("value")
    number = F.when(v.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), v.try_cast("double"))
    return table(spark, d, "method_return_const").select(
        "id", F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit("none")).alias("shown"), number.alias("number"), F.when(v.isNull() | (F.trim(v) == ""), 1).otherwise(0).alias("blank")
    )
