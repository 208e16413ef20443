"""Typed tables out of extracted relations: methods, calls, endpoints, boundaries, exceptions, constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from thicket.functions import predicates as pr, sig
from thicket.operators import joins

#: Boundary type of a callee by the start of its class, first match wins; fixed values.
BOUNDARIES = [
    ("org.springframework.web.client.RestTemplate", "HTTP"), ("org.springframework.web.reactive.function.client.WebClient$", "HTTP"),
    ("org.apache.http.impl.client.", "HTTP"), ("org.apache.http.impl.execchain.", "HTTP"), ("org.apache.hc.client5.http.impl.classic.", "HTTP"),
    ("org.apache.hc.client5.http.impl.async.", "HTTP"), ("java.net.HttpURLConnection", "HTTP"), ("java.net.http.HttpClient", "HTTP"),
    ("okhttp3.OkHttpClient", "HTTP"), ("okhttp3.Call", "HTTP"), ("feign.Client", "HTTP"), ("org.springframework.cloud.openfeign", "HTTP"),
    ("io.grpc.", "GRPC"), ("org.springframework.kafka.core.KafkaTemplate", "MQ"), ("org.apache.kafka.clients.producer", "MQ"),
    ("org.apache.rocketmq.client.producer", "MQ"), ("org.springframework.amqp.rabbit", "MQ"), ("java.sql.", "DB"), ("javax.sql.", "DB"),
    ("org.springframework.jdbc", "DB"), ("org.apache.ibatis", "DB"), ("org.mybatis", "DB"), ("com.baomidou.mybatisplus", "DB"),
    ("org.springframework.data.redis", "CACHE"), ("redis.clients.jedis", "CACHE"), ("io.lettuce", "CACHE"), ("org.redisson", "CACHE"),
    ("com.fasterxml.jackson", "SERIALIZATION"), ("com.alibaba.fastjson", "SERIALIZATION"), ("com.google.gson", "SERIALIZATION"),
    ("org.springframework.transaction", "TRANSACTION"),
]
#: Boundary type by the end of the class, for callees no prefix knows; fixed values.
CLIENTS = [("$BlockingStub", "GRPC"), ("$FutureStub", "GRPC"), ("Client", "HTTP"), ("Mapper", "DB")]
#: Endpoint type and verb by the simple name of an annotation; fixed values.
ROUTES = {
    "GetMapping": ("CONTROLLER", "GET"), "PostMapping": ("CONTROLLER", "POST"), "PutMapping": ("CONTROLLER", "PUT"), "DeleteMapping": ("CONTROLLER", "DELETE"),
    "PatchMapping": ("CONTROLLER", "PATCH"), "RequestMapping": ("CONTROLLER", "ALL"), "KafkaListener": ("KAFKA", None), "RocketMQMessageListener": ("ROCKETMQ", None),
    "RabbitListener": ("RABBIT", None), "Scheduled": ("SCHEDULED", None), "GrpcMethod": ("GRPC", None),
}
#: Words in a parent's name that make its class an endpoint; the first that fits wins.
PARENT_KINDS = [("MessageListener", "MQ"), ("Consumer", "MQ"), ("ImplBase", "GRPC"), ("BindableService", "GRPC"), ("Job", "SCHEDULED"), ("Tasklet", "SCHEDULED")]
#: Attributes that name a listener's target, the first present wins.
TARGETS = [("topics", "topic"), ("topic", "topic"), ("value", "topic"), ("queues", "queue"), ("cron", "cron"), ("fixedRate", "fixedRate"), ("fixedDelay", "fixedDelay")]


def import_methods(method_info: DataFrame) -> DataFrame:
    """Methods (full_method, flags, return_type, ..) without constructors and generated ones, each once, with their parts."""
    m = F.col("full_method")
    kept = method_info.where(m.isNotNull() & ~pr.is_generated_method(m)).dropDuplicates(["full_method"])
    cls = sig.class_name(m)
    return kept.select(
        "*", cls.alias("class_name"), sig.package_name(cls).alias("package_name"), sig.method_name(m).alias("method_name"), sig.access_words(F.col("flags")).alias("access")
    )


def import_calls(method_call: DataFrame) -> DataFrame:
    """Call edges of tagged rows (call_id, enabled 1/0, caller, tagged callee, line): only callers are cleared of generated methods."""
    t = F.col("callee")
    out = method_call.where(~F.coalesce(pr.is_generated_method(F.col("caller")), F.lit(False)))
    return out.select("call_id", (F.col("enabled") == "1").alias("enabled"), "caller", sig.untagged(t).alias("callee"), sig.call_type(t).alias("call_type"), F.col("line").try_cast("int").alias("line_number"))


def detect_boundaries(calls: DataFrame) -> DataFrame:
    """(caller, callee, boundary_type, line_number) of calls that leave the program, one per caller, type and callee."""
    cls = sig.class_name(F.col("callee"))
    kind = F.coalesce(joins.first_rule(cls, BOUNDARIES), joins.first_rule(cls, CLIENTS, "suffix"))
    b = calls.withColumn("boundary_type", kind).where("boundary_type is not null")
    return b.groupBy("caller", "callee", "boundary_type").agg(F.min("line_number").alias("line_number"))


def exception_boundaries(catches: DataFrame, throws: DataFrame) -> DataFrame:
    """EXCEPTION boundaries: catches (full_method, exception_type, flag, line) that the compiler did not make, and throws (full_method, exception_type, line)."""
    c = catches.where(F.coalesce("flag", F.lit("")) == "").select("full_method", F.concat(F.lit("catch "), "exception_type").alias("context"), "line")
    t = throws.select("full_method", F.concat(F.lit("throw "), "exception_type").alias("context"), "line")
    return c.unionByName(t).groupBy("full_method", "context").agg(F.min("line").alias("line_number")).withColumn("boundary_type", F.lit("EXCEPTION"))


def annotation_attributes(rows: DataFrame) -> DataFrame:
    """(full_method, annotation_class, attributes map) of ragged annotation rows (full_method, annotation_class, attr_name, attr_value)."""
    pairs = F.collect_list(F.when(F.col("attr_name").isNotNull(), F.struct("attr_name", "attr_value")))
    return rows.dropDuplicates(["full_method", "annotation_class", "attr_name"]).groupBy("full_method", "annotation_class").agg(F.map_from_entries(F.array_sort(pairs)).alias("attributes"))


def _first_value(attributes: Column, names: Sequence[str]) -> Column:
    clean = lambda n: F.nullif(F.regexp_replace(F.element_at(attributes, F.lit(n)), r'^[\[{"]+|[\]}"]+$', ""), F.lit(""))
    return F.coalesce(*[clean(n) for n in names])


def endpoints(annotations: DataFrame, class_paths: DataFrame) -> DataFrame:
    """Endpoints (full_method, endpoint_type, http_method, url_path, target) of annotated methods.

    ``annotations`` is (full_method, annotation_class, attributes), ``class_paths`` (class_name, base_path). One endpoint per method and type.
    """
    simple = sig.simple_class(F.col("annotation_class"))
    dim = F.create_map(*[x for k, (t, v) in ROUTES.items() for x in (F.lit(k), F.struct(F.lit(t).alias("t"), F.lit(v).cast("string").alias("v")))])
    a = annotations.withColumn("route", F.element_at(dim, simple)).where("route is not null").withColumn("class_name", sig.class_name(F.col("full_method")))
    a = a.join(class_paths.select("class_name", "base_path"), "class_name", "left")
    web = F.col("route.t") == "CONTROLLER"
    own = F.coalesce(_first_value(F.col("attributes"), ["value", "path"]), F.lit(""))
    full = F.regexp_replace(F.concat(F.lit("/"), F.coalesce("base_path", F.lit("")), F.lit("/"), own), "/+", "/")
    target = F.coalesce(*[F.concat(F.lit(f"{p}:"), _first_value(F.col("attributes"), [n])) for n, p in TARGETS])
    rows = a.select(
        "full_method", F.col("route.t").alias("endpoint_type"), F.col("route.v").alias("http_method"),
        F.when(web, F.when(F.length(full) > 1, F.regexp_replace(full, "/$", "")).otherwise(full)).alias("url_path"), F.when(~web, target).alias("target"),
    )
    w = Window.partitionBy("full_method", "endpoint_type").orderBy(F.col("http_method").eqNullSafe("ALL"), "http_method", "url_path")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def inherited_endpoints(inheritance: DataFrame, methods: DataFrame, known: DataFrame) -> DataFrame:
    """Public methods of classes whose parent's name tells an endpoint kind, unless ``known`` has (full_method, endpoint_type)."""
    kind = joins.first_rule(F.col("parent"), PARENT_KINDS, "contains")
    order = F.array_position(F.array(*[F.lit(k) for k in ("MQ", "GRPC", "SCHEDULED")]), F.col("endpoint_type"))
    classes = inheritance.select(F.col("child").alias("class_name"), kind.alias("endpoint_type")).where("endpoint_type is not null")
    classes = classes.groupBy("class_name").agg(F.min_by("endpoint_type", order).alias("endpoint_type"))
    public = methods.where(F.col("flags").bitwiseAND(F.lit(1)) != 0)
    return public.join(classes, "class_name").select("full_method", "endpoint_type").join(known, ["full_method", "endpoint_type"], "left_anti")


def json_lists(rows: DataFrame, key: Sequence[str], value: str, order: str, most: int) -> DataFrame:
    """(key.., values): distinct values in first-seen order, at most ``most``, as a JSON list."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("__o"))
    w = Window.partitionBy(*key).orderBy("__o", value)
    kept = first.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return kept.groupBy(*key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(value).alias("v")))), lambda x: x["v"])).alias("values"))


def enum_constants(args: DataFrame) -> DataFrame:
    """(enum_class, const_name, ordinal, code, description) of assignments (enum_class, const_name, ordinal, arg_seq, value).

    The first whole number is the code, the first text of two characters or more the description.
    """
    whole = F.col("value").rlike(r"^-?\d+$")
    return args.groupBy("enum_class", "const_name").agg(
        F.min("ordinal").alias("ordinal"),
        F.min_by(F.when(whole, F.col("value")), F.when(whole, F.col("arg_seq"))).alias("code"),
        F.min_by(F.when(~whole & (F.length("value") >= 2), F.col("value")), F.when(~whole & (F.length("value") >= 2), F.col("arg_seq"))).alias("description"),
    )
