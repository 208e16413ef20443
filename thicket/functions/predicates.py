"""Predicates of the call-graph domain as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from thicket.functions import sig

#: Edge types that are no calls.
INHERITANCE = ["EXTENDS", "IMPLEMENTS"]
#: Method names only generated remoting code has; fixed values.
GENERATED_METHODS = [
    "newBlockingStub", "newFutureStub", "newStub", "bindService", "getServiceDescriptor", "getDescriptor", "getFileDescriptor",
    "parseFrom", "parseDelimitedFrom", "writeTo", "mergeFrom", "isInitialized", "getParserForType", "getDefaultInstance",
    "getDefaultInstanceForType",
]
#: Class-name endings of data carriers and of structural components; fixed values.
CARRIER_ENDINGS = [
    "Request", "Response", "DTO", "Dto", "VO", "Vo", "PO", "Po", "BO", "Bo", "Bean", "Entity", "Param", "Info", "Detail",
    "Result", "Enum", "Constant", "Constants", "Model", "Data", "Context",
]
CARRIER_PACKAGES = ["dto", "bean", "entity", "vo", "po", "model", "request", "response", "em", "enums", "constant"]
STRUCTURAL_ENDINGS = [
    "Controller", "Service", "ServiceImpl", "Mapper", "Repository", "Dao", "Component", "Manager", "Handler", "Client",
    "Remote", "Filter", "Interceptor", "Aspect", "Config", "Listener", "Consumer", "Producer", "Util", "Utils", "Helper",
]
#: Path and key segments without meaning of their own; fixed values.
GENERIC_SEGMENTS = [
    "api", "service", "services", "url", "host", "base", "baseurl", "endpoint", "gateway", "rest", "http", "https", "v1", "v2",
    "v3", "open", "inner", "internal", "external", "common", "web",
]
#: Type of a class by the ending of its lower-case name, first match wins; fixed values.
CLASS_TYPES = [
    ("controller", "Controller"), ("serviceimpl", "ServiceImpl"), ("service", "Service"), ("mapper", "Mapper"),
    ("repository", "Repository"), ("repo", "Repository"), ("dao", "DAO"), ("entity", "Entity"), ("dto", "DTO"), ("vo", "VO"),
    ("bo", "BO"), ("request", "Request"), ("response", "Response"), ("configuration", "Config"), ("config", "Config"),
    ("properties", "Config"), ("utils", "Utils"), ("util", "Utils"), ("helper", "Utils"), ("handler", "Handler"),
    ("interceptor", "Interceptor"), ("filter", "Filter"), ("aspect", "Aspect"), ("consumer", "MQ Consumer"),
    ("listener", "Listener"), ("producer", "Producer"), ("scheduler", "Scheduled"), ("task", "Scheduled"), ("job", "Scheduled"),
    ("client", "FeignClient"), ("stub", "gRPC Stub"), ("converter", "Converter"), ("serializer", "Converter"),
    ("exception", "Exception"), ("enums", "Enum"), ("enum", "Enum"), ("constants", "Constants"), ("constant", "Constants"),
    ("consts", "Constants"),
]


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(Column.__or__, columns, F.lit(False))


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    """True for all where no prefix is given."""
    return any_of([c.startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def prefix_list(text: str | None) -> list[str]:
    """Prefixes of a setting divided by commas, semicolons or white space."""
    import re

    return [p for p in re.split(r"[,;\s]+", text or "") if p]


def is_inheritance(call_type: Column) -> Column:
    return call_type.isin(INHERITANCE)


#: What is generated or boilerplate, by the part of a signature ``class:method(arguments)`` that tells it, as patterns; the words in them
#: are fixed values. ``class`` patterns look at the whole class, ``stub`` at methods of generated stubs, ``method`` at all.
SHAPES = {
    "class": [
        r"^(?:io\.grpc|com\.google\.protobuf)\.",
        r"\.(?:api\.client\.model|api\.grpc\.model|proto\.)",
        r"(?:\$Builder|OrBuilder)$",
        r"(?:^|\.)[^.$]*Grpc\d*$",
        r"\$(?:MethodHandlers|AsyncService|[^.$]*(?:DescriptorSupplier|ImplBase))$",
    ],
    "stub": [r"\$[^.$:]*Stub:(?:<init>|getChannel|getCallOptions|with[^(:]*)(?:\(|$)"],
    "method": [rf":(?:{'|'.join(GENERATED_METHODS)})(?:\(|$)"],
    "constructor": [r":<(?:cl)?init>\("],
    "object": [r":(?:equals|hashCode|toString)(?:\(|$)"],
    "accessor": [r":(?:get|is)[^(:]*\(\)", r":set[^(:]*\([^,()]+\)"],
}


def _shaped(c: Column, *kinds: str) -> Column:
    return c.rlike("|".join(f"(?:{p})" for k in kinds for p in SHAPES[k]))


def is_generated_class(cls: Column) -> Column:
    """Classes of remoting and serialization frameworks and those generated for them."""
    return _shaped(cls, "class")


def is_generated_method(full: Column) -> Column:
    """Methods of generated classes, plumbing and constructors of generated stubs, and methods only generated code has."""
    return is_generated_class(sig.class_name(full)) | _shaped(full, "stub", "method")


def is_constructor(full: Column) -> Column:
    return _shaped(full, "constructor")


def is_boilerplate(full: Column) -> Column:
    """Constructors, object methods, true accessors and generated methods; null is none."""
    return F.coalesce(is_generated_method(full) | _shaped(full, "constructor", "object", "accessor"), F.lit(False))


def is_data_carrier(cls: Column) -> Column:
    simple = sig.simple_class(cls)
    hit = cls.contains("$") | any_of([simple.endswith(e) for e in CARRIER_ENDINGS])
    return F.coalesce(hit | any_of([F.lower(cls).contains(f".{p}.") for p in CARRIER_PACKAGES]), F.lit(True))


def is_structural(cls: Column) -> Column:
    return F.coalesce(any_of([sig.simple_class(cls).endswith(e) for e in STRUCTURAL_ENDINGS]), F.lit(False))


def class_type(simple: Column) -> Column:
    lower, out = F.lower(simple), F.lit("Class")
    for ending, kind in reversed(CLASS_TYPES):
        out = F.when(lower.endswith(ending), F.lit(kind)).otherwise(out)
    return out


#: Shapes of constants that mean something to the business, and of those that don't whatever else they look like. A constant has 3 to 100
#: characters, one of the first and none of the second. Fixed values.
TELLING = {
    "reference to an enum constant": r"[A-Z]\w+\.[A-Z][A-Z0-9_]+",
    "address": r"(?s)(?:https?://|/api/).*",
    "key with a namespace": r"[^ ]{0,99}:[^ ]{0,99}(?<=.{4})",
    "name": r"[a-zA-Z][a-zA-Z0-9_]{0,39}",
    "Chinese text": r"(?s).*[一-鿿].*",
    "message of a failure": r"(?is).*(?:is empty|not found|invalid|error|failed).*",
}
IDLE = {
    "number": r"-?\d+(?:\.\d+)?",
    "nothing but punctuation or letters outside ASCII": r"[\W\s_]+",
    "text with a placeholder": r"(?s).*\{\}.*",
    "text of a log": r"(?is)(?:call |response|调用|(?:debug|info|warn|error|trace)\b).*",
}


def is_business_constant(v: Column) -> Column:
    """Constants that mean something to the business: see ``TELLING`` and ``IDLE``; null is none."""
    any_shape = lambda shapes: v.rlike("^(?:" + "|".join(f"(?:{p})" for p in shapes.values()) + ")$")
    return F.coalesce(F.length(v).between(3, 100) & any_shape(TELLING) & ~any_shape(IDLE), F.lit(False))


def path_matches(path: Column, template: Column) -> Column:
    """Equal number of segments, each equal or a ``{variable}`` of the template."""
    a, b = F.split(path, "/"), F.split(template, "/")
    same = F.forall(F.zip_with(a, b, lambda x, y: y.startswith("{") | (x == y)), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(a) == F.size(b)) & same


def sql_smells(sql: Column) -> Column:
    """array<string> of what a statement should be looked at for."""
    u = F.upper(sql)
    joins, selects = F.regexp_count(u, F.lit("JOIN")), F.regexp_count(u, F.lit("SELECT"))
    return F.array_compact(
        F.array(
            F.when(u.contains("SELECT *"), F.lit("select_all")),
            F.when((selects > 0) & ~u.contains("WHERE") & ~u.contains("LIMIT"), F.lit("full_scan")),
            F.when(joins >= 3, F.lit("many_joins")),
            F.when(selects > 1, F.lit("subquery")),
        )
    )


def file_kind(path: Column) -> Column:
    """Kind of a changed file: config, sql, dependency, deploy, api, code or other."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    config = path.rlike(r"\.(yml|yaml|properties)$") & (
        path.rlike("src/main/resources|config/|nacos|apollo") | path.startswith("application") | path.startswith("bootstrap")
    )
    return (
        F.when(config & name.rlike("-(local|test|dev|sit|uat)\\."), "dev_config")
        .when(config, "config")
        .when(path.endswith(".sql") | path.rlike("db/migration|sql/"), "sql")
        .when(path.rlike(r"(pom\.xml|build\.gradle|build\.gradle\.kts)$"), "dependency")
        .when(path.rlike("Dockerfile|docker-compose|\\.gitlab-ci|k8s|helm"), "deploy")
        .when(path.endswith(".java") & ~path.contains("test/") & path.rlike("Controller|controller/"), "api")
        .when(path.rlike(r"\.(java|class)$"), "code")
        .otherwise("other")
    )
