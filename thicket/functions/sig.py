"""Derivations of method signatures ``package.Class:method(argType,argType)`` and of related names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Access flags of methods, in the order they are spelled; fixed values of the class-file format.
ACCESS_FLAGS = {
    0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x20: "synchronized",
    0x100: "native", 0x400: "abstract",
}


def class_name(full: Column) -> Column:
    """Text before the last ``:``; all of it without one."""
    return F.when(F.instr(full, ":") > 0, F.regexp_extract(full, r"^(.*):", 1)).otherwise(full)


def method_name(full: Column) -> Column:
    """Text between the last ``:`` and the parenthesis behind it."""
    return F.split_part(F.substring_index(full, ":", -1), F.lit("("), F.lit(1))


def params(full: Column) -> Column:
    """Text inside the parentheses: empty without arguments, null without parentheses."""
    tail = F.substring_index(full, ":", -1)
    return F.when(F.instr(tail, "(") > 0, F.regexp_extract(tail, r"\(([^)]*)", 1))


def n_args(full: Column) -> Column:
    p = params(full)
    return F.when(p.isNull(), None).when(p == "", 0).otherwise(F.size(F.split(p, ",")))


def package_name(cls: Column) -> Column:
    """Class name up to its last dot; empty without one."""
    return F.regexp_extract(cls, r"^(.*)\.", 1)


def simple_class(cls: Column) -> Column:
    return F.substring_index(cls, ".", -1)


def short_ref(full: Column) -> Column:
    """``SimpleClass.method``."""
    return F.concat_ws(".", simple_class(class_name(full)), method_name(full))


def top_class(cls: Column) -> Column:
    """Class name without inner classes."""
    return F.substring_index(cls, "$", 1)


def first_segments(name: Column, n: int) -> Column:
    """First ``n`` dotted segments."""
    return F.substring_index(name, ".", n)


def access_words(flags: Column) -> Column:
    """Words of an access-flag mask, blank-separated."""
    words = [F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(word)) for bit, word in ACCESS_FLAGS.items()]
    return F.concat_ws(" ", *words)


def call_type(tagged: Column) -> Column:
    """``T`` of ``(T)callee``; empty without tag."""
    return F.regexp_extract(tagged, r"^\(([^)]*)\)", 1)


def untagged(tagged: Column) -> Column:
    """Callee of ``(T)callee``."""
    return F.regexp_replace(tagged, r"^\([^)]*\)", "")


def camel_words(name: Column) -> Column:
    """Words of a camel-case name, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(spaced)


def package_levels(package: Column) -> Column:
    """array<struct<level, name>> of a package's levels: a, a.b, a.b.c."""
    parts = F.split(package, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("name")),
    )


def placeholder_key(value: Column) -> Column:
    """``k`` of ``${k}`` or ``${k:default}``; null without placeholder."""
    return F.nullif(F.regexp_extract(value, r"\$\{([^}:]*)[^}]*\}", 1), F.lit(""))


def placeholder_default(value: Column) -> Column:
    """``default`` of ``${k:default}``; null without one."""
    return F.nullif(F.regexp_extract(value, r"\$\{[^}:]*:([^}]*)\}", 1), F.lit(""))


def join_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def jar_display_name(path: Column) -> Column:
    """File name without its archive ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?i)\.(jar|war|jmod)$", "")


def one_line(text: Column, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def mask_secret(key: Column, value: Column) -> Column:
    """Value with all but its ends masked where the key names a secret."""
    secret = F.lower(key).rlike("password|passwd|secret|token|credential|private|access.?key")
    short = F.length(value) <= 4
    masked = F.when(short, F.lit("****")).otherwise(F.concat(F.substring(value, 1, 2), F.lit("****"), F.right(value, F.lit(2))))
    return F.when(secret, masked).otherwise(value)


def http_verb(annotation: Column, verbs: Sequence[str] = ("Get", "Post", "Put", "Delete", "Patch")) -> Column:
    """Verb named by a route annotation, else ALL."""
    simple = simple_class(annotation)
    out = F.lit("ALL")
    for v in reversed(verbs):
        out = F.when(simple.startswith(v), F.lit(v.upper())).otherwise(out)
    return out


def first_business_segment(path: Column, generic: Sequence[str]) -> Column:
    """First segment of a path or key that tells something; null if none does."""
    segments = F.transform(F.split(path, r"[./\-_]"), lambda s: F.trim(s))
    telling = F.filter(
        segments,
        lambda s: (F.length(s) >= 2) & ~F.lower(s).isin(list(generic)) & ~s.rlike(r"^\d+$") & ~s.contains("{"),
    )
    return F.get(telling, F.lit(0))
