"""Deeply nested JSON to flat tables whose rows keep the path of their parent.

One higher-order SQL projection walks a whole body: each round of nested
``transform`` calls attaches path and owner to the children of every open
container, ``flatten`` makes them the next round's containers, and what is an
object inside a list is put aside with its ancestor. One ``inline`` per target
table then emits the rows. No shuffle, no schema needed beforehand.

Bodies that begin like JSON but that the engine's parser refuses (or that hold
such a text) are marked by the projection and read exactly by
:mod:`thicket.functions.json_text` instead: valid ones nested too deeply for the
parser, with repeated member names (each is entered) or beyond its limits of
size give all their rows, invalid ones none. Only their texts go to Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from thicket.functions import json_text

#: Closes the text under test; a text with anything after its value can't reach it.
SEAL = "~thicket seal 7f3c91d2~"
#: How a text begins that may be an object or a list, as a pattern within an SQL literal.
OPENS = r"^[ \\t\\r\\n]*[\\[{]"
#: The same for a whole body, which may be a text itself.
BEGINS = r"^[ \\t\\r\\n]*[\\[{\"]"
#: How either ends; a text that is cut off ends otherwise in most cases.
ENDS = r"[\\]}\"][ \\t\\r\\n]*$"


def _parse(text: str) -> str:
    """SQL: the variant of ``text`` if all of it is one valid JSON value, else null.

    ``try_parse_json`` stops after the first value, so the text is parsed as
    the first of two list elements: garbage behind it breaks the list or its size.
    """
    whole = f"try_variant_get(try_parse_json(concat('[', {text}, ',\"{SEAL}\"]')), '$', 'array<variant>')"
    good = f"size(w) = 2 and try_variant_get(w[1], '$', 'string') = '{SEAL}'"
    return f"element_at(transform(array({whole}), w -> if({good}, w[0], null)), 1)"


def _open(value: str) -> str:
    return f"'a', try_variant_get({value}, '$', 'array<variant>'), 'm', try_variant_get({value}, '$', 'map<string,variant>')"


#: Target tables: the type of their rows, and the SQL that takes them from the open containers ``b.t`` of a round.
OBJECTS = "struct<path: string, owner_path: string, n_members: int>"
FIELDS = "struct<object_path: string, owner_path: string, name: string, value: string>"
LEAVES = "struct<path: string, value: string>"


def _objects() -> str:
    return "transform(filter(b.t, x -> x.e and x.m is not null), x -> named_struct('path', x.p, 'owner_path', x.o, 'n_members', size(x.m)))"


def _text(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def _plain(value: str) -> str:
    inside = f"coalesce({_text(value)} rlike '{OPENS}' and {_parse(_text(value))} is not null, false)"
    return f"try_variant_get({value}, '$', 'array<variant>') is null and try_variant_get({value}, '$', 'map<string,variant>') is null and not {inside}"


def _fields() -> str:
    row = f"named_struct('object_path', x.p, 'owner_path', if(x.e, x.p, x.o), 'name', kv.key, 'value', {_text('kv.value')})"
    return f"flatten(transform(filter(b.t, x -> x.m is not null), x -> transform(filter(map_entries(x.m), kv -> {_plain('kv.value')}), kv -> {row})))"


def _leaves() -> str:
    row = lambda path, value: f"named_struct('path', {path}, 'value', {_text(value)})"
    members = f"transform(filter(map_entries(x.m), kv -> {_plain('kv.value')}), kv -> {row("concat(x.p, '.', kv.key)", 'kv.value')})"
    places = "transform(x.a, (c, i) -> named_struct('p', concat(x.p, '[', cast(i as string), ']'), 'v', c))"
    elements = f"transform(filter({places}, y -> {_plain('y.v')}), y -> {row('y.p', 'y.v')})"
    return f"flatten(transform(filter(b.t, x -> x.m is not null or x.a is not null), x -> if(x.m is not null, {members}, {elements})))"


_TABLES = {OBJECTS: _objects, FIELDS: _fields, LEAVES: _leaves}


def _walk(body: str, rows: str) -> str:
    """SQL: struct of the array ``r`` of the rows of one target table that ``body`` gives, and whether the parser ``refused`` any text."""
    root = _parse(body)
    seen = f"transform(acc.f, x -> named_struct('p', x.p, 'o', x.o, 'e', x.e, 'v', x.v, {_open('x.v')}, 'b', false))"
    inner = "try_variant_get(x.v, '$', 'string')"
    text = _parse(inner)
    texts = (
        "transform({seen}, x -> if(x.a is null and x.m is null and x.v is not null and {inner} rlike '{opens}', "
        "element_at(transform(array({text}), t -> named_struct('p', x.p, 'o', x.o, 'e', x.e, 'v', t, {open_t}, 'b', t is null and {inner} rlike '{ends}')), 1), x))"
    ).format(seen=seen, inner=inner, text=text, open_t=_open("t"), opens=OPENS, ends=ENDS)
    live = f"filter({texts}, x -> x.a is not null or x.m is not null or x.b)"
    of_object = (
        "transform(map_entries(x.m), kv -> named_struct('p', concat(x.p, '.', kv.key), 'o', if(x.e, x.p, x.o), 'e', false, 'v', kv.value))"
    )
    of_list = "transform(x.a, (c, i) -> named_struct('p', concat(x.p, '[', cast(i as string), ']'), 'o', x.o, 'e', true, 'v', c))"
    # a refused text ends the rounds: the body is read anew by the exact path
    children = f"coalesce(flatten(transform(b.t, x -> if(x.m is not null, {of_object}, {of_list}))), filter(acc.f, x -> false))"
    found = _TABLES[rows]()
    step = (
        f"element_at(transform(array(named_struct('t', {live}, 'r', acc.r)), "
        f"b -> named_struct('f', {children}, 'r', concat(b.r, {found}), 'refused', exists(b.t, x -> x.b))), 1)"
    )
    start = (
        f"element_at(transform(array({root}), v -> named_struct('f', array(named_struct('p', '$', 'o', '$', 'e', false, 'v', v)), "
        f"'r', cast(array() as array<{rows}>), 'refused', v is null and {body} rlike '{BEGINS}' and {body} rlike '{ENDS}')), 1)"
    )
    # no value lies deeper than the body has opening brackets, escaped ones included
    fuel = (
        f"1 + length({body}) - length(translate({body}, '[{{', '')) "
        f"+ length({body}) - length(replace({body}, '\\\\u', '\\\\'))"
    )
    end = "acc -> named_struct('r', acc.r, 'refused', acc.refused)"
    return f"aggregate(sequence(1, {fuel}), {start}, (acc, k) -> if(size(acc.f) = 0 or acc.refused, acc, {step}), {end})"


def _walked(body: str, rows: str) -> Column:
    none = f"named_struct('r', cast(array() as array<{rows}>), 'refused', false)"
    return F.expr(f"if({body} is null or not ({body} rlike '[\\\\[{{]'), {none}, {_walk(body, rows)})")


def _exactly(rows: str) -> Callable[[Column], Column]:
    """The exact path: rows of a body by the reader without the parser's limits; null texts give null."""
    read = {OBJECTS: json_text.list_objects, FIELDS: json_text.object_fields, LEAVES: json_text.leaves}[rows]
    names = [x.split(":")[0].strip() for x in rows[len("struct<") : -1].split(",")]

    @F.pandas_udf(f"array<{rows}>")
    def exact(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else [dict(zip(names, x)) for x in read(b)])

    return exact


def flatten_bodies(df: DataFrame, keep: list[str], bodies: dict[str, str]) -> DataFrame:
    """Rows of the table of list-element objects: ``keep``, side, path, owner_path, n_members.

    ``bodies`` maps the side's name to the column that holds its text. ``path``
    starts with ``$`` and adds ``.name`` and ``[i]``; ``owner_path`` is the
    path of the nearest enclosing object that is a list element, else ``$``.
    Texts inside that are valid JSON objects or lists by themselves are entered
    as if unquoted. Null, empty, cut-off or otherwise invalid bodies and those
    without such objects give no row; repeated input rows give repeated rows.
    Depth, length and repeated member names are no limit: what the engine's
    parser refuses is read by the exact path (a session that sets
    ``spark.sql.variant.allowDuplicateKeys`` keeps one of the repeated members
    instead). Columns of ``df`` that are not in ``keep`` may have any name.
    """
    return _flatten(df, keep, bodies, OBJECTS)


def flatten_fields(df: DataFrame, keep: list[str], bodies: dict[str, str]) -> DataFrame:
    """Rows of the table of plain members: ``keep``, side, object_path, owner_path, name, value.

    ``owner_path`` names the row of :func:`flatten_bodies` that the member belongs to (``$``: the body's own row): the object itself if
    it is a list element, else the nearest such around it. ``value`` is text, null for JSON's null; numbers read by the exact path stand as
    written. Plain values in lists are no members.
    """
    return _flatten(df, keep, bodies, FIELDS)


def leaf_values(df: DataFrame, keep: list[str], body: str) -> DataFrame:
    """All plain values wherever they stand: ``keep``, path, value (text, null for JSON's null); see :func:`flatten_bodies` for paths and bad bodies."""
    return _flatten(df, keep, {"": body}, LEAVES).drop("side")


def _flatten(df: DataFrame, keep: list[str], bodies: dict[str, str], rows: str) -> DataFrame:
    sides = list(bodies)
    walked = df.select(*keep, *[F.col(f"`{bodies[s]}`").alias(f"__b{i}") for i, s in enumerate(sides)])
    walked = walked.select("*", *[_walked(f"__b{i}", rows).alias(f"__w{i}") for i in range(len(sides))])
    text = lambda i: F.when(F.col(f"__w{i}.refused"), F.col(f"__b{i}")).alias(f"__t{i}")
    marked = walked.select(*keep, *[F.col(f"__w{i}.r").alias(f"__r{i}") for i in range(len(sides))], *[text(i) for i in range(len(sides))])
    exact = _exactly(rows)

    def tagged(i: int) -> Column:
        found = F.when(F.col(f"__t{i}").isNull(), F.col(f"__r{i}")).otherwise(exact(F.col(f"__t{i}")))
        return F.transform(found, lambda x: F.struct(F.lit(sides[i]).alias("side"), x.alias("x")))

    one = marked.select(*keep, F.inline(F.flatten(F.array(*[tagged(i) for i in range(len(sides))]))))
    return one.select(*keep, "side", "x.*")
