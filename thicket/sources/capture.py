"""Captured requests: cURL commands, JSON sessions, and telling them apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from thicket.functions import json_text

#: Schema of a captured session; fixed format.
SESSION = (
    "session_id long, user_action string, timestamp long, url string, "
    "request_chain array<struct<timestamp: long, seq: int, method: string, url: string, full_url: string, request_body: string, "
    "response_status: int, response_body: string, duration: long, success: boolean, request_headers: map<string,string>>>, "
    "data_flow array<struct<`from`: string, `to`: string, fields: array<struct<field: string, value: string>>>>"
)


def is_curl(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*curl\s"), F.lit(False))


def is_json(text: Column) -> Column:
    """Whole texts that are a JSON object or list, however deep, long or repetitive."""

    @F.pandas_udf("boolean")
    def exactly(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and json_text.container(t) is not None)

    sealed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"~"]'))), "$", "array<variant>")
    parsed = F.coalesce(F.size(sealed) == 2, F.lit(False))
    looks = F.coalesce(text.rlike(r"^[ \t\r\n]*[\[{]") & text.rlike(r"[\]}][ \t\r\n]*$"), F.lit(False))
    # what the parser refuses is read again by the exact reader
    return looks & (parsed | exactly(F.when(looks & ~parsed, text)))


#: What the value of an option of the command is; the other options with a value are passed over. Names fixed by the tool.
CURL_OPTIONS = {
    "method": ["-X", "--request"],
    "header": ["-H", "--header"],
    "body": ["-d", "--data", "--data-raw", "--data-binary", "--data-ascii", "--data-urlencode", "--json"],
    "address": ["--url"],
    "other": ["-A", "--user-agent", "-b", "--cookie", "-c", "--cookie-jar", "-e", "--referer", "-m", "--max-time", "-o", "--output", "-u", "--user", "-x", "--proxy", "--connect-timeout"],
}
#: A stretch of a shell word: between quotes, one escaped character, or plain.
_STRETCH = r"""'[^']*'|"(?:[^"\\]|\\[\s\S])*"|\\[\s\S]|[^\s'"\\]+|['"]"""


def shell_words(text: Column) -> Column:
    """Words of a command line as a shell divides them: quotes and escapes undone, continued lines joined; array<string>."""
    flat = F.regexp_replace(text, r"\\\r?\n", " ")

    def plain(s: Column) -> Column:
        inner = s.substr(F.lit(2), F.length(s) - 2)
        closed = F.length(s) >= 2
        return (
            F.when(closed & s.startswith("'"), inner)
            .when(closed & s.startswith('"'), F.regexp_replace(inner, r'\\(["\\$`])', "$1"))
            .when(closed & s.startswith("\\"), s.substr(F.lit(2), F.lit(1)))
            .when(s.isin("'", '"'), F.lit(""))  # never closed
            .otherwise(s)
        )

    words = F.regexp_extract_all(flat, F.lit(f"(?:{_STRETCH})+"), F.lit(0))
    return F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(_STRETCH), F.lit(0)), plain), ""))


def parse_curl(text: Column) -> Column:
    """struct<method, url, full_url, headers, request_body> of a cURL command; null without an address.

    The address is the first word with a scheme that is no option's value, ``url`` the address from its path on. A body makes the
    method POST unless an option names one; several bodies are joined by ``&``, of equal headers the last counts.
    """
    kinds = F.create_map(*[x for kind, names in CURL_OPTIONS.items() for n in names for x in (F.lit(n), F.lit(kind))])
    none = F.lit(None).cast("string")
    found = F.array().cast("array<struct<kind: string, value: string>>")
    pair = lambda k, v: F.array(F.struct(k.alias("kind"), v.alias("value")))

    def step(acc: Column, w: Column) -> Column:
        glued = F.when(~w.startswith("--") & (F.length(w) > 2), F.element_at(kinds, F.substring(w, 1, 2)))
        own = F.element_at(kinds, w)
        add = (
            F.when(acc["waits"].isNotNull(), pair(acc["waits"], w))
            .when(own.isNotNull(), found)
            .when(w.startswith("-"), F.when(glued.isNotNull(), pair(glued, w.substr(F.lit(3), F.length(w)))).otherwise(found))
            .when(F.contains(w, F.lit("://")), pair(F.lit("address"), w))
            .otherwise(found)
        )
        return F.struct(F.when(acc["waits"].isNull(), own).alias("waits"), F.concat(acc["found"], add).alias("found"))

    parts = F.aggregate(shell_words(text), F.struct(none.alias("waits"), found.alias("found")), step, lambda acc: acc["found"])
    of = lambda p, kind: F.transform(F.filter(p, lambda x: x["kind"] == kind), lambda x: x["value"])

    def request(p: Column) -> Column:
        full, body = F.get(of(p, "address"), F.lit(0)), F.nullif(F.array_join(of(p, "body"), "&"), F.lit(""))
        path = F.regexp_replace(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
        cut = lambda h: F.struct(F.trim(F.split_part(h, F.lit(":"), F.lit(1))).alias("k"), F.trim(h.substr(F.instr(h, ":") + 1, F.length(h))).alias("v"))
        pairs = F.transform(F.filter(of(p, "header"), lambda h: F.contains(h, F.lit(":"))), cut)
        last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda y: y["k"] == x["k"]))
        method = F.upper(F.element_at(F.concat(F.array(F.when(body.isNotNull(), "POST").otherwise("GET")), of(p, "method")), -1))
        return F.when(
            full.isNotNull(),
            F.struct(
                method.alias("method"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("url"), full.alias("full_url"),
                F.map_from_entries(last).alias("headers"), body.alias("request_body"),
            ),
        )

    return F.element_at(F.transform(F.array(parts), request), 1)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Captured sessions from JSON files, one object per line."""
    return spark.read.schema(SESSION).json(path)


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over a landing folder."""
    return spark.readStream.schema(SESSION).json(path)


def requests_of(sessions: DataFrame) -> DataFrame:
    """One row per captured request, numbered from 1 where the capture gave no order."""
    r = sessions.select("session_id", "user_action", F.posexplode("request_chain").alias("i", "r"))
    return r.select("session_id", "user_action", "r.*", F.coalesce("r.seq", F.col("i") + 1).alias("order_no"))
