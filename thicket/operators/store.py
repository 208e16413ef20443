"""Changes of stored tables as plans: keyed scans, upserts, deletions, status marks, truncation, and rows as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def find_by(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal the given values (None: null; a list: any of it); reaches the scan as pushed filters and partition pruning."""
    tests = [
        F.col(c).isNull() if v is None else F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v) for c, v in values.items()
    ]
    return df.where(reduce(Column.__and__, tests, F.lit(True)))


def point_id(*key: Column) -> Column:
    """A fixed id in the form of a UUID out of the parts of a key; null if any is."""
    h = F.md5(F.concat(*[x for i, k in enumerate(key) for x in ([F.lit(":")] if i else []) + [k.cast("string")]]))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(h.isNotNull(), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], latest: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; of several new rows of a key that of greatest ``latest`` stays.

    Keys compare null-safe. ``new`` has the columns of ``old``. The join is an anti-join on the key: unchanged rows are passed on as they are.
    """
    if latest is not None:
        others = [c for c in new.columns if c not in key]
        last = new.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(latest, *[F.xxhash64(c) for c in others])).alias("__r"))
        new = last.select(*[c if c in key else F.col(f"__r.{c}").alias(c) for c in new.columns])
    o, n = old.alias("o"), new.select(*key).distinct().alias("n")
    same = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    return o.join(n, same, "left_anti").unionByName(new)


def without_parents(children: DataFrame, parent_key: str, gone: DataFrame, key: str) -> DataFrame:
    """Children that stay when the parents of ``gone`` (``key``) are deleted with all that is theirs; null references stay."""
    return children.join(gone.select(F.col(key).alias(parent_key)).where(F.col(parent_key).isNotNull()).distinct(), parent_key, "left_anti").select(*children.columns)


def mark(df: DataFrame, ids: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """``df`` with ``column`` set to ``value`` in the rows whose ``key`` is among ``ids`` (``key``); repeated and unknown ids do no harm."""
    known = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    out = df.join(known, key, "left")
    return out.withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).select(*df.columns)


def truncated(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """``df`` with texts cut to their columns' lengths in characters."""
    return df.select(*[F.substring(c, 1, lengths[c]).alias(c) if c in lengths else F.col(f"`{c}`") for c in df.columns])


def markdown_row(*cells: Column) -> Column:
    """A line of a Markdown table; bars and line ends within cells are escaped, nulls are empty."""
    clean = [F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))
