"""References to records that do not exist at the instant of the reference.

A reference is a row of some child table that names a key of a parent table; a
parent record lives from an instant (inclusive) until another (exclusive; null:
still there). The plan is a left anti-join of the distinct non-null references
(key and instant) against the distinct parent lifetimes, joined back to the
rows for identities and counts.

Scale: the exact repeats on both sides fall away map-side before the shuffle.
The anti-join and the join back are equi-joins whose left side is a plain scan
or distinct set, so adaptive execution may split a hot key's partition; no key
is collected and nothing is broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

REF = "__ref"


def references(df: DataFrame, name: str, key: Sequence[str], at: str, row_id: str = "id") -> DataFrame:
    """Child rows as (table_name, row_id, k0.., at); only the named columns are read.

    Rows with a null in any part of the key are no references and are left out;
    a row whose instant is null stays and counts as an orphan, as no record is
    known to live then.
    """
    parts = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]
    present = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in key])
    return df.where(present).select(
        F.lit(name).alias("table_name"), F.col(f"`{row_id}`").alias("row_id"), *parts, F.col(f"`{at}`").alias("at")
    )


def lifetimes(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Distinct parent lifetimes as (k0.., lives_from, lives_until).

    Records with a null in the key or without a start never answer a reference;
    a record whose end is not after its start lives for no instant.
    """
    parts = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]
    present = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in [*key, start]])
    alive = F.col(f"`{end}`").isNull() | (F.col(f"`{end}`") > F.col(f"`{start}`"))
    return (
        df.where(present & alive)
        .select(*parts, F.col(f"`{start}`").alias("lives_from"), F.col(f"`{end}`").alias("lives_until"))
        .distinct()
    )


def orphan_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (k0.., at) of ``refs`` for which no record of ``parents`` lives at ``at``."""
    keys = [c for c in parents.columns if c.startswith("k")]
    c, p = refs.select(*keys, "at").distinct().alias("c"), parents.alias("p")
    same = reduce(Column.__and__, [F.col(f"c.{k}") == F.col(f"p.{k}") for k in keys])
    there = (F.col("p.lives_from") <= F.col("c.at")) & (
        F.col("p.lives_until").isNull() | (F.col("c.at") < F.col("p.lives_until"))
    )
    return c.join(p, same & there, "left_anti")


def period(at: Column) -> Column:
    """yyyy-MM of an instant in UTC, whatever the session's zone."""
    days = F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def orphan_rows(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` that point nowhere: (table_name, period, row_id); period is yyyy-MM in UTC.

    Repeated rows with ids of their own are all returned; an empty parent table
    makes every reference an orphan, an empty child table gives no row. A null
    instant gives a null period.
    """
    keys = [c for c in parents.columns if c.startswith("k")]
    r, o = refs.alias("r"), orphan_keys(refs, parents).alias("o")
    same = reduce(Column.__and__, [F.col(f"r.{k}") == F.col(f"o.{k}") for k in keys])
    hit = r.join(o, same & F.col("r.at").eqNullSafe(F.col("o.at")), "left_semi")
    return hit.select("table_name", period(F.col("at")).alias("period"), "row_id")


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table and period: rows that refer, rows that refer to nothing, and their share."""
    seen = refs.groupBy("table_name", period(F.col("at")).alias("period")).agg(
        F.count(F.lit(1)).alias("n_references")
    )
    lost = orphans.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
    same = (F.col("s.table_name") == F.col("l.table_name")) & F.col("s.period").eqNullSafe(F.col("l.period"))
    n = F.coalesce(F.col("l.n_orphans"), F.lit(0))
    return seen.alias("s").join(lost.alias("l"), same, "left").select(
        "s.table_name",
        "s.period",
        "s.n_references",
        n.alias("n_orphans"),
        F.round(n / F.col("s.n_references"), 6).alias("orphan_share"),
    )
