"""Per-key results without one busy task: range partitions on (key, order), then stitched boundary states.

Rows are range-partitioned on the composite of key and a secondary order by
sampled quantiles, so a key that holds a third of all rows is spread over a
third of the partitions instead of filling one. Every partition reduces its
sorted rows to one partial state per key; only the states, at most one per key
and partition, are shuffled by key and put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

STATE = (
    "key_no int, key_value string, n_rows long, n_marked long, n_timed long, "
    "first_us long, first_id long, last_us long, last_id long, gap_us long"
)
NONE = np.iinfo(np.int64).min


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One state per run of equal keys in rows sorted by (key, time, id)."""
    no, val = pdf["key_no"].to_numpy(), pdf["key_value"].to_numpy(object)
    null = pd.isna(val)
    text = np.where(null, "", val)
    new = np.ones(len(pdf), bool)
    new[1:] = (no[1:] != no[:-1]) | (null[1:] != null[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    us, ids = pdf["us"].to_numpy("int64"), pdf["id"].to_numpy("int64")
    timed = us != NONE
    gap = np.zeros(len(pdf), "int64")
    gap[1:] = np.where(~new[1:] & timed[1:] & timed[:-1], us[1:] - us[:-1], 0)
    end = np.append(at[1:], len(pdf)) - 1
    n_timed = np.add.reduceat(timed.astype("int64"), at)
    first = np.minimum(end, at + (end - at + 1 - n_timed))  # rows without a time sort first
    return pd.DataFrame(
        {
            "key_no": no[at],
            "key_value": val[at],
            "n_rows": end - at + 1,
            "n_marked": np.add.reduceat(pdf["mark"].to_numpy("int64"), at),
            "n_timed": n_timed,
            "first_us": us[first],
            "first_id": ids[first],
            "last_us": us[end],
            "last_id": ids[end],
            "gap_us": np.maximum.reduceat(gap, at),
        }
    )


def _merge(a: dict, b: dict) -> dict:
    """State of the rows of ``a`` followed by those of ``b``, of one key."""
    out = dict(b)
    between = b["first_us"] - a["last_us"] if a["n_timed"] and b["n_timed"] else 0
    for c in ("n_rows", "n_marked", "n_timed"):
        out[c] = a[c] + b[c]
    if a["n_timed"] or not b["n_timed"]:
        out["first_us"], out["first_id"] = a["first_us"], a["first_id"]
    out["gap_us"] = max(a["gap_us"], b["gap_us"], between)
    return out


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    carry: dict | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        st = _runs(pdf)
        if carry is not None:
            head = st.iloc[0].to_dict()
            same = carry["key_no"] == head["key_no"] and (
                carry["key_value"] == head["key_value"] or (pd.isna(carry["key_value"]) and pd.isna(head["key_value"]))
            )
            if same:
                merged = _merge(carry, head)
                for c, v in merged.items():
                    st.at[st.index[0], c] = v
            else:
                yield pd.DataFrame([carry])
        carry = st.iloc[-1].to_dict()
        if len(st) > 1:
            yield st.iloc[:-1]
    if carry is not None:
        yield pd.DataFrame([carry])


def boundary_states(
    df: DataFrame, keys: Sequence[str], time: str, row_id: str, mark: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Partial states (``STATE``) of every key column, one per key and range partition.

    All key columns go through one shuffle of narrow rows: (column, value,
    time, id, mark). ``mark`` counts its non-null values per key. Null keys
    form a key of their own; null times sort first and open no gap; null ids
    count as 0. ``partitions`` fixes the number of ranges, else the session's
    number, joined by adaptive execution where small.
    """
    us = F.coalesce(F.unix_micros(F.col(f"`{time}`")), F.lit(NONE)).alias("us")
    ids = F.coalesce(F.col(f"`{row_id}`").cast("long"), F.lit(0)).alias("id")
    has = (F.col(f"`{mark}`").isNotNull().cast("tinyint") if mark else F.lit(0).cast("tinyint")).alias("mark")
    pairs = F.array(
        *[F.struct(F.lit(i).alias("key_no"), F.col(f"`{k}`").cast("string").alias("key_value")) for i, k in enumerate(keys)]
    )
    rows = df.select(F.explode(pairs).alias("kv"), us, ids, has).select("kv.key_no", "kv.key_value", "us", "id", "mark")
    by = ["key_no", "key_value", "us", "id"]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by).mapInPandas(_states, STATE)


def stitch(states: DataFrame) -> DataFrame:
    """Put the partial states of each key together, in their order.

    A key has at most one state per range partition, so neither the window nor
    the group grows with its number of rows.
    """
    pieces = Window.partitionBy("key_no", "key_value").orderBy("first_us", "first_id", "last_us", "last_id")
    timed = F.col("n_timed") > 0
    before = F.lag(F.when(timed, F.col("last_us"))).over(pieces)
    joint = F.when(timed & before.isNotNull(), F.col("first_us") - before).otherwise(F.lit(0))
    return (
        states.withColumn("joint_us", joint)
        .groupBy("key_no", "key_value")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_marked").alias("n_marked"),
            F.count(F.lit(1)).alias("n_pieces"),
            F.min(F.when(timed, F.col("first_us"))).alias("first_us"),
            F.max(F.when(timed, F.col("last_us"))).alias("last_us"),
            F.max(F.greatest("gap_us", "joint_us")).alias("max_gap_us"),
        )
    )


def per_key(
    df: DataFrame, keys: Sequence[str], time: str, row_id: str, mark: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Per key column and value: rows, marked rows, first and last time, longest pause, share of all rows, pieces.

    Columns: key_column, key_value (as text, null for the null key), n_rows,
    n_marked, first_at, last_at, max_gap_us (0 for fewer than two timed rows),
    n_pieces (range partitions the key was spread over), share. One action
    counts the rows of ``df`` (parquet: from the footers). An empty table gives
    no row.
    """
    total = df.count()
    names = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("key_no") + 1)
    return stitch(boundary_states(df, keys, time, row_id, mark, partitions)).select(
        names.alias("key_column"),
        "key_value",
        "n_rows",
        "n_marked",
        F.timestamp_micros("first_us").alias("first_at"),
        F.timestamp_micros("last_us").alias("last_at"),
        "max_gap_us",
        "n_pieces",
        (F.col("n_rows") / F.lit(max(1, total))).alias("share"),
    )


def heavy_keys(results: DataFrame, min_share: float) -> DataFrame:
    """The keys of :func:`per_key` that hold at least ``min_share`` of all rows; the null key is none."""
    return results.where((F.col("share") >= F.lit(min_share)) & F.col("key_value").isNotNull())
