"""Percentiles per group with a guaranteed rank error: mergeable digests of dyadic-tree counts.

A value is quantized to one of ``UNIVERSE`` ordered buckets: exact below 2**7,
above that 128 buckets per power of two, so a bucket's ends differ by less than
1/128 of their value. The buckets are the leaves of a binary tree (heap
numbering: leaf = UNIVERSE + bucket, parent = node // 2). A digest holds counts
at tree nodes; a node stays apart only while it, its sibling and their parent
together count more than n / k, so at most 3 k nodes remain and any rank is
off by at most LEVELS * n / k. Digests are merged by adding the counts of equal
nodes and compressing again, which keeps the same bound for the sum of the n.

Scale: leaf counts are pre-aggregated map-side, so what is shuffled is bounded by
groups x UNIVERSE whatever the number of rows; a hot group costs no more than
any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

MANTISSA = 7
LEVELS = 13
UNIVERSE = 1 << LEVELS
LARGEST = (1 << 62) - 1
#: Bucket of the largest value; the leaves beyond stay empty.
LAST = 54 * (1 << MANTISSA) + 2 * (1 << MANTISSA) - 1


def bucket(value: Column) -> Column:
    """Ordered bucket (0..UNIVERSE-1) of a whole number; values over 2**62 - 1 fall into its bucket."""
    v = F.least(value.cast("long"), F.lit(LARGEST))
    shift = F.greatest(F.length(F.bin(v)) - F.lit(MANTISSA + 1), F.lit(0))
    return (shift * F.lit(1 << MANTISSA) + F.call_function("shiftright", v, shift)).cast("int")


def bucket_high(b: Column) -> Column:
    """Largest value of bucket ``b``."""
    shift = F.greatest(F.call_function("shiftright", b, F.lit(MANTISSA)) - 1, F.lit(0)).cast("int")
    mantissa = b.cast("long") - shift.cast("long") * F.lit(1 << MANTISSA)
    return F.call_function("shiftleft", mantissa + 1, shift) - 1


def factor(error: float) -> int:
    """Compression factor k that keeps every rank within ``error`` of the group's size."""
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return ceil(LEVELS / error)


def compress_nodes(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress the trees of many groups at once, level by level from the leaves; groups are 0..g-1."""
    size = 2 * UNIVERSE
    limit = np.bincount(group, weights=count).astype("int64") // k
    key = group.astype("int64") * size + node
    depth = np.frexp(node.astype("float64"))[1] - 1
    kept_key, kept_count = [], []
    up_key, up_count = np.zeros(0, "int64"), np.zeros(0, "int64")
    for level in range(LEVELS, -1, -1):
        here = depth == level
        k_all = np.concatenate([key[here], up_key])
        c_all = np.concatenate([count[here], up_count])
        k_here, at = np.unique(k_all, return_inverse=True)
        c_here = np.bincount(at, weights=c_all, minlength=len(k_here)).astype("int64")
        if level == 0:
            kept_key.append(k_here), kept_count.append(c_here)
            break
        g, n = k_here // size, k_here % size
        parent, at = np.unique(g * size + n // 2, return_inverse=True)
        total = np.bincount(at, weights=c_here, minlength=len(parent)).astype("int64")
        above = depth == level - 1
        p_sorted = np.argsort(key[above], kind="stable")
        p_key, p_count = key[above][p_sorted], count[above][p_sorted]
        lo, hi = np.searchsorted(p_key, parent), np.searchsorted(p_key, parent, side="right")
        run = np.concatenate([[0], np.cumsum(p_count)])
        light = total + run[hi] - run[lo] <= limit[parent // size]
        stay = ~light[at]
        kept_key.append(k_here[stay]), kept_count.append(c_here[stay])
        up_key, up_count = parent[light], total[light]
    k_out, c_out = np.concatenate(kept_key), np.concatenate(kept_count)
    return k_out // size, k_out % size, c_out


def _compressor(by: Sequence[str], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["gid"].iloc[-1]
            done = pdf["gid"] != last
            if done.any() or (held and held[-1]["gid"].iloc[-1] != last):
                yield work(pd.concat([*held, pdf[done]]))
                held = []
            held.append(pdf[~done])
        if held:
            yield work(pd.concat(held))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        code, _ = pd.factorize(pdf["gid"])
        first = pdf.iloc[np.unique(code, return_index=True)[1]]
        g, node, n = compress_nodes(code, pdf["node"].to_numpy("int64"), pdf["n"].to_numpy("int64"), k)
        out = {c: first[c].to_numpy()[g] for c in by}
        return pd.DataFrame(out | {"node": node.astype("int32"), "n": n})

    return run


def _compress(counts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """``counts`` (by.., node, n) compressed; a group has at most 2 x UNIVERSE rows and is treated within one task."""
    keyed = counts.withColumn("gid", F.xxhash64(*by)) if by else counts.withColumn("gid", F.lit(0).cast("long"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    exact = F.concat_ws("\x00", F.hex("gid"), *text, *[F.col(c).isNull().cast("string") for c in by])
    keyed = keyed.withColumn("gid", exact)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*by).schema) + ", " * bool(by)
    return (
        keyed.repartition("gid").sortWithinPartitions("gid").mapInPandas(_compressor(list(by), k), schema + "node int, n long")
    )


def digest(df: DataFrame, by: Sequence[str], value: str, error: float) -> DataFrame:
    """Digest per group: (by.., node, n), at most 3 x ``factor(error)`` nodes each.

    Null and negative values do not count; a group without any other gives no
    row; null group keys form a group.
    """
    v = F.col(f"`{value}`")
    leaf = (bucket(v) + F.lit(UNIVERSE)).alias("node")
    counts = df.where(v >= 0).groupBy(*by, leaf).agg(F.count(F.lit(1)).alias("n"))
    return _compress(counts, by, factor(error))


def merge(digests: DataFrame, by: Sequence[str], error: float) -> DataFrame:
    """Digests of separate loads or days put together per ``by``, by adding nodes; all must have been made with ``error``."""
    return _compress(digests.groupBy(*by, "node").agg(F.sum("n").alias("n")), by, factor(error))


def percentiles(digests: DataFrame, by: Sequence[str], at: dict[str, float], error: float) -> DataFrame:
    """Per group: n, one column per name in ``at`` (share -> value), and max_rank_error.

    A value is the upper end of the bucket where the rank ceil(share * n) falls;
    its true rank lies within max_rank_error = error * n of the one asked for, and the
    bucket adds less than 1/128 of the value.
    """
    depth = F.length(F.bin("node")) - 1
    span = F.lit(LEVELS) - depth
    last = F.least(F.call_function("shiftleft", F.col("node") + 1, span) - 1 - F.lit(UNIVERSE), F.lit(LAST))
    nodes = digests.withColumn("last", last)
    up = Window.partitionBy(*by).orderBy(F.col("last"), F.col("node").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    ranked = nodes.select(*by, "last", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("total"))
    asked = [
        bucket_high(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(q)), F.col("last")))).alias(name)
        for name, q in at.items()
    ]
    n = F.max("total")
    return ranked.groupBy(*by).agg(n.alias("n"), *asked, F.ceil(n * F.lit(error)).alias("max_rank_error"))
