"""Keyword scoring, vector search and routing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def keyword_score(words: Sequence[str], fields: Sequence[tuple[Column, int, int]]) -> Column:
    """Sum over the words of the weights of the fields that contain them, letter case aside.

    A field is (column, weight, least word length). One-letter words count only if
    there are no others.
    """
    lower = [w.lower() for w in words if w]
    kept = [w for w in lower if len(w) > 1] or lower
    hits = [
        F.when(F.contains(F.lower(c), F.lit(w)), weight).otherwise(0) for w in kept for c, weight, least in fields if len(w) >= least
    ]
    return reduce(Column.__add__, hits, F.lit(0))


def best(df: DataFrame, score: Column, k: int | None, tie: str) -> DataFrame:
    """The ``k`` rows of greatest positive score (none: all of them), in order; ties go to the least ``tie``."""
    found = df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), tie)
    return found if k is None else found.limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long vectors; null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def nearest(vectors: DataFrame, vector: str, query: Sequence[float], k: int, tie: str, per: str | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine (per value of ``per`` where given), with ``similarity`` to nine places."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("similarity", F.round(cosine(F.col(vector), q), 9)).where("similarity is not null")
    if per is None:
        return scored.orderBy(F.desc("similarity"), tie).limit(k)
    w = Window.partitionBy(per).orderBy(F.desc("similarity"), tie)
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("rk")


#: Queries and rows that are scored together: one block of each gives some 64 MB of similarities.
QUERY_BLOCK, ROW_BLOCK = 2_000, 4_000


def nearest_batch(vectors: DataFrame, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, tie: str, per: str | None = None) -> DataFrame:
    """:func:`nearest` for every row (``query``, ``query_vector``) of ``queries``: (query, tie, per where given, similarity).

    Every block of queries meets every block of rows and keeps its own ``k``; the best of
    these are the result. ``query`` and ``tie`` are unique and not null. Vectors of another length than the query's or
    with null, NaN or no length are nobody's neighbours.
    """
    names = [query, tie, *([per] if per else [])]
    types = {f.name: f.dataType.simpleString() for df in (queries, vectors) for f in df.schema}

    def blocks(df: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // most))
        return df.withColumn("own", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n

    q, nq = blocks(queries.select(query, F.col(query_vector).cast("array<double>").alias("qv")).where("qv is not null"), query, QUERY_BLOCK)
    v, nv = blocks(vectors.select(tie, *([per] if per else []), F.col(vector).cast("array<double>").alias("v")).where("v is not null"), tie, ROW_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.col("own")).withColumn("vb", every(nv)).drop("own")
    v = v.withColumn("vb", F.col("own")).withColumn("qb", every(nq)).drop("own")

    def best_of(left, right):
        parts = []
        lengths, widths = left["qv"].map(len), right["v"].map(len)
        for size in sorted(set(lengths) & set(widths) - {0}):
            a, b = left[lengths == size], right[widths == size].sort_values(tie)
            x, y = (np.array([np.asarray(u, dtype=float) for u in c]) for c in (a["qv"], b["v"]))
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.round((x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]), 9)
            sim[np.isnan(sim)] = -np.inf
            codes = pd.factorize(b[per], use_na_sentinel=False)[0] if per else np.zeros(len(b), dtype=int)
            for group in np.unique(codes):
                at = np.flatnonzero(codes == group)
                own = sim[:, at]
                least = np.partition(own, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(a), -np.inf)
                for i in range(len(a)):
                    near = np.flatnonzero((own[i] >= least[i]) & (own[i] > -np.inf))
                    near = at[near[np.argsort(-own[i, near], kind="stable")[:k]]]  # rows are in the order of the tie
                    found = b.iloc[near][names[1:]]
                    found.insert(0, query, a[query].iloc[i])
                    found["similarity"] = sim[i, near]
                    parts.append(found)
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in [*names, "similarity"]})

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "similarity double"])
    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(best_of, schema)
    w = Window.partitionBy(query, *([per] if per else [])).orderBy(F.desc("similarity"), tie)
    return found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("rk")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: text.substr(i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def route(repos: DataFrame, question: str, name: str, text: str, few: int = 5, whole: int = 0) -> DataFrame:
    """The ``few`` repositories that a question is most about, by words and CJK pairs in their text and by name; all if none, or if there are no more than ``whole``."""
    import re

    words = sorted({w.lower() for w in re.findall(r"[A-Za-z0-9]{2,}", question)})
    runs = re.findall(r"[一-鿿]{2,}", question)
    pairs = sorted({r[i : i + 2] for r in runs for i in range(len(r) - 1)})
    t = F.lower(F.col(text))
    score = keyword_score(words, [(F.col(text), 3, 2), (F.col(name), 20, 2)])
    score = reduce(Column.__add__, [F.when(F.contains(t, F.lit(p)), 5).otherwise(0) for p in pairs], score)
    scored = repos.withColumn("score", F.coalesce(score, F.lit(0)))
    if whole and repos.limit(whole + 1).count() <= whole:
        return scored
    top = scored.where("score > 0").orderBy(F.desc("score"), name).limit(few)
    return top if not top.isEmpty() else scored
