"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a queue in shuffled (hashed) order, the whole
queue over again for every allowed repeat. A document's virtual finish time is
its source's cumulative tokens, itself included, divided by the source's weight; all
queues are merged by a range sort on finish time and the mix ends at the total
budget. Sources that run out leave their place to the others, in proportion to weight.

Scale: no source is ever held by one task. Running sums go over range
partitions of (group, order) by sampled quantiles: every partition sums its own
sorted rows, the sums of whole partitions, at most one per partition and
group, are added up on the driver and sent back. Each of both orders is one
shuffle and written once to the shared folder. Only copies that can be reached
within the budget are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from thicket.session import stored

#: Rows of a range partition: about so many where there is little, at most so many in the mean.
RANGE_ROWS, MOST_ROWS = 20_000, 1_000_000


def source_key(c: Column) -> Column:
    """Spelling of a source for comparison: trimmed, lower case."""
    return F.lower(F.trim(c))


def _running(group: Sequence[str], value: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last, carry = None, 0
        for pdf in frames:
            if not len(pdf):
                continue
            if group:
                keys = pdf[group[0]] if len(group) == 1 else pd.Series(list(zip(*(pdf[g] for g in group))), index=pdf.index)
                new = (keys != keys.shift()).cumsum()
                sums = pdf[value].groupby(new).cumsum()
                if keys.iloc[0] == last:
                    sums = sums + np.where(new == new.iloc[0], carry, 0)
                last = keys.iloc[-1]
            else:
                sums = pdf[value].cumsum() + carry
            carry = int(sums.iloc[-1])
            yield pdf.assign(__part=part, __in=sums)

    return run


def cumulative(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, n_rows: int) -> DataFrame:
    """``df`` with ``name`` = sum of ``value`` (whole numbers) over the rows of its group up to and with this one in ``order``.

    ``order`` must tell all rows of a group apart; null groups are not allowed. ``n_rows``, about the number of rows,
    sets the number of range partitions. One group may span any number of them.
    """
    spark = df.sparkSession
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n_rows / RANGE_ROWS))
    by = [*group, *order]
    ranged = df.repartitionByRange(max(1, few, ceil(n_rows / MOST_ROWS)), *by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __part int, __in long"
    summed = stored(ranged.mapInPandas(_running(list(group), value), schema))
    totals = summed.groupBy("__part", *group).agg(F.max("__in").alias("__all")).collect()
    before: dict[tuple, int] = {}
    rows = []
    for r in sorted(totals, key=lambda r: r["__part"]):
        key = tuple(r[g] for g in group)
        rows.append((r["__part"], *key, before.get(key, 0)))
        before[key] = before.get(key, 0) + r["__all"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for g in group for f in df.schema if f.name == g)
    offsets = spark.createDataFrame(rows, f"__part int, {kinds}__before long")
    # one row per partition and group
    out = summed.join(F.broadcast(offsets), ["__part", *group]).withColumn(name, F.col("__before") + F.col("__in"))
    return out.select(*df.columns, name)


def fill_level(weights: list[float], caps: list[float], budget: float) -> float:
    """Virtual time at which queues of these weights and lengths have sent ``budget`` together (inf: never)."""
    open_w, left, now = sum(weights), float(budget), 0.0
    for end, w in sorted((c / w, w) for w, c in zip(weights, caps)):
        need = (end - now) * open_w
        if need >= left:
            return now + left / open_w
        left, now, open_w = left - need, end, open_w - w
    return float("inf")


class Mix:
    """A mix of ``documents`` (doc_id long, source string, n_tokens) by ``targets`` (source, target_weight, max_repeats).

    Sources are compared trimmed and in lower case; targets spelled alike are
    taken together (weights added, the larger repeats). A null weight leaves a
    source out, a weight of zero or less gives it no share; null repeats mean
    1. Documents without tokens or without a source in the mix are not used;
    equal or null doc_ids are each used. The budget defaults to the tokens of
    all documents whose source has a weight. Making a Mix runs one pass over
    the documents (their sizes are kept in the shared folder, with a serial number
    that tells equal ones apart) and collects one row per target source.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7):
        spark = documents.sparkSession
        named = targets.select("source", source_key(F.col("source")).alias("key"), "target_weight", "max_repeats")
        self.targets = (
            named.where(F.col("key").isNotNull() & F.col("target_weight").isNotNull())
            .groupBy("key")
            .agg(
                F.min("source").alias("source"),
                F.sum(F.greatest("target_weight", F.lit(0.0))).alias("weight"),
                F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("repeats"),
            )
        )
        sized = documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("key"), F.col("n_tokens").cast("long").alias("n_tokens"),
            F.monotonically_increasing_id().alias("serial"),
        ).where("n_tokens > 0")
        self.sized = stored(sized.join(self.targets.select("key"), "key", "left_semi"))
        own = self.sized.groupBy("key").agg(F.sum("n_tokens").alias("own"), F.count(F.lit(1)).alias("n_docs"))
        rows = self.targets.join(own, "key", "left").na.fill({"own": 0, "n_docs": 0}).collect()
        self.budget = sum(r.own for r in rows) if budget is None else budget
        whole = sum(r.weight for r in rows)
        live = [r for r in rows if r.weight > 0 and r.own > 0 and r.repeats > 0]
        level = fill_level([r.weight for r in live], [r.own * r.repeats for r in live], self.budget)
        plan = [
            (r.key, r.source, r.weight, r.repeats, r.own, r.weight / whole if whole else 0.0,
             min(r.repeats, int(min(r.repeats, r.weight * level / r.own)) + 1) if r in live else 0)
            for r in rows
        ]
        self.plan = spark.createDataFrame(
            plan, "key string, source string, weight double, repeats int, own long, target_share double, rounds int"
        )
        self.level, self.seed = level, seed
        self.n_docs = sum(r.n_docs for r in rows)
        self.n_rows = sum(r.n_docs * p[6] for r, p in zip(rows, plan))

    def queue(self) -> DataFrame:
        """The mix in order: doc_id, source, round, n_tokens, finish_time, upto_tokens (tokens of the mix so far)."""
        shuffled = self.sized.withColumn("h", F.xxhash64(F.lit(self.seed), "doc_id", "n_tokens", "serial"))
        queued = cumulative(shuffled, ["key"], ["h", "serial"], "n_tokens", "in_round", self.n_docs).join(F.broadcast(self.plan), "key")
        copies = queued.where("rounds > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
        sent = F.col("round") * F.col("own") + F.col("in_round")
        timed = copies.withColumn("finish_time", sent / F.col("weight"))
        if self.level != float("inf"):  # later ones can't start within the budget
            timed = timed.where((sent - F.col("n_tokens")) / F.col("weight") <= F.lit(self.level * (1 + 1e-9)))
        timed = timed.select("doc_id", "source", "round", "n_tokens", "finish_time", "serial")
        merged = cumulative(timed, [], ["finish_time", "source", "serial", "round"], "n_tokens", "upto_tokens", self.n_rows)
        return merged.where(F.col("upto_tokens") <= F.lit(self.budget)).drop("serial")

    def report(self) -> DataFrame:
        """Per source of the mix: shares wished and reached, tokens, most copies of one document, and whether it ran out short of its share."""
        total = F.lit(max(1, self.budget))
        used = self.queue().groupBy("source").agg(
            F.sum("n_tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("n_rows"), (F.max("round") + 1).alias("most_copies")
        )
        r = self.plan.join(used, "source", "left").na.fill({"mix_tokens": 0, "n_rows": 0, "most_copies": 0})
        spent = F.col("mix_tokens") >= F.col("own") * F.col("repeats")
        return r.select(
            "source",
            "target_share",
            (F.col("mix_tokens") / total).alias("reached_share"),
            "mix_tokens",
            F.col("own").alias("own_tokens"),
            "repeats",
            "most_copies",
            (spent & (F.col("mix_tokens") < F.col("target_share") * F.lit(self.budget))).alias("short"),
        )
