"""Filling containers of fixed capacity: vector best fit over tokens, documents and attention cost.

A container holds at most ``capacity`` tokens, ``max_documents`` pieces and an
attention cost (sum of squared lengths) of at most ``attention_budget``. Texts
longer than the capacity are cut into full containers and one remainder;
nothing else is cut. The sizes are written to the shared folder with a serial
number, so that counting pieces and dealing them needs no second tokenizing and
no executor's loss deals a piece twice. Pieces are dealt by the hash of their
serial number into blocks of some ``BLOCK`` pieces, whatever their ids, and
each block is packed on its own in descending length, every piece into the open
container that its weighted score prefers among those where it fits under every
constraint. A block leaves at most a few containers partly filled among
thousands, so the loss by dividing the work does not grow with the data.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from thicket.session import stored

CAPACITY = 2048
MAX_DOCUMENTS = 256
BLOCK = 20_000
#: Blocks that a task packs where there are more than tasks.
BLOCKS_A_TASK = 16
#: Weights of the residuals of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.05, 0.05)
PACKED = (
    "block long, container int, doc_id long, piece int, n_pieces int, start_token long, n_tokens int, doc_tokens long"
)


def best_fit(
    sizes: np.ndarray, capacity: int, max_documents: int, attention_budget: int, weights=WEIGHTS, rule: str = "norm"
) -> np.ndarray:
    """Container number of each size (1..capacity), taken in descending order.

    Residuals are measured in shares of each capacity. Rule ``norm`` takes the
    container whose weighted residual norm is least once the piece is in;
    ``dot`` the one whose weighted dot product of residual and demand is
    greatest. Ties go to the oldest container. A piece whose own attention cost
    exceeds the budget gets a container to itself.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    cap = np.array([capacity, max_documents, attention_budget], "float64")
    w = np.asarray(weights, "float64")
    out = np.zeros(len(sizes), "int32")
    free = np.zeros((3, 1024))
    number = np.zeros(1024, "int32")
    n_open = n_bins = 0
    order = np.argsort(-sizes, kind="stable")
    least = int(sizes.min()) if len(sizes) else 0
    ws = w / cap**2
    for i in order:
        s = int(sizes[i])
        need = (s, 1, s * s)
        at = -1
        if n_open and need[2] <= attention_budget:
            f = free[:, :n_open]
            fits = np.flatnonzero((f[0] >= s) & (f[1] >= 1) & (f[2] >= need[2]))
            if len(fits):
                c = f[:, fits]
                if rule == "norm":
                    score = ws[0] * (c[0] - s) ** 2 + ws[1] * (c[1] - 1) ** 2 + ws[2] * (c[2] - need[2]) ** 2
                    at = int(fits[np.argmin(score)])
                else:
                    score = ws[0] * c[0] * s + ws[1] * c[1] + ws[2] * c[2] * need[2]
                    at = int(fits[np.argmax(score)])
        if at < 0:
            out[i] = n_bins
            n_bins += 1
            if capacity - s >= least and max_documents > 1 and attention_budget - need[2] >= least * least:
                if n_open == free.shape[1]:
                    free, number = np.concatenate([free, np.zeros_like(free)], 1), np.concatenate([number, np.zeros_like(number)])
                free[:, n_open] = capacity - s, max_documents - 1, attention_budget - need[2]
                number[n_open] = n_bins - 1
                n_open += 1
            continue
        out[i] = number[at]
        free[:, at] -= need
        if free[0, at] < least or free[1, at] < 1 or free[2, at] < least * least:  # nothing fits any more
            free[:, at : n_open - 1] = free[:, at + 1 : n_open].copy()
            number[at : n_open - 1] = number[at + 1 : n_open].copy()
            n_open -= 1
    return out


def pack(
    items: DataFrame,
    capacity: int = CAPACITY,
    max_documents: int = MAX_DOCUMENTS,
    attention_budget: int | None = None,
    rule: str = "norm",
    block: int = BLOCK,
) -> DataFrame:
    """Place every item of ``items`` (doc_id long, n_tokens) in containers: see ``PACKED``.

    Items without tokens (null, zero) need no container and give no row; items
    of equal or null doc_id are each placed. ``(block, container)`` names a
    container, ``piece`` counts an item's parts from 0, and
    ``start_token``..``start_token + n_tokens`` is the part's place in its text.
    ``attention_budget`` defaults to capacity squared, the cost of one full
    container, which nothing that fits by tokens exceeds; give less to bind it.
    Writes the sizes to the shared folder and counts their pieces.
    """
    if capacity < 1 or max_documents < 1 or block < 1:
        raise ValueError("capacity, max_documents and block must be at least 1")
    budget = capacity * capacity if attention_budget is None else attention_budget
    n = F.col("n_tokens").cast("long")
    sized = items.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("doc_tokens"), F.monotonically_increasing_id().alias("serial"))
    sized = stored(sized.where("doc_tokens > 0").withColumn("n_pieces", F.ceil(F.col("doc_tokens") / capacity).cast("int")))
    blocks = max(1, ceil((sized.agg(F.sum("n_pieces")).first()[0] or 0) / block))
    pieces = (
        sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
        .withColumn("start_token", F.col("piece").cast("long") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start_token")).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("serial", "piece"), F.lit(blocks)))
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["serial", "piece"], kind="stable", ignore_index=True)
        pdf["container"] = best_fit(pdf["n_tokens"].to_numpy("int64"), capacity, max_documents, budget, rule=rule)
        return pdf[["block", "container", "doc_id", "piece", "n_pieces", "start_token", "n_tokens", "doc_tokens"]]

    # a given number keeps adaptive execution from putting small blocks into one task
    tasks = min(blocks, max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(blocks / BLOCKS_A_TASK)))
    return pieces.repartition(tasks, "block").groupBy("block").applyInPandas(place, PACKED)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: block, container, n_pieces, n_tokens, unused, attention_cost."""
    size = F.col("n_tokens").cast("long")
    return packed.groupBy("block", "container").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.sum(size).alias("n_tokens"),
        (F.lit(capacity) - F.sum(size)).alias("unused"),
        F.sum(size * size).alias("attention_cost"),
    )


def cut_documents(packed: DataFrame) -> DataFrame:
    """Distinct doc_id of the items that were cut."""
    return packed.where(F.col("n_pieces") > 1).select("doc_id").distinct()
