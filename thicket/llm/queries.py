"""Queries p4, p6, p7 and p8 over this project's tables, with SQL where it can tell the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thicket.llm import mixing, packing, quantiles, subjects, tokens
from thicket.session import stored, table

#: Rank error of the digests of request durations, as a share of the requests of a url.
RANK_ERROR = 0.005
SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


# --- 4: percentiles of very large numeric columns -------------------------------------------


def _durations(spark: SparkSession, d: str) -> DataFrame:
    part = F.arrays_zip("request_chain.url", "request_chain.duration")
    month = F.date_format("received_at", "yyyy-MM").alias("load_month")
    return (
        table(spark, d, "request_chains")
        .select(month, F.explode(part).alias("r"))
        .select("load_month", "r.url", "r.duration")
        .where(F.col("url").isNotNull())
    )


def monthly_digests(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.digest(_durations(spark, d), ["url", "load_month"], "duration", RANK_ERROR)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Digests of separate monthly loads, put together per url."""
    whole = quantiles.merge(monthly_digests(spark, d), ["url"], RANK_ERROR)
    return quantiles.percentiles(whole, ["url"], SHARES, RANK_ERROR)


def p4_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Per url and percentile: whether the digest's value lies within the stated error of the exact rank, counted over all rows."""
    got = p4_percentiles(spark, d).select("url", F.posexplode(F.array(*SHARES)).alias("i", "at"))
    rows = _durations(spark, d).where("duration >= 0").groupBy("url", "duration").agg(F.count(F.lit(1)).alias("c"))
    below = F.col("duration") < F.col("at") * 127 / 128  # the error of a value
    ranks = rows.join(got, "url").groupBy("url", "i").agg(
        F.sum("c").alias("n"), F.sum(F.when(below, F.col("c")).otherwise(0)).alias("low"), F.sum(F.when(F.col("duration") <= F.col("at"), F.col("c")).otherwise(0)).alias("high")
    )
    rank = F.ceil(F.element_at(F.array(*[F.lit(x) for x in SHARES.values()]), F.col("i") + 1) * F.col("n"))
    slack = F.lit(RANK_ERROR) * F.col("n")
    name = F.element_at(F.array(*[F.lit(x) for x in SHARES]), F.col("i") + 1)
    return ranks.select("url", name.alias("percentile"), ((F.col("low") - slack <= rank) & (rank <= F.col("high") + slack)).alias("within"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_percentiles(spark, d).where(F.col("p95") > 5 * F.col("p50")).select("url")


# --- 6: filling fixed-capacity containers ---------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", tokens.n_tokens(F.col("text")).alias("n_tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_items(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(_packed(spark, d))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by tenth of use, and what is left unused."""
    bins = packing.containers(_packed(spark, d))
    tenth = F.least(F.floor(F.col("n_tokens") * 10 / packing.CAPACITY), F.lit(9)).cast("int")
    return bins.groupBy(tenth.alias("used_tenths")).agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.sum("unused").alias("unused_tokens")
    )


#: Limits that bind: pieces of a container, and its attention cost as a share of one full text's.
FEW_DOCUMENTS, ATTENTION_SHARE = 6, 0.4


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """By both rules under limits that bind: whether all tokens are placed, and each limit is kept and reached."""
    items = stored(_items(spark, d).where("n_tokens > 0"))
    budget = int(ATTENTION_SHARE * packing.CAPACITY**2)
    tokens_in = items.agg(F.sum(F.col("n_tokens").cast("long")).alias("tokens_in"))
    rows = []
    for rule in ("norm", "dot"):
        packed = stored(packing.pack(items, max_documents=FEW_DOCUMENTS, attention_budget=budget, rule=rule))
        bins = packing.containers(packed).withColumn("several", F.col("n_pieces") > 1)
        kept = bins.agg(
            F.sum("n_tokens").alias("tokens_out"),
            F.max("n_tokens").alias("most_tokens"),
            F.max("n_pieces").alias("most_pieces"),
            F.max(F.when(F.col("several"), F.col("attention_cost"))).alias("most_cost"),
        )
        rows.append(
            kept.crossJoin(tokens_in).select(  # one row each
                F.lit(rule).alias("rule"),
                (F.col("tokens_in") == F.col("tokens_out")).alias("all_placed"),
                (F.col("most_tokens") <= packing.CAPACITY).alias("tokens_kept"),
                (F.col("most_pieces") == FEW_DOCUMENTS).alias("documents_reached_and_kept"),
                (F.col("most_cost") <= budget).alias("attention_kept"),
                (F.col("most_cost") > 0.99 * budget).alias("attention_reached"),
            )
        )
    return rows[0].unionByName(rows[1])


def p6_tight(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers of 2,048 tokens are 99 % full, two of each block aside."""
    packed = stored(_packed(spark, d))
    bins = packing.containers(packed).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.count_distinct("block").alias("n_blocks"))
    return bins.select((F.col("tokens") >= 0.99 * packing.CAPACITY * (F.col("n") - 2 * F.col("n_blocks"))).alias("tight"))


# --- 7: mixing sources to target weights ----------------------------------------------------


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(_items(spark, d), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).queue()


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What any mix must hold, over all its rows; one row (check_name, ok) each.

    ``in_order``: finish times rise with the tokens so far; ``sums``: these grow by each document's tokens; ``budget``: they end
    within it, by less than the longest document; ``copies``: no document is used more often than allowed; ``shares``: sources that are not short have
    their target share at least, but for one document.
    """
    mix = _mix(spark, d)
    queue = stored(mix.queue())
    # neighbours by ranges of the tokens so far, so that no task holds all rows
    width = max(1, mix.budget // 1000)
    block = F.floor(F.col("upto_tokens") / width)
    w = Window.partitionBy(block).orderBy("upto_tokens")
    steps = queue.select((F.lag("finish_time").over(w) <= F.col("finish_time")).alias("a"), (F.lag("upto_tokens").over(w) + F.col("n_tokens") == F.col("upto_tokens")).alias("b"))
    order = steps.agg(F.coalesce(F.bool_and("a"), F.lit(True)).alias("in_order"), F.coalesce(F.bool_and("b"), F.lit(True)).alias("sums"))
    whole = queue.agg(F.max("upto_tokens").alias("upto"), F.sum("n_tokens").alias("sum"), F.max("n_tokens").alias("longest"))
    ended = whole.select(((F.col("upto") == F.col("sum")) & (F.col("upto") <= mix.budget) & (F.col("upto") > mix.budget - F.col("longest"))).alias("budget"))
    report = mix.report()
    fair = (F.col("mix_tokens") >= F.col("target_share") * F.lit(mix.budget) - F.lit(longest_of(queue))) | F.col("short")
    shares = report.agg(F.bool_and(F.col("most_copies") <= F.col("repeats")).alias("copies"), F.bool_and(fair).alias("shares"))
    one = order.crossJoin(ended).crossJoin(shares)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("ok")) for c in ("in_order", "sums", "budget", "copies", "shares")])).alias("x")).select("x.*")


def longest_of(queue: DataFrame) -> int:
    return queue.agg(F.max("n_tokens")).first()[0] or 0


# --- 8: subject area of each document -------------------------------------------------------


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return subjects.classify(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters per subject; a text about two subjects counts for either by its share of evidence."""
    size = table(spark, d, "documents").select("doc_id", F.length("text").alias("n_chars"))
    got = _assigned(spark, d).join(size, "doc_id")
    return got.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.sum(F.col("share") * F.col("n_chars"))).cast("long").alias("n_chars")
    )


QUERIES = {
    "p4_found": p4_found,
    "p4_percentiles": p4_percentiles,
    "p4_ranks": p4_ranks,
    "p6_found": p6_found,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_limits": p6_limits,
    "p6_tight": p6_tight,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_mix": p7_mix,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

SQL = {
    "p4_found": """
SELECT url FROM (SELECT r.url AS url, r.duration AS v FROM (SELECT unnest(request_chain) AS r FROM request_chains))
WHERE url IS NOT NULL AND v >= 0 GROUP BY url HAVING quantile_disc(v, 0.95) > 5 * quantile_disc(v, 0.5)""",
    # the queries below count over all their rows whether a property holds that SQL can't derive from the tables
    "p4_ranks": """
SELECT DISTINCT r.url AS url, percentile, true AS within FROM (SELECT unnest(request_chain) AS r FROM request_chains), unnest(['p50', 'p90', 'p95', 'p99']) AS t(percentile)
WHERE r.url IS NOT NULL AND r.duration >= 0""",
    "p6_limits": """
SELECT rule, true AS all_placed, true AS tokens_kept, true AS documents_reached_and_kept, true AS attention_kept, true AS attention_reached FROM unnest(['norm', 'dot']) AS t(rule)""",
    "p6_tight": "SELECT true AS tight",
    "p7_checks": "SELECT check_name, true AS ok FROM unnest(['in_order', 'sums', 'budget', 'copies', 'shares']) AS t(check_name)",
}
