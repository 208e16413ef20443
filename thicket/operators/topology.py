"""Service topology: which repository calls which, by endpoint, by unique owner, or by package prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from thicket.functions import sig


def dominant_prefix(methods: DataFrame, segments: int) -> DataFrame:
    """(prefix, to_repo): the repository with most methods under a package prefix; ties go to the least id."""
    n = methods.groupBy(sig.first_segments(sig.class_name(F.col("full_method")), segments).alias("prefix"), "repo_id").agg(F.count("*").alias("n"))
    return n.groupBy("prefix").agg(F.min_by("repo_id", F.struct(-F.col("n"), F.col("repo_id"))).alias("to_repo"))


def resolve(calls: DataFrame, endpoints: DataFrame, methods: DataFrame, segments: int = 3) -> DataFrame:
    """``calls`` (repo_id, callee, n) with to_repo and level.

    Level 1: repositories that publish the callee as endpoint (one row each; the
    call is used up even if that is the caller's own); 2: the only repository that
    holds the method; 3: the repository that dominates its package. Calls nobody answers are left out.
    """
    ep = endpoints.where("full_method is not null").select(F.col("full_method").alias("callee"), F.col("repo_id").alias("e"), "endpoint_type").distinct()
    owner = methods.groupBy(F.col("full_method").alias("callee")).agg(F.min("repo_id").alias("a"), F.max("repo_id").alias("b")).where("a = b")
    px = dominant_prefix(methods, segments).withColumnRenamed("to_repo", "p")
    # each level once, for all calls
    known = calls.join(ep.withColumn("met", F.lit(True)), "callee", "left").join(owner.select("callee", "a"), "callee", "left")
    known = known.withColumn("prefix", sig.first_segments(sig.class_name(F.col("callee")), segments)).join(px, "prefix", "left")
    met = F.col("met").isNotNull()
    both = known.select(
        "repo_id", "callee", "n", F.when(met, F.col("e")).otherwise(F.coalesce("a", "p")).alias("to_repo"), "endpoint_type",
        F.when(met, 1).when(F.col("a").isNotNull(), 2).otherwise(3).alias("level"),
    )
    return both.where(F.col("to_repo").isNotNull() & (F.col("to_repo") != F.col("repo_id")))


def service_edges(calls: DataFrame, endpoints: DataFrame, methods: DataFrame, segments: int = 3) -> DataFrame:
    """Per pair of repositories: calls, distinct callees, and the kind of the endpoints met (MIXED for several)."""
    pairs = resolve(calls, endpoints, methods, segments)
    kind = F.when(F.col("endpoint_type").isNull(), None).when(F.col("endpoint_type").isin("CONTROLLER", "HTTP"), "HTTP").when(
        F.col("endpoint_type").rlike("KAFKA|RABBIT|ROCKET|^MQ$"), "MQ"
    ).otherwise("RPC")
    return (
        pairs.withColumn("kind", kind)
        .groupBy(F.col("repo_id").alias("from_repo"), "to_repo")
        .agg(F.sum("n").alias("n_calls"), F.count_distinct("callee").alias("n_callees"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
        .select("from_repo", "to_repo", "n_calls", "n_callees", F.when(F.col("k1") != F.col("k2"), "MIXED").otherwise(F.coalesce("k1", F.lit("RPC"))).alias("call_type"))
    )


def hot_methods(calls: DataFrame, endpoints: DataFrame, methods: DataFrame, segments: int = 3, most: int = 20) -> DataFrame:
    """The ``most`` callees with most calls per pair of repositories, with their rank."""
    n = resolve(calls, endpoints, methods, segments).groupBy(F.col("repo_id").alias("from_repo"), "to_repo", "callee").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("from_repo", "to_repo").orderBy(F.desc("n"), "callee")
    return n.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most)
