"""Windowed aggregates over event streams, run over what a landing folder holds (Trigger.AvailableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from thicket.session import ensure_checkpoint_dir


def _shared(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table's files as a stream of appended rows."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{base}/{name}.parquet*")


def finish(result: DataFrame, mode: str, partitions: int | None = None) -> DataFrame:
    """Run a streaming result to the end of its input and give its rows.

    In ``complete`` mode the rows of the last batch stand, in ``append`` mode those of all. A batch that is run again replaces its own rows.
    """
    spark = result.sparkSession
    out, state = _shared(spark, "stream"), _shared(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/__batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out).select(*result.columns)


def tumbling(spark: SparkSession, base: str, name: str, at: str, key: str, value: str, width: str) -> DataFrame:
    """(window_start, key, n, total) per window of ``width``."""
    s = stream(spark, base, name).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    done = finish(s.select(F.col("window.start").alias("window_start"), key, "n", "total"), "complete")
    return done.withColumn("total", F.round("total", 6))


def sessions(spark: SparkSession, base: str, name: str, at: str, key: str, gap: str) -> DataFrame:
    """(key, first_at, last_at, n) of sessions: events of a key less than ``gap`` apart."""
    s = stream(spark, base, name).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
    return finish(s.drop("w"), "complete")


def closed_sessions(events: DataFrame, at: str, key: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a stream as they close; events later than ``lateness`` behind the newest are dropped."""
    s = events.withWatermark(at, lateness).groupBy(key, F.session_window(at, gap).alias("w"))
    return s.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).drop("w")
