"""Streaming forms of the stateful operators; each takes an events stream and returns a streaming frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, late: str = "10 minutes") -> DataFrame:
    """The events as a stream with a watermark on their time, which has to be a timestamp with a zone."""
    stream = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")  # a pattern finds a file as well as a folder of files
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def settlement(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling sums by event type (ECO5)."""
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("total")).select(
        F.unix_seconds("window.start").alias("start_s"), "event_type", "n", "total"
    )


def sliding_load(stream: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Events in sliding windows (ECO3)."""
    return stream.groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("start_s"), "n")


def patterns(stream: DataFrame) -> DataFrame:
    """Running frequency, first and last of each pattern (PAT5)."""
    return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("frequency"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"))


def reputation(stream: DataFrame) -> DataFrame:
    """Clamped reputation per node, kept as state and updated in event order within each batch (CON5)."""
    impact = {"click": 0.05, "view": 0.02, "purchase": 0.1, "error": -0.2}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score = state.get[0] if state.exists else 1.0
        rows = pd.concat(list(batches))
        for kind in rows.sort_values(["ts", "event_id"])["event_type"]:
            score = min(2.0, max(0.0, score + impact.get(kind, -0.1)))
        state.update((score,))
        yield pd.DataFrame({"node_id": [key[0]], "reputation": [score]})

    return stream.groupBy(F.col("user_id")).applyInPandasWithState(update, "node_id long, reputation double", "score double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is available now, run to its end into a table in memory."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
