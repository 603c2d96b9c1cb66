"""Streams of events: running counts, windows with watermarks, and histories kept as state.

Each function starts a query on the events files with the availableNow trigger, writes to the shared folder and
returns what was written, so that it can be compared with its batch twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from histrank.session import shared_dir, table


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, with ts as a timestamp in UTC."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str) -> DataFrame:
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    numbers = range((query.lastProgress or {"batchId": -1})["batchId"] + 1) if mode == "append" else [(query.lastProgress or {"batchId": -1})["batchId"]]
    paths = [f"{out}/batch={n}" for n in numbers if n >= 0]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, n, total) over all events so far."""
    rows = events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return _run(rows, "complete").select("event_type", "n", F.round("total", 4).alias("total"))


def stream_windows(spark: SparkSession, d: str, length: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n) of windows that are closed; events more than a day behind the newest of earlier batches are late and dropped.

    A window is closed, given out once and its state removed when its end is a day behind the newest event.
    """
    return _closed(window_counts(events(spark, d), F.window("ts", length, slide), "event_type"))


def window_counts(stream: DataFrame, window: Column, by: str) -> DataFrame:
    """(start, by, n) of the stream's windows, with a watermark of a day on ts."""
    rows = stream.withWatermark("ts", "1 day").groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), by, "n")


def stream_sessions(spark: SparkSession, d: str, gap: str) -> DataFrame:
    """(start, user_id, n) of closed sessions: events of a user that follow each other within the gap."""
    return _closed(window_counts(events(spark, d), F.session_window("ts", gap), "user_id"))


def _closed(rows: DataFrame) -> DataFrame:
    return _run(rows, "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_histories(spark: SparkSession, d: str, length: int) -> DataFrame:
    """(user_id, event_id, history): up to `length` earlier events of the user, which the state keeps between batches.

    Events of one batch are put in order of time; a batch's events of one user fit in memory.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ids, histories = [], []
        for event in pdf.event_id:
            if kept:
                ids.append(event)
                histories.append(list(kept))
            kept = [*kept, int(event)][-length:]
        state.update((kept,))
        yield pd.DataFrame({"user_id": [key[0]] * len(ids), "event_id": ids, "history": histories})

    rows = events(spark, d).select("user_id", "event_id", "ts").groupBy("user_id")
    return _run(rows.applyInPandasWithState(step, "user_id bigint, event_id bigint, history array<bigint>", "kept array<bigint>", "append", GroupStateTimeout.NoTimeout), "append")
