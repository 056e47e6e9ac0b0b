"""Structured Streaming over event tables: windows, sessions, watermark deduplication and stateful watches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.checkpoints import ensure_checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8, pattern: str = "*.parquet") -> DataFrame:
    """A stream over the parquet files of ``path`` whose names fit ``pattern``, with event time ``at``."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, size: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events and value per window and kind; rows later than ``delay`` are dropped by the watermark."""
    windows = events.withWatermark("at", delay).groupBy(F.window("at", size), "event_type")
    return windows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding_counts(events: DataFrame, size: str = "1 day", slide: str = "6 hours", delay: str = "2 days") -> DataFrame:
    """Events per kind in overlapping windows."""
    return events.withWatermark("at", delay).groupBy(F.window("at", size, slide), "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    """Events per session of a user: a session ends after ``gap`` without an event."""
    return events.withWatermark("at", delay).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each event id once; state older than the watermark is given up."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def repeat_watch(events: DataFrame, least: int = 3) -> DataFrame:
    """A row whenever a user repeats the same event kind ``least`` times running, within and across batches."""

    def watch(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kind, run = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for event, name in zip(rows["event_id"], rows["event_type"]):
            kind, run = (name, run + 1) if name == kind else (name, 1)
            if run == least:
                out.append((key[0], int(event), name))
        state.update((kind, run))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])

    keyed = events.select("user_id", "event_id", "event_type", "at").groupBy("user_id")
    return keyed.applyInPandasWithState(watch, "user_id bigint, event_id bigint, event_type string", "kind string, run int", "append", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and return the table it wrote (for bounded inputs)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream's rows to parquet files, once for all input that is there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_shared(stream: DataFrame) -> DataFrame:
    """Run an append stream over all that is there into the shared folder and return what it wrote."""
    folder = _scratch(stream.sparkSession)
    run_to_files(stream, f"{folder}/rows", f"{folder}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_upserts(events: DataFrame) -> DataFrame:
    """(event_type, n, last_event): totals that ``foreachBatch`` keeps up to date.

    Each batch's totals are merged with those before into a table of the batch's own number, so a batch that is run again
    after a failure writes the same table again.
    """
    spark, folder = events.sparkSession, _scratch(events.sparkSession)
    kept = {"n": -1}

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
        if number > 0:
            new = new.unionByName(spark.read.parquet(f"{folder}/totals-{number - 1}"))
        new.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event")).write.mode("overwrite").parquet(f"{folder}/totals-{number}")
        kept["n"] = number

    events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if kept["n"] < 0:
        return spark.createDataFrame([], "event_type string, n bigint, last_event bigint")
    return spark.read.parquet(f"{folder}/totals-{kept['n']}")
