"""A stream of crawl events into keyed state: the latest status and the number of attempts of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "url string, status string, http_status int, fetched_at timestamp, error string"


def events(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def unfinished(rows: DataFrame, old: DataFrame | None = None, terminal: tuple[str, ...] = ()) -> DataFrame:
    """Events that count: none of a page whose state is terminal, none after its first terminal event."""
    if not terminal:
        return rows
    if old is not None:
        rows = rows.join(old.where(F.col("status").isin(*terminal)).select("url"), "url", "left_anti")
    ends = rows.where(F.col("status").isin(*terminal)).groupBy("url").agg(F.min("fetched_at").alias("_end"))
    return rows.join(ends, "url", "left").where("_end IS NULL OR fetched_at <= _end").drop("_end")


def state_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("url").agg(
        F.count("*").alias("attempt_count"), F.max_by("status", F.struct("fetched_at", "status")).alias("status"),
        F.max_by("http_status", F.struct("fetched_at", "status")).alias("http_status"), F.max("fetched_at").alias("fetched_at"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of two times as one: attempts add up, the later status stays."""
    both = old.unionByName(new)
    at = F.struct("fetched_at", "status")
    return both.groupBy("url").agg(
        F.sum("attempt_count").alias("attempt_count"), F.max_by("status", at).alias("status"), F.max_by("http_status", at).alias("http_status"), F.max("fetched_at").alias("fetched_at")
    )


def keep_state(stream: DataFrame, path: str, checkpoint: str, terminal: tuple[str, ...] = ()) -> StreamingQuery:
    """Merges each batch into a version of its own: ``path/version=<batch>``; a batch that comes again writes the same version.
    Pages in a terminal state stay as they are."""

    def write(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/version={number - 1}") if number else None
        new = state_of(unfinished(batch, old, terminal))
        (merged(old, new) if old is not None else new).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by status and window of event time; what is later than the watermark is left out."""
    return stream.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", size), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")
