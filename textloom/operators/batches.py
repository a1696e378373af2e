"""Embedding batches as a state table: shard, tokens, status, attempts; each step gives a new table and may be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import wave

STEPS = ("prepared", "submitted", "completed", "failed", "collected")


def prepared(requests: DataFrame) -> DataFrame:
    """A state row for each shard of requests."""
    sums = requests.groupBy("shard").agg(F.count("*").alias("n_requests"), F.count_distinct("entity_id").alias("n_entities"), F.sum("token_count").alias("tokens"))
    return sums.withColumn("status", F.lit("prepared")).withColumn("attempts", F.lit(0))


def submitted(state: DataFrame, budget: int | None = None) -> DataFrame:
    """Prepared shards become submitted; with a budget, those that fit it in order of their numbers."""
    open_ = state.where("status = 'prepared'")
    taken = open_.select("shard") if budget is None else wave(open_, budget).where("taken").select("shard")
    hit = state.join(taken.withColumn("_hit", F.lit(True)), "shard", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), "submitted").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + F.col("_hit").isNotNull().cast("int")).drop("_hit")


def updated(state: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports (shard, status, reported_at) of submitted shards; the latest of a shard counts."""
    last = reports.where(F.col("status").isin("completed", "failed")).groupBy("shard").agg(F.max_by("status", "reported_at").alias("new"))
    return state.join(last, "shard", "left").withColumn("status", F.when(F.col("status") == "submitted", F.coalesce("new", "status")).otherwise(F.col("status"))).drop("new")


def retried(state: DataFrame, budget: int, most_attempts: int = 3) -> DataFrame:
    """Failed shards within the budget go back to prepared and are submitted again, unless they were tried often enough."""
    again = F.when((F.col("status") == "failed") & (F.col("attempts") < most_attempts), "prepared").otherwise(F.col("status"))
    return submitted(state.withColumn("status", again), budget)


def unknown(requested: DataFrame, state: DataFrame) -> DataFrame:
    """Requested shards that the state doesn't know."""
    return requested.join(state.select("shard"), "shard", "left_anti")


def points(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(point_id, vector, payload) of outputs (custom_id, vector) by the manifest; raises on an output it doesn't know."""
    payload = F.struct(*[c for c in manifest.columns if c not in ("point_id", "custom_id")])
    known = manifest.select("custom_id", "point_id", payload.alias("payload"))
    joined = outputs.join(known, "custom_id", "left")
    fine = F.col("point_id").isNotNull()
    return joined.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("no manifest row for "), "custom_id")).cast("boolean"))).select("point_id", "vector", "payload")


def missing(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest rows without a point."""
    return manifest.join(done.select("point_id"), "point_id", "left_anti")
