"""Operators over order: runs, pairs, consecutive empties, insert order, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_runs(lines: Column) -> Column:
    """Array of lines in which a line equal to the one before is dropped."""
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.coalesce(F.try_element_at(lines, i), F.lit(""))))


def without_noise(lines: Column, noise: list[str]) -> Column:
    return F.filter(lines, lambda x: (x != "") & ~x.isin(*noise))


def until_empty(pages: DataFrame, listing: str, page: str, count: str, most_empty: int) -> DataFrame:
    """Pages of each listing up to the first run of ``most_empty`` empty pages, that run included."""
    w = Window.partitionBy(listing).orderBy(page)
    rows = pages.withColumn("_full", F.sum(F.when(F.col(count) > 0, 1).otherwise(0)).over(w))
    rows = rows.withColumn("_run", F.sum(F.when(F.col(count) == 0, 1).otherwise(0)).over(Window.partitionBy(listing, "_full").orderBy(page)))
    stop = F.min(F.when(F.col("_run") >= most_empty, F.col(page))).over(Window.partitionBy(listing))
    return rows.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_full", "_run", "_stop")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def unique_match(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with one value only, and that value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("n")).where("n = 1").drop("n")


def enrich(left: DataFrame, right: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Left rows with the last matching row of the right as a whole: where one matches, all its columns replace."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"))
    joined = left.join(last, key, "left")
    return joined.select(*[F.coalesce(F.when(F.col("r").isNotNull(), F.col(f"r.{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns])


def remaining(span: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys of a range or queue that aren't done."""
    return span.join(done.select(key).distinct(), key, "left_anti")


def rollup_counts(df: DataFrame, column: str) -> DataFrame:
    """Count of each value, and of all rows under NULL."""
    return df.rollup(column).agg(F.count("*").alias("n"))
