"""Writers of lines, tables and shards. Spark's commit protocol makes each write whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routed_jsonl(df: DataFrame, path: str, by: str = "type") -> None:
    """JSON lines in a folder for each value of a column."""
    df.withColumn("_by", F.col(by)).repartition("_by", F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("overwrite").partitionBy("_by").json(path)


def jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines; in a total order over all files if asked: ranges are sorted, and files are named in their order."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, separator: str = " | ", order: list[str] | None = None, mark: bool = False) -> None:
    """CSV files with lists joined by the separator and a header; in a total order over all files if asked, and with a byte
    order mark in front of each file if asked."""
    lists = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    flat = df.select(*[F.concat_ws(separator, c).alias(c) if c in lists else F.col(c) for c in df.columns])
    flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0]) if mark else flat
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def sharded(df: DataFrame, path: str) -> None:
    """Rows of each shard in a folder of its own."""
    df.write.mode("overwrite").partitionBy("shard").json(path)


def upsert_parquet(df: DataFrame, path: str, key: str) -> None:
    """Points by key into a new version of a table: rows of df replace those of the same key."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df.write.parquet(path)
        return
    from ..session import written

    old = spark.read.parquet(path)

    new = written(old.join(df.select(key), key, "left_anti").unionByName(df), "upsert")
    new.write.mode("overwrite").parquet(path)
