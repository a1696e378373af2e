"""Readers of line-based files, manifests, web pages and PDFs. No reader goes to the network."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE_END = re.compile(r"\r\n|\r|\n")
MANIFEST = "type string, title string, file_url string, type_file string"
COMPANION = "file_url string, id string, page_id string, detail_url string, mime_type string, access_status string, http_status int, local_path string"


def jsonl_numbered(spark: SparkSession, path: str, schema: str, bad: str = "null") -> DataFrame:
    """Records with source_file and their physical 1-based source_line; a byte order mark and blank lines are passed over.
    Lines that aren't objects give NULL records, or are left out (bad = "drop"), or raise (bad = "raise"). A file is read as a whole in one task, as its line numbers demand."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = pa.schema([("source_file", pa.string()), ("source_line", pa.int32()), ("line", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(*(c.to_pylist() for c in part.columns)):
                found = [(i, x) for i, x in enumerate(_LINE_END.split(content.decode("utf-8-sig")), 1) if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([i for i, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())], schema=out)

    rows = files.mapInArrow(run, "source_file string, source_line int, line string")
    mode = {"mode": "FAILFAST" if bad == "raise" else "PERMISSIVE"}
    record = F.when(F.ltrim("line").startswith("{"), F.from_json("line", schema, mode)) if bad != "raise" else F.from_json("line", schema, mode)
    rows = rows.select("source_file", "source_line", record.alias("record"))
    return rows.where("record IS NOT NULL") if bad == "drop" else rows


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Raises on a line that isn't JSON."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def manifest(spark: SparkSession, path: str, companion: str) -> DataFrame:
    """PDF entries of a manifest with the last companion row of the same URL, and their ids."""
    from ..functions.ids import file_id

    rows = jsonl_strict(spark, path, MANIFEST).where(F.lower("type_file") == "pdf")
    more = spark.read.schema(COMPANION).json(companion).withColumn("_line", F.monotonically_increasing_id())
    last = more.groupBy("file_url").agg(F.max_by(F.struct("id", "page_id", "detail_url", "mime_type", "access_status", "http_status", "local_path"), "_line").alias("c"))
    joined = rows.join(last, "file_url", "left")
    return joined.select(file_id(F.col("c.id"), F.col("file_url"), F.col("title"), F.col("c.local_path")).alias("id"), *rows.columns, "c.page_id", "c.mime_type", "c.access_status", "c.local_path")


def sqlite_table(spark: SparkSession, url: str, table: str) -> DataFrame:
    """A table over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table).load()


def nodes_with_text(nodes: DataFrame, labels: list[str], limit: int | None = None) -> DataFrame:
    """Nodes that have any of the labels and a text that isn't blank."""
    wanted = F.array(*[F.lit(x) for x in labels])
    rows = nodes.where(F.arrays_overlap("labels", wanted) & (F.length(F.trim("text")) > 0)).orderBy("id")
    return rows.limit(limit) if limit else rows


def queue(rows: DataFrame, status: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows that aren't done, in numeric order of their key; a key that isn't a number counts as 0."""
    left = rows.where(F.coalesce(status, F.lit("")) != "done").orderBy(F.coalesce(F.expr(f"try_cast({key} AS int)"), F.lit(0)), key)
    return left.limit(limit) if limit else left


def advice_queue(rows: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Profiles whose details are done, whose consultations aren't and that have a URL of them, in the order of ``queue``."""
    ready = rows.where((F.col("detail_status") == "done") & (F.length("advice_url") > 0))
    return queue(ready, "advice_status", key, limit)


def id_range(spark: SparkSession, first: int, last: int, done: DataFrame, key: str = "id") -> DataFrame:
    return spark.range(first, last + 1).withColumnRenamed("id", key).join(done.select(key), key, "left_anti")


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of files; cache them as Parquet for repeated use."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF files, pages joined by blank lines; needs the pypdf package on the executors."""
    @F.arrow_udf("string")
    def extract(values: pa.Array) -> pa.Array:
        import io

        from pypdf import PdfReader

        return pa.array(["\n\n".join((p.extract_text() or "") for p in PdfReader(io.BytesIO(b)).pages) for b in values.to_pylist()], pa.string())

    return spark.read.format("binaryFile").load(path).select("path", extract("content").alias("text"))


def retry_delay(attempt: int, retry_after: float | None = None, most: float = 60.0) -> float:
    """Seconds before the next attempt: what the server asks for, else doubling, at most ``most``."""
    return min(most, retry_after if retry_after is not None else 2.0**attempt)
