"""Dense vectors: norm, cosine, hashing embedding, top-k."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """NULL where a vector is zero or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (F.size(a) == F.size(b)), dot(a, b) / size)


def hashed_tokens(text: Column | str) -> Column:
    """Case-folded runs of letters, digits and underscores."""
    low = F.lower(F.replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("ß"), F.lit("ss")))
    return F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def bucket_and_sign(token: Column, dimension: int) -> tuple[Column, Column]:
    """The bucket is the first 8 bytes of SHA-256 modulo the dimension, the sign the low bit of the ninth."""
    h = F.sha2(token, 256)
    number = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    odd = F.conv(F.substring(h, 18, 1), 16, 10).cast("int") % 2
    return (number % F.lit(dimension).cast("decimal(20,0)")).cast("int"), F.when(odd == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def hashing_embedding(df: DataFrame, key: str, text: str, dimension: int = 384) -> DataFrame:
    """(key, bucket, value): the non-zero places of the normalised hashing embedding of each text.

    Tokens of a text are counted first; equal tokens share one hash. A text without tokens has no row (a zero vector).
    """
    tokens = df.select(key, F.explode(hashed_tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    bucket, sign = bucket_and_sign(F.col("token"), dimension)
    sums = tokens.select(key, bucket.alias("bucket"), (sign * F.col("n")).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v")).where("v != 0")
    size = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    return sums.join(size, key).select(key, "bucket", (F.col("v") / F.col("size")).alias("value"))


def dense(df: DataFrame, key: str, dimension: int) -> DataFrame:
    """Dense vectors of (key, bucket, value) rows."""
    at = F.map_from_entries(F.collect_list(F.struct("bucket", "value")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return df.groupBy(key).agg(at.alias("m")).select(key, filled.alias("vector"))


def check_dimension(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Raises on a vector of another length."""
    right = F.size(vector) == dimension
    return df.where(F.when(right, True).otherwise(F.raise_error(F.lit(f"a vector has not {dimension} places")).cast("boolean")))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, most_bytes: int = 1 << 26) -> DataFrame:
    """(query, key, score, rank): of each query vector the k most similar vectors, by cosine, ties by key.

    Queries go through the data in blocks of at most ``most_bytes``, one scan for each block; each batch keeps its own k best of each query, so what is
    shuffled is k rows per query and batch. Zero vectors and vectors of other lengths have no similarity.
    """
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query long, key long, score double, rank int")
    numbered = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL")
    count, width = numbered.agg(F.count("*"), F.max(F.size("v"))).first()
    n_blocks = max(1, -(-count * 8 * (width or 1) // most_bytes))
    schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    data = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    out = None
    for i in range(n_blocks):
        own = numbered.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == i).orderBy("q").collect()  # about one block of vectors
        if not own:
            continue
        part = data.mapInArrow(_best([r[0] for r in own], [r[1] for r in own], k, schema), "query long, key long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query long, key long, score double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(ids: list[int], rows: list[list[float]], k: int, schema: pa.Schema):
    width = max(len(r) for r in rows)
    fit = [i for i, r in enumerate(rows) if len(r) == width]
    q = np.array([rows[i] for i in fit], float)
    q_ids = np.array([ids[i] for i in fit], np.int64)
    q_size = np.sqrt((q * q).sum(axis=1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vs = part.column(1).to_pylist()
            keep = [i for i, v in enumerate(vs) if len(v) == width and None not in v]
            if not keep:
                continue
            keys = part.column(0).to_numpy()[keep]
            m = np.array([vs[i] for i in keep], float)
            size = np.sqrt((m * m).sum(axis=1))
            by_key = np.argsort(keys, kind="stable")
            for at in range(0, len(q), 512):
                own = slice(at, at + 512)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (q[own] @ m.T) / q_size[own, None] / size[None, :]
                s[~np.isfinite(s)] = -np.inf
                order = by_key[np.argsort(-s[:, by_key], axis=1, kind="stable")[:, :k]]
                score = np.take_along_axis(s, order, axis=1)
                good = np.isfinite(score)
                qs = np.repeat(q_ids[own], order.shape[1]).reshape(order.shape)
                yield pa.RecordBatch.from_arrays([pa.array(qs[good]), pa.array(keys[order][good]), pa.array(score[good])], schema=schema)

    return run


def decode_base64(column: str):
    """Little-endian 32-bit floats of a base64 text; NULL if the text is bad."""

    @F.arrow_udf("array<float>")
    def decode(values: pa.Array) -> pa.Array:
        def one(x: str | None) -> list[float] | None:
            try:
                return np.frombuffer(base64.b64decode(x, validate=True), "<f4").tolist() if x else None
            except ValueError:
                return None

        return pa.array([one(x) for x in values.to_pylist()], pa.list_(pa.float32()))

    return decode(F.col(column))


def split_responses(df: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Embedding responses (custom_id, response) that are usable, with their vector, and the others with a reason."""
    item = F.try_element_at(F.col("response.body.data"), F.lit(1))
    reason = (
        F.when(F.coalesce(F.col("response.status_code") != 200, F.lit(True)), "status")
        .when(F.coalesce(F.size("response.body.data"), F.lit(0)) != 1, "items")
        .when(item["embedding"].isNull(), "embedding")
    )
    marked = df.select("custom_id", reason.alias("reason"), item["embedding"].alias("e")).withColumn("vector", decode_base64("e"))
    marked = marked.withColumn("reason", F.coalesce("reason", F.when(F.coalesce(F.size("vector"), F.lit(-1)) != dimension, "dimension")))
    return marked.where("reason IS NULL").select("custom_id", "vector"), marked.where("reason IS NOT NULL").select("custom_id", "reason")
