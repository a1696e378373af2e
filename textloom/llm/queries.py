"""Queries over the test tables for the nine text problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tables, written
from . import confusables, leakage, near_duplicates, packing, pairs, personal, pieces, residue, subjects


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


P1_FIELDS = (("consultations", "question"), ("consultations", "answer"), ("lawyers", "about"))


def _lexicon(spark: SparkSession, d: str) -> personal.Lexicon:
    texts = _union([tables(spark, d, t)[0].select(F.col(f).alias("text")) for t, f in P1_FIELDS])
    return personal.learn(texts, tables(spark, d, "lawyers")[0].select("name"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    named = [tables(spark, d, t)[0].select(F.lit(t).alias("table_name"), "row_id", F.lit(f).alias("field_name"), F.col(f).alias("text")) for t, f in P1_FIELDS]
    keys = ["table_name", "row_id", "field_name"]
    return personal.found_items(_union(named), keys, "text", _lexicon(spark, d)).select(*keys, "pii_type", "occurrence")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    lexicon = _lexicon(spark, d)
    consultations, lawyers = tables(spark, d, "consultations", "lawyers")
    named = lambda df, t: df.select(F.lit(t).alias("table_name"), "*")
    a = named(personal.redacted(consultations.select("row_id", "question", "answer"), ["question", "answer"], lexicon), "consultations")
    b = named(personal.redacted(lawyers.select("row_id", "about"), ["about"], lexicon), "lawyers")
    return a.unionByName(b, allowMissingColumns=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    (consultations,) = tables(spark, d, "consultations")
    linked, copies = near_duplicates.similar_pairs(consultations, "row_id", ["question", "answer"], 3, 0.5)
    return near_duplicates.all_pairs(linked, copies)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    (consultations,) = tables(spark, d, "consultations")
    return near_duplicates.duplicate_groups(consultations, "row_id", ["question", "answer"], 5, 0.8).withColumnRenamed("id", "row_id")


def p2_raw_groups(spark: SparkSession, d: str) -> DataFrame:
    (consultations,) = tables(spark, d, "consultations")
    return near_duplicates.duplicate_groups(consultations, "row_id", ["raw_text"], 5, 0.8).withColumnRenamed("id", "row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(tables(spark, d, "consultations")[0])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, files = tables(spark, d, "nodes", "legal_files")
    named = lambda df, t, f: df.select(F.lit(t).alias("table_name"), "row_id", F.lit(f).alias("field_name"))
    return _union([
        named(residue.residue_texts(nodes, "row_id", "text", "url"), "nodes", "text"),
        named(residue.bad_statuses(nodes, "row_id", "access_status", residue.NODE_STATUSES), "nodes", "access_status"),
        named(residue.bad_statuses(files, "row_id", "access_status", residue.FILE_STATUSES), "legal_files", "access_status"),
    ])


def p4_clean_files(spark: SparkSession, d: str) -> DataFrame:
    (files,) = tables(spark, d, "legal_files")
    cases = residue.bad_statuses(files, "row_id", "access_status", residue.FILE_STATUSES)
    return residue.without(files, cases, "row_id")


def p4_clean_nodes(spark: SparkSession, d: str) -> DataFrame:
    (nodes,) = tables(spark, d, "nodes")
    cases = residue.residue_texts(nodes, "row_id", "text", "url").select("row_id")
    return residue.without(nodes, cases.unionByName(residue.bad_statuses(nodes, "row_id", "access_status", residue.NODE_STATUSES).select("row_id")), "row_id")


CUT_TABLES = ("nodes", "text_chunks", "document_chunks")


def _pieces(spark: SparkSession, d: str, only_larger: bool) -> DataFrame:
    (limits,) = tables(spark, d, "size_limits")
    parts = []
    for t in CUT_TABLES:
        limit, overlap, unit = pieces.limit_of(limits, t, "text")
        sums = packing.token_sums() if unit == "tokens" else None
        cut = pieces.split_texts(tables(spark, d, t)[0], "row_id", "text", limit, overlap, sums, only_larger)
        parts.append(cut.select(F.lit(t).alias("table_name"), *cut.columns))
    return _union(parts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True).where("piece_no = 1").select("table_name", "row_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False)


def p5_document_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents beyond the size of a container, cut by their limit in tokens."""
    documents, limits = tables(spark, d, "documents", "size_limits")
    limit, overlap, unit = pieces.limit_of(limits, "documents", "text")
    return pieces.split_texts(documents, "doc_id", "text", limit, overlap, packing.token_sums() if unit == "tokens" else None, True)


P6_FIELDS = (("nodes", "text"), ("consultations", "question"), ("lawyers", "name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [confusables.inconsistent_values(tables(spark, d, t)[0], "row_id", [f], t) for t, f in P6_FIELDS]
    return _union(parts).select("table_name", "row_id", "field_name")


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t, f in P6_FIELDS:
        (df,) = tables(spark, d, t)
        parts.append(df.select(F.lit(t).alias("table_name"), "row_id", F.lit(f).alias("field_name"), confusables.consistent_column(f).alias("value")))
    return _union(parts)


def p6_name_groups(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alike_groups(tables(spark, d, "lawyers")[0], "row_id", "name")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    values = [tables(spark, d, t)[0].select(F.lit(t).alias("table_name"), "row_id", F.lit(f).alias("field_name"), F.col(f).alias("value")) for t, f in P6_FIELDS]
    return confusables.look_alike_members(_union(values), "value")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    documents, limits = tables(spark, d, "documents", "size_limits")
    capacity, _, _ = pieces.limit_of(limits, "documents", "text")
    sizes = packing.token_counts(documents, "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", capacity)


def p7_use(spark: SparkSession, d: str) -> DataFrame:
    capacity, _, _ = pieces.limit_of(tables(spark, d, "size_limits")[0], "documents", "text")
    loads = p7_packed(spark, d).where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    total, n = F.sum("load"), F.count("*")
    return loads.agg(n.alias("n_containers"), total.alias("n_tokens"), F.max("load").alias("fullest"), (n * capacity - total).alias("unused"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).where("n_words >= 12").select("doc_id", "item_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(*tables(spark, d, "documents", "eval_items"))


def p9_areas(spark: SparkSession, d: str) -> DataFrame:
    documents, labels = tables(spark, d, "documents", "subject_labels")
    records = written(subjects.described(documents, "doc_id", "text"), "subject-terms")
    found = subjects.areas(records, subjects.learn(records, labels))
    return found.select("doc_id", "subject", F.round("share", 4).alias("share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_areas(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return p9_areas(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p1_redacted, p2_found, p2_groups, p2_raw_groups, p3_found, p4_found, p4_clean_files, p4_clean_nodes, p5_found, p5_pieces, p5_document_pieces,
        p6_found, p6_consistent, p6_groups, p6_name_groups, p7_packed, p7_use, p8_found, p8_spans, p9_found, p9_areas, p9_composition,
    )
}
