"""Question-and-answer records as a graph, and joins of consultations and lawyers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import first_non_empty, strip

RECORD = """request_id string, status string, page_url string, fetched_at string,
 question struct<title: string, text: string, tags: array<struct<name: string, url: string>>>,
 answers array<struct<number: string, text: string, date: string, time: string, lawyer: struct<name: string, city: string, profile_url: string>>>"""


def valid_records(records: DataFrame) -> DataFrame:
    """Records with a question that were found; raises on one without an id."""
    kept = records.where(F.col("question").isNotNull() & (F.coalesce("status", F.lit("")) != "not_found"))
    has_id = F.length(strip(F.coalesce("request_id", F.lit("")))) > 0
    return kept.where(F.when(has_id, True).otherwise(F.raise_error(F.lit("a record has no request_id")).cast("boolean")))


def graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of records. Positions of answers count skipped ones too; a URL that isn't empty wins."""
    r = valid_records(records).withColumn("rid", strip("request_id")).withColumn("qid", F.concat(F.lit("question:"), F.col("rid")))
    title = first_non_empty(strip("question.title"), F.concat(F.lit("مشاوره حقوقی "), F.col("rid")))
    questions = r.select(F.col("qid").alias("id"), F.lit("Question").alias("label"), title.alias("name"), strip(F.coalesce("question.text", F.lit(""))).alias("text"), F.coalesce("page_url", F.lit("")).alias("url"))
    tags = r.select("qid", F.explode("question.tags").alias("t")).where(strip("t.name") != "").select("qid", stable_id("tag", F.col("t.name")).alias("id"), strip("t.name").alias("name"), F.coalesce("t.url", F.lit("")).alias("url"))
    answers = r.select("rid", "qid", F.posexplode("answers").alias("i", "a")).where(strip("a.text") != "")
    answers = answers.withColumn("id", F.concat_ws(":", F.lit("answer"), "rid", (F.col("i") + 1).cast("string")))
    lawyers = answers.where(strip("a.lawyer.name") != "").select(
        F.col("id").alias("answer"), stable_id("lawyer", first_non_empty("a.lawyer.profile_url", "a.lawyer.name")).alias("id"), strip("a.lawyer.name").alias("name"), F.coalesce("a.lawyer.profile_url", F.lit("")).alias("url")
    )
    node = lambda df, label, text: df.select("id", F.lit(label).alias("label"), "name", text.alias("text"), "url")
    rows = questions.unionByName(node(tags, "Tag", F.lit(""))).unionByName(node(lawyers, "Lawyer", F.lit("")))
    rows = rows.unionByName(answers.select("id", F.lit("Answer").alias("label"), F.coalesce("a.number", (F.col("i") + 1).cast("string")).alias("name"), strip("a.text").alias("text"), F.lit("").alias("url")))
    nodes = rows.groupBy("id", "label").agg(F.max("name").alias("name"), F.max("text").alias("text"), F.max("url").alias("url"))
    link = lambda df, a, b, kind: df.select(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("relation_type"))
    links = link(tags, "qid", "id", "TAGGED_WITH").unionByName(link(answers, "qid", "id", "HAS_ANSWER")).unionByName(link(lawyers, "answer", "id", "ANSWERED_BY"))
    return nodes, links.distinct()


def with_lawyers(consultations: DataFrame, lawyers: DataFrame) -> DataFrame:
    """Consultations with the profile of their page; of a profile that was read twice the latest row counts."""
    one = lawyers.groupBy("profile_url").agg(F.max_by(F.struct("lawyer_id", "name", "city"), F.struct(F.coalesce("updated_at", F.lit("")), "row_id")).alias("p")).select("profile_url", "p.*")
    return consultations.join(one, "profile_url")


def lawyer_counts(lawyers: DataFrame, consultations: DataFrame) -> DataFrame:
    """Profiles and how many consultations their page has; 0 where none."""
    counts = consultations.groupBy("profile_url").agg(F.count("*").alias("n_consultations"))
    one = lawyers.groupBy("lawyer_id").agg(F.max("profile_url").alias("profile_url"))
    return one.join(counts, "profile_url", "left").select("lawyer_id", "profile_url", F.coalesce("n_consultations", F.lit(0)).alias("n_consultations"))
