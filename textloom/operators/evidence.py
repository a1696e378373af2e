"""Evidence: authority, deduplication, ledgers, grounded answers, fused ranks, assembled contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import excerpt, markers, strip_markers

# Labels by authority, and the order in which a label names the source.
PRIMARY = ("Article", "Note", "Law", "LegalDecision", "LegalProvision", "UnanimityDecision")
AUXILIARY = ("Question", "Answer", "Lawyer", "Tag")
PRIORITY = ("Article", "Note", "UnanimityDecision", "LegalDecision", "LegalProvision", "Law", "Question", "Answer", "Lawyer", "Tag")
INSUFFICIENT = "شواهد کافی بازیابی نشد."
UNCITED = "برخی بندهای پاسخ ارجاع ندارند."
NO_PRIMARY = "هیچ منبع اصلی بازیابی نشد."


def _list(xs: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def authority(labels: Column, access_status: Column, more_auxiliary: tuple[str, ...] = ()) -> Column:
    """auxiliary labels first, then what is only referred to, then primary labels; all else is secondary."""
    ls = F.coalesce(labels, F.array().cast("array<string>"))
    return (
        F.when(F.arrays_overlap(ls, _list(AUXILIARY + more_auxiliary)), "auxiliary")
        .when(F.coalesce(access_status, F.lit("")) == "reference_only", "secondary")
        .when(F.arrays_overlap(ls, _list(PRIMARY)), "primary")
        .otherwise("secondary")
    )


def source_type(labels: Column, fallback: str = "legal_source") -> Column:
    hits = F.filter(_list(PRIORITY), lambda x: F.array_contains(F.coalesce(labels, F.array().cast("array<string>")), x))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(fallback))


def best(df: DataFrame, keys: list[str], score: str = "score", position: str = "position") -> DataFrame:
    """Of each key the row with the highest score; the earliest of equal ones."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(position))).alias("r")).select(*keys, "r.*")


def within_calls(calls: DataFrame, most: int, call: str = "call") -> DataFrame:
    """Rows of the first calls of each run, numbered from 1: what comes after the budget adds no evidence."""
    return calls.where(F.col(call) <= most)


def ledger(calls: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, evidence_id, source_id, …): the best row of each evidence, numbered S1, S2, … by first appearance."""
    from .chunks import numbered

    first = calls.groupBy(run, "evidence_id").agg(F.min("position").alias("first"))
    # numbers over all runs, less those before the run: a run that holds a third of all rows is divided among tasks
    ranked = numbered(first, [run, "first", "evidence_id"])
    starts = ranked.groupBy(run).agg((F.min("rn") - 1).alias("before"))
    number = (F.col("rn") - F.col("before")).cast("string")
    named = ranked.join(starts, run).select(run, "evidence_id", F.concat(F.lit("S"), number).alias("source_id"))
    return best(calls, [run, "evidence_id"]).join(named, [run, "evidence_id"])


def grounded(drafts: DataFrame, sources: DataFrame, run: str = "run_id") -> DataFrame:
    """Answers held to their evidence: (run, answer, cited, citations, limitations, limited).

    drafts: run, answer, cited_source_ids, limitations. Markers of unknown sources are taken out; without a valid citation
    a fixed warning replaces the answer; a substantial paragraph without a marker, or no primary source, limits it.
    """
    held = sources.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("source_id", F.struct("title", "authority", excerpt("text").alias("excerpt"))))).alias("held"))
    d = drafts.join(held, run, "left").withColumn("held", F.coalesce("held", F.create_map().cast("map<string,struct<title:string,authority:string,excerpt:string>>")))
    asked = F.array_distinct(F.concat(F.coalesce("cited_source_ids", F.array().cast("array<string>")), markers("answer")))
    d = d.withColumn("cited", F.filter(asked, lambda s: F.map_contains_key("held", s)))
    d = d.withColumn("kept", strip_markers("answer", F.col("cited")))
    paragraphs = F.filter(F.transform(F.split("kept", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: (F.length(p) >= 20) & ~p.startswith("#") & ~p.endswith(":"))
    covered = F.forall(paragraphs, lambda p: F.size(F.array_intersect(markers(p), F.col("cited"))) > 0) & (F.size(paragraphs) > 0)
    has = F.size("cited") > 0
    primary = F.exists(F.col("cited"), lambda s: F.try_element_at(F.col("held"), s)["authority"] == "primary")
    own = F.array_distinct(F.coalesce("limitations", F.array().cast("array<string>")))
    more = F.array_compact(F.array(F.when(~has, F.lit(INSUFFICIENT)), F.when(has & ~covered, F.lit(UNCITED)), F.when(has & ~primary, F.lit(NO_PRIMARY))))
    d = d.withColumn("limits", F.array_distinct(F.concat(own, more)))
    body = F.when(has & (F.col("kept") != ""), F.col("kept")).otherwise(F.lit(INSUFFICIENT))
    missing = F.filter("limits", lambda x: ~F.contains(body, x))
    limits = F.when(F.size(missing) > 0, F.concat(F.lit("\n\nمحدودیت‌های پاسخ:\n"), F.array_join(F.transform(missing, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    listed = F.transform(F.col("cited"), lambda s: F.concat(F.lit("- ["), s, F.lit("] "), F.try_element_at(F.col("held"), s)["title"]))
    listing = F.when(has, F.concat(F.lit("\n\nمنابع بازیابی‌شده:\n"), F.array_join(listed, "\n"))).otherwise("")
    citations = F.transform(F.col("cited"), lambda s: F.struct(s.alias("source_id"), F.try_element_at(F.col("held"), s).alias("source")))
    return d.select(run, F.concat(body, limits, listing).alias("answer"), "cited", citations.alias("citations"), F.col("limits").alias("limitations"), (F.size("limits") > 0).alias("limited"))


def draft(structured: Column, messages: Column) -> Column:
    """The structured answer, else the text of the last message."""
    return F.coalesce(F.when(F.trim(structured) != "", structured), F.trim(F.try_element_at(messages, F.lit(-1))))


def tail(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    if n <= 0:
        return messages.limit(0)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def fused(lists: list[DataFrame], key: str, k: int = 60, most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, rank), of each the first ``most`` places if asked."""
    lists = lists if most is None else [x.where(F.col("rank") <= most) for x in lists]
    rows = lists[0].select(key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def context(df: DataFrame, run: str, key: str, tokens: str, score: str, budget: int) -> DataFrame:
    """Chunks by score while their running sum of tokens is within the budget; a chunk that comes twice counts once."""
    one = df.groupBy(run, key).agg(F.max(score).alias(score), F.max(tokens).alias(tokens))
    w = Window.partitionBy(run).orderBy(F.desc(score), key).rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def weighted(df: DataFrame, weights: dict[str, float], ties: list[str]) -> DataFrame:
    """Rows with a weighted sum of their scores, and their place by it."""
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("total", total).orderBy(F.desc("total"), *ties)


def guard(question: str, longest: int = 12_000) -> str:
    """The stripped question; raises if it is blank or too long."""
    q = question.strip()
    if not q:
        raise ValueError("the question is empty")
    if len(q) > longest:
        raise ValueError("the question is too long")
    return q


def known(requested: DataFrame, sources: DataFrame, run: str = "run_id") -> DataFrame:
    """Requested entities that a run's ledger holds."""
    return requested.join(sources.select(run, "entity_id").distinct(), [run, "entity_id"], "left_semi")


def tool_rows(sources: DataFrame) -> DataFrame:
    """The fields that a tool hands out, scores rounded to six places."""
    fields = [c for c in ("source_id", "evidence_id", "entity_id", "title", "text", "source_type", "authority", "source_uri") if c in sources.columns]
    return sources.select(*fields, F.round("score", 6).alias("score"))


# Where the parts of an evidence may stand in a hit's payload, the first that isn't empty.
PAYLOAD = {
    "entity_id": ("entity_id", "metadata.entity_id", "chunk_id", "metadata.chunk_id", "document_id", "metadata.document_id"),
    "text": ("text", "page_content", "metadata.text"), "title": ("title", "metadata.title", "name"),
    "source_uri": ("url", "file_url", "metadata.source_uri", "metadata.file_url"), "access_status": ("access_status", "metadata.access_status"),
    "kind": ("node_type", "metadata.document_type"), "labels": ("labels", "metadata.labels"),
}


def from_hits(hits: DataFrame) -> DataFrame:
    """Evidence of vector hits (id, score, payload): fields of the payload itself, else of its metadata, whichever of them are
    there; hits without an id, an entity or a text are left out."""
    from ..functions.text import first_non_empty

    def holds(path: str) -> bool:
        kind = hits.schema["payload"].dataType
        for name in path.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return False
            kind = kind[name].dataType
        return True

    own = {k: [F.col(f"payload.{x}") for x in paths if holds(x)] for k, paths in PAYLOAD.items()}
    said = lambda k, *more: first_non_empty(*[c.cast("string") for c in own[k]], *more, F.lit(None).cast("string"))
    labels = F.coalesce(*own["labels"], F.array().cast("array<string>"))
    entity, text = F.trim(F.coalesce(said("entity_id"), F.lit(""))), F.trim(F.coalesce(said("text"), F.lit("")))
    there = (F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) != "") & (entity != "") & (text != "")
    return hits.where(there).select(
        F.concat(F.lit("vector:"), F.col("id").cast("string")).alias("evidence_id"), entity.alias("entity_id"), F.trim(said("title", entity)).alias("title"), text.alias("text"),
        said("kind", source_type(labels)).alias("source_type"), authority(labels, said("access_status")).alias("authority"), F.col("score").cast("double").alias("score"),
        F.coalesce(F.trim(said("source_uri")), F.lit("")).alias("source_uri"),
    )


def summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean, median, least score, and failures (NULL scores) of an evaluation."""
    return scores.agg(F.avg(score).alias("mean"), F.median(score).alias("median"), F.min(score).alias("least"), F.count_if(F.col(score).isNull()).alias("failures"))


def worst(scores: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k rows with the least scores, failures (NULL) first, ties by key."""
    return scores.orderBy(F.col(score).asc_nulls_first(), key).limit(k)


def settings(values: dict[str, str]) -> dict[str, int]:
    """Typed limits from text; raises on one that isn't a positive number."""
    defaults = {"top_k": 8, "depth": 2, "graph_results": 16, "history": 10}
    out = {k: int(values.get(k.upper(), d)) for k, d in defaults.items()}
    for k, v in out.items():
        if v < (0 if k == "history" else 1):
            raise ValueError(f"{k} must be positive")
    return out
