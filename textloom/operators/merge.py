"""Keyed merges with a policy for each column, and their relatives.

A merge is one aggregation by key: partial sums meet before the shuffle, and a key that holds a third of all rows is one
row per task there. Order columns decide what "last" means; break all ties in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of node types by dataset, and of datasets.
TYPE_LABELS = {
    "laws": {
        "index": ("Index",), "category": ("LegalCategory",), "law_group": ("Law", "LawGroup"), "document": ("Law",),
        "article": ("Article",), "note": ("Note",), "unresolved_reference": ("UnresolvedLegalReference",),
    },
    "unanimity": {
        "index": ("Index",), "year": ("DecisionYear",), "decision": ("LegalDecision", "UnanimityDecision"), "institution": ("Organization",),
        "legal_document": ("Law",), "legal_provision": ("LegalProvision",),
        "external_legal_document": ("ExternalLegalDocument",), "external_legal_provision": ("ExternalLegalProvision",),
        "unresolved_legal_reference": ("UnresolvedLegalReference",), "external_unanimity_decision": ("ExternalUnanimityDecision",),
    },
}
DATASET_LABELS = {"laws": "Laws", "unanimity": "Unanimity"}
#: Columns of a law node and of a ruling node, with what a later row does to an earlier one.
LAW_POLICY = dict.fromkeys(("type", "subtype"), "last") | dict.fromkeys(("title", "url"), "last_non_empty") | dict.fromkeys(
    ("numeric_id", "category", "approval_info", "text", "content_hash", "fetched_at"), "last_non_null"
)
RULING_POLICY = {"type": "last"} | dict.fromkeys(
    ("subtype", "numeric_id", "title", "url", "year", "decision_number", "approval_date", "subject", "issuing_body", "text", "access_status", "content_hash", "fetched_at", "metadata_json"), "last_non_empty"
)
EDGE_POLICY = {"confidence": "max", "source_url": "last_non_empty"}
PROFILE_POLICY = dict.fromkeys(("name", "listing_name", "city", "email", "address", "about", "license_number"), "last_non_empty") | {"detail_status": "last", "updated_at": "max"}


def _merged(column: str, how: str, order: Column) -> Column:
    c = F.col(column)
    if how == "last":
        return F.max_by(c, order)
    if how == "last_non_null":
        return F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), order))
    if how == "last_non_empty":
        return F.coalesce(F.max_by(F.when(c != "", c), F.when(c != "", order)), F.min_by(c, order))
    if how == "first_non_null":
        return F.min_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), order))
    if how == "max":
        return F.max(c)
    if how == "min":
        return F.min(c)
    if how == "count":
        return F.count("*")
    if how == "set":
        return F.array_sort(F.collect_set(c))
    raise ValueError(f"unknown policy {how}")


def merge(rows: DataFrame, keys: list[str], policy: dict[str, str], order: list[str]) -> DataFrame:
    """One row per key. Policies: last, last_non_null, last_non_empty, first_non_null, max, min, count, set.

    last_non_empty: the latest value that isn't '' or NULL; with none, the earliest value, so NULL and '' stay apart.
    """
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[_merged(c, how, at).alias(c) for c, how in policy.items()])


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, str], order: list[str]) -> DataFrame:
    """Updates win over the target by policy, whatever their own order; the target has at most one row per key."""
    both = target.withColumn("_late", F.lit(0)).unionByName(updates.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return merge(both, keys, policy, ["_late", *order])


def overwrite(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer: rows of the updates replace those of the target, column by column without regard to NULL."""
    t, u = target.select(key, *columns), updates.select(key, *columns)
    joined = t.alias("t").join(u.withColumn("_hit", F.lit(True)).alias("u"), F.col(f"t.{key}") == F.col(f"u.{key}"), "full")
    pick = lambda c: F.when(F.col("u._hit"), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}"))
    return joined.select(F.coalesce(f"u.{key}", f"t.{key}").alias(key), *[pick(c).alias(c) for c in columns])


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The target, and of each new key the first row."""
    fresh = rows.join(target.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")
    return target.unionByName(first.select(*target.columns))


def replace_group(target: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Rows of the groups that are delivered anew go; the new rows come."""
    return target.join(rows.select(group).distinct(), group, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def without_prefix(target: DataFrame, key: str, prefix: str, node_type: str | None = None) -> DataFrame:
    gone = F.col(key).startswith(prefix)
    if node_type:
        gone = gone | (F.col("type") == node_type)
    return target.where(~F.coalesce(gone, F.lit(False)))


def latest(rows: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The latest row of each key, among those of a condition."""
    rows = rows if where is None else rows.where(where)
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def page_log(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Attempts and the latest state of each page."""
    state = F.struct("access_status", "http_status", "error")
    return rows.groupBy(key).agg(F.count("*").alias("attempt_count"), F.max_by(state, F.struct(*order)).alias("s")).select(key, "attempt_count", "s.*")


def labels_of(dataset: Column, node_type: Column) -> Column:
    """Labels of a node; NULL for a type that isn't known."""
    pairs = [(d, t, ls) for d, types in TYPE_LABELS.items() for t, ls in types.items()]
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for d, t, ls in pairs:
        out = out.when((dataset == d) & (node_type == t), F.array(*[F.lit(x) for x in (*ls, DATASET_LABELS[d])]))
    return out


def graph_nodes(rows: DataFrame, order: list[str]) -> DataFrame:
    """Nodes by id over both datasets: later values fill, laws decide the type, datasets and labels are collected."""
    at = F.struct(*order)
    kept = [c for c in ("title", "url", "text", "access_status", "year", "category") if c in rows.columns]
    labelled = rows.withColumn("_labels", labels_of(F.col("dataset"), F.col("type")))
    law_type = F.max_by(F.when(F.col("dataset") == "laws", F.col("type")), F.when(F.col("dataset") == "laws", at))
    return labelled.groupBy("id").agg(
        F.coalesce(law_type, F.min_by("type", at)).alias("node_type"),
        F.array_sort(F.collect_set("dataset")).alias("source_datasets"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_labels")))).alias("labels"),
        *[_merged(c, "last_non_null", at).alias(c) for c in kept],
    )


def graph_edges(edges: DataFrame, nodes: DataFrame, order: list[str], dataset: str = "dataset") -> DataFrame:
    """Edges by relation_key whose two ends exist, with the datasets that hold them; the last confidence and URL that
    aren't NULL stay."""
    from ..functions.ids import relation_key

    keyed = edges.withColumn("relation_key", relation_key("source_id", "target_id", "relation_type", "raw_reference"))
    one = keyed.groupBy("relation_key").agg(
        F.first("source_id").alias("source_id"), F.first("target_id").alias("target_id"), F.first("relation_type").alias("relation_type"),
        F.first("raw_reference").alias("raw_reference"), F.array_sort(F.collect_set(dataset)).alias("source_datasets"),
        *[_merged(c, "last_non_null", F.struct(*order)).alias(c) for c in ("confidence", "source_url")],
    )
    ids = nodes.select("id").distinct()
    return one.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that aren't unique, with their counts: empty where the constraint holds."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def checked_identifier(name: Column, pattern: str = "^[A-Z][A-Z0-9_]*$") -> Column:
    """The name of a relation type or label; raises on one that isn't made of capital letters, digits and underscores."""
    said = F.concat(F.lit("not an identifier: "), F.coalesce(name, F.lit("NULL")))
    return F.when(F.coalesce(name.rlike(pattern), F.lit(False)), name).otherwise(F.raise_error(said).cast("string"))


def valid_lawyers(df: DataFrame) -> DataFrame:
    """Profiles with the required fields; raises on a profile without an id or URL."""
    required = (F.length("lawyer_id") > 0) & (F.length("profile_url") > 0)
    return df.where(F.when(required, True).otherwise(F.raise_error(F.lit("a profile has no id or URL")).cast("boolean")))
