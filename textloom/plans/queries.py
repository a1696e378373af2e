"""Queries of the engine's own operators over the test tables, and the equivalent SQL. Each reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, json, text, urls
from ..operators import batches, chunks, citations, consultations, evidence, graph, merge, sequences, vectors
from ..session import tables
from ..sources import html, readers
from . import ingestion

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL -------------------------------------------------------------------------------------------------
_SP = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SP}+', ' ', 'g'))"


def _digits(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{text.DIGITS}', '{text.ASCII_DIGITS}')"


def _letters(x: str, brackets: str = "") -> str:
    x = f"translate({_digits(x)}, '{text.LETTERS}', '{text.PLAIN_LETTERS}')"
    x = f"translate({x}, chr(8204) || chr(8207) || chr(65279), '   ')"
    if brackets:
        x = f"regexp_replace({x}, '{brackets}', ' ', 'g')"
    return f"lower({_space(x)})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _law(x: str) -> str:
    return _letters(x, """[()\\[\\]«»"''`]+""")


def _ruling(x: str) -> str:
    return _letters(x, """[\\[\\]«»"''`]+""")


def _advice(x: str) -> str:
    return _space(f"translate(coalesce({x}, ''), chr(8204) || chr(65279), '  ')")


def _profile(x: str) -> str:
    x = f"translate(coalesce({x}, ''), 'يكۀة', 'یکهه')"
    x = f"translate(replace({x}, chr(8204), ' '), chr(8207) || chr(8206), '')"
    return f"trim({_space(x)}, E' \\t\\r\\n:：-')"


_LABELS = "CASE " + " ".join(
    f"WHEN dataset = '{d}' AND type = '{t}' THEN {[*ls, merge.DATASET_LABELS[d]]}" for d, types in merge.TYPE_LABELS.items() for t, ls in types.items()
) + " END"
_REVERSED = "last_non_empty"


def _merge_sql(table: str, keys: str, policy: dict[str, str], order: str, where: str = "true") -> str:
    def one(c: str, how: str) -> str:
        if how == "last":
            return f"(list({c} ORDER BY {order}))[-1] AS {c}"
        if how == "last_non_null":
            return f"(list({c} ORDER BY {order}) FILTER ({c} IS NOT NULL))[-1] AS {c}"
        if how == "last_non_empty":
            return f"coalesce((list({c} ORDER BY {order}) FILTER ({c} <> ''))[-1], (list({c} ORDER BY {order}))[1]) AS {c}"
        return f"{how}({c}) AS {c}"

    return f"SELECT {keys}, {', '.join(one(c, h) for c, h in policy.items())} FROM {table} WHERE {where} GROUP BY {keys}"


# --- vectors -------------------------------------------------------------------------------------------------------
@query("""
    SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    found = vectors.nearest(e, e.where("vec_id = 0"), "vec_id", "embedding", 5)
    return found.select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query("""
    SELECT query, key, round(s, 6) AS score, rank FROM (
      SELECT q.vec_id AS query, e.vec_id AS key, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id)::INT AS rank
      FROM embeddings q, embeddings e, LATERAL (SELECT list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s)
      WHERE q.vec_id % 100 = 0) WHERE rank <= 3""")
def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    found = vectors.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 3)
    return found.select("query", "key", F.round("score", 6).alias("score"), "rank")


@query("""
    SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, len(embedding)::INT AS dimension FROM embeddings""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    return vectors.check_dimension(e, "embedding", 64).select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.size("embedding").alias("dimension"))


@query(r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{L}\p{N}_]+')) AS token FROM documents),
    c AS (SELECT doc_id, token, count(*) AS n, sha256(token) AS h FROM t GROUP BY ALL),
    s AS (SELECT doc_id, (('0x' || h[1:16])::UBIGINT % 384)::INT AS bucket,
                 sum(n * CASE WHEN ('0x' || h[18:18])::INT % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM c GROUP BY ALL HAVING v <> 0)
    SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    return vectors.hashing_embedding(docs, "doc_id", "text").select("doc_id", "bucket", F.round("value", 6).alias("value"))


# --- scalar functions ----------------------------------------------------------------------------------------------
@query(f"""
    SELECT row_id, {_space('name')} AS space, {_law('name')} AS law, {_ruling('name')} AS ruling, {_letters('name')} AS file,
           {_profile('name')} AS profile, {_advice('name')} AS advice FROM lawyers""")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "lawyers")
    return rows.select(
        "row_id", text.normalize_space("name").alias("space"), text.normalize_law("name").alias("law"), text.normalize_ruling("name").alias("ruling"),
        text.normalize_file("name").alias("file"), text.normalize_profile("name").alias("profile"), text.clean_advice("name").alias("advice"),
    )


@query(f"""
    SELECT row_id, array_to_string(regexp_extract_all({_digits('title')}, '\\d+'), ',') AS numbers,
           nullif(regexp_extract({_digits('title')}, '(?:سال\\s*)?(1[234]\\d{{2}})', 1), '') AS year,
           nullif(regexp_replace({_digits("regexp_extract(coalesce(approval_date, ''), '[۰-۹٠-٩0-9]{2,4}/[۰-۹٠-٩0-9]{1,2}/[۰-۹٠-٩0-9]{1,2}')")}, '\\s+', '', 'g'), '') AS plain_date FROM nodes""")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "nodes")
    date = text.approval_date(F.concat(F.lit("تاریخ: "), F.coalesce("approval_date", F.lit(""))))
    return rows.select("row_id", F.array_join(text.number_tokens("title"), ",").alias("numbers"), text.year("title").alias("year"), date.alias("plain_date"))


_STOP = "\\s+(?:مصوب|الحاقی|اصلاحی|مورخ|با\\s+اصلاحات|با\\s+الحاقات|که|می\\s*باشد|خواهد\\s+بود|است)(?:\\s.*)?$"


@query(f"""
    SELECT row_id, trim(regexp_replace({_space('title')}, '{_STOP}', ''), ' ،؛.ـ-–') AS legal_title,
           regexp_replace(id, '[^a-zA-Z0-9_.-]+', '_', 'g') || '.html' AS page_file,
           CASE WHEN length(title) > 20 THEN rtrim(title[1:20], ' ') || '…' ELSE title END AS clipped, {_space('text')}[1:280] AS excerpt FROM nodes""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "nodes")
    return rows.select("row_id", text.legal_title("title").alias("legal_title"), text.page_filename("id").alias("page_file"), text.clip("title", 20).alias("clipped"), text.excerpt("text").alias("excerpt"))


def _case(x: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{other}' END"


@query(f"""
    SELECT row_id,
      {_case(_law('text'), text.LAW_RELATIONS, 'REFERENCES')} AS law_relation, {_case(_ruling('text'), text.RULING_RELATIONS, 'REFERENCES')} AS ruling_relation,
      {_case(_ruling('text'), text.DECISION_RELATIONS, 'CITES_DECISION')} AS decision_relation
    FROM nodes""")
def relation_types(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "nodes")
    return rows.select("row_id", text.law_relation("text").alias("law_relation"), text.ruling_relation("text").alias("ruling_relation"), text.decision_relation("text").alias("decision_relation"))


@query(f"""
    SELECT row_id, CASE WHEN regexp_matches({_letters('text')}, '{"|".join(text.LOGIN_MARKERS)}') THEN 'unauthorized'
      WHEN regexp_matches({_letters('text')}, '{"|".join(text.PAYWALL_MARKERS)}') AND url IS NULL THEN 'paywalled'
      WHEN url IS NOT NULL AND dataset = 'laws' THEN 'subscribed' WHEN url IS NOT NULL THEN 'public' ELSE 'missing_file' END AS access,
      ({" + ".join(f"contains(coalesce(text, ''), {m!r})::INT" for m in text.PAYWALL_MARKERS)}) >= 2
        AND NOT regexp_matches(coalesce(text, ''), '{text.DATE}') AND NOT regexp_matches(coalesce(text, ''), 'موضوع ?:') AS paywalled,
      regexp_matches(lower({_space('title')}), '404|not found|صفحه یافت نشد|صفحه مورد نظر یافت نشد')
        OR (length({_space('text')}) < 500 AND regexp_matches(lower({_space('text')}), 'page not found|صفحه مورد نظر یافت نشد|اطلاعاتی یافت نشد|موردی یافت نشد')) AS missing
    FROM nodes""")
def access_rules(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "nodes")
    return rows.select(
        "row_id", text.file_access("text", F.col("url").isNotNull(), F.col("dataset") == "laws").alias("access"), text.paywalled("text").alias("paywalled"),
        text.looks_missing(F.lit(200), "title", "text").alias("missing"),
    )


@query("""
    SELECT row_id, len(string_split(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10)))::INT AS n_lines,
           CASE WHEN line IS NOT NULL THEN trim(regexp_replace(line, '%s+', ' ', 'g')) END AS approval
    FROM (SELECT *, coalesce(list_filter(string_split(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10))[1:8],
            lambda l: regexp_matches(l, 'مصوب|تصویب|اصلاحات|الحاقات'))[1],
            nullif(regexp_extract(coalesce(text, ''), '([^\\n]{0,180}(?:مصوب|تصویب)[^\\n]{0,180})', 1), '')) AS line FROM nodes)""" % _SP)
def approval_lines(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "nodes")
    return rows.select("row_id", F.size(text.lines("text")).alias("n_lines"), text.approval_line("text").alias("approval"))


@query("""
    SELECT row_id, len(coalesce(TRY_CAST(CASE WHEN json_valid(specialties_json) THEN specialties_json END AS JSON)::VARCHAR[], []))::INT AS n_specialties,
           nullif(regexp_extract(coalesce(email, ''), '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}'), '') AS email,
           array_to_string(list_filter(list_transform(coalesce(specialties, []), lambda s: trim(s)), lambda s: s <> ''), ' | ') AS specialties FROM lawyers""")
def profile_fields(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "lawyers")
    return rows.select("row_id", F.size(text.json_list("specialties_json")).alias("n_specialties"), text.email("email").alias("email"), F.concat_ws(" | ", text.string_list("specialties")).alias("specialties"))


@query(
    r"""
    SELECT row_id, lower(regexp_extract(detail_url, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(detail_url, '://([^/?#]*)', 1)) ||
             coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(detail_url, '://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '(/show/\d+)(?:/.*)?$', '\1'), ''), '/') AS canonical,
           nullif(regexp_extract(detail_url, '/show/(\d+)', 1), '') AS number, lower(nullif(regexp_extract(file_url, '(?i)\.("""
    + "|".join(urls.EXTENSION_KINDS)
    + r""")$', 1), '')) AS ext,
           regexp_extract(detail_url, '://([^/?#]*)', 1) = regexp_extract(file_url, '://([^/?#]*)', 1) AS same
    FROM legal_files WHERE file_url IS NOT NULL"""
)
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "legal_files")[0].where("file_url IS NOT NULL")
    r = urls.route("detail_url", "qanunyar.example", "/files/", [("detail", "show", r"/show/(\d+)(?:/|$)"), ("category", "childs", r"/childs/(\d+)(?:/|$)"), ("index", "lists", r"/lists(?:/|$)")])
    return rows.select("row_id", urls.canonical("detail_url").alias("canonical"), r["numeric_id"].alias("number"), urls.extension("file_url").alias("ext"), urls.same_origin("detail_url", "file_url").alias("same"))


@query(r"""
    SELECT row_id, nullif(regexp_extract(source_url, '[?&]lawyerID=([^&#]*)', 1), '') AS lawyer_id, nullif(regexp_extract(source_url, '[?&]page=([^&#]*)', 1), '') AS page FROM consultations""")
def url_parameters(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "consultations")
    return rows.select("row_id", urls.parameter("source_url", "lawyerID").alias("lawyer_id"), urls.parameter("source_url", "page").alias("page"))


def _kind_sql() -> str:
    ext = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.EXTENSION_KINDS.items())
    mime = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.MIME_KINDS.items())
    return rf"""
    SELECT row_id, coalesce(CASE lower(regexp_extract(file_url, '(?i)\.([a-z0-9]+)$', 1)) {ext} END, CASE m {mime} END,
             CASE WHEN string_split(m, '/')[1] IN ('audio', 'video', 'image') THEN string_split(m, '/')[1] END, 'unknown') AS kind
    FROM (SELECT *, lower(trim(string_split(coalesce(mime_type, ''), ';')[1])) AS m FROM legal_files)"""


@query(_kind_sql())
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "legal_files")[0].select("row_id", urls.file_kind("file_url", "mime_type").alias("kind"))


# --- identities ----------------------------------------------------------------------------------------------------
@query("""
    SELECT source_id, target_id, relation_type, sha256(concat_ws(chr(0), source_id, target_id, relation_type, coalesce(raw_reference, ''))) AS relation_key FROM relations""")
def relation_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "relations")[0].select("source_id", "target_id", "relation_type", ids.relation_key("source_id", "target_id", "relation_type", "raw_reference").alias("relation_key"))


@query(f"""
    WITH s AS (SELECT row_id, sha1(unhex('{chunks.URL_NAMESPACE.hex}') || encode(id || chr(0) || row_id)) AS h, id FROM nodes)
    SELECT row_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[('0x' || h[17:17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id,
           'tag:' || sha1(lower(trim(id)))[1:20] AS stable_id, 'external_legal_document:' || sha256(id)[1:20] AS hash_id FROM s""")
def identities(spark: SparkSession, d: str) -> DataFrame:
    (rows,) = tables(spark, d, "nodes")
    name = F.concat_ws("\0", "id", F.col("row_id").cast("string"))
    return rows.select("row_id", ids.uuid5(uuid.NAMESPACE_URL, name).alias("point_id"), ids.stable_id("tag", "id").alias("stable_id"), ids.hash_id("external_legal_document", "id").alias("hash_id"))


@query(f"""
    WITH h AS (SELECT row_id, sha256({_advice("coalesce(advice_date, '') || chr(10) || coalesce(title, '') || chr(10) || coalesce(question, '') || chr(10) || coalesce(answer, '')")}) AS hash FROM consultations)
    SELECT hash, min(row_id) AS row_id, count(*) AS n FROM h GROUP BY hash""")
def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "consultations")[0].select("row_id", ids.item_hash("advice_date", "title", "question", "answer").alias("hash"))
    return rows.groupBy("hash").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


@query("SELECT to_json({'source_id': source_id, 'target_id': target_id, 'relation_type': relation_type}) AS signature, count(*) AS n FROM relations GROUP BY 1")
def signature_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "relations")[0].select(F.to_json(F.struct("source_id", "target_id", "relation_type")).alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("n"))


# --- merges --------------------------------------------------------------------------------------------------------
@query(_merge_sql("nodes", "id", merge.LAW_POLICY, "loaded_at, row_id", "dataset = 'laws'"))
def law_node_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge(tables(spark, d, "nodes")[0].where("dataset = 'laws'"), ["id"], merge.LAW_POLICY, ["loaded_at", "row_id"])


@query(_merge_sql("nodes", "id", merge.RULING_POLICY, "loaded_at, row_id", "dataset = 'unanimity'"))
def ruling_node_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge(tables(spark, d, "nodes")[0].where("dataset = 'unanimity'"), ["id"], merge.RULING_POLICY, ["loaded_at", "row_id"])


@query("""
    SELECT source_id, target_id, relation_type, coalesce(raw_reference, '') AS raw_reference, max(confidence) AS confidence,
           coalesce(max(nullif(source_url, '')), '') AS source_url FROM relations GROUP BY ALL""")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "relations")[0].withColumn("raw_reference", text.or_empty("raw_reference")).withColumn("source_url", text.or_empty("source_url"))
    return merge.merge(rows, ["source_id", "target_id", "relation_type", "raw_reference"], merge.EDGE_POLICY, ["source_url"])


def _node_kept(c: str) -> str:
    return f"(list({c} ORDER BY loaded_at, row_id) FILTER ({c} IS NOT NULL))[-1] AS {c}"


@query(f"""
    SELECT id, coalesce((list(type ORDER BY loaded_at, row_id) FILTER (dataset = 'laws'))[-1], (list(type ORDER BY loaded_at, row_id))[1]) AS node_type,
           array_to_string(list_sort(list_distinct(list(dataset))), ',') AS source_datasets,
           array_to_string(list_sort(list_distinct(flatten(list({_LABELS}) FILTER (type IS NOT NULL)))), ',') AS labels,
           {', '.join(_node_kept(c) for c in ('title', 'url', 'text', 'access_status', 'year', 'category'))} FROM nodes GROUP BY id""")
def graph_node_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = merge.graph_nodes(tables(spark, d, "nodes")[0], ["loaded_at", "row_id"])
    return merged.withColumn("source_datasets", F.array_join("source_datasets", ",")).withColumn("labels", F.array_join("labels", ","))


@query("""
    WITH d AS (SELECT id, min(dataset) AS dataset FROM nodes GROUP BY id),
    e AS (SELECT r.*, d.dataset, sha256(concat_ws(chr(0), source_id, target_id, relation_type, coalesce(raw_reference, ''))) AS relation_key FROM relations r JOIN d ON d.id = r.source_id)
    SELECT relation_key, max(source_id) AS source_id, max(target_id) AS target_id, max(relation_type) AS relation_type, max(raw_reference) AS raw_reference,
           (list(confidence ORDER BY source_url NULLS FIRST, confidence NULLS FIRST) FILTER (confidence IS NOT NULL))[-1] AS confidence,
           (list(source_url ORDER BY source_url) FILTER (source_url IS NOT NULL))[-1] AS source_url, array_to_string(list_sort(list_distinct(list(dataset))), ',') AS source_datasets
    FROM e WHERE target_id IN (SELECT id FROM nodes) GROUP BY 1""")
def graph_edge_merge(spark: SparkSession, d: str) -> DataFrame:
    """Edges by key; the page that an edge was read from stands for the time, as the table has none."""
    nodes, edges = tables(spark, d, "nodes", "relations")
    datasets = nodes.groupBy(F.col("id").alias("source_id")).agg(F.min("dataset").alias("dataset"))
    merged = merge.graph_edges(edges.join(datasets, "source_id"), nodes, ["source_url", "confidence"])
    return merged.withColumn("source_datasets", F.array_join("source_datasets", ","))


@query(_merge_sql("lawyers", "lawyer_id", merge.PROFILE_POLICY, "coalesce(updated_at, ''), row_id"))
def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "lawyers")[0].withColumn("_at", text.or_empty("updated_at"))
    return merge.merge(rows, ["lawyer_id"], merge.PROFILE_POLICY, ["_at", "row_id"])


@query("""
    WITH t AS (SELECT lawyer_id, arg_max(name, row_id) AS name, arg_max(city, row_id) AS city, count(*) AS n FROM lawyers WHERE row_id % 2 = 0 GROUP BY 1),
    u AS (SELECT lawyer_id, name, city FROM lawyers WHERE row_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY lawyer_id ORDER BY row_id DESC) = 1),
    o AS (SELECT lawyer_id, name, city FROM lawyers WHERE row_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY lawyer_id ORDER BY row_id DESC) = 1)
    SELECT coalesce(u.lawyer_id, o.lawyer_id) AS lawyer_id, CASE WHEN u.lawyer_id IS NOT NULL THEN u.name ELSE o.name END AS name,
           CASE WHEN u.lawyer_id IS NOT NULL THEN u.city ELSE o.city END AS city FROM o FULL JOIN u ON u.lawyer_id = o.lawyer_id""")
def profile_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of odd rows, as a second delivery, overwrite those of even rows; all rows take part."""
    rows = tables(spark, d, "lawyers")[0].select("row_id", "lawyer_id", "name", "city")
    one = lambda half: merge.latest(rows.where(f"row_id % 2 = {half}"), ["lawyer_id"], ["row_id"])
    return merge.overwrite(one(0), one(1), "lawyer_id", ["name", "city"])


@query("""
    SELECT id, count(*) AS attempt_count, (list(access_status ORDER BY fetched_at, row_id))[-1] AS access_status, coalesce((list(http_status ORDER BY fetched_at, row_id))[-1], -1) AS http_status,
           (list(error ORDER BY fetched_at, row_id))[-1] AS error FROM legal_files GROUP BY id""")
def page_log(spark: SparkSession, d: str) -> DataFrame:
    return merge.page_log(tables(spark, d, "legal_files")[0], "id", ["fetched_at", "row_id"]).na.fill(-1, ["http_status"])


@query("""
    SELECT id, row_id, fetched_at, access_status FROM legal_files WHERE http_status = 200
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1""")
def latest_success(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "legal_files")[0].select("id", "row_id", "fetched_at", "access_status", "http_status")
    return merge.latest(rows, ["id"], ["fetched_at", "row_id"], F.col("http_status") == 200).drop("http_status")


@query("""
    WITH t AS (SELECT item_hash, min(row_id) AS row_id FROM consultations WHERE row_id % 2 = 0 GROUP BY item_hash)
    SELECT * FROM t UNION ALL SELECT item_hash, min(row_id) AS row_id FROM consultations c
    WHERE row_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.item_hash = c.item_hash) GROUP BY item_hash""")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """The first even row of each hash is there; of the odd rows those of known hashes are ignored. All rows take part."""
    rows = tables(spark, d, "consultations")[0].select("item_hash", "row_id")
    target = rows.where("row_id % 2 = 0").groupBy("item_hash").agg(F.min("row_id").alias("row_id"))
    return merge.insert_or_ignore(target, rows.where("row_id % 2 = 1"), "item_hash", ["row_id"])


@query("""
    SELECT document_id, row_id, chunk_index FROM document_chunks WHERE document_id NOT IN (SELECT id FROM legal_files WHERE type_file = 'pdf')
    UNION ALL SELECT id, row_id, 1 FROM legal_files WHERE type_file = 'pdf'""")
def replace_documents(spark: SparkSession, d: str) -> DataFrame:
    old, files = tables(spark, d, "document_chunks", "legal_files")
    new = files.where("type_file = 'pdf'").select(F.col("id").alias("document_id"), "row_id", F.lit(1).alias("chunk_index"))
    return merge.replace_group(old.select("document_id", "row_id", "chunk_index"), new, "document_id")


@query("SELECT id, row_id FROM nodes WHERE NOT (id LIKE 'note:%' OR type = 'index')")
def legacy_delete(spark: SparkSession, d: str) -> DataFrame:
    return merge.without_prefix(tables(spark, d, "nodes")[0].select("id", "row_id", "type"), "id", "note:", "index").drop("type")


@query("SELECT row_id, CASE WHEN detail_status = 'error' THEN 'pending' ELSE detail_status END AS detail_status FROM lawyers")
def state_reset(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "lawyers")[0].select("row_id", F.when(F.col("detail_status") == "error", "pending").otherwise(F.col("detail_status")).alias("detail_status"))


# --- counts --------------------------------------------------------------------------------------------------------
@query("SELECT type, count(*) AS n FROM nodes GROUP BY ROLLUP (type)")
def node_stats(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rollup_counts(tables(spark, d, "nodes")[0], "type")


@query("SELECT relation_type, count(*) AS n, count(raw_reference) AS n_raw, max(confidence) AS top FROM relations GROUP BY relation_type")
def edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "relations")[0].groupBy("relation_type").agg(F.count("*").alias("n"), F.count("raw_reference").alias("n_raw"), F.max("confidence").alias("top"))


@query("SELECT coalesce(access_status, 'unknown') AS access_status, count(*) AS n FROM nodes WHERE type = 'decision' GROUP BY 1")
def access_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "nodes")[0].where("type = 'decision'")
    return rows.groupBy(F.coalesce("access_status", F.lit("unknown")).alias("access_status")).agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, count(DISTINCT entity_id) AS n_entities, sum(token_count)::BIGINT AS tokens FROM (SELECT *, unnest(labels) AS label FROM text_chunks) GROUP BY label")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "text_chunks")[0].select("entity_id", "token_count", F.explode("labels").alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"), F.sum("token_count").alias("tokens"))


@query("SELECT detail_status, advice_status, count(*) AS n, count(error) AS n_errors, count(lawyer_id) AS n_ids FROM lawyers GROUP BY ALL")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "lawyers")[0].groupBy("detail_status", "advice_status").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"), F.count("lawyer_id").alias("n_ids"))


@query("SELECT custom_id, count(*) AS n FROM text_chunks GROUP BY custom_id HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return merge.check_unique(tables(spark, d, "text_chunks")[0], "custom_id")


# --- joins ---------------------------------------------------------------------------------------------------------
@query("""
    WITH p AS (SELECT profile_url, lawyer_id, name, city FROM lawyers QUALIFY row_number() OVER (PARTITION BY profile_url ORDER BY coalesce(updated_at, '') DESC, row_id DESC) = 1)
    SELECT c.row_id, p.lawyer_id, p.name, p.city FROM consultations c JOIN p USING (profile_url)""")
def consultation_lawyers(spark: SparkSession, d: str) -> DataFrame:
    rows, lawyers = tables(spark, d, "consultations", "lawyers")
    return consultations.with_lawyers(rows.select("row_id", "profile_url"), lawyers).select("row_id", "lawyer_id", "name", "city")


@query("""
    SELECT lawyer_id, profile_url, (SELECT count(*) FROM consultations c WHERE c.profile_url = l.profile_url) AS n_consultations
    FROM (SELECT lawyer_id, max(profile_url) AS profile_url FROM lawyers GROUP BY 1) l""")
def lawyer_consultation_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, lawyers = tables(spark, d, "consultations", "lawyers")
    return consultations.lawyer_counts(lawyers, rows)


@query("""
    WITH last AS (SELECT id, title, access_status FROM legal_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)
    SELECT c.row_id, c.document_id, CASE WHEN l.id IS NOT NULL AND l.title IS NOT NULL THEN l.title ELSE c.title END AS title
    FROM document_chunks c LEFT JOIN last l ON l.id = c.document_id""")
def left_enrich(spark: SparkSession, d: str) -> DataFrame:
    pieces, files = tables(spark, d, "document_chunks", "legal_files")
    right = files.select(F.col("id").alias("document_id"), "title", "row_id")
    return sequences.enrich(pieces.select("row_id", "document_id", "title"), right, "document_id", ["row_id"], ["title"])


@query("SELECT title, min(id) AS id FROM nodes WHERE title IS NOT NULL GROUP BY title HAVING count(DISTINCT id) = 1")
def lookup_unique_match(spark: SparkSession, d: str) -> DataFrame:
    return sequences.unique_match(tables(spark, d, "nodes")[0].select("title", "id"), "title", "id")


@query("SELECT lawyer_id FROM lawyers WHERE lawyer_id NOT IN (SELECT lawyer_id FROM lawyers WHERE detail_status = 'done')")
def anti_completed(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "lawyers")[0].select("lawyer_id", "detail_status")
    return sequences.remaining(rows, rows.where("detail_status = 'done'"), "lawyer_id").select("lawyer_id")


@query("""
    SELECT source_id, target_id, relation_type, confidence FROM relations
    WHERE relation_type IN ('APPLIES', 'IMPLEMENTS', 'INTERPRETS_AMENDMENT', 'REPEALS_OR_DISAPPLIES', 'REFERENCES')
      AND source_id IN (SELECT id FROM nodes WHERE type = 'decision')""")
def decision_authorities(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    kinds = ("APPLIES", "IMPLEMENTS", "INTERPRETS_AMENDMENT", "REPEALS_OR_DISAPPLIES", "REFERENCES")
    decisions = nodes.where("type = 'decision'").select(F.col("id").alias("source_id")).distinct()
    return edges.where(F.col("relation_type").isin(*kinds)).join(decisions, "source_id", "left_semi").select("source_id", "target_id", "relation_type", "confidence").orderBy("source_id", F.desc("confidence"), "target_id")


# --- graph ---------------------------------------------------------------------------------------------------------
def _trails(depth: int) -> str:
    allowed = ", ".join(f"'{a}'" for a in graph.ALLOWED)
    parts = ["SELECT s.seed, a.b AS node, 1 AS hops, [a.t] AS path, [a.e] AS used FROM seeds s JOIN adj a ON a.a = s.seed"]
    sql = f"""WITH e AS (SELECT *, row_number() OVER () AS e FROM (SELECT DISTINCT source_id, target_id, relation_type AS t, coalesce(raw_reference, '') AS r FROM relations WHERE relation_type IN ({allowed}))),
      adj AS (SELECT source_id AS a, target_id AS b, t, e FROM e UNION ALL SELECT target_id, source_id, t, e FROM e WHERE source_id <> target_id),
      seeds AS (SELECT DISTINCT id AS seed FROM nodes WHERE row_id % 100 = 0), t1 AS ({parts[0]})"""
    for i in range(2, depth + 1):
        sql += f", t{i} AS (SELECT p.seed, a.b AS node, {i} AS hops, list_append(p.path, a.t) AS path, list_append(p.used, a.e) AS used FROM t{i - 1} p JOIN adj a ON a.a = p.node WHERE NOT list_contains(p.used, a.e))"
    every = " UNION ALL ".join(f"SELECT seed, node, hops, path FROM t{i}" for i in range(1, depth + 1))
    return sql + f" SELECT seed, node AS neighbor, hops::INT AS hops, array_to_string(min(path), ',') AS relation_types FROM ({every}) GROUP BY seed, node, hops QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY hops) = 1"


def _expansion(depth: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        nodes, edges = tables(spark, d, "nodes", "relations")
        found = graph.expand(nodes.where("row_id % 100 = 0").select("id"), edges, depth)
        return found.withColumn("relation_types", F.array_join("relation_types", ","))

    run.__name__ = f"graph_expand_{depth}"
    return query(_trails(depth))(run)


graph_expand_1, graph_expand_2, graph_expand_3 = (_expansion(i) for i in (1, 2, 3))


@query("""
    WITH e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM relations WHERE relation_type = 'CONTAINS' AND source_id <> target_id),
    r AS (SELECT DISTINCT id AS root FROM nodes WHERE type = 'category'), l1 AS (SELECT DISTINCT root, b AS node FROM r JOIN e ON a = root),
    l2 AS (SELECT DISTINCT root, b AS node FROM l1 JOIN e ON a = node), l3 AS (SELECT DISTINCT root, b AS node FROM l2 JOIN e ON a = node)
    SELECT root, node, min(depth)::INT AS depth FROM (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) GROUP BY ALL""")
def hierarchy_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    return graph.hierarchy(edges, nodes.where("type = 'category'").select("id"))


def _rounds(n: int) -> str:
    sql = """WITH m AS (SELECT id, (list(type ORDER BY row_id))[-1] AS type, (list(title ORDER BY row_id))[-1] AS title, (list(category ORDER BY row_id))[-1] AS category FROM nodes GROUP BY id),
      e AS (SELECT DISTINCT source_id AS parent, target_id AS id FROM relations WHERE relation_type = 'CONTAINS'),
      s0 AS (SELECT id, category, CASE WHEN type = 'category' THEN title END AS own FROM m)"""
    for i in range(1, n + 1):
        sql += f""", s{i} AS (SELECT c.id, coalesce(c.category, (SELECT min({{'rank': CASE WHEN p.own IS NOT NULL THEN 0 ELSE 1 END, 'value': coalesce(p.own, p.category)}}).value
             FROM e JOIN s{i - 1} p ON p.id = e.parent WHERE e.id = c.id AND (p.own IS NOT NULL OR p.category IS NOT NULL))) AS category, c.own FROM s{i - 1} c)"""
    return sql + f" SELECT id, category FROM s{n}"


@query(_rounds(8))
def category_propagate(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    one = merge.merge(nodes, ["id"], {"type": "last", "title": "last", "category": "last"}, ["row_id"])
    return graph.propagate(one, edges)


@query("""
    WITH m AS (SELECT id, (list(type ORDER BY row_id))[-1] AS type, (list(year ORDER BY row_id))[-1] AS year FROM nodes GROUP BY id)
    SELECT c.id, coalesce(c.year, (SELECT min(p.year) FROM relations r JOIN m p ON p.id = r.source_id WHERE r.target_id = c.id AND r.relation_type = 'CONTAINS' AND p.type = 'year')) AS year
    FROM m c WHERE c.type = 'decision'""")
def year_propagate(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    return graph.propagate_years(merge.merge(nodes, ["id"], {"type": "last", "year": "last"}, ["row_id"]), edges)


@query(f"""
    WITH m AS (SELECT id, (list(decision_number ORDER BY row_id))[-1] AS number, (list(type ORDER BY row_id))[-1] AS type FROM nodes GROUP BY id),
    n AS (SELECT id, {_digits('number')}::BIGINT AS n FROM m WHERE type = 'decision' AND regexp_full_match({_digits('number')}, '[0-9]+')),
    s AS (SELECT id, n, row_number() OVER (ORDER BY n, id) AS rn FROM n)
    SELECT a.id AS source_id, b.id AS target_id, CASE WHEN b.n < a.n THEN 'PREVIOUS_DECISION' ELSE 'NEXT_DECISION' END AS relation_type, 0.95::DOUBLE AS confidence
    FROM s a JOIN s b ON abs(a.rn - b.rn) = 1 WHERE abs(a.n - b.n) = 1""")
def adjacency_next_prev(spark: SparkSession, d: str) -> DataFrame:
    """Decisions in the order of their numbers, each adjacent to the one before and after in that list."""
    one = merge.merge(tables(spark, d, "nodes")[0], ["id"], {"type": "last", "decision_number": "last"}, ["row_id"])
    decisions = one.withColumn("decision_number", text.normalize_digits("decision_number"))
    listed = decisions.where("type = 'decision' AND decision_number RLIKE '^[0-9]+$'").select("id", F.col("decision_number").cast("long").alias("n"))
    listed = chunks.numbered(listed, ["n", "id"])
    beside = listed.select(F.col("id").alias("source_id"), F.explode(F.array(F.col("rn") - 1, F.col("rn") + 1)).alias("rn")).join(listed.select("rn", F.col("id").alias("target_id")), "rn")
    return graph.adjacency(decisions, beside.select("source_id", "target_id", F.lit("ADJACENT_DECISION").alias("relation_type")))


@query("""
    WITH m AS (SELECT id, min(type) AS type FROM nodes GROUP BY id),
    l AS (SELECT DISTINCT source_id, target_id, s.type AS st, t.type AS tt FROM relations r JOIN m s ON s.id = source_id JOIN m t ON t.id = target_id WHERE source_id <> target_id)
    SELECT source_id, target_id, 'LINKS_TO' AS relation_type, 0.7::DOUBLE AS confidence FROM l
    UNION ALL SELECT source_id, target_id, 'CONTAINS', 1.0::DOUBLE FROM l WHERE (st = 'category' AND tt IN ('law_group', 'document')) OR (st = 'law_group' AND tt = 'document')
    UNION ALL SELECT source_id, target_id, 'LISTS', 0.95::DOUBLE FROM l WHERE st = 'index'
    UNION ALL SELECT source_id, target_id, 'ADJACENT_DECISION', 0.75::DOUBLE FROM l WHERE st = 'decision' AND tt = 'decision'""")
def structural_relations(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    types = nodes.groupBy("id").agg(F.min("type").alias("type"))
    of = lambda a, b: types.select(F.col("id").alias(a), F.col("type").alias(b))
    links = edges.join(of("source_id", "page_type"), "source_id").join(of("target_id", "target_type"), "target_id")
    return graph.structure(links.select(F.col("source_id").alias("page"), "page_type", F.col("target_id").alias("target"), "target_type"))


@query("""
    WITH RECURSIVE l AS (SELECT DISTINCT source_id AS a, target_id AS b FROM relations WHERE relation_type = 'LINKS_TO'),
    f AS (SELECT DISTINCT id AS page, 0 AS depth FROM nodes WHERE type = 'category' UNION SELECT l.b, f.depth + 1 FROM f JOIN l ON l.a = f.page WHERE f.depth < 60)
    SELECT page, min(depth)::INT AS depth FROM f GROUP BY page""")
def frontier_bfs(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    links = edges.where("relation_type = 'LINKS_TO'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    return graph.frontier(links, nodes.where("type = 'category'").select("id"))


# --- chunks --------------------------------------------------------------------------------------------------------
_PY_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_PY_SPACE}+|{_PY_SPACE}+$', '', 'g')"


def _chunk_sql(longest: int, overlap: int) -> str:
    """doc_id, chunk_index, chunk_count, piece: windows walked from piece to piece."""
    ends = f"greatest(CASE WHEN instr(reverse(w), chr(10)) > 0 THEN {longest} - instr(reverse(w), chr(10)) ELSE -1 END, CASE WHEN instr(reverse(w), ' .') > 0 THEN {longest} - instr(reverse(w), ' .') - 1 ELSE -1 END)"
    step = f"SELECT doc_id, s, a, w, CASE WHEN a + {longest} - 1 >= length(s) THEN length(s) - a + 1 WHEN {ends} > {longest // 2} THEN {ends} + 1 ELSE {longest} END AS n"
    return f"""RECURSIVE t AS (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
        lambda l: {_py_strip('l')}), lambda l: l <> ''), chr(10)) AS s FROM documents),
      f AS ({step} FROM (SELECT doc_id, s, 1 AS a, substr(s, 1, {longest}) AS w FROM t WHERE s <> '')
        UNION ALL {step} FROM (SELECT doc_id, s, a + n - {overlap} AS a, substr(s, a + n - {overlap}, {longest}) AS w FROM f WHERE a + n - 1 < length(s))),
      p AS (SELECT doc_id, a, {_py_strip('substr(s, a, n)')} AS piece FROM f),
      c AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_count FROM p WHERE piece <> '')"""


@query(f"WITH {_chunk_sql(1500, 200)} SELECT doc_id, chunk_index::INT AS chunk_index, chunk_count::INT AS chunk_count, length(piece)::INT AS n_chars, sha256(piece) AS hash FROM c")
def character_chunks(spark: SparkSession, d: str) -> DataFrame:
    pieces = chunks.character_chunks(tables(spark, d, "documents")[0], "doc_id", "text", 1500, 200)
    return pieces.select("doc_id", "chunk_index", "chunk_count", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("hash"))


@query(f"""
    WITH {_chunk_sql(1000, 100)},
    e AS (SELECT doc_id, chunk_index, chunk_count, piece FROM c UNION ALL SELECT doc_id, 1, 1, title FROM documents WHERE title IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM c)),
    i AS (SELECT e.*, d.title, 'legal_file:' || doc_id || ':chunk:' || chunk_index || ':' || sha256(piece)[1:16] AS id FROM e JOIN documents d USING (doc_id)),
    h AS (SELECT *, sha1(unhex('{chunks.URL_NAMESPACE.hex}') || encode(id)) AS h FROM i)
    SELECT 'legal_file:' || doc_id AS document_id, chunk_index::INT AS chunk_index, chunk_count::INT AS chunk_count, piece AS text, title, id,
           h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[('0x' || h[17:17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id,
           title || chr(10) || chr(10) || piece AS embedding_input FROM h""")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = tables(spark, d, "documents")[0].select(F.concat(F.lit("legal_file:"), F.col("doc_id")).alias("document_id"), "title", "text")
    return chunks.document_chunks(docs, 1000, 100)


@query(f"""
    WITH w AS (SELECT row_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}+'), lambda x: x <> '') AS w,
                      list_filter(regexp_split_to_array(CASE WHEN title <> '' THEN 'عنوان: ' || title ELSE '' END, '{_SP}+'), lambda x: x <> '') AS h FROM nodes),
    c AS (SELECT *, 120 - len(h) AS a, len(w) AS n FROM w WHERE len(w) > 0),
    k AS (SELECT *, CASE WHEN n <= a THEN 1 ELSE 1 + ceil((n - a) / (a - 20.0))::INT END AS chunk_count FROM c)
    SELECT row_id::VARCHAR AS id, (i + 1)::INT AS chunk_index, chunk_count::INT AS chunk_count, (len(h) + len(w[i * (a - 20) + 1 : i * (a - 20) + a]))::INT AS token_count
    FROM k, LATERAL (SELECT unnest(range(chunk_count)) AS i)""")
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "nodes")[0].select(F.col("row_id").cast("string").alias("id"), "title", "text")
    pieces = chunks.token_chunks(rows, "id", "text", F.col("title"), F.array().cast("array<string>"), 120, 20)
    return pieces.select("id", "chunk_index", "chunk_count", "token_count")


@query("""
    WITH r AS (SELECT row_id, row_number() OVER (ORDER BY entity_id, chunk_index, row_id) AS rn FROM text_chunks)
    SELECT row_id, ((rn - 1) // 20 + 1)::INT AS shard, ((rn - 1) % 20 + 1)::INT AS place,
           'graph-' || lpad(((rn - 1) // 20 + 1)::VARCHAR, 4, '0') || '-' || lpad(((rn - 1) % 20 + 1)::VARCHAR, 6, '0') AS custom_id FROM r""")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "text_chunks")[0].select("row_id", "entity_id", "chunk_index")
    return chunks.shards(rows, ["entity_id", "chunk_index", "row_id"], 20).select("row_id", "shard", "place", "custom_id")


@query("""
    WITH RECURSIVE s AS (SELECT (rn - 1) // 20 + 1 AS shard, sum(token_count)::BIGINT AS tokens
      FROM (SELECT token_count, row_number() OVER (ORDER BY entity_id, chunk_index, row_id) AS rn FROM text_chunks) GROUP BY 1),
    f AS (SELECT 0::BIGINT AS shard, 0::BIGINT AS tokens, false AS taken, 0::BIGINT AS used
      UNION ALL SELECT s.shard, s.tokens, f.used + s.tokens <= 60000, f.used + CASE WHEN f.used + s.tokens <= 60000 THEN s.tokens ELSE 0 END FROM f JOIN s ON s.shard = f.shard + 1)
    SELECT shard, tokens, taken FROM f WHERE shard > 0""")
def token_budget_wave(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "text_chunks")[0].select("row_id", "entity_id", "chunk_index", "token_count")
    sums = chunks.shards(rows, ["entity_id", "chunk_index", "row_id"], 20).groupBy("shard").agg(F.sum("token_count").alias("tokens"))
    return chunks.wave(sums, 60_000)


# --- evidence ------------------------------------------------------------------------------------------------------
_AUTH = "CASE WHEN list_has_any(labels, ['Question', 'Answer', 'Lawyer', 'Tag']) THEN 'auxiliary' WHEN list_has_any(labels, ['Article', 'Note', 'Law', 'LegalDecision', 'LegalProvision', 'UnanimityDecision']) THEN 'primary' ELSE 'secondary' END"


@query(f"""
    WITH n AS (SELECT row_id, access_status, coalesce({_LABELS}, []) AS labels FROM nodes)
    SELECT row_id, CASE WHEN {_AUTH} = 'auxiliary' THEN 'auxiliary' WHEN access_status = 'reference_only' THEN 'secondary' ELSE {_AUTH} END AS authority,
           coalesce(list_filter({list(evidence.PRIORITY)}, lambda x: list_contains(labels, x))[1], 'legal_source') AS source_type FROM n""")
def authority_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "nodes")[0].select("row_id", "access_status", merge.labels_of(F.col("dataset"), F.col("type")).alias("labels"))
    return rows.select("row_id", evidence.authority(F.col("labels"), F.col("access_status")).alias("authority"), evidence.source_type(F.col("labels")).alias("source_type"))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as evidence of runs, one run for each entity."""
    rows = tables(spark, d, "text_chunks")[0].where("entity_id IS NOT NULL").select(
        F.col("entity_id").alias("run_id"), F.col("custom_id").alias("evidence_id"), "entity_id", F.coalesce("title", F.lit("")).alias("title"), "text",
        evidence.authority(F.col("labels"), F.lit(None).cast("string")).alias("authority"), F.col("token_count").cast("double").alias("score"), F.col("row_id").alias("position"),
    )
    return evidence.ledger(rows)


_LEDGER = f"""
    l0 AS (SELECT entity_id AS run_id, custom_id, min(row_id) AS first FROM text_chunks WHERE entity_id IS NOT NULL GROUP BY ALL),
    l1 AS (SELECT *, 'S' || row_number() OVER (PARTITION BY run_id ORDER BY first, custom_id) AS source_id FROM l0),
    l2 AS (SELECT entity_id AS run_id, custom_id, coalesce(title, '') AS title, {_AUTH} AS authority, text, token_count FROM text_chunks WHERE entity_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY entity_id, custom_id ORDER BY token_count DESC, row_id) = 1),
    l AS (SELECT * FROM l1 JOIN l2 USING (run_id, custom_id))"""
_BODY = "این پاسخ بر پایه منبع بازیابی شده نوشته شده است"


@query(f"""
    WITH {_LEDGER}, g AS (SELECT run_id, list_contains(list(source_id), 'S2') AS two, max(title) FILTER (source_id = 'S1') AS t1, max(title) FILTER (source_id = 'S2') AS t2,
        max(authority) FILTER (source_id = 'S1') AS a1, max(authority) FILTER (source_id = 'S2') AS a2 FROM l GROUP BY run_id),
    k AS (SELECT *, list_filter([CASE WHEN two THEN '{evidence.UNCITED}' END, CASE WHEN NOT (a1 = 'primary' OR (two AND a2 = 'primary')) THEN '{evidence.NO_PRIMARY}' END], lambda x: x IS NOT NULL) AS limits FROM g)
    SELECT run_id, CASE WHEN two THEN '{_BODY}. [S1]' || chr(10) || chr(10) || '{_BODY}.' ELSE '{_BODY}. [S1]' END
        || CASE WHEN len(limits) > 0 THEN chr(10) || chr(10) || 'محدودیت‌های پاسخ:' || chr(10) || array_to_string(list_transform(limits, lambda x: '- ' || x), chr(10)) ELSE '' END
        || chr(10) || chr(10) || 'منابع بازیابی‌شده:' || chr(10) || '- [S1] ' || t1 || CASE WHEN two THEN chr(10) || '- [S2] ' || t2 ELSE '' END AS answer,
      CASE WHEN two THEN 'S1,S2' ELSE 'S1' END AS cited, array_to_string(limits, ',') AS limitations, len(limits) > 0 AS limited FROM k""")
def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Drafts held to the ledgers of their runs: a known marker, an unknown one, a source named beside the text, and, where
    there are two sources, a paragraph without a marker."""
    sources = _ledger(spark, d)
    runs = sources.groupBy("run_id").agg(F.count("*").alias("n"))
    drafted = F.when(F.col("n") >= 2, F.lit(f"{_BODY}. [S1][S999]\n\n{_BODY}.")).otherwise(F.lit(f"{_BODY}. [S1][S999]"))
    drafts = runs.select("run_id", evidence.draft(F.substring("run_id", 1, 0), F.array(F.col("run_id"), drafted)).alias("answer"), F.array(F.lit("S1"), F.lit("S2"), F.lit("S777")).alias("cited_source_ids"), F.lit(None).cast("array<string>").alias("limitations"))
    out = evidence.grounded(drafts, sources)
    return out.select("run_id", "answer", F.array_join("cited", ",").alias("cited"), F.array_join("limitations", ",").alias("limitations"), "limited")


@query("""
    SELECT DISTINCT r.source_id AS run_id, r.target_id AS entity_id FROM relations r JOIN text_chunks c ON c.entity_id = r.target_id WHERE r.relation_type = 'REFERENCES'""")
def known_entities(spark: SparkSession, d: str) -> DataFrame:
    """Of the entities that a node refers to, those whose chunks its ledger holds."""
    edges, pieces = tables(spark, d, "relations", "text_chunks")
    asked = edges.where("relation_type = 'REFERENCES'").select(F.col("source_id").alias("run_id"), F.col("target_id").alias("entity_id")).distinct()
    held = asked.join(pieces.select("entity_id").distinct(), "entity_id", "left_semi")
    return evidence.known(asked, held)


@query(f"""
    WITH {_LEDGER} SELECT run_id, bool_and(source_id <> 'S3') AS short, bool_or(authority = 'primary') AS any_primary, round(avg(token_count), 6) AS mean, min(token_count)::DOUBLE AS least, count(*) FILTER (token_count IS NULL) AS failures
    FROM l GROUP BY run_id""")
def run_quantifiers(spark: SparkSession, d: str) -> DataFrame:
    """Of each run: whether no source is the third, whether any is primary, and the scores' mean, least and failures."""
    return _ledger(spark, d).groupBy("run_id").agg(
        F.bool_and(F.col("source_id") != "S3").alias("short"), F.bool_or(F.col("authority") == "primary").alias("any_primary"),
        F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.count_if(F.col("score").isNull()).alias("failures"),
    )


@query("""
    WITH a AS (SELECT row_id, coalesce(list_distinct(regexp_extract_all(t, '\\[(S[0-9]+)\\]', 1)), []) AS ids, t FROM (SELECT row_id, '[S1] ' || coalesce(answer, '') || ' [S' || (row_id % 7) || '][S2]' AS t FROM consultations))
    SELECT row_id, array_to_string(list_sort(ids), ',') AS markers, trim(CASE WHEN row_id % 7 IN (1, 2) THEN t ELSE replace(t, '[S' || (row_id % 7) || ']', '') END) AS kept FROM a""")
def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "consultations")[0].select("row_id", F.concat(F.lit("[S1] "), text.or_empty("answer"), F.lit(" [S"), (F.col("row_id") % 7).cast("string"), F.lit("][S2]")).alias("t"))
    return rows.select("row_id", F.array_join(F.array_sort(text.markers("t")), ",").alias("markers"), text.strip_markers("t", F.array(F.lit("S1"), F.lit("S2"))).alias("kept"))


@query("""
    WITH e AS (SELECT DISTINCT source_id, target_id FROM relations WHERE relation_type = 'REFERENCES' AND source_id <> target_id),
    m AS (SELECT id, (list(text ORDER BY loaded_at, row_id))[-1] AS text FROM nodes GROUP BY id),
    s AS (SELECT id FROM (SELECT DISTINCT id FROM nodes) ORDER BY id LIMIT 50),
    n AS (SELECT DISTINCT CASE WHEN source_id IN (SELECT id FROM s) THEN target_id ELSE source_id END AS a, 1 AS x FROM e WHERE source_id IN (SELECT id FROM s) OR target_id IN (SELECT id FROM s)),
    b AS (SELECT target_id AS a FROM e WHERE source_id IN (SELECT id FROM s) UNION SELECT source_id FROM e WHERE target_id IN (SELECT id FROM s)),
    t AS (SELECT a, text FROM b JOIN m ON m.id = b.a ORDER BY a LIMIT 100)
    SELECT a AS neighbor, 1 AS hops, 'REFERENCES' AS relation_types FROM t WHERE length(trim(coalesce(text, ''))) > 0""")
def graph_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty ids as seeds: their nearest hundred neighbours, of which those with text are evidence."""
    nodes, edges = tables(spark, d, "nodes", "relations")
    one = merge.merge(nodes, ["id"], {"text": "last"}, ["loaded_at", "row_id"])
    wanted = [r[0] for r in nodes.select("id").distinct().orderBy("id").limit(60).collect()]
    seeds = spark.createDataFrame([(i,) for i in graph.seed_ids(wanted)], "id string")
    found = graph.expand(seeds, edges.where("source_id != target_id"), 1, ("REFERENCES",)).where("hops = 1")
    return graph.evidence(found, one, 100).select("neighbor", "hops", F.array_join("relation_types", ",").alias("relation_types"))


@query("""
    SELECT profile_url AS run_id, 'e:' || item_hash AS evidence_id, length(answer)::DOUBLE AS score, row_id AS position FROM consultations
    WHERE profile_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY profile_url, item_hash ORDER BY length(answer) DESC NULLS LAST, row_id) = 1""")
def dedupe_best_score(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "consultations")[0].where("profile_url IS NOT NULL").select(
        F.col("profile_url").alias("run_id"), F.concat(F.lit("e:"), "item_hash").alias("evidence_id"), F.length("answer").cast("double").alias("score"), F.col("row_id").alias("position")
    )
    return evidence.best(rows, ["run_id", "evidence_id"])


@query("""
    WITH f AS (SELECT profile_url AS run_id, item_hash AS evidence_id, min(row_id) AS first FROM consultations WHERE profile_url IS NOT NULL GROUP BY ALL)
    SELECT run_id, evidence_id, 'S' || row_number() OVER (PARTITION BY run_id ORDER BY first, evidence_id) AS source_id FROM f""")
def source_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "consultations")[0].where("profile_url IS NOT NULL").select(
        F.col("profile_url").alias("run_id"), F.col("item_hash").alias("evidence_id"), F.lit(1.0).alias("score"), F.col("row_id").alias("position")
    )
    return evidence.ledger(rows).select("run_id", "evidence_id", "source_id")


@query("""
    SELECT row_id, profile_url FROM consultations WHERE profile_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY profile_url ORDER BY row_id DESC) <= 3""")
def history_tail(spark: SparkSession, d: str) -> DataFrame:
    return evidence.tail(tables(spark, d, "consultations")[0].where("profile_url IS NOT NULL").select("row_id", "profile_url"), "profile_url", "row_id", 3)


@query("""
    WITH a AS (SELECT row_id, row_number() OVER (ORDER BY length(text) DESC NULLS LAST, row_id) AS rank FROM text_chunks),
    b AS (SELECT row_id, row_number() OVER (ORDER BY token_count DESC, row_id) AS rank FROM text_chunks)
    SELECT row_id, round(1.0::DOUBLE / (60 + a.rank) + 1.0::DOUBLE / (60 + b.rank), 9) AS score FROM a JOIN b USING (row_id)""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "text_chunks")[0].select("row_id", F.coalesce(-F.length("text"), F.lit(1)).alias("by_text"), (-F.col("token_count")).alias("by_tokens"))
    lists = [chunks.numbered(rows, [c, "row_id"], "rank") for c in ("by_text", "by_tokens")]
    return evidence.fused(lists, "row_id").withColumn("score", F.round("score", 9))


@query("""
    WITH o AS (SELECT entity_id AS run_id, custom_id, max(token_count) AS token_count, max(length(text)) AS score FROM text_chunks GROUP BY ALL),
    u AS (SELECT *, sum(token_count) OVER (PARTITION BY run_id ORDER BY score DESC, custom_id ROWS UNBOUNDED PRECEDING) AS used FROM o)
    SELECT run_id, custom_id, used::BIGINT AS used FROM u WHERE used <= 600""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "text_chunks")[0].select(F.col("entity_id").alias("run_id"), "custom_id", "token_count", F.length("text").alias("score"))
    return evidence.context(rows, "run_id", "custom_id", "token_count", "score", 600).select("run_id", "custom_id", "used")


# --- citations -----------------------------------------------------------------------------------------------------
def _one_each(nodes: DataFrame) -> DataFrame:
    return merge.merge(nodes, ["id"], dict.fromkeys(("type", "title", "text", "numeric_id", "decision_number"), "last"), ["loaded_at", "row_id"])


def _heading_sql(source: str, key: str, heading: str) -> str:
    """key, i, parts: what is before a heading, and each heading with its label, number and text up to the next one."""
    marked = f"regexp_replace(text, '(?m)(^|[\\n.؛]){heading}', '\\1' || chr(1) || '\\3' || chr(2) || '\\4' || chr(3) || '\\2', 'g')"
    return f"SELECT {key}, i, parts[i + 1] AS part FROM (SELECT {key}, string_split({marked}, chr(1)) AS parts FROM {source} WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(parts))) AS i)"


_N = "[۰-۹٠-٩0-9]+"
_DASH = f"(?:[-–—ـ:]{_SP}*)?"
_ARTICLE_SQL = f"({_SP}*(ماده|اصل){_SP}*[(\\[]?{_SP}*({_N}){_SP}*[)\\]]?{_SP}*{_DASH})"
_NOTE_SQL = f"({_SP}*(تبصره)(?:{_SP}*[(\\[]?{_SP}*({_N}){_SP}*[)\\]]?)?{_SP}*{_DASH})"
_ARTICLES = f"""
    m AS (SELECT id, (list(type ORDER BY loaded_at, row_id))[-1] AS type, (list(text ORDER BY loaded_at, row_id))[-1] AS text FROM nodes GROUP BY id),
    h AS (HEADINGS),
    a AS (SELECT id AS document_id, i, split_part(part, chr(2), 1) AS label, {_digits("split_part(split_part(part, chr(3), 1), chr(2), 2)")} AS number, {_space("split_part(part, chr(3), 2)")} AS text FROM h),
    b AS (SELECT *, 'article:' || document_id || ':' || label || ':' || number AS id FROM a QUALIFY row_number() OVER (PARTITION BY document_id, label, number ORDER BY i DESC) = 1)"""


@query("WITH " + _ARTICLES.replace("HEADINGS", _heading_sql("(SELECT * FROM m WHERE type IN ('document', 'law_group'))", "id", _ARTICLE_SQL)) + " SELECT document_id, id, label, number, text FROM b")
def law_articles(spark: SparkSession, d: str) -> DataFrame:
    nodes = _one_each(tables(spark, d, "nodes")[0]).where("type IN ('document', 'law_group')")
    return citations.articles(nodes)


@query("WITH " + _ARTICLES.replace("HEADINGS", _heading_sql("m", "id", _ARTICLE_SQL)) + f""",
    n AS ({_heading_sql("b", "id", _NOTE_SQL)}),
    o AS (SELECT id AS article_id, i, nullif({_digits("split_part(split_part(part, chr(3), 1), chr(2), 2)")}, '') AS own, {_space("split_part(part, chr(3), 2)")} AS text FROM n)
    SELECT article_id, 'note:' || article_id || ':' || coalesce(own, i::VARCHAR) AS id, coalesce(own, i::VARCHAR) AS number, text FROM o
    QUALIFY row_number() OVER (PARTITION BY article_id, coalesce(own, i::VARCHAR) ORDER BY i DESC) = 1""")
def law_notes(spark: SparkSession, d: str) -> DataFrame:
    return citations.notes(citations.articles(_one_each(tables(spark, d, "nodes")[0])))


@query(f"""
    WITH m AS (SELECT id, (list(title ORDER BY loaded_at, row_id))[-1] AS title, (list(type ORDER BY loaded_at, row_id))[-1] AS type FROM nodes GROUP BY id),
    t AS (SELECT {_law('title')} AS title, min(id) AS id FROM m WHERE type IN ('document', 'law_group') AND length({_law('title')}) >= 3 GROUP BY 1),
    p AS (SELECT DISTINCT title AS phrase, trim(regexp_split_to_array({_law('title')}, '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(text.TITLE_STOPS)})($|[^\\p{{L}}\\p{{N}}_])')[1]) AS c FROM text_chunks WHERE title <> ''),
    x AS (SELECT phrase, c FROM p WHERE c <> ''), e AS (SELECT x.phrase, t.id FROM x JOIN t ON t.title = x.c),
    i AS (SELECT x.phrase, t.id FROM x JOIN t ON length(t.title) >= 5 AND contains(x.c, t.title) WHERE x.phrase NOT IN (SELECT phrase FROM e)
      QUALIFY row_number() OVER (PARTITION BY x.phrase ORDER BY length(t.title) DESC, t.title DESC) = 1)
    SELECT phrase, id, 1.0::DOUBLE AS confidence FROM e UNION ALL SELECT phrase, id, 0.96::DOUBLE FROM i""")
def title_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Phrases that equal a title or hold one; similar ones, which SQL can't score, are left to law_citation_edges."""
    nodes, pieces = tables(spark, d, "nodes", "text_chunks")
    found = citations.resolve_titles(pieces.where("title <> ''").select(F.col("title").alias("phrase")), citations.title_choices(_one_each(nodes)), cutoff=100.1)
    return found.where("confidence >= 0.96")


@query()
def law_citation_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    one = _one_each(nodes)
    return citations.law_citations(one.where("type IN ('document', 'article', 'note')"), citations.title_choices(one), citations.article_lookup(one, edges))


@query()
def ruling_citation_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = tables(spark, d, "nodes", "relations")
    one = _one_each(nodes)
    choices = citations.title_choices(one, normal=text.normalize_ruling)
    return citations.ruling_citations(one.where("type = 'decision'"), choices, citations.article_lookup(one, edges))


_KEY = f"replace(replace({_ruling('decision_number')}, ' ', ''), 'شماره', '')"


@query(f"""
    WITH m AS (SELECT id, (list(type ORDER BY loaded_at, row_id))[-1] AS type, (list(decision_number ORDER BY loaded_at, row_id))[-1] AS decision_number FROM nodes GROUP BY id),
    k AS (SELECT {_KEY} AS key, min(id) AS target, count(*) AS n FROM m WHERE type = 'decision' AND {_KEY} <> '' GROUP BY 1),
    c AS (SELECT DISTINCT r.source_id, {_KEY} AS key FROM relations r JOIN m ON m.id = r.target_id AND m.type = 'decision' WHERE r.relation_type = 'CITES_DECISION' AND {_KEY} <> ''
      UNION SELECT DISTINCT source_id, '9999999' FROM relations WHERE relation_type = 'CITES_DECISION')
    SELECT c.source_id, CASE WHEN n = 1 THEN target ELSE 'external_unanimity_decision:' || sha256(c.key)[1:20] END AS target_id, 'CITES_DECISION' AS relation_type,
           'رأی وحدت رویه شماره ' || c.key AS raw_reference, CASE WHEN n = 1 THEN 0.95 WHEN n > 1 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence
    FROM c LEFT JOIN k ON k.key = c.key WHERE c.source_id IN (SELECT id FROM m) AND (n IS DISTINCT FROM 1 OR target <> c.source_id)""")
def decision_citation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Texts that cite by number the decisions that their nodes' edges lead to, and one that isn't there: the texts of the
    table itself cite none. A number may belong to one decision, to several or to none."""
    nodes, edges = tables(spark, d, "nodes", "relations")
    one = _one_each(nodes)
    number = text.decision_key("decision_number")
    decisions = one.where("type = 'decision'").select(F.col("id").alias("target_id"), number.alias("key")).where("key != ''")
    cites = edges.where("relation_type = 'CITES_DECISION'")
    keys = cites.join(decisions, "target_id").select("source_id", "key").unionByName(cites.select("source_id", F.lit("9999999").alias("key"))).distinct()
    cited = keys.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("key")), lambda k: F.concat(F.lit("رأی وحدت رویه شماره "), k)), "\n").alias("text"))
    return citations.decision_citations(one.drop("text").join(cited, "id", "left"))


# --- questions and answers -----------------------------------------------------------------------------------------
def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "consultations")[0].where("profile_url IS NOT NULL")
    lawyer = F.struct(F.regexp_extract("profile_url", "lawyerID=(.*)$", 1).alias("name"), F.lit(None).cast("string").alias("city"), F.col("profile_url").alias("profile_url"))
    answer = F.struct(F.lit(None).cast("string").alias("number"), F.col("answer").alias("text"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("time"), lawyer.alias("lawyer"))
    tag = F.struct(F.col("advice_date").alias("name"), F.lit("").alias("url"))
    return rows.select(
        F.col("row_id").cast("string").alias("request_id"), F.lit("ok").alias("status"), F.col("source_url").alias("page_url"), F.col("created_at").alias("fetched_at"),
        F.struct("title", F.col("question").alias("text"), F.array(tag).alias("tags")).alias("question"), F.array(answer).alias("answers"),
    )


@query(f"""
    WITH c AS (SELECT *, regexp_extract(profile_url, 'lawyerID=(.*)$', 1) AS name FROM consultations WHERE profile_url IS NOT NULL)
    SELECT label, count(*) AS n FROM (SELECT DISTINCT 'Question' AS label, row_id::VARCHAR AS id FROM c UNION SELECT 'Answer', row_id::VARCHAR FROM c WHERE {_strip('answer')} <> ''
      UNION SELECT 'Tag', lower({_strip('advice_date')}) FROM c WHERE {_strip('advice_date')} <> ''
      UNION SELECT 'Lawyer', lower({_strip('profile_url')}) FROM c WHERE {_strip('answer')} <> '' AND {_strip('name')} <> '') GROUP BY label""")
def qa_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = consultations.graph(_records(spark, d))
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


@query(f"""
    WITH c AS (SELECT *, regexp_extract(profile_url, 'lawyerID=(.*)$', 1) AS name FROM consultations WHERE profile_url IS NOT NULL)
    SELECT 'question:' || row_id AS question, 'answer:' || row_id || ':1' AS answer,
           CASE WHEN {_strip('name')} <> '' THEN 'lawyer:' || sha1(lower({_strip('profile_url')}))[1:20] END AS lawyer FROM c WHERE {_strip('answer')} <> ''""")
def qa_optional_match(spark: SparkSession, d: str) -> DataFrame:
    _, links = consultations.graph(_records(spark, d))
    of = lambda kind, a, b: links.where(F.col("relation_type") == kind).select(F.col("source_id").alias(a), F.col("target_id").alias(b))
    return of("HAS_ANSWER", "question", "answer").join(of("ANSWERED_BY", "answer", "lawyer"), "answer", "left").select("question", "answer", "lawyer")


@query("""
    SELECT id, profile_url FROM (SELECT row_id AS id, profile_url, advice_status, lawyer_id, detail_status, advice_url FROM lawyers)
    WHERE detail_status IN ('done', 'pending') AND length(advice_url) > 0 AND coalesce(advice_status, '') <> 'done'""")
def advice_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue of consultations once the details that are pending have been read."""
    rows = tables(spark, d, "lawyers")[0].withColumn("detail_status", F.when(F.col("detail_status") == "pending", "done").otherwise(F.col("detail_status")))
    return readers.advice_queue(rows, "lawyer_id").select(F.col("row_id").alias("id"), "profile_url")


@query("""
    SELECT n.row_id, n.title, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)),
        lambda l: trim(regexp_replace(l, '[\\s\\x{A0}]+', ' ', 'g'))), lambda l: l <> ''), chr(10)), '') AS text
    FROM nodes n WHERE title <> '' AND regexp_full_match(coalesce(text, '') || title, '[\\x{20}-\\x{25}\\x{27}-\\x{3B}\\x{3D}\\x{3F}-\\x{7E}\\x{600}-\\x{6FF}\\x{200C}\\n]*') AND trim(title) = title AND length(text) > 300
      AND len(list_distinct(string_split(text, chr(10)))) = len(string_split(text, chr(10))) AND NOT contains(title, '  ')""")
def page_contents(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of nodes, with a menu, a form that is never closed, a footer and comments, and their content read again.
    Texts with markup, signs of other scripts or repeated lines are left to the tests, as SQL has no parser."""
    rows = tables(spark, d, "nodes")[0].where("title != '' AND length(text) > 300 AND trim(title) = title AND instr(title, '  ') = 0")
    rows = rows.where(F.concat("text", "title").rlike(r"^[\x{20}-\x{25}\x{27}-\x{3B}\x{3D}\x{3F}-\x{7E}\x{600}-\x{6FF}\x{200C}\n]*\z") & (F.size(F.array_distinct(F.split("text", "\n"))) == F.size(F.split("text", "\n"))))
    page = F.concat(
        F.lit("<html><head><title>site | x</title></head><body><nav><a href='/'>menu</a></nav><div class='page'><div><form><input name=q></div><article><h1>"), F.col("title"), F.lit("</h1><p>"),
        F.replace(F.col("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><div class='comments'>c</div></article></div><footer>f</footer></body></html>"),
    )
    read = rows.select("row_id", html.content(page, F.lit("")).alias("c"))
    return read.select("row_id", "c.title", "c.text")


# --- order, pages --------------------------------------------------------------------------------------------------
@query("""
    WITH l AS (SELECT doc_id, i, lines[i] AS line, lines[i - 1] AS before FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i))
    SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (i = 1 OR line <> before)::INT AS n_kept FROM l GROUP BY doc_id""")
def line_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "documents")[0].select("doc_id", text.lines("text").alias("ls"))
    return rows.select("doc_id", F.size("ls").alias("n_lines"), F.size(sequences.without_runs(F.col("ls"))).alias("n_kept"))


@query("""
    WITH p AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY ALL),
    f AS (SELECT *, sum((n > 0)::INT) OVER (PARTITION BY user_id ORDER BY day) AS g FROM p),
    r AS (SELECT *, sum((n = 0)::INT) OVER (PARTITION BY user_id, g ORDER BY day) AS run FROM f),
    s AS (SELECT *, min(day) FILTER (run >= 3) OVER (PARTITION BY user_id) AS stop FROM r)
    SELECT user_id, day::VARCHAR AS day, n FROM s WHERE stop IS NULL OR day <= stop""")
def until_empty(spark: SparkSession, d: str) -> DataFrame:
    """Days of each user up to three days in a row without a purchase."""
    rows = tables(spark, d, "events")[0].groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("n"))
    return sequences.until_empty(rows, "user_id", "day", "n", 3).withColumn("day", F.col("day").cast("string"))


@query("""
    SELECT row_id, length(title)::INT AS n_title, 1 AS n_links FROM nodes WHERE url IS NOT NULL AND title IS NOT NULL AND NOT contains(title, '<') AND NOT contains(title, '&')""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of nodes, with a script, a menu and a link to the node, and read again."""
    rows = tables(spark, d, "nodes")[0].where("url IS NOT NULL AND title IS NOT NULL AND instr(title, '<') = 0 AND instr(title, '&') = 0")
    page = F.concat(F.lit("<html><head><title>t</title><script>var a = '<a href=x>';</script></head><body><nav><p>menu</p></nav><p><a href='"), F.col("url"), F.lit("'>"), F.col("title"), F.lit("</a></p></body></html>"))
    read = rows.select("row_id", "url", "title", page.alias("html"))
    found = html.links(read, "row_id", "url", "html").groupBy("row_id").agg(F.count("*").cast("int").alias("n_links"), F.max("url").alias("link"))
    return read.join(found, "row_id").where(F.col("link") == F.col("url")).select("row_id", F.length("title").alias("n_title"), "n_links")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = tables(spark, d, "customer", "orders")
    sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return customers.join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""
    WITH r AS (SELECT token_count, entity_id, (row_number() OVER (ORDER BY entity_id, chunk_index, row_id) - 1) // 20 + 1 AS shard FROM text_chunks)
    SELECT shard::INT AS shard, count(*) AS n_requests, count(DISTINCT entity_id) AS n_entities, sum(token_count)::BIGINT AS tokens, 'submitted' AS status, 1 AS attempts FROM r GROUP BY 1""")
def batch_state(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "text_chunks")[0].select("row_id", "entity_id", "chunk_index", "token_count")
    return batches.submitted(batches.prepared(chunks.shards(rows, ["entity_id", "chunk_index", "row_id"], 20)))


@query("""
    SELECT row_id::VARCHAR AS document_id, CASE WHEN coalesce(title, '') || coalesce(text, '') <> '' THEN 'indexed' ELSE 'failed' END AS ingestion_status FROM document_chunks""")
def ingestion_status(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "document_chunks")[0].select(F.col("row_id").cast("string").alias("document_id"), "title", "text")
    _, _, status = ingestion.ingest(rows)
    return status.select("document_id", "ingestion_status")


@query(f"""
    SELECT 'vector:' || point_id || ':' || row_id AS evidence_id, entity_id, coalesce(nullif(title, ''), entity_id) AS title, coalesce(nullif(node_type, ''), 'legal_source') AS source_type, {_AUTH} AS authority, token_count::DOUBLE AS score
    FROM text_chunks WHERE trim(entity_id) <> '' AND trim(text) <> ''""")
def evidence_from_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "text_chunks")[0]
    hits = rows.select(F.concat_ws(":", "point_id", F.col("row_id").cast("string")).alias("id"), F.col("token_count").alias("score"), F.struct("entity_id", "labels", "title", "text", "url", "node_type").alias("payload"))
    return evidence.from_hits(hits).select("evidence_id", "entity_id", "title", "source_type", "authority", "score")


@query("""
    SELECT row_id, len(json_keys(metadata_json))::INT AS n_leaves, json_extract_string(metadata_json, '$.source_lines') AS source_lines FROM nodes WHERE json_valid(metadata_json)""")
def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "nodes")[0].where("metadata_json IS NOT NULL").select("row_id", json.leaves("metadata_json").alias("ls"))
    return rows.select("row_id", F.size("ls").alias("n_leaves"), json.pick(F.col("ls"), ["source_lines"]).alias("source_lines"))
