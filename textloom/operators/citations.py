"""Articles, notes and citations in legal texts, and the titles, articles and decisions that they mean.

Offsets come from one Arrow-batched pass over each text; all joins and decisions after it are plans.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import article_id, hash_id, note_id
from ..functions.text import (
    decision_key, decision_number_tokens, decision_relation, law_relation, legal_number_tokens, legal_title,
    normalize_digits, normalize_law, normalize_space, number_tokens, ruling_candidate, ruling_relation, title_candidate,
)
from ..session import written

# The forms of headings and citations.
_NUM = "[۰-۹٠-٩0-9]+"
ARTICLE = re.compile(rf"(?:^|(?<=[\n.؛]))\s*(ماده|اصل)\s*[(\[]?\s*({_NUM})\s*[)\]]?\s*(?:[-–—ـ:]\s*)?", re.M)
NOTE = re.compile(rf"(?:^|(?<=[\n.؛]))\s*(تبصره)(?:\s*[(\[]?\s*({_NUM})\s*[)\]]?)?\s*(?:[-–—ـ:]\s*)?", re.M)
_LAW = r"(?:قانون|آیین\s*نامه|اساسنامه|دستورالعمل|بخشنامه|تصویب\s*نامه|لایحه\s+قانونی)"
LAW_CITATION = re.compile(rf"(ماده|مواد|اصل|اصول|تبصره|بند)\s+([۰-۹٠-٩0-9\s،,و\-–تاالی]+?)(?:\s+(?:از\s+)?({_LAW}[^\n.؛]{{2,140}}))?(?=$|[،؛.\n])")
_WORD = r"یک|دو|سه|چهار|پنج|شش|هفت|هشت|نه|ده"
_ONE = rf"(?:{_NUM}(?:\s*مکرر)?|{_WORD})"
_LAW2 = r"(?:قانون|آیین\s*نامه|اساسنامه|دستورالعمل|بخشنامه|تصویب\s*نامه|لایحه\s+قانونی|مقررات|نظامنامه)"
RULING_CITATION = re.compile(
    rf"(ماده|مواد|اصل|اصول|تبصره|بند)\s*[(\[«]?\s*({_ONE}(?:\s*(?:،|,|و|تا|الی|-|–)\s*{_ONE})*)[)\]»]?(?:\s+(?:از\s+)?({_LAW2}[^\n.؛]{{2,220}}))?(?=$|[،؛.\n])"
)
STANDALONE = re.compile(r"((?:قانون|آیین\s*نامه|اساسنامه|دستورالعمل|بخشنامه|تصویب\s*نامه|لایحه\s+قانونی|نظامنامه)[^\n.؛]{3,180})(?=$|[،؛.\n])")
DECISION_CITATION = re.compile(r"ر[أا]ی\s+وحدت\s*رویه(?:\s+قضایی)?\s*(?:شماره(?:های)?|ردیف)?\s*([()رR۰-۹٠-٩0-9/\-–،,\sو]{1,80})(?=$|[،؛.\n])", re.I)
SPAN = "array<struct<start:int,end:int,raw:string,g1:string,g2:string,g3:string,near:string,sentence:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), *[(n, pa.string()) for n in ("raw", "g1", "g2", "g3", "near", "sentence")]]))


def _sentence(text: str, start: int, end: int) -> str:
    left = max(text.rfind(mark, 0, start) for mark in "\n.؛") + 1
    right = [i for i in (text.find(mark, end) for mark in "\n.؛") if i >= 0]
    return text[left : min(right, default=len(text))]


def spans(text: Column, pattern: re.Pattern[str], near: int = 80) -> Column:
    """Matches of a pattern with offsets, up to three groups, the characters near and the sentence around."""

    @F.arrow_udf(SPAN)
    def find(values: pa.Array) -> pa.Array:
        def of(t: str | None) -> list[dict]:
            out = []
            for m in pattern.finditer(t or ""):
                a, b = m.span()
                g = (*m.groups(), None, None, None)
                out.append({"start": a, "end": b, "raw": m[0], "g1": g[0], "g2": g[1], "g3": g[2], "near": t[max(0, a - near) : b + near], "sentence": _sentence(t, a, b)})
            return out

        return pa.array([of(t) for t in values.to_pylist()], _SPAN_TYPE)

    return find(text)


def _sections(df: DataFrame, key: str, text: str, pattern: re.Pattern[str]) -> DataFrame:
    """Each heading with the text up to the next one."""
    found = df.select(key, text, F.posexplode(spans(F.col(text), pattern, 0)).alias("order", "m"))
    after = F.lead("m.start").over(Window.partitionBy(key).orderBy("order"))
    found = found.withColumn("stop", F.coalesce(after, F.length(text)))
    return found.select(key, (F.col("order") + 1).alias("order"), "m.g1", "m.g2", normalize_space(F.expr(f"substring({text}, m.start + 1, stop - m.start)")).alias("section"))


def articles(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Articles of documents: document_id, id, label, number, text. Text before the first article belongs to none; of a
    repeated id the last article stays."""
    found = _sections(df, key, text, ARTICLE)
    number = normalize_digits("g2")
    rows = found.select(F.col(key).alias("document_id"), article_id(F.col(key), F.col("g1"), number).alias("id"), F.col("g1").alias("label"), number.alias("number"), F.col("section").alias("text"), "order")
    return rows.groupBy("document_id", "id").agg(F.max_by(F.struct("label", "number", "text"), "order").alias("r")).select("document_id", "id", "r.*")


def notes(found: DataFrame) -> DataFrame:
    """Notes of articles: article_id, id, number, text; a note without a number takes its place as its number."""
    rows = _sections(found.select("id", "text"), "id", "text", NOTE)
    number = F.when(F.col("g2").isNotNull(), normalize_digits("g2"))
    rows = rows.select(F.col("id").alias("article_id"), note_id(F.col("id"), number, F.col("order")).alias("id"), F.coalesce(number, F.col("order").cast("string")).alias("number"), F.col("section").alias("text"), "order")
    return rows.groupBy("article_id", "id").agg(F.max_by(F.struct("number", "text"), "order").alias("r")).select("article_id", "id", "r.*")


def title_choices(nodes: DataFrame, kinds: tuple[str, ...] = ("document", "law_group"), normal: Callable[[str], Column] = normalize_law) -> DataFrame:
    """(title, id): normalised titles of at least three letters; the smallest id of equal titles."""
    named = nodes.where(F.col("type").isin(*kinds)).select(normal("title").alias("title"), "id")
    return named.where(F.length("title") >= 3).groupBy("title").agg(F.min("id").alias("id"))


def token_set_ratio(a: str, b: str) -> float:
    """100 times the best similarity of the shared words with the shared and own words of each, by longest common subsequence."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    join = lambda own: (both + " " + " ".join(sorted(own))).strip()
    left, right = join(x - y), join(y - x)
    scores = [_indel(left, right)]
    if both:
        scores += [_indel(both, left), _indel(both, right)]
    return max(scores)


def _indel(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths; bit-parallel, one step for each letter of b."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def resolve_titles(phrases: DataFrame, choices: DataFrame, cutoff: float = 80.0, candidate: Callable[[str], Column] = title_candidate) -> DataFrame:
    """(phrase, id, confidence) of phrases that name a known title: equal, else containing one, else similar.

    The cheap test comes first and only what is left goes on. Containment is an equi-join on what is rarest in a title.
    Similarity is asked of every pair that lengths and letters allow to reach the cutoff, with a word in common or without.
    """
    asked = phrases.select("phrase").where("phrase IS NOT NULL").distinct().withColumn("c", candidate("phrase")).where("c != ''")
    asked = written(asked, "phrases")
    choices = written(choices, "titles")
    exact = asked.join(choices, asked["c"] == choices["title"]).select("phrase", "id", F.lit(1.0).alias("confidence"))
    rest = written(asked.join(exact.select("phrase"), "phrase", "left_anti"), "unequal")
    inside = written(_containing(rest, choices), "containing")
    left = written(rest.join(inside.select("phrase"), "phrase", "left_anti"), "unknown")
    fuzzy = _similar(left, choices, cutoff)
    return exact.unionByName(inside).unionByName(fuzzy)


def _ends(c: str, of: Callable[[Column, Column], Column]) -> Column:
    """Suffixes or prefixes of every word of a text."""
    parts = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: of(w, i))
    return F.array_distinct(F.flatten(F.transform(F.split(c, " "), parts)))


def _containing(rest: DataFrame, choices: DataFrame) -> DataFrame:
    """(phrase, id, 0.96): the longest title of at least five letters that stands anywhere in a phrase.

    Where a title stands, its inner words are words of the phrase, its first word ends one and its last begins one. Of these
    marks the one that fewest titles have is joined, so a word that most titles share is never a key unless nothing else
    is there; a title of one word is looked up among the parts of words.
    """
    ws = F.split("title", " ")
    many = choices.where(F.length("title") >= 5).select("title", "id", ws.alias("ws"))
    mark = lambda kind, w: F.struct(F.lit(kind).alias("kind"), w.alias("w"))
    inner = F.transform(F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 2, F.lit(0))), lambda w: mark("inner", w))
    marks = F.concat(inner, F.array(mark("ends", F.col("ws")[0]), mark("begins", F.element_at("ws", -1))))
    marked = many.where(F.size("ws") > 1).select("title", "id", F.explode(F.array_distinct(marks)).alias("m"))
    rarity = marked.groupBy("m").agg(F.count("*").alias("df"))
    rarest = marked.join(rarity, "m").groupBy("title", "id").agg(F.min_by("m", F.struct("df", "m")).alias("m"))
    own = F.concat(
        F.transform(F.array_distinct(F.split("c", " ")), lambda w: mark("inner", w)),
        F.transform(_ends("c", lambda w, i: F.substr(w, i)), lambda w: mark("ends", w)), F.transform(_ends("c", lambda w, i: F.substring(w, 1, i)), lambda w: mark("begins", w)),
    )
    found = rest.select("phrase", "c", F.explode(own).alias("m")).join(rarest, "m").where(F.contains("c", "title")).select("phrase", "title", "id")
    single = many.where(F.size("ws") == 1).select("title", "id")
    found = found.unionByName(rest.select("phrase", F.explode(_substrings(F.col("c"))).alias("title")).join(single, "title").select("phrase", "title", "id"))
    return found.groupBy("phrase").agg(F.max_by("id", F.struct(F.length("title"), "title")).alias("id")).withColumn("confidence", F.lit(0.96))


def _substrings(c: Column) -> Column:
    """Beginnings of at least five letters of every suffix of every word."""
    return F.array_distinct(F.flatten(F.transform(F.split(c, " "), lambda w: F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w) - 4, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(5), F.greatest(F.length(w) - i + 1, F.lit(5))), lambda n: F.substring(w, i, n)))))))


def _rare_words(df: DataFrame, text: str, key: list[str], frequency: DataFrame, part: float) -> DataFrame:
    """The rarest words of each text, up to 1 - ``part`` of its letters: texts that share ``part`` of them share one of these."""
    w = df.select(*key, F.explode(F.array_distinct(F.split(text, " "))).alias("w")).join(frequency, "w", "left").na.fill(0, ["df"])
    order = Window.partitionBy(*key).orderBy("df", "w")
    before = F.coalesce(F.sum(F.length("w") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.length("w") + 1).over(Window.partitionBy(*key))
    return w.withColumn("before", before).withColumn("total", total).where(F.col("before") <= F.col("total") * (1 - part) + 1e-6).select(*key, "w")


_SKETCH = 4


def _letters(values: pa.Array) -> pa.Array:
    """Length of the distinct words, joined, and 256 bits: each letter, with its number among equal letters, turns one."""
    out = []
    for t in values.to_pylist():
        ws = " ".join(sorted(set((t or "").split())))
        bits, times = [0] * _SKETCH, dict[str, int]()
        for c in ws:
            times[c] = times.get(c, 0) + 1
            bit = crc32(f"{c}{times[c]}".encode()) % (64 * _SKETCH)
            bits[bit // 64] ^= 1 << bit % 64
        out.append([len(ws), *[x - (1 << 64) if x >> 63 else x for x in bits]])
    return pa.array(out, pa.list_(pa.int64()))


def _similar(left: DataFrame, choices: DataFrame, cutoff: float) -> DataFrame:
    """The most similar title of each phrase, of all that reach the cutoff: the smallest of equally similar ones.

    A score is reached either by the words that both sides share or by all letters. Shared words that reach it are
    cutoff / (200 - cutoff) of a side, so one of them is a rare word of that side. By letters, at most (1 - cutoff / 100) of
    both lengths may stand on one side only. Letters on one side only are at least as many as the bits in which the
    sketches differ, so the join passes by no pair that reaches the cutoff; only what it finds is compared letter by letter.
    """
    part = cutoff / (200 - cutoff)
    word = lambda df, c, key: df.select(*key, F.explode(F.array_distinct(F.split(c, " "))).alias("w"))
    titles = word(choices, "title", ["title", "id"])
    frequency = written(titles.groupBy("w").agg(F.count("*").alias("df")), "title-words")
    one = word(left, "c", ["phrase", "c"]).join(_rare_words(choices, "title", ["title", "id"], frequency, part), "w")
    two = _rare_words(left, "c", ["phrase", "c"], frequency, part).join(titles, "w")
    pairs = one.select("phrase", "c", "title", "id").unionByName(two.select("phrase", "c", "title", "id")).distinct()
    a, b = F.array_distinct(F.split("c", " ")), F.array_distinct(F.split("title", " "))
    size = lambda ws: F.length(F.array_join(ws, " "))
    pairs = pairs.select("*", size(F.array_intersect(a, b)).alias("n"), size(a).alias("n_a"), size(b).alias("n_b"))
    covered = F.when((F.col("n") == F.col("n_a")) | (F.col("n") == F.col("n_b")), 100.0).otherwise(200.0 * F.col("n") / (F.col("n") + F.least("n_a", "n_b")))
    sure = pairs.select("phrase", "id", "title", covered.alias("score"))

    @F.arrow_udf("double")
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([token_set_ratio(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    letters = F.arrow_udf(_letters, "array<bigint>")
    described = lambda df, c, *names: df.select(*names, c, letters(c).alias("l")).select(*names, c, F.col("l")[0].alias("size"), *[F.col("l")[i + 1].alias(f"s{i}") for i in range(_SKETCH)])
    x, y = written(described(left, "c", "phrase"), "phrase-letters"), written(described(choices, "title", "id"), "title-letters")
    # a row of a phrase for each length that a title may have
    sizes = F.sequence(F.ceil(F.col("size") * part - 1e-6), F.floor(F.col("size") / part + 1e-6))
    x = x.where("size > 0").select("*", F.explode(sizes).alias("other"))
    apart = F.expr(" + ".join(f"bit_count(a.s{i} ^ b.s{i})" for i in range(_SKETCH)))
    near = (F.col("a.other") == F.col("b.size")) & (apart <= (1 - cutoff / 100) * (F.col("a.size") + F.col("b.size")) + 1e-6)
    asked = x.alias("a").join(y.alias("b"), near).select("a.phrase", "b.id", "b.title", ratio("a.c", "b.title").alias("score"))
    scored = sure.unionByName(asked).where(F.col("score") >= cutoff)
    top = scored.groupBy("phrase").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "title")).alias("m"))
    return top.select("phrase", "m.id", F.round(F.col("m.score") / 100, 3).alias("confidence"))


def article_lookup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, label, number, article): articles that are the only one of their label and number in a document, or in a
    group of laws over all its documents."""
    part = lambda i: F.regexp_extract("id", r"^article:(document:(?:child|show):\d+):(ماده|اصل):(\d+)$", i)
    own = nodes.where(F.col("type") == "article").select(part(1).alias("owner"), part(2).alias("label"), part(3).alias("number"), F.col("id").alias("article")).where("owner != ''")
    groups = edges.where("relation_type = 'CONTAINS' AND source_id LIKE 'law\\_group:%' AND target_id LIKE 'document:%'").select("source_id", F.col("target_id").alias("owner")).distinct()
    of_group = own.join(groups, "owner").select(F.col("source_id").alias("owner"), "label", "number", "article")
    single = own.unionByName(of_group).groupBy("owner", "label", "number").agg(F.min("article").alias("article"), F.max("article").alias("other"))
    return single.where("article = other").drop("other")


def law_citations(nodes: DataFrame, choices: DataFrame, lookup: DataFrame) -> DataFrame:
    """Edges of citations in laws: source_id, target_id, relation_type, raw_reference, confidence.

    A citation of the article's own heading is none. Without a title it means the own document (0.72); a title that isn't
    resolved gives a placeholder (0.35). Each number leads to its article; if none does, the document takes 0.08 less.
    """
    found = nodes.where(F.length("text") > 0).select("id", "type", "numeric_id", F.explode(spans(F.col("text"), LAW_CITATION)).alias("m"))
    found = found.select("id", "type", "numeric_id", "m.*").withColumn("numbers", number_tokens("g2")).withColumn("raw", normalize_space("raw"))
    heading = (F.col("type") == "article") & (F.col("start") <= 8) & (F.try_element_at("numbers", F.lit(1)) == F.col("numeric_id"))
    found = found.where(~F.coalesce(heading, F.lit(False))).withColumn("relation_type", law_relation("near")).withColumnRenamed("g3", "phrase")
    found = written(found.select("id", "type", "raw", "g1", "phrase", "numbers", "relation_type"), "citations")
    named = resolve_titles(found, choices)
    owner = F.when(F.col("type") == "document", F.col("id")).when(F.col("type").isin("article", "note"), F.regexp_replace("id", r"^(?:note:)?(?:article:)?(.*?):(?:ماده|اصل):.*$", "$1"))
    found = found.join(named.withColumnsRenamed({"id": "named", "confidence": "c"}), "phrase", "left")
    target = F.when(F.col("phrase").isNotNull(), F.col("named")).otherwise(owner)
    found = found.withColumn("target", target).withColumn("c", F.when(F.col("phrase").isNotNull(), F.col("c")).otherwise(0.72))
    label = F.when(F.col("g1").isin("ماده", "مواد"), "ماده").when(F.col("g1").isin("اصل", "اصول"), "اصل")
    found = found.withColumn("label", label)
    numbered = found.where("target IS NOT NULL AND label IS NOT NULL AND size(numbers) > 0").select("*", F.explode("numbers").alias("number"))
    hit = numbered.join(lookup, (F.col("target") == F.col("owner")) & (numbered["label"] == lookup["label"]) & (numbered["number"] == lookup["number"]))
    to_article = hit.select("id", F.col("article").alias("target_id"), "relation_type", "raw", F.col("c").alias("confidence"))
    keys = ["id", "raw", "relation_type", "target"]
    resolved = hit.select(*keys).distinct()
    plain = found.where("target IS NOT NULL").join(resolved, keys, "left_anti")
    less = F.when(F.col("label").isNotNull() & (F.size("numbers") > 0), F.greatest(F.lit(0.45), F.col("c") - 0.08)).otherwise(F.col("c"))
    to_document = plain.select("id", F.col("target").alias("target_id"), "relation_type", "raw", less.alias("confidence"))
    to_none = found.where("target IS NULL").select("id", hash_id("unresolved", F.col("raw")).alias("target_id"), "relation_type", "raw", F.lit(0.35).alias("confidence"))
    every = to_article.unionByName(to_document).unionByName(to_none)
    return every.groupBy(F.col("id").alias("source_id"), "target_id", "relation_type", F.col("raw").alias("raw_reference")).agg(F.round(F.max("confidence"), 3).alias("confidence"))


def ruling_citations(nodes: DataFrame, choices: DataFrame, lookup: DataFrame) -> DataFrame:
    """Edges of citations in rulings, of provisions and of laws that stand alone outside every provision's span (an
    interval anti-join within the text). Unknown laws and provisions get ids of their own; without a title the citation
    is unresolved."""
    text = F.col("text")
    both = nodes.where(F.length("text") > 0).select("id", spans(text, RULING_CITATION).alias("p"), spans(text, STANDALONE).alias("s"))
    outside = F.filter("s", lambda m: ~F.exists("p", lambda q: (m["end"] > q["start"]) & (m["start"] < q["end"])))
    cited = both.select("id", F.explode("p").alias("m")).select("id", "m.*", F.lit(False).alias("alone"))
    alone = both.select("id", F.explode(outside).alias("m")).select("id", "m.*", F.lit(True).alias("alone"))
    alone = alone.withColumn("g3", F.col("g1")).withColumn("g1", F.lit(None).cast("string")).withColumn("g2", F.lit(None).cast("string"))
    rows = cited.unionByName(alone).withColumn("phrase", F.when(F.col("g3").isNotNull(), legal_title("g3"))).where(~F.col("alone") | (F.length("phrase") >= 6))
    label = F.when(F.col("g1").isin("ماده", "مواد"), "ماده").when(F.col("g1").isin("اصل", "اصول"), "اصل").otherwise(F.col("g1"))
    rows = rows.select("id", "alone", "phrase", label.alias("label"), legal_number_tokens("g2").alias("numbers"), normalize_space("raw").alias("raw"), ruling_relation("sentence").alias("relation_type"))
    rows = written(rows, "ruling-citations")
    named = resolve_titles(rows, choices, 82.0, ruling_candidate).withColumnsRenamed({"id": "named", "confidence": "c"})
    rows = rows.join(named, "phrase", "left")
    law = F.coalesce(F.col("named"), F.when(F.col("phrase").isNotNull(), hash_id("external_legal_document", normalize_law("phrase"))))
    c = F.coalesce(F.col("c"), F.when(F.col("alone"), 0.42).otherwise(0.45))
    rows = rows.withColumn("law", law).withColumn("c", c)
    numbered = rows.where("law IS NOT NULL AND size(numbers) > 0").select("id", "law", "label", "raw", "relation_type", "c", F.explode("numbers").alias("number"))
    own = lookup.withColumnsRenamed({"owner": "o", "label": "l", "number": "n"})
    joined = numbered.join(own, (F.col("law") == F.col("o")) & (F.col("label") == F.col("l")) & (F.col("number") == F.col("n")), "left")
    outside_id = hash_id("external_legal_provision", F.concat("law", "label", "number"), 24)
    provisions = joined.select("id", "law", F.coalesce("article", outside_id).alias("target_id"), "relation_type", "raw", F.col("c").alias("confidence"))
    contains = provisions.select(F.col("law").alias("id"), "target_id", F.lit("CONTAINS").alias("relation_type"), F.lit("").alias("raw"), F.lit(0.85).alias("confidence")).distinct()
    whole = rows.where("law IS NOT NULL AND size(numbers) = 0").select("id", F.col("law").alias("target_id"), "relation_type", "raw", F.col("c").alias("confidence"))
    none = rows.where("law IS NULL").select("id", hash_id("unresolved_legal_reference", F.col("raw")).alias("target_id"), "relation_type", "raw", F.lit(0.35).alias("confidence"))
    every = provisions.drop("law").unionByName(contains).unionByName(whole).unionByName(none)
    return every.groupBy(F.col("id").alias("source_id"), "target_id", "relation_type", F.col("raw").alias("raw_reference")).agg(F.max("confidence").alias("confidence"))


def decision_citations(nodes: DataFrame) -> DataFrame:
    """Edges of citations of decisions by number: 0.95 where one decision has it, 0.60 where several, 0.40 where none."""
    keyed = nodes.where((F.col("type") == "decision") & F.col("decision_number").isNotNull()).select(decision_key("decision_number").alias("key"), "id").where("key != ''")
    numbers = keyed.groupBy("key").agg(F.min("id").alias("target"), F.count_distinct("id").alias("n"))
    found = nodes.where(F.length("text") > 0).select("id", "decision_number", F.explode(spans(F.col("text"), DECISION_CITATION)).alias("m")).select("id", "decision_number", "m.*")
    raw = normalize_space("raw")
    own = (F.col("start") < 10) & (F.col("decision_number") != "") & F.contains(raw, F.col("decision_number"))
    found = found.where(~F.coalesce(own, F.lit(False))).select("id", raw.alias("raw"), decision_relation("sentence").alias("relation_type"), F.explode(decision_number_tokens("g1")).alias("number"))
    joined = found.withColumn("key", decision_key("number")).join(numbers, "key", "left")
    target = F.when(F.col("n") == 1, F.col("target")).otherwise(hash_id("external_unanimity_decision", F.col("key")))
    confidence = F.when(F.col("n") == 1, 0.95).when(F.col("n") > 1, 0.6).otherwise(0.4)
    rows = joined.select(F.col("id").alias("source_id"), target.alias("target_id"), "relation_type", F.col("raw").alias("raw_reference"), confidence.alias("confidence"))
    return rows.where("source_id != target_id").groupBy("source_id", "target_id", "relation_type", "raw_reference").agg(F.max("confidence").alias("confidence"))


def hierarchical_chunks(df: DataFrame, key: str, text: str, longest: int = 4000, overlap: int = 300) -> DataFrame:
    """Articles as chunks, long ones in parts: owner, article, part_index, part_count, text."""
    from .chunks import character_chunks

    found = articles(df, key, text)
    parts = character_chunks(found.select(F.col("id").alias("article"), "text"), "article", "text", longest, overlap)
    owners = found.select(F.col("id").alias("article"), F.col("document_id").alias("owner"))
    return parts.join(owners, "article").select("owner", "article", F.col("chunk_index").alias("part_index"), F.col("chunk_count").alias("part_count"), "text")
