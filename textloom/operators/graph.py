"""Graphs as edge tables: bounded expansion, hierarchies, propagation to a fixpoint, adjacency, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Relation types along which evidence may be expanded.
ALLOWED = (
    "ADJACENT_DECISION", "AFFIRMS_DECISION", "AMENDS", "ANSWERED_BY", "APPLIES", "CITES_DECISION", "CONTAINS", "DISTINGUISHES_DECISION",
    "HAS_ANSWER", "IMPLEMENTS", "INTERPRETS_AMENDMENT", "ISSUED_BY", "LINKS_TO", "LISTS", "NEXT_DECISION", "OVERRULES_DECISION",
    "PREVIOUS_DECISION", "REFERENCES", "REPEALS", "REPEALS_OR_DISAPPLIES", "TAGGED_WITH",
)
MOST_SEEDS, MOST_DEPTH, MOST_ROWS = 50, 3, 100


def clamp(value: int, most: int) -> int:
    return max(1, min(int(value), most))


def seed_ids(ids: list[str]) -> list[str]:
    """Trimmed ids without repetition: the first fifty, of which blank ones are then dropped."""
    return [x for x in list(dict.fromkeys(i.strip() for i in ids))[:MOST_SEEDS] if x]


def both_ways(edges: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Each allowed edge from both of its ends: a, b, relation_type, edge (its identity). A loop appears once."""
    e = edges.where(F.col("relation_type").isin(*allowed)).select(
        "source_id", "target_id", "relation_type", F.xxhash64("source_id", "target_id", "relation_type", F.coalesce("raw_reference", F.lit(""))).alias("edge")
    ).distinct()
    there = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation_type", "edge")
    back = e.where("source_id != target_id").select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "relation_type", "edge")
    return there.unionByName(back)


def expand(seeds: DataFrame, edges: DataFrame, depth: int, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(seed, neighbor, hops, relation_types): the fewest edges of a trail between them, and its smallest list of types.

    Trails use no edge twice. A shortest walk to another node never does, so each level keeps one row per seed and
    neighbor, however many paths meet in a hub; only ways back to the seed itself are looked up edge by edge.
    """
    depth = clamp(depth, MOST_DEPTH)
    adjacent = both_ways(edges, allowed)
    seeds = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    level = seeds.select("seed", F.col("seed").alias("node"), F.array().cast("array<string>").alias("path"))
    known = level.select("seed", "node")
    found: DataFrame | None = None
    for hops in range(1, depth + 1):
        step = level.join(adjacent, level["node"] == adjacent["a"]).select("seed", F.col("b").alias("node"), F.array_append("path", F.col("relation_type")).alias("path"))
        level = step.join(known, ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
        level = written(level, "level")
        known = known.unionByName(level.select("seed", "node"))
        part = level.withColumn("hops", F.lit(hops))
        found = part if found is None else found.unionByName(part)
    back = _returns(seeds, adjacent, depth)
    out = found.unionByName(back.select("seed", F.col("seed").alias("node"), "path", "hops"))
    return out.select("seed", F.col("node").alias("neighbor"), "hops", F.col("path").alias("relation_types"))


def _returns(seeds: DataFrame, adjacent: DataFrame, depth: int) -> DataFrame:
    """Ways from a seed back to it: a loop, two parallel edges, a triangle."""
    own = adjacent.join(seeds.withColumnRenamed("seed", "a"), "a", "left_semi")
    loops = own.where("a = b").select(F.col("a").alias("seed"), F.array("relation_type").alias("path"), F.lit(1).alias("hops"))
    ways = loops
    first = own.where("a != b").select(F.col("a").alias("seed"), F.col("b").alias("u"), F.col("relation_type").alias("t1"), F.col("edge").alias("e1"))
    last = own.where("a != b").select(F.col("a").alias("seed"), F.col("b").alias("w"), F.col("relation_type").alias("t3"), F.col("edge").alias("e3"))
    if depth >= 2:
        two = first.join(last.withColumnRenamed("w", "u"), ["seed", "u"]).where("e1 != e3")
        ways = ways.unionByName(two.select("seed", F.array("t1", "t3").alias("path"), F.lit(2).alias("hops")))
    if depth >= 3:
        # a triangle closes between two neighbours of a seed: only edges between such nodes take part
        near = last.select(F.col("w").alias("b")).distinct()
        middle = adjacent.where("a != b").join(near.withColumnRenamed("b", "a"), "a", "left_semi").join(near, "b", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("w"), F.col("relation_type").alias("t2"), F.col("edge").alias("e2"))
        three = first.join(middle, "u").where((F.col("w") != F.col("seed")) & (F.col("e1") != F.col("e2"))).join(last, ["seed", "w"])
        three = three.where((F.col("e3") != F.col("e2")) & (F.col("e3") != F.col("e1")))
        ways = ways.unionByName(three.select("seed", F.array("t1", "t2", "t3").alias("path"), F.lit(3).alias("hops")))
    return ways.groupBy("seed").agg(F.min(F.struct("hops", "path")).alias("m")).select("seed", "m.hops", "m.path")


def evidence(neighbors: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The nearest ``limit`` neighbours, then those of them that have text: the order of the two is part of the feature."""
    one = neighbors.groupBy("neighbor").agg(F.min(F.struct("hops", "relation_types")).alias("m")).select("neighbor", "m.hops", "m.relation_types")
    top = one.join(nodes, one["neighbor"] == nodes["id"]).orderBy("hops", "neighbor").limit(clamp(limit, MOST_ROWS))
    return top.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def hierarchy(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, node, depth) of every CONTAINS path of 1 … depth edges, each node once at its least depth."""
    e = edges.where("relation_type = 'CONTAINS' AND source_id != target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    roots = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    level, out = roots.select("root", F.col("root").alias("node")), None
    for d in range(1, depth + 1):
        level = level.join(e, level["node"] == e["a"]).select("root", F.col("b").alias("node")).distinct()
        part = level.withColumn("depth", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, category): the category of each node, filled from the parents that contain it until nothing changes.

    A parent that is a category gives its title and is preferred; among equals the smallest value wins. Each round is
    written, so the plan stays short and a lost executor repeats one round at most.
    """
    links = edges.where("relation_type = 'CONTAINS'").select(F.col("source_id").alias("parent"), F.col("target_id").alias("id")).distinct()
    state = nodes.select("id", "category", F.when(F.col("type") == "category", F.col("title")).alias("own"))
    state = written(state, "categories")
    while True:
        giving = state.where("own IS NOT NULL OR category IS NOT NULL").select(
            F.col("id").alias("parent"), F.struct(F.when(F.col("own").isNotNull(), 0).otherwise(1).alias("rank"), F.coalesce("own", "category").alias("value")).alias("given")
        )
        missing = state.where("category IS NULL").select("id")
        fills = links.join(missing, "id", "left_semi").join(giving, "parent").groupBy("id").agg(F.min("given").alias("g")).select("id", F.col("g.value").alias("filled"))
        fills = written(fills, "fills")
        if not fills.head(1):
            break
        state = written(state.join(fills, "id", "left").select("id", F.coalesce("category", "filled").alias("category"), "own"), "categories")
    return state.select("id", "category")


def propagate_years(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, year) of the decisions; a missing year is the smallest of the years that contain the decision."""
    years = nodes.where("type = 'year' AND year IS NOT NULL").select(F.col("id").alias("source_id"), F.col("year").alias("given"))
    given = edges.where("relation_type = 'CONTAINS'").join(years, "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("given").alias("given"))
    return nodes.where("type = 'decision'").join(given, "id", "left").select("id", F.coalesce("year", "given").alias("year"))


def adjacency(nodes: DataFrame, edges: DataFrame, relation: str = "ADJACENT_DECISION") -> DataFrame:
    """PREVIOUS_DECISION and NEXT_DECISION edges where adjacent decisions have neighbouring plain numbers."""
    numbers = nodes.where((F.col("type") == "decision") & F.col("decision_number").rlike("^[0-9]+$")).select("id", F.col("decision_number").cast("long").alias("n"))
    s = numbers.select(F.col("id").alias("source_id"), F.col("n").alias("s"))
    t = numbers.select(F.col("id").alias("target_id"), F.col("n").alias("t"))
    pairs = edges.where(F.col("relation_type") == relation).join(s, "source_id").join(t, "target_id").where(F.abs(F.col("t") - F.col("s")) == 1)
    kind = F.when(F.col("t") < F.col("s"), "PREVIOUS_DECISION").otherwise("NEXT_DECISION")
    return pairs.select("source_id", "target_id", kind.alias("relation_type"), F.lit(0.95).alias("confidence"))


def frontier(links: DataFrame, seeds: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(page, depth): breadth-first reach over a link table (a, b) until nothing new is found, or, if asked, until there are
    ``most_pages``, in the order of depth and page. Each page comes once; pages seen before are left out."""
    seen = level = written(seeds.select(F.col(seeds.columns[0]).alias("page")).distinct().withColumn("depth", F.lit(0)), "frontier")
    depth = 0
    while level.head(1) and (most_pages is None or seen.count() < most_pages):
        depth += 1
        step = level.join(links, level["page"] == links["a"]).select(F.col("b").alias("page")).where("page IS NOT NULL").distinct()
        level = written(step.join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(level)
        if depth % 16 == 0:
            seen = written(seen, "seen")  # keeps the plan short on long chains
    return seen if most_pages is None else seen.orderBy("depth", "page").limit(most_pages)


def structure(links: DataFrame) -> DataFrame:
    """Structural edges of a link table (page, page_type, target, target_type): LINKS_TO always; CONTAINS by types; LISTS
    from an index; ADJACENT_DECISION between two decisions."""
    links = links.where("page != target")
    edge = lambda when, kind, confidence: links.where(when).select(F.col("page").alias("source_id"), F.col("target").alias("target_id"), F.lit(kind).alias("relation_type"), F.lit(confidence).alias("confidence"))
    inside = "(page_type = 'category' AND target_type IN ('law_group', 'document')) OR (page_type = 'law_group' AND target_type = 'document')"
    edges = edge("true", "LINKS_TO", 0.7).unionByName(edge(inside, "CONTAINS", 1.0)).unionByName(edge("page_type = 'index'", "LISTS", 0.95))
    edges = edges.unionByName(edge("page_type = 'decision' AND target_type = 'decision'", "ADJACENT_DECISION", 0.75))
    return edges.groupBy("source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence"))


def breadcrumb_edges(chains: DataFrame, key: str, chain: str) -> DataFrame:
    """CONTAINS edges of consecutive members of a chain, without self edges."""
    pairs = F.arrays_zip(F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0))).alias("a"), F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))).alias("b"))
    rows = chains.where(F.size(chain) > 1).select(F.posexplode(pairs).alias("position", "p"), F.col(key))
    return rows.select(key, "position", F.col("p.a").alias("source_id"), F.col("p.b").alias("target_id")).where("source_id != target_id")
