"""One question, one of four plans: a concept, a path, a neighbourhood or ranked chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from quillspark.operators import graph, retrieval


def intent_of(question: str, patterns: list[tuple[str, str]]) -> str:
    """The label of the first pattern that is found, else hybrid_search; patterns that don't compile are passed over."""
    for label, rx in patterns:
        try:
            if re.search(rx, question, re.I):
                return label
        except re.error:
            continue
    return "hybrid_search"


def to_slug(text: str) -> str:
    return re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", text.strip().lower().replace("'", "")))[:100]


#: How the two ends of a path are named, tried in order.
PATHS = (r"(?:path from|from)\s+(.+?)\s+to\s+(.+)", r"(?:between|connect(?:s|ing)?)\s+(.+?)\s+and\s+(.+)", r"how (?:does|do|is)\s+(.+?)\s+(?:connect|relate|link) to\s+(.+)")


def path_ends(question: str) -> tuple[str, str] | None:
    """Slugs of the two ends of a question about a path."""
    for rx in PATHS:
        m = re.search(rx, question, re.I)
        if m:
            return to_slug(m[1]), to_slug(m[2])
    return None


def labelled(questions: DataFrame, patterns: list[tuple[str, str]], fallback: str = "hybrid_search") -> DataFrame:
    """questions(query_id, text) with `intent`, the label of the first of the patterns (label, regular expression) that is found. The patterns
    are an argument, learned ones before the built-in ones; one that doesn't compile is passed over."""
    c = F.lit(fallback)
    for label, rx in reversed(patterns):
        try:
            re.compile(rx)
        except re.error:
            continue
        c = F.when(F.col("text").rlike(f"(?i){rx}"), label).otherwise(c)
    return questions.withColumn("intent", c)


def learned_first(patterns: DataFrame, built_in: list[tuple[str, str]], most: int = 1000) -> list[tuple[str, str]]:
    """Learned patterns(label, pattern, confidence, match_count), at most `most`, by confidence and matches, before the built-in ones."""
    rows = patterns.orderBy(F.desc("confidence"), F.desc("match_count"), "pattern").limit(most).select("label", "pattern").collect()
    return [(r.label, r.pattern) for r in rows] + built_in


def route_all(questions: DataFrame, patterns: list[tuple[str, str]], concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, intent, route, subject, target): for each of questions(query_id, text) the plan that answers it: a known concept, a path, a
    neighbourhood, or ranked chunks where a concept isn't known or a path's ends can't be made out."""
    slug = lambda c: F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "'", ""), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 100)
    named = F.regexp_replace(F.regexp_replace("text", r"(?i)^(who|what) is\s+", ""), r"(?i)^(tell me about|explain|describe)\s+", "")
    near = F.regexp_replace("text", r"(?i)^.*?(related to|neighbors of|connected to)\s+", "")
    end = lambda i: F.coalesce(*[F.when(F.col("text").rlike(f"(?i){rx}"), slug(F.regexp_extract("text", f"(?i){rx}", i))) for rx in PATHS])
    q = labelled(questions, patterns)
    q = q.withColumn("subject", F.when(F.col("intent") == "entity_lookup", slug(named)).when(F.col("intent") == "graph_path", end(1)).when(F.col("intent") == "neighborhood", slug(F.regexp_replace(near, r"[?.!]+$", ""))))
    q = q.withColumn("target", F.when(F.col("intent") == "graph_path", end(2)))
    j = q.join(concepts.select(F.col("slug").alias("subject"), F.lit(True).alias("known")).distinct(), "subject", "left")
    route = F.when((F.col("intent") == "entity_lookup") & F.col("known"), "concept").when((F.col("intent") == "graph_path") & F.col("target").isNotNull(), "path").when(F.col("intent") == "neighborhood", "neighborhood").otherwise("hybrid_search")
    return j.select("query_id", "intent", route.alias("route"), "subject", "target")


def route(question: str, patterns: list[tuple[str, str]], concepts: DataFrame, edges: DataFrame, chunks: DataFrame, limit: int = 10) -> tuple[str, DataFrame]:
    """(route taken, result). A concept or path that can't be made out falls through to ranked chunks; a neighbourhood never does."""
    kind = intent_of(question, patterns)
    subject = to_slug(re.sub(r"(?i)^(?:(?:who|what) is|tell me about|explain|describe|.*?(?:related to|neighbors of|connected to))\s+", "", question))
    if kind == "entity_lookup":
        hit = concepts.where(F.col("slug") == subject)
        if not hit.isEmpty():
            return kind, hit
    elif kind == "graph_path":
        ends = path_ends(question)
        if ends:
            return kind, graph.shortest_paths(edges, ends[0], 6).where(F.col("node") == ends[1])
    elif kind == "neighborhood":
        return kind, graph.hops_from(edges, subject, 2)
    q = concepts.sparkSession.createDataFrame([(0, question)], "query_id long, text string")
    return "hybrid_search", retrieval.hybrid(chunks, q, limit)
