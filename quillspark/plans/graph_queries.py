"""Registered graph queries over concepts and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators import graph as G
from quillspark.plans.registry import register
from quillspark.session import table



def centre(edges: DataFrame) -> str:
    """The node with the most neighbours, the smallest of equals; '' without edges."""
    r = G.undirected(edges).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").first()
    return r.node if r else ""


_UND = "u AS (SELECT from_slug AS node, to_slug AS nb FROM edges UNION SELECT to_slug, from_slug FROM edges)"
_DEG = """d AS (SELECT c.slug, count(e.s) AS degree FROM concepts c LEFT JOIN (SELECT from_slug AS s FROM edges UNION ALL SELECT to_slug FROM edges WHERE to_slug <> from_slug) e ON e.s = c.slug GROUP BY c.slug)"""


def _hops(depth: int) -> str:
    parts = [_UND, f"h0 AS (SELECT node, 0 AS hops FROM u GROUP BY node ORDER BY count(*) DESC, node LIMIT 1)"]
    for i in range(1, depth + 1):
        parts.append(f"h{i} AS (SELECT * FROM h{i - 1} UNION ALL SELECT DISTINCT nb, {i} FROM u JOIN h{i - 1} USING (node) WHERE hops = {i - 1} AND nb NOT IN (SELECT node FROM h{i - 1}))")
    return ", ".join(parts)


@register(f"WITH {_DEG} SELECT slug, degree FROM d ORDER BY degree DESC, slug LIMIT 10")
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(table(spark, d, "concepts"), table(spark, d, "edges")).orderBy(F.desc("degree"), "slug").limit(10)


@register(f"WITH {_UND} SELECT node, count(*) AS neighbours FROM u GROUP BY node")
def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(table(spark, d, "edges")).groupBy("node").agg(F.count("*").alias("neighbours"))


@register("""SELECT (SELECT count(*) FROM concepts) AS nodes, (SELECT count(*) FROM edges) AS edges,
round(CASE WHEN (SELECT count(*) FROM concepts) <= 1 THEN 0 ELSE 2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM concepts) * ((SELECT count(*) FROM concepts) - 1.0)) END, 6) AS density""")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "concepts").agg(F.count("*").alias("nodes"))
    e = table(spark, d, "edges").agg(F.count("*").alias("edges"))
    n = F.col("nodes")
    return v.crossJoin(e).select("nodes", "edges", F.round(F.when(n <= 1, 0.0).otherwise(2.0 * F.col("edges") / F.greatest(n * (n - 1.0), F.lit(1.0))), 6).alias("density"))


@register(f"WITH {_hops(6)} SELECT node, hops FROM h6")
def hops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    return G.hops_from(e, centre(e), 6)


def _paths() -> str:
    parts = [_UND, f"h0 AS (SELECT node, 0 AS hops, node AS path FROM u GROUP BY node ORDER BY count(*) DESC, node LIMIT 1)"]
    for i in range(1, 7):
        parts.append(f"h{i} AS (SELECT * FROM h{i - 1} UNION ALL SELECT nb, {i}, arg_min(path, node) || ' > ' || nb FROM u JOIN h{i - 1} USING (node) WHERE hops = {i - 1} AND nb NOT IN (SELECT node FROM h{i - 1}) GROUP BY nb)")
    return "WITH " + ", ".join(parts) + " SELECT node, hops, path FROM h6"


@register(_paths())
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    return G.shortest_paths(e, centre(e), 6)


@register(f"WITH {_hops(1)} SELECT DISTINCT from_slug, to_slug, relation, weight FROM edges WHERE from_slug IN (SELECT node FROM h1) OR to_slug IN (SELECT node FROM h1)")
def neighbourhood2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select("from_slug", "to_slug", "relation", "weight")
    return G.neighbourhood_edges(e, centre(e), 2)


@register("""WITH RECURSIVE u AS (SELECT from_slug AS a, to_slug AS b FROM edges UNION SELECT to_slug, from_slug FROM edges UNION SELECT slug, slug FROM concepts),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), l AS (SELECT a AS slug, min(b) AS label FROM r GROUP BY a)
SELECT label, count(*) AS size FROM l WHERE slug IN (SELECT slug FROM concepts) GROUP BY label""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Size of every component; isolated concepts are their own."""
    labels = G.component_labels(table(spark, d, "edges").select(F.col("from_slug").alias("src"), F.col("to_slug").alias("dst")))
    c = table(spark, d, "concepts").select("slug").join(labels.withColumnRenamed("node", "slug"), "slug", "left").select("slug", F.coalesce("label", "slug").alias("label"))
    return c.groupBy("label").agg(F.count("*").alias("size"))


def _rank_sql(rounds: int = 10, digits: int = 6) -> str:
    parts = [_UND, "k AS (SELECT node, nb FROM u WHERE node IN (SELECT slug FROM concepts) AND nb IN (SELECT slug FROM concepts))", "o AS (SELECT node, count(*) AS outs FROM k GROUP BY node)", "n AS (SELECT count(DISTINCT slug) AS n FROM concepts)", "s0 AS (SELECT DISTINCT slug, 1.0 / n AS score FROM concepts, n)"]
    for i in range(1, rounds + 1):
        parts.append(f"g{i} AS (SELECT nb AS slug, sum(score / outs) AS got FROM k JOIN o USING (node) JOIN s{i - 1} ON s{i - 1}.slug = node GROUP BY nb), x{i} AS (SELECT coalesce(sum(score), 0) AS d FROM s{i - 1} WHERE slug NOT IN (SELECT node FROM o)), s{i} AS (SELECT s.slug, 0.15 / n + 0.85 * (coalesce(got, 0) + d / n) AS score FROM s{i - 1} s LEFT JOIN g{i} USING (slug), x{i}, n)")
    return "WITH " + ", ".join(parts) + f" SELECT slug, round(score, {digits}) AS score FROM s{rounds}"


@register(_rank_sql())
def pagerank10(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(table(spark, d, "concepts"), table(spark, d, "edges"), rounds=10, tolerance=None).select("slug", F.round("score", 6).alias("score"))


@register("WITH r AS (" + _rank_sql(60, 9) + ") SELECT slug, round(score, 5) AS score FROM r")
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """Until the change is below 1e-6; by SQL in many more rounds than that takes."""
    return G.pagerank(table(spark, d, "concepts"), table(spark, d, "edges")).select("slug", F.round("score", 5).alias("score"))


def _lpa_sql(rounds: int = 5) -> str:
    parts = [_UND, "k AS (SELECT node, nb FROM u WHERE node <> nb AND node IN (SELECT slug FROM concepts) AND nb IN (SELECT slug FROM concepts))", "l0 AS (SELECT DISTINCT slug, slug AS label FROM concepts)"]
    for i in range(1, rounds + 1):
        parts.append(f"v{i} AS (SELECT node, label, count(*) AS n FROM k JOIN l{i - 1} ON slug = nb GROUP BY ALL), b{i} AS (SELECT v.node, v.label FROM v{i} v JOIN l{i - 1} o ON o.slug = v.node QUALIFY row_number() OVER (PARTITION BY v.node ORDER BY n DESC, v.label <> o.label, v.label) = 1), l{i} AS (SELECT slug, coalesce(b.label, l.label) AS label FROM l{i - 1} l LEFT JOIN b{i} b ON b.node = slug)")
    return "WITH " + ", ".join(parts) + f" SELECT slug, label FROM l{rounds}"


@register(_lpa_sql())
def communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(table(spark, d, "concepts"), table(spark, d, "edges"), 5)


@register("""SELECT DISTINCT e.from_slug, e.to_slug, e.relation, e.weight, a.scope_key AS from_scope, b.scope_key AS to_scope FROM edges e JOIN concepts a ON a.slug = from_slug JOIN concepts b ON b.slug = to_slug WHERE a.scope_key <> b.scope_key""")
def cross_scope_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends lie in different groups; the groups are the scopes."""
    c, e = table(spark, d, "concepts"), table(spark, d, "edges").select("from_slug", "to_slug", "relation", "weight")
    return e.join(c.select(F.col("slug").alias("from_slug"), F.col("scope_key").alias("from_scope")), "from_slug").join(c.select(F.col("slug").alias("to_slug"), F.col("scope_key").alias("to_scope")), "to_slug").where("from_scope <> to_scope").distinct()


@register("""SELECT slug, name, (SELECT count(*) FROM edges WHERE from_slug = slug) AS out_edges, (SELECT count(*) FROM edges WHERE to_slug = slug) AS in_edges,
(SELECT count(DISTINCT source_id) FROM edges WHERE from_slug = slug OR to_slug = slug) AS sources FROM concepts""")
def concept_detail(spark: SparkSession, d: str) -> DataFrame:
    c, e = table(spark, d, "concepts"), table(spark, d, "edges")
    o = e.groupBy(F.col("from_slug").alias("slug")).agg(F.count("*").alias("out_edges"))
    i = e.groupBy(F.col("to_slug").alias("slug")).agg(F.count("*").alias("in_edges"))
    s = e.select(F.explode(F.array("from_slug", "to_slug")).alias("slug"), "source_id").groupBy("slug").agg(F.countDistinct("source_id").alias("sources"))
    z = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return c.select("slug", "name").join(o, "slug", "left").join(i, "slug", "left").join(s, "slug", "left").select("slug", "name", z("out_edges"), z("in_edges"), z("sources"))


@register("""WITH o AS (SELECT from_slug AS slug, string_agg(relation || ':' || to_slug, ' ' ORDER BY weight DESC, relation || ':' || to_slug) AS out_edges FROM edges GROUP BY 1), i AS (SELECT to_slug AS slug, string_agg(relation || ':' || from_slug, ' ' ORDER BY weight DESC, relation || ':' || from_slug) AS in_edges FROM edges GROUP BY 1),
l AS (SELECT from_slug AS slug, source_id, max(weight) AS w FROM edges WHERE source_id IS NOT NULL GROUP BY ALL), s AS (SELECT slug, string_agg(source_id, ' ' ORDER BY w DESC, source_id) AS sources FROM l GROUP BY 1)
SELECT c.slug, coalesce(out_edges, '') AS out_edges, coalesce(in_edges, '') AS in_edges, coalesce(sources, '') AS sources FROM concepts c LEFT JOIN o USING (slug) LEFT JOIN i USING (slug) LEFT JOIN s USING (slug)""")
def concept_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every concept with its edges out and in by falling weight, and its sources by relevance, as lists."""
    e = table(spark, d, "edges")

    def listed(df: DataFrame, key: str, item, name: str) -> DataFrame:
        x = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), item.alias("x"))))
        return df.groupBy(F.col(key).alias("slug")).agg(F.array_join(F.transform(x, lambda y: y["x"]), " ").alias(name))

    s = e.where("source_id is not null").groupBy("from_slug", "source_id").agg(F.max("weight").alias("weight"))
    out = table(spark, d, "concepts").select("slug")
    for df in (listed(e, "from_slug", F.concat_ws(":", "relation", "to_slug"), "out_edges"), listed(e, "to_slug", F.concat_ws(":", "relation", "from_slug"), "in_edges"), listed(s, "from_slug", F.col("source_id"), "sources")):
        out = out.join(df, "slug", "left")
    return out.select("slug", *[F.coalesce(c, F.lit("")).alias(c) for c in ("out_edges", "in_edges", "sources")])


@register("SELECT from_slug, to_slug, relation, weight, source_id FROM edges ORDER BY weight DESC, from_slug, to_slug, relation, source_id LIMIT 50")
def edge_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").orderBy(F.desc("weight"), "from_slug", "to_slug", "relation", F.asc_nulls_last("source_id")).limit(50)
