"""Registered queries of reports, profiles, routing, reviews and the exchange of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.operators import graph as G, router, sync, telemetry
from quillspark.plans.graph_queries import _DEG, _UND, _lpa_sql, _rank_sql, centre
from quillspark.plans.registry import register
from quillspark.plans.table_queries import INTENTS
from quillspark.session import table

_LOG = "log AS (SELECT DISTINCT * FROM query_log)"
_COMM = f"com AS ({_lpa_sql()}), cn AS (SELECT label, count(*) AS size FROM com GROUP BY 1), ci AS (SELECT label, size, row_number() OVER (ORDER BY size DESC, label) - 1 AS community FROM cn), pl AS (SELECT slug, community, size FROM com JOIN ci USING (label))"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return G.community_ids(G.communities(table(spark, d, "concepts"), table(spark, d, "edges"), 5))


@register(f"WITH {_COMM} SELECT pl.slug, community, size, mention_count, coalesce(compiled_truth, summary) AS truth FROM pl JOIN concepts USING (slug)")
def community_detail(spark: SparkSession, d: str) -> DataFrame:
    """Members of every community with their truth and mentions."""
    c = table(spark, d, "concepts").select("slug", "mention_count", F.coalesce("compiled_truth", "summary").alias("truth"))
    return _placed(spark, d).join(c, "slug").select("slug", "community", "size", "mention_count", "truth")


@register(f"WITH {_COMM} SELECT from_slug, to_slug, relation, a.community AS from_community, b.community AS to_community, max(weight) AS weight FROM edges JOIN pl a ON a.slug = from_slug JOIN pl b ON b.slug = to_slug WHERE a.community <> b.community GROUP BY ALL")
def cross_community(spark: SparkSession, d: str) -> DataFrame:
    return G.cross_community(table(spark, d, "edges"), _placed(spark, d)).select("from_slug", "to_slug", "relation", "from_community", "to_community", "weight")


@register(f"WITH rk AS ({_rank_sql()}), top AS (SELECT slug FROM rk ORDER BY score DESC, slug LIMIT 50) SELECT 'node' AS part, slug AS a, '' AS b FROM top UNION SELECT 'edge', from_slug, to_slug FROM edges WHERE from_slug IN (SELECT slug FROM top) AND to_slug IN (SELECT slug FROM top)")
def graph_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The 50 concepts of the highest rank and the edges between them."""
    c, e = table(spark, d, "concepts"), table(spark, d, "edges")
    ranks = G.pagerank(c, e, rounds=10, tolerance=None).withColumn("score", F.round("score", 6))
    n, x = G.snapshot(c.select("slug"), e, ranks, 50)
    return n.select(F.lit("node").alias("part"), F.col("slug").alias("a"), F.lit("").alias("b")).unionByName(x.select(F.lit("edge").alias("part"), F.col("from_slug").alias("a"), F.col("to_slug").alias("b"))).distinct()


_SIZES = "(SELECT count(*) FROM concepts) AS nodes, (SELECT count(*) FROM edges) AS edges"


@register(f"""WITH {_COMM}, {_DEG}, g AS (SELECT slug, degree, row_number() OVER (ORDER BY degree DESC, slug) AS n FROM d), rk AS ({_rank_sql()}), r AS (SELECT slug, score, row_number() OVER (ORDER BY score DESC, slug) AS n FROM rk),
x AS (SELECT from_slug, to_slug, relation, max(weight) AS weight FROM edges JOIN pl a ON a.slug = from_slug JOIN pl b ON b.slug = to_slug WHERE a.community <> b.community GROUP BY ALL), xs AS (SELECT *, row_number() OVER (ORDER BY weight DESC, from_slug, to_slug, relation) AS n FROM x)
SELECT 1 AS section, 1 AS place, '- ' || nodes || ' concepts, ' || edges || ' edges, ' || (SELECT count(*) FROM ci) || ' communities' AS line FROM (SELECT {_SIZES})
UNION ALL SELECT 2, n, n || '. ' || slug || ' (' || degree || ')' FROM g WHERE n <= 10 UNION ALL SELECT 3, n, n || '. ' || slug FROM r WHERE n <= 10
UNION ALL SELECT 4, community + 1, '- ' || community || ': ' || label || ' (' || size || ')' FROM ci WHERE community < 15 UNION ALL SELECT 5, n, '- ' || from_slug || ' > ' || to_slug || ' (' || relation || ')' FROM xs WHERE n <= 10""")
def graph_report(spark: SparkSession, d: str) -> DataFrame:
    """(section, place, line): overview, ten nodes by degree and by rank, fifteen communities, ten edges between communities."""
    c, e = table(spark, d, "concepts"), table(spark, d, "edges")
    labels = G.communities(c, e, 5)
    placed = G.community_ids(labels)
    kinds = labels.groupBy("label").agg(F.count("*").alias("size"))
    num = lambda *by: F.row_number().over(W.orderBy(*by))
    line = lambda n, place, text: (F.lit(n).alias("section"), place.cast("long").alias("place"), text.alias("line"))
    s = lambda x: F.col(x).cast("string")
    counts = c.agg(F.count("*").alias("v")).crossJoin(e.agg(F.count("*").alias("w"))).crossJoin(kinds.agg(F.count("*").alias("k")))  # one row each
    out = counts.select(*line(1, F.lit(1), F.concat(F.lit("- "), s("v"), F.lit(" concepts, "), s("w"), F.lit(" edges, "), s("k"), F.lit(" communities"))))
    deg = G.degrees(c, e).orderBy(F.desc("degree"), "slug").limit(10).withColumn("n", num(F.desc("degree"), "slug"))
    out = out.unionByName(deg.select(*line(2, F.col("n"), F.concat(s("n"), F.lit(". "), F.col("slug"), F.lit(" ("), s("degree"), F.lit(")")))))
    rank = G.pagerank(c, e, rounds=10, tolerance=None).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "slug").limit(10).withColumn("n", num(F.desc("score"), "slug"))
    out = out.unionByName(rank.select(*line(3, F.col("n"), F.concat(s("n"), F.lit(". "), F.col("slug")))))
    big = kinds.orderBy(F.desc("size"), "label").limit(15).withColumn("n", num(F.desc("size"), "label"))
    out = out.unionByName(big.select(*line(4, F.col("n"), F.concat(F.lit("- "), (F.col("n") - 1).cast("string"), F.lit(": "), F.col("label"), F.lit(" ("), s("size"), F.lit(")")))))
    by = (F.desc("weight"), "from_slug", "to_slug", "relation")
    x = G.cross_community(e, placed).orderBy(*by).limit(10).withColumn("n", num(*by))
    return out.unionByName(x.select(*line(5, F.col("n"), F.concat(F.lit("- "), F.col("from_slug"), F.lit(" > "), F.col("to_slug"), F.lit(" ("), F.col("relation"), F.lit(")")))))


@register(f"""WITH RECURSIVE {_UND}, uu AS (SELECT node AS a, nb AS b FROM u UNION SELECT slug, slug FROM concepts), rr AS (SELECT a, b FROM uu UNION SELECT rr.a, uu.b FROM rr JOIN uu ON uu.a = rr.b), cl AS (SELECT a AS slug, min(b) AS label FROM rr GROUP BY a), cs AS (SELECT label, count(*) AS size FROM cl WHERE slug IN (SELECT slug FROM concepts) GROUP BY 1), {_COMM}
SELECT (SELECT count(*) FROM cs) AS components, (SELECT max(size) FROM cs) AS largest, (SELECT count(*) FROM ci) AS communities""")
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    c, e = table(spark, d, "concepts"), table(spark, d, "edges")
    labels = G.component_labels(e.select(F.col("from_slug").alias("src"), F.col("to_slug").alias("dst")))
    sizes = c.select("slug").join(labels.withColumnRenamed("node", "slug"), "slug", "left").groupBy(F.coalesce("label", "slug").alias("l")).agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest")).crossJoin(G.communities(c, e, 5).agg(F.countDistinct("label").alias("communities")))  # one row each


@register("""WITH u AS (SELECT from_slug AS node, to_slug AS nb FROM edges UNION SELECT to_slug, from_slug FROM edges), h0 AS (SELECT node FROM u GROUP BY node ORDER BY count(*) DESC, node LIMIT 1), h1 AS (SELECT node FROM h0 UNION SELECT nb FROM u JOIN h0 USING (node))
SELECT h1.node AS slug, from_slug, to_slug, relation FROM h1 JOIN edges ON from_slug = h1.node UNION ALL SELECT h1.node, from_slug, to_slug, relation FROM h1 JOIN edges ON to_slug = h1.node WHERE from_slug <> to_slug""")
def neighbourhood_touched(spark: SparkSession, d: str) -> DataFrame:
    """Every edge from each of its ends within the neighbourhood, so an inner edge comes twice."""
    e = table(spark, d, "edges")
    return G.touched_edges(e, centre(e), 2).select("slug", "from_slug", "to_slug", "relation")


def _steps() -> str:
    from quillspark.plans.graph_queries import _paths

    return _paths().rpartition(" SELECT node, hops, path FROM h6")[0]


@register(f"""{_steps()}, sp AS (SELECT node, string_split(path, ' > ') AS p FROM h6 WHERE hops > 0), st AS (SELECT node, unnest(range(1, len(p))) AS i, p FROM sp), ab AS (SELECT node, i - 1 AS step, p[i] AS a, p[i + 1] AS b FROM st),
f AS (SELECT from_slug, to_slug, min(relation) AS relation FROM edges GROUP BY ALL)
SELECT node, step, CASE WHEN t.relation IS NOT NULL THEN a ELSE b END AS from_slug, CASE WHEN t.relation IS NOT NULL THEN b ELSE a END AS to_slug, coalesce(t.relation, k.relation) AS relation FROM ab LEFT JOIN f t ON t.from_slug = a AND t.to_slug = b LEFT JOIN f k ON k.from_slug = b AND k.to_slug = a""")
def path_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges along every shortest path from the centre."""
    e = table(spark, d, "edges")
    p = G.path_edges(e, G.shortest_paths(e, centre(e), 6))
    return p.select("node", F.col("step").cast("long").alias("step"), "from_slug", "to_slug", "relation")


_ASKED = "SELECT DISTINCT query_text AS text FROM query_log WHERE query_text IS NOT NULL UNION SELECT 'What is ' || name FROM concepts UNION SELECT 'path from ' || from_slug || ' to ' || to_slug FROM edges UNION SELECT 'what is connected to ' || name || '?' FROM concepts"
_LEARNED = (("neighborhood", r"^what is connected to", 0.9), ("broken", "(", 1.0))
_CASES = [(n, rx) for n, rx, _ in _LEARNED if n != "broken"] + list(INTENTS)
_SLUG = "substr(regexp_replace(regexp_replace(replace(lower({0}), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 100)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    c, e = table(spark, d, "concepts"), table(spark, d, "edges")
    q = table(spark, d, "query_log").where("query_text is not null").select(F.col("query_text").alias("text"))
    q = q.union(c.select(F.concat(F.lit("What is "), "name"))).union(e.select(F.concat(F.lit("path from "), "from_slug", F.lit(" to "), "to_slug"))).union(c.select(F.concat(F.lit("what is connected to "), "name", F.lit("?"))))
    return q.distinct().withColumn("query_id", F.xxhash64("text"))


def _patterns(spark: SparkSession) -> list[tuple[str, str]]:
    learned = spark.createDataFrame([(a, b, c, 1) for a, b, c in _LEARNED], "label string, pattern string, confidence double, match_count long")
    return router.learned_first(learned, list(INTENTS))


@register(f"""WITH q AS ({_ASKED}), i AS (SELECT text, CASE {' '.join(f"WHEN regexp_matches(text, '(?i){rx}') THEN '{n}'" for n, rx in _CASES)} ELSE 'hybrid_search' END AS intent FROM q),
s AS (SELECT text, intent, CASE intent WHEN 'entity_lookup' THEN {_SLUG.format("trim(regexp_replace(regexp_replace(text, '(?i)^(who|what) is\\s+', ''), '(?i)^(tell me about|explain|describe)\\s+', ''))")} WHEN 'graph_path' THEN {_SLUG.format("regexp_extract(text, '(?i)(?:path from|from)\\s+(.+?)\\s+to\\s+(.+)', 1)")}
 WHEN 'neighborhood' THEN {_SLUG.format("regexp_replace(regexp_replace(text, '(?i)^.*?(related to|neighbors of|connected to)\\s+', ''), '[?.!]+$', '')")} END AS subject, CASE intent WHEN 'graph_path' THEN {_SLUG.format("regexp_extract(text, '(?i)(?:path from|from)\\s+(.+?)\\s+to\\s+(.+)', 2)")} END AS target FROM i)
SELECT text, intent, CASE WHEN intent = 'entity_lookup' AND subject IN (SELECT slug FROM concepts) THEN 'concept' WHEN intent = 'graph_path' THEN 'path' WHEN intent = 'neighborhood' THEN 'neighborhood' ELSE 'hybrid_search' END AS route, subject, target FROM s""")
def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Calls and made-up questions, each with the plan that answers it; learned patterns come first, a broken one is passed over."""
    q = asked(spark, d)
    return router.route_all(q, _patterns(spark), table(spark, d, "concepts"), table(spark, d, "edges")).join(q, "query_id").select("text", "intent", "route", "subject", "target")


@register(f"""WITH q AS ({_ASKED}), i AS (SELECT CASE {' '.join(f"WHEN regexp_matches(text, '(?i){rx}') THEN '{n}'" for n, rx in _CASES)} ELSE 'hybrid_search' END AS intent FROM q), a AS (SELECT count(*) FILTER (intent <> 'hybrid_search') AS hits, count(*) FILTER (intent = 'hybrid_search') AS fallbacks FROM i)
SELECT hits, fallbacks, CAST(floor(100 * hits / (hits + fallbacks) + 0.5) AS BIGINT) AS share FROM a""")
def classifier_stats(spark: SparkSession, d: str) -> DataFrame:
    n = router.labelled(asked(spark, d), _patterns(spark)).groupBy(F.col("intent").alias("label")).agg(F.count("*").alias("n"))
    return telemetry.classifier_stats(n, "hybrid_search")


@register(f"WITH {_LOG} SELECT lower(tool_name) AS label, query_text AS input, count(*) AS n FROM log WHERE query_text IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, label, input LIMIT 20")
def frequent_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Calls stand in for the log of fallbacks."""
    q = telemetry.calls(table(spark, d, "query_log")).where("query_text is not null").select(F.lower("tool_name").alias("label"), F.col("query_text").alias("input"))
    return telemetry.frequent_fallbacks(q)


_SAVE = "count(*) AS sessions, CAST(coalesce(sum(CASE WHEN h = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS hit, coalesce(avg(CASE WHEN h <> 1 THEN t END), 0) AS b, coalesce(avg(CASE WHEN h = 1 THEN t END), 0) AS a"
_RATE, _SAVED = "CASE WHEN sessions = 0 THEN 0.0 ELSE round(hit / sessions, 6) END", "CAST(floor(greatest(b - a, 0) * hit + 0.5) AS BIGINT)"


@register(f"""WITH {_LOG}, s AS (SELECT session_id, max(skill_hit) AS h, sum(tokens_spent) AS t, max(scope_kind) AS kind, max(scope_key) AS key FROM log WHERE session_id IS NOT NULL GROUP BY 1), g AS (SELECT {_SAVE} FROM s), p AS (SELECT kind, key, {_SAVE} FROM s WHERE kind IS NOT NULL AND key IS NOT NULL GROUP BY 1, 2),
o AS (SELECT kind, key, sessions, {_RATE} AS r, {_SAVED} AS v FROM p), t AS (SELECT sessions, {_RATE} AS r, {_SAVED} AS v, CAST(floor(b + 0.5) AS BIGINT) AS b, CAST(floor(a + 0.5) AS BIGINT) AS a FROM g)
SELECT c.kind, c.key, coalesce(o.sessions, t.sessions) AS sessions, t.a AS with_skill, t.b AS without_skill, coalesce(o.v, t.v) AS saved, coalesce(o.r, t.r) AS hit_rate FROM (SELECT DISTINCT kind, key FROM scopes UNION SELECT 'codebase', 'unknown') c LEFT JOIN o USING (kind, key), t""")
def budget_hints(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scopes").select("kind", "key").union(spark.createDataFrame([("codebase", "unknown")], "kind string, key string"))
    return telemetry.budget_hints(table(spark, d, "query_log"), s)


@register(f"""WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id, tool_name) AS line_no FROM log WHERE session_id IS NOT NULL)
SELECT session_id, line_no, line_no || '. ' || tool_name || ' "' || CASE WHEN length(query_text) > 120 THEN substr(query_text, 1, 117) || '...' ELSE coalesce(query_text, '') END || '"' || CASE WHEN skill_hit = 1 THEN ' (skill_hit)' ELSE '' END || coalesce(' ' || tokens_spent || 't', '') AS line FROM n""")
def session_lines(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.session_lines(table(spark, d, "query_log")).withColumn("line_no", F.col("line_no").cast("long"))


@register(f"""WITH {_LOG}, s AS (SELECT session_id, count(*) AS calls, max(CASE WHEN lower(tool_name) IN {telemetry.WRITE_TOOLS} THEN 1 ELSE 0 END) AS writes, min(query_text) AS task, count(DISTINCT tool_name) AS steps FROM log WHERE session_id IS NOT NULL GROUP BY 1)
SELECT session_id, CASE WHEN calls < 3 THEN 'too_short' WHEN writes = 0 THEN 'read_only' WHEN calls % 5 = 0 THEN 'empty' WHEN coalesce(task, '') = '' OR calls % 7 = 0 THEN 'rejected' ELSE 'extracted' END AS outcome FROM s""")
def review_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with findings as a model might give them: none for some, some without a valid outcome."""
    q = telemetry.calls(table(spark, d, "query_log")).where("session_id is not null")
    s = q.groupBy("session_id").agg(F.count("*").alias("calls"), F.max(F.lower("tool_name").isin(*telemetry.WRITE_TOOLS).cast("int")).alias("writes"), F.min("query_text").alias("task"), F.countDistinct("tool_name").alias("steps"))
    found = s.where("calls % 5 <> 0").select("session_id", "task", F.when(F.col("calls") % 7 == 0, "unknown").otherwise("success").alias("outcome"), "steps")
    return telemetry.review_outcomes(s, found)


@register(f"""WITH {_LOG} SELECT 'static' AS section, 'sources' AS name, CAST(count(*) AS VARCHAR) AS value FROM sources UNION ALL SELECT 'static', 'chunks', CAST(count(DISTINCT id) AS VARCHAR) FROM chunks UNION ALL SELECT 'static', 'concepts', CAST(count(*) AS VARCHAR) FROM concepts UNION ALL SELECT 'static', 'edges', CAST(count(*) AS VARCHAR) FROM edges
UNION ALL SELECT 'types', source_type, CAST(count(*) AS VARCHAR) FROM sources GROUP BY source_type
UNION ALL (SELECT 'dynamic', title, strftime(added_at, '%Y-%m-%d') FROM sources ORDER BY added_at DESC, id LIMIT 5)
UNION ALL (SELECT 'learned', query_text, CAST(count(*) AS VARCHAR) FROM log WHERE query_text IS NOT NULL AND query_text <> '' GROUP BY query_text ORDER BY count(*) DESC, query_text LIMIT 5)""")
def profile(spark: SparkSession, d: str) -> DataFrame:
    """(section, name, value): counts, types, the newest sources, the most frequent texts of calls."""
    s, q = table(spark, d, "sources"), telemetry.calls(table(spark, d, "query_log"))
    row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("string").alias("value"))
    count = lambda df, n: row(df.agg(F.count("*").alias("n")), "static", F.lit(n), F.col("n"))
    out = count(s, "sources").unionByName(count(table(spark, d, "chunks").select("id").distinct(), "chunks")).unionByName(count(table(spark, d, "concepts"), "concepts")).unionByName(count(table(spark, d, "edges"), "edges"))
    out = out.unionByName(row(s.groupBy("source_type").agg(F.count("*").alias("n")), "types", F.col("source_type"), F.col("n")))
    out = out.unionByName(row(s.orderBy(F.desc("added_at"), "id").limit(5), "dynamic", F.col("title"), F.date_format("added_at", "yyyy-MM-dd")))
    t = q.where("query_text is not null and query_text <> ''").groupBy("query_text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query_text").limit(5)
    return out.unionByName(row(t, "learned", F.col("query_text"), F.col("n")))


_NAMES = ("sources", "chunks", "concepts", "edges", "sync_journal", "query_log", "scopes", "documents", "eval_items")


@register(" UNION ALL ".join([f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _NAMES] + [
    "SELECT 'links', count(DISTINCT from_slug || '>' || to_slug) FROM edges", "SELECT 'feedback', count(DISTINCT sync_id) FROM sync_journal WHERE op = 'feedback'", "SELECT 'unpushed', count(DISTINCT sync_id) FROM sync_journal WHERE pushed_at IS NULL",
    "SELECT 'unapplied', count(DISTINCT sync_id) FROM sync_journal WHERE applied_at IS NULL", "SELECT 'sessions', count(DISTINCT session_id) FROM query_log", "SELECT 'embedded', count(DISTINCT id) FROM chunks WHERE embedded_at IS NOT NULL"]))
def all_counts(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in _NAMES]
    j = t("sync_journal")
    for name, df, key in (("links", t("edges"), F.concat_ws(">", "from_slug", "to_slug")), ("feedback", j.where("op = 'feedback'"), F.col("sync_id")), ("unpushed", j.where("pushed_at is null"), F.col("sync_id")), ("unapplied", j.where("applied_at is null"), F.col("sync_id")), ("sessions", t("query_log"), F.col("session_id")), ("embedded", t("chunks").where("embedded_at is not null"), F.col("id"))):
        parts.append(df.agg(F.countDistinct(key).alias("n")).select(F.lit(name).alias("name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ENTRIES = "e AS (SELECT device_id AS user_hash, CASE WHEN sync_id LIKE '%7' THEN upper(sync_id) || 'x' ELSE sync_id END AS sync_id, CASE WHEN op = 'retire' THEN 'short' ELSE substr(sha256(scope_key), 1, 16) END AS scope_tag, CASE WHEN json_valid(payload) THEN payload ELSE '' END AS envelope, row_number() OVER (ORDER BY sync_id, op, payload, created_at, device_id, pushed_at, pulled_at, applied_at) AS seq, pushed_at FROM sync_journal)"


@register(f"""WITH {_ENTRIES}, st AS (SELECT DISTINCT user_hash, sync_id FROM e WHERE seq % 3 = 0), dd AS (SELECT DISTINCT user_hash, sync_id FROM e WHERE seq % 10 = 1)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_full_match(sync_id, '[0-9a-f]{{12}}-[0-9a-f]{{20}}') THEN 'bad_sync_id' WHEN NOT regexp_full_match(scope_tag, '[0-9a-f]{{16}}') THEN 'bad_scope_tag' WHEN envelope = '' THEN 'bad_envelope' WHEN octet_length(encode(envelope)) > 262144 THEN 'too_large'
 WHEN (user_hash, sync_id) IN (SELECT user_hash, sync_id FROM dd) THEN 'deleted' WHEN (user_hash, sync_id) IN (SELECT user_hash, sync_id FROM st) OR row_number() OVER (PARTITION BY user_hash, sync_id ORDER BY seq) > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM e) GROUP BY 1""")
def relay_push(spark: SparkSession, d: str) -> DataFrame:
    """Changes pushed to a relay that holds a third of them and deleted a tenth; some with ids, tags or envelopes that aren't valid."""
    j = table(spark, d, "sync_journal")
    seq = F.row_number().over(W.orderBy("sync_id", "op", "payload", "created_at", "device_id", "pushed_at", "pulled_at", "applied_at"))  # a stand-in for the order of arrival
    e = j.withColumn("seq", seq).select(F.col("device_id").alias("user_hash"), F.when(F.col("sync_id").like("%7"), F.concat(F.upper("sync_id"), F.lit("x"))).otherwise(F.col("sync_id")).alias("sync_id"),
                                        F.when(F.col("op") == "retire", "short").otherwise(F.substring(F.sha2("scope_key", 256), 1, 16)).alias("scope_tag"), F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise("").alias("envelope"), "seq")
    return sync.push(e.where("seq % 3 = 0"), e, e.where("seq % 10 = 1")).groupBy("outcome").agg(F.count("*").alias("n"))


@register("WITH j AS (SELECT DISTINCT sync_id FROM sync_journal WHERE pushed_at IS NULL) SELECT sync_id, CAST(floor((row_number() OVER (ORDER BY sync_id) - 1) / 100) AS BIGINT) AS batch FROM j")
def push_batches(spark: SparkSession, d: str) -> DataFrame:
    return sync.push_batches(table(spark, d, "sync_journal"))


_CURSORS = (("a", "0195"), ("b", "01970"), ("c", "zzzz"), ("d", ""))


@register("WITH s AS (SELECT DISTINCT sync_id FROM sync_journal), c AS (SELECT * FROM (VALUES ('a', '0195'), ('b', '01970'), ('c', 'zzzz'), ('d', '')) t(device, cursor)), p AS (SELECT device, sync_id, row_number() OVER (PARTITION BY device ORDER BY sync_id) AS place, count(*) OVER (PARTITION BY device) AS n FROM c JOIN s ON sync_id > cursor) SELECT device, sync_id, place, CASE WHEN n > 200 THEN max(sync_id) OVER (PARTITION BY device) END AS next_cursor FROM p WHERE place <= 200")
def pull_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 200 for four devices; the next cursor is null on a last page."""
    p = sync.pull_pages(table(spark, d, "sync_journal"), spark.createDataFrame(_CURSORS, "device string, cursor string"), 200)
    return p.withColumn("place", F.col("place").cast("long"))


@register("SELECT sync_id, bool_or(coalesce(json_valid(payload), false)) AS readable FROM sync_journal GROUP BY 1")
def pulled_readable(spark: SparkSession, d: str) -> DataFrame:
    return sync.readable_or_quarantined(table(spark, d, "sync_journal"))


@register("SELECT max(sync_id) AS newest, count(DISTINCT CASE WHEN pushed_at IS NULL THEN sync_id END) AS unpushed, count(DISTINCT CASE WHEN pulled_at IS NOT NULL AND applied_at IS NULL THEN sync_id END) AS unapplied FROM sync_journal")
def sync_watermark(spark: SparkSession, d: str) -> DataFrame:
    return sync.watermark(table(spark, d, "sync_journal"))


@register("""WITH t AS (SELECT json_extract_string(payload, '$.source_id') AS source_id, sync_id, json_extract_string(payload, '$.metadata.task') AS task, json_extract_string(payload, '$.metadata.outcome') AS outcome FROM sync_journal WHERE op = 'trajectory' AND json_valid(payload))
SELECT source_id, task, outcome FROM t WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM sources WHERE substr(id, 1, 1) < '8') QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sync_id, task, outcome) = 1""")
def trajectory_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories of the journal whose source is missing; half of the sources count as missing."""
    return sync.trajectory_inserts(table(spark, d, "sync_journal"), table(spark, d, "sources").where("substr(id, 1, 1) < '8'"))
