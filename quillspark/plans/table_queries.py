"""Registered relational, telemetry, fold and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.functions import text as T
from quillspark.functions.estimate import token_estimate
from quillspark.operators import folds, telemetry
from quillspark.plans.registry import register
from quillspark.session import table

_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def stamp(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or c)


_SLUGIFY = "substr(regexp_replace(regexp_replace(replace(lower(name), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 100)"
_LOG = "log AS (SELECT DISTINCT * FROM query_log)"


@register(f"SELECT id, title, strftime(added_at, '{_STAMP}') AS added_at FROM sources WHERE source_type = 'url' AND compiled_at IS NULL")
def source_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where("source_type = 'url' and compiled_at is null").orderBy(F.desc("added_at"), "id").select("id", "title", stamp("added_at"))


@register("SELECT source_type, count(*) AS n, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM sources GROUP BY source_type")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").groupBy("source_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


_TABLES = ("sources", "chunks", "concepts", "edges", "sync_journal", "query_log", "scopes")


@register(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in _TABLES:
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY added_at, id) AS kept FROM sources QUALIFY id <> first_value(id) OVER (PARTITION BY content_hash ORDER BY added_at, id)")
def source_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Later sources with a content hash that an earlier one has."""
    s = table(spark, d, "sources").select("id", "content_hash", "added_at")
    first = s.groupBy("content_hash").agg(F.min(F.struct("added_at", "id")).alias("f"))
    return s.join(first, "content_hash").where("id <> f.id").select("id", F.col("f.id").alias("kept"))


_HASH = r"sha256(regexp_replace(regexp_replace(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"


@register(f"SELECT id, {_HASH} AS hash, substr(sha256(content), 1, 12) AS short FROM sources")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", T.content_hash(F.col("content")).alias("hash"), T.short_id(F.col("content")).alias("short"))


@register("SELECT id, substr(regexp_replace(regexp_replace(replace(lower(title), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 100) AS slug, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words FROM sources".replace("\\\\", "\\"))
def slugs_and_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", T.slug(F.col("title")).alias("slug"), T.word_count(F.col("content")).alias("words"))


@register("""WITH c AS (SELECT DISTINCT id, token_count, CASE WHEN length(content) = 0 THEN 0 ELSE CAST(ceil(length(content) / (4.0 - ((length(content) - length(translate(content, '{}();=<>[]', ''))) / length(content)) * 1.5)) AS BIGINT) END AS tokens FROM chunks)
SELECT id, token_count, tokens FROM c WHERE token_count <> tokens""")
def token_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose stored count isn't the estimate."""
    return table(spark, d, "chunks").select("id", "token_count", token_estimate(F.col("content")).alias("tokens")).distinct().where("token_count <> tokens")


_TRIM = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"


@register(rf"""WITH t AS (SELECT id, {_TRIM} AS t FROM sources), n AS (SELECT id, t, len(regexp_extract_all(t, '(?i)</?[a-z][\w-]*[^>]*>')) AS tags, len(string_split(t, chr(10))) AS lines FROM t)
SELECT id, CASE WHEN regexp_matches(t, '(?i)^<!doctype\s+html') OR regexp_matches(t, '(?i)^<html') OR (tags > 5 AND tags / lines > 0.3) THEN 'html' WHEN regexp_matches(t, '(?m)^#{{1,6}}\s') OR regexp_matches(t, '(?m)^```') OR regexp_matches(t, '^---\n') THEN 'markdown' ELSE 'plain' END AS format FROM n""")
def formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", T.detect_format(F.col("content")).alias("format"))


@register(r"""WITH t AS (SELECT id, content, lower(content) AS low, list_filter(string_split_regex(lower(title), '\s+'), lambda x: x <> '' AND contains(lower(content), x))[1] AS term FROM sources),
p AS (SELECT *, instr(low, term) - 1 AS pos FROM t), w AS (SELECT *, greatest(0, pos - 80) AS s, least(length(content), pos + 120) AS e FROM p)
SELECT id, CASE WHEN term IS NULL THEN substr(content, 1, 200) ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || replace(substr(content, s + 1, e - s), chr(10), ' ') || (CASE WHEN e < length(content) THEN '...' ELSE '' END) END AS snippet FROM w""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """A snippet of every source for its own title."""
    return table(spark, d, "sources").select("id", T.snippet(F.col("content"), F.col("title")).alias("snippet"))


def _scrub_sql() -> str:
    """One CTE a pattern; look-behind and look-ahead are spelled without them, cards are checked one by one."""
    parts = ["s0 AS (SELECT id, content AS t FROM sources)"]
    digit = "CAST(substr(@G, CAST(length(@G) - i + 1 AS BIGINT), 1) AS INT)"
    luhn = f"list_sum(list_transform(range(1, length(@G) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} ELSE ({digit} * 2) // 10 + ({digit} * 2) % 10 END)) % 10 = 0"
    n = 0
    for name, rx, put in T.PII_CATALOGUE:
        n += 1
        q = rx.replace("'", "''")
        if name == "credit_card":
            put_all = "array_to_string(list_transform(list_zip(string_split_regex(t, '{0}'), regexp_extract_all(t, '{0}')), lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN ({1}) THEN '{2}' ELSE x[2] END), '')"
            g = "regexp_replace(x[2], '[^0-9]', '', 'g')"
            body = put_all.format(q, f"length({g}) BETWEEN 13 AND 19 AND " + luhn.replace("@G", g), put)
            body = f"CASE WHEN regexp_matches(t, '{q}') THEN {body} ELSE t END"
        elif name == "openai_token":
            body = f"regexp_replace(replace(t, 'sk-ant-', chr(1)), '\\bsk-[a-zA-Z0-9_-]{{20,}}\\b', '{put}', 'g')"
            body = f"replace({body}, chr(1), 'sk-ant-')"
        elif name == "phone_us":
            body = rf"regexp_replace(regexp_replace(t, '\b\d{{3}}[-.\s]\d{{3}}[-.\s]\d{{4}}\b', '{put}', 'g'), '(^|[^\d-])\(\d{{3}}\)\s?\d{{3}}[-.\s]\d{{4}}\b', '\1{put}', 'g')"
        else:
            body = f"regexp_replace(t, '{q}', '{put}', 'g')"
        parts.append(f"s{n} AS (SELECT id, {body} AS t FROM s{n - 1})")
    return "WITH " + ", ".join(parts) + f" SELECT id, t AS content FROM s{n}"


_COUNTED = [(n, rx) for n, rx, _ in T.PII_CATALOGUE if n not in ("openai_token", "credit_card", "phone_us")]


@register("SELECT id, " + ", ".join(f"len(regexp_extract_all(content, '{rx.replace(chr(39), chr(39) * 2)}')) AS {n}" for n, rx in _COUNTED) + " FROM sources")
def catalogue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every pattern of the catalogue in the texts as they are."""
    return table(spark, d, "sources").select("id", *[F.regexp_count("content", F.lit(T.ascii_boundaries(rx))).cast("long").alias(n) for n, rx in _COUNTED])


@register(_scrub_sql())
def scrubbed(spark: SparkSession, d: str) -> DataFrame:
    """Every source through the redaction catalogue."""
    return T.scrubbed(table(spark, d, "sources").select("id", "content"), "content").drop("redactions")


_STEPS_SQL = _scrub_sql().rpartition(" SELECT id, t AS content")[0]


@register(_STEPS_SQL + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, CAST(sum(len(regexp_extract_all(t, '{rx.replace(chr(39), chr(39) * 2)}'))) AS BIGINT) AS n FROM s{i}" for i, (n, rx, _) in enumerate(T.PII_CATALOGUE) if (n, rx) in _COUNTED) + ") WHERE n > 0")
def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each pattern of the catalogue was replaced, by the maps of counts of all sources."""
    r = T.scrubbed(table(spark, d, "sources").select("id", "content"), "content")
    n = r.select(F.explode("redactions").alias("pattern", "n")).groupBy("pattern").agg(F.sum("n").alias("n"))
    return n.where(F.col("pattern").isin(*[x for x, _ in _COUNTED]))


@register("WITH s AS (" + _scrub_sql() + ") SELECT s.id, s.content = o.content AS clean FROM s JOIN sources o USING (id)")
def strict_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Sources that strict mode accepts."""
    return T.strict(table(spark, d, "sources").select("id", "content"), "content").select("id", F.col("reason").isNull().alias("clean"))


@register(f"WITH {_LOG} SELECT lower(tool_name) AS tool, count(*) AS n FROM log GROUP BY 1")
def queries_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.calls(table(spark, d, "query_log")).groupBy(F.lower("tool_name").alias("tool")).agg(F.count("*").alias("n"))


@register(f"WITH {_LOG} SELECT query_text, count(*) AS n FROM log WHERE query_text IS NOT NULL AND query_text <> '' GROUP BY 1 ORDER BY n DESC, query_text LIMIT 20")
def frequent_topics(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.calls(table(spark, d, "query_log")).where("query_text is not null and query_text <> ''").groupBy("query_text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query_text").limit(20)


@register(f"WITH {_LOG} SELECT lower(tool_name) AS tool, query_text, count(*) AS n FROM log WHERE query_text IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, tool, query_text LIMIT 20")
def repeated_inputs(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.calls(table(spark, d, "query_log")).where("query_text is not null").groupBy(F.lower("tool_name").alias("tool"), "query_text").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "tool", "query_text").limit(20)


@register(f"""WITH {_LOG}, r AS (SELECT DISTINCT session_id FROM log WHERE result_count = 0 AND session_id IS NOT NULL)
SELECT session_id, count(*) AS calls, strftime(max(timestamp), '{_STAMP}') AS last_at, max(CASE WHEN lower(tool_name) IN {telemetry.WRITE_TOOLS} THEN 1 ELSE 0 END) AS writes FROM log WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM r) GROUP BY 1 HAVING count(*) >= 3""")
def candidate_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with an empty result stand in for the reviewed ones."""
    q = table(spark, d, "query_log")
    return telemetry.candidate_sessions(q, q.where("result_count = 0 and session_id is not null").select("session_id").distinct()).select("session_id", "calls", stamp("last_at"), "writes")


@register(f"""WITH {_LOG}, f AS (SELECT session_id, scope_kind, scope_key FROM log WHERE session_id IS NOT NULL AND scope_kind IS NOT NULL AND scope_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id, scope_kind, scope_key) = 1)
SELECT l.session_id, count(*) AS calls, CAST(sum(skill_hit) AS BIGINT) AS hits, CAST(coalesce(sum(tokens_spent), 0) AS BIGINT) AS tokens, strftime(min(timestamp), '{_STAMP}') AS first_at, strftime(max(timestamp), '{_STAMP}') AS last_at, any_value(f.scope_kind) AS scope_kind, any_value(f.scope_key) AS scope_key
FROM log l LEFT JOIN f USING (session_id) WHERE l.session_id IS NOT NULL GROUP BY l.session_id""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.session_summary(table(spark, d, "query_log")).select("session_id", "calls", "hits", "tokens", stamp("first_at"), stamp("last_at"), "scope_kind", "scope_key")


_SESS = f"{_LOG}, s AS (SELECT session_id, max(skill_hit) AS h, sum(tokens_spent) AS t, max(scope_kind) AS scope_kind, max(scope_key) AS scope_key FROM log WHERE session_id IS NOT NULL GROUP BY 1)"
_SAVE = "count(*) AS sessions, CAST(coalesce(sum(CASE WHEN h = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS hit_sessions, coalesce(avg(CASE WHEN h <> 1 THEN t END), 0) AS b, coalesce(avg(CASE WHEN h = 1 THEN t END), 0) AS a"
_OUT = "sessions, hit_sessions, CASE WHEN sessions = 0 THEN 0.0 ELSE round(hit_sessions / sessions, 6) END AS hit_rate, CAST(floor(b + 0.5) AS BIGINT) AS baseline, CAST(floor(a + 0.5) AS BIGINT) AS with_skill, CAST(floor(greatest(b - a, 0) * hit_sessions + 0.5) AS BIGINT) AS saved, floor(greatest(b - a, 0) * hit_sessions / 1000 * 0.003 * 100 + 0.5) / 100 AS usd"


@register(f"WITH {_SESS}, g AS (SELECT {_SAVE} FROM s) SELECT {_OUT} FROM g")
def cost_avoided(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.cost_avoided(table(spark, d, "query_log"))


@register(f"WITH {_SESS}, g AS (SELECT scope_kind, scope_key, {_SAVE} FROM s WHERE scope_kind IS NOT NULL AND scope_key IS NOT NULL GROUP BY 1, 2) SELECT scope_kind, scope_key, {_OUT} FROM g")
def cost_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.cost_by_scope(table(spark, d, "query_log"))


@register(f"""WITH {_LOG}, r AS (SELECT id, session_id, epoch_us(timestamp) AS us, CAST(floor(epoch_us(timestamp) / 60000000) AS BIGINT) AS bucket FROM log WHERE session_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, bucket ORDER BY us, id) AS n FROM r) SELECT id, session_id, bucket, CAST(greatest(1, ceil((bucket + 1) * 60 - us / 1000000)) AS BIGINT) AS retry_after FROM n WHERE n > 2""")
def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.rate_limited(table(spark, d, "query_log"), "session_id", 60, 2)


@register(f"""WITH {_LOG}, r AS (SELECT lower(tool_name) AS tool, latency_ms, row_number() OVER (PARTITION BY lower(tool_name) ORDER BY latency_ms, id) - 1 AS i, count(*) OVER (PARTITION BY lower(tool_name)) AS n FROM log WHERE latency_ms IS NOT NULL)
SELECT tool, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN latency_ms END) AS p50, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN latency_ms END) AS p95, max(CASE WHEN i = least(floor(n * 0.99), n - 1) THEN latency_ms END) AS p99 FROM r GROUP BY tool""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.latency_percentiles(table(spark, d, "query_log").withColumn("tool", F.lower("tool_name")), "tool")


@register(f"WITH {_LOG}, m AS (SELECT max(timestamp) AS m FROM log) SELECT lower(tool_name) AS tool, count(*) AS n, CAST(coalesce(sum(tokens_spent), 0) AS BIGINT) AS tokens FROM log, m WHERE timestamp >= m - INTERVAL 7 DAY GROUP BY 1")
def rolling_week(spark: SparkSession, d: str) -> DataFrame:
    """The seven days up to the last call."""
    q = telemetry.calls(table(spark, d, "query_log"))
    end = q.agg(F.max("timestamp").alias("end"))  # one row
    return q.crossJoin(F.broadcast(end)).where("timestamp >= end - interval 7 days").groupBy(F.lower("tool_name").alias("tool")).agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens_spent"), F.lit(0)).alias("tokens"))


#: Intents and their patterns, tried in order.
INTENTS = (
    ("entity_lookup", r"^(who|what) is\s+"), ("entity_lookup", r"^(tell me about|explain|describe)\s+"), ("graph_path", r"path (from|between)\s+"), ("graph_path", r"how (does|do|is).+(connect|relate|link)"),
    ("neighborhood", r"(related to|neighbors of|connected to)\s+"), ("temporal", r"(what|when).+(happen|occur).+(in|on|during)"), ("temporal", r"(timeline|history|chronology) of"),
    ("originals", r"(what (have|did) i (say|said|write|wrote|note|noted)|my (notes|thoughts) on)"),
)


@register("SELECT DISTINCT query_text, CASE " + " ".join(f"WHEN regexp_matches(query_text, '(?i){rx}') THEN '{n}'" for n, rx in INTENTS) + " ELSE 'hybrid_search' END AS intent FROM query_log WHERE query_text IS NOT NULL")
def intents(spark: SparkSession, d: str) -> DataFrame:
    c = F.lit(None)
    for name, rx in reversed(INTENTS):
        c = F.when(F.col("query_text").rlike(f"(?i){rx}"), name).otherwise(c)
    return table(spark, d, "query_log").where("query_text is not null").select("query_text", F.coalesce(c, F.lit("hybrid_search")).alias("intent")).distinct()


@register(f"""WITH a AS (SELECT {_SLUGIFY} AS alias, min(slug) AS canonical_slug FROM concepts GROUP BY 1), al AS (SELECT a.* FROM a WHERE alias NOT IN (SELECT slug FROM concepts)),
e AS (SELECT coalesce(f.canonical_slug, from_slug) AS from_slug, coalesce(t.canonical_slug, to_slug) AS to_slug, relation, weight, source_id, s.added_at AS seq FROM edges LEFT JOIN al f ON f.alias = from_slug LEFT JOIN al t ON t.alias = to_slug LEFT JOIN sources s ON s.id = source_id),
n AS (SELECT from_slug, to_slug, relation, source_id FROM e WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY from_slug, to_slug, relation ORDER BY seq DESC NULLS LAST, source_id DESC) = 1)
SELECT from_slug, to_slug, relation, max(weight) AS weight, any_value(n.source_id) AS source_id FROM e LEFT JOIN n USING (from_slug, to_slug, relation) GROUP BY 1, 2, 3""")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Edges in order of arrival of their sources, with ends that are known aliases resolved."""
    c = table(spark, d, "concepts")
    aliases = c.groupBy(T.slug(F.col("name")).alias("alias")).agg(F.min("slug").alias("canonical_slug")).join(c.select(F.col("slug").alias("alias")), "alias", "left_anti")
    e = table(spark, d, "edges").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("added_at").alias("seq")), "source_id", "left")
    return folds.upsert_edges(e, aliases)


@register("""WITH c AS (SELECT DISTINCT entity_id AS slug, sync_id AS seq, json_extract_string(payload, '$.name') AS name, json_extract_string(payload, '$.summary') AS summary, json_extract_string(payload, '$.compiled_truth') AS truth FROM sync_journal WHERE op = 'concept_create' AND json_valid(payload))
SELECT slug, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(summary, seq) FILTER (summary IS NOT NULL) AS summary, arg_max(truth, seq) FILTER (truth IS NOT NULL) AS truth, count(*) AS mentions FROM c GROUP BY slug""")
def concept_upsert(spark: SparkSession, d: str) -> DataFrame:
    from quillspark.operators.journal import complete_json

    j = table(spark, d, "sync_journal").where("op = 'concept_create'").where(complete_json(F.col("payload")))
    get = lambda n: F.get_json_object("payload", f"$.{n}")
    return folds.upsert_concepts(j.select(F.col("entity_id").alias("slug"), F.col("sync_id").alias("seq"), get("name").alias("name"), get("summary").alias("summary"), get("compiled_truth").alias("truth")).distinct())


@register("""WITH l AS (SELECT from_slug AS slug, source_id FROM edges UNION SELECT to_slug, source_id FROM edges), n AS (SELECT slug, count(DISTINCT source_id) AS sources FROM l WHERE source_id IS NOT NULL GROUP BY 1)
SELECT c.slug, mention_count AS mentions, coalesce(sources, 0) AS sources, CASE WHEN mention_count >= 6 AND coalesce(sources, 0) >= 3 THEN 1 WHEN mention_count >= 3 AND coalesce(sources, 0) >= 2 THEN 2 ELSE 3 END AS tier FROM concepts c LEFT JOIN n USING (slug)""")
def concept_tiers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    links = e.select(F.col("from_slug").alias("slug"), "source_id").union(e.select("to_slug", "source_id"))
    return folds.tiers(table(spark, d, "concepts"), links)


@register("SELECT enrichment_tier, count(*) AS n, CAST(sum(enrichment_queued) AS BIGINT) AS queued FROM concepts GROUP BY 1")
def enrichment_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").groupBy("enrichment_tier").agg(F.count("*").alias("n"), F.sum("enrichment_queued").alias("queued"))


@register("SELECT slug, enrichment_tier, mention_count FROM concepts WHERE enrichment_queued = 1 ORDER BY enrichment_tier, mention_count DESC, slug LIMIT 10")
def enrichment_queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").where("enrichment_queued = 1").orderBy("enrichment_tier", F.desc("mention_count"), "slug").limit(10).select("slug", "enrichment_tier", "mention_count")


@register("""WITH f AS (SELECT sync_id, created_at, json_extract_string(payload, '$.concept_slug') AS slug, CAST(json_extract_string(payload, '$.delta') AS INT) AS delta, json_extract_string(payload, '$.reason') AS reason FROM sync_journal WHERE op = 'feedback' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY sync_id ORDER BY created_at, payload) = 1),
r AS (SELECT *, sum(delta) OVER (PARTITION BY slug ORDER BY created_at, sync_id ROWS UNBOUNDED PRECEDING) AS run FROM f WHERE delta IN (-1, 1) AND slug IS NOT NULL),
g AS (SELECT slug, arg_min(struct_pack(a := created_at, b := sync_id), struct_pack(a := created_at, b := sync_id)) FILTER (run <= -3) AS r FROM r GROUP BY slug),
w AS (SELECT slug, reason FROM r JOIN g USING (slug) WHERE delta < 0 AND reason IS NOT NULL AND struct_pack(a := created_at, b := sync_id) <= g.r QUALIFY row_number() OVER (PARTITION BY slug ORDER BY created_at DESC, sync_id DESC) = 1)
SELECT r.slug, CAST(sum(delta) AS BIGINT) AS score, any_value(g.r.b) AS retired_by, any_value(w.reason) AS reason FROM r LEFT JOIN g USING (slug) LEFT JOIN w USING (slug) GROUP BY r.slug""")
def feedback_retire(spark: SparkSession, d: str) -> DataFrame:
    return folds.retirements(folds.feedback_events(table(spark, d, "sync_journal")))


@register("""WITH u AS (SELECT DISTINCT sync_id, entity_id, json_extract_string(payload, '$.updated_at') AS u FROM sync_journal WHERE op = 'truth_update' AND json_valid(payload)),
i AS (SELECT sync_id, entity_id, CASE WHEN regexp_full_match(u, '[0-9]+') THEN CAST(u AS BIGINT) * 1000 ELSE epoch_us(CAST(u AS TIMESTAMPTZ)) END AS us FROM u),
b AS (SELECT *, max(us) OVER (PARTITION BY entity_id ORDER BY sync_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
SELECT sync_id, entity_id, CASE WHEN before IS NULL OR us > before THEN 'won' WHEN us = before THEN 'tie' ELSE 'lost' END AS outcome FROM b""")
def lww_apply(spark: SparkSession, d: str) -> DataFrame:
    return folds.truth_outcomes(table(spark, d, "sync_journal"))




@register(f"""WITH a AS (SELECT {_SLUGIFY} AS alias, min(slug) AS canonical_slug FROM concepts GROUP BY 1), e AS (SELECT DISTINCT entity_id AS slug FROM sync_journal)
SELECT e.slug, coalesce(c.slug, a.canonical_slug) AS canonical FROM e LEFT JOIN concepts c ON c.slug = e.slug LEFT JOIN a ON a.alias = e.slug""")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "concepts")
    a = c.select(T.slug(F.col("name")).alias("alias"), F.col("slug").alias("canonical_slug"))
    return folds.resolve_aliases(table(spark, d, "sync_journal").select(F.col("entity_id").alias("slug")).distinct(), c, a)


_SETTOK = "list_distinct(list_filter(string_split_regex(lower(coalesce(compiled_truth, summary, name, '')), '[^a-z0-9]+'), lambda w: length(w) > 2))"


@register(f"""WITH c AS (SELECT slug, scope_kind, scope_key, {_SETTOK} AS t FROM concepts WHERE retired_at IS NULL), k AS (SELECT * FROM c WHERE len(t) >= 4)
SELECT a.slug AS slug_a, b.slug AS slug_b, a.scope_key FROM k a JOIN k b ON a.scope_kind = b.scope_kind AND a.scope_key = b.scope_key AND a.slug < b.slug
WHERE 1 - levenshtein(a.slug, b.slug) / greatest(length(a.slug), length(b.slug)) >= 0.7 - 1e-9 AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.6 - 1e-9""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "concepts").where("retired_at is null").withColumn("content", F.coalesce("compiled_truth", "summary", "name", F.lit("")))
    return folds.merge_candidates(c)


@register("SELECT count(*) AS total, count(embedded_at) AS embedded, count(*) - count(embedded_at) AS pending FROM (SELECT DISTINCT id, embedded_at FROM chunks)")
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "embedded_at").distinct()
    return c.agg(F.count("*").alias("total"), F.count("embedded_at").alias("embedded"), (F.count("*") - F.count("embedded_at")).alias("pending"))


@register("SELECT source_id, id, position FROM (SELECT DISTINCT source_id, id, position FROM chunks) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY position, id) <= 8")
def first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first eight chunks of every source."""
    c = table(spark, d, "chunks").select("source_id", "id", "position").distinct()
    return c.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("position", "id"))).where("n <= 8").drop("n")


@register("""WITH gone AS (SELECT id FROM sources WHERE word_count = 0 OR substr(id, 1, 1) = '0'), dead AS (SELECT slug FROM concepts WHERE retired_at IS NOT NULL)
SELECT DISTINCT 'chunks' AS child, c.id AS key, 'delete' AS action FROM chunks c WHERE source_id IN (SELECT id FROM gone) UNION SELECT 'edges', from_slug || '>' || to_slug || '>' || relation, 'delete' FROM edges WHERE from_slug IN (SELECT slug FROM dead) OR to_slug IN (SELECT slug FROM dead)
UNION SELECT 'edges', from_slug || '>' || to_slug || '>' || relation, 'set null' FROM edges WHERE source_id IN (SELECT id FROM gone) AND from_slug NOT IN (SELECT slug FROM dead) AND to_slug NOT IN (SELECT slug FROM dead)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What goes with sources without words and retired concepts: chunks and edges; edges of other concepts only lose their source."""
    gone = table(spark, d, "sources").where("word_count = 0 or substr(id, 1, 1) = '0'").select(F.col("id").alias("source_id"))
    dead = table(spark, d, "concepts").where("retired_at is not null").select("slug")
    chunks = table(spark, d, "chunks").join(gone, "source_id", "left_semi").select(F.lit("chunks").alias("child"), F.col("id").alias("key"), F.lit("delete").alias("action"))
    e = table(spark, d, "edges").withColumn("key", F.concat_ws(">", "from_slug", "to_slug", "relation"))
    hit = e.join(dead.withColumnRenamed("slug", "from_slug"), "from_slug", "left_semi").select("key").union(e.join(dead.withColumnRenamed("slug", "to_slug"), "to_slug", "left_semi").select("key")).distinct()
    orphans = e.join(gone, "source_id", "left_semi").select("key").join(hit, "key", "left_anti")
    edge = lambda df, a: df.select(F.lit("edges").alias("child"), "key", F.lit(a).alias("action"))
    return chunks.unionByName(edge(hit, "delete")).unionByName(edge(orphans, "set null")).distinct()


@register("WITH m AS (SELECT max(added_at) AS now FROM sources) SELECT id FROM sources, m WHERE compiled_at IS NULL OR floor((epoch_us(now) - epoch_us(compiled_at)) / 1000000) >= 86400")
def due_sources(spark: SparkSession, d: str) -> DataFrame:
    """Never run, or the last run a day or more before the newest source."""
    s = table(spark, d, "sources")
    now = s.agg(F.max("added_at").alias("now"))  # one row
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.crossJoin(F.broadcast(now)).where(F.col("compiled_at").isNull() | (F.floor((us("now") - us("compiled_at")) / 1_000_000) >= 86400)).select("id")


@register("SELECT DISTINCT sync_id, op FROM sync_journal WHERE sync_id > '019500000000' ORDER BY sync_id, op LIMIT 100")
def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sync_journal").where("sync_id > '019500000000'").select("sync_id", "op").distinct().orderBy("sync_id", "op").limit(100)


@register("SELECT s.kind, s.key, coalesce(s.label, s.key) AS label, count(c.slug) AS concepts FROM scopes s LEFT JOIN concepts c ON c.scope_kind = s.kind AND c.scope_key = s.key GROUP BY ALL")
def scope_overview(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "scopes"), table(spark, d, "concepts").groupBy(F.col("scope_kind").alias("kind"), F.col("scope_key").alias("key")).agg(F.count("*").alias("concepts"))
    return s.join(c, ["kind", "key"], "left").select("kind", "key", F.coalesce("label", "key").alias("label"), F.coalesce("concepts", F.lit(0)).alias("concepts"))


@register("""WITH w AS (SELECT DISTINCT lower(regexp_extract(compiled_truth, '[A-Za-z]+ ([a-z]+ [a-z]+)', 1)) AS s FROM concepts), names AS (SELECT replace(s, ' ', '-') AS slug FROM w WHERE s <> '' UNION SELECT split_part(s, ' ', 1) FROM w WHERE length(s) > 14 UNION SELECT 'that-' || split_part(s, ' ', 1) || '-was' FROM w WHERE s <> '' UNION SELECT slug FROM concepts),
c AS (SELECT slug, lower(compiled_truth) AS low FROM concepts), f AS (SELECT slug AS mentions, lower(slug) AS form FROM names UNION SELECT slug, replace(lower(slug), '-', ' ') FROM names)
SELECT DISTINCT slug, mentions FROM c JOIN f ON slug <> mentions AND contains(low, form)""")
def auto_links(spark: SparkSession, d: str) -> DataFrame:
    """Known concepts, and concepts named by words of the truths."""
    c = table(spark, d, "concepts").select("slug", F.col("compiled_truth").alias("truth"))
    w = c.select(F.lower(F.regexp_extract("truth", "[A-Za-z]+ ([a-z]+ [a-z]+)", 1)).alias("s")).where("s <> ''").distinct()
    first = F.split("s", " ")[0]
    names = w.select(F.replace("s", F.lit(" "), F.lit("-"))).union(w.where("length(s) > 14").select(first)).union(w.select(F.concat(F.lit("that-"), first, F.lit("-was")))).toDF("slug").distinct().join(c.select("slug"), "slug", "left_anti")
    return folds.auto_links(c.unionByName(names.withColumn("truth", F.lit(None).cast("string"))))


_STEPS = "array<struct<n:long,tool:string,args:map<string,string>,result_summary:string,result_ok:boolean,elapsed_ms:long>>"


@register("""WITH t AS (SELECT id, content FROM sources WHERE source_type = 'trajectory' AND json_valid(content)), s AS (SELECT id, unnest(CAST(json_extract(content, '$.steps') AS JSON[])) AS x FROM t)
SELECT id, CAST(json_extract_string(x, '$.n') AS BIGINT) AS n, json_extract_string(x, '$.tool') AS tool, json_extract_string(x, '$.args.cmd') AS cmd, CASE WHEN length(json_extract_string(x, '$.result_summary')) > 500 THEN substr(json_extract_string(x, '$.result_summary'), 1, 497) || '...' ELSE json_extract_string(x, '$.result_summary') END AS summary, CAST(json_extract_string(x, '$.elapsed_ms') AS BIGINT) AS elapsed FROM s""")
def trajectory_steps(spark: SparkSession, d: str) -> DataFrame:
    """One row per step of the trajectories that are whole; long summaries are cut to 497 characters and three dots."""
    from quillspark.operators.journal import complete_json

    t = table(spark, d, "sources").where("source_type = 'trajectory'").where(complete_json(F.col("content")))
    s = t.select("id", F.explode(F.from_json("content", f"steps {_STEPS}")["steps"]).alias("x")).select("id", "x.*")
    long = F.length("result_summary") > 500
    return s.select("id", "n", "tool", F.col("args")["cmd"].alias("cmd"), F.when(long, F.concat(F.substring("result_summary", 1, 497), F.lit("..."))).otherwise(F.col("result_summary")).alias("summary"), F.col("elapsed_ms").alias("elapsed"))


@register("SELECT slug, coalesce(compiled_truth, summary) AS truth, score FROM concepts WHERE retired_at IS NULL AND coalesce(compiled_truth, summary) IS NOT NULL")
def known_skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").where("retired_at is null").select("slug", F.coalesce("compiled_truth", "summary").alias("truth"), "score").where("truth is not null")


@register(r"""WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(content, 'git@[A-Za-z0-9.\-]+:[A-Za-z0-9_./\-]+')) AS remote FROM sources)
SELECT remote, lower('https://' || regexp_replace(regexp_replace(substr(remote, 5), ':', '/'), '\.git$', '')) AS url FROM r""")
def git_remotes(spark: SparkSession, d: str) -> DataFrame:
    """Remotes in the texts, in one spelling."""
    r = table(spark, d, "sources").select(F.explode(F.regexp_extract_all("content", F.lit(r"git@[A-Za-z0-9.\-]+:[A-Za-z0-9_./\-]+"), F.lit(0))).alias("remote")).distinct()
    return r.select("remote", F.lower(F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace(F.substring("remote", 5, 10_000), "^([^:]*):", "$1/"), r"\.git$", ""))).alias("url"))


@register(f"""WITH {_LOG} SELECT strftime(time_bucket(INTERVAL 1 HOUR, timestamp), '%Y-%m-%d %H:%M:%S') AS start, lower(tool_name) AS tool, count(*) AS calls, CAST(sum(skill_hit) AS BIGINT) AS hits, CAST(coalesce(sum(tokens_spent), 0) AS BIGINT) AS tokens FROM query_log GROUP BY 1, 2""".replace(f"WITH {_LOG} ", ""))
def stream_call_windows(spark: SparkSession, d: str) -> DataFrame:
    """The whole log through the windowed stream, late calls too; the last state of every window."""
    import uuid

    from quillspark.session import shared_folder
    from quillspark.sources.files import stream_parquet
    from quillspark.streaming import jobs

    base = f"{shared_folder(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    jobs.write_batches(jobs.call_windows(stream_parquet(spark, f"{d}/query_log.parquet"), late=None), f"{base}/out", f"{base}/checkpoint", mode="update").awaitTermination()
    rows = spark.read.parquet(f"{base}/out").withColumn("k", F.row_number().over(W.partitionBy("start", "tool").orderBy(F.desc("batch"))))
    return rows.where("k = 1").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tool", "calls", "hits", F.coalesce("tokens", F.lit(0)).alias("tokens"))


@register(f"WITH {_LOG} SELECT id, lower(tool_name) AS tool, strftime(timestamp, '{_STAMP}') AS at FROM log ORDER BY timestamp DESC, id DESC, tool LIMIT 50")
def recent_queries(spark: SparkSession, d: str) -> DataFrame:
    q = telemetry.calls(table(spark, d, "query_log")).select("id", F.lower("tool_name").alias("tool"), "timestamp")
    return q.orderBy(F.desc("timestamp"), F.desc("id"), "tool").limit(50).select("id", "tool", stamp("timestamp", "at"))


@register("SELECT DISTINCT kind, key FROM (SELECT kind, key FROM scopes WHERE NOT (kind = 'codebase' AND starts_with(key, 'local-')) UNION ALL SELECT 'personal', 'me')")
def scope_tags(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that may be shared, and the personal one."""
    s = table(spark, d, "scopes").where("not (kind = 'codebase' and startswith(key, 'local-'))").select("kind", "key")
    return s.union(spark.createDataFrame([("personal", "me")], "kind string, key string")).distinct()


@register("SELECT to_slug AS slug, from_slug, relation, weight FROM (SELECT DISTINCT to_slug, from_slug, relation, weight FROM edges) QUALIFY row_number() OVER (PARTITION BY to_slug ORDER BY weight DESC, from_slug, relation) <= 5")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """The five heaviest edges into every concept."""
    e = table(spark, d, "edges").select(F.col("to_slug").alias("slug"), "from_slug", "relation", "weight").distinct()
    w = W.partitionBy("slug").orderBy(F.desc("weight"), "from_slug", "relation")
    return e.withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")


@register("""SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM concepts WHERE retired_at IS NULL) AS active,
(SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / greatest((SELECT count(*) FROM concepts), 1), 6) AS edges_per_concept""")
def status_overview(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").agg(F.count("*").alias("sources"))
    k = table(spark, d, "chunks").agg(F.countDistinct("id").alias("chunks"))
    c = table(spark, d, "concepts").agg(F.count("*").alias("concepts"), F.count(F.when(F.col("retired_at").isNull(), 1)).alias("active"))
    e = table(spark, d, "edges").agg(F.count("*").alias("edges"))
    one = s.crossJoin(k).crossJoin(c).crossJoin(e)  # single rows
    return one.withColumn("edges_per_concept", F.round(F.col("edges") / F.greatest("concepts", F.lit(1)), 6))


@register("""WITH l AS (SELECT slug, source_id, max(weight) AS relevance FROM (SELECT from_slug AS slug, source_id, weight FROM edges UNION ALL SELECT to_slug, source_id, weight FROM edges) WHERE source_id IS NOT NULL GROUP BY 1, 2),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY slug ORDER BY relevance DESC, source_id) <= 5),
k AS (SELECT source_id, id, position FROM (SELECT DISTINCT source_id, id, position FROM chunks) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY position, id) <= 8)
SELECT slug, source_id, id AS chunk_id, position FROM t JOIN k USING (source_id)""")
def enrichment_context(spark: SparkSession, d: str) -> DataFrame:
    """For every concept its five most relevant sources, with their first eight chunks."""
    e = table(spark, d, "edges").where("source_id is not null")
    ends = e.select(F.explode(F.array("from_slug", "to_slug")).alias("slug"), "source_id", "weight")
    links = ends.groupBy("slug", "source_id").agg(F.max("weight").alias("relevance"))
    top = links.withColumn("n", F.row_number().over(W.partitionBy("slug").orderBy(F.desc("relevance"), "source_id"))).where("n <= 5").select("slug", "source_id")
    return top.join(first_chunks(spark, d), "source_id").select("slug", "source_id", F.col("id").alias("chunk_id"), "position")
