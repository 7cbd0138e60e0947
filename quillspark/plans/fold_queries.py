"""Registered queries of changes to keyed tables: history, retirements, aliases, links, timelines, scopes, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.functions import text as T
from quillspark.operators import folds
from quillspark.operators.journal import complete_json
from quillspark.plans.registry import register
from quillspark.session import table

_INSTANT = "CASE WHEN regexp_full_match(u, '[0-9]+') THEN CAST(u AS BIGINT) * 1000 ELSE epoch_us(CAST(u AS TIMESTAMPTZ)) END"
_UPDATES = f"""u0 AS (SELECT DISTINCT sync_id, entity_id, json_extract_string(payload, '$.updated_at') AS u, json_extract_string(payload, '$.new_truth') AS truth FROM sync_journal WHERE op = 'truth_update' AND json_valid(payload)),
u AS (SELECT sync_id, entity_id, truth, {_INSTANT} AS us FROM u0), b AS (SELECT *, max(us) OVER (PARTITION BY entity_id ORDER BY sync_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
w AS (SELECT *, lead(sync_id) OVER (PARTITION BY entity_id ORDER BY sync_id) AS nxt FROM b WHERE before IS NULL OR us > before)"""


@register(f"""WITH {_UPDATES} SELECT entity_id AS slug, sync_id, truth, us AS at_micros, nxt AS superseded_by FROM w WHERE nxt IS NOT NULL
UNION ALL SELECT b.entity_id, b.sync_id, b.truth, b.us, w.sync_id FROM b JOIN w ON w.entity_id = b.entity_id AND w.us = b.before WHERE b.us < b.before""")
def truth_history(spark: SparkSession, d: str) -> DataFrame:
    return folds.truth_history(table(spark, d, "sync_journal")).withColumnRenamed("at", "at_micros")


@register("SELECT entity_id AS slug, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS retired_at, json_extract_string(payload, '$.reason') AS reason FROM sync_journal WHERE op = 'retire' AND json_valid(payload) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at, sync_id, reason) = 1")
def first_retirements(spark: SparkSession, d: str) -> DataFrame:
    r = folds.first_retirements(table(spark, d, "sync_journal"))
    return r.select("slug", F.date_format("retired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("retired_at"), "reason")


@register("""WITH j AS (SELECT sync_id, bool_or(coalesce(json_valid(payload), false)) AS whole, min(op) AS op, min(entity_id) AS entity_id FROM sync_journal GROUP BY 1),
m AS (SELECT entity_id FROM sync_journal WHERE op = 'concept_create' AND json_valid(payload) UNION SELECT slug FROM concepts WHERE retired_at IS NULL)
SELECT sync_id, op, CASE WHEN right(sync_id, 1) = '0' THEN 'skipped' WHEN NOT whole THEN 'unreadable' WHEN op IN ('truth_update', 'retire', 'feedback') AND entity_id NOT IN (SELECT entity_id FROM m) THEN 'pending' ELSE 'applied' END AS outcome FROM j""")
def apply_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every change dispatched; ids that end in 0 count as applied before."""
    j = table(spark, d, "sync_journal")
    return folds.apply_outcomes(j, table(spark, d, "concepts").where("retired_at is null"), j.where("sync_id like '%0'"))


@register("""SELECT json_extract_string(payload, '$.concept_slug') AS slug, json_extract_string(payload, '$.reason') AS reason FROM (SELECT sync_id, min(created_at) AS created_at, min(payload) AS payload FROM sync_journal WHERE op = 'feedback' AND json_valid(payload) GROUP BY 1)
WHERE json_extract_string(payload, '$.delta') = '-1' AND json_extract_string(payload, '$.reason') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY created_at DESC, sync_id DESC) = 1""")
def newest_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The newest reason given with a vote against every concept."""
    e = folds.feedback_events(table(spark, d, "sync_journal")).where("delta = -1 and reason is not null")
    return folds.latest(e, ["slug"], "at", "sync_id").select("slug", "reason")


_FIELDS = "SELECT slug, unnest(CAST(timeline AS JSON[])) AS x, generate_subscripts(CAST(timeline AS JSON[]), 1) AS i, len(CAST(timeline AS JSON[])) AS n FROM concepts WHERE json_valid(timeline)"


@register(f"SELECT slug, n - i AS place, json_extract_string(x, '$.date') AS date, json_extract_string(x, '$.event') AS event FROM ({_FIELDS})")
def timelines(spark: SparkSession, d: str) -> DataFrame:
    return folds.timeline(table(spark, d, "concepts")).select("slug", F.col("place").cast("long").alias("place"), "date", "event")


@register("""WITH n AS (SELECT entity_id AS slug, count(*) AS n, max(sync_id) AS last FROM (SELECT DISTINCT sync_id, entity_id FROM sync_journal WHERE op = 'truth_update') GROUP BY 1)
SELECT c.slug, coalesce(len(CAST(timeline AS JSON[])), 0) + coalesce(n.n, 0) AS entries, coalesce(n.last, json_extract_string(CAST(timeline AS JSON[])[-1], '$.event')) AS newest FROM concepts c LEFT JOIN n USING (slug)""")
def timeline_appends(spark: SparkSession, d: str) -> DataFrame:
    """Truth updates appended to the timelines of their concepts: entries and the newest event."""
    j = table(spark, d, "sync_journal").where("op = 'truth_update'").select(F.col("entity_id").alias("slug"), F.col("sync_id").alias("seq")).distinct()
    e = j.select("slug", "seq", F.lit("2025-01-01").alias("date"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_title"), F.col("seq").alias("event"))
    t = folds.append_timeline(table(spark, d, "concepts").select("slug", "timeline"), e)
    return t.select("slug", F.size("timeline").cast("long").alias("entries"), F.try_element_at("timeline", F.lit(-1))["event"].alias("newest"))


@register("""WITH s AS (SELECT scope_kind AS kind, scope_key AS key, min(added_at) AS f, max(added_at) AS t, arg_max(language, struct_pack(a := added_at, b := language)) FILTER (language IS NOT NULL) AS m FROM sources GROUP BY ALL)
SELECT coalesce(c.kind, s.kind) AS kind, coalesce(c.key, s.key) AS key, label, coalesce(s.m, c.metadata) AS metadata, epoch_us(coalesce(c.detected_at, s.f)) AS detected, epoch_us(coalesce(s.t, c.last_seen_at)) AS seen FROM (SELECT * FROM scopes WHERE key NOT LIKE 'a%') c FULL JOIN s ON c.kind = s.kind AND c.key = s.key""".replace("struct_pack(a := added_at, b := language)", "struct_pack(x := added_at, y := language)"))
def scope_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of scopes by their sources; some scopes are new."""
    s = table(spark, d, "sources").select(F.col("scope_kind").alias("kind"), F.col("scope_key").alias("key"), F.lit(None).cast("string").alias("label"), F.col("language").alias("metadata"), F.col("added_at").alias("at"))
    s = s.withColumn("at", F.col("at"))
    u = folds.upsert_scopes(table(spark, d, "scopes").where("key not like 'a%'"), s)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return u.select("kind", "key", "label", "metadata", us("detected_at").alias("detected"), us("last_seen_at").alias("seen"))


@register("""WITH l AS (SELECT from_slug, to_slug, 'reference' AS link_type, relation AS seq, source_id AS context FROM edges UNION ALL SELECT to_slug, from_slug, 'back-link', relation, source_id FROM edges)
SELECT from_slug, to_slug, link_type, min(seq) AS seq FROM l GROUP BY ALL""")
def link_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    return folds.link_pairs(e.select("from_slug", "to_slug", F.col("relation").alias("seq"), F.col("source_id").alias("context"))).drop("context")


@register("""WITH l AS (SELECT from_slug, to_slug, relation AS link_type, max(s.added_at) AS created FROM edges e LEFT JOIN sources s ON s.id = e.source_id GROUP BY ALL)
SELECT to_slug AS slug, from_slug, link_type, row_number() OVER (PARTITION BY to_slug ORDER BY created DESC NULLS LAST, from_slug, link_type) AS place FROM l""")
def links_by_date(spark: SparkSession, d: str) -> DataFrame:
    """Links into every concept, newest first."""
    e = table(spark, d, "edges").join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "added_at"), "source_id", "left")
    links = e.groupBy(F.col("to_slug").alias("slug"), "from_slug", F.col("relation").alias("link_type")).agg(F.max("added_at").alias("created"))
    w = W.partitionBy("slug").orderBy(F.desc_nulls_last("created"), "from_slug", "link_type")
    return links.select("slug", "from_slug", "link_type", F.row_number().over(w).cast("long").alias("place"))


_SLUGIFY = "substr(regexp_replace(regexp_replace(replace(lower(name), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 100)"


@register(f"""WITH n AS (SELECT {_SLUGIFY} AS alias, slug AS canonical_slug, scope_kind, scope_key, min(created_at) AS seq FROM concepts GROUP BY ALL), k AS (SELECT slug AS alias, min(scope_key) AS canonical_slug FROM concepts WHERE retired_at IS NOT NULL GROUP BY 1 UNION ALL SELECT alias, min(canonical_slug) FROM n WHERE substr(alias, 1, 1) < 'c' AND alias NOT IN (SELECT slug FROM concepts) GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY seq, canonical_slug, scope_kind, scope_key) AS r, first_value(canonical_slug) OVER (PARTITION BY alias ORDER BY seq, canonical_slug, scope_kind, scope_key) AS head FROM n)
SELECT f.alias, f.canonical_slug, CASE WHEN f.canonical_slug IN (SELECT alias FROM k) THEN 'chained' WHEN k.alias IS NOT NULL THEN 'conflict' WHEN r = 1 THEN 'recorded' ELSE 'conflict' END AS outcome FROM f LEFT JOIN k ON k.alias = f.alias""")
def alias_records(spark: SparkSession, d: str) -> DataFrame:
    """Names as aliases of their concepts; retired concepts and some names are bound elsewhere already."""
    c = table(spark, d, "concepts")
    n = c.groupBy(T.slug(F.col("name")).alias("alias"), F.col("slug").alias("canonical_slug"), "scope_kind", "scope_key").agg(F.min("created_at").alias("seq"))
    k = c.where("retired_at is not null").groupBy(F.col("slug").alias("alias")).agg(F.min("scope_key").alias("canonical_slug"))
    k = k.unionByName(n.where("substr(alias, 1, 1) < 'c'").join(c.select(F.col("slug").alias("alias")), "alias", "left_anti").groupBy("alias").agg(F.min("canonical_slug").alias("canonical_slug")))
    return folds.record_aliases(n, k.withColumn("scope_kind", F.lit("-")).withColumn("scope_key", F.lit("-"))).select("alias", "canonical_slug", "outcome")


@register(r"""WITH a AS (SELECT slug AS alias, regexp_replace(slug, '-(v?\d+|[a-z]{1,9})$', '') AS canonical, updated_at FROM concepts) SELECT canonical, alias, row_number() OVER (PARTITION BY canonical ORDER BY updated_at DESC, alias) AS place FROM a WHERE alias <> canonical""")
def aliases_of_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of every concept, the latest first; slugs without their last part stand in for the canonical ones."""
    a = table(spark, d, "concepts").select(F.col("slug").alias("alias"), F.regexp_replace("slug", r"-(v?\d+|[a-z]{1,9})$", "").alias("canonical"), "updated_at").where("alias <> canonical")
    return a.select("canonical", "alias", F.row_number().over(W.partitionBy("canonical").orderBy(F.desc("updated_at"), "alias")).cast("long").alias("place"))


#: The relations of the graph.
RELATIONS = ("implements", "extends", "contradicts", "supports", "related", "part-of", "prerequisite", "alternative", "example-of")


@register(f"""WITH k AS (SELECT slug FROM concepts WHERE enrichment_tier <= 3), e AS (SELECT from_slug AS f, to_slug AS t, CASE WHEN relation IN {RELATIONS} THEN relation ELSE 'related' END AS relation, greatest(0.0, least(1.0, CASE WHEN coalesce(weight, 0) = 0 THEN 0.5 ELSE weight END)) AS weight FROM edges)
SELECT f AS from_slug, t AS to_slug, relation, weight FROM e WHERE f <> t AND f IN (SELECT slug FROM k) AND t IN (SELECT slug FROM k)""")
def compiled_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges as a model might give them, cleaned: self-loops, unknown ends and relations, weights out of range."""
    raw = table(spark, d, "edges").select(F.col("from_slug").alias("from"), F.col("to_slug").alias("to"), "relation", "weight")
    return folds.clean_edges(raw, table(spark, d, "concepts").where("enrichment_tier <= 3"), RELATIONS)


@register("""WITH c AS (SELECT DISTINCT source_id, position, id, content FROM chunks WHERE chunk_type <> 'heading' AND length(content) > 20)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY position, id, content) AS place, sha256(content) AS hash FROM c QUALIFY place <= 30""")
def compile_inputs(spark: SparkSession, d: str) -> DataFrame:
    return folds.compile_input(table(spark, d, "chunks")).select("source_id", F.col("place").cast("long").alias("place"), F.sha2("content", 256).alias("hash"))


@register("""WITH c AS (SELECT DISTINCT source_id, position, id, content, heading FROM chunks WHERE chunk_type <> 'heading' AND length(content) > 20),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position, id, content, heading) AS i FROM c QUALIFY i <= 30)
SELECT source_id, sha256(string_agg('[' || i || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY i)) AS prompt FROM n GROUP BY 1""")
def compile_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Numbered chunk blocks of every source, joined by blank lines; by their hash."""
    c = folds.compile_input(table(spark, d, "chunks"))
    part = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]\n"), F.col("content"))
    return c.groupBy("source_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("p")))), lambda x: x["p"]), "\n\n"), 256).alias("prompt"))


_SETTOK = "list_distinct(list_filter(string_split_regex(lower(coalesce(compiled_truth, summary, name, '')), '[^a-z0-9]+'), lambda w: length(w) > 2))"


@register(f"""WITH c AS (SELECT slug, scope_kind, scope_key, {_SETTOK} AS t, score, mention_count, retired_at FROM concepts), e AS (SELECT * FROM c WHERE retired_at IS NULL),
m AS (SELECT i.slug, e.slug AS other FROM c i JOIN e ON e.scope_kind = i.scope_kind AND e.scope_key = i.scope_key AND e.slug <> i.slug WHERE len(i.t) >= 4 AND len(e.t) >= 4 AND 1 - levenshtein(i.slug, e.slug) / greatest(length(i.slug), length(e.slug)) >= 0.7 - 1e-9
  AND len(list_intersect(i.t, e.t)) / (len(i.t) + len(e.t) - len(list_intersect(i.t, e.t))) >= 0.6 - 1e-9 QUALIFY row_number() OVER (PARTITION BY i.slug ORDER BY e.score DESC, e.mention_count DESC, e.slug) = 1)
SELECT c.slug, m.other AS canonical, CASE WHEN m.other IS NOT NULL THEN 'merged' WHEN (SELECT count(*) FROM e WHERE e.scope_kind = c.scope_kind AND e.scope_key = c.scope_key AND e.slug <> c.slug) = 0 THEN 'no_candidates' WHEN len(t) < 4 THEN 'thin_content' ELSE 'below_threshold' END AS reason FROM c LEFT JOIN m USING (slug)""")
def merge_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every concept as if it came in anew, against the other active ones of its scope."""
    c = table(spark, d, "concepts").withColumn("content", F.coalesce("compiled_truth", "summary", "name", F.lit("")))
    return folds.merge_decisions(c, c.where("retired_at is null"))


@register()
def merge_on_write(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that came after the first half, merged in order of arrival; tested against a plain loop."""
    c = table(spark, d, "concepts").where("retired_at is null").withColumn("content", F.coalesce("compiled_truth", "summary", "name", F.lit("")))
    seq = F.unix_micros(F.col("created_at").cast("timestamp"))
    mid = c.agg(F.percentile_approx(seq, 0.5)).first()[0] or 0
    return folds.merge_on_write(c.where(seq <= mid), c.where(seq > mid).select("slug", seq.alias("seq"), "scope_kind", "scope_key", "content"))


@register("""WITH l AS (SELECT from_slug AS slug, source_id FROM edges UNION SELECT to_slug, source_id FROM edges), n AS (SELECT slug, count(DISTINCT source_id) AS s FROM l WHERE source_id IS NOT NULL GROUP BY 1),
t AS (SELECT c.slug, enrichment_tier, enrichment_queued, CASE WHEN mention_count >= 6 AND coalesce(s, 0) >= 3 THEN 1 WHEN mention_count >= 3 AND coalesce(s, 0) >= 2 THEN 2 ELSE 3 END AS tier FROM concepts c LEFT JOIN n USING (slug))
SELECT slug, tier, CASE WHEN tier < enrichment_tier THEN 1 ELSE enrichment_queued END AS queued FROM t""")
def tier_queue(spark: SparkSession, d: str) -> DataFrame:
    """New tiers; concepts whose tier improves are queued."""
    c, e = table(spark, d, "concepts"), table(spark, d, "edges")
    t = folds.tiers(c, e.select(F.col("from_slug").alias("slug"), "source_id").union(e.select("to_slug", "source_id"))).select("slug", "tier")
    return c.join(t, "slug").select("slug", "tier", F.when(F.col("tier") < F.col("enrichment_tier"), 1).otherwise(F.col("enrichment_queued")).alias("queued"))


@register("SELECT slug, 1 AS enrichment_queued FROM concepts")
def queue_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").select("slug", F.lit(1).alias("enrichment_queued"))


@register("""WITH r AS (SELECT session_id, CASE WHEN result_count = 0 THEN 'skipped' ELSE 'extracted' END AS outcome, timestamp, id FROM (SELECT DISTINCT * FROM query_log) WHERE session_id IS NOT NULL),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC, outcome DESC) = 1)
SELECT session_id, outcome, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS reviewed_at FROM u ORDER BY timestamp DESC, session_id LIMIT 30""")
def review_listing(spark: SparkSession, d: str) -> DataFrame:
    """The newest reviews, one row a session; the last call of a session stands in for its review."""
    q = table(spark, d, "query_log").dropDuplicates().where("session_id is not null")
    r = q.select("session_id", F.when(F.col("result_count") == 0, "skipped").otherwise("extracted").alias("outcome"), "timestamp", "id")
    u = folds.latest(r, ["session_id"], "timestamp", "id", "outcome")
    return u.orderBy(F.desc("timestamp"), "session_id").limit(30).select("session_id", "outcome", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reviewed_at"))


@register("""SELECT source_id, slug AS concept_slug, relevance FROM (SELECT source_id, from_slug AS slug, weight AS relevance, relation || '>' || to_slug AS seq FROM edges WHERE source_id IS NOT NULL UNION ALL SELECT source_id, to_slug, weight, relation || '<' || from_slug FROM edges WHERE source_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY source_id, slug ORDER BY seq DESC, relevance DESC) = 1""")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    """Sources of concepts with the relevance given last."""
    e = table(spark, d, "edges").where("source_id is not null")
    out = e.select("source_id", F.col("from_slug").alias("concept_slug"), F.col("weight").alias("relevance"), F.concat("relation", F.lit(">"), "to_slug").alias("seq"))
    back = e.select("source_id", F.col("to_slug").alias("concept_slug"), F.col("weight").alias("relevance"), F.concat("relation", F.lit("<"), "from_slug").alias("seq"))
    return folds.latest(out.unionByName(back), ["source_id", "concept_slug"], "seq", "relevance").select("source_id", "concept_slug", "relevance")


@register("""WITH l AS (SELECT from_slug AS slug, source_id, max(weight) AS relevance FROM edges WHERE source_id IS NOT NULL GROUP BY ALL)
SELECT slug, source_id, coalesce(s.title, source_id) AS title, relevance, row_number() OVER (PARTITION BY slug ORDER BY relevance DESC, source_id) AS place FROM l LEFT JOIN (SELECT id, title FROM sources WHERE source_type <> 'image') s ON s.id = l.source_id""")
def concept_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of every concept by relevance, with the id where a title is missing."""
    l = table(spark, d, "edges").where("source_id is not null").groupBy(F.col("from_slug").alias("slug"), "source_id").agg(F.max("weight").alias("relevance"))
    s = table(spark, d, "sources").where("source_type <> 'image'").select(F.col("id").alias("source_id"), "title")
    w = W.partitionBy("slug").orderBy(F.desc("relevance"), "source_id")
    return l.join(s, "source_id", "left").select("slug", "source_id", F.coalesce("title", "source_id").alias("title"), "relevance", F.row_number().over(w).cast("long").alias("place"))


@register("""SELECT sync_id, max(CASE WHEN sync_id IN (SELECT sync_id FROM sync_journal WHERE op = 'retire') THEN 1 ELSE 0 END) AS marked FROM sync_journal WHERE pushed_at IS NULL GROUP BY 1""")
def bulk_mark(spark: SparkSession, d: str) -> DataFrame:
    """Unpushed changes, with those of an id list marked."""
    j = table(spark, d, "sync_journal")
    ids = j.where("op = 'retire'").select("sync_id").distinct().withColumn("in", F.lit(1))
    return j.where("pushed_at is null").select("sync_id").distinct().join(ids, "sync_id", "left").select("sync_id", F.coalesce("in", F.lit(0)).alias("marked"))


@register("""SELECT sync_id, op, coalesce(nullif(concat_ws(',', CASE WHEN NOT json_valid(payload) THEN 'payload' END, CASE WHEN op = 'feedback' AND json_valid(payload) AND coalesce(json_extract_string(payload, '$.delta'), '') NOT IN ('1', '-1') THEN 'delta' END, CASE WHEN NOT regexp_full_match(sync_id, '[0-9a-f]{12}-[0-9a-f]{20}') THEN 'sync_id' END), ''), 'ok') AS checks FROM (SELECT DISTINCT sync_id, op, payload FROM sync_journal)""")
def row_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery with the checks it fails."""
    j = table(spark, d, "sync_journal").select("sync_id", "op", "payload").distinct()
    whole = F.coalesce(complete_json(F.col("payload")), F.lit(False))
    delta = (F.col("op") == "feedback") & whole & ~F.coalesce(F.get_json_object("payload", "$.delta"), F.lit("")).isin("1", "-1")
    failed = F.concat_ws(",", F.when(~whole, "payload"), F.when(delta, "delta"), F.when(~F.col("sync_id").rlike("^[0-9a-f]{12}-[0-9a-f]{20}$"), "sync_id"))
    return j.select("sync_id", "op", F.when(failed == "", "ok").otherwise(failed).alias("checks"))
