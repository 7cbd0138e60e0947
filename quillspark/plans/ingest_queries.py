"""Registered queries of detection, ingest, feeds and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import detect as X
from quillspark.functions import text as T
from quillspark.operators import ingest as I
from quillspark.plans.registry import register
from quillspark.session import table
from quillspark.sources import files


def sources(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    s = table(spark, d, "sources")
    return s.where(F.col("source_type").isin(*kinds)) if kinds else s


@register(r"""WITH i AS (SELECT url AS given FROM sources WHERE url IS NOT NULL UNION SELECT title FROM sources UNION SELECT replace(url, 'https://papers.example', 'https://arxiv.org') FROM sources WHERE source_type = 'arxiv' UNION SELECT 'https://github.com/' || replace(title, '/', '-') || '/x' FROM sources WHERE source_type = 'code')
SELECT given, CASE WHEN regexp_matches(given, '(?i)youtu\.?be') OR regexp_matches(given, '^[A-Za-z0-9_-]{11}$') THEN 'youtube' WHEN regexp_matches(given, '(?i)arxiv\.org') OR regexp_matches(given, '^\d{4}\.\d{4,5}(v\d+)?$') THEN 'arxiv'
 WHEN regexp_matches(given, '(?i)^git@github\.com:[^/]+/[^/]+?(\.git)?$') OR regexp_matches(given, '(?i)^https?://github\.com/+[^/?#]+/+[^/?#]+/*([?#].*)?$') THEN 'code' WHEN regexp_matches(given, '(?i)^https?://huggingface\.co/datasets/') THEN 'dataset'
 WHEN regexp_matches(given, '(?i)^https?://') THEN CASE WHEN ends_with(lower(given), '.pdf') THEN 'pdf' ELSE 'url' END
 WHEN regexp_matches(lower(given), '\.(csv|tsv|jsonl|ndjson|parquet)$') THEN 'dataset' WHEN regexp_matches(lower(given), '\.(png|jpg|jpeg|gif|webp|bmp|tiff)$') THEN 'image' WHEN ends_with(lower(given), '.pdf') THEN 'pdf' ELSE 'file' END AS kind FROM i""")
def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    given = s.select(F.col("url").alias("given")).where("given is not null").union(s.select("title")).union(s.where("source_type = 'arxiv'").select(F.replace("url", F.lit("https://papers.example"), F.lit("https://arxiv.org"))))
    given = given.union(s.where("source_type = 'code'").select(F.concat(F.lit("https://github.com/"), F.replace("title", F.lit("/"), F.lit("-")), F.lit("/x")))).distinct()
    return given.select("given", X.source_type(F.col("given")).alias("kind"))


_WALL = " OR ".join(f"regexp_matches(content, '{rx}')" for rx in X.PAYWALL)


@register(rf"""WITH t AS (SELECT id, content, length(regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS n FROM sources WHERE source_type = 'url')
SELECT id, (n < 200 AND len(regexp_extract_all(content, '(?i)<script')) > 5) OR (regexp_matches(content, 'id=["''](__next|root|app|__nuxt)["'']') AND n < 500) OR regexp_matches(content, '(?i)<noscript') AS shell, {_WALL} AS wall FROM t""")
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    """Pages that only a script fills, and pages behind a wall."""
    return sources(spark, d, "url").select("id", X.js_shell(F.col("content")).alias("shell"), X.paywall(F.col("content")).alias("wall"))


@register("""WITH s AS (SELECT DISTINCT 200 + latency_ms % 400 AS status FROM query_log WHERE latency_ms IS NOT NULL)
SELECT status, CASE WHEN status IN (401, 403) THEN 'PAYWALL' WHEN status IN (404, 410) THEN 'NOT_FOUND' WHEN status = 429 THEN 'RATE_LIMITED' ELSE 'NETWORK' END AS error, status = 429 OR status >= 500 AS again FROM s""")
def status_errors(spark: SparkSession, d: str) -> DataFrame:
    """Latencies stand in for statuses."""
    s = table(spark, d, "query_log").where("latency_ms is not null").select((200 + F.col("latency_ms") % 400).alias("status")).distinct()
    return s.select("status", X.status_error(F.col("status")).alias("error"), X.retryable(F.col("status")).alias("again"))


def _strip(c: str) -> str:
    for n in X.SKIPPED_ELEMENTS:
        c = f"regexp_replace({c}, '(?is)<{n}[^>]*>.*?</{n}>', '', 'g')"
    return rf"regexp_replace(regexp_replace(replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


_HOST, _PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)", r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@register(rf"""SELECT id, {_strip('content')} AS body, CASE WHEN {_HOST} = '' THEN url ELSE regexp_replace(url_decode(CASE WHEN regexp_extract({_PATH}, '([^/]+)/*$', 1) = '' THEN lower({_HOST}) ELSE regexp_extract({_PATH}, '([^/]+)/*$', 1) END), '[-_]', ' ', 'g') END AS title
FROM sources WHERE source_type = 'url' AND url IS NOT NULL""")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Fallback text of every page, and a title out of its address."""
    return sources(spark, d, "url").where("url is not null").select("id", X.fallback_text(F.col("content")).alias("body"), X.title_from_url(F.col("url")).alias("title"))


@register(r"SELECT id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), ' ') AS content FROM sources WHERE source_type = 'youtube'")
def timed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts written as timed text, line by line, and read back."""
    esc = lambda s: F.replace(F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    xml = F.array_join(F.transform(F.split("content", "\n"), lambda s: F.concat(F.lit('<text start="0">'), esc(s), F.lit("</text>"))), "")
    return sources(spark, d, "youtube").select("id", X.timed_text(xml).alias("content"))


@register(r"""SELECT id, regexp_replace(regexp_extract(replace(url, 'papers.example', 'arxiv.org'), 'arxiv\.org/(?:abs|pdf)/([^\s/?#]+)', 1), '\.pdf$', '') AS paper, regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS title FROM sources WHERE source_type = 'arxiv' AND url IS NOT NULL AND contains(replace(url, 'papers.example', 'arxiv.org'), 'arxiv.org/')""")
def paper_ids(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d, "arxiv").withColumn("u", F.replace("url", F.lit("papers.example"), F.lit("arxiv.org"))).where(F.contains("u", F.lit("arxiv.org/")))
    return s.select("id", F.coalesce(X.paper_id(F.col("u")), F.lit("")).alias("paper"), X.clean_title(F.col("title")).alias("title"))


@register(r"SELECT id, CASE WHEN regexp_matches(url, '(?i)^https?://youtu\.be/') THEN regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) ELSE nullif(regexp_extract(url, '[?&]v=([^&#]*)', 1), '') END AS video FROM (SELECT id, replace(url, 'video.', 'youtube.com.') AS url FROM sources WHERE source_type = 'youtube' AND url IS NOT NULL) WHERE contains(lower(url), 'youtube.com')")
def video_ids(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d, "youtube").select("id", F.replace("url", F.lit("video."), F.lit("youtube.com.")).alias("u")).where(F.contains(F.lower("u"), F.lit("youtube.com")))
    return s.select("id", X.video_id(F.col("u")).alias("video"))


def _sig(language: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(content, '{rx}', 1)" for rx in X.SIGNATURES[language]) + ")" if len(X.SIGNATURES[language]) > 1 else ""


_FIRST = "list_transform(list_sort(list_transform(list_distinct({0}), lambda t: list_position({0}, t))), lambda p: ({0})[p])[1:40]"


@register("WITH c AS (SELECT id, lower(language) AS language, content FROM sources WHERE source_type = 'code'), f AS (SELECT id, CASE language " + " ".join(f"WHEN '{k}' THEN {_sig(k)}" for k in ("python", "javascript", "typescript", "go", "rust", "ruby")) + f" ELSE [] END AS x FROM c) SELECT id, array_to_string({_FIRST.format('x')}, ' ') AS names FROM f")
def code_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Declared names of every code source in its language."""
    return sources(spark, d, "code").select("id", F.array_join(X.signatures(F.col("content"), F.coalesce(F.lower("language"), F.lit(""))), " ").alias("names"))


@register("""WITH n AS (SELECT lower(language) AS language, count(*) AS files FROM sources WHERE source_type = 'code' AND language IS NOT NULL GROUP BY 1), t AS (SELECT sum(files) AS total FROM n)
SELECT language, files, round(files / total, 9) AS share FROM n, t WHERE files >= least(50, ceil(total * 0.05))""")
def code_languages(spark: SparkSession, d: str) -> DataFrame:
    s = I.language_shares(sources(spark, d, "code").select(F.lower("language").alias("language")))
    return s.select("language", "files", F.round("share", 9).alias("share"))


_CASES = ("git@Host.example:Own/Repo.git", "https://user:pw@Host.example:443/Own/Repo.git/?a=1#b", "ssh://git@host.example/own/repo", "C:\\\\dir\\\\x", "not a remote", "http://host.example:8080//own/repo///", "host.example:own/repo")


@register("SELECT * FROM (VALUES ('git@Host.example:Own/Repo.git', 'https://host.example/own/repo'), ('https://user:pw@Host.example:443/Own/Repo.git/?a=1#b', 'https://host.example/own/repo.git'), ('ssh://git@host.example/own/repo', 'https://host.example/own/repo'), ('C:\\\\dir\\\\x', NULL), ('not a remote', NULL), ('http://host.example:8080//own/repo///', 'https://host.example:8080/own/repo'), ('host.example:own/repo', 'https://host.example/own/repo')) t(remote, url)")
def remote_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Remotes of every accepted spelling, with what each must come out as."""
    return spark.createDataFrame([(x,) for x in _CASES], "remote string").select("remote", X.git_remote(F.col("remote")).alias("url"))


@register(r"""WITH r AS (SELECT tool_name, query_text FROM query_log WHERE query_text IS NOT NULL ORDER BY tool_name, query_text LIMIT 20)
SELECT 0 AS part, '# Calls' AS line UNION ALL SELECT 1, '| column | type | nulls |' UNION ALL SELECT 3, '| tool_name | query_text |' UNION ALL SELECT 2, '| tool_name | string | 0 |' UNION ALL SELECT 2, '| query_text | string | 0 |'
UNION ALL SELECT 4, '| ' || regexp_replace(replace(substr(tool_name, 1, 120), '|', chr(92) || '|'), '\s+', ' ', 'g') || ' | ' || regexp_replace(replace(substr(query_text, 1, 120), '|', chr(92) || '|'), '\s+', ' ', 'g') || ' |' FROM r""")
def dataset_card(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_log").where("query_text is not null").select("tool_name", "query_text")
    return I.dataset_card(q, files.infer_types(q), "Calls")


@register("WITH f AS (SELECT scope_kind, scope_key, title AS name, min(content) AS content FROM sources WHERE source_type IN ('file', 'folder') GROUP BY ALL) SELECT scope_kind, scope_key, sha256(string_agg('## ' || name || chr(10) || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY name)) AS hash, CAST(count(*) AS BIGINT) AS files FROM f GROUP BY ALL")
def folder_documents(spark: SparkSession, d: str) -> DataFrame:
    """The texts of a scope as one document of sections; by its hash."""
    f = sources(spark, d, "file", "folder").groupBy("scope_kind", "scope_key", F.col("title").alias("name")).agg(F.min("content").alias("content"))
    n = f.groupBy("scope_kind", "scope_key").agg(F.count("*").alias("files"))
    return I.folder_document(f, "scope_kind", "scope_key").join(n, ["scope_kind", "scope_key"]).select("scope_kind", "scope_key", F.sha2("content", 256).alias("hash"), "files")


@register(r"""WITH f AS (SELECT scope_kind, scope_key, title AS path, lower(language) AS language, min(content) AS content FROM sources WHERE source_type = 'code' AND octet_length(encode(content)) <= 50000 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY CASE WHEN regexp_matches(lower(path), '(^|/)readme[^/]*$|\.(md|rst|txt)$') THEN 0 ELSE 1 END, path, language NULLS FIRST) AS n FROM f),
l AS (SELECT scope_kind, scope_key, language FROM (SELECT scope_kind, scope_key, language, count(*) AS c FROM f WHERE language IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scope_kind, scope_key ORDER BY c DESC, language) = 1)
SELECT scope_kind, scope_key, count(*) AS files, any_value(l.language) AS language, sha256(string_agg('## ' || path || chr(10) || chr(10) || '```' || coalesce(o.language, '') || chr(10) || content || chr(10) || '```', chr(10) || chr(10) ORDER BY n)) AS hash FROM o LEFT JOIN l USING (scope_kind, scope_key) GROUP BY ALL""")
def repository_documents(spark: SparkSession, d: str) -> DataFrame:
    """The code of a scope as one document with its main language; by its hash."""
    f = sources(spark, d, "code").where(F.octet_length("content") <= 50_000).groupBy("scope_kind", "scope_key", F.col("title").alias("path"), F.lower("language").alias("language")).agg(F.min("content").alias("content"))
    return I.repository_document(f, "scope_kind", "scope_key").select("scope_kind", "scope_key", "files", "language", F.sha2("content", 256).alias("hash"))


_FEED = "SELECT scope_key AS feed, row_number() OVER (PARTITION BY scope_key ORDER BY added_at, id) - 1 AS place, id AS entry_id, title, content, added_at FROM sources WHERE source_type IN ('url', 'arxiv')"


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a scope written as an Atom feed, in order of arrival."""
    esc = lambda c: F.replace(F.replace(c, F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))
    e = F.concat(F.lit("<entry><id>http://x/"), F.col("id"), F.lit("v3</id><title>\n "), esc(F.col("title")), F.lit("</title><published>"), F.date_format("added_at", "yyyy-MM-dd"), F.lit("</published><summary>"), esc(F.col("content")), F.lit("</summary></entry>"))
    s = sources(spark, d, "url", "arxiv").select(F.col("scope_key").alias("feed"), F.struct("added_at", "id", e.alias("e")).alias("x"))
    return s.groupBy("feed").agg(F.concat(F.lit("<feed>"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), ""), F.lit("</feed>")).alias("xml"))


@register(rf"""WITH f AS ({_FEED}) SELECT feed, place, entry_id, regexp_replace(regexp_replace(replace(replace(title, '<', '('), '>', ')'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS title, strftime(added_at, '%Y-%m-%d') AS published, length(regexp_replace(content, '^\s+|\s+$', '', 'g')) AS chars FROM f""")
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    return I.feed_entries(_feeds(spark, d)).select("feed", "place", "entry_id", "title", "published", F.length("body").alias("chars"))


@register(rf"""WITH f AS ({_FEED}), seen AS (SELECT feed, entry_id FROM f WHERE place % 3 = 0) SELECT feed, entry_id FROM f WHERE (feed, entry_id) NOT IN (SELECT feed, entry_id FROM seen) AND regexp_replace(content, '\s+', '', 'g') <> ''""")
def new_feed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entries not seen before that have a text; every third counts as seen."""
    e = I.feed_entries(_feeds(spark, d))
    fresh = I.new_entries(e.unionByName(e.withColumn("place", F.col("place") + 1000)), e.where("place % 3 = 0"))
    return I.entry_documents(fresh.withColumn("article", F.lit(None).cast("string"))).select("feed", "entry_id")


@register(f"""WITH f AS ({_FEED}), u AS (SELECT feed, 0 AS age, place, entry_id FROM f WHERE place >= 4 UNION ALL SELECT feed, 1, place, entry_id FROM f WHERE place < 6), m AS (SELECT feed, entry_id, min(age * 100000 + place) AS ord FROM u GROUP BY ALL),
r AS (SELECT feed, entry_id, row_number() OVER (PARTITION BY feed ORDER BY ord, entry_id) - 1 AS place FROM m) SELECT * FROM r WHERE place < 8""")
def feed_seen_ids(spark: SparkSession, d: str) -> DataFrame:
    e = I.feed_entries(_feeds(spark, d))
    return I.seen_ids(e.where("place >= 4"), e.where("place < 6"), 8).select("feed", "entry_id", F.col("place").cast("long").alias("place"))


@register("""WITH n AS (SELECT id AS path, max(epoch_us(added_at)) AS mtime FROM sources GROUP BY id), b AS (SELECT path, CASE WHEN mtime % 2 = 0 THEN mtime ELSE mtime - 1 END AS was FROM n WHERE substr(path, 1, 1) < 'c'),
c AS (SELECT n.path, mtime FROM n LEFT JOIN b USING (path) WHERE was IS NULL OR was <> mtime ORDER BY path LIMIT 100)
SELECT path, mtime, 'changed' AS part FROM c UNION ALL SELECT path, mtime, 'state' FROM c UNION ALL SELECT n.path, was, 'state' FROM n JOIN b USING (path) WHERE n.path NOT IN (SELECT path FROM c)""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose time differs from the state before, at most 100 a pull, and the state after."""
    now = sources(spark, d).groupBy(F.col("id").alias("path")).agg(F.max(F.unix_micros(F.col("added_at").cast("timestamp"))).alias("mtime"))
    before = now.where("substr(path, 1, 1) < 'c'").select("path", (F.col("mtime") - F.col("mtime") % 2).alias("mtime"))
    gone = spark.createDataFrame([("zz-gone", 1)], "path string, mtime long")
    changed, state = I.changed_files(now, before.unionByName(gone), 100)
    return changed.withColumn("part", F.lit("changed")).unionByName(state.withColumn("part", F.lit("state")))


@register("""WITH r AS (SELECT scope_key AS id, epoch_us(timestamp) AS us, id AS seq, query_text AS state, CASE WHEN result_count = 0 THEN 'empty' END AS error FROM (SELECT DISTINCT * FROM query_log) WHERE scope_key IS NOT NULL AND query_text IS NOT NULL),
c AS (SELECT DISTINCT key AS id FROM scopes), g AS (SELECT id, state FROM r WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY us DESC, seq DESC) = 1), e AS (SELECT id, us, error FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY us DESC, seq DESC) = 1)
SELECT c.id, coalesce(g.state, '-') AS state, e.us AS last_run_at, e.error AS last_error FROM c LEFT JOIN g USING (id) LEFT JOIN e USING (id)""")
def connector_runs(spark: SparkSession, d: str) -> DataFrame:
    """Calls stand in for runs of the connectors of their scopes: one without results failed; the state is the text of the last success."""
    q = table(spark, d, "query_log").dropDuplicates().where("scope_key is not null and query_text is not null")
    runs = q.select(F.col("scope_key").alias("id"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.col("id").alias("seq"), F.col("query_text").alias("state"), F.when(F.col("result_count") == 0, "empty").alias("error"))
    base = table(spark, d, "scopes").select(F.col("key").alias("id"), F.lit("-").alias("state"), F.lit(None).cast("long").alias("last_run_at"), F.lit(None).cast("string").alias("last_error")).distinct()
    return I.connector_runs(base, runs)


@register("""WITH c AS (SELECT kind, key, max(last_seen_at) AS last_run_at FROM scopes GROUP BY ALL), m AS (SELECT max(last_run_at) AS now FROM c), x AS (SELECT kind || ':' || key AS id, CASE WHEN kind = 'personal' THEN NULL ELSE last_run_at END AS last_run_at FROM c)
SELECT id, row_number() OVER (ORDER BY last_run_at NULLS FIRST, id) AS place FROM x, m WHERE last_run_at IS NULL OR floor((epoch_us(now) - epoch_us(last_run_at)) / 1000000) >= 86400""")
def due_connectors(spark: SparkSession, d: str) -> DataFrame:
    """Scopes stand in for connectors with an interval of a day; places show the order, those never run first."""
    from pyspark.sql import Window as W

    c = table(spark, d, "scopes").groupBy("kind", "key").agg(F.max("last_seen_at").alias("last_run_at"))
    now = c.agg(F.max("last_run_at").alias("now"))  # one row
    x = c.crossJoin(F.broadcast(now)).select(F.concat_ws(":", "kind", "key").alias("id"), F.when(F.col("kind") != "personal", F.col("last_run_at")).alias("last_run_at"), F.lit(86400).alias("interval_seconds"), "now")
    return I.due(x, F.col("now")).select("id", F.row_number().over(W.orderBy(F.asc_nulls_first("last_run_at"), "id")).cast("long").alias("place"))  # connectors are few


_TRAJ = "t AS (SELECT id, content, CAST(json_extract(content, '$.steps') AS JSON[]) AS st FROM sources WHERE source_type = 'trajectory' AND json_valid(content))"


@register(f"WITH {_TRAJ} SELECT id, CASE WHEN coalesce(len(st), 0) < 1 THEN 'no_steps' WHEN len(st) > 50 THEN 'too_many_steps' WHEN octet_length(encode(content)) > 262144 THEN 'too_large' END AS reason, coalesce(len(st), 0) AS steps FROM t")
def trajectory_checks(spark: SparkSession, d: str) -> DataFrame:
    return I.validated(I.trajectories(sources(spark, d, "trajectory"))).select("id", "reason", F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("steps"))


_ARGS = "array_to_string(list_transform(json_keys(x, '$.args'), lambda k: k || '=' || json_extract_string(x, '$.args.\"' || k || '\"')), ' ')"
_SUM = "coalesce(json_extract_string(x, '$.result_summary'), '')"


@register(f"""WITH {_TRAJ}, s AS (SELECT id, unnest(st) AS x FROM t WHERE len(st) BETWEEN 1 AND 50),
b AS (SELECT id, CAST(json_extract_string(x, '$.n') AS BIGINT) AS n, json_extract_string(x, '$.tool') AS tool, {_ARGS} AS args, CASE WHEN length({_SUM}) > 500 THEN substr({_SUM}, 1, 497) || '...' ELSE {_SUM} END AS summary, json_extract_string(x, '$.result_ok') AS ok FROM s)
SELECT id AS source_id, CAST(0 AS BIGINT) AS position, 'Trajectory summary' AS heading, 'Task: ' || coalesce(json_extract_string(content, '$.task'), '') || chr(10) || 'Outcome: ' || coalesce(json_extract_string(content, '$.outcome'), '') || chr(10) || 'Agent: ' || coalesce(json_extract_string(content, '$.agent'), '') || chr(10) || 'Steps: ' || len(st) AS content FROM t WHERE len(st) BETWEEN 1 AND 50
UNION ALL SELECT id, n + 1, 'Step ' || n || ': ' || tool, 'step ' || n || ': ' || tool || '(' || CASE WHEN length(coalesce(args, '')) > 200 THEN substr(args, 1, 197) || '...' ELSE coalesce(args, '') END || ')' || chr(10) || 'result: ' || CASE WHEN ok = 'true' THEN 'ok' ELSE 'error' END || ' - ' || summary FROM b""")
def trajectory_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.trajectory_chunks(I.validated(I.trajectories(sources(spark, d, "trajectory")))).select("source_id", "position", "heading", "content")


@register("""WITH b AS (SELECT id, content_hash, scope_kind FROM sources WHERE substr(id, 1, 1) < '8'), n AS (SELECT id, content_hash, added_at, CASE WHEN substr(id, 2, 1) = '0' THEN NULL ELSE scope_kind END AS scope_kind, CASE WHEN substr(id, 2, 1) IN ('0', '1') THEN NULL ELSE scope_key END AS scope_key FROM sources WHERE substr(id, 1, 1) >= '8'),
f AS (SELECT * FROM n WHERE (scope_kind IS NULL) = (scope_key IS NULL) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY added_at, id) = 1)
SELECT id, scope_kind, 'kept' AS outcome FROM b UNION ALL SELECT id, coalesce(scope_kind, 'personal'), 'kept' FROM f WHERE content_hash NOT IN (SELECT content_hash FROM b) UNION ALL SELECT id, scope_kind, 'rejected' FROM n WHERE (scope_kind IS NULL) <> (scope_key IS NULL)""")
def source_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Half of the sources added to the other half; some without scope, some with half a scope."""
    s = sources(spark, d)
    base, new, second = s.where("substr(id, 1, 1) < '8'"), s.where("substr(id, 1, 1) >= '8'"), F.substring("id", 2, 1)
    new = new.withColumn("scope_kind", F.when(second != "0", F.col("scope_kind"))).withColumn("scope_key", F.when(~second.isin("0", "1"), F.col("scope_key")))
    kept = I.insert_sources(base, new).select("id", "scope_kind", F.lit("kept").alias("outcome"))
    return kept.unionByName(I.rejected_sources(new).select("id", "scope_kind", F.lit("rejected").alias("outcome")))


@register("SELECT DISTINCT source_id, position, substr(sha256(source_id || ':' || position || ':' || content), 1, 12) AS id FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return I.chunk_rows(table(spark, d, "chunks").select("source_id", "position", "content")).select("source_id", "position", "id").distinct()


@register(r"SELECT DISTINCT query_text, CASE WHEN regexp_full_match(w, '\d+[dhms]') THEN CAST(regexp_extract(w, '\d+') AS BIGINT) * CASE right(w, 1) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END END AS seconds FROM (SELECT query_text, (id % 90) || substr('dhmsx', CAST(id % 5 + 1 AS INT), 1) AS w, w AS x FROM (SELECT *, 1 AS w FROM query_log) WHERE query_text IS NOT NULL)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """Ids stand in for spelled durations."""
    q = table(spark, d, "query_log").where("query_text is not null")
    w = F.concat((F.col("id") % 90).cast("string"), F.substring(F.lit("dhmsx"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)))
    return q.select("query_text", X.duration_seconds(w).alias("seconds")).distinct()


_KNOWN = ("python", "yaml", "rust", "shell", "go")


@register(f"""WITH c AS (SELECT scope_key, lower(language) AS language FROM sources WHERE source_type = 'code' AND language IS NOT NULL), n0 AS (SELECT scope_key, language, count(*) AS n FROM c GROUP BY scope_key, language), n AS (SELECT *, sum(n) OVER (PARTITION BY scope_key) AS total FROM n0)
SELECT DISTINCT scope_key AS root, 'codebase' AS kind, scope_key AS key FROM c UNION SELECT scope_key, 'framework', language FROM c WHERE language IN {_KNOWN} UNION SELECT scope_key, 'language', language FROM n WHERE n >= least(50, ceil(total * 0.05))""")
def scope_list(spark: SparkSession, d: str) -> DataFrame:
    """Every code base with its frameworks and languages as scopes; a list of its languages stands in for its manifest."""
    c = sources(spark, d, "code").where("language is not null").select(F.col("scope_key").alias("root"), F.lower("language").alias("language"))
    m = c.groupBy("root").agg(F.array_join(F.transform(F.collect_set("language"), lambda x: F.concat(x, F.lit("==1.0"))), "\n").alias("text"))
    f = m.select("root", F.lit("framework").alias("kind"), F.explode(X.frameworks(F.lit("requirements.txt"), F.col("text"), _KNOWN)).alias("key"))
    n = c.groupBy("root", "language").agg(F.count("*").alias("n"))
    total = n.groupBy("root").agg(F.sum("n").alias("total"))
    l = n.join(total, "root").where(F.col("n") >= F.least(F.lit(50), F.ceil(F.col("total") * 0.05))).select("root", F.lit("language").alias("kind"), F.col("language").alias("key"))
    return c.select("root", F.lit("codebase").alias("kind"), F.col("root").alias("key")).unionByName(f).unionByName(l).distinct()


@register("WITH f AS (SELECT scope_key, title AS name, min(content) AS content FROM sources WHERE source_type = 'code' GROUP BY ALL) SELECT scope_key, substr(sha1(string_agg(name || ':' || substr(sha1(content), 1, 16), '|' ORDER BY name)), 1, 16) AS key FROM f GROUP BY 1")
def codebase_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of every code base by the fingerprint of its files."""
    f = sources(spark, d, "code").groupBy("scope_key", F.col("title").alias("name")).agg(F.min("content").alias("content"))
    files_ = f.groupBy("scope_key").agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("files"))
    return files_.select("scope_key", X.codebase_key(X.fingerprint(F.col("files"))).alias("key"))


@register("SELECT id, sha256('# ' || title || chr(10) || chr(10) || coalesce('Source: ' || url || chr(10) || chr(10), '') || content) AS document FROM sources")
def issue_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sources sent in base64, decoded and rendered with a heading; by their hash."""
    s = sources(spark, d).withColumn("sent", F.base64(F.encode("content", "UTF-8")))
    text = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce(F.concat(F.lit("Source: "), F.col("url"), F.lit("\n\n")), F.lit("")), F.decode(F.unbase64("sent"), "UTF-8"))
    return s.select("id", F.sha2(text, 256).alias("document"))


@register("WITH u AS (SELECT source_id AS id, max(embedded_at) AS at FROM chunks WHERE embedded_at IS NOT NULL GROUP BY 1) SELECT s.id, epoch_us(coalesce(u.at, s.compiled_at)) AS compiled FROM sources s LEFT JOIN u USING (id)")
def compiled_flags(spark: SparkSession, d: str) -> DataFrame:
    """Sources marked compiled at the last time that one of their chunks tells."""
    from quillspark.operators.folds import latest

    u = latest(table(spark, d, "chunks").where("embedded_at is not null").select(F.col("source_id").alias("id"), F.col("embedded_at").alias("at")), ["id"], "at")
    return sources(spark, d).join(u, "id", "left").select("id", F.unix_micros(F.coalesce("at", "compiled_at").cast("timestamp")).alias("compiled"))
