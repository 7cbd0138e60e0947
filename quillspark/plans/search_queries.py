"""Registered retrieval queries: the whole texts of every 20th evaluation item, and the texts of every 20th call, against all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.plans.porter_sql import porter_ctes
from quillspark.plans.registry import register
from quillspark.session import file_stamp, table

_INDEXES: dict[tuple[str, str], R.ChunkIndex] = {}


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").withColumnRenamed("id", "chunk_id")


def chunk_index(spark: SparkSession, d: str) -> R.ChunkIndex:
    """The index of the chunk table, built once an application for the files as they are."""
    key = (spark.sparkContext.applicationId, file_stamp(spark, f"{d}/chunks.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = R.ChunkIndex(chunk_rows(spark, d).select("chunk_id", "content"))
    return _INDEXES[key]


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).select("chunk_id", "token_count").distinct().groupBy("chunk_id").agg(F.min("token_count").alias("tokens"))


def item_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def call_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").where("id % 20 = 0 and query_text is not null").select(F.col("id").alias("query_id"), F.col("query_text").alias("text")).distinct()


_CH = "c AS (SELECT DISTINCT id AS chunk_id, content, source_id, token_count, heading FROM chunks)"
_TOK = "list_filter(string_split_regex(lower(replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' ')), '[^a-z0-9]+'), lambda w: length(w) >= 2)"
_PLAIN = f"list_filter(string_split_regex(translate(lower({{0}}), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: w <> '')"
_ITEMS = "iq AS (SELECT item_id AS query_id, text FROM eval_items WHERE item_id % 20 = 0)"
_CALLS = "iq AS (SELECT DISTINCT id AS query_id, query_text AS text FROM query_log WHERE id % 20 = 0 AND query_text IS NOT NULL)"


def _tfidf(queries: str) -> str:
    return f"""{_CH}, {queries},
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TOK.format('content')}) AS term FROM c) GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format('text')}) AS term FROM iq) GROUP BY ALL),
idf AS (SELECT term, ln((SELECT count(*) FROM c WHERE content IS NOT NULL) / count(*)) AS idf FROM p GROUP BY term),
nrm AS (SELECT chunk_id, sqrt(sum(pow(1 + ln(tf), 2))) AS norm FROM p GROUP BY chunk_id),
qw AS (SELECT query_id, q.term, idf, (1 + ln(qtf)) * idf AS w FROM q JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(w * (1 + ln(tf)) * idf) AS dot FROM qw JOIN p USING (term) GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, dot / (norm * qnorm) AS score FROM dots JOIN nrm USING (chunk_id) JOIN qn USING (query_id) WHERE qnorm > 0),
tf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc)"""


def _bm25(queries: str, limit: int = 20) -> str:
    """Words between blanks, each a phrase of stems at neighbouring places."""
    vocabulary = f"SELECT unnest({_PLAIN.format('content')}) AS term FROM chunks UNION ALL SELECT unnest({_PLAIN.format('text')}) FROM iq"
    return f"""{_CH}, {queries}, {porter_ctes(vocabulary)},
tk AS (SELECT chunk_id, {_PLAIN.format('content')} AS ts FROM c WHERE content IS NOT NULL),
ps AS (SELECT chunk_id, stem AS term, pos FROM (SELECT chunk_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM tk) JOIN stems USING (term)),
wd AS (SELECT query_id, unnest(string_split_regex(text, '\\s+')) AS word, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS phrase FROM iq),
q AS (SELECT query_id, phrase, size, off, stem AS term FROM (SELECT query_id, phrase, len({_PLAIN.format('word')}) AS size, unnest({_PLAIN.format('word')}) AS term, generate_subscripts({_PLAIN.format('word')}, 1) AS off FROM wd) JOIN stems USING (term)),
hs AS (SELECT query_id, phrase, chunk_id, size, pos - off AS start, count(DISTINCT off) AS have FROM q JOIN ps USING (term) GROUP BY ALL),
h0 AS (SELECT query_id, phrase, chunk_id, count(*) AS f FROM hs WHERE have = size GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM tk),
idf AS (SELECT query_id, phrase, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM h0, st GROUP BY query_id, phrase, n),
h AS (SELECT query_id, chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len(ts) / av))), 9) AS raw, count(*) AS got FROM h0 JOIN idf USING (query_id, phrase) JOIN tk USING (chunk_id), st GROUP BY ALL),
bm0 AS (SELECT query_id, chunk_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM h JOIN (SELECT query_id, count(DISTINCT phrase) AS wanted FROM q GROUP BY 1) USING (query_id) WHERE got = wanted),
bm AS (SELECT *, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 0.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS score FROM bm0 WHERE rank <= {limit} WINDOW w AS (PARTITION BY query_id))"""


_FUSED = f"""a AS (WITH {_tfidf(_CALLS)} SELECT query_id, chunk_id, rank, 1 AS s, score FROM tf WHERE rank <= 20), b AS (WITH {_bm25(_CALLS)} SELECT query_id, chunk_id, rank, 0 AS s, score FROM bm WHERE rank <= 20),
u AS (SELECT query_id, chunk_id, sum(0.5 / (60 + rank)) AS rrf, min(s * 1000 + rank) AS o, max(CASE WHEN s = 0 THEN score END) AS bm25, max(CASE WHEN s = 1 THEN score END) AS tfidf FROM (SELECT * FROM b UNION ALL SELECT * FROM a) GROUP BY ALL),
r AS (SELECT query_id, chunk_id, rrf, bm25, tfidf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, o, chunk_id) AS rank FROM u)"""


@register(f"WITH {_tfidf(_ITEMS)} SELECT query_id, chunk_id, coalesce(title, source_id) AS title, round(score, 6) AS score, rank FROM tf JOIN c USING (chunk_id) LEFT JOIN (SELECT id, title FROM sources) s ON s.id = c.source_id WHERE rank <= 10")
def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    hits = R.tfidf(chunk_index(spark, d), item_queries(spark, d), 10)
    titled = chunk_rows(spark, d).select("chunk_id", "source_id").distinct().join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "title"), "source_id", "left")
    return hits.join(titled, "chunk_id").select("query_id", "chunk_id", F.coalesce("title", "source_id").alias("title"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _bm25_rows(h: DataFrame) -> DataFrame:
    return h.select("query_id", "chunk_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"WITH {_bm25(_CALLS)} SELECT query_id, chunk_id, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM bm")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed, every word of the call's text must occur."""
    return _bm25_rows(R.bm25(chunk_index(spark, d), call_queries(spark, d), 20))


_PHRASES = f"iq AS (SELECT item_id AS query_id, ts[2] || '-' || ts[3] || ' ' || ts[5] AS text FROM (SELECT item_id, {_PLAIN.format('text')} AS ts FROM eval_items) WHERE len(ts) > 5)"


@register(f"WITH {_bm25(_PHRASES)} SELECT query_id, chunk_id, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM bm")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Two neighbouring words of every item as a phrase, with a word that follows."""
    ts = T.plain_tokens(F.col("text"))
    q = table(spark, d, "eval_items").where(F.size(ts) > 5).select(F.col("item_id").alias("query_id"), F.concat(ts[1], F.lit("-"), ts[2], F.lit(" "), ts[4]).alias("text"))
    return _bm25_rows(R.bm25(chunk_index(spark, d), q, 20))


@register(f"WITH {_FUSED} SELECT query_id, chunk_id, round(rrf, 9) AS rrf, round(bm25, 6) AS bm25, round(tfidf, 6) AS tfidf, rank FROM r WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Both signals over-fetch twice the limit; weights .5 / .5."""
    f = R.hybrid(chunk_index(spark, d), call_queries(spark, d), 10)
    return f.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.round(F.col("signals")["bm25"], 6).alias("bm25"), F.round(F.col("signals")["tfidf"], 6).alias("tfidf"), F.col("rank").cast("long").alias("rank"))


_AROUND = """CASE WHEN term IS NULL THEN substr(content, 1, 200) ELSE (CASE WHEN lo > 0 THEN '...' ELSE '' END) || replace(substr(content, lo + 1, hi - lo), chr(10), ' ') || (CASE WHEN hi < length(content) THEN '...' ELSE '' END) END"""


@register(f"""WITH {_FUSED}, {_CH}, {_CALLS}, j AS (SELECT r.query_id, rank, r.chunk_id, c.source_id, coalesce(s.title, c.source_id) AS title, heading, content, rrf, list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '' AND contains(lower(content), t))[1] AS term FROM r JOIN c USING (chunk_id) JOIN iq USING (query_id) LEFT JOIN (SELECT id, title FROM sources) s ON s.id = c.source_id WHERE rank <= 10),
k AS (SELECT *, greatest(0, instr(lower(content), term) - 81) AS lo, least(length(content), instr(lower(content), term) + 119) AS hi FROM j)
SELECT query_id, rank, chunk_id, source_id, title, heading, {_AROUND} AS snippet, round(rrf, 9) AS score FROM k""")
def search(spark: SparkSession, d: str) -> DataFrame:
    """The joined result: title, heading and snippet of every hit."""
    r = R.search(chunk_rows(spark, d).select("chunk_id", "content", "source_id", "heading"), table(spark, d, "sources").select("id", "title"), call_queries(spark, d), 10, index=chunk_index(spark, d))
    return r.withColumn("score", F.round("score", 9)).withColumn("rank", F.col("rank").cast("long"))


_PICKED = f"""{_tfidf(_ITEMS)}, hh AS (SELECT query_id, chunk_id, score, token_count AS tokens FROM tf JOIN c USING (chunk_id) WHERE rank <= 20),
ls AS (SELECT query_id, list(struct_pack(d := -score / greatest(tokens, 1), chunk_id := chunk_id, tokens := tokens) ORDER BY -score / greatest(tokens, 1), chunk_id) AS xs FROM hh GROUP BY 1),
rec AS (SELECT query_id, xs, CAST(0 AS BIGINT) AS i, CAST(1000 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS chunk_id, CAST(NULL AS BIGINT) AS tokens FROM ls
 UNION ALL SELECT query_id, xs, i + 1, CASE WHEN rest > 0 AND xs[i + 1].tokens <= rest THEN rest - xs[i + 1].tokens ELSE rest END, CASE WHEN rest > 0 AND xs[i + 1].tokens <= rest THEN place + 1 ELSE place END,
 CASE WHEN rest > 0 AND xs[i + 1].tokens <= rest THEN xs[i + 1].chunk_id END, xs[i + 1].tokens FROM rec WHERE i < len(xs))"""


@register(f"WITH RECURSIVE {_PICKED} SELECT query_id, chunk_id, tokens, place FROM rec WHERE chunk_id IS NOT NULL")
def budget_select(spark: SparkSession, d: str) -> DataFrame:
    """Greedy by density within 1 000 tokens."""
    h = R.tfidf(chunk_index(spark, d), item_queries(spark, d), 20).join(token_counts(spark, d), "chunk_id")
    return R.select_by_budget(h.select("query_id", "chunk_id", "score", "tokens"), 1000).withColumn("place", F.col("place").cast("long"))


@register(f"""WITH RECURSIVE {_PICKED}, al AS (SELECT query_id, 'C' || place AS alias, chunk_id FROM rec WHERE chunk_id IS NOT NULL), n AS (SELECT query_id, count(*) AS n FROM al GROUP BY 1)
SELECT query_id, CASE WHEN query_id % 40 = 0 THEN 'no_evidence' WHEN query_id % 60 = 0 OR n < 2 THEN 'uncertain' ELSE 'answered' END AS verdict, CAST(least(n, 2) AS BIGINT) AS citations, (SELECT sha256(content) FROM c JOIN al USING (chunk_id) WHERE al.query_id = n.query_id AND alias = 'C1') AS first FROM n""")
def ask_checked(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every item within the budget, and answers as a model might give them, checked: they cite C1, C2 and an unknown alias."""
    h = R.tfidf(chunk_index(spark, d), item_queries(spark, d), 20).join(token_counts(spark, d), "chunk_id")
    e = R.evidence(h.select("query_id", "chunk_id", "score", "tokens"), 1000)
    content = chunk_rows(spark, d).select("chunk_id", "content").join(e.select("chunk_id").distinct(), "chunk_id", "left_semi").distinct()
    cite = lambda m, a: F.struct(F.lit(m).alias("marker"), F.lit(a).alias("chunk_id"), F.lit("").alias("quote"))
    q = F.col("query_id")
    answers = e.select("query_id").distinct().select("query_id", F.concat(F.lit("So it is [1] and [2]"), F.when(q % 60 == 0, " and [9].").otherwise(".")).alias("answer"),
                                                     F.when(q % 40 == 0, "no_evidence").otherwise("answered").alias("verdict"), F.array(cite("1", "C1"), cite(" 2 ", "C2"), cite("9", "C999"), cite("", "C1")).alias("citations"))
    a, c = R.checked_answers(answers, e.join(content, "chunk_id").select("query_id", "alias", "chunk_id", "content"))
    whole = c.join(content, "chunk_id").groupBy("query_id").agg(F.count("*").alias("citations"), F.max(F.when(F.col("marker") == "1", F.sha2("content", 256))).alias("first"))
    return a.join(whole, "query_id").select("query_id", "verdict", "citations", "first")


@register(f"""WITH {_tfidf(_ITEMS)}, r AS (SELECT query_id, chunk_id, rank, sum(CASE WHEN coalesce(token_count, 0) = 0 THEN 100 ELSE token_count END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM tf JOIN c USING (chunk_id) WHERE rank <= 20)
SELECT query_id, chunk_id, rank, CAST(used AS BIGINT) AS used FROM r WHERE used <= 1000 OR rank = 1""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    h = R.tfidf(chunk_index(spark, d), item_queries(spark, d), 20).join(token_counts(spark, d), "chunk_id")
    return R.prefix_budget(h, 1000).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "used")


@register("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, greatest(0, 1 - (1 - list_cosine_similarity(qe, CAST(embedding AS DOUBLE[]))) / 2) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest_vectors(e, q, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_TASKS = "iq AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY id) AS query_id, split_part(title, ' ', length(title) - length(replace(title, ' ', '')) + 1) AS text, scope_kind, scope_key FROM sources WHERE source_type = 'trajectory'))"
_OUTCOME = "tr AS (SELECT id AS source_id, scope_kind, scope_key, json_extract_string(content, '$.outcome') AS outcome FROM sources WHERE source_type = 'trajectory' AND json_valid(content))"


@register(f"""WITH {_bm25(_TASKS, 260)}, {_OUTCOME}, j AS (SELECT bm.query_id, c.source_id, outcome, max(score) AS score FROM bm JOIN c USING (chunk_id) JOIN tr ON tr.source_id = c.source_id JOIN iq ON iq.query_id = bm.query_id AND iq.scope_kind = tr.scope_kind AND iq.scope_key = tr.scope_key WHERE outcome IN ('success', 'partial', 'failure') GROUP BY ALL)
SELECT query_id, source_id, outcome, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score - CASE outcome WHEN 'success' THEN 0 WHEN 'partial' THEN 0.2 ELSE 0.5 END, 9) DESC, source_id) AS place FROM j QUALIFY place <= 5""")
def replays(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories of the same scope for the last word of every trajectory's title."""
    t = table(spark, d, "sources").where("source_type = 'trajectory'")
    tasks = t.select(F.row_number().over(W.orderBy("id")).cast("long").alias("query_id"), F.element_at(F.split("title", " "), -1).alias("text"), "scope_kind", "scope_key")
    known = t.where(F.try_parse_json("content").isNotNull()).select("id", "scope_kind", "scope_key", F.get_json_object("content", "$.outcome").alias("outcome"))
    r = R.replays(chunk_index(spark, d), chunk_rows(spark, d), known, tasks)
    return r.select("query_id", "source_id", "outcome", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@register(f"""WITH {_tfidf(_ITEMS)}, g AS (SELECT DISTINCT query_id, chunk_id, 1 + (ascii(right(term, 1)) % 3) AS grade FROM (SELECT query_id, {_TOK.format('text')}[1] AS term FROM iq) f JOIN p USING (term)),
top AS (SELECT query_id, chunk_id, rank, coalesce(grade, 0) AS grade FROM tf LEFT JOIN g USING (query_id, chunk_id) WHERE rank <= 20),
i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(n + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM g) WHERE n <= 5 GROUP BY 1)
SELECT query_id, max(CASE WHEN rank = 1 AND grade > 0 THEN 1 ELSE 0 END) AS p1, round(sum(CASE WHEN rank <= 5 AND grade > 0 THEN 1 ELSE 0 END) / 5, 6) AS p5, round(max(CASE WHEN grade > 0 THEN 1 / rank ELSE 0 END), 6) AS rr,
round(coalesce(sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) / any_value(ideal), 0), 6) AS ndcg5 FROM top LEFT JOIN i USING (query_id) GROUP BY query_id""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF ranks of the items; chunks that hold an item's first token are relevant, with a grade by that token."""
    ix, q = chunk_index(spark, d), item_queries(spark, d)
    first = q.select("query_id", F.try_element_at(T.search_tokens(F.col("text")), F.lit(1)).alias("term")).where("term is not null")
    g = ix.rows("split", first).join(first, "term").select("query_id", "chunk_id", (1 + F.ascii(F.substring("term", -1, 1)) % 3).alias("grade"))
    m = R.ranking_metrics(R.tfidf(ix, q, 20), g)
    return m.select("query_id", "p1", F.round("p5", 6).alias("p5"), F.round("rr", 6).alias("rr"), F.round("ndcg5", 6).alias("ndcg5"))


@register("SELECT id AS chunk_id, CAST(length(content) AS DOUBLE) AS size, CAST(len(string_split(content, ' ')) AS DOUBLE) AS parts, 'sizes' AS embedding_model FROM (SELECT DISTINCT id, content FROM chunks WHERE embedded_at IS NULL)")
def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector, embedded in batches of 100 by a stand-in for a model: their length and number of parts."""
    e = R.embed_pending(chunk_rows(spark, d).select("chunk_id", "content", "embedded_at"), lambda texts: [[float(len(t)), float(t.count(" ") + 1)] for t in texts], "sizes")
    return e.select("chunk_id", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("parts"), "embedding_model")


@register("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 20 = 0), ch AS (SELECT vec, id AS chunk_id, source_id FROM (SELECT DISTINCT id, source_id, row_number() OVER (ORDER BY id) - 1 AS vec FROM (SELECT DISTINCT id, source_id FROM chunks))),
s AS (SELECT query_id, vec_id, greatest(0, 1 - (1 - list_cosine_similarity(qe, CAST(embedding AS DOUBLE[]))) / 2) AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, chunk_id, title, round(score, 6) AS score FROM r JOIN ch ON ch.vec = r.vec_id JOIN (SELECT id, title FROM sources) so ON so.id = ch.source_id WHERE rank <= 10""")
def vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors with their chunks and sources; a vector without a chunk is dropped. Vectors are chunks by place in order of id."""
    e = table(spark, d, "embeddings")
    hits = R.nearest_vectors(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    c = chunk_rows(spark, d).select("chunk_id", "source_id").distinct().withColumn("vec_id", F.row_number().over(W.orderBy("chunk_id")).cast("long") - 1)  # a stand-in for the vector table's row ids
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "title")
    return hits.join(c, "vec_id").join(s, "source_id").select("query_id", "chunk_id", "title", F.round("score", 6).alias("score"))
