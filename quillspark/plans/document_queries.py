"""Registered chunking, compression, inference and export queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as D
from quillspark.plans.registry import register
from quillspark.session import shared_folder, spread, table
from quillspark.sources import files


@register()
def chunked_sources(spark: SparkSession, d: str) -> DataFrame:
    """All sources by the chunker of their format; the chunkers are tested on fixtures."""
    s = spread(table(spark, d, "sources").select("id", "content"), "id")
    return D.chunk_documents(s.select("id", "content", T.detect_format(F.col("content")).alias("format")))


@register()
def compressed_sources(spark: SparkSession, d: str) -> DataFrame:
    return D.compress_documents(spread(table(spark, d, "sources").select("id", "content"), "id"))


_COLS = ("id", "tool_name", "query_text", "result_count", "latency_ms", "session_id", "tokens_spent", "skill_hit")
#: Columns of other types, as text: halves and whole numbers, truth values, nothing.
_CAST = {
    "latency_ms": "CASE WHEN latency_ms % 2 = 1 THEN (latency_ms // 2) || '.5' ELSE CAST(latency_ms // 2 AS VARCHAR) END", "skill_hit": "CASE WHEN skill_hit = 1 THEN 'True' ELSE 'false' END",
    "tokens_spent": "CASE WHEN tokens_spent < 0 THEN '1' ELSE ' ' END",
}


def _infer(c: str) -> str:
    v = f"trim({_CAST.get(c, f'CAST({c} AS VARCHAR)')})"
    ints, floats, bools = f"regexp_matches({v}, '^-?[0-9]+$')", f"regexp_matches({v}, '^-?[0-9]*[.][0-9]+$')", f"lower({v}) IN ('true', 'false')"
    n = f"count(*) FILTER ({v} <> '')"
    kind = f"CASE WHEN {n} = 0 THEN 'null' WHEN count(*) FILTER ({ints}) = {n} THEN 'integer' WHEN count(*) FILTER ({bools}) = {n} THEN 'boolean' WHEN count(*) FILTER ({ints} OR {floats}) = {n} THEN 'float' ELSE 'string' END"
    return f"""SELECT '{c}' AS "column", {kind} AS type, count(*) FILTER ({v} IS NULL OR {v} = '') AS nulls FROM query_log"""


@register(" UNION ALL ".join(map(_infer, _COLS)))
def schema_inference(spark: SparkSession, d: str) -> DataFrame:
    """Types of text columns: whole numbers, fractions, truth values, nothing, text."""
    whole = F.floor(F.col("latency_ms") / 2).cast("string")
    half = F.when(F.col("latency_ms") % 2 == 1, F.concat(whole, F.lit(".5"))).otherwise(whole)
    q = table(spark, d, "query_log").withColumn("latency_ms", half).withColumn("skill_hit", F.when(F.col("skill_hit") == 1, "True").otherwise("false")).withColumn("tokens_spent", F.when(F.col("tokens_spent") < 0, "1").otherwise(" "))
    return files.infer_types(q.select(*[F.col(c).cast("string").alias(c) for c in _COLS]))


_PLACED = "pl AS (SELECT slug, name, row_number() OVER (ORDER BY slug) % 23 AS community FROM concepts)"
_PALETTE = ", ".join(f"({i}, '{c}')" for i, c in enumerate(files.COLOURS))
_FIXED = " UNION ALL ".join(f"SELECT {n} AS part, '{x}' AS line" for n, x in [*enumerate(files.DOT_HEAD), (20, ""), (40, files.DOT_TAIL[0])])


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with a number for a community."""
    return table(spark, d, "concepts").select("slug", "name", (F.row_number().over(W.orderBy("slug")) % 23).cast("long").alias("community"))  # a stand-in for the communities


@register(f"""WITH {_PLACED}, co AS (SELECT * FROM (VALUES {_PALETTE}) t(i, colour)), n AS (SELECT slug, replace(name, '"', chr(92) || '"') AS name, colour FROM pl JOIN co ON i = community % 10)
{_FIXED} UNION ALL SELECT 10, '  "' || slug || '" [label="' || name || '", fillcolor="' || colour || '"];' FROM n UNION ALL SELECT 30, '  "' || from_slug || '" -> "' || to_slug || '" [label="' || relation || '", weight=' || weight || '];' FROM edges""")
def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    return files.graph_dot(_nodes(spark, d), table(spark, d, "edges"))


@register(f"""WITH {_PLACED} SELECT 'node' AS part, '{{"slug":"' || slug || '","name":"' || name || '","community":' || community || '}}' AS line FROM pl UNION ALL SELECT 'edge', '{{"from_slug":"' || from_slug || '","to_slug":"' || to_slug || '","relation":"' || relation || '","weight":' || weight || '}}' FROM edges""")
def graph_json(spark: SparkSession, d: str) -> DataFrame:
    return files.graph_json(_nodes(spark, d), table(spark, d, "edges"))


@register("SELECT 'INSERT OR REPLACE INTO scopes (kind, key, label) VALUES (' || chr(39) || kind || chr(39) || ', ' || chr(39) || key || chr(39) || ', ' || coalesce(chr(39) || replace(label, chr(39), chr(39) || chr(39)) || chr(39), 'NULL') || ');' AS line FROM scopes")
def sql_export(spark: SparkSession, d: str) -> DataFrame:
    return files.export_sql("scopes", table(spark, d, "scopes").select("kind", "key", "label"))


@register("SELECT slug, min(name) AS name, max(mention_count) + 1 AS mentions FROM concepts GROUP BY slug")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Concepts written as JSON lines, twice, the second time with a later count, and read back over the table: the last line of a key wins."""
    c = table(spark, d, "concepts").select("slug", "name", F.col("mention_count").alias("mentions"))
    at = f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    twice = c.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select("slug", "name", (F.col("mentions") + F.col("n")).alias("mentions")).repartition(4, "slug").sortWithinPartitions("mentions")
    files.export_json_lines({"concepts": twice, "other": c.limit(3)}, at)
    return files.import_json_lines(spark, at, "concepts", "slug string, name string, mentions long", ["slug"], c)


@register(r"""WITH s AS (SELECT id, title, url, strftime(added_at, '%Y-%m-%d') AS date, regexp_replace(regexp_replace(substr(content, 1, 400), '[#\r]', '', 'g'), '^---', '') AS body, json_extract_string(metadata, '$.tags[0]') AS tag FROM sources WHERE source_type = 'file')
SELECT id || '.md' AS path, CASE WHEN substr(id, 1, 1) < '8' THEN title ELSE id END AS title, url, date, coalesce(tag, '') AS tags, body AS content FROM s""")
def vault_items(spark: SparkSession, d: str) -> DataFrame:
    """Files written as notes with front matter and read back as items."""
    s = table(spark, d, "sources").where("source_type = 'file'")
    body = F.regexp_replace(F.regexp_replace(F.substring("content", 1, 400), r"[#\r]", ""), "^---", "")
    tag = F.get_json_object("metadata", "$.tags[0]")
    head = F.concat(
        F.lit("---\n"), F.when(F.substring("id", 1, 1) < "8", F.concat(F.lit('title: "'), "title", F.lit('"\n'))).otherwise(""), F.when(F.col("url").isNotNull(), F.concat(F.lit("source: "), "url", F.lit("\n"))).otherwise(""),
        F.lit("date: "), F.date_format("added_at", "yyyy-MM-dd"), F.lit("\n"), F.when(tag.isNotNull(), F.concat(F.lit("tags:\n  - "), tag, F.lit("\n"))).otherwise(""), F.lit("---\n"),
    )
    notes = files.front_matter(s.select(F.concat("id", F.lit(".md")).alias("path"), F.concat(head, body).alias("content")))
    return files.vault_items(notes.drop("content")).withColumn("tags", F.array_join("tags", ","))
