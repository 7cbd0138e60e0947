"""Registered queries of the training-data operators: callables over (spark, folder of the tables)."""

from __future__ import annotations

import secrets as secrets_
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.llm import boiler, leak, mojibake, neardup, pack, pii, secrets, split
from quillspark.session import table, write_shared


def text_records(spark: SparkSession, d: str) -> DataFrame:
    """Sources and chunks as one relation (rec_table, rec_id, content)."""
    s = table(spark, d, "sources").select(F.lit("sources").alias("rec_table"), F.col("id").alias("rec_id"), "content")
    c = table(spark, d, "chunks").select(F.lit("chunks").alias("rec_table"), F.col("id").alias("rec_id"), "content")
    return s.unionByName(c)


def _keyed(spark: SparkSession, d: str, name: str, key: str, text: str) -> DataFrame:
    return table(spark, d, name).select(F.lit(name).alias("rec_table"), F.col(key).alias("key"), F.col(text).alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = neardup.duplicate_pairs(_keyed(spark, d, "sources", "id", "content"))
    return s.unionByName(neardup.duplicate_pairs(_keyed(spark, d, "concepts", "slug", "compiled_truth"), key_similarity=0.7))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every source and concept with its group, so that each group can be kept once."""
    s = neardup.duplicate_groups(_keyed(spark, d, "sources", "id", "content"))
    return s.unionByName(neardup.duplicate_groups(_keyed(spark, d, "concepts", "slug", "compiled_truth"), key_similarity=0.7))


_KEYS: dict[str, bytes] = {}


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the surrogates: spark.quillspark.surrogateKey; where it is unset a random one for this application."""
    told = spark.conf.get("spark.quillspark.surrogateKey", None) or spark.sparkContext.getConf().get("spark.quillspark.surrogateKey")
    return told.encode() if told else _KEYS.setdefault(spark.sparkContext.applicationId, secrets_.token_bytes(32))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(text_records(spark, d))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(text_records(spark, d))


def p2_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value's kind with its surrogate; the values themselves stay inside."""
    return pii.surrogate_table(text_records(spark, d), surrogate_key(spark)).select("kind", "surrogate")


def p2_pseudonymised(spark: SparkSession, d: str) -> DataFrame:
    r = text_records(spark, d)
    return pii.replace_with_surrogates(r, pii.surrogate_table(r, surrogate_key(spark)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that the splitter cut."""
    return split.split_oversized(text_records(spark, d), with_content=False).where("position = 0").select("rec_table", "rec_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized source as rows like chunks."""
    return split.split_oversized(text_records(spark, d).where("rec_table = 'sources'")).drop("rec_table").withColumnRenamed("rec_id", "source_id")


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized source whether all pieces are within the limit, slices of it, and reach from its first word to its last."""
    p = p3_pieces(spark, d).join(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("content").alias("whole")), "source_id")
    w = F.regexp_replace(F.col("whole"), r"^\s+|\s+$", "")
    part = F.regexp_replace(F.col("content"), r"^\s+|\s+$", "")
    first, last = F.min("position").over(W.partitionBy("source_id")), F.max("position").over(W.partitionBy("source_id"))
    p = p.select("source_id", (F.col("token_count") <= 1000).alias("within"), F.contains(F.col("whole"), part).alias("slices"), ((F.col("position") != first) | F.startswith(w, part)).alias("starts"), ((F.col("position") != last) | F.endswith(w, part)).alias("ends"))
    return p.groupBy("source_id").agg(*[F.min(c).alias(c) for c in ("within", "slices", "starts", "ends")])


def _whole_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(_whole_sources(spark, d))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_secrets(_whole_sources(spark, d))


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every redacted source, as many as it had."""
    return p4_redacted(spark, d).where("content is not null").select("source_id", F.size(F.split("content", "\n")).cast("long").alias("lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boiler.boilerplate_lines(_whole_sources(spark, d).where("source_type = 'url'"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boiler.main_text(_whole_sources(spark, d).where("source_type = 'url'"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(_whole_documents(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, those placed whole and once, containers above the capacity, and copies that share a container."""
    docs = table(spark, d, "documents").where("text is not null")
    c = write_shared(p7_containers(spark, d), "p7-checked")
    pieces = c.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("k"), F.max("piece").alias("m"))
    placed = pieces.where("n = k and n = m + 1").agg(F.count("*").alias("placed"))
    over = c.groupBy("container").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > pack.CAPACITY).agg(F.count("*").cast("int").alias("over"))
    key = F.sha2(F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " "), 256)
    same = c.join(docs.select("doc_id", key.alias("key")), "doc_id").groupBy("container", "key", "piece").agg(F.countDistinct("doc_id").alias("n")).where("n > 1")
    return docs.agg(F.count("*").alias("documents")).crossJoin(placed).crossJoin(over).crossJoin(same.agg(F.count("*").cast("int").alias("clashes")))  # one row each


def _whole_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(_whole_documents(spark, d), table(spark, d, "eval_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Also passages of 13 words with one word changed, put in or left out."""
    return leak.find_leaks(_whole_documents(spark, d), table(spark, d, "eval_items"), edits=1)


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p8_near that hold without any edit: all of p8_found."""
    return p8_near(spark, d).join(p8_found(spark, d), ["doc_id", "item_id"], "left_semi")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_documents(_whole_documents(spark, d)).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repair_documents(_whole_documents(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}  # in order of definition


def oracle_sql() -> dict[str, str]:
    from quillspark.llm.sql import SQL

    return dict(SQL)
