"""Queries over sync_journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import journal
from quillspark.plans.registry import register
from quillspark.session import table

#: Instants in SQL: epoch milliseconds as they are, ISO 8601 read with its offset. One readable delivery per sync_id is enough.
_STATE = """
WITH readable AS (
  SELECT DISTINCT op, entity_id, sync_id, created_at,
    CASE WHEN op = 'truth_update' THEN json_extract_string(payload, '$.new_truth')
         ELSE coalesce(json_extract_string(payload, '$.compiled_truth'), json_extract_string(payload, '$.summary')) END AS truth,
    json_extract_string(payload, '$.updated_at') AS u
  FROM sync_journal WHERE json_valid(payload) AND op IN ('concept_create', 'truth_update', 'retire')),
born AS (SELECT entity_id, sync_id, epoch_us(created_at) AS us, truth FROM readable WHERE op = 'concept_create'
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sync_id, truth) = 1),
told AS (SELECT entity_id, sync_id, truth,
    CASE WHEN regexp_full_match(u, '[0-9]+') THEN CAST(u AS BIGINT) * 1000 ELSE epoch_us(CAST(u AS TIMESTAMPTZ)) END AS us
  FROM readable WHERE op = 'truth_update'),
alive AS (SELECT entity_id, sync_id, us, truth FROM (SELECT * FROM born UNION ALL SELECT entity_id, sync_id, us, truth FROM told)
  WHERE entity_id IN (SELECT entity_id FROM born) AND entity_id NOT IN (SELECT entity_id FROM readable WHERE op = 'retire'))
"""
_PICK = "QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, sync_id, truth) = 1"


@register(_STATE + f"SELECT entity_id, sync_id FROM alive {_PICK}")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The living concepts and their standing changes, by the keyed stream over all of the journal."""
    return journal.replay(spark, f"{d}/sync_journal.parquet").select("entity_id", "sync_id")


@register(_STATE + f"SELECT entity_id, sync_id, truth, us AS at_micros FROM alive {_PICK}")
def p6_state(spark: SparkSession, d: str) -> DataFrame:
    """The standing truth of every living concept, by one aggregation."""
    s = journal.concept_state(table(spark, d, "sync_journal"))
    return s.selectExpr("entity_id", "sync_id", "truth", "unix_micros(at) AS at_micros")
