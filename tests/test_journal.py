import json
import random
from datetime import datetime

import pytest

from quillspark.operators import journal

SCHEMA = "sync_id string, op string, entity_id string, payload string, created_at timestamp_ntz, device_id string"


def change(sync, op, entity, at=None, truth=None, created="2025-01-01T00:00:00", cut=False):
    body = {"concept_slug": entity, "new_truth": truth, "updated_at": at} if op == "truth_update" else {"slug": entity, "compiled_truth": truth, "summary": None} if op == "concept_create" else {"concept_slug": entity}
    p = json.dumps(body)
    return (sync, op, entity, p[: len(p) // 2] if cut else p, datetime.fromisoformat(created), "d")


ROWS = [
    change("05", "concept_create", "a", truth="late copy", created="2025-03-01T00:00:00"),
    change("01", "concept_create", "a", truth="first"),
    change("03", "truth_update", "a", "2025-01-02T01:30:00.000+05:30", "x"),  # 2025-01-01T20:00Z
    change("04", "truth_update", "a", 1735768800000, "y"),  # 2025-01-01T22:00Z
    change("02", "truth_update", "a", "2025-01-01T22:00:00Z", "z"),  # equal instant, smaller id
    change("09", "truth_update", "a", "2026-01-01T00:00:00Z", "cut", cut=True),
    change("10", "concept_create", "b", truth="gone"), change("11", "retire", "b", created="2024-01-01T00:00:00"),
    change("12", "concept_create", "c", truth="kept"), change("13", "retire", "c", cut=True), change("14", "truth_update", "c", "nonsense", "no"),
    change("15", "truth_update", "d", "2025-01-01T00:00:00Z", "never created"),
    change("16", "concept_create", "e", truth=None), change("16", "concept_create", "e", truth=None, cut=True),
    ("17", "feedback", "a", "{}", datetime(2027, 1, 1), "d"), (None, "retire", "a", "{}", None, None), ("18", "retire", None, "{}", None, None), ("19", None, "a", None, None, None),
]
WANT = {"a": ("02", "z"), "c": ("12", "kept"), "e": ("16", None)}


def state(df):
    return {r.entity_id: (r.sync_id, r.truth) for r in df.collect()}


def test_any_order_and_repetition(spark):
    for seed in range(3):
        rows = ROWS + ROWS[:: seed + 1]
        random.Random(seed).shuffle(rows)
        assert state(journal.concept_state(spark.createDataFrame(rows, SCHEMA))) == WANT


def test_empty(spark):
    assert journal.concept_state(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text,want", [
    ("2025-01-02T01:30:00.000+05:30", 1735761600000000), ("2025-01-01T20:00:00Z", 1735761600000000), ("1735761600000", 1735761600000000), ("2025-01-01T16:00:00.000001-04:00", 1735761600000001),
    ("2025-01-01 20:00", 1735761600000000), ("2025-01-01T22:00:00+0200", 1735761600000000), ("x", None), ("2025-13-01T00:00:00Z", None), ("", None), (None, None),
])
def test_instants(spark, text, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(journal.instant_micros(F.col("t")).alias("m")).first().m == want


@pytest.mark.parametrize("every", [1, 2, 20])
def test_stream_gives_the_same_state(spark, tmp_path, every):
    rows = ROWS + ROWS[::2]
    random.Random(7).shuffle(rows)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    third = len(rows) // 3
    for i in range(3):  # three arrivals, the query restarted between them
        part = rows[i * third : (i + 1) * third if i < 2 else None]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        journal.start_state_table(spark.readStream.schema(SCHEMA).parquet(src), out, ck, compact_every=every).awaitTermination()
    assert state(journal.read_state_table(spark, out)) == WANT
    journal.start_state_table(spark.readStream.schema(SCHEMA).parquet(src), out, ck, compact_every=every).awaitTermination()
    assert state(journal.read_state_table(spark, out)) == WANT
    if every == 1:  # a batch that comes again after it was compacted changes nothing
        spark.createDataFrame([("a", "00", "old", 0, True)], journal.UPSERT).write.mode("overwrite").parquet(f"{out}/batches/batch=0")
        assert state(journal.read_state_table(spark, out)) == WANT


def test_replay_in_several_batches_keeps_settings(spark, tmp_path):
    rows = ROWS + ROWS[::3]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(str(tmp_path / "j"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert state(journal.replay(spark, str(tmp_path / "j"), files_per_batch=2)) == WANT
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
