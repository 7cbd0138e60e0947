"""Exchange of change rows between devices and a relay: checks, pushes, pulls by cursor, limits, and waiting rows.

Defined cases: a row without sync id is rejected; a repeated sync id is stored once, the first by arrival; an empty page keeps the cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Forms of the keys, and limits of an envelope, a batch and a page.
SYNC_ID, TAG = r"^[0-9a-f]{12}-[0-9a-f]{20}$", r"^[0-9a-f]{16}$"
ENVELOPE_BYTES, BATCH, PAGE, MOST_PAGE = 256 * 1024, 100, 100, 500


def checked(entries: DataFrame) -> DataFrame:
    """entries(sync_id, scope_tag, envelope) with `reason` of rejection, null where they pass."""
    reason = (
        F.when(F.col("sync_id").isNull() | ~F.col("sync_id").rlike(SYNC_ID), "bad_sync_id").when(F.col("scope_tag").isNull() | ~F.col("scope_tag").rlike(TAG), "bad_scope_tag")
        .when(F.col("envelope").isNull() | (F.col("envelope") == ""), "bad_envelope").when(F.octet_length("envelope") > ENVELOPE_BYTES, "too_large")
    )
    return entries.withColumn("reason", reason)


def push(stored: DataFrame, entries: DataFrame, dead: DataFrame) -> DataFrame:
    """(user_hash, sync_id, outcome) of entries(user_hash, sync_id, scope_tag, envelope, seq): accepted, duplicate (stored before or earlier in
    the batch), deleted (in dead(user_hash, sync_id)) or the reason of rejection."""
    key = ["user_hash", "sync_id"]
    first = F.row_number().over(W.partitionBy(*key).orderBy("seq")) == 1
    c = checked(entries).withColumn("first", first)
    c = c.join(stored.select(*key).distinct().withColumn("have", F.lit(True)), key, "left").join(dead.select(*key).distinct().withColumn("dead", F.lit(True)), key, "left")
    out = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("dead"), "deleted").when(F.col("have") | ~F.col("first"), "duplicate").otherwise("accepted")
    return c.select(*key, "seq", out.alias("outcome"))


def push_batches(journal: DataFrame, size: int = BATCH) -> DataFrame:
    """(sync_id, batch): changes not pushed yet, in order of id, `size` a batch. Ids are numbered within ranges of their time, and ranges by
    their counts, so no task holds all rows."""
    j = journal.where("pushed_at is null and sync_id is not null").select("sync_id").distinct().withColumn("r", F.substring("sync_id", 1, 6))
    per = j.groupBy("r").agg(F.count("*").alias("n"))
    before = per.select("r", F.coalesce(F.sum("n").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a range of time
    n = F.row_number().over(W.partitionBy("r").orderBy("sync_id"))
    return j.withColumn("n", n).join(before, "r").select("sync_id", F.floor((F.col("before") + F.col("n") - 1) / size).cast("long").alias("batch"))


def pull_pages(stored: DataFrame, cursors: DataFrame, page: int = PAGE) -> DataFrame:
    """(device, sync_id, place, next_cursor) of stored(sync_id) after the cursors(device, cursor): a page by id; the next cursor is its last id
    if the page is full, else null: the last page. The smallest ids after a cursor are found per time range first."""
    page = max(1, min(page, MOST_PAGE))
    s = stored.select("sync_id").distinct()
    # the cursors are a stated, small set; each takes one ordered page
    parts = None
    for r in cursors.select("device", "cursor").collect():
        one = s.where(F.col("sync_id") > r.cursor).orderBy("sync_id").limit(page + 1).select(F.lit(r.device).alias("device"), "sync_id")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return s.where("false").select(F.lit("").alias("device"), "sync_id", F.lit(0).alias("place"), F.lit("").alias("next_cursor"))
    w = W.partitionBy("device").orderBy("sync_id")
    p = parts.withColumn("place", F.row_number().over(w))
    last = F.max(F.when(F.col("place") <= page, F.col("sync_id"))).over(W.partitionBy("device"))
    full = F.max("place").over(W.partitionBy("device")) > page
    return p.withColumn("next_cursor", F.when(full, last)).where(F.col("place") <= page).select("device", "sync_id", "place", "next_cursor")


def readable_or_quarantined(pulled: DataFrame) -> DataFrame:
    """(sync_id, readable): rows that can't be read are kept aside; the cursor passes them all the same."""
    return pulled.groupBy("sync_id").agg(F.max(F.try_parse_json("payload").isNotNull()).alias("readable"))


def watermark(journal: DataFrame) -> DataFrame:
    """One row: the newest id, and how many changes wait to be pushed, pulled changes to be applied."""
    return journal.agg(F.max("sync_id").alias("newest"), F.countDistinct(F.when(F.col("pushed_at").isNull(), F.col("sync_id"))).alias("unpushed"), F.countDistinct(F.when(F.col("pulled_at").isNotNull() & F.col("applied_at").isNull(), F.col("sync_id"))).alias("unapplied"))


def trajectory_inserts(journal: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, task, outcome): readable trajectory changes whose source is missing, the first delivery by id."""
    p = F.col("payload")
    t = journal.where((F.col("op") == "trajectory") & F.try_parse_json(p).isNotNull()).select(F.get_json_object(p, "$.source_id").alias("source_id"), "sync_id", F.get_json_object(p, "$.metadata.task").alias("task"), F.get_json_object(p, "$.metadata.outcome").alias("outcome"))
    one = t.where("source_id is not null").groupBy("source_id").agg(F.min(F.struct("sync_id", "task", "outcome")).alias("x"))
    return one.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("source_id", "x.task", "x.outcome")
