"""Applying the change feed: the current state of concepts from the journal, in batch and as a stream.

A delivery is readable if its payload is complete JSON. A change counts once per sync_id, by any readable delivery. A concept is in
the state if it has a readable concept_create and no readable retire. Its standing truth is that of the change with the latest
instant: the create (the one with the smallest sync_id, at its created_at) or a truth_update (at the instant of its updated_at,
ISO 8601 with any offset or precision, or epoch milliseconds); at equal instants the smallest sync_id stands.

Both forms are one associative merge over (create, best update, tombstone), so repeated, late and reordered changes give the same
state. Batch: one aggregation with map-side partials, so an entity with a third of all rows costs one row per partition. Stream:
keyed state keeps the payload, the last change and the tombstone; only newer changes are accepted, and batches are emitted as
idempotent upserts under their batch number, in a table that is compacted every few batches.

Defined cases: null op, entity, sync id or payload: the row is skipped; a truth_update without a readable updated_at does not
count; an update of an unknown concept waits for its create; copies of a change that differ in spelling are one change (ties by
payload text); an empty journal gives no concept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.session import session_setting, shared_folder
from quillspark.sources.files import stream_parquet

OPS = ("concept_create", "truth_update", "retire")


def instant_micros(text: Column) -> Column:
    """Microseconds since the epoch of an ISO 8601 text with offset or Z, or of epoch milliseconds; null if it is neither."""
    t = F.upper(F.trim(text))
    ms = F.when(t.rlike(r"^-?\d{9,16}(\.\d+)?$"), t.cast("decimal(20,3)"))
    iso = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)?\s*(Z|[+-]\d\d(:?\d\d)?)?$")
    plain = F.regexp_replace(F.regexp_replace(t, r"\s+(?=[Z+-])", ""), ",", ".")
    plain = F.regexp_replace(plain, r"^(.{11}\d\d:\d\d)(?!:)", "$1:00")
    zoned = F.when(plain.rlike(r"[+-]\d{4}$"), F.regexp_replace(plain, r"(\d\d)$", ":$1")).when(plain.rlike(r"(Z|:\d\d[+-]\d\d(:\d\d)?|\.\d+[+-]\d\d(:\d\d)?)$"), plain).otherwise(F.concat(plain, F.lit("Z")))
    return F.when(ms.isNotNull(), (ms * 1000).cast("long")).when(iso, F.unix_micros(zoned.try_cast("timestamp")))


def complete_json(payload: Column) -> Column:
    """Whether the text is one whole JSON value; a payload cut off in transit isn't."""
    return F.try_parse_json(payload).isNotNull()


def readable_changes(journal: DataFrame) -> DataFrame:
    """(entity_id, sync_id, op, at, truth, created_at) of the readable deliveries of the three kinds that shape the state."""
    p = F.col("payload")
    upd = F.get_json_object(p, "$.updated_at")
    created = F.unix_micros(F.col("created_at").cast("timestamp"))
    return (
        journal.where(F.col("op").isin(*OPS) & F.col("entity_id").isNotNull() & F.col("sync_id").isNotNull() & p.isNotNull())
        .select("entity_id", "sync_id", "op", "payload", "created_at")
        .where(complete_json(p))
        .select(
            "entity_id", "sync_id", "op",
            F.when(F.col("op") == "truth_update", instant_micros(upd)).when(F.col("op") == "concept_create", created).alias("at"),
            F.when(F.col("op") == "truth_update", F.get_json_object(p, "$.new_truth"))
            .when(F.col("op") == "concept_create", F.coalesce(F.get_json_object(p, "$.compiled_truth"), F.get_json_object(p, "$.summary")))
            .alias("truth"),
        )
    )


def _folded(changes: DataFrame) -> DataFrame:
    """One row per entity: the create with the smallest sync_id, the best update, and whether it was retired."""
    is_new, is_upd = F.col("op") == "concept_create", (F.col("op") == "truth_update") & F.col("at").isNotNull()
    one = F.struct("sync_id", F.coalesce("truth", F.lit("")).alias("tie"), "at", "truth")
    # latest instant first, then the smallest sync_id: min over (-at, sync_id)
    upd = F.struct((-F.col("at")).alias("neg"), "sync_id", F.coalesce("truth", F.lit("")).alias("tie"), "truth")
    return changes.groupBy("entity_id").agg(
        F.min(F.when(is_new, one)).alias("born"), F.min(F.when(is_upd, upd)).alias("told"), F.max((F.col("op") == "retire").cast("int")).alias("gone")
    )


def _by_update() -> Column:
    """Whether the standing change of a folded row is its update."""
    later = -F.col("told.neg") > F.col("born.at")
    same = (-F.col("told.neg") == F.col("born.at")) & (F.col("told.sync_id") < F.col("born.sync_id"))
    return F.col("told").isNotNull() & (later | same | F.col("born.at").isNull())


def concept_state(journal: DataFrame) -> DataFrame:
    """(entity_id, sync_id, truth, at): one row per living concept."""
    s = _folded(readable_changes(journal)).where(F.col("born").isNotNull() & (F.col("gone") == 0))
    pick = lambda f, g: F.when(_by_update(), f).otherwise(g)
    return s.select(
        "entity_id",
        pick(F.col("told.sync_id"), F.col("born.sync_id")).alias("sync_id"),
        pick(F.col("told.truth"), F.col("born.truth")).alias("truth"),
        F.timestamp_micros(pick(-F.col("told.neg"), F.col("born.at"))).alias("at"),
    )


# ---- as a stream --------------------------------------------------------------------------------------------------------------

UPSERT = "entity_id string, sync_id string, truth string, at_micros long, living boolean"
#: After so many micro-batches the state table is written anew as one base.
COMPACT_EVERY = 20


def concept_upserts(journal_stream: DataFrame) -> DataFrame:
    """The stream of upserts. The keyed state of an entity is its create, its standing update (payload and instant) and its tombstone;
    a change that isn't newer leaves the state as it is. The state is a built-in aggregate, so it stays in the JVM, and a hot entity
    sends one row per partition and micro-batch."""
    s = _folded(readable_changes(journal_stream)).where(F.col("born").isNotNull())
    by_update, pick = _by_update(), lambda f, g: F.when(_by_update(), f).otherwise(g)
    return s.select(
        "entity_id", pick(F.col("told.sync_id"), F.col("born.sync_id")).alias("sync_id"), pick(F.col("told.truth"), F.col("born.truth")).alias("truth"),
        F.when(by_update, -F.col("told.neg")).otherwise(F.col("born.at")).alias("at_micros"), (F.col("gone") == 0).alias("living"),
    )


def _path(spark: SparkSession, folder: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers N of the complete folders name=N."""
    fs, p = _path(spark, folder)
    if not fs.exists(p):
        return []
    found = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith(f"{name}=")]
    return sorted(int(f.getName().partition("=")[2]) for f in found if fs.exists(_path(spark, f"{f}/_SUCCESS")[1]))


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """Per entity the row of the highest batch, tombstones too: the newest base and the batches after it."""
    base = max(_numbers(spark, f"{folder}/bases", "base"), default=None)
    parts = [n for n in _numbers(spark, f"{folder}/batches", "batch") if base is None or n > base]
    rows = spark.createDataFrame([], f"{UPSERT}, batch long")
    if base is not None:
        rows = spark.read.schema(UPSERT).parquet(f"{folder}/bases/base={base}").withColumn("batch", F.lit(base).cast("long"))
    if parts:
        new = spark.read.option("basePath", f"{folder}/batches").schema(f"{UPSERT}, batch long").parquet(*[f"{folder}/batches/batch={n}" for n in parts])
        rows = rows.unionByName(new)
    names = ("sync_id", "truth", "at_micros", "living")
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(*names), "batch").alias("x")).select("entity_id", *[F.col(f"x.{n}") for n in names])


def compact_state_table(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the state after batch `upto` as one base. Batches it holds are dropped once it is complete, and bases but the one before;
    a batch that is repeated later is at or below the base, so it changes nothing."""
    _latest(spark, folder).write.mode("overwrite").parquet(f"{folder}/bases/base={upto}")
    fs, _ = _path(spark, folder)
    for name, below in (("batch", upto + 1), ("base", max([n for n in _numbers(spark, f"{folder}/bases", "base") if n < upto], default=0))):
        for n in _numbers(spark, f"{folder}/{'batches' if name == 'batch' else 'bases'}", name):
            if n < below:
                fs.delete(_path(spark, f"{folder}/{'batches' if name == 'batch' else 'bases'}/{name}={n}")[1], True)


def start_state_table(journal_stream: DataFrame, folder: str, checkpoint: str, once: bool = True, compact_every: int = COMPACT_EVERY):
    """Run the stream into `folder`: every micro-batch overwrites its own partition batch=N, so a repeated batch changes nothing."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")
        if batch % compact_every == compact_every - 1:
            compact_state_table(df.sparkSession, folder, batch)

    w = concept_upserts(journal_stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w).start()


def read_state_table(spark: SparkSession, folder: str) -> DataFrame:
    """The current state: per entity the row of the highest batch, without tombstones."""
    return _latest(spark, folder).where("living").select("entity_id", "sync_id", "truth", F.timestamp_micros("at_micros").alias("at"))


def replay(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Feed all files of a journal through the stream and return the state table, kept in the shared folder. By default a micro-batch
    takes a quarter of the files, at most 1 000."""
    files_per_batch = files_per_batch or max(1, min(1000, len(spark.read.parquet(path).inputFiles()) // 4))
    base = f"{shared_folder(spark).rstrip('/')}/journal-{uuid.uuid4().hex}"
    with session_setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        query = start_state_table(stream_parquet(spark, path, files_per_batch), f"{base}/state", f"{base}/checkpoint")
    query.awaitTermination()
    return read_state_table(spark, f"{base}/state")
