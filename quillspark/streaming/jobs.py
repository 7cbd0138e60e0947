"""Structured Streaming jobs over event logs. State is bounded by watermarks; sinks overwrite their own batch, so a repeat changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery


def new_items(stream: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Items whose key was not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def call_windows(stream: DataFrame, seconds: int = 3600, late: str | None = "1 day") -> DataFrame:
    """Calls, hits and tokens per tumbling window and tool of a query_log stream; windows leave once the watermark passed them. With
    `late` None every call counts however late it comes; the state then holds every window."""
    t = stream.withColumn("ts", F.col("timestamp").cast("timestamp"))
    t = t.withWatermark("ts", late) if late else t
    g = t.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), F.lower("tool_name").alias("tool"))
    return g.agg(F.count("*").alias("calls"), F.sum("skill_hit").alias("hits"), F.sum("tokens_spent").alias("tokens")).select(F.col("w.start").alias("start"), "tool", "calls", "hits", "tokens")


def gap_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by silence: calls of a session id with no more than the gap between them."""
    t = stream.where("session_id is not null").withColumn("ts", F.col("timestamp").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def write_batches(df: DataFrame, folder: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    def put(b: DataFrame, n: int) -> None:
        b.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if once else w).start()
