"""Call-log aggregates over query_log. Repeated rows of the log count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

USD_PER_1000 = 0.003
#: Tools that write.
WRITE_TOOLS = ("add", "edit", "write", "bash", "capture", "capture_trajectory", "compile")


def calls(log: DataFrame) -> DataFrame:
    return log.dropDuplicates()


def sessions(log: DataFrame) -> DataFrame:
    """Per session: any hit, token sum (null if none has tokens), the largest scope kind and key, each taken alone."""
    return calls(log).where("session_id is not null").groupBy("session_id").agg(
        F.max("skill_hit").alias("any_hit"), F.sum("tokens_spent").alias("tokens"), F.max("scope_kind").alias("scope_kind"), F.max("scope_key").alias("scope_key")
    )


def _savings(s: DataFrame, *keys: str) -> DataFrame:
    hit = F.col("any_hit") == 1
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("tokens"))), F.lit(0.0))
    a = s.groupBy(*keys).agg(F.count("*").alias("sessions"), F.sum(F.when(hit, 1).otherwise(0)).alias("hit_sessions"), mean(~hit).alias("base"), mean(hit).alias("aided"))
    saved = F.greatest(F.col("base") - F.col("aided"), F.lit(0.0)) * F.coalesce("hit_sessions", F.lit(0))
    rnd = lambda c: F.floor(c + 0.5).cast("long")
    return a.select(
        *keys, "sessions", F.coalesce("hit_sessions", F.lit(0)).alias("hit_sessions"), F.when(F.col("sessions") == 0, 0.0).otherwise(F.round(F.col("hit_sessions") / F.greatest("sessions", F.lit(1)), 6)).alias("hit_rate"),
        rnd(F.col("base")).alias("baseline"), rnd(F.col("aided")).alias("with_skill"), rnd(saved).alias("saved"), (F.floor(saved / 1000 * USD_PER_1000 * 100 + 0.5) / 100).alias("usd"),
    )


def cost_avoided(log: DataFrame) -> DataFrame:
    """One row; zeros for an empty log."""
    return _savings(sessions(log))


def cost_by_scope(log: DataFrame) -> DataFrame:
    return _savings(sessions(log).where("scope_kind is not null and scope_key is not null"), "scope_kind", "scope_key")


def session_summary(log: DataFrame) -> DataFrame:
    """Per session calls, hits, tokens, first and last instant, and the scope of the first call that names both parts."""
    c = calls(log).where("session_id is not null")
    named = F.when(F.col("scope_kind").isNotNull() & F.col("scope_key").isNotNull(), F.struct("timestamp", "id", "scope_kind", "scope_key"))
    return c.groupBy("session_id").agg(
        F.count("*").alias("calls"), F.sum("skill_hit").alias("hits"), F.coalesce(F.sum("tokens_spent"), F.lit(0)).alias("tokens"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.min(named).alias("n"),
    ).select("session_id", "calls", "hits", "tokens", "first_at", "last_at", F.col("n.scope_kind").alias("scope_kind"), F.col("n.scope_key").alias("scope_key"))


def candidate_sessions(log: DataFrame, reviewed: DataFrame, least: int = 3) -> DataFrame:
    """Unreviewed sessions of at least so many calls, with whether a tool that writes was among them."""
    c = calls(log).where("session_id is not null").join(reviewed.select("session_id"), "session_id", "left_anti")
    g = c.groupBy("session_id").agg(F.count("*").alias("calls"), F.max("timestamp").alias("last_at"), F.max(F.lower("tool_name").isin(*WRITE_TOOLS).cast("int")).alias("writes"))
    return g.where(F.col("calls") >= least)


def rate_limited(log: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Fixed windows: which calls of a key go beyond the limit of their window, with the seconds to wait (at least 1). The first `limit`
    calls of a window, by (timestamp, id), are accepted."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    c = calls(log).where(F.col(key).isNotNull()).withColumn("at", at).withColumn("bucket", F.floor(F.col("at") / (seconds * 1_000_000)))
    n = F.row_number().over(W.partitionBy(key, "bucket").orderBy("at", "id"))
    end = (F.col("bucket") + 1) * seconds
    return c.withColumn("n", n).select("id", key, "bucket", (F.col("n") > limit).alias("rejected"), F.greatest(F.lit(1), F.ceil(end - F.col("at") / 1_000_000)).cast("long").alias("retry_after")).where("rejected").drop("rejected")


def latency_percentiles(log: DataFrame, *keys: str) -> DataFrame:
    """The element floor(n p) of the sorted latencies, not interpolated. Calls are counted per latency first, so a key's window holds its
    different latencies, not its calls."""
    c = calls(log).where("latency_ms is not null").groupBy(*keys, "latency_ms").agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys)
    r = c.withColumn("upto", F.sum("c").over(w.orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    pick = lambda p: F.min(F.when(F.col("upto") > at(p), F.col("latency_ms")))
    return r.groupBy(*keys).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


def budget_hints(log: DataFrame, scopes: DataFrame) -> DataFrame:
    """For scopes(kind, key): sessions, savings and hit rate of the scope's own row, else of all; the mean tokens are those of all."""
    all_, per = cost_avoided(log), cost_by_scope(log)
    total = all_.select(F.col("sessions").alias("s"), F.col("saved").alias("v"), F.col("hit_rate").alias("h"), F.col("with_skill"), F.col("baseline"))  # one row
    own = per.select(F.col("scope_kind").alias("kind"), F.col("scope_key").alias("key"), "sessions", "saved", "hit_rate")
    j = scopes.select("kind", "key").distinct().join(own, ["kind", "key"], "left").crossJoin(F.broadcast(total))
    return j.select("kind", "key", F.coalesce("sessions", "s").alias("sessions"), "with_skill", F.col("baseline").alias("without_skill"), F.coalesce("saved", "v").alias("saved"), F.coalesce("hit_rate", "h").alias("hit_rate"))


def session_lines(log: DataFrame) -> DataFrame:
    """(session_id, line_no, line): the calls of a session as numbered lines, in order."""
    c = calls(log).where("session_id is not null")
    n = F.row_number().over(W.partitionBy("session_id").orderBy("timestamp", "id", "tool_name"))
    text = F.when(F.length("query_text") > 120, F.concat(F.substring("query_text", 1, 117), F.lit("..."))).otherwise(F.coalesce("query_text", F.lit("")))
    line = F.concat(F.lit(". "), F.col("tool_name"), F.lit(' "'), text, F.lit('"'), F.when(F.col("skill_hit") == 1, " (skill_hit)").otherwise(""), F.coalesce(F.concat(F.lit(" "), F.col("tokens_spent").cast("string"), F.lit("t")), F.lit("")))
    return c.withColumn("line_no", n).select("session_id", "line_no", F.concat(F.col("line_no").cast("string"), line).alias("line"))


def review_outcomes(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, outcome) of sessions(session_id, calls, writes) with a model's findings found(session_id, task, outcome, steps): too_short
    and read_only sessions are skipped, findings that aren't valid rejected, sessions without any are empty."""
    f = found.select("session_id", F.when((F.coalesce("task", F.lit("")) == "") | ~F.col("outcome").isin("success", "partial", "failure") | (F.coalesce("steps", F.lit(0)) < 1), "rejected").otherwise("extracted").alias("o")).groupBy("session_id").agg(F.min("o").alias("o"))
    return sessions.join(f, "session_id", "left").select("session_id", F.when(F.col("calls") < 3, "too_short").when(F.col("writes") == 0, "read_only").otherwise(F.coalesce("o", F.lit("empty"))).alias("outcome"))


def classifier_stats(labels: DataFrame, fallback: str) -> DataFrame:
    """(hits, fallbacks, share) of labels(label, n): one row; the share of hits in whole percent, 0 without calls."""
    a = labels.agg(F.coalesce(F.sum(F.when(F.col("label") != fallback, F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col("label") == fallback, F.col("n"))), F.lit(0)).alias("fallbacks"))
    total = F.col("hits") + F.col("fallbacks")
    return a.select("hits", "fallbacks", F.when(total == 0, 0).otherwise(F.floor(100 * F.col("hits") / F.greatest(total, F.lit(1)) + 0.5)).cast("long").alias("share"))


def frequent_fallbacks(calls_: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(label, input, n): the inputs that fell back most often, at least `least` times."""
    return calls_.groupBy("label", "input").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "label", "input").limit(most)
