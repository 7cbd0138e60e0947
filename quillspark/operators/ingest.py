"""From inputs to documents: folders, tables, feeds, vault items, trajectories, and what of them is new.

Defined cases: a null text counts as empty; an entry without an id is left out; a repeated entry counts once, by its first place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import text as T
from quillspark.functions.estimate import token_estimate


def folder_document(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, content) of files(keys, name, content): sections '## name' by name, with rules between them. A folder's texts meet in one
    row, which is the document asked for."""
    part = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return files.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("part")))), lambda x: x["part"]), "\n\n---\n\n").alias("content"))


def repository_document(files: DataFrame, *keys: str, most_files: int = 800, most_bytes: int = 500_000, cut_bytes: int = 50_000) -> DataFrame:
    """(keys, files, language, content) of files(keys, path, language, content): documents first, then by path; files above `most_bytes`
    are left out, longer texts cut at a line end; the language is that of most files."""
    doc = F.lower(F.col("path")).rlike(r"(^|/)readme[^/]*$|\.(md|rst|txt)$")
    size = F.octet_length("content")
    head = F.substring("content", 1, cut_bytes)
    text = F.when(size > cut_bytes, F.concat(F.regexp_replace(head, r"\n[^\n]*\z", ""), F.lit("\n\n"), F.lit("/* truncated */"))).otherwise(F.col("content"))
    f = files.where(F.col("content").isNotNull() & (size <= most_bytes)).select(*keys, "path", "language", (~doc).alias("late"), text.alias("text"))
    w = W.partitionBy(*keys).orderBy("late", "path")
    f = f.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_files)
    section = F.concat(F.lit("## "), F.col("path"), F.lit("\n\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```"))
    by = f.where("language is not null").groupBy(*keys, "language").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "language"))["language"].alias("language"))
    out = f.groupBy(*keys).agg(F.count("*").alias("files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("content"))
    return out.join(by, list(keys), "left").select(*keys, "files", "language", "content")


def dataset_card(df: DataFrame, types: DataFrame, title: str, preview: int = 20, cell: int = 120) -> DataFrame:
    """(part, line) of a markdown card: a table of columns(column, type, nulls), and the first rows by all columns."""
    esc = lambda c: F.regexp_replace(F.replace(F.substring(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), 1, cell), F.lit("|"), F.lit("\\|")), r"\s+", " ")
    rows = df.orderBy(*[F.col(f"`{c}`") for c in df.columns]).limit(preview)
    spark = df.sparkSession
    head = spark.createDataFrame([(0, f"# {title}"), (1, "| column | type | nulls |"), (3, "| " + " | ".join(df.columns) + " |")], "part int, line string")
    schema = types.select(F.lit(2).alias("part"), F.format_string("| %s | %s | %d |", "column", "type", "nulls").alias("line"))
    return head.unionByName(schema).unionByName(rows.select(F.lit(4).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *[esc(c) for c in df.columns]), F.lit(" |")).alias("line")))


def language_shares(files: DataFrame) -> DataFrame:
    """(language, files, share) of files(language): languages of at least 5 % of the files, or of 50."""
    n = files.where("language is not null").groupBy("language").agg(F.count("*").alias("files"))
    total = n.agg(F.sum("files").alias("total"))  # one row
    least = F.least(F.lit(50), F.ceil(F.col("total") * 0.05))
    return n.crossJoin(F.broadcast(total)).where(F.col("files") >= least).select("language", "files", (F.col("files") / F.col("total")).alias("share"))


def feed_entries(feeds: DataFrame) -> DataFrame:
    """(feed, place, entry_id, title, published, body) of Atom texts feeds(feed, xml); the version behind an id is dropped."""
    one = lambda tag: F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    e = feeds.select("feed", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("place", "e"))
    ident = F.regexp_replace(F.regexp_extract(one("id"), r"([^/]+)$", 1), r"v\d+$", "")
    return e.select("feed", "place", ident.alias("entry_id"), T.trim_all(F.regexp_replace(one("title"), r"\s+", " ")).alias("title"), one("published").alias("published"), T.trim_all(one("summary")).alias("body")).where("entry_id <> ''")


def entry_documents(entries: DataFrame) -> DataFrame:
    """Entries with a text of their own: the article body, else the description; the others make no document, but count as seen."""
    none = lambda c: F.when(T.trim_all(F.col(c)) != "", F.col(c))
    return entries.withColumn("content", F.coalesce(none("article"), none("body"))).where("content is not null")


def new_entries(fetched: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries fetched(feed, place, entry_id, ...) whose id was not seen(feed, entry_id), each once by its first place."""
    w = W.partitionBy("feed", "entry_id").orderBy("place")
    return fetched.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").join(seen.select("feed", "entry_id"), ["feed", "entry_id"], "left_anti")


def seen_ids(fetched: DataFrame, seen: DataFrame, most: int = 500) -> DataFrame:
    """(feed, place, entry_id): ids of this fetch before those of earlier ones(feed, place, entry_id), first occurrence kept, the first
    `most` of every feed."""
    both = fetched.select("feed", F.lit(0).alias("age"), "place", "entry_id").unionByName(seen.select("feed", F.lit(1).alias("age"), "place", "entry_id"))
    first = both.groupBy("feed", "entry_id").agg(F.min(F.struct("age", "place")).alias("at"))
    w = W.partitionBy("feed").orderBy("at", "entry_id")
    return first.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < most).select("feed", "place", "entry_id")


def changed_files(now: DataFrame, before: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(changed, state) of now(path, mtime) against before(path, mtime): files that are new or whose time differs, at most `most` by
    path; the new state holds them and what was there before, without files that are gone."""
    j = now.join(before.select("path", F.col("mtime").alias("was")), "path", "left")
    changed = j.where(~F.col("mtime").eqNullSafe(F.col("was"))).orderBy("path").limit(most).select("path", "mtime")
    kept = j.where("was is not null").join(changed.select("path"), "path", "left_anti").select("path", F.col("was").alias("mtime"))
    return changed, changed.unionByName(kept)


def connector_runs(connectors: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, state, last_run_at, last_error) after runs(id, at, seq, state, error): a failure keeps the state, a success clears the error."""
    r = runs.groupBy("id").agg(
        F.max("at").alias("at"), F.max_by("error", F.struct("at", "seq")).alias("error"), F.max_by("state", F.when(F.col("error").isNull(), F.struct("at", "seq"))).alias("new_state"), F.count("*").alias("n")
    )
    j = connectors.join(r, "id", "left")
    return j.select("id", F.coalesce("new_state", "state").alias("state"), F.coalesce("at", "last_run_at").alias("last_run_at"), F.when(F.col("n").isNull(), F.col("last_error")).otherwise(F.col("error")).alias("last_error"))


def due(connectors: DataFrame, now: Column) -> DataFrame:
    """Connectors never run, or not for their interval, those never run first."""
    waited = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_run_at").cast("timestamp"))) / 1_000_000)
    return connectors.where(F.col("last_run_at").isNull() | (waited >= F.col("interval_seconds"))).orderBy(F.asc_nulls_first("last_run_at"), "id")


# ---- trajectories -----------------------------------------------------------------------------------------------------------------

STEPS = "array<struct<n:long,tool:string,args:map<string,string>,result_summary:string,result_ok:boolean,elapsed_ms:long>>"
TRAJECTORY = f"task string, outcome string, agent string, steps {STEPS}"
#: Limits of a trajectory.
MOST_STEPS, SUMMARY_CHARS, ARGS_BYTES, WHOLE_BYTES = 50, 500, 2048, 256 * 1024


def trajectories(records: DataFrame) -> DataFrame:
    """(id, content, x): records(id, content) that are whole JSON, parsed."""
    return records.select("id", "content", F.from_json("content", TRAJECTORY).alias("x")).where(F.try_parse_json("content").isNotNull() & F.col("x").isNotNull())


def validated(parsed: DataFrame) -> DataFrame:
    """Trajectories(id, content, x) with `reason` of rejection, null where accepted; summaries and arguments that are too long are cut to
    their limits in accepted ones."""
    steps = F.col("x.steps")
    n = F.coalesce(F.size(steps), F.lit(0))
    reason = F.when(n < 1, "no_steps").when(n > MOST_STEPS, "too_many_steps").when(F.octet_length("content") > WHOLE_BYTES, "too_large")
    long = lambda s: F.length(s["result_summary"]) > SUMMARY_CHARS
    big = lambda s: F.octet_length(F.to_json(s["args"])) > ARGS_BYTES
    cut = F.transform(steps, lambda s: F.struct(
        s["n"].alias("n"), s["tool"].alias("tool"), F.when(big(s), F.create_map(F.lit("_truncated"), F.lit("true"))).otherwise(s["args"]).alias("args"),
        F.when(long(s), F.concat(F.substring(s["result_summary"], 1, SUMMARY_CHARS - 3), F.lit("..."))).otherwise(s["result_summary"]).alias("result_summary"),
        s["result_ok"].alias("result_ok"), s["elapsed_ms"].alias("elapsed_ms"),
    ))
    return parsed.select("id", "x.task", "x.outcome", "x.agent", cut.alias("steps"), reason.alias("reason"))


def trajectory_chunks(accepted: DataFrame) -> DataFrame:
    """(source_id, position, heading, content, token_count): one summary and one chunk per step of validated trajectories."""
    args = F.array_join(F.transform(F.map_entries("s.args"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), " ")
    args = F.when(F.length(args) > 200, F.concat(F.substring(args, 1, 197), F.lit("..."))).otherwise(F.coalesce(args, F.lit("")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    summary = F.concat(F.lit("Task: "), text("task"), F.lit("\nOutcome: "), text("outcome"), F.lit("\nAgent: "), text("agent"), F.lit("\nSteps: "), F.size("steps").cast("string"))
    step = F.concat(F.lit("step "), F.col("s.n").cast("string"), F.lit(": "), F.col("s.tool"), F.lit("("), args, F.lit(")\nresult: "), F.when(F.col("s.result_ok"), "ok").otherwise("error"), F.lit(" - "), F.coalesce("s.result_summary", F.lit("")))
    a = accepted.where("reason is null")
    heads = a.select(F.col("id").alias("source_id"), F.lit(0).cast("long").alias("position"), F.lit("Trajectory summary").alias("heading"), summary.alias("content"))
    rest = a.select("id", F.explode("steps").alias("s")).select(F.col("id").alias("source_id"), (F.col("s.n") + 1).alias("position"), F.concat(F.lit("Step "), F.col("s.n").cast("string"), F.lit(": "), F.col("s.tool")).alias("heading"), step.alias("content"))
    return heads.unionByName(rest).withColumn("token_count", token_estimate(F.col("content")))


# ---- rows of sources and chunks -----------------------------------------------------------------------------------------------------


def insert_sources(base: DataFrame, new: DataFrame) -> DataFrame:
    """The base with new sources that its hashes lack, the earliest row of a hash first. A row without scope gets the personal one; one
    with only half a scope is rejected (see `rejected_sources`)."""
    ok = new.where(F.col("scope_kind").isNull() == F.col("scope_key").isNull())
    ok = ok.withColumn("scope_key", F.coalesce("scope_key", F.lit("me"))).withColumn("scope_kind", F.coalesce("scope_kind", F.lit("personal")))
    w = W.partitionBy("content_hash").orderBy("added_at", "id")
    first = ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(base.select("content_hash"), "content_hash", "left_anti")
    return base.unionByName(first.select(base.columns))


def rejected_sources(new: DataFrame) -> DataFrame:
    return new.where(F.col("scope_kind").isNull() != F.col("scope_key").isNull())


def chunk_rows(pieces: DataFrame) -> DataFrame:
    """Chunks with their ids: the short hash of source, position and content."""
    return pieces.withColumn("id", T.short_id(F.concat_ws(":", "source_id", F.col("position").cast("string"), "content"))).withColumn("content_hash", T.content_hash(F.col("content")))
