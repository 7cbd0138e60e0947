"""One object over a folder of tables: search, questions, graph, status and lists, each as a DataFrame; and the same as named tools.

A folder holds <table>.parquet, a file or a folder each; `add` needs folders, since it appends. Defined cases: a missing table is empty
where its schema is known here (sources, chunks, concepts, edges, query_log), else an error; texts that are there already are not added."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import text as T
from quillspark.operators import documents, folds, graph as G, ingest, retrieval as R, router, telemetry
from quillspark.session import file_stamp, table

SCHEMAS = {
    "sources": "id string, title string, url string, content string, content_hash string, source_type string, added_at timestamp, compiled_at timestamp, word_count long, language string, metadata string, scope_kind string, scope_key string",
    "chunks": "id string, source_id string, content string, content_hash string, chunk_type string, heading string, position long, token_count long, embedding_model string, embedded_at timestamp",
    "concepts": "slug string, name string, summary string, compiled_truth string, timeline string, article string, created_at timestamp, updated_at timestamp, mention_count long, enrichment_tier long, last_enriched_at timestamp, enrichment_queued long, scope_kind string, scope_key string, score long, retired_at timestamp, retire_reason string",
    "edges": "from_slug string, to_slug string, relation string, weight double, source_id string",
    "query_log": "id long, tool_name string, query_text string, result_count long, latency_ms long, session_id string, timestamp timestamp, tokens_spent long, skill_hit long, exploration_depth long, scope_kind string, scope_key string",
}


class _Listing:
    """get, list and count of one table."""

    def __init__(self, engine: Engine, name: str, key: str, order: str) -> None:
        self.engine, self.name, self.key, self.order = engine, name, key, order

    def get(self, key: str) -> DataFrame:
        return self.engine.table(self.name).where(F.col(self.key) == key)

    def list(self, limit: int | None = None, **equal: Any) -> DataFrame:
        """Rows with the given values, newest or first by order, the key breaking ties."""
        df = self.engine.table(self.name)
        for c, v in equal.items():
            df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
        df = df.orderBy(F.desc(self.order) if self.order.endswith("_at") else F.asc(self.order), self.key)
        return df.limit(_positive(limit)) if limit is not None else df

    def count(self) -> int:
        return self.engine.table(self.name).select(self.key).distinct().count()

    def count_by(self, column: str) -> DataFrame:
        return self.engine.table(self.name).groupBy(column).agg(F.count("*").alias("n"))


class _Graph:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def _ve(self) -> tuple[DataFrame, DataFrame]:
        return self.engine.table("concepts"), self.engine.table("edges")

    def god_nodes(self, limit: int = 10) -> DataFrame:
        return G.degrees(*self._ve()).orderBy(F.desc("degree"), "slug").limit(_positive(limit))

    def path(self, start: str, end: str, depth: int = 6) -> DataFrame:
        """(node, hops, path): one row, none where there is no path within the depth; a node is at 0 hops from itself."""
        return G.shortest_paths(self.engine.table("edges"), start, depth).where(F.col("node") == end)

    def neighbours(self, slug: str, depth: int = 2) -> DataFrame:
        return G.hops_from(self.engine.table("edges"), slug, depth)

    def neighbourhood(self, slug: str, depth: int = 2) -> DataFrame:
        return G.touched_edges(self.engine.table("edges"), slug, depth)

    def pagerank(self, limit: int | None = None) -> DataFrame:
        r = G.pagerank(*self._ve()).orderBy(F.desc(F.round("score", 9)), "slug")
        return r.limit(_positive(limit)) if limit is not None else r

    def communities(self) -> DataFrame:
        return G.community_ids(G.communities(*self._ve()))

    def components(self) -> DataFrame:
        c, e = self._ve()
        labels = G.component_labels(e.select(F.col("from_slug").alias("src"), F.col("to_slug").alias("dst")))
        return c.select("slug").join(labels.withColumnRenamed("node", "slug"), "slug", "left").select("slug", F.coalesce("label", "slug").alias("component"))

    def cross_community(self) -> DataFrame:
        return G.cross_community(self.engine.table("edges"), self.communities())

    def density(self) -> float | None:
        c, e = self._ve()
        v, n = c.count(), e.count()
        return None if v == 0 else 0.0 if v == 1 else 2 * n / (v * (v - 1))


class Engine:
    """`on_call(event)` is told of the start and the end of every public call; what it raises is not the call's concern."""

    def __init__(self, spark: SparkSession, folder: str, patterns: list[tuple[str, str]] | None = None, on_call: Callable[[dict], None] | None = None) -> None:
        self.spark, self.folder, self.patterns, self.on_call = spark, folder.rstrip("/"), patterns or [], on_call
        self._index: tuple[str, R.ChunkIndex] | None = None
        self.sources, self.chunks, self.concepts = _Listing(self, "sources", "id", "added_at"), _Listing(self, "chunks", "id", "position"), _Listing(self, "concepts", "slug", "updated_at")
        self.graph = _Graph(self)

    def table(self, name: str) -> DataFrame:
        try:
            return table(self.spark, self.folder, name)
        except AnalysisException:
            if name in SCHEMAS:
                return self.spark.createDataFrame([], SCHEMAS[name])
            raise

    def _told(self, name: str, run: Callable[[], Any], **args: Any) -> Any:
        def tell(**event: Any) -> None:
            try:
                if self.on_call:
                    self.on_call({"call": name, **event})
            except Exception:  # noqa: BLE001
                pass

        start = time.time()
        tell(event="start", args=args)
        try:
            out = run()
        except Exception as e:
            tell(event="finish", ok=False, error=str(e), seconds=time.time() - start)
            raise
        tell(event="finish", ok=True, seconds=time.time() - start)
        return out

    def _rows(self) -> DataFrame:
        return self.table("chunks").withColumnRenamed("id", "chunk_id")

    def index(self) -> R.ChunkIndex:
        """The index of the chunks as their files are now."""
        try:
            stamp = file_stamp(self.spark, f"{self.folder}/chunks.parquet")
        except AnalysisException:
            stamp = ""
        if self._index is None or self._index[0] != stamp:
            self._index = (stamp, R.ChunkIndex(self._rows()))
        return self._index[1]

    def _asked(self, questions: str | DataFrame) -> DataFrame:
        if isinstance(questions, str):
            if not questions.strip():
                raise ValueError("the question is empty")
            return self.spark.createDataFrame([(0, questions)], "query_id long, text string")
        return questions

    def search(self, questions: str | DataFrame, limit: int = 10, mode: str = "hybrid") -> DataFrame:
        """Ranked chunks for one text or for a DataFrame (query_id, text)."""
        q = self._asked(questions)
        rows = self._rows().select("chunk_id", "content", "source_id", "heading")
        return self._told("search", lambda: R.search(rows, self.table("sources").select("id", "title"), q, _positive(limit), mode, self.index()), limit=limit, mode=mode)

    def evidence(self, questions: str | DataFrame, limit: int = 10, budget: int = 4000) -> DataFrame:
        """What a model is to answer from: (query_id, alias, chunk_id, tokens) within the budget."""

        def run() -> DataFrame:
            h = R.hybrid(self.index(), self._asked(questions), _positive(limit))
            t = self._rows().groupBy("chunk_id").agg(F.min("token_count").alias("tokens"))
            return R.evidence(h.join(t, "chunk_id").select("query_id", "chunk_id", F.col("rrf").alias("score"), "tokens"), budget)

        return self._told("evidence", run, limit=limit, budget=budget)

    def check_answers(self, answers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
        content = self._rows().select("chunk_id", "content").dropDuplicates(["chunk_id"])
        return self._told("check_answers", lambda: R.checked_answers(answers, evidence.join(content, "chunk_id").select("query_id", "alias", "chunk_id", "content")))

    def route(self, question: str, limit: int = 10) -> tuple[str, DataFrame]:
        rows = self._rows().select("chunk_id", "content")
        return self._told("route", lambda: router.route(question, self.patterns, self.table("concepts"), self.table("edges"), rows, limit), question=question)

    def add(self, texts: DataFrame) -> DataFrame:
        """Append texts(title, content, and url, source_type, scope_kind, scope_key where they are) with their chunks; (id, title) of those
        that are new."""

        def run() -> DataFrame:
            has = lambda c, d: F.col(c) if c in texts.columns else F.lit(d).cast("string")
            new = texts.where("content is not null and content <> ''").select(
                T.short_id(F.col("content")).alias("id"), "title", has("url", None).alias("url"), "content", T.content_hash(F.col("content")).alias("content_hash"), F.coalesce(has("source_type", None), F.lit("file")).alias("source_type"),
                F.current_timestamp().alias("added_at"), F.lit(None).cast("timestamp").alias("compiled_at"), T.word_count(F.col("content")).alias("word_count"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("metadata"),
                has("scope_kind", None).alias("scope_kind"), has("scope_key", None).alias("scope_key"),
            )
            base = self.table("sources").select(new.columns)
            fresh = ingest.insert_sources(base.where("false"), new.join(base.select("content_hash"), "content_hash", "left_anti").select(new.columns)).cache()
            done = fresh.select("id", "title").collect()
            if done:
                pieces = documents.chunk_documents(fresh.select("id", "content", T.detect_format(F.col("content")).alias("format"))).withColumnRenamed("id", "source_id")
                rows = ingest.chunk_rows(pieces).withColumn("embedding_model", F.lit(None).cast("string")).withColumn("embedded_at", F.lit(None).cast("timestamp"))
                rows.select("id", "source_id", "content", "content_hash", "chunk_type", "heading", "position", "token_count", "embedding_model", "embedded_at").write.mode("append").parquet(f"{self.folder}/chunks.parquet")
                fresh.write.mode("append").parquet(f"{self.folder}/sources.parquet")
            fresh.unpersist()
            return self.spark.createDataFrame([(r.id, r.title) for r in done], "id string, title string")

        return self._told("add", run)

    def compile_input(self) -> DataFrame:
        return folds.compile_input(self.table("chunks"))

    def status(self) -> DataFrame:
        """(name, value) of counts and density."""

        def run() -> DataFrame:
            rows = [(n, float(self.table(n).count())) for n in ("sources", "chunks", "concepts", "edges")]
            d = self.graph.density()
            return self.spark.createDataFrame([*rows, ("density", d)], "name string, value double")

        return self._told("status", run)

    def profile(self) -> DataFrame:
        return self._told("profile", lambda: telemetry.cost_avoided(self.table("query_log")))

    def due(self, connectors: DataFrame) -> DataFrame:
        """What a watcher has to run now."""
        return ingest.due(connectors, F.current_timestamp())

    def close(self) -> None:
        self._index = None

    # -- the same as tools

    TOOLS = {
        "search": "Ranked chunks for a text", "add": "Append texts", "status": "Counts and density", "profile": "Sessions and what skills saved", "god_nodes": "Nodes of the highest degree", "pagerank": "Nodes by rank",
        "neighbours": "Nodes within some hops", "path": "The shortest path between two nodes", "communities": "Nodes by community", "concept": "One concept", "ask": "Evidence for a question within a budget of tokens",
    }

    def call(self, tool: str, **args: Any) -> DataFrame:
        where = {"search": self.search, "add": self.add, "status": self.status, "profile": self.profile, "ask": self.evidence, "concept": self.concepts.get}
        if tool not in self.TOOLS:
            raise ValueError(f"no such tool: {tool}")
        return where[tool](**args) if tool in where else self._told(tool, lambda: getattr(self.graph, tool)(**args), **args)


def _positive(n: int) -> int:
    if not isinstance(n, int) or n < 1:
        raise ValueError("a limit is a whole number of at least 1")
    return n
