import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.estimate import token_estimate
from quillspark.operators import documents as D, folds, graph as G, retrieval as R, telemetry
from quillspark.sources import files
from quillspark.streaming import jobs


def one(spark, col, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(col(*[F.col(n) for n in names]).alias("x")).first().x


def test_text_goldens(spark):
    assert [one(spark, T.search_tokens, x) for x in ("Hello World", "myFunctionName", "my_function_name", "I am a cat")] == [["hello", "world"], ["my", "function", "name"], ["my", "function", "name"], ["am", "cat"]]
    assert one(spark, T.slug, "Self-Attention Is All") == "self-attention-is-all" and one(spark, T.slug, "--A--") == "a"
    assert one(spark, lambda a, b: T.jaccard(T.set_tokens(a), T.set_tokens(b)), "alpha beta gamma", "beta gamma delta") == 0.5
    assert one(spark, lambda a, b: T.jaccard(T.set_tokens(a), T.set_tokens(b)), "", "beta") == 0
    assert one(spark, T.slug_similarity, "add-route", "add-routes") == pytest.approx(0.9) and one(spark, T.slug_similarity, "", "") == 1
    assert [one(spark, token_estimate, x) for x in ("", "12345678", "f();")] == [0, 2, 2]
    assert one(spark, T.detect_format, "# Hello\n\nWorld") == "markdown" and one(spark, T.detect_format, "<!DOCTYPE html><p>") == "html" and one(spark, T.detect_format, "x") == "plain"
    assert one(spark, T.content_hash, " a\r\nb \t c\n\n\n\nd ") == one(spark, T.content_hash, "a\nb c\n\nd")


def test_scrub(spark):
    text = "a@b.example c@d.example card 4111-1111-1111-1111 id 4111-1111-1111-1112 sk-abcdefghijklmnopqrst12 10.1.2.3 /home/ann/x +14155550123"
    out = one(spark, T.scrub, text)
    assert out.count("<REDACTED:email>") == 2 and "card <REDACTED:credit_card>" in out and "4111-1111-1111-1112" in out
    assert all(x in out for x in ("<REDACTED:openai_token>", "<REDACTED:private_ip>", "/home/<USER>/x", "<REDACTED:phone>"))


def test_snippet(spark):
    long = "x" * 200 + " needle\nhere " + "y" * 300
    s = one(spark, T.snippet, long, "missing Needle")
    assert s.startswith("...") and s.endswith("...") and "needle here" in s
    assert one(spark, T.snippet, long, "nothing") == long[:200]


def chunks(spark):
    rows = [("c1", "quick brown fox"), ("c2", "lazy brown dog and quick dog"), ("c3", "nothing at all"), ("c4", ""), ("c5", None)]
    return spark.createDataFrame(rows, "chunk_id string, content string")


def test_tfidf_against_loops(spark):
    q = spark.createDataFrame([(1, "quick dog"), (2, "quantum"), (3, "")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in R.tfidf(chunks(spark), q, 10).collect()}
    docs = {"c1": ["quick", "brown", "fox"], "c2": ["lazy", "brown", "dog", "and", "quick", "dog"], "c3": ["nothing", "at", "all"]}
    n = 4
    idf = {t: math.log(n / sum(t in d for d in docs.values())) for d in docs.values() for t in d}
    want = {}
    for c, d in docs.items():
        norm = math.sqrt(sum((1 + math.log(d.count(t))) ** 2 for t in set(d)))
        qn = math.sqrt(idf["quick"] ** 2 + idf["dog"] ** 2)
        dot = sum(idf[t] ** 2 * (1 + math.log(d.count(t))) for t in ("quick", "dog") if t in d)
        if dot:
            want[1, c] = dot / (norm * qn)
    assert got == pytest.approx(want)
    assert R.tfidf(chunks(spark).where("false"), q).count() == 0


def test_bm25_needs_all_terms(spark):
    q = spark.createDataFrame([(1, "quick brown"), (2, "quick nothing")], "query_id long, text string")
    hits = R.bm25(chunks(spark), q).collect()
    assert {(r.query_id, r.chunk_id) for r in hits} == {(1, "c1"), (1, "c2")} and {r.score for r in hits} == {0.0, 1.0} or len({r.raw for r in hits}) == 1


def test_rrf_golden(spark):
    lists = [spark.createDataFrame([(1, c, r) for r, c in enumerate(x, 1)], "query_id long, chunk_id string, rank int") for x in (["c1", "c2"], ["c2", "c3"])]
    got = {r.chunk_id: (r.rrf, r["rank"]) for r in R.fuse([("a", 1.0, lists[0]), ("b", 1.0, lists[1])]).collect()}
    assert got == {"c2": (pytest.approx(1 / 62 + 1 / 61), 1), "c1": (pytest.approx(1 / 61), 2), "c3": (pytest.approx(1 / 62), 3)}


def test_budgets(spark):
    items = spark.createDataFrame([(1, "a", 0.5, 20, 1), (1, "b", 0.9, 14, 2), (2, "z", 1.0, 999, 1)], "query_id long, chunk_id string, score double, tokens long, rank int")
    assert [(r.query_id, r.chunk_id) for r in R.select_by_budget(items, 25).collect()] == [(1, "b")]
    assert sorted((r.query_id, r.chunk_id) for r in R.prefix_budget(items, 25).collect()) == [(1, "a"), (2, "z")]


def test_metrics_golden(spark):
    ranked = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id long, chunk_id string, rank int")
    grades = spark.createDataFrame([(1, "a", 3), (1, "b", 1)], "query_id long, chunk_id string, grade int")
    r = R.ranking_metrics(ranked, grades).first()
    assert (r.p1, r.p5, r.rr) == (1, 0.4, 1.0) and r.ndcg5 == pytest.approx((1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)))


def graph(spark):
    nodes = spark.createDataFrame([(x,) for x in ("alpha", "beta", "gamma", "delta", "epsilon")], "slug string")
    edges = spark.createDataFrame([("alpha", "beta", "supports", 0.8, "s"), ("beta", "gamma", "extends", 0.7, "s"), ("alpha", "delta", "related", 0.5, None)], "from_slug string, to_slug string, relation string, weight double, source_id string")
    return nodes, edges


def test_graph_goldens(spark):
    v, e = graph(spark)
    assert {r.slug: r.degree for r in G.degrees(v, e).collect()} == {"alpha": 2, "beta": 2, "gamma": 1, "delta": 1, "epsilon": 0}
    paths = {r.node: (r.hops, r.path) for r in G.shortest_paths(e, "alpha").collect()}
    assert paths["gamma"] == (2, "alpha > beta > gamma") and paths["alpha"] == (0, "alpha") and "epsilon" not in paths
    assert {r.node for r in G.hops_from(e, "alpha", 1).collect()} == {"alpha", "beta", "delta"}
    assert {r.node for r in G.hops_from(e, "epsilon", 2).collect()} == {"epsilon"}
    assert {r.node: r.label for r in G.component_labels(e.selectExpr("from_slug src", "to_slug dst")).collect()} == dict.fromkeys(("alpha", "beta", "gamma", "delta"), "alpha")
    p = {r.slug: r.score for r in G.pagerank(v, e).collect()}
    assert sum(p.values()) == pytest.approx(1, abs=1e-4) and p["alpha"] > p["epsilon"] and p["alpha"] == pytest.approx(p["beta"]) and p["gamma"] == pytest.approx(p["delta"])
    assert {r.slug: r.label for r in G.communities(v, e).collect()}["epsilon"] == "epsilon"
    none = e.where("false")
    assert G.pagerank(v, none, rounds=2).count() == 5 and G.component_labels(none.selectExpr("from_slug src", "to_slug dst")).count() == 0 and G.neighbourhood_edges(none, "x").count() == 0


def test_components_of_long_chains(spark):
    rows = [(i, i + 1) for i in range(1, 200)] + [(1000, 1001), (1001, 1001), (None, 3)]
    got = {r.node: r.label for r in G.component_labels(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 1000: 1000, 1001: 1000}


LOG = "id long, tool_name string, query_text string, result_count long, latency_ms long, session_id string, timestamp timestamp_ntz, tokens_spent long, skill_hit long, exploration_depth long, scope_kind string, scope_key string"


def log(spark, rows):
    full = [(i, "search", None, 1, 10 * (i + 1), s, datetime(2025, 1, 1, 0, 0, i % 60), t, h, None, "codebase" if k else None, k) for i, (s, t, h, k) in enumerate(rows)]
    return spark.createDataFrame(full + full[:1], LOG) if full else spark.createDataFrame([], LOG)


def test_cost_goldens(spark):
    rows = [("a", 1000, 0, "r"), ("b", 1000, 0, "r")] + [(x, 200, 1, "r") for x in "cde"]
    r = telemetry.cost_avoided(log(spark, rows)).first()
    assert (r.hit_rate, r.baseline, r.with_skill, r.saved, r.usd) == (0.6, 1000, 200, 2400, 0.01)
    assert telemetry.cost_avoided(log(spark, [("a", 100, 0, "r"), ("b", 9999, 1, "r")])).first().saved == 0
    r = telemetry.cost_avoided(log(spark, [("a", None, 1, "r"), ("b", 500, 0, "r")])).first()
    assert (r.baseline, r.with_skill, r.hit_sessions, r.saved) == (500, 0, 1, 500)
    e = telemetry.cost_avoided(log(spark, [])).first()
    assert (e.sessions, e.hit_sessions, e.hit_rate, e.saved) == (0, 0, 0.0, 0)
    s = {r.scope_key: r.saved for r in telemetry.cost_by_scope(log(spark, [("a", 800, 0, "x"), ("b", 200, 1, "x"), ("c", 200, 0, "y"), ("d", 100, 1, "y")])).collect()}
    assert s == {"x": 600, "y": 100}


def test_rate_window_and_percentiles(spark):
    df = log(spark, [("s", 1, 0, "r")] * 3)
    r = telemetry.rate_limited(df, "session_id", 60, 2).collect()
    assert [(x.id, x.retry_after) for x in r] == [(2, 58)]
    p = telemetry.latency_percentiles(df, "tool_name").first()
    assert (p.p50, p.p95) == (20, 30)


def test_folds(spark):
    ev = spark.createDataFrame([("a", f"{i:02d}", d, None, datetime(2025, 1, 1 + i)) for i, d in enumerate([1, -1, -1, -1, -1, 1])] + [("b", "90", 1, None, datetime(2025, 1, 1))], "slug string, sync_id string, delta int, reason string, at timestamp_ntz")
    assert {r.slug: (r.score, r.retired_by) for r in folds.retirements(ev).collect()} == {"a": (-2, "04"), "b": (1, None)}
    c = spark.createDataFrame([(s, m) for s, m in (("t1", 6), ("t2", 6), ("t3", 10))], "slug string, mention_count long")
    links = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t1", "c"), ("t2", "a"), ("t2", "b"), ("t3", "a"), ("t3", "a")], "slug string, source_id string")
    assert {r.slug: r.tier for r in folds.tiers(c, links).collect()} == {"t1": 1, "t2": 2, "t3": 3}
    m = spark.createDataFrame([("add-route", "k", "s", "adds one route to the router table"), ("add-routes", "k", "s", "adds one route to the router table now"), ("react-hooks", "k", "s", "hooks keep state inside function parts"), ("add-route-x", "k", "other", "adds one route to the router table")], "slug string, scope_kind string, scope_key string, content string")
    assert [(r.slug_a, r.slug_b) for r in folds.merge_candidates(m).collect()] == [("add-route", "add-routes")]
    ch = spark.createDataFrame([("a", 1, "n1", None, "t1"), ("a", 2, "n2", "s", None)], "slug string, seq int, name string, summary string, truth string")
    assert tuple(folds.upsert_concepts(ch).first()) == ("a", "n2", "s", "t1", 2)


def test_chunkers():
    assert D.chunk_plain("One. Two! three") == [("One. Two! three", "paragraph", None)]
    assert D.split_sentences("One. Two! three", 1) == ["One.", "Two!"]
    md = "---\ntitle: x\n---\n# Head\n\n" + "word " * 60 + "\n\n```py\na = 1\n\nb = 2\n```\n\n- x\n- y\n"
    kinds = [(t, h) for _, t, h in D.chunk_markdown(md)]
    assert kinds == [("frontmatter", None), ("heading", "Head"), ("paragraph", "Head"), ("code", "Head"), ("list", "Head")]
    assert D.chunk("<html><body><h2>Hi</h2><p>Text &amp; more</p><ul><li>a</li></ul></body></html>", "html")[0] == ("## Hi", "heading", "Hi")
    assert D.chunk("", "plain") == [] and all(D.tokens(c) <= 1000 for c, _, _ in D.chunk_plain("A sentence here. " * 3000))


def test_compression():
    text = "\n".join(f"- item {i}" for i in range(10))
    out = D.shorten_lists(text)
    assert out.count("- item") == 5 and "5 more items omitted" in out
    same = "The quick brown fox jumps high. " * 3 + "Something else entirely is here."
    assert D.drop_repeats(same).count("quick") == 1
    assert D.extract("One. Two.") == "One. Two." and D.compress("")[0] == ""
    assert D.compress(" ".join(f"Sentence {i} tells about thing {i * 7}." for i in range(20)))[2] < 200


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,x,b,s,e\n1,1.5,true,"a,b",\n2,2,false,c,\n')
    t = {r.column: (r.type, r.nulls) for r in files.infer_types(files.read_delimited(spark, str(tmp_path / "a.csv"))).collect()}
    assert t == {"n": ("integer", 0), "x": ("float", 0), "b": ("boolean", 0), "s": ("string", 0), "e": ("null", 2)}
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"b": "x"}\n')
    assert files.read_json_lines(spark, str(tmp_path / "a.jsonl")).count() == 2
    d = tmp_path / "notes"
    d.mkdir()
    (d / "my-note.md").write_text("# Hi\n\nthere")
    (d / "x.bin").write_text("no")
    assert [(r.title, r.content) for r in files.read_texts(spark, str(d)).collect()] == [("my note", "# Hi\n\nthere")]
    assert files.parse_front_matter("---\ntitle: A\ntags: [x, 'y']\nurls:\n  - u1\n---\nbody") == ({"title": ["A"], "tags": ["x", "y"], "urls": ["u1"]}, "body")
    v = spark.createDataFrame([("a", 1), ("b", None)], "slug string, n int")
    files.export_json_lines({"concepts": v, "edges": v}, str(tmp_path / "out"))
    base = spark.createDataFrame([("a", 9), ("c", 3)], "slug string, n int")
    back = files.import_json_lines(spark, str(tmp_path / "out"), "concepts", "slug string, n int", ["slug"], base)
    assert {tuple(r) for r in back.collect()} == {("a", 1), ("b", None), ("c", 3)}


def test_streams_match_batch(spark, tmp_path):
    rows = [("s1", 5, 1, "r"), ("s1", None, 0, "r"), ("s2", 7, 0, None)] * 4
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    log(spark, rows).dropDuplicates().write.parquet(src)
    stream = spark.readStream.schema(LOG).parquet(src)
    jobs.write_batches(jobs.call_windows(stream), out, str(tmp_path / "ck"), mode="update").awaitTermination()
    got = spark.read.parquet(out).first()
    assert (got.calls, got.hits, got.tokens) == (12, 4, 48)
    ids = jobs.new_items(spark.readStream.schema(LOG).parquet(src).withColumn("ts", F.col("timestamp").cast("timestamp")), "session_id", "ts").select("session_id")
    jobs.write_batches(ids, str(tmp_path / "o2"), str(tmp_path / "ck2")).awaitTermination()
    assert sorted(r.session_id for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == ["s1", "s2"]
    jobs.write_batches(jobs.gap_sessions(spark.readStream.schema(LOG).parquet(src)), str(tmp_path / "o3"), str(tmp_path / "ck3")).awaitTermination()


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 0.5 * (i > 1)]) for i in range(4)] + [(9, None)], "vec_id long, embedding array<float>")
    q = v.selectExpr("vec_id as query_id", "embedding").where("query_id = 0")
    r = R.nearest_vectors(v, q, 2, block=1).collect()
    assert sorted((x["rank"], x.vec_id) for x in r) == [(1, 0), (2, 1)] and r[0].score == pytest.approx(1.0)
    assert R.nearest_vectors(v, q.where("false")).count() == 0


def test_every_query_runs(spark, sf_dir):
    from quillspark.plans import registry

    for name, query in registry.queries().items():
        df = query(spark, sf_dir)
        assert len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()
