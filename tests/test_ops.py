import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import detect as X, text as T
from quillspark.operators import documents as D, folds, graph as G, ingest as I, retrieval as R, router, sync, telemetry
from quillspark.sources import files


def column(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r.x for r in df.select(f(F.col("t")).alias("x")).collect()]


def test_scrub_cases(spark):
    cases = {
        "-john@x.com": "-<REDACTED:email>", "..foo@x.com": "..<REDACTED:email>", "%bar@x.com,": "%<REDACTED:email>,", "/home/alice/x": "/home/<USER>/x", "/Users/bob": "/Users/<USER>",
        "call 415-555-0123 or (415) 555-0123": "call <REDACTED:phone> or <REDACTED:phone>", "5(415) 555-0123": "5(415) 555-0123", "192.168.1.20 172.20.0.1 172.40.0.1 8.8.8.8": "<REDACTED:private_ip> <REDACTED:private_ip> 172.40.0.1 8.8.8.8",
        "4111 1111 1111 1111 and 4111 1111 1111 1112": "<REDACTED:credit_card> and 4111 1111 1111 1112", "": "", "a\n/home/x y": "a\n/home/<USER> y", "é@x.com": "é@x.com",
    }
    assert dict(zip(cases, column(spark, T.scrub, *cases))) == cases
    assert column(spark, T.scrub, None) == [None]
    df = spark.createDataFrame([(1, "a@b.co c@d.co +14155550123"), (2, "clean"), (3, None)], "id int, t string")
    assert [r.redactions for r in T.scrubbed(df, "t").orderBy("id").collect()] == [{"email": 2, "phone_e164": 1}, {}, {}]
    assert [r.reason for r in T.strict(df, "t").orderBy("id").collect()] == ["patterns detected: email, phone_e164", None, None]
    assert T.scrubbed(df, "t", ("email", "phone_e164")).where("id = 1").first().t == "a@b.co c@d.co +14155550123"


def test_markdown_chunks():
    text = "---\ntitle: x\n---\n# One\nfirst line\n   \nsame block\n\n- a\n- b\n\n```py\n# no heading\n\nx = 1\n```\n## Two\n> said\n"
    got = D.chunk_markdown(text, 1, 1000)
    assert got == [("---\ntitle: x\n---", "frontmatter", None), ("# One", "heading", "One"), ("first line\n   \nsame block", "paragraph", "One"), ("- a\n- b", "list", "One"), ("```py\n# no heading\n\nx = 1\n```", "code", "One"), ("## Two", "heading", "Two"), ("> said", "blockquote", "Two")]
    assert [c[1] for c in D.chunk_markdown("# " + "Word. " * 2000, 50, 100)][:2] == ["heading", "heading"]  # a huge heading is split too
    assert D.chunk_markdown("a\n\n| x | y |\n| - | - |", 50)[0][1] == "table" and D.chunk_markdown("") == []


def test_html_chunks():
    html = '<nav>menu</nav><h2>A <b>b</b></h2><p>Some <strong>bold</strong>, <em>it</em>, <code>f(x)</code> &amp; <a class="l" href="u">link</a>.</p><ul><li>one</li><li>two</li></ul><blockquote>q1\nq2</blockquote><pre><code>x &lt; 1</code></pre>'
    md = D.html_to_markdown(html)
    assert md == "menu\n## A b\nSome **bold**, *it*, `f(x)` & [link](u).\n\n- one\n- two\n> q1\n> q2\n\n```\nx < 1\n```"
    assert ("## A b", "heading", "A b") in D.chunk(html, "html", 1)


def test_running_fold_over_buckets(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, rng.choice([-1, 1, 2])) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for how in ("sum", "max"):
        got = {r.i: r.x for r in folds.running(df, "k", F.floor(F.col("i") / 40), ["i"], "v", how, "x").collect()}
        want = {}
        for k, i, _ in rows:
            before = [v for a, b, v in rows if a == k and b < i]
            want[i] = (sum(before) if how == "sum" else max(before)) if before else None
        assert got == want


def loop_merge(existing, incoming):
    """The rule one concept at a time."""
    words = lambda t: {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if len(w) > 2}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pool = [(s, t, score, n) for s, t, score, n in existing]
    out = {}
    for slug, text in incoming:
        fit = []
        for s, t, score, n in pool:
            a, b = words(text), words(t)
            if min(len(a), len(b)) >= 4 and 1 - distance(slug, s) / max(len(slug), len(s)) >= 0.7 - 1e-9 and len(a & b) / len(a | b) >= 0.6 - 1e-9:
                fit.append((-score, -n, s))
        out[slug] = min(fit)[2] if fit else slug
        if not fit:
            pool.append((slug, text, 0, 0))
    return out


def test_merge_on_write_equals_the_loop(spark):
    rng = random.Random(11)
    base = [(f"topic-{c}{c}{c}-main", [f"word{c}{i}" for i in range(8)]) for c in "abcdef"]
    existing, incoming = [], []
    for n in range(60):
        slug, words = rng.choice(base)
        words = [w if rng.random() > 0.15 else f"other{rng.randrange(6)}" for w in words]
        row = (f"{slug}{n}", " ".join(words))
        existing.append((*row, rng.randrange(3), rng.randrange(5))) if n < 8 else incoming.append(row)
    e = spark.createDataFrame([(s, "k", "x", t, a, b) for s, t, a, b in existing], "slug string, scope_kind string, scope_key string, content string, score long, mention_count long")
    i = spark.createDataFrame([(s, q, "k", "x", t) for q, (s, t) in enumerate(incoming)], "slug string, seq long, scope_kind string, scope_key string, content string")
    got = {r.slug: r.canonical for r in folds.merge_on_write(e, i).collect()}
    want = loop_merge(existing, incoming)
    assert got == want and 3 < sum(k != v for k, v in want.items()) < len(want)


def test_checked_answers(spark):
    a = spark.createDataFrame([(1, "x [1] [2]", "answered", [("1", "C1", "q"), ("2", "C9", "")]), (2, "y [1]", "answered", [("1", "C1", "")]), (3, "[7]", "no_evidence", []), (4, "z", "sure", None)], "query_id long, answer string, verdict string, citations array<struct<marker:string,chunk_id:string,quote:string>>")
    al = spark.createDataFrame([(1, "C1", "c1", "text"), (2, "C1", "c2", "t" * 300)], "query_id long, alias string, chunk_id string, content string")
    answers, cites = R.checked_answers(a, al)
    assert {r.query_id: r.verdict for r in answers.collect()} == {1: "uncertain", 2: "answered", 3: "no_evidence", 4: "uncertain"}
    assert {(r.query_id, r.chunk_id, r.quote) for r in cites.collect()} == {(1, "c1", "q"), (2, "c2", "t" * 200)}


def test_phrases(spark):
    c = spark.createDataFrame([("a", "the quick-brown fox"), ("b", "brown quick fox"), ("c", "quick brown quick brown"), ("a", "the quick-brown fox"), ("d", None), ("e", "Café au lait")], "chunk_id string, content string")
    find = lambda text: {r.chunk_id for r in R.bm25(c, spark.createDataFrame([(1, text)], "query_id long, text string")).collect()}
    assert find("quick-brown") == {"a", "c"} and find("quick brown") == {"a", "b", "c"} and find("fox quick-brown") == {"a"} and find("cafe") == {"e"} and find("") == set() and find("-") == set()
    assert R.search(c.selectExpr("chunk_id", "content", "chunk_id as source_id", "'h' as heading"), spark.createDataFrame([("a", "A")], "id string, title string"), spark.createDataFrame([(1, "fox")], "query_id long, text string")).where("source_id = 'a'").first().title == "A"
    with pytest.raises(ValueError):
        R.search(c, c, c, mode="none")


def test_feeds_and_files(spark, tmp_path):
    xml = "<feed><entry><id>http://x/2301.00001v2</id><title> A\n b </title><published>2025</published><summary> s </summary></entry><entry><title>no id</title></entry></feed>"
    e = I.feed_entries(spark.createDataFrame([("f", xml), ("g", ""), ("h", None)], "feed string, xml string"))
    assert [(r.entry_id, r.title, r.body) for r in e.collect()] == [("2301.00001", "A b", "s")]
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, mtime long")
    before = spark.createDataFrame([("a", 1), ("b", 1), ("z", 9)], "path string, mtime long")
    changed, state = I.changed_files(now, before)
    assert {tuple(r) for r in changed.collect()} == {("b", 2), ("c", 3)} and {tuple(r) for r in state.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "e.jsonl").write_text("")
    assert files.read_dataset(spark, str(tmp_path / "x.csv")).count() == 1
    for bad in ("e.jsonl", "y.doc"):
        with pytest.raises(Exception):
            files.read_dataset(spark, str(tmp_path / bad))
    notes = files.front_matter(spark.createDataFrame([("d/my-note.md", "---\ntags: [a, b]\nsource: http://u\n---\n# Head\ntext #c"), ("x.md", None)], "path string, content string"))
    v = {r.path: r for r in files.vault_items(notes.drop("content")).collect()}
    assert (v["d/my-note.md"].title, v["d/my-note.md"].url, v["d/my-note.md"].tags) == ("Head", "http://u", ["a", "b", "c"]) and v["x.md"].title == "x"


def test_detection(spark):
    assert column(spark, X.source_type, "dQw4w9WgXcQ", "https://arxiv.org/abs/1", "git@github.com:a/b.git", "https://github.com/a/b/blob/x", "https://x.example/a.PDF", "d/x.csv", "x.png", "notes.md", None) == ["youtube", "arxiv", "code", "url", "pdf", "dataset", "image", "file", None]
    assert column(spark, X.js_shell, '<div id="root"></div>', "<p>" + "x" * 600 + "</p>", "<noscript>", None) == [True, False, True, None]
    assert column(spark, X.wikilinks, "[[a]] and [[b|c]] [[]]") == [["a", "b"]]
    assert column(spark, X.timed_text, '<text start="1">a &amp;amp; b</text><text> </text><text>c\nd</text>') == ["a &amp; b c d"]
    df = spark.createDataFrame([("package.json", '{"dependencies": {"react": "1"}}'), ("go.mod", "require github.com/x/gin v1.2"), ("requirements.txt", "django==4\n"), ("README", "react")], "m string, c string")
    assert [r.f for r in df.select(X.frameworks(F.col("m"), F.col("c"), ("react", "gin", "django")).alias("f")).collect()] == [["react"], ["gin"], ["django"], []]


def test_trajectory_limits(spark):
    ok = {"task": "t", "outcome": "success", "steps": [{"n": 0, "tool": "x", "args": {"a": "b"}, "result_summary": "s" * 600, "result_ok": True}]}
    rows = [("a", json.dumps(ok)), ("b", json.dumps({"task": "t", "steps": []})), ("c", json.dumps({**ok, "steps": ok["steps"] * 51})), ("d", "{"), ("e", None)]
    v = I.validated(I.trajectories(spark.createDataFrame(rows, "id string, content string")))
    got = {r.id: (r.reason, r.steps) for r in v.collect()}
    assert {k: x[0] for k, x in got.items()} == {"a": None, "b": "no_steps", "c": "too_many_steps"} and len(got["a"][1][0].result_summary) == 500
    c = {r.position: r for r in I.trajectory_chunks(v).collect()}
    assert set(c) == {0, 1} and c[1].content.startswith("step 0: x(a=b)\nresult: ok - sss")


def test_exchange(spark):
    ids = [f"{i:012x}-{i:020x}" for i in range(250)]
    j = spark.createDataFrame([(x, None) for x in ids + ids[:50]], "sync_id string, pushed_at timestamp")
    b = {r.sync_id: r.batch for r in sync.push_batches(j).collect()}
    assert b == {x: n // 100 for n, x in enumerate(ids)}
    p = sync.pull_pages(j, spark.createDataFrame([("a", ""), ("b", ids[200])], "device string, cursor string"), 100).collect()
    assert {(r.device, r.next_cursor) for r in p} == {("a", ids[99]), ("b", None)} and sum(r.device == "b" for r in p) == 49
    assert sync.push_batches(j.where("false")).count() == 0


def test_router(spark):
    assert router.path_ends("how does from A to B connect") == ("a", "b-connect") and router.path_ends("connect X and Y") == ("x", "y") and router.path_ends("how is x link to y") == ("x", "y")


def test_communities_rest(spark):
    v = spark.createDataFrame([(x,) for x in "abcdefgh"], "slug string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("g", "g")], "from_slug string, to_slug string")
    got = {r.slug: (r.community, r["size"]) for r in G.community_ids(G.communities(v, e)).collect()}
    assert got["a"] == got["b"] == got["c"] == (0, 3) and got["d"] == got["f"] == (1, 3) and got["g"][1] == got["h"][1] == 1
    assert G.communities(v, e.where("false")).where("slug = label").count() == 8


def test_percentiles_of_hot_keys(spark):
    rows = [(i, "t", i % 7) for i in range(100)] + [(200, "u", 5), (201, "v", None)]
    got = {r.k: (r.p50, r.p95, r.p99) for r in telemetry.latency_percentiles(spark.createDataFrame(rows, "id int, k string, latency_ms long"), "k").collect()}
    s = sorted(i % 7 for i in range(100))
    assert got == {"t": (s[50], s[95], s[99]), "u": (5, 5, 5)}


def test_long_texts_without_sentence_ends():
    import re
    import time

    start = time.time()
    assert D.chunk_plain("word " * 40_000, 50, 100) and D.sentences("word " * 40_000) == [] and time.time() - start < 10
    for t in ("A b. C d! E", "no end", "...", "a.  b?\n", "", ".x. y", "x!!  "):
        assert D.sentences(t) == re.findall(r"[^.!?]+[.!?]+\s*", t), t
