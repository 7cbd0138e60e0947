import pytest

from quillspark.engine import Engine
from quillspark.sources.connector import ConnectorSource, pull_folder


def test_add_search_and_lists(spark, tmp_path):
    events = []
    e = Engine(spark, str(tmp_path), [("graph_path", r"path (from|between)\s+")], events.append)
    assert e.sources.count() == 0 and e.search("anything").count() == 0
    docs = spark.createDataFrame([("A", "# Foxes\n\nThe quick brown fox jumps over dogs."), ("B", "Plain text on rivers and foxes."), ("C", "Plain text on rivers and foxes."), ("D", ""), ("E", None)], "title string, content string")
    assert {r.title for r in e.add(docs).collect()} <= {"A", "B", "C"} and e.sources.count() == 2 and e.add(docs).count() == 0
    hits = e.search("fox river", 5, "tfidf").collect()
    assert hits and {h.title for h in hits} <= {"A", "B", "C"}
    assert e.search("fox").count() == 3  # the heading, its paragraph and the other text and e.chunks.list(1).count() == 1 and e.sources.list(source_type="file").count() == 2 and e.sources.get("none").count() == 0
    ev = e.evidence("fox", budget=1000)
    answers = ev.select("query_id").distinct().selectExpr("query_id", "'so [1]' as answer", "'answered' as verdict", "array(named_struct('marker', '1', 'chunk_id', 'C1', 'quote', '')) as citations")
    a, c = e.check_answers(answers, ev)
    assert a.first().verdict == "answered" and c.count() == 1
    assert {r.name: r.value for r in e.status().collect()}["sources"] == 2.0 and e.graph.density() is None
    assert {x["event"] for x in events} == {"start", "finish"} and events[0]["call"] == "search"
    with pytest.raises(ValueError):
        e.search(" ")
    with pytest.raises(ValueError):
        e.search("x", 0)


def test_tools(spark, sf_dir):
    e = Engine(spark, sf_dir)
    top = e.call("god_nodes", limit=3).collect()
    assert len(top) == 3 and set(e.TOOLS) >= {"search", "path", "communities"}
    a = top[0].slug
    assert e.call("path", start=a, end=a).first().hops == 0 and e.call("concept", key=a).count() == 1 and e.call("neighbours", slug=a, depth=1).count() > 1
    kind, r = e.route("what is something unknown")
    assert kind == "hybrid_search" and "rrf" in r.columns
    with pytest.raises(ValueError):
        e.call("nothing")


def test_connector_stream(spark, tmp_path):
    notes = tmp_path / "notes"
    (notes / ".hidden").mkdir(parents=True)
    (notes / "a-b.md").write_text("first")
    (notes / ".hidden" / "x.md").write_text("no")
    items, state = pull_folder({"path": str(notes)}, {})
    assert [(t, c) for _, t, c in items] == [("a b", "first")] and pull_folder({"path": str(notes)}, state)[0] == []
    spark.dataSource.register(ConnectorSource)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        s = spark.readStream.format("quillspark_connector").option("type", "folder").option("config", f'{{"path": "{notes}"}}').load()
        q = s.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", ck).start()
        q.processAllAvailable()
        q.stop()

    run()
    (notes / "c.txt").write_text("second")
    run()
    assert {r.content for r in spark.read.parquet(out).collect()} == {"first", "second"}
