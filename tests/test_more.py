import pytest

from quillspark.functions.stem import stem
from quillspark.operators import folds, retrieval as R, router
from tests.test_core import chunks, graph


@pytest.mark.parametrize("word,want", [
    ("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("electrical", "electr"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("é", "é"), ("a1", "a1"), ("", ""),
])
def test_stem(word, want):
    assert stem(word) == want


def test_stemmed_search(spark):
    q = spark.createDataFrame([(1, "dogs quickly browned")], "query_id long, text string")
    assert R.bm25(chunks(spark), q, stemmed=False).count() == 0
    q = spark.createDataFrame([(1, "dogs")], "query_id long, text string")
    assert [r.chunk_id for r in R.bm25(chunks(spark), q).collect()] == ["c2"]


def test_auto_links(spark):
    rows = [("add-route", "Uses the ROUTER-table and more"), ("router-table", "nothing"), ("ab", "see add route here"), ("x", None), ("y", ""), ("self", "self")]
    df = spark.createDataFrame(rows, "slug string, truth string")
    assert {tuple(r) for r in folds.auto_links(df).collect()} == {("add-route", "router-table"), ("ab", "add-route")} | {(s, m) for s, t in rows if t for m in ("x", "y", "ab") if m != s and m in t.lower()}
    assert folds.auto_links(df.where("false")).count() == 0


PATTERNS = [("entity_lookup", r"^(who|what) is\s+"), ("bad", "("), ("graph_path", r"path (from|between)\s+"), ("neighborhood", r"(related to|neighbors of|connected to)\s+")]


def test_router(spark):
    v, e = graph(spark)
    c = v.selectExpr("slug", "slug as name")
    assert router.path_ends("path between Alpha and Gamma?") == ("alpha", "gamma") and router.path_ends("how does a relate to b") == ("a", "b") and router.path_ends("x") is None
    kind, r = router.route("What is alpha", PATTERNS, c, e, chunks(spark))
    assert kind == "entity_lookup" and r.first().slug == "alpha"
    kind, r = router.route("path from alpha to gamma", PATTERNS, c, e, chunks(spark))
    assert kind == "graph_path" and r.first().hops == 2
    kind, r = router.route("what is related to epsilon", PATTERNS[2:], c, e, chunks(spark))
    assert kind == "neighborhood" and r.count() == 1
    kind, r = router.route("what is brown dog", PATTERNS, c, e, chunks(spark))
    assert kind == "hybrid_search" and r.count() > 0


def test_runs_without_the_training_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['quillspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and not any(k.startswith('p1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
