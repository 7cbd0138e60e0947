import random

import numpy as np

from quillspark.llm import neardup as d


def corpus(seed, n=400, words=(20, 120), vocab=3000):
    rng = random.Random(seed)
    pool = [f"word{i}" for i in range(vocab)] + ["the", "and", "for", "with"] * 40
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(t) // 5))):
                p = rng.randrange(len(t))
                t[p : p + 1] = rng.choice([[], [rng.choice(pool)], [t[p], rng.choice(pool)]])
            rng.shuffle(t) if rng.random() < 0.2 else None
        else:
            t = [rng.choice(pool) for _ in range(rng.randint(*words))]
        texts.append(" ".join(t) or "x")
    return texts


def brute(texts, t=0.7, least=20):
    s = [set(d._WORD.findall(x.lower())) for x in texts]
    return {(j, i) for i in range(len(s)) for j in range(i) if min(len(s[i]), len(s[j])) >= least and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-9}


def one_block(sets):
    n = len(sets)
    return d.block_candidates(np.zeros(n, dtype=np.int64), np.full(n, 3), np.arange(n), [d.bitmap(s) for s in sets], np.array([len(s) for s in sets]), 0.7)


def test_tree_rules_nothing_out_wrongly():
    for texts in (corpus(1), corpus(5, 120, (200, 420), 8000)):
        a, b = one_block([d.word_set(x) for x in texts])
        got, want = set(zip(a.tolist(), b.tolist())), brute(texts)
        assert len(want) > 20 and want <= got and len(got) < len(texts) ** 2 / 20


def test_many_blocks_are_as_many_trees():
    sets = [d.word_set(x) for x in corpus(6, 300)]
    rng = np.random.default_rng(6)
    block = np.sort(rng.choice([1, 2, 3, 5, 8, 13], 300, p=[0.6, 0.2, 0.1, 0.06, 0.03, 0.01]))
    wide, sizes = [d.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    got = set(zip(*(x.tolist() for x in d.block_candidates(block, np.full(300, 3), np.arange(300), wide, sizes, 0.7))))
    want = set()
    for k in np.unique(block):
        own = np.flatnonzero(block == k)
        a, b = d.block_candidates(block[own], np.full(len(own), 3), own, [wide[i] for i in own], sizes[own], 0.7)
        want |= set(zip(a.tolist(), b.tolist()))
    assert want and got == want


def test_sides_of_a_split_block():
    sets = [d.word_set(x) for x in corpus(7, 200)]
    wide, sizes, side = [d.bitmap(s) for s in sets], np.array([len(s) for s in sets]), np.arange(200) % 2 + 1
    run = lambda s: set(zip(*(x.tolist() for x in d.block_candidates(np.zeros(200, dtype=np.int64), s, np.arange(200), wide, sizes, 0.7))))
    every = run(np.full(200, 3))
    assert run(side) == {(a, b) for a, b in every if (a - b) % 2} and run(side)


def test_blocks_find_what_brute_force_finds():
    for seed in (2, 3):
        texts = corpus(seed)
        sets = [d.word_set(x) for x in texts]
        w, c = np.unique(np.concatenate(sets), return_counts=True)
        keys = [d.block_keys(s, w[c > 0.05 * len(sets)]) for s in sets]
        own = np.repeat(np.arange(len(sets)), [len(k) for k in keys])
        bits = [d.bitmap(s) for s in sets]
        i, j = d.block_candidates(np.concatenate(keys), np.full(len(own), 3), own, [bits[k] for k in own], np.array([len(s) for s in sets])[own], 0.7)
        got, want = set(zip(i.tolist(), j.tolist())), brute(texts)
        assert len(want) > 100 and len(want - got) <= 0.01 * len(want)


def test_rows_of_a_record_do_not_grow_with_partitions(spark):
    rows = [("sources", f"k{i}", t) for i, t in enumerate(corpus(8, 120, (90, 300)))]
    c = d.word_sets(spark.createDataFrame(rows, "rec_table string, key string, text string")).select("cls", "n", "words").dropDuplicates(["cls"])
    per = d.block_rows(c, np.zeros(0, dtype=np.uint64)).groupBy("cls").count().agg({"count": "max"}).first()[0]
    assert per <= 3 * (d.PAIRS + d.TRIPLES)
    links = [{tuple(r) for r in d.similar_classes(c, partitions=p).collect()} for p in (1, 6, 280)]
    assert links[0] and links[0] == links[1] == links[2]
    assert {tuple(r) for r in d.similar_classes(c, hot=8).collect()} == links[0]  # split blocks


def test_operators(spark):
    texts = corpus(4, 250) + ["", "too short"]
    rows = [("sources", f"k{i:03d}", t) for i, t in enumerate(texts)] + [("sources", "zz", None), ("sources", "k000", texts[0])]
    df = spark.createDataFrame(rows, "rec_table string, key string, text string").selectExpr("*", "1 as cls", "'x' as a")
    want = {(f"k{i:03d}", f"k{j:03d}") for i, j in brute(texts)}
    got = {(r.key_a, r.key_b) for r in d.duplicate_pairs(df).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want)
    parent = {r[1]: r[1] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    groups = {r.key: r.group_id for r in d.duplicate_groups(df).collect()}
    assert groups == {k: root(k) for k in parent}
    assert d.duplicate_pairs(df.where("false")).count() == 0 and d.duplicate_groups(df.where("false")).count() == 0


def test_key_similarity(spark):
    t = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([("c", "add-route", t), ("c", "add-routes", t + " more"), ("c", "quite-other", t)], "rec_table string, key string, text string")
    assert [tuple(r) for r in d.duplicate_pairs(df, key_similarity=0.7).collect()] == [("c", "add-route", "add-routes")]


def test_long_texts_of_a_template(spark):
    """Shared words are common, edited words rare: pairs at J = 0.7 agree on few keys of those they hold."""
    texts, names = [], []
    for t in range(10):
        for i in range(12):
            texts.append(" ".join([f"template{t}x{k}" for k in range(593)] + [f"own{t}x{i}x{k}" for k in range(127)]))
            names.append(f"{t}-{i:02d}")
    df = spark.createDataFrame([("sources", k, x) for k, x in zip(names, texts)], "rec_table string, key string, text string")
    want = {(names[i], names[j]) for i, j in brute(texts)}
    assert len(want) == 660 and {(r.key_a, r.key_b) for r in d.duplicate_pairs(df).collect()} == want


def test_groups_by_key_similarity(spark):
    t = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([("c", "add-route", t), ("c", "add-routes", t + " more"), ("c", "quite-other", t), ("c", "none", None)], "rec_table string, key string, text string")
    got = {(r.key, r.group_id, r.links) for r in d.duplicate_groups(df, key_similarity=0.7).collect()}
    assert got == {("add-route", "add-route", 1), ("add-routes", "add-route", 1), ("quite-other", "quite-other", 0), ("none", "none", 0)}


def test_query_groups_concepts(spark, sf_dir):
    from quillspark.llm import queries

    got = {r.rec_table: r["count"] for r in queries.p1_groups(spark, sf_dir).groupBy("rec_table").count().collect()}
    assert got["concepts"] == spark.read.parquet(f"{sf_dir}/concepts.parquet").select("slug").distinct().count() and got["sources"]
