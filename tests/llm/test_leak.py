import random

import numpy as np

from quillspark.llm import leak


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 9, 13, 30, 50])))) for i in range(25)]
    docs = []
    for d in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            t = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(t) - 12))
            w[len(w) // 2 : len(w) // 2] = t[a : a + rng.choice([12, 13, 20])]
        docs.append((d, ", ".join(w).title() if d % 2 else " ".join(w)))
    return docs, items


def brute(docs, items, edits=0):
    out = set()
    for d, t in docs:
        w = leak.words_of(t)
        for i, x in items:
            q = leak.words_of(x)
            m = min(13, len(q))
            for p in range(len(q) - m + 1) if m else ():
                want = q[p : p + m]
                for n in range(m - edits, m + edits + 1):
                    if any(leak.edit_distance(w[s : s + n], want, edits) <= edits for s in range(len(w) - n + 1)):
                        out.add((d, i))
    return out


def test_exact_against_brute_force():
    docs, items = corpus()
    assert leak.ItemBlock(items, 13, 0, 1).pairs(docs) == brute(docs, items)


def test_near_recall():
    docs, items = corpus(2)
    want = brute(docs, items, 1)
    reps = leak.repetitions_for(items, 13, 1, 0.95)
    got = leak.ItemBlock(items, 13, 1, reps).pairs(docs)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_walk_and_distance():
    h = np.array([leak._hash(w) for w in "a b c d e f g h i j k l m n".split()], dtype=np.uint64)
    plan = {13: leak.samples(39, 1)}
    k = leak.sampled_keys(h, np.array([0, 1]), 13, 13, plan)[13][0]
    again = leak.sampled_keys(np.concatenate((h[:1], h)), np.array([1]), 13, 13, plan)[13][0]
    assert k[0] == again[0] != k[1]
    assert leak.edit_distance("abcd", "abd", 2) == 1 and leak.edit_distance("abcd", "xyz", 1) == 2


def test_operator(spark):
    docs, items = corpus(3)
    rows = docs + [docs[0], (900, None), (901, ""), (902, "Straße_12 ñandú " * 3)]
    its = items + [(100, ""), (101, None), (102, "STRASSE"), (103, "straße 12 ÑANDÚ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as item_id")
    i = spark.createDataFrame(its, "item_id long, text string").selectExpr("*", "7 as doc_id")
    want = brute(docs, items) | {(902, 103)}
    assert {tuple(r) for r in leak.find_leaks(d, i).collect()} == want
    assert {tuple(r) for r in leak.find_leaks(d, i, block_windows=50).collect()} == want
    assert leak.find_leaks(d, i.where("false")).count() == 0 and leak.find_leaks(d.where("false"), i).count() == 0


def test_near_recall_of_edited_windows():
    """Only pairs with an edit, for each size of window; what meets is measured on other edits than those that chose the repetitions."""
    rng = random.Random(11)
    for m in (4, 6, 9, 13):
        items = [(i, " ".join(f"w{i}x{k}" for k in range(m))) for i in range(400)]
        docs = [(i, " ".join(["before", *leak.edited(t.split(), 1, rng), "after"])) for i, t in items]
        got = leak.ItemBlock(items, 13, 1, leak.repetitions_by_size(items, 13, 1, 0.95)).pairs(docs)
        assert got <= {(i, i) for i, _ in items} and len(got) >= 0.94 * len(items), (m, len(got))


def test_joined_keys_find_the_same(spark):
    docs, items = corpus(6, 90)
    its = items + [(100, ""), (101, None), (103, "straße 12 ÑANDÚ")]
    d = spark.createDataFrame(docs + [docs[0], (900, None), (901, ""), (902, "Straße_12 ñandú " * 3)], "doc_id long, text string")
    i = spark.createDataFrame(its, "item_id long, text string")
    assert {tuple(r) for r in leak.joined_leaks(d, i).collect()} == brute(docs, items) | {(902, 103)}
    want = brute(docs, items, 1)
    got = {tuple(r) for r in leak.joined_leaks(d, i, edits=1).collect()} - {(902, 103)}
    assert got <= want | {(902, 103)} and len(got) >= 0.95 * len(want)
    assert {tuple(r) for r in leak.find_leaks(d, i, block_windows=20).collect()} == brute(docs, items) | {(902, 103)}  # so many blocks are joined
    assert leak.joined_leaks(d, i.where("false")).count() == 0 and leak.joined_leaks(d.where("false"), i).count() == 0
