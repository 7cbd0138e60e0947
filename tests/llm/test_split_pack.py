import random

from hypothesis import given, settings, strategies as st

from quillspark.llm import pack, split


def _check(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    dense = split._dense_prefix(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, e, t in pieces:
        assert a < e and t <= limit
        assert t == split._tokens(split.np.array([e - a]), split.np.array([dense[e] - dense[a]]))[0]
    for (_, e, _), (s, _, _) in zip(pieces, pieces[1:]):
        assert s <= e
    return pieces


def test_sentences_and_overlap():
    text = " ".join(f"Sentence number {i} says a little about topic {i % 7}." for i in range(800))
    pieces = _check(text, 1000, 100)
    for (_, e, _), (s, _, _) in zip(pieces, pieces[1:]):
        assert 60 * 4 <= e - s <= 140 * 4
        assert text[:e].rstrip().endswith(".") and text[s:].startswith("Sentence")


def test_no_pause_at_all():
    for text in ("x" * 48_000, "é" * 9_000, "{}" * 6_000):
        assert len(_check(text, 1000, 100)) > 1


def test_empty_and_short():
    assert split.split_text("") == []
    assert split.split_text("a b") == [(0, 3, 1)]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .\n{}#é", min_size=1, max_size=3000), st.integers(20, 80))
def test_any_text(text, limit):
    _check(text, limit, limit // 10)


def test_split_operator(spark):
    rows = [("sources", "a", "word. " * 2000), ("sources", "b", None), ("sources", "c", ""), ("chunks", "a", "short")]
    df = spark.createDataFrame(rows, "rec_table string, rec_id string, content string").selectExpr("*", "1 as position")
    out = split.split_oversized(df).collect()
    assert {r.rec_id for r in out} == {"a"} and all(r.token_count <= 1000 for r in out)
    assert split.split_oversized(df.where("false")).count() == 0


def test_best_fit_against_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        n = 120
        sizes = [rng.randint(0, 100) for _ in range(n)]
        srcs = [rng.randint(0, 5) for _ in range(n)]
        clusters = [rng.randint(0, 60) for _ in range(n)]
        where, residual = pack.pack_items(sizes, srcs, clusters, 100)
        held = {}
        for i, b in enumerate(where):
            held.setdefault(b, []).append(i)
        for b, items in held.items():
            assert sum(sizes[i] for i in items) == 100 - residual[b] >= 0
            assert len({clusters[i] for i in items}) == len(items)
        # brute force: the same order, the tightest compatible bin by linear search
        order = sorted(range(n), key=lambda i: (-sizes[i], clusters[i], i))
        total = sum(sizes)
        share = {s: sum(z for z, q in zip(sizes, srcs) if q == s) for s in set(srcs)}
        quota = {s: max(50, min(100, int(150 * v / total))) for s, v in share.items()}
        bins = []
        for i in order:
            ok = [b for b in bins if b[0] >= sizes[i] and clusters[i] not in b[1] and b[2].get(srcs[i], 0) + sizes[i] <= max(quota[srcs[i]], sizes[i])]
            b = min(ok, key=lambda b: b[0]) if ok else None
            if b is None:
                b = [100, set(), {}]
                bins.append(b)
            b[0] -= sizes[i]
            b[1].add(clusters[i])
            b[2][srcs[i]] = b[2].get(srcs[i], 0) + sizes[i]
        assert abs(len(bins) - len(residual)) <= 2


def test_hot_copies_are_linear():
    n = 6000
    where, residual = pack.pack_items([30] * n, [1] * n, [7] * n)
    assert len(set(where)) == n


def test_pack_documents(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "", "s"), (3, None, "s"), (4, "word " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 as cluster", "'x' as container")
    out = pack.pack_documents(df).toPandas()
    assert (out.groupby("container").n_tokens.sum() <= 2048).all()
    assert sorted(out[out.doc_id < 4].doc_id) == [1, 1, 2]
    assert out[out.doc_id == 4].n_tokens.sum() == len(pack.load_tokenizer().encode_ordinary("word " * 5000))
    assert out[out.doc_id == 1].container.nunique() == 2
    assert pack.pack_documents(df.where("false")).count() == 0


def test_overlap_is_what_is_asked_for():
    import pytest

    text = " ".join(f"Sentence number {i} goes on." for i in range(3000))
    cuts = split.split_text(text, 400, 200)
    assert all(t <= 400 for _, _, t in cuts) and cuts[-1][1] == len(text)
    assert all(150 <= split.split_text(text[b : a2], 10**9, 0)[0][2] <= 250 for (_, a2, _), (b, _, _) in zip(cuts, cuts[1:]))
    with pytest.raises(ValueError):
        split.split_text(text, 100, 100)
