"""Graph operators over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.session import materialize


def component_labels(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label) of the undirected graph edges(src, dst); label is the smallest node of the component.

    Alternating large-star and small-star: each round is two aggregations over the edges, and the number of rounds grows with the
    logarithm of the longest chain. A hot node's neighbours are reduced with partial minima; no neighbour list is built.
    Null ends and self-loops of other nodes are ignored; isolated nodes are the caller's. An empty graph has no rows. A graph that
    isn't at rest after `rounds`, more than any chain that fits in 64-bit counts needs, raises an error.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    e = materialize(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = materialize(small)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not at rest after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (node, neighbour) in both directions, self-loops once; edges(from_slug, to_slug)."""
    e = edges.select("from_slug", "to_slug").where("from_slug is not null and to_slug is not null")
    return e.select(F.col("from_slug").alias("node"), F.col("to_slug").alias("neighbour")).unionByName(e.select(F.col("to_slug").alias("node"), F.col("from_slug").alias("neighbour"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slug, degree): edges at either end; a self-loop counts once, parallel relations each."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_slug", "to_slug"))).alias("slug")).groupBy("slug").agg(F.count("*").alias("degree"))
    return nodes.select("slug").join(ends, "slug", "left").select("slug", F.coalesce("degree", F.lit(0)).alias("degree"))


def hops_from(edges: DataFrame, start: str, depth: int = 6) -> DataFrame:
    """(node, hops) of the nodes within `depth` hops, the start itself at 0 even if it has no edge. One frontier join per level."""
    spark = edges.sparkSession
    und = undirected(edges).where("node <> neighbour")
    seen = spark.createDataFrame([(start, 0)], "node string, hops int")
    front = seen
    for d in range(1, depth + 1):
        step = und.join(front.select("node"), "node", "left_semi").select(F.col("neighbour").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = materialize(step.withColumn("hops", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, start: str, depth: int = 6) -> DataFrame:
    """(node, hops, path): of paths with equal hops the one whose parent is smallest at every step."""
    spark = edges.sparkSession
    und = undirected(edges).where("node <> neighbour")
    seen = spark.createDataFrame([(start, 0, start)], "node string, hops int, path string")
    front = seen
    for d in range(1, depth + 1):
        step = und.join(front.select("node", "path"), "node").groupBy("neighbour").agg(F.min(F.struct("node", "path")).alias("p"))
        step = step.select(F.col("neighbour").alias("node"), F.concat_ws(" > ", "p.path", "neighbour").alias("path")).join(seen.select("node"), "node", "left_anti")
        front = materialize(step.select("node", F.lit(d).alias("hops"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbourhood_edges(edges: DataFrame, centre: str, depth: int = 2) -> DataFrame:
    """Edges with an end within depth - 1 hops of the centre, each once."""
    inner = hops_from(edges, centre, depth - 1).select("node")
    a = edges.join(inner.withColumnRenamed("node", "from_slug"), "from_slug", "left_semi")
    b = edges.join(inner.withColumnRenamed("node", "to_slug"), "to_slug", "left_semi").select(a.columns)
    return a.unionByName(b).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(slug, score) on the undirected graph of distinct neighbours: uniform start, mass of nodes without neighbours spread evenly,
    edge ends that are no nodes dropped. Stops after the round in which the L1 change fell below the tolerance; None: fixed rounds."""
    v = nodes.select("slug").distinct()
    n = v.count()
    if n == 0:
        return v.withColumn("score", F.lit(0.0))
    u = undirected(edges).join(v.select(F.col("slug").alias("node")), "node", "left_semi").join(v.select(F.col("slug").alias("neighbour")), "neighbour", "left_semi")
    links = materialize(u.join(u.groupBy("node").agg(F.count("*").alias("out")), "node").select("node", "neighbour", "out"))
    linked = materialize(links.select(F.col("node").alias("slug"), F.lit(True).alias("linked")).distinct())
    score = materialize(v.join(linked, "slug", "left")).withColumn("score", F.lit(1.0 / n))
    for r in range(rounds):
        sent = links.join(score.withColumnRenamed("slug", "node"), "node").groupBy(F.col("neighbour").alias("slug")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        placed = score.join(sent, "slug", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
        dangling = score.where("linked is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("d"))
        new = placed.crossJoin(dangling).select("slug", "linked", F.col("score").alias("old"), ((1 - damping) / n + damping * (F.col("got") + F.col("d") / n)).alias("score"))  # one row on the right
        if tolerance is None:
            score = materialize(new.drop("old")) if r % 4 == 3 else new.drop("old")
            continue
        new = materialize(new)
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        score = new.drop("old")
        if change < tolerance:
            break
    return score.select("slug", "score")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(slug, label) by synchronous label propagation: the most frequent label among the neighbours, ties to the own label, then to the
    smallest; until nothing changes or the labels of two rounds before come back, as they may in a graph with two sides, or `rounds`."""
    v = nodes.select("slug").distinct()
    u = materialize(undirected(edges).where("node <> neighbour").join(v.select(F.col("slug").alias("node")), "node", "left_semi").join(v.select(F.col("slug").alias("neighbour")), "neighbour", "left_semi"))
    label = v.withColumn("label", F.col("slug"))
    seen: list[tuple] = []
    for _ in range(rounds):
        votes = u.join(label.select(F.col("slug").alias("neighbour"), "label"), "neighbour").groupBy("node", "label").agg(F.count("*").alias("n"))
        own = votes.join(label.select(F.col("slug").alias("node"), F.col("label").alias("own")), "node")
        best = own.groupBy(F.col("node").alias("slug")).agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("label") != F.col("own")).alias("o"), F.col("label").alias("l"))).alias("b"))
        label = materialize(label.join(best, "slug", "left").select("slug", F.coalesce("b.l", "label").alias("label")))
        seen.append(tuple(label.agg(F.count("*"), F.bit_xor(F.xxhash64("slug", "label")), F.sum(F.xxhash64("slug", "label").cast("decimal(38,0)"))).first()))
        if seen[-1] in seen[-3:-1]:
            break
    return label


def community_ids(labels: DataFrame) -> DataFrame:
    """(slug, community, size): communities numbered from 0 by falling size, then by label."""
    from pyspark.sql import Window as W

    n = labels.groupBy("label").agg(F.count("*").alias("size"))
    ids = n.withColumn("community", F.row_number().over(W.orderBy(F.desc("size"), "label")) - 1)  # one row a community
    return labels.join(ids, "label").select("slug", F.col("community").cast("long").alias("community"), "size")


def cross_community(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges(from_slug, to_slug, relation, weight) between different communities of placed(slug, community), each once with its largest weight."""
    a, b = (placed.select(F.col("slug").alias(f"{e}_slug"), F.col("community").alias(f"{e}_community")) for e in ("from", "to"))
    j = edges.join(a, "from_slug").join(b, "to_slug").where("from_community <> to_community")
    return j.groupBy("from_slug", "to_slug", "relation", "from_community", "to_community").agg(F.max("weight").alias("weight"))


def path_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, step, from_slug, to_slug, relation): an edge for every step of paths(node, path): the first relation onwards, else the first back."""
    s = paths.select("node", F.split("path", " > ").alias("p")).where(F.size("p") > 1)
    s = s.select("node", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))).alias("step", "x")).select("node", "step", "x.a", "x.b")
    first = edges.groupBy("from_slug", "to_slug").agg(F.min("relation").alias("relation"))
    out = first.select(F.col("from_slug").alias("a"), F.col("to_slug").alias("b"), F.col("relation").alias("there"))
    back = first.select(F.col("to_slug").alias("a"), F.col("from_slug").alias("b"), F.col("relation").alias("back"))
    j = s.join(out, ["a", "b"], "left").join(back, ["a", "b"], "left")
    ahead = F.col("there").isNotNull()
    return j.select("node", "step", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("from_slug"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("to_slug"), F.coalesce("there", "back").alias("relation"))


def touched_edges(edges: DataFrame, centre: str, depth: int = 2) -> DataFrame:
    """(slug, from_slug, to_slug, relation): the edges met from every node within depth - 1 hops, so that one between two of them comes twice."""
    inner = hops_from(edges, centre, depth - 1).select(F.col("node").alias("slug"))
    ends = edges.select(F.explode(F.array_distinct(F.array("from_slug", "to_slug"))).alias("slug"), "from_slug", "to_slug", "relation")
    return ends.join(inner, "slug")


def snapshot(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the `most` nodes of the highest rank(slug, score), and the edges between them."""
    top = nodes.join(ranks, "slug").orderBy(F.desc(F.round("score", 9)), "slug").limit(most)
    keep = top.select("slug")
    e = edges.join(keep.withColumnRenamed("slug", "from_slug"), "from_slug", "left_semi").join(keep.withColumnRenamed("slug", "to_slug"), "to_slug", "left_semi")
    return top, e
