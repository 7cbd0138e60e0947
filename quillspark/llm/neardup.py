"""Near-duplicate records: pairs whose sets of words overlap by at least a threshold, without pairwise comparison.

1. Every record becomes a set of word hashes (words of at least three letters or digits); records with equal sets are one class.
2. Blocks: words are put in hash order, and neighbours form keys: pairs of the less common words, triples of all words, for small
   sets pairs of all words. Words missing from one side or added to the other break only the keys they touch, at places that are
   random to the data: with overlap J, J' = 2J / (1 + J) of the words are shared and some J'^3 of the pairs, J'^5 of the triples of
   a set, at J = 0.7 more than half and more than a third. Long sets keep a nested sample of their keys (by powers of two, so that
   two sets agree on what is kept). Against brute force over the large check input no pair was lost (README).
3. Signature trees: every block, of two records or of many, is a tree whose leaves are records with a token bitmap and a size; inner
   nodes hold the OR of their bitmaps and their range of sizes. The tree is descended against itself; a pair of nodes is pruned when
   the largest overlap that its bitmaps and sizes allow is below what the threshold needs. Pairs of records left pass the bitmaps'
   lower bound on the difference, then the exact comparison of their sets. Every pair that meets in a single key gets this far; the
   bounds leave out only pairs below the threshold.

Scale: a record is sent once per key, some thirty rows of about 100 bytes, whatever the number of partitions; partitions are
read sorted, a bounded chunk of blocks at a time. A key with more than `HOT` classes is split into chunks, and every pair of chunks
is compared once, in a block of its own; such keys meet their rows by a join. Only the list of common words comes to the driver; it
is bounded by the ratio that defines it.

Defined cases: null or empty text, or fewer than `min_words` different words: the record is in no pair, and in a group of its own;
a repeated row counts once; ties don't matter, since a pair is written with the smaller key first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.session import write_shared

THRESHOLD, MIN_WORDS = 0.7, 20
#: A word in more than this share of the classes makes no pairs. At most (mean set size) / COMMON words are that common.
COMMON = 0.05
#: At least about as many pairs and triples are kept of a long set, at most twice as many; a record is sent once per key.
PAIRS, TRIPLES = 6, 12
#: Sets of fewer words make pairs of all their words too.
SMALL = 90
#: 64-bit words of the bitmap in inner nodes; records carry one of two to four bits a word, at least this wide.
WIDTH = 8
#: Classes that one block may hold; a key with more is split in chunks. There are at most (all keys) / HOT such keys.
HOT = 40_000
#: Rows of the block table that are compared at a time, in whole blocks.
CHUNK = 200_000
#: Rows of the block table per partition.
PER_PARTITION = 400_000

_WORD = re.compile(r"[a-z0-9]{3,}")


def word_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the different words; two of a billion words share one with chance 0.03."""
    words = set(_WORD.findall(text.lower()))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)))


def _runs(words: np.ndarray, gram: int, keep: int) -> np.ndarray:
    """Keys of all runs of `gram` neighbours; of more than twice `keep`, a nested sample."""
    if len(words) < gram:
        return np.zeros(0, dtype=np.uint64)
    k = words[: len(words) - gram + 1] + np.uint64(gram)
    for i in range(1, gram):
        k = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - gram + 1 + i]
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shift = max(0, int(math.log2(len(k) / keep)) if len(k) > keep else 0)
    return k[(k >> np.uint64(40)) & np.uint64((1 << shift) - 1) == 0] if shift else k


def block_keys(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys of a set: pairs of its less common words, triples of all its words, and of a small set also pairs of all its words.

    Every set makes triples, so two sets meet whatever their share of common words is; small sets make pairs up to half as many
    words again as they need, so that no two sets fall on different sides of a rule."""
    rare = words
    if len(common):
        p = np.minimum(np.searchsorted(common, words), len(common) - 1)
        rare = words[common[p] != words]
    parts = [_runs(rare, 2, PAIRS), _runs(words, 3, TRIPLES)]
    if len(words) < SMALL:
        parts.append(_runs(words, 2, PAIRS) ^ np.uint64(1))
    return np.unique(np.concatenate(parts)).astype(np.int64)


def bitmap(words: np.ndarray, width: int | None = None) -> np.ndarray:
    """Bitmap of a set, by default with two to four bits a word."""
    width = width or max(WIDTH, 1 << math.ceil(math.log2(max(1, 2 * len(words) / 64))))
    out = np.zeros(width, dtype=np.uint64)
    place = (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(width * 64)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


# ---- signature trees ----------------------------------------------------------------------------------------------------------


class SignatureForest:
    """A signature tree for every block, all built and descended together.

    Level 0 are the records, by block, side and size; a node of a higher level covers up to `fan` nodes below it, of one block. It
    holds the OR of their bitmaps, their range of sizes, the most words that share a bit, and their sides: a pair of records of a
    block counts if one is on side 1 and the other on side 2, or either on both (3), as all are in a block that isn't a split one."""

    def __init__(self, block: np.ndarray, side: np.ndarray, wide: list[np.ndarray], sizes: np.ndarray, fan: int = 8) -> None:
        self.order = np.lexsort((sizes, side, block))
        block, sizes = block[self.order], sizes[self.order]
        self.wide = [wide[i] for i in self.order.tolist()]
        self.sizes, self.fan = sizes, fan
        width = np.array([len(w) for w in self.wide], dtype=np.int64)
        bits = np.zeros((len(sizes), WIDTH), dtype=np.uint64)
        for n in np.unique(width).tolist():
            at = np.flatnonzero(width == n)
            bits[at] = np.bitwise_or.reduce(np.concatenate([self.wide[i] for i in at.tolist()]).reshape(len(at), -1, WIDTH), axis=1)
        spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        # (bitmap, least size, most, most words sharing a bit, sides, first child, children) of every level
        self.levels = [(bits, sizes, sizes, spare, side[self.order], None, None)]
        self.roots: list[tuple[int, np.ndarray]] = []
        level, own = 0, block
        alive = np.arange(len(block))  # nodes of this level that aren't the root of their block yet
        while len(alive):
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            length = np.diff(np.concatenate((start, [len(own)])))
            one = length == 1
            if level and one.any():
                self.roots.append((level, alive[start[one]]))
            stay = np.repeat(~one, length)  # a block of one record has no pair
            alive, own, length = alive[stay], own[stay], length[~one]
            if not len(alive):
                break
            at = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
            cut = np.flatnonzero(at % fan == 0)
            b, lo, hi, spare, sides, _, _ = self.levels[level]
            take = slice(None) if len(alive) == len(lo) else alive
            self.levels.append((
                np.bitwise_or.reduceat(b[take], cut), np.minimum.reduceat(lo[take], cut), np.maximum.reduceat(hi[take], cut), np.maximum.reduceat(spare[take], cut),
                np.bitwise_or.reduceat(sides[take], cut), alive[cut], np.diff(np.concatenate((cut, [len(own)]))),
            ))
            own = own[cut]
            level += 1
            alive = np.arange(len(own))

    def candidates(self, t: float, step: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of records, as positions before sorting, that the trees descended against themselves cannot rule out."""
        found_i, found_j = [], []
        stack = [(level, r, r) for level, r in self.roots]
        while stack:
            level, i, j = stack.pop()
            if len(i) > step:
                half = len(i) // 2
                stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
                continue
            b, lo, hi, spare, side, child, children = self.levels[level]
            cross = side[i] & ((side[j] & 1) << 1 | side[j] >> 1)
            ok = (cross > 0) & (lo[j] * t <= hi[i] + 1e-9) & (lo[i] * t <= hi[j] + 1e-9)
            i, j = i[ok], j[ok]
            if level == 0:
                differ = np.bitwise_count(b[i] ^ b[j]).sum(axis=1, dtype=np.int64)
                ok = differ <= (1 - t) / (1 + t) * (lo[i] + lo[j]) + 1e-9
                i, j = i[ok], j[ok]
                ok = self._wide_bound(i, j, t)
                found_i.append(self.order[i[ok]])
                found_j.append(self.order[j[ok]])
                continue
            most = np.bitwise_count(b[i] & b[j]).sum(axis=1, dtype=np.int64) + np.minimum(np.maximum(spare[i], spare[j]), np.minimum(hi[i], hi[j]))
            ok = np.minimum(most, np.minimum(hi[i], hi[j])) >= t / (1 + t) * (lo[i] + lo[j]) - 1e-9
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            nj = children[j]
            each = children[i] * nj
            e = np.repeat(np.arange(len(i)), each)
            at = np.arange(len(e)) - np.repeat(np.cumsum(each) - each, each)
            ci, cj = child[i][e] + at // nj[e], child[j][e] + at % nj[e]
            ok = (ci < cj) | ((ci == cj) & (level > 1))
            if ok.any():
                stack.append((level - 1, ci[ok], cj[ok]))
        empty = np.zeros(0, dtype=np.int64)
        return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)

    def _wide_bound(self, i: np.ndarray, j: np.ndarray, t: float, step: int = 50_000) -> np.ndarray:
        """Whether the records' own bitmaps allow the threshold; the wider of two is folded."""
        width = np.array([len(w) for w in self.wide], dtype=np.int64)
        least = np.minimum(width[i], width[j])
        ok = np.ones(len(i), dtype=bool)
        for n in np.unique(least[least > WIDTH]).tolist():
            at = np.flatnonzero(least == n)
            own, place = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
            bits = np.array([np.bitwise_or.reduce(self.wide[k].reshape(-1, n)) for k in own.tolist()])
            a, b = place[: len(at)], place[len(at) :]
            for lo in range(0, len(at), step):
                e = slice(lo, lo + step)
                differ = np.bitwise_count(bits[a[e]] ^ bits[b[e]]).sum(axis=1, dtype=np.int64)
                ok[at[e]] = differ <= (1 - t) / (1 + t) * (self.sizes[i[at[e]]] + self.sizes[j[at[e]]]) + 1e-9
        return ok


def block_candidates(block: np.ndarray, side: np.ndarray, cls: np.ndarray, wide: list[np.ndarray], sizes: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (a, b) of classes, a < b, over all blocks, each once."""
    i, j = SignatureForest(block, side, wide, sizes).candidates(t)
    a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
    pairs = np.unique(np.stack((a, b), axis=1)[a != b], axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
    return pairs[:, 0], pairs[:, 1]


# ---- in Spark -----------------------------------------------------------------------------------------------------------------


def _sets(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tab, key, text in zip(b["rec_table"], b["key"], b["text"]):
                if text:
                    w = word_set(text)
                    if len(w) >= min_words:
                        rows.append((tab, key, xxhash.xxh3_64_intdigest(tab.encode() + w.tobytes()) - (1 << 63), len(w), w.tobytes()))
            yield pd.DataFrame(rows, columns=["rec_table", "key", "cls", "n", "words"])

    return run


def word_sets(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rec_table, key, cls, n, words) of records(rec_table, key, text); cls is the same for equal sets."""
    return records.select("rec_table", "key", "text").where("text is not null").mapInPandas(_sets(min_words), "rec_table string, key string, cls long, n int, words binary")


def _of(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint64)


def block_rows(classes: DataFrame, common: np.ndarray, hot: int = HOT) -> DataFrame:
    """(blk, side, cls, n, bits) of classes(cls, n, words): a row for each key of a class, some forty however many partitions there
    are. A key with more than `hot` classes is split: its classes are dealt to chunks, and every pair of chunks is a block, with one
    chunk on side 1 and the other on side 2. Such keys are found by count and met by a join."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [_of(x) for x in b["words"]]
            keys = [block_keys(w, common) for w in words]
            n = [len(k) for k in keys]
            at = np.repeat(np.arange(len(b)), n)
            bits = np.array([bitmap(w).tobytes() for w in words], dtype=object)
            yield pd.DataFrame({"blk": np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), "cls": b["cls"].to_numpy()[at], "n": b["n"].to_numpy()[at], "bits": bits[at] if len(b) else bits})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k, c = np.unique(np.concatenate([block_keys(_of(x), common) for x in b["words"]]) if len(b) else np.zeros(0, dtype=np.int64), return_counts=True)
            yield pd.DataFrame({"blk": k, "c": c.astype(np.int64)})

    rows = classes.select("cls", "n", "words").mapInPandas(send, "blk long, cls long, n int, bits binary").withColumn("side", F.lit(3))
    counts = classes.select("words").mapInPandas(count, "blk long, c long").groupBy("blk").agg(F.sum("c").alias("c"))
    busy = write_shared(counts.where(F.col("c") > hot).select("blk", F.ceil(F.col("c") * 2 / hot).alias("m")), "p1-busy")
    if busy.isEmpty():
        return rows.select("blk", "side", "cls", "n", "bits")
    own = F.pmod(F.xxhash64("cls"), "m")
    chunks = F.when(F.col("m").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    met = rows.join(busy, "blk", "left").withColumn("own", own).withColumn("other", F.explode(chunks))
    split = F.col("m").isNotNull()
    return met.select(
        F.when(split, F.xxhash64("blk", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("blk")).alias("blk"),
        F.when(split & (F.col("own") < F.col("other")), 1).when(split & (F.col("own") > F.col("other")), 2).otherwise(3).alias("side"),
        "cls", "n", "bits",
    )


def similar_classes(classes: DataFrame, threshold: float = THRESHOLD, partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """(a, b) with a < b: classes(cls, n, words) whose sets overlap by at least the threshold. Classes of different tables never meet, since
    the table is part of a class, but their words may: callers pass one table at a time."""
    spark = classes.sparkSession
    total, words = classes.agg(F.count("*"), F.sum("n")).first()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, n = np.unique(np.concatenate([_of(x) for x in b["words"]]) if len(b) else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pd.DataFrame({"w": w.astype(np.int64), "c": n.astype(np.int64)})

    # at most (mean set size) / COMMON rows
    common = classes.select("words").mapInPandas(spread, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") > max(2, COMMON * total)).select("w")
    common_words = np.sort(np.array([r.w for r in common.collect()], dtype=np.int64).astype(np.uint64))
    keys = min(total * (3 * TRIPLES), 3 * (words or 0))
    parts = partitions or max(spark.sparkContext.defaultParallelism, -(-keys // PER_PARTITION))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows in, a chunk of whole blocks at a time."""

        def pairs(g: pd.DataFrame) -> pd.DataFrame:
            a, b = block_candidates(g["blk"].to_numpy(), g["side"].to_numpy(), g["cls"].to_numpy(), [_of(x) for x in g["bits"]], g["n"].to_numpy(dtype=np.int64), threshold)
            return pd.DataFrame({"a": a, "b": b})

        held: list[pd.DataFrame] = []
        size = 0
        for g in batches:
            held.append(g)
            size += len(g)
            if size < CHUNK:
                continue
            g = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(g["blk"].to_numpy(), g["blk"].iloc[-1], "left"))  # the last block may go on
            if cut:
                yield pairs(g.iloc[:cut])
            held, size = [g.iloc[cut:]], len(g) - cut
        if size:
            yield pairs(pd.concat(held, ignore_index=True))

    sent = block_rows(classes, common_words, hot).repartition(parts, "blk").sortWithinPartitions("blk")
    maybe = write_shared(sent.mapInPandas(compare, "a long, b long").distinct(), "p1-candidates")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["wa"], b["wb"]):
                u, v = _of(x), _of(y)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= threshold * (len(u) + len(v) - both) - 1e-9)
            yield b.loc[keep, ["a", "b"]]

    w = classes.select(F.col("cls").alias("a"), F.col("words").alias("wa"))
    v = classes.select(F.col("cls").alias("b"), F.col("words").alias("wb"))
    return maybe.join(w, "a").join(v, "b").select("a", "b", "wa", "wb").mapInPandas(verify, "a long, b long")


def links_and_members(records: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(a, b) between classes, and (rec_table, key, cls) of every record with enough words."""
    sets = write_shared(word_sets(records, min_words), "p1-sets")
    classes = write_shared(sets.select("cls", "n", "words").dropDuplicates(["cls"]), "p1-classes")
    return write_shared(similar_classes(classes, threshold), "p1-links"), sets.select("rec_table", "key", "cls").distinct()


def duplicate_pairs(records: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, key_similarity: float | None = None) -> DataFrame:
    """(rec_table, key_a, key_b) of all pairs of records, copies included; with key_similarity also 1 - edit distance / longer length of the keys."""
    links, members = links_and_members(records, threshold, min_words)
    m, o = members.alias("m"), members.alias("o")
    copies = m.join(o, (F.col("m.cls") == F.col("o.cls")) & (F.col("m.key") < F.col("o.key"))).select("m.rec_table", F.col("m.key").alias("x"), F.col("o.key").alias("y"))
    linked = (
        links.join(members.select(F.col("cls").alias("a"), "rec_table", F.col("key").alias("x")), "a")
        .join(members.select(F.col("cls").alias("b"), F.col("key").alias("y")), "b").select("rec_table", "x", "y")
    )
    pairs = copies.unionByName(linked).select("rec_table", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    if key_similarity is not None:
        longest = F.greatest(F.length("key_a"), F.length("key_b"))
        pairs = pairs.where(1 - F.levenshtein("key_a", "key_b") / longest >= key_similarity - 1e-9)
    return pairs


def duplicate_groups(records: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, key_similarity: float | None = None) -> DataFrame:
    """(rec_table, key, group_id, links): one row per record; group_id is the smallest key of the records it hangs together with, links the
    number of classes of other texts that its own is linked to. Copies are not expanded into pairs. With key_similarity only pairs of
    records with similar keys hang together, copies too, and links is the number of such records."""
    from quillspark.operators.graph import component_labels

    if key_similarity is not None:
        pairs = write_shared(duplicate_pairs(records, threshold, min_words, key_similarity), "p1-pairs")
        labels = component_labels(pairs.select(F.col("key_a").alias("src"), F.col("key_b").alias("dst"))).select(F.col("node").alias("key"), F.col("label").alias("group_id"))
        degree = pairs.select(F.col("key_a").alias("key")).unionAll(pairs.select(F.col("key_b").alias("key"))).groupBy("key").agg(F.count("*").alias("links"))
        every = records.select("rec_table", "key").distinct().join(labels, "key", "left").join(degree, "key", "left")
        return every.select("rec_table", "key", F.coalesce("group_id", "key").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    links, members = links_and_members(records, threshold, min_words)
    labels = component_labels(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.col("a").alias("cls")).unionAll(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    placed = members.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    first = placed.groupBy("label").agg(F.min("key").alias("group_id"))
    have = placed.join(first, "label").join(degree, "cls", "left").select("rec_table", "key", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    alone = records.select("rec_table", "key").distinct().join(members.select("rec_table", "key"), ["rec_table", "key"], "left_anti")
    return have.unionByName(alone.select("rec_table", "key", F.col("key").alias("group_id"), F.lit(0).cast("long").alias("links")))
