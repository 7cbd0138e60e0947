"""Evaluation texts inside training texts.

Every window of `window` words of an item (the whole item, if it is shorter) is embedded by the CGK random walk: at step j the
walk writes the current word and moves on or stays by a random bit of (j, word), so that few edits leave most of the written
positions equal. Windows of a document are embedded the same way, all starts of a batch at once. Each repetition of the LSH
samples positions of the embedding; windows that agree on a sample are candidates, verified by their exact edit distance in words.
With no edits allowed, equal windows have equal embeddings, so one repetition finds all of them. For e edits every repetition
walks by random bits of its own, and the number of repetitions of each size of window is the least whose recall, measured on
windows of the items for every kind and place of an edit, reaches the target; a window of no more words than edits is found only unedited.

Scale: the items are the query set; their sampled keys go to the tasks in blocks of a checked size, the documents are read once
per block and never shuffled. A document's candidates stay in its batch. A query set of more than a few blocks is joined by its keys
instead, behind a bit filter of a stated size, with one pass over the documents. Defined cases: null or empty text has no words; an item
without words is in no document; repeated rows give one pair; pairs are (doc_id, item_id), each once.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.session import write_shared

WINDOW = 13
#: Positions of the embedding that one repetition samples.
SAMPLED = 8
#: Item windows in one block: their keys, words and places take some 100 MB at most in a worker.
BLOCK_WINDOWS = 400_000
SEED = 20_240

_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def sampled(size: int, edits: int) -> int:
    """Positions to sample for a size of window: with edits fewer of a short one, so that some samples miss the edited word."""
    return SAMPLED if edits == 0 else max(1, SAMPLED * size // WINDOW)


def samples(steps: int, repetitions: int, k: int = SAMPLED) -> list[list[int]]:
    """Sampled steps of every repetition. The first repetition is spread evenly over the walk."""
    rng = random.Random(SEED)
    out = [sorted({min(steps - 1, i * steps // k) for i in range(k)})]
    out += [sorted(rng.sample(range(steps), min(k, steps))) for _ in range(repetitions - 1)]
    return out[:repetitions]


def sampled_keys(h: np.ndarray, starts: np.ndarray, size: int, longest: int, plans: dict[int, list[list[int]]], walk: int = 0) -> dict[int, list[np.ndarray]]:
    """Keys of the windows at `starts` for every size in `plans`; sizes share one walk, since it only differs after its end. Walks of
    different numbers take different bits of a word."""
    at = starts.astype(np.int64)
    off = np.zeros(len(at), dtype=np.int64)
    last = len(h) - 1
    keys = {m: [np.full(len(at), np.uint64(m), dtype=np.uint64) for _ in p] for m, p in plans.items()}
    wanted = {j: [(m, r) for m, p in plans.items() for r, steps in enumerate(p) if j in steps] for j in range(3 * longest)}
    prime = np.uint64(0x9E3779B97F4A7C15)
    end = max(max(s[-1] for s in p) for p in plans.values())
    salt = np.uint64(walk * 0xD1B54A32D192ED03 % (1 << 64))
    mixed = h if walk == 0 else ((h ^ salt) * prime) ^ (((h ^ salt) * prime) >> np.uint64(32))
    for j in range(end + 1):
        sym = h[np.minimum(at, last)]
        for m, r in wanted[j]:
            v = np.where(off < m, sym, np.uint64(0))
            k = keys[m][r]
            keys[m][r] = (k ^ (k >> np.uint64(29)) ^ v) * prime
        bit = ((mixed[np.minimum(at, last)] >> np.uint64(j % 61)) & np.uint64(1)).astype(np.int64)
        bit[off >= longest] = 0
        off += bit
        at += bit
    return keys


class ItemBlock:
    """Windows of a block of items with their sampled keys."""

    def __init__(self, items: list[tuple[int, str]], window: int, edits: int, repetitions: int | dict[int, int]) -> None:
        self.window, self.edits = window, edits
        self.windows: list[tuple[int, tuple[str, ...]]] = []
        for i, text in items:
            w = words_of(text)
            m = min(window, len(w))
            self.windows += [(i, tuple(w[p : p + m])) for p in range(len(w) - m + 1)] if m else []
        sizes = sorted({len(w) for _, w in self.windows})
        if not isinstance(repetitions, dict):
            repetitions = dict.fromkeys(sizes, repetitions)
        self.plans = {m: samples(3 * m, repetitions[m], sampled(m, edits)) for m in sizes}
        self.longest = max(sizes, default=0)
        self.row = np.zeros(len(self.windows), dtype=np.int64)  # row of a window among those of its size
        self.hashes: dict[int, np.ndarray] = {}
        self.lookup: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in sizes:
            own = [n for n, (_, w) in enumerate(self.windows) if len(w) == m]
            pad = self.longest - m
            flat = np.array([_hash(x) for n in own for x in (*self.windows[n][1], *[""] * pad)], dtype=np.uint64)
            self.hashes[m] = flat.reshape(len(own), self.longest)[:, :m]
            self.row[own] = np.arange(len(own))
            for r, steps in enumerate(self.plans[m]):
                k = sampled_keys(flat, np.arange(len(own)) * self.longest, m, self.longest, {m: [steps]}, r)[m][0]
                order = np.argsort(k, kind="stable")
                bits = np.zeros(1 << 20, dtype=bool)
                bits[(k & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.lookup[m, r] = (k[order], np.array(own)[order], bits)

    def pairs(self, docs: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
        """(doc_id, item_id) of the documents that hold a window within the allowed edits of an item's."""
        if not self.windows:
            return set()
        vocab: dict[str, int] = {}
        words: list[str] = []
        ids, begin = [], [0]
        for d, text in docs:
            words += words_of(text)
            ids.append(d)
            begin.append(len(words))
        if not words:
            return set()
        h = np.empty(len(words), dtype=np.uint64)
        for n, w in enumerate(words):
            v = vocab.get(w)
            if v is None:
                v = vocab[w] = _hash(w)
            h[n] = v
        begin_a = np.array(begin)
        room = np.repeat(begin_a[1:], np.diff(begin_a)) - np.arange(len(words))  # words left in the document
        out: set[tuple[int, int]] = set()
        for lo in range(0, len(words), 200_000):
            starts = np.arange(lo, min(lo + 200_000, len(words)))
            for r in range(max(map(len, self.plans.values()))):
                keys = sampled_keys(h, starts, 0, self.longest, {m: [p[r]] for m, p in self.plans.items() if r < len(p)}, r)
                for m, (k,) in keys.items():
                    fits = room[starts] >= max(1, m - self.edits)
                    sorted_keys, own, bits = self.lookup[m, r]
                    near = np.flatnonzero(fits & bits[(k & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    left = np.searchsorted(sorted_keys, k[near], "left")
                    right = np.searchsorted(sorted_keys, k[near], "right")
                    n_each = right - left
                    if not n_each.any():
                        continue
                    at = np.repeat(starts[near], n_each)
                    which = own[np.repeat(left, n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)]
                    ok = self._enough(h, at, which, m)
                    for p, n in zip(at[ok].tolist(), which[ok].tolist()):
                        doc = int(np.searchsorted(begin_a, p, "right")) - 1
                        item, want = self.windows[n]
                        if (ids[doc], item) not in out and self._same(words, p, begin[doc + 1], want):
                            out.add((ids[doc], item))
        return out

    def _enough(self, h: np.ndarray, at: np.ndarray, which: np.ndarray, m: int) -> np.ndarray:
        """Candidates with enough words in place, give or take the allowed edits: what any pair within them must have."""
        same = np.zeros((len(at), m), dtype=bool)
        want = self.hashes[m][self.row[which]]
        cols = np.arange(m)
        for shift in range(-self.edits, self.edits + 1):
            same |= h[np.clip(at[:, None] + cols + shift, 0, len(h) - 1)] == want
        return same.sum(axis=1) >= m - self.edits

    def _same(self, words: list[str], p: int, stop: int, want: tuple[str, ...]) -> bool:
        m = len(want)
        if self.edits == 0:
            return p + m <= stop and tuple(words[p : p + m]) == want
        return any(edit_distance(words[p : min(stop, p + n)], want, self.edits) <= self.edits for n in range(m - self.edits, m + self.edits + 1))


def edit_distance(a, b, most: int) -> int:
    """Edit distance in words, given up above `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def edited(w: list[str], edits: int, rng: random.Random, first: tuple[int, int] | None = None) -> list[str]:
    """A window under random edits, each of which changes it: words left out (0), changed (1), or put in between its words (2). The kind
    and place of the first edit may be given."""
    b = list(w)
    for n in range(edits):
        kind, q = first if n == 0 and first else (0, rng.randrange(len(b)) if b else 0)
        if not (n == 0 and first):
            kind = rng.randrange(3 if 0 < q else 2)
        new = f"x{rng.getrandbits(60)}"
        b[q : q + 1] = [] if kind == 0 else [new] if kind == 1 else [new, b[q]]
    return b


def measured_recall(pool: list[list[str]], m: int, edits: int, walks: int, tries: int = 300, seed: int = SEED) -> list[float]:
    """Share of windows of m words that meet their edited form within the first 1, 2, ... repetitions, for the kind and place of the first
    edit where it is least; `tries` windows for each."""
    rng = random.Random(seed)
    clean, other, long = [], [], m + edits + 1
    places = [(kind, q) for kind in range(3) for q in range(m) if kind < 2 or q]
    for first in places:
        for _ in range(tries):
            w = rng.choice(pool)
            p = rng.randrange(len(w) - m + 1)
            a = w[p : p + m]
            clean += [_hash(x) for x in (a + [""] * long)[:long]]
            other += [_hash(x) for x in (edited(a, edits, rng, first) + [f"y{rng.random()}" for _ in range(long)])[:long]]
    at = np.arange(tries * len(places)) * long
    met, out = np.zeros(len(at), dtype=bool), []
    for r, steps in enumerate(samples(3 * m, walks, sampled(m, edits))):
        x, y = (sampled_keys(np.array(h, dtype=np.uint64), at, m, m, {m: [steps]}, r)[m][0] for h in (clean, other))
        met |= x == y
        out.append(float(met.reshape(len(places), tries).mean(axis=1).min()))
        if out[-1] >= 0.998:
            break
    return out


#: More repetitions than any size of window above the edits was measured to need; a size that needs more is refused.
MOST_REPETITIONS = 128


def repetitions_by_size(items: list[tuple[int, str]], window: int, edits: int, recall: float = 0.95) -> dict[int, int]:
    """For each size of the items' windows, the least repetitions whose measured recall reaches the target wherever the edit falls, with a
    standard error to spare."""
    pools: dict[int, list[list[str]]] = {}
    for _, t in items:
        if w := words_of(t):
            pools.setdefault(min(window, len(w)), []).append(w)
    out = {}
    for m, pool in pools.items():
        if edits == 0 or m <= edits:
            out[m] = 1
            continue
        target = min(0.998, recall + math.sqrt(recall * (1 - recall) / 300))
        reached = next((r for r, x in enumerate(measured_recall(pool, m, edits, MOST_REPETITIONS), 1) if x >= target), None)
        if reached is None:
            raise ValueError(f"recall {recall} is not reached for windows of {m} words with {edits} edits")
        out[m] = reached
    return out


def repetitions_for(items: list[tuple[int, str]], window: int, edits: int, recall: float) -> int:
    """Repetitions that reach the recall for every size of the items' windows."""
    return max(repetitions_by_size(items, window, edits, recall).values(), default=1)


#: Bits of the filter that the documents' windows pass before a join, for each key of the items; and its largest size, 128 MB.
FILTER_BITS, MOST_BITS = 16, 30
#: Bits of one piece of the filter, which one task makes.
PIECE_BITS = 16


def _window_keys(batches: Iterator[pd.DataFrame], window: int, edits: int, reps: dict[int, int]) -> Iterator[tuple[int, np.ndarray, ItemBlock, np.ndarray]]:
    """(item windows' size, keys, block, their windows) of every repetition, for items(item_id, text) in blocks."""
    for b in batches:
        block = ItemBlock(list(zip(b["item_id"], b["text"])), window, edits, reps)
        for (m, _), (keys, own, _) in block.lookup.items():
            yield m, keys, block, own


def joined_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = 0, recall: float = 0.95, sample: int = 2_000) -> DataFrame:
    """(doc_id, item_id) by a join of sampled keys, for more items than fit in a few blocks: the documents are read once whatever the
    number of items. Windows of documents pass a bit filter of the items' keys, of a stated largest size, before they are shuffled.
    Repetitions are chosen on a sample of at most `sample` items."""
    spark = docs.sparkSession
    pool = [(i, t) for i, t in enumerate(r.text for r in items.select("text").where("text is not null").orderBy(F.xxhash64("text")).limit(sample).collect())]
    known = repetitions_by_size(pool, window, edits, recall)
    most = max(known.values(), default=1)
    reps = {m: known.get(m, 1 if edits == 0 or m <= edits else most) for m in range(1, window + 1)}
    its = items.select("item_id", "text").where("text is not null").distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m, k, block, own in _window_keys(batches, window, edits, reps):
            yield pd.DataFrame({"key": k.astype(np.int64), "item_id": [block.windows[n][0] for n in own.tolist()], "m": m, "want": [" ".join(block.windows[n][1]) for n in own.tolist()]})

    wanted = write_shared(its.mapInPandas(keys, "key long, item_id long, m int, want string").distinct(), "p8-keys")
    bits = min(MOST_BITS, max(PIECE_BITS, math.ceil(math.log2(max(1, wanted.count() * FILTER_BITS)))))

    def piece(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        at = g["at"].to_numpy()
        out = np.zeros(1 << PIECE_BITS, dtype=bool)
        out[at] = True
        return pd.DataFrame({"piece": [key[0]], "bits": [np.packbits(out).tobytes()]})

    place = F.col("key").bitwiseAND((1 << bits) - 1)
    low = place.bitwiseAND((1 << PIECE_BITS) - 1)
    pieces = wanted.select(F.shiftright(place, PIECE_BITS).alias("piece"), low.alias("at")).distinct().groupBy("piece").applyInPandas(piece, "piece long, bits binary")
    table = np.zeros((1 << (bits - PIECE_BITS), 1 << (PIECE_BITS - 3)), dtype=np.uint8)
    for r in pieces.toLocalIterator():  # at most 2^30 bits in all
        table[r.piece] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())
    sizes = sorted(r.m for r in wanted.select("m").distinct().collect())
    plans = {m: samples(3 * m, reps[m], sampled(m, edits)) for m in sizes}
    longest = max(sizes, default=0)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filt = np.frombuffer(shared.value, dtype=np.uint8)
        mask = np.uint64((1 << bits) - 1)
        for b in batches:
            words, ids, begin = [], [], [0]
            for d, t in zip(b["doc_id"], b["text"]):
                words += words_of(t)
                ids.append(d)
                begin.append(len(words))
            if not words or not sizes:
                continue
            h = np.fromiter((_hash(w) for w in words), dtype=np.uint64, count=len(words))
            begin_a = np.array(begin)
            for lo in range(0, len(words), 200_000):
                starts = np.arange(lo, min(lo + 200_000, len(words)))
                doc = np.searchsorted(begin_a, starts, "right") - 1
                room = begin_a[doc + 1] - starts
                for r in range(max(map(len, plans.values()))):
                    for m, (k,) in sampled_keys(h, starts, 0, longest, {m: [p[r]] for m, p in plans.items() if r < len(p)}, r).items():
                        bit = k & mask
                        hit = (filt[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1
                        near = np.flatnonzero((hit == 1) & (room >= max(1, m - edits)))
                        if len(near):
                            yield pd.DataFrame({
                                "key": k[near].astype(np.int64), "doc_id": [ids[i] for i in doc[near].tolist()],
                                "said": [" ".join(words[p : min(begin[i + 1], p + m + edits)]) for p, i in zip(starts[near].tolist(), doc[near].tolist())],
                            })

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for said, want in zip(b["said"], b["want"]):
                w, x = said.split(" "), want.split(" ")
                keep.append(any(edit_distance(w[:n], x, edits) <= edits for n in range(max(1, len(x) - edits), min(len(w), len(x) + edits) + 1)))
            yield b.loc[keep, ["doc_id", "item_id"]]

    met = docs.select("doc_id", "text").where("text is not null").mapInPandas(meet, "key long, doc_id long, said string")
    return met.join(wanted.select("key", "item_id", "want"), "key").drop("key").distinct().mapInPandas(verify, "doc_id long, item_id long").distinct()


#: Blocks of items above which the documents are joined instead of read once for each.
MOST_BLOCKS = 4


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = 0, recall: float = 0.95, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id) of docs(doc_id, text) against items(item_id, text). The items are read in blocks of at most about
    `block_windows` windows, a pass over the documents each; for more than a few blocks the keys are joined (`joined_leaks`), with the
    same embeddings, keys and check."""
    chars = items.select(F.sum(F.length("text"))).first()[0] or 0
    if chars // 5 > MOST_BLOCKS * block_windows:
        return joined_leaks(docs, items, window, edits, recall)
    found: DataFrame | None = None
    block: list[tuple[int, str]] = []
    size = 0

    def run_block(rows: list[tuple[int, str]]) -> DataFrame:
        reps = repetitions_by_size(rows, window, edits, recall)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b_items = ItemBlock(rows, window, edits, reps)
            for b in batches:
                yield pd.DataFrame(sorted(b_items.pairs(list(zip(b["doc_id"], b["text"])))), columns=["doc_id", "item_id"])

        return docs.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, item_id long")

    def flush() -> None:
        nonlocal found, block, size
        part = run_block(block)
        found = part if found is None else found.unionByName(part)
        block, size = [], 0

    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        size += max(1, len(r.text) // 5)
        if size >= block_windows:
            flush()
    if block or found is None:
        flush()
    return found.distinct()
