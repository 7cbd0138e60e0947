"""Filling containers of fixed capacity with texts, by conflict-constrained best fit.

Bins are kept in classes by residual, with a bitmap of the classes in use; the search for an item of size s starts at the
smallest residual >= s and goes on to the next until a compatible bin is found, which is then the tightest compatible one. Each
bin carries a bitmap of hashed duplicate clusters (no two copies of a text share a container) and one of sources that have used
their quota of its tokens.

Scale: items are dealt to shards by hash, each of about `shard_tokens` tokens, so that a hot source or a text repeated in a third
of all rows is spread evenly; a shard is packed in one task; the few loose containers of all shards are packed again together.

Defined cases: a null text is left out; an empty text takes no room but is placed; a text above the capacity is cut into pieces
of the capacity and a rest; a repeated row is placed as often as it comes. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.session import write_shared

CAPACITY = 2048
#: Token counts travel with 64-bit keys only; a shard of this size holds about 2 000 full containers and some 10 MB.
SHARD_TOKENS = 4_000_000
#: A container with more room than this after the first round is opened again.
LOOSE = 64
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of the byte-level vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def load_tokenizer(folder: str = TOKENIZER_DIR, name: str = TOKENIZER):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def cluster_key(text: str) -> int:
    """Copies that differ only in case, spacing or punctuation share a key."""
    return xxhash.xxh3_64_intdigest(" ".join(re.findall(r"\w+", text.lower())).encode("utf-8", "surrogatepass")) - (1 << 63)


def _measure(capacity: int, folder: str, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_tokenizer(folder, name)
        for b in batches:
            rows = []
            for doc, src, text in zip(b["doc_id"], b["source"], b["text"]):
                n = len(enc.encode_ordinary(text)) if text else 0
                s = xxhash.xxh3_64_intdigest((src or "").encode()) - (1 << 63)
                k = cluster_key(text)
                for p in range(max(1, -(-n // capacity))):
                    rows.append((doc, p, min(capacity, n - p * capacity), s, (k + p) if k + p < (1 << 63) else k))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "n_tokens", "src", "cluster"])

    return run


class _Bins:
    """Open bins by residual; `mask` has bit r set while some bin has residual r."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask = capacity, 0
        self.classes: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.residual: list[int] = []
        self.bits: list[int] = []  # hashed duplicate clusters
        self.closed: list[int] = []  # hashed sources at their quota
        self.clusters: list[set[int]] = []
        self.used: list[dict[int, int]] = []

    def _enter(self, b: int, r: int) -> None:
        self.classes[r][b] = None
        self.mask |= 1 << r

    def _leave(self, b: int, r: int) -> None:
        del self.classes[r][b]
        if not self.classes[r]:
            self.mask &= ~(1 << r)

    def place(self, size: int, src: int, cluster: int, quota: int) -> int:
        """The tightest compatible bin, else a new one. A hit in the bitmap is confirmed in the set."""
        bit, sbit = 1 << (cluster & 255), 1 << (src & 63)
        m = self.mask >> size << size
        while m:
            r = (m & -m).bit_length() - 1
            for b in self.classes[r]:
                if self.bits[b] & bit and cluster in self.clusters[b]:
                    continue
                if self.closed[b] & sbit and self.used[b].get(src, 0) + size > quota:
                    continue
                if self.used[b].get(src, 0) + size > quota:
                    self.closed[b] |= sbit
                    continue
                self._leave(b, r)
                self._fill(b, r - size, size, src, cluster, bit)
                return b
            m &= m - 1
        b = len(self.residual)
        self.residual.append(0)
        self.bits.append(0)
        self.closed.append(0)
        self.clusters.append(set())
        self.used.append({})
        self._fill(b, self.capacity - size, size, src, cluster, bit)
        return b

    def _fill(self, b: int, r: int, size: int, src: int, cluster: int, bit: int) -> None:
        self.residual[b] = r
        self.bits[b] |= bit
        self.clusters[b].add(cluster)
        self.used[b][src] = self.used[b].get(src, 0) + size
        self._enter(b, r)


def pack_items(sizes: list[int], srcs: list[int], clusters: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin of each item, and residual of each bin. Items are taken by falling size, copies of a text one after another.

    The copies of one text (same cluster and size) are handled as a run: a bin that took one copy is set aside from the classes
    until the run is over, so a text repeated n times costs n searches, not n squared.
    A source may use half a container, or more in proportion when its share of all tokens is above a third.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], i))
    total = sum(sizes) or 1
    share: dict[int, int] = {}
    for s, n in zip(srcs, sizes):
        share[s] = share.get(s, 0) + n
    quota = {s: max(capacity // 2, min(capacity, int(1.5 * capacity * n / total))) for s, n in share.items()}
    bins = _Bins(capacity)
    out = [0] * len(sizes)
    aside: list[int] = []
    run = None
    for i in order:
        if run != (sizes[i], clusters[i]):
            for b in aside:
                bins._enter(b, bins.residual[b])
            aside, run = [], (sizes[i], clusters[i])
        b = out[i] = bins.place(sizes[i], srcs[i], clusters[i], max(quota[srcs[i]], sizes[i]))
        bins._leave(b, bins.residual[b])
        aside.append(b)
    return out, bins.residual


PACKED = "container string, doc_id long, piece long, n_tokens long, src long, cluster long, loose boolean"


def _pack_shard(capacity: int, tag: str, loose: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, residual = pack_items(g["n_tokens"].tolist(), g["src"].tolist(), g["cluster"].tolist(), capacity)
        return pd.DataFrame({
            "container": [f"{tag}-{key[0]}-{b}" for b in where],
            "doc_id": g["doc_id"].to_numpy(), "piece": g["piece"].to_numpy(), "n_tokens": g["n_tokens"].to_numpy(),
            "src": g["src"].to_numpy(), "cluster": g["cluster"].to_numpy(),
            "loose": [residual[b] > loose for b in where],
        })

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, piece, n_tokens) for docs(doc_id, text, source)."""
    sized = write_shared(
        docs.select("doc_id", "source", "text").where(F.col("text").isNotNull()).mapInPandas(
            _measure(capacity, tokenizer_dir, tokenizer), "doc_id long, piece long, n_tokens long, src long, cluster long"
        ),
        "p7-sized",
    )
    done: DataFrame | None = None
    rest, rounds, before = sized, 0, None
    while True:
        total = rest.agg(F.sum("n_tokens")).first()[0] or 0
        shards = max(1, -(-int(total) // shard_tokens))
        packed = (
            rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(rounds)), F.lit(shards)))
            .repartition(min(shards, 20_000), "shard")
            .groupBy("shard")
            .applyInPandas(_pack_shard(capacity, f"r{rounds}", LOOSE), PACKED)
        )
        rounds += 1
        last = shards == 1 or before is not None and total > 0.9 * before  # until all that is loose is one shard, or packing it again gains little
        before = total
        if not last:
            packed = write_shared(packed, f"p7-round{rounds}")
        keep = packed if last else packed.where(~F.col("loose"))
        keep = keep.select("container", "doc_id", "piece", "n_tokens")
        done = keep if done is None else done.unionByName(keep)
        if last:
            return done
        rest = packed.where("loose").select("doc_id", "piece", "n_tokens", "src", "cluster")
