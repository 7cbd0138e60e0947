"""Cutting oversized texts at natural boundaries, with overlap.

Dynamic programming over boundary positions: the cost of a division is the sum of cut penalties (blank line < line end <
sentence end < word < character), of a charge per piece and of the squared deviation from an even size, subject to every piece
staying within the limit and to a specified overlap with the piece before.

Defined cases: null or empty text gives no piece; a text within the limit gives no piece from the oversize operator and one
piece from `split_text`; text without any pause is cut between characters. Offsets are code points. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillspark.functions.estimate import DENSE_CHARS, token_estimate

LIMIT, OVERLAP = 1000, 100
#: Cut penalties by kind of boundary.
BLANK, LINE, SENTENCE, WORD, CHAR = 0.0, 1.0, 1.5, 6.0, 20.0
IN_FENCE = 3.0
PER_PIECE, EVENNESS = 4.0, 6.0
#: Gaps (characters) between natural boundaries above which words, then characters, become boundaries.
WORD_GAP, CHAR_GAP = 300, 300

_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*[ \t]+")
_SPACE = re.compile(r"\s+")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(.+?)[ \t#\r]*$", re.M)
_DENSE = np.zeros(128, dtype=bool)
_DENSE[[ord(c) for c in DENSE_CHARS]] = True


def _dense_prefix(text: str) -> np.ndarray:
    """Number of dense characters before each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hit = (points < 128) & _DENSE[np.minimum(points, 127)]
    return np.concatenate(([0], np.cumsum(hit)))


def _tokens(length: np.ndarray, dense: np.ndarray) -> np.ndarray:
    length = np.maximum(length, 1)
    return np.ceil(length / (4.0 - (dense / length) * 1.5))


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, with their penalties; the end of the text is the last."""
    n = len(text)
    best: dict[int, float] = {}
    for rx, cost in ((_SENTENCE, SENTENCE), (_LINE, LINE), (_BLANK, BLANK)):
        for m in rx.finditer(text):
            best[m.end()] = cost
    marks = [m.start() for m in _FENCE.finditer(text)]
    for p in best:
        i = bisect_left(marks, p)  # marks before p
        if i % 2 and i < len(marks):
            best[p] += IN_FENCE
    best.pop(0, None)
    best[n] = 0.0
    edges = sorted(best)
    for a, b in zip([0, *edges], edges):
        if b - a <= WORD_GAP:
            continue
        last = a
        for m in _SPACE.finditer(text, a, b):
            if m.end() - last >= 40 and m.end() < b:
                best[m.end()] = WORD
                last = m.end()
    edges = sorted(best)
    for a, b in zip([0, *edges], edges):
        for p in range(a + CHAR_GAP // 3, b, CHAR_GAP // 3) if b - a > CHAR_GAP else ():
            best[p] = CHAR
    pos = np.array(sorted(best), dtype=np.int64)
    return pos, np.array([best[p] for p in pos.tolist()])


def _overlap_starts(pos: np.ndarray, pen: np.ndarray, dense: np.ndarray, overlap: int) -> np.ndarray:
    """For a piece ending at pos[i], where the next one starts: the mildest boundary about `overlap` tokens before it."""
    if overlap <= 0:
        return pos.copy()
    out = np.empty_like(pos)
    for i, e in enumerate(pos.tolist()):
        lo = int(np.searchsorted(pos, e - 6 * overlap))
        cand = pos[lo:i]
        if len(cand):
            t = _tokens(e - cand, dense[e] - dense[cand])
            off = np.abs(t - overlap) / overlap
            cost = np.where(off <= 0.35, pen[lo:i] / 4 + 4 * off, np.inf)
            j = int(np.argmin(cost))
            if np.isfinite(cost[j]):
                out[i] = cand[j]
                continue
        s = np.arange(max(0, e - 4 * overlap), e)
        t = _tokens(e - s, dense[e] - dense[s])
        out[i] = s[int(np.argmin(np.abs(t - overlap)))] if len(s) else e
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece. Every piece is within the limit; each but the first starts about `overlap` tokens before the last
    one's end. An overlap that isn't below the limit is an error."""
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} does not fit a limit of {limit}")
    n = len(text)
    if n == 0:
        return []
    dense = _dense_prefix(text)
    total = int(_tokens(np.array([n]), np.array([dense[n]]))[0])
    if total <= limit:
        return [(0, n, total)]
    pos, pen = boundaries(text)
    starts = np.concatenate(([0], _overlap_starts(pos, pen, dense, overlap)))  # starts[i]: for the piece after the i-th boundary
    ends = np.concatenate(([0], pos))
    pieces = max(2, -(-(total - overlap) // (limit - overlap)))
    target = min(limit, total / pieces + overlap)
    m = len(ends)
    cost = np.full(m, np.inf)
    back = np.zeros(m, dtype=np.int64)
    cost[0] = 0.0
    lo = 0
    for j in range(1, m):
        e = ends[j]
        while True:
            s = starts[lo]
            k = dense[e] - dense[s]
            if lo >= j or (e - s) / (4.0 - (k / (e - s)) * 1.5) <= limit:
                break
            lo += 1
        if lo >= j:
            continue
        s = starts[lo:j]
        t = _tokens(e - s, dense[e] - dense[s])
        c = cost[lo:j] + EVENNESS * ((t - target) / target) ** 2
        c = np.where(t <= limit, c, np.inf)
        i = int(np.argmin(c))
        cost[j] = c[i] + pen[j - 1] + PER_PIECE
        back[j] = lo + i
    if not np.isfinite(cost[-1]):  # a limit below one boundary gap: plain steps
        step = max(1, 2 * (limit - overlap))
        cuts = [(max(0, a - 2 * overlap), min(n, a + step)) for a in range(0, n, step)]
    else:
        cuts, j = [], m - 1
        while j > 0:
            i = int(back[j])
            cuts.append((int(starts[i]), int(ends[j])))
            j = i
        cuts.reverse()
    return [(a, b, int(_tokens(np.array([b - a]), np.array([dense[b] - dense[a]]))[0])) for a, b in cuts]


def headings_at(text: str, starts: list[int]) -> list[str | None]:
    """The last markdown heading at or before each start, outside nothing in particular; None where there is none."""
    found = [(m.start(), m[1]) for m in _HEADING.finditer(text)]
    at = [p for p, _ in found]
    return [found[i - 1][1] if (i := bisect_right(at, s)) else None for s in starts]


PIECES = "rec_table string, rec_id string, position long, token_count long, heading string, start_char long, end_char long, content string"


def _splitter(limit: int, overlap: int, with_content: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tab, rid, text in zip(b["rec_table"], b["rec_id"], b["content"]):
                cuts = split_text(text, limit, overlap)
                for p, ((a, e, t), h) in enumerate(zip(cuts, headings_at(text, [c[0] for c in cuts]))):
                    rows.append((tab, rid, p, t, h, a, e, text[a:e] if with_content else None))
            yield pd.DataFrame(rows, columns=["rec_table", "rec_id", "position", "token_count", "heading", "start_char", "end_char", "content"])

    return run


def split_oversized(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_content: bool = True) -> DataFrame:
    """Pieces of every record (rec_table, rec_id, content) estimated above the limit. The estimate runs in the JVM, so only oversized texts reach Python; there is no shuffle."""
    big = records.select("rec_table", "rec_id", "content").where(token_estimate(F.col("content")) > limit)
    return big.mapInPandas(_splitter(limit, overlap, with_content), PIECES)
