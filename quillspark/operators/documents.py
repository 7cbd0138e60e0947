"""Chunking and compression of documents. Both are sequential over the blocks of one text, so they run per record in Arrow batches;
there is no shuffle. Defined cases: null or empty text gives no chunk and compresses to empty text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame

from quillspark.functions.estimate import DENSE_CHARS

_DENSE = frozenset(DENSE_CHARS)
_FENCED = re.compile(r"^(`{3,})[^\n]*\n.*?\n\1$", re.M | re.S)
_FRONT = re.compile(r"\A---\n(.*?)\n---\n?", re.S)
_HEAD = re.compile(r"^(#{1,6})\s+(.+)$")
_SENTENCES = re.compile(r"[^.!?]+[.!?]+\s*")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s")
#: Chunk types that are never merged with a neighbour.
ATOMIC = ("heading", "code", "frontmatter")

Chunk = tuple[str, str, str | None]  # content, type, heading


def tokens(text: str) -> int:
    n = len(text)
    return ceil(n / (4 - 1.5 * (sum(c in _DENSE for c in text) / n))) if n else 0


def sentences(text: str) -> list[str]:
    """Sentences with their ends and the blanks behind; what follows the last end is in none. Only the part up to the last end is looked at,
    so a long text without ends isn't tried from every place."""
    end = max(text.rfind(c) for c in ".!?") + 1
    while end and end < len(text) and text[end].isspace():
        end += 1
    return _SENTENCES.findall(text[:end]) if end else []


def split_sentences(text: str, most: int) -> list[str]:
    """Pieces of whole sentences within the limit; what follows the last full sentence belongs to no piece, unless there is no sentence at all."""
    out, held = [], ""
    for s in sentences(text) or [text]:
        if held and tokens(held + s) > most:
            out.append(held.strip())
            held = s
        else:
            held += s
    return out + ([held.strip()] if held.strip() else [])


def chunk_plain(text: str, least: int = 50, most: int = 1000) -> list[Chunk]:
    """Paragraphs; one below `least` tokens takes in the next, one above `most` is split at sentences."""
    groups: list[str] = []
    for p in filter(None, (x.strip() for x in re.split(r"\n{2,}", text))):
        if groups and tokens(groups[-1]) < least:
            groups[-1] += "\n\n" + p
        else:
            groups.append(p)
    return [(piece, "paragraph", None) for g in groups for piece in ([g] if tokens(g) <= most else split_sentences(g, most))]


def block_type(block: str) -> str:
    if len([x for x in block.split("\n") if x.strip().startswith("|")]) >= 2 and re.search(r"^\|.+\|$", block, re.M):
        return "table"
    if re.search(r"^>\s", block, re.M):
        return "blockquote"
    if re.search(r"^[\t ]*(?:[-*+]\s|\d+[.)]\s)", block, re.M):
        return "list"
    return "paragraph"


def _blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) in order: fenced code, headings, and blocks between empty lines. A line of blanks alone doesn't end a block."""
    out: list[tuple[str, str]] = []
    at = 0
    spans = [m.span() for m in _FENCED.finditer(text)]
    for a, e in [*spans, (len(text), len(text))]:
        part, lines = text[at:a], []
        for line in [*part.split("\n"), None]:
            head = line is not None and _HEAD.match(line)
            if head or line is None:
                out += [("block", b.strip()) for b in re.split(r"\n{2,}", "\n".join(lines)) if b.strip()]
                lines = []
                if head:
                    out.append(("heading", line.strip()))
            else:
                lines.append(line)
        if e > a:
            out.append(("code", text[a:e]))
        at = e
    return out


def chunk_markdown(text: str, least: int = 50, most: int = 1000) -> list[Chunk]:
    """Front matter, headings, fenced code as it is, and blocks by type under their heading; small blocks are joined, huge ones split."""
    raw: list[Chunk] = []
    m = _FRONT.match(text)
    if m:
        raw.append((m[0].strip(), "frontmatter", None))
        text = text[m.end() :]
    heading: str | None = None
    for kind, b in _blocks(text):
        if kind == "heading":
            heading = _HEAD.match(b)[2].strip()
            raw.append((b, "heading", heading))
        else:
            raw.append((b, "code" if kind == "code" else block_type(b), heading))
    joined: list[list] = []
    open_ = False
    for c, t, h in raw:
        if t in ATOMIC:
            joined.append([c, t, h])
            open_ = False
        elif open_ and tokens(joined[-1][0]) < least:
            joined[-1][0] += "\n\n" + c
            if joined[-1][1] == "paragraph":
                joined[-1][1] = t
        else:
            joined.append([c, t, h])
            open_ = True
    return [(piece, t, h) for c, t, h in joined for piece in ([c] if t == "code" or tokens(c) <= most else split_sentences(c, most))]


def _bare(t: str) -> str:
    return re.sub(r"<[^>]+>", "", t)


def _plain_entities(t: str) -> str:
    for a, b in ENTITIES:
        t = t.replace(a, b)
    return t


#: Entities that are decoded, in order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def html_to_markdown(text: str) -> str:
    """Headings, code, emphasis, links, items, quotations and paragraphs as markdown; other tags leave their text. Tags without a line end
    between them are inline."""
    fence = lambda body: f"\n```\n{body.strip()}\n```\n"
    rules = [(rf"(?i)<h{n}[^>]*>(.*?)</h{n}>", lambda m, n=n: f"\n{'#' * n} {_bare(m[1]).strip()}\n") for n in range(6, 0, -1)]
    rules += [
        (r"(?is)<pre[^>]*><code[^>]*>(.*?)</code></pre>", lambda m: fence(_plain_entities(m[1]))),
        (r"(?is)<pre[^>]*>(.*?)</pre>", lambda m: fence(_plain_entities(_bare(m[1])))),
        (r"(?i)<code[^>]*>(.*?)</code>", lambda m: f"`{_bare(m[1])}`"),
        (r"(?i)<(strong|b)[^>]*>(.*?)</\1>", lambda m: f"**{_bare(m[2])}**"),
        (r"(?i)<(em|i)[^>]*>(.*?)</\1>", lambda m: f"*{_bare(m[2])}*"),
        (r'(?i)<a[^>]+href="([^"]*)"[^>]*>(.*?)</a>', lambda m: f"[{_bare(m[2])}]({m[1]})"),
        (r"(?is)<li[^>]*>(.*?)</li>", lambda m: f"- {_bare(m[1]).strip()}\n"),
        (r"(?is)<blockquote[^>]*>(.*?)</blockquote>", lambda m: "\n".join(f"> {line}" for line in _bare(m[1]).strip().split("\n")) + "\n"),
        (r"(?i)<br\s*/?>", lambda m: "\n"), (r"(?i)</p>", lambda m: "\n\n"), (r"(?i)<p[^>]*>", lambda m: ""),
    ]
    for rx, put in rules:
        text = re.sub(rx, put, text)
    return re.sub(r"\n{3,}", "\n\n", _plain_entities(_bare(text))).strip()


def chunk(text: str, form: str, least: int = 50, most: int = 1000) -> list[Chunk]:
    if not text:
        return []
    if form == "html":
        return chunk_markdown(html_to_markdown(text), least, most)
    return chunk_markdown(text, least, most) if form == "markdown" else chunk_plain(text, least, most)


def chunk_documents(docs: DataFrame, least: int = 50, most: int = 1000) -> DataFrame:
    """(id, position, content, chunk_type, heading, token_count) of docs(id, content, format)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p, c, t, h, tokens(c)) for i, x, f in zip(b["id"], b["content"], b["format"]) for p, (c, t, h) in enumerate(chunk(x, f, least, most))]
            yield pd.DataFrame(rows, columns=["id", "position", "content", "chunk_type", "heading", "token_count"])

    return docs.select("id", "content", "format").mapInPandas(run, "id string, position long, content string, chunk_type string, heading string, token_count long")


# ---- compression ----------------------------------------------------------------------------------------------------------------


def shorten_lists(text: str, keep: int = 5) -> str:
    """Lists cut to their first items with a note of how many were left out; fenced code and headings stay."""
    out: list[str] = []
    run: list[str] = []
    code = False

    def close() -> None:
        out.extend(run[:keep])
        if len(run) > keep:
            out.append(f"  ... ({len(run) - keep} more items omitted)")
        run.clear()

    for line in text.split("\n"):
        fence = line.startswith("```")
        if not code and not fence and not line.startswith("#") and _ITEM.match(line):
            run.append(line)
            continue
        close()
        code ^= fence
        out.append(line)
    close()
    return "\n".join(out)


def _parts(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]


def _words(s: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", s.lower()) if len(w) > 2]


def drop_repeats(text: str, alike: float = 0.8) -> str:
    """Sentences that resemble one already kept are dropped; those of fewer than three tokens stay."""
    kept, sets = [], []
    for s in _parts(text):
        w = set(_words(s))
        if len(w) >= 3:
            if any(len(w & o) >= alike * len(w | o) for o in sets):
                continue
            sets.append(w)
        kept.append(s)
    return " ".join(kept)


def extract(text: str, share: float = 0.6) -> str:
    """The sentences with the highest mean term frequency, the first three and last two favoured, in their order."""
    parts = _parts(text)
    if len(parts) <= 3:
        return text
    words = [_words(s) for s in parts]
    freq: dict[str, int] = {}
    for w in words:
        for x in w:
            freq[x] = freq.get(x, 0) + 1
    n = len(parts)
    score = [(sum(freq[x] for x in w) / len(w) if w else 0) * (1.5 if i < 3 or i >= n - 2 else 1) for i, w in enumerate(words)]
    best = sorted(range(n), key=lambda i: (-score[i], i))[: max(3, ceil(n * share))]
    return " ".join(parts[i] for i in sorted(best))


def compress(text: str) -> tuple[str, int, int, int, int]:
    """(compressed, tokens before, after shortened lists, after dropped repeats, after extraction)"""
    short = shorten_lists(text)
    once = drop_repeats(short)
    out = extract(once, 0.5)
    return out, tokens(text), tokens(short), tokens(once), tokens(out)


def compress_documents(docs: DataFrame) -> DataFrame:
    """(id, content, before, lists, repeats, after) of docs(id, content): the compressed text and its tokens before and after every stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *compress(x or "")) for i, x in zip(b["id"], b["content"])], columns=["id", "content", "before", "lists", "repeats", "after"])

    return docs.select("id", "content").mapInPandas(run, "id string, content string, before long, lists long, repeats long, after long")
