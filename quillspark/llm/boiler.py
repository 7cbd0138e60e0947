"""Page boilerplate against main content, by consensus of host paths.

Each page is cut into its containers, a line each, with its path: the open elements around it with generalised classes
(`div.c-*>ul>li`), or the markdown form where there are none (heading, item, quotation), and what the container holds (a title, a
heading, sentences, a row, code, a link, a trail, a label). A page scores its containers by where they lie: its main region goes
from its title to its last heading, long sentences, row or code. Then paths are voted on in Spark:

1. (host, path): the share of a host's containers of that path that lie outside the main regions, drawn towards the mean share of the path
   over all hosts, and that towards the mean of what it holds, so that a host with few pages follows the others and one with many decides for itself. A class is a site's own, so its
   paths are decided by the site under several titles.
2. (host, path with text) and (path with text) over all hosts: the same text under several titles, mostly outside or with the site's
   name in it, is boilerplate wherever it comes, also in the middle of a body.

Pages are extracted again with the winning paths alone: a container is boilerplate if its path or its text was voted out.

Scale: lines travel as 64-bit keys without text; votes are pre-aggregated per (host, path, title), so a hot host is spread over
its paths. Nothing is broadcast or collected.

Defined cases: a source without url or host votes with all such pages as one host; null or empty content gives no line; blank
lines are neither; a page whose host has no other page is decided by the votes of all hosts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.session import write_shared

#: A text is voted out when it comes under so many titles of a host, or at so many hosts, and so often outside the body.
MIN_TITLES, MIN_HOSTS, OUTSIDE = 2, 3, 0.5
#: Containers that stand for all hosts beside a host's own of a path, and hosts that stand for the kind beside those of the path.
PRIOR, PRIOR_HOSTS = 30, 10
#: Share outside that votes out containers of sentences.
SENTENCES_OUTSIDE = 0.8
#: Containers around a line that its path names, the innermost.
DEPTH = 4
#: Elements that are containers.
CONTAINERS = frozenset("address article aside blockquote body dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section span summary table tbody td th thead tr ul".split())
#: Elements that end when another of their kind begins.
SELF_ENDING = frozenset("li p dd dt td th tr".split())

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)/?>")
_CLASS = re.compile(r"class\s*=\s*[\"']?([^\"'>\s]+)")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)\s]*\)")
_MARK = re.compile(r"^\s*(?:(#{1,6})\s+|(>)\s*|([-*+•]|\d{1,3}[.)])\s+)")
_END = re.compile(r"[.!?…:;][\"'”’»)\]]*\Z")
_SEP = re.compile(r"\s*(?:\s[|·•/»›>]\s)\s*")
_NUMERIC_ROW = re.compile(r"\|?\s*[\d.,%\-]+(?:\s*\|\s*[\d.,%\-]+)+\s*\|?\Z")
_RULE_ROW = re.compile(r"\|?\s*:?-{2,}:?(?:\s*\|\s*:?-{2,}:?)*\s*\|?\Z")
_SIGNED = re.compile(r"[—–-] ?[A-ZÀ-Þ][\w'’.\-]+,? [\wÀ-ÿ]")
_SAID = re.compile(r"\[\d\d:\d\d\] ")

#: What a container holds. The first three lie in a main region wherever they are; a probe is a reading of a line that only looks votes up.
TITLE, CODE, ROW, HEADING, QUOTE, SAID, SENTENCES, LINK, TRAIL, LABEL, EMPTY, PROBE = range(12)
BODY_LIKE, SENTENCE_LIKE = frozenset((TITLE, CODE, ROW)), frozenset((HEADING, QUOTE, SAID, SENTENCES))


def host_of(url: str | None) -> str:
    """Host without port and the usual leading labels; '' where there is none."""
    if not url:
        return ""
    try:
        h = urlsplit(url if "://" in url else "http://" + url.lstrip("/")).hostname or ""
    except ValueError:
        return ""
    return re.sub(r"^(?:www\d?|m|docs|blog|wiki)\.", "", h.lower().rstrip("."))


#: Second-level labels under which names are registered.
_SECOND_LEVEL = frozenset("ac co com edu example gov net or org".split())


def label_of(host: str) -> str:
    """The name a site calls itself by: the label before the public suffix."""
    parts = host.split(".")
    end = len(parts) - 1
    if end > 1 and parts[end - 1] in _SECOND_LEVEL:
        end -= 1
    return parts[max(0, end - 1)] if host else ""


def generalise(text: str, label: str) -> str:
    t = re.sub(r"\d+", "9", re.sub(r"\s+", " ", text.lower())).strip()
    return re.sub(rf"(?<!\w){re.escape(label)}(?!\w)", "\x01", t) if label and label in t else t


def strip_tags(line: str) -> tuple[str, str, bool]:
    """Text of a line, its first element with generalised class, and whether all of its text is in links."""
    if "<" in line:
        m = _TAG.search(line)
        tag = generalised(m) if m else ""
        linked = bool(re.fullmatch(r"(?:\s*</?(?:li|ul|ol|nav|div|span|p|td|tr)\b[^>]*>)*\s*<a\b[^>]*>.*?</a>\s*(?:</?[a-z]+[^>]*>\s*)*", line.strip(), re.I))
        text = _TAG.sub("", line)
    else:
        text, tag, linked = line, "", False
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        linked = linked or not re.search(r"\w", _LINK.sub("", text))
        text = _LINK.sub(r"\1", text)
    return text.strip(), tag, linked


def generalised(m: re.Match) -> str:
    c = _CLASS.search(m[2])
    return m[1].lower() + ("." + re.sub(r"[0-9a-f]{3,}|\d+", "*", c[1]) if c else "")


def enter(line: str, open_: list[tuple[str, str]]) -> str:
    """The path of the containers around the line's text; `open_` goes on to the state behind the line."""
    path = None
    end = 0
    for m in _TAG.finditer(line):
        if path is None and line[end : m.start()].strip():
            path = ">".join(g for _, g in open_[-DEPTH:])
        end = m.end()
        name = m[1].lower()
        if name not in CONTAINERS:
            continue
        if m[0][1] == "/":
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at is not None:
                if path is None:
                    path = ">".join(g for _, g in open_[-DEPTH:])  # a container without text
                del open_[at:]
        elif not m[0].endswith("/>"):
            if name in SELF_ENDING and open_ and open_[-1][0] == name:
                open_.pop()
            open_.append((name, generalised(m)))
    return ">".join(g for _, g in open_[-DEPTH:]) if path is None else path


def same_title(text: str, title: str | None) -> bool:
    return bool(title) and re.sub(r"\W+", " ", text).strip().lower() == re.sub(r"\W+", " ", title).strip().lower()


def score(content: str, title: str | None, url: str | None) -> list[tuple[int, int, str, str, bool]]:
    """(line number, what it holds, path, generalised text, outside) of every line that is not blank."""
    label = label_of(host_of(url))
    rows: list[list] = []
    open_: list[tuple[str, str]] = []
    fence = False
    for n, raw in enumerate(content.split("\n"), 1):
        around = enter(raw, open_) if "<" in raw else ">".join(g for _, g in open_[-DEPTH:]) if open_ else ""
        text, tag, linked = strip_tags(raw)
        if not text:
            if raw.strip():  # bare tags take what follows them
                rows.append([n, None, around, "", "", False])
            continue
        m = _MARK.match(text)
        mark = "" if m is None else "#" if m[1] else ">" if m[2] else "-"
        body = text[m.end() :].strip() if m else text
        if text.startswith("```") or text.startswith("~~~"):
            fence = not fence
            holds = CODE
        elif fence:
            holds = CODE
        elif linked and len(body.split()) < 4:
            holds = LINK
        else:
            holds = _holds(body, mark, tag, title)
        rows.append([n, holds, around or mark, generalise(body, label), text, mark == "#" or tag[:2] in ("h1", "h2", "h3", "h4")])
    for i, r in enumerate(rows):  # rows of a table stand by each other
        t = r[4]
        if " | " in t or t.startswith("|"):
            near = [rows[j][4] for j in (i - 1, i + 1) if 0 <= j < len(rows)]
            if t.startswith("|") and t.endswith("|") or _NUMERIC_ROW.match(t) or _RULE_ROW.match(t) or any(_NUMERIC_ROW.match(x) or _RULE_ROW.match(x) for x in near):
                r[1] = ROW
    titles = [i for i, r in enumerate(rows) if r[4] and same_title(_MARK.sub("", r[4]), title)]
    sure = [i for i, r in enumerate(rows) if r[5] or r[1] in SENTENCE_LIKE and len(r[4]) > 130 or r[1] in BODY_LIKE]
    first = titles[0] if titles else (sure[0] if sure else 0)
    last = max(sure, default=len(rows))
    holds = EMPTY
    for r in reversed(rows):
        if r[1] is None:
            r[1] = holds
        holds = r[1]
    return [(r[0], r[1], r[2], r[3], i < first or i > last) for i, r in enumerate(rows)]


def _holds(body: str, mark: str, tag: str, title: str | None) -> int:
    if same_title(body, title):
        return TITLE
    if mark == "#" or tag[:2] in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return HEADING
    if mark == ">" or tag == "blockquote":
        return QUOTE
    if title and len(body) > len(title) and _SEP.search(body) and same_title(_SEP.split(body)[-1], title):
        return TRAIL
    words = body.split()
    if _SIGNED.match(body) or _SAID.match(body):
        return SAID
    if len(words) >= 4 and _END.search(body):
        return SENTENCES
    if len(body) > 100 and len(words) >= 12 and not _SEP.search(body):
        return SENTENCES
    if len(words) >= 4 and re.search(r"[.!?…] [A-ZÀ-ÞА-Я¿¡]\w* \w+ \w+ \w+", body):
        return SENTENCES  # several sentences, the last one without its end
    return LABEL


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, url, title, content in zip(b["id"], b["url"], b["title"], b["content"]):
            if not content:
                continue
            host = host_of(url)
            t = _key((title or "").lower())
            for n, holds, path, text, outside in score(content, title, url):
                if holds not in SENTENCE_LIKE:  # its text isn't asked for
                    rows.append((i, host, t, n, holds, _key(f"{path}|{holds}"), 0, outside, False, "." in path))
                    continue
                words = text.split(" ")
                key, parts = word_keys(words)
                rows.append((i, host, t, n, holds, _key(f"{path}|{holds}"), _signed(key), outside, "\x01" in text, "." in path))
                if not host and len(words) > 2:  # the site's name isn't known: try each word as its place
                    for w, word in enumerate(words):
                        core = word.strip(".,;:!?")
                        if core:
                            other = key + (_hash(word.replace(core, "\x01")) - _hash(word)) * parts[w]
                            rows.append((i, host, t, n, PROBE, 0, _signed(other % (1 << 64)), outside, True, False))
        yield pd.DataFrame(rows, columns=["id", "host", "title", "line_no", "holds", "path", "text", "outside", "named", "classed"])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(k: int) -> int:
    return k - (1 << 64) if k >= 1 << 63 else k


def _key(text: str) -> int:
    return _signed(_hash(text))


def word_keys(words: list[str]) -> tuple[int, list[int]]:
    """Key of a text as a polynomial over its words, and the factor of each, so that the key with another word in a place is a step away."""
    key, power, parts = 0, 1, []
    for w in words:
        key = (key + _hash(w) * power) % (1 << 64)
        parts.append(power)
        power = power * 0x9E3779B97F4A7C15 % (1 << 64)
    return key, parts


def vote_paths(lines: DataFrame) -> DataFrame:
    """(host, path) voted out: the host's share outside, drawn towards the mean share of the path, that towards the mean of what it holds. A
    path with a class is a site's own: under several titles its share stands alone."""
    several = F.max("classed") & (F.min("title") != F.max("title"))
    own = lines.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.col("outside").cast("int")).alias("out"), F.first("holds").alias("holds"), several.alias("alone")).withColumn("r", F.col("out") / F.col("n"))
    kind = own.groupBy("holds").agg(F.avg("r").alias("usual"))  # one row for each of a dozen kinds
    every = own.groupBy("path").agg(F.sum("r").alias("sum"), F.count("*").alias("hosts"))  # a hot host counts as one
    j = own.join(every, "path").join(F.broadcast(kind), "holds")
    share = (F.col("sum") + PRIOR_HOSTS * F.col("usual")) / (F.col("hosts") + PRIOR_HOSTS)
    least = F.when(F.col("holds").isin(*SENTENCE_LIKE), SENTENCES_OUTSIDE).otherwise(OUTSIDE)
    prior = F.when(F.col("alone"), 0).otherwise(PRIOR)
    return j.where(F.col("out") + prior * share >= least * (F.col("n") + prior)).select("host", "path")


def vote_texts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts voted out: (host, text) by the host's own pages, and (text) by all hosts."""
    per_title = lines.groupBy("host", "text", "title").agg(F.count("*").alias("n"), F.sum(F.col("outside").cast("int")).alias("out"), F.max("named").alias("named"))
    per_host = per_title.groupBy("host", "text").agg(F.count("*").alias("titles"), F.sum("n").alias("n"), F.sum("out").alias("out"), F.max("named").alias("named"))
    everywhere = per_host.groupBy("text").agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("out").alias("out"), F.max("named").alias("named"))
    away = (F.col("out") >= OUTSIDE * F.col("n")) | F.col("named")
    return (
        per_host.where((F.col("titles") >= MIN_TITLES) & away).select("host", "text"),
        everywhere.where((F.col("hosts") >= MIN_HOSTS) & away).select("text"),
    )


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(source_id, line_no) of every line that is not the body, of pages(id, url, title, content)."""
    lines = write_shared(
        pages.select("id", "url", "title", "content").where("content is not null and content <> ''").mapInPandas(
            _lines, "id string, host string, title long, line_no long, holds int, path long, text long, outside boolean, named boolean, classed boolean"
        ),
        "p5-lines",
    )
    real = lines.where(F.col("holds") != PROBE)
    doubtful = real.where(F.col("holds").isin(*SENTENCE_LIKE))
    by_host, by_all = vote_texts(doubtful)
    out = (
        real.join(vote_paths(real), ["host", "path"], "left_semi").select("id", "line_no")
        .unionByName(doubtful.join(by_host, ["host", "text"], "left_semi").select("id", "line_no"))
        .unionByName(lines.where(F.col("holds").isin(*SENTENCE_LIKE, PROBE)).join(by_all, "text", "left_semi").select("id", "line_no"))
    )
    return out.select(F.col("id").alias("source_id"), "line_no").distinct()


def main_text(pages: DataFrame) -> DataFrame:
    """(source_id, content) with only the body's lines and the blank lines between them."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, drop in zip(b["content"], b["drop"]):
                if c and drop is not None:
                    gone = set(map(int, drop))
                    c = "\n".join(strip_tags(l)[0] if "<" in l else l for n, l in enumerate(c.split("\n"), 1) if n not in gone).strip("\n")
                    c = re.sub(r"\n{3,}", "\n\n", c)
                out.append(c)
            yield pd.DataFrame({"source_id": b["id"], "content": out})

    drop = boilerplate_lines(pages).groupBy("source_id").agg(F.collect_list("line_no").alias("drop"))
    base = pages.select("id", "content").join(drop, F.col("id") == F.col("source_id"), "left").select("id", "content", "drop")
    return base.mapInPandas(keep, "source_id string, content string")
