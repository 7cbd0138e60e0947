"""Text functions as Columns. All are null for null text unless said otherwise; lengths count code points."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    """SHA-256 of the text with line ends, runs of blanks and of empty lines made alike, without outer white space."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.sha2(trim_all(t), 256)


def short_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def slug(c: Column) -> Column:
    """Lower case, apostrophes dropped, other runs to '-', no '-' at either end, cut to 100."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), "'", ""), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(t, "^-|-$", ""), 1, 100)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")


def search_tokens(c: Column) -> Column:
    """camelCase and snake_case split, lower case, ASCII letters and digits, at least two of them."""
    t = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(t, "_", " ")), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def _accents() -> tuple[str, str]:
    """Accented letters of the Latin blocks, and the letters without."""
    import unicodedata

    pairs = [(chr(o), unicodedata.normalize("NFD", chr(o))[0]) for o in range(0xC0, 0x250)]
    kept = [(x, y) for x, y in pairs if x != y and y.isascii() and x == x.lower()]
    return "".join(x for x, _ in kept), "".join(y for _, y in kept)


ACCENTS = _accents()


def plain_tokens(c: Column) -> Column:
    """Tokens of the inverted index before stemming: lower-case runs of letters and digits of any script, without accents."""
    return F.filter(F.split(F.translate(F.lower(c), *ACCENTS), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def set_tokens(c: Column) -> Column:
    """Distinct tokens of three or more characters, for set similarity."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def slug_similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def snippet(content: Column, query: Column, before: int = 80, after: int = 120) -> Column:
    """A window around the first query term that occurs anywhere; else the first 200 characters as they are. Line ends in the window become spaces."""
    low = F.lower(content)
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: (t != "") & F.contains(low, t))
    term = F.try_element_at(terms, F.lit(1))
    at = F.instr(low, term) - 1
    start, end = F.greatest(at - before, F.lit(0)), F.least(at + after, F.length(content))
    window = F.regexp_replace(content.substr(start + 1, end - start), "\n", " ")
    around = F.concat(F.when(start > 0, "...").otherwise(""), window, F.when(end < F.length(content), "...").otherwise(""))
    return F.when(term.isNull(), F.substring(content, 1, 200)).otherwise(around)


def detect_format(c: Column) -> Column:
    """html, markdown or plain."""
    t = trim_all(c)
    tags = F.regexp_count(t, F.lit(r"(?i)</?[a-z][\w-]*[^>]*>"))
    lines = F.size(F.split(t, "\n"))
    return (
        F.when(t.rlike(r"(?i)^<!doctype\s+html") | t.rlike("(?i)^<html") | ((tags > 5) & (tags / lines > 0.3)), "html")
        .when(t.rlike(r"(?m)^#{1,6}\s") | t.rlike("(?m)^```") | t.rlike("^---\n"), "markdown")
        .otherwise("plain")
    )


#: Names, patterns, replacements and order of the redaction catalogue, with word boundaries between ASCII signs.
PII_CATALOGUE = (
    ("anthropic_token", r"\bsk-ant-[a-zA-Z0-9_-]{20,}\b", "<REDACTED:anthropic_token>"),
    ("openai_token", r"\bsk-(?!ant-)[a-zA-Z0-9_-]{20,}\b", "<REDACTED:openai_token>"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", "<REDACTED:github_token>"),
    ("slack_token", r"\bxox[bpars]-[A-Za-z0-9-]{10,}\b", "<REDACTED:slack_token>"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "<REDACTED:aws_access_key>"),
    ("gcp_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b", "<REDACTED:gcp_api_key>"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "<REDACTED:jwt>"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<REDACTED:email>"),
    ("credit_card", r"\b(?:\d[ -]?){12,18}\d\b", "<REDACTED:credit_card>"),
    ("phone_e164", r"\+[1-9]\d{7,14}\b", "<REDACTED:phone>"),
    ("phone_us", r"(?:\b\d{3}[-.\s]|(?<![\d-])\(\d{3}\)\s?)\d{3}[-.\s]\d{4}\b", "<REDACTED:phone>"),
    ("private_ipv4", r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", "<REDACTED:private_ip>"),
    ("macos_user_path", r"/Users/[^/\s'\"]+", "/Users/<USER>"),
    ("linux_user_path", r"/home/[^/\s'\"]+", "/home/<USER>"),
)


def ascii_boundaries(rx: str) -> str:
    """Java's word boundary also looks at letters beyond ASCII; the catalogue's doesn't."""
    w = "[A-Za-z0-9_]"
    return rx.replace(r"\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")


def luhn_valid(digits: Column) -> Column:
    """13 to 19 digits with a correct check digit."""
    return F.length(digits).between(13, 19) & digits.rlike("^[0-9]+$") & F.call_function("luhn_check", digits)


def _step(c: Column, name: str, rx: str, put: str) -> Column:
    """The text after one pattern; of card numbers only those that pass the check, each at its own place."""
    rx = ascii_boundaries(rx)
    if name != "credit_card":
        return F.regexp_replace(c, rx, put)
    found = F.regexp_extract_all(c, F.lit(rx), F.lit(0))
    valid = lambda m: luhn_valid(F.regexp_replace(m, "[^0-9]", ""))
    kept = F.transform(found, lambda m: F.when(valid(m), put).otherwise(m))
    text = F.array_join(F.transform(F.arrays_zip(F.split(c, rx, -1).alias("a"), kept.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")
    return F.when(F.size(found) > 0, text).otherwise(c)


def scrub(c: Column, allow: tuple[str, ...] = ()) -> Column:
    """The text with every match of the catalogue, in order, each pattern on what the one before left, replaced."""
    for name, rx, put in PII_CATALOGUE:
        if name not in allow:
            c = _step(c, name, rx, put)
    return c


def _luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 * (n > 9) for n in twice) % 10 == 0


def scrub_text(text: str, allow: frozenset[str] = frozenset()) -> tuple[str, dict[str, int]]:
    """One text scrubbed, and how often each pattern was replaced."""
    counts: dict[str, int] = {}
    for name, rx, put in PII_CATALOGUE:
        if name in allow:
            continue
        card = name == "credit_card"
        n = 0

        def replaced(m: re.Match) -> str:
            nonlocal n
            if card and not _luhn(re.sub(r"[^0-9]", "", m[0])):
                return m[0]
            n += 1
            return put

        text = re.sub(rx, replaced, text, flags=re.ASCII)
        if n:
            counts[name] = n
    return text, counts


def scrubbed(df: DataFrame, column: str, allow: tuple[str, ...] = ()) -> DataFrame:
    """df with `column` scrubbed and a map `redactions` of how often each pattern was replaced, for those found. Text and counts come from
    one pass in Arrow batches: as column expressions every count would hold all the replacements before it once more."""
    skip = frozenset(allow)

    @F.pandas_udf("text string, redactions map<string,bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [scrub_text(t, skip) if t is not None else (None, {}) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "redactions": [n for _, n in done]})

    return df.withColumn("_s", run(F.col(f"`{column}`"))).withColumn(column, F.col("_s.text")).withColumn("redactions", F.col("_s.redactions")).drop("_s")


def strict(df: DataFrame, column: str, allow: tuple[str, ...] = ()) -> DataFrame:
    """df with `reason`, null where nothing of the catalogue is found in `column`, else the patterns found."""
    s = scrubbed(df.withColumn("_text", F.col(f"`{column}`")), "_text", allow)
    return s.withColumn("reason", F.when(F.size("redactions") > 0, F.concat(F.lit("patterns detected: "), F.array_join(F.map_keys("redactions"), ", ")))).drop("_text", "redactions")
