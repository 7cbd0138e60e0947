"""What an input is, and plain text and identifiers out of it, as Columns. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.text import trim_all

#: Extensions of data files and of images.
DATASET_EXTENSIONS = ("csv", "tsv", "jsonl", "ndjson", "parquet")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff")

#: What tells a page behind a wall.
PAYWALL = (
    r"(?i)paywall", r"(?i)subscribe to (read|continue|access)", r"(?i)premium (content|article|member)", r"(?i)sign[- ]?in to (read|continue|view)",
    r"(?i)create (a |an )?account to", r'(?i)class="[^"]*paywall[^"]*"', r'(?i)class="[^"]*subscriber-only[^"]*"', r"(?i)meter-count",
)
#: Elements whose text is no article text.
SKIPPED_ELEMENTS = ("script", "style", "nav", "footer", "header")


def source_type(given: Column, is_folder: Column | None = None, has_git: Column | None = None, as_dataset: bool = False) -> Column:
    """Type of an input by its spelling; folders by the two flags, where they are known."""
    low = F.lower(given)
    ext = F.regexp_extract(low, r"\.([^./\\]+)$", 1)
    repo = given.rlike(r"(?i)^git@github\.com:[^/]+/[^/]+?(\.git)?$") | given.rlike(r"(?i)^https?://github\.com/+[^/?#]+/+[^/?#]+/*([?#].*)?$")
    out = (
        F.when(given.rlike(r"(?i)youtu\.?be") | given.rlike(r"^[A-Za-z0-9_-]{11}$"), "youtube")
        .when(given.rlike(r"(?i)arxiv\.org") | given.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), "arxiv")
        .when(repo, "code")
        .when(given.rlike(r"(?i)^https?://huggingface\.co/datasets/"), "dataset")
        .when(low.rlike("^https?://"), F.when(F.endswith(low, F.lit(".pdf")), "pdf").otherwise("url"))
    )
    if is_folder is not None:
        out = out.when(is_folder, F.when(has_git, "code").otherwise("folder") if has_git is not None else F.lit("folder"))
    return F.when(given.isNotNull(), out.when(F.lit(as_dataset) | ext.isin(*DATASET_EXTENSIONS), "dataset").when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext == "pdf", "pdf").otherwise("file"))


def js_shell(html: Column) -> Column:
    """A page that only a script fills."""
    size = F.length(trim_all(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " ")))
    root, scripts = html.rlike("""id=["'](__next|root|app|__nuxt)["']"""), F.regexp_count(html, F.lit("(?i)<script"))
    return ((size < 200) & (scripts > 5)) | (root & (size < 500)) | html.rlike("(?i)<noscript")


def paywall(html: Column) -> Column:
    out = F.lit(False)
    for rx in PAYWALL:
        out = out | html.rlike(rx)
    return out


def status_error(status: Column) -> Column:
    """Error code of an HTTP status that is no success."""
    return F.when(status.isin(401, 403), "PAYWALL").when(status.isin(404, 410), "NOT_FOUND").when(status == 429, "RATE_LIMITED").when(status.isNotNull(), "NETWORK")


def retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def fallback_text(html: Column) -> Column:
    """Text of a page without its scripts, styles, menus, headers and footers, on one line."""
    t = html
    for name in SKIPPED_ELEMENTS:
        t = F.regexp_replace(t, rf"(?is)<{name}[^>]*>.*?</{name}>", "")
    return trim_all(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "&nbsp;", " "), r"\s+", " "))


def title_from_url(url: Column) -> Column:
    """The last part of the path, or the host, with blanks for '-' and '_'."""
    host, path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(host == "", url).otherwise(F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(F.when(last == "", F.lower(host)).otherwise(last), F.lit("+"), F.lit("%2B"))), url), "[-_]", " "))


def page_title(html: Column, url: Column) -> Column:
    t = trim_all(F.regexp_extract(html, r"(?i)<title[^>]*>(.*?)</title>", 1))
    return F.when(t == "", title_from_url(url)).otherwise(t)


def video_id(given: Column) -> Column:
    host = F.lower(F.regexp_extract(given, r"^https?://([^/?#:]+)", 1))
    short, query = F.regexp_extract(given, r"^https?://[^/?#]+/([^?#]*)", 1), F.regexp_extract(given, r"[?&]v=([^&#]*)", 1)
    empty = lambda c: F.when(c != "", c)
    return F.when(given.rlike(r"^[A-Za-z0-9_-]{11}$"), given).when(host == "youtu.be", empty(short)).when(F.contains(host, F.lit("youtube.com")), empty(query))


def timed_text(xml: Column) -> Column:
    """Segments of a transcript, without entities, joined by blanks."""
    seg = F.regexp_extract_all(xml, F.lit(r"(?s)<text[^>]*>(.*?)</text>"), F.lit(1))

    def plain(s: Column) -> Column:
        for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("\n", " ")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return trim_all(s)

    return F.array_join(F.filter(F.transform(seg, plain), lambda s: s != ""), " ")


def paper_id(given: Column) -> Column:
    raw = given.rlike(r"^(\d{4}\.\d{4,5}(v\d+)?|[a-z-]+/\d{7}(v\d+)?)$")
    url = F.regexp_replace(F.regexp_extract(given, r"arxiv\.org/(?:abs|pdf)/([^\s/?#]+)", 1), r"\.pdf$", "")
    return F.when(raw, given).when(url != "", url)


def clean_title(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\s+", " "))


def git_remote(given: Column) -> Column:
    """One https spelling of a remote: without credentials, query, '.git', port 443 and closing slashes, in lower case; null if it is none."""
    raw = trim_all(given)
    ssh = r"^([\w.-]+@)?([\w.-]+):([\w./~-]+)$"
    is_ssh = raw.rlike(ssh) & ~F.contains(raw, F.lit("://")) & ~raw.rlike(r"^[A-Za-z]:[\\/]")
    url = F.when(is_ssh, F.regexp_replace(raw, ssh, "https://$2/$3")).otherwise(raw)
    whole = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@]+)([^?#]*).*$"
    host = F.regexp_replace(F.regexp_extract(url, whole, 1), ":443$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, whole, 2), r"(?i)\.git$", ""), "/+$", ""), "^/*", "/")
    return F.when(url.rlike(whole), F.lower(F.concat(F.lit("https://"), host, path)))


#: Patterns of declarations by language, in order; at most 40 names of a file are kept.
_BRACED = (r"\b(?:public|private|protected|internal)\s+(?:static\s+)?(?:[A-Za-z_<>\[\],\s]+\s+)?([A-Za-z_][\w]*)\s*\(", r"\b(?:public|private|protected|internal)?\s*class\s+([A-Za-z_][\w]*)", r"\b(?:public|private|protected|internal)?\s*interface\s+([A-Za-z_][\w]*)")
_SCRIPT = (
    r"\b(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", r"\b(?:export\s+)?class\s+([A-Za-z_$][\w$]*)", r"\b(?:export\s+)?type\s+([A-Za-z_$][\w$]*)",
    r"\b(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", r"\b(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(",
)
SIGNATURES = {
    "python": (r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][\w]*)\s*\(", r"(?m)^\s*class\s+([A-Za-z_][\w]*)"),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": (r"\bfunc\s+(?:\([^)]*\)\s+)?([A-Za-z_][\w]*)\s*\(", r"\btype\s+([A-Za-z_][\w]*)\s+(?:struct|interface)"),
    "rust": (r"\b(?:pub\s+)?fn\s+([A-Za-z_][\w]*)", r"\b(?:pub\s+)?struct\s+([A-Za-z_][\w]*)", r"\b(?:pub\s+)?trait\s+([A-Za-z_][\w]*)", r"\b(?:pub\s+)?enum\s+([A-Za-z_][\w]*)"),
    "java": _BRACED,
    "kotlin": _BRACED,
    "csharp": _BRACED,
    "ruby": (r"(?m)^\s*def\s+(?:self\.)?([A-Za-z_][\w!?=]*)", r"(?m)^\s*class\s+([A-Z][\w]*)", r"(?m)^\s*module\s+([A-Z][\w]*)"),
    "c": (r"(?m)^\s*(?:[A-Za-z_][\w*\s]+?)\s+([A-Za-z_][\w]*)\s*\([^)]*\)\s*\{", r"\b(?:class|struct)\s+([A-Za-z_][\w]*)"),
}
SIGNATURES["cpp"] = SIGNATURES["c"]
MOST_SIGNATURES = 40


def signatures(content: Column, language: Column) -> Column:
    """Distinct declared names in order of pattern and place; an empty array for other languages."""
    out = F.array().cast("array<string>")
    for name, patterns in SIGNATURES.items():
        found = F.concat(*[F.regexp_extract_all(content, F.lit(rx), F.lit(1)) for rx in patterns])
        out = F.when(language == name, F.slice(F.array_distinct(found), 1, MOST_SIGNATURES)).otherwise(out)
    return F.when(content.isNotNull(), out)


#: Manifests and the packages in them that name a framework.
MANIFESTS = ("package.json", "pyproject.toml", "requirements.txt", "Cargo.toml", "go.mod", "Gemfile")


def frameworks(manifest: Column, content: Column, known: tuple[str, ...]) -> Column:
    """Known packages that a manifest (one of `MANIFESTS`, by file name) depends on, in the order of `known`."""
    quoted = lambda n: content.rlike(rf'"{n}"\s*:')
    listed = lambda n: content.rlike(rf"(?im)^\s*[\"']?{n}(?![\w.-])")
    found = [
        F.when(
            F.when(manifest == "package.json", quoted(n)).when(manifest == "go.mod", content.rlike(rf"(?m)^\s*(?:require\s+)?\S*{n}\S*\s+v\d"))
            .when(manifest == "Gemfile", content.rlike(rf"(?m)^\s*gem\s+[\"']{n}[\"']")).when(manifest == "pyproject.toml", listed(n) | content.rlike(rf"[\"']{n}(?:[\[<>=~! ;][^\"']*)?[\"']"))
            .when(manifest.isin("requirements.txt", "Cargo.toml"), listed(n)).otherwise(False),
            F.lit(n),
        )
        for n in known
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def fingerprint(files: Column) -> Column:
    """Of an array of (name, content) in a fixed order: 'name:hash' joined by '|'; its short hash is the key of a code base without a remote."""
    return F.array_join(F.transform(files, lambda f: F.concat(f["name"], F.lit(":"), F.substring(F.sha1(f["content"]), 1, 16))), "|")


def codebase_key(origin: Column) -> Column:
    return F.substring(F.sha1(origin), 1, 16)


def duration_seconds(c: Column) -> Column:
    """'7d', '24h', '30m', '60s'; null for anything else."""
    n, unit = F.regexp_extract(c, r"^(\d+)([dhms])$", 1), F.regexp_extract(c, r"^(\d+)([dhms])$", 2)
    size = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.when(c.rlike(r"^\d+[dhms]$"), n.cast("long") * size)


def wikilinks(c: Column) -> Column:
    """Targets of [[target]] and [[target|text]] in order."""
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
