"""Live credentials in code, configuration and notes: found by entropy and context, blanked in place.

Quoted strings and long tokens are extracted; their Shannon entropy is held against a threshold that depends on the alphabet
(hex, alphanumeric, base64, printable) and on the length, since a short string cannot reach the entropy of its alphabet. Names of
the assigned field, call or header lower the threshold (`NAMED_SHARE`). Literals that are joined or glued together are one value.
Hashes, identifiers, public keys, references and placeholders are left out. Values and lines are taken whole, whatever their length.

Each record is handled alone, in Arrow batches, with no shuffle. Values are blanked with a filler of the same kind, so quotes,
separators and line count stay. Defined cases: null content gives no finding and stays null; empty content stays empty.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Words that name a secret when they end the name of a field, flag or variable.
SECRET_NAMES = (
    "password passwd passphrase passwort kennwort kennung_pw pwd pass pw secret token apikey api_key api-key signing_key signingkey "
    "license_key licensekey access_key accesskey private_key privatekey secret_key secretkey encryption_key client_secret webhook_secret "
    "credential credentials auth authtoken auth_token contraseña contrasena clave senha mot_de_passe motdepasse mdp hasło haslo пароль"
).split()
#: Prefixes under which public services issue keys.
ISSUED = r"(?:sk-|sk_live_|rk_live_|gh[pousr]_|github_pat_|xox[abeprs]-|AKIA|ASIA|AIza|glpat-|npm_|hf_|pypi-|SG\.|dop_v1_|shpat_)"

_NAMES = "|".join(sorted(map(re.escape, SECRET_NAMES), key=len, reverse=True))
_OPEN = r"(?:b|r|u|f|\[\]byte\(|bytes\.fromhex\()?"
_ASSIGN = re.compile(
    rf"(?i)({_NAMES})(?:_?[0-9])?[\"'`]?\]?\s*(?::\s*\w+\s*=|:=|=>|\?\?=|\|\|=|=(?!=)|:)\s*{_OPEN}(\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|[^\s,;)\]}}>]+)"
)
_XML = re.compile(rf"(?i)(?:key|name)=[\"'][\w.\-]*(?:{_NAMES})[\"']\s+value=(\"[^\"\n]*\"|'[^'\n]*')")
_PROSE = re.compile(rf"(?i)(?<!\w)(?:{_NAMES}|key|mot de passe)(?: (?:for|of|to|für|de|pour|para) \S+)? (?:is|was|ist|lautet|es|est|é|:|=) +(\S+)")
_FLAG = re.compile(rf"(?i)(?:--?[\w\-]*(?:{_NAMES}|key)[ =]+|\bsshpass +-p *|\blogin +\S+ +password +|\bidentified +by +|\b(?:curl|wget) [^\n]*?-u +[^\s:]+:)(\"[^\"\n]+\"|'[^'\n]+'|\S+)")
_LOGIN = re.compile(r"(?i)\b(?:log ?in|sign ?in|log on|anmelden|connect|melden sie sich)\b[^\n/]{0,30}? (?:as|with|als|mit) (\S+) ?/ ?(\S+)")
_HEADER = re.compile(r"(?i)\b(basic|bearer|token) +([A-Za-z0-9+/=_.~\-]{8,})")
_CALL = re.compile(r"(?i)\b(?:connect|login|authenticate|setbasicauth|basicauth|auth)\(([^()\n]*)\)")
_QUOTED = re.compile(r"\"([^\"\s\\]{8,})\"|'([^'\s\\]{8,})'|`([^`\s\\]{8,})`")
#: A field or header that is only called a key: its value must be random by itself, as hex or otherwise.
_KEYED = re.compile(r"(?i)(?:(?<![\w.\-])|[_\-])key[\"'`]?\]?\s*(?::=|=(?!=)|:)\s*(?:[\w.\[\]]+\()?(\"[^\"\n]*\"|'[^'\n]*'|[^\s,;)\]}>\"']+)")
_LITERAL = r"(?:\"[^\"\s\\]+\"|'[^'\s\\]+')"
_JOINED = re.compile(rf"(\"\"\.join\(\s*[\[(]\s*|''\.join\(\s*[\[(]\s*)?({_LITERAL}(?:\s*[,+]\s*(?:\\\n\s*)?{_LITERAL})+)(\s*,?\s*\]\s*\.join\(\s*(?:\"\"|'')\s*\))?")
_ONE_LITERAL = re.compile(_LITERAL)
_LONG = re.compile(r"[A-Za-z0-9+/_=~.\-]{12,}")
_USERINFO = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*://|[\"'`(= ])([^\s\"'`:/@]*):([^\s\"'`@/]{4,})\Z")
_SCHEME = re.compile(r"[a-zA-Z0-9+.\-]*\Z")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_PUBLIC = re.compile(r"(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-\S+) +[A-Za-z0-9+/=]+|\bsha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+|\bmd5[-:][0-9a-f]+")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_B64 = re.compile(r"[A-Za-z0-9+/]{8,}={0,2}\Z")
_PLACEHOLDER = re.compile(
    r"(?i)(?:x{4,}|\*{3,}|\.{3,}|-{3,}|_{3,}|#{3,}|\?{3,}|0{6,}|1234567?8?9?0?)\Z|.*(?:replace[_\- ]?me|change[_\- ]?me|your[_\-]|example|placeholder|redacted|dummy|sample|todo|insert[_\-]|<[^>]*>|fill[_\-]?in|not[_\-]?set)"
)
_NOT_VALUE = re.compile(
    r"(?i)(?:[$%]?[{(<\[&*]|\$|%\w+%|@|~?/|\./|\\|env\b|os\.|process\.|vault|secret[s]?[./:]|config[.\[]|settings\.|file:|kv/|arn:|ref[:+]|!\w+ |none\b|null\b|nil\b|true\b|false\b|undefined\b|self\.|this\.|await\b|new\b|function\b|lambda\b|str\b|string\b|bytes\b|len\b|int\b|any\b)"
)
_CALLED = re.compile(r"[A-Za-z_][\w.]*[(\[]")
_DATED = re.compile(r"v?\d+(?:[.\-:/T]\d+)+\w*\Z|\d{4}-\d\d-\d\d")
_WORDY = re.compile(r"[A-Za-z]+(?:[-_./:][A-Za-z]+)*\d{0,3}\Z")
_PEM_BODY = re.compile(r"\s*[A-Za-z0-9+/=]{16,}\s*\Z")
_HEX_LITERAL = re.compile(r"fromhex\(\s*[\"']([0-9a-fA-F]{32,})[\"']")
_NAMED = re.compile(rf"(?i)(?<![A-Za-z])(?:{_NAMES})\b")
#: Words whose absence (in lower case) from a text rules out the contextual patterns.
_CUES = ("pass", "pwd", "kennw", "secret", "token", "key", "credential", "auth", "login", "log in", "sign in", "contrase", "clave", "senha", "mdp", "mot de", "bearer", "basic", "connect(", "identified by", "-u ", "hasło", "haslo", "пароль", "pw")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def classes(s: str) -> int:
    """How many of lower case, upper case, digit and sign occur."""
    low = up = dig = sign = 0
    for c in s:
        if c.islower():
            low = 1
        elif c.isupper():
            up = 1
        elif c.isdigit():
            dig = 1
        else:
            sign = 1
    return low + up + dig + sign


#: Share of the largest entropy that a value needs whose name says that it is a secret; people choose them.
NAMED_SHARE = 0.5


def alphabet(s: str) -> int:
    return 16 if _HEX.match(s) else 62 if s.isalnum() else 94


def named_random(s: str) -> bool:
    """Entropy enough for a value that a name marks as a secret."""
    return entropy(s) >= NAMED_SHARE * math.log2(min(len(s), alphabet(s)))


def threshold(s: str) -> float:
    """Bits per character that a random string of this alphabet and length nearly always reaches: of n draws from A signs, log2 of
    the smaller, less the loss by repeated draws."""
    if _HEX.match(s):
        a, share = 16, 0.80
    elif s.isalnum():
        a, share = 62, 0.84
    elif _B64.match(s) or all(c.isalnum() or c in "-_." for c in s):
        a, share = 64, 0.84
    else:
        a, share = 94, 0.82
    return share * math.log2(min(len(s), a))


def excluded(s: str) -> bool:
    """Hashes, identifiers, versions, dates and placeholders, by form."""
    if _UUID.match(s) or _PLACEHOLDER.match(s) or _DATED.match(s):
        return True
    if _HEX.match(s):
        return True  # a digest unless a name says otherwise; see `live`
    return bool(_WORDY.match(s)) or "://" in s


def decodes(s: str) -> str | None:
    """The text behind base64, if it is printable ASCII with letters and a digit."""
    if len(s) < 12 or len(s) % 4 or not _B64.match(s):
        return None
    try:
        t = base64.b64decode(s, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return t if t.isprintable() and any(c.isdigit() for c in t) and any(c.isalpha() for c in t) else None


def random_like(s: str, quoted: bool) -> bool:
    """By entropy alone. Unquoted tokens must be longer and use three classes."""
    if excluded(s) or not any(c.isdigit() for c in s):
        return False
    k = classes(s)
    if entropy(s) < threshold(s):
        return False
    if quoted:
        return k >= 3 and not (k == 3 and _looks_like_path(s))
    if len(s) < 16 or k < 3 or _looks_like_path(s):
        return False
    return any(c.isupper() for c in s) and any(c.islower() for c in s) and _switches(s) >= len(s) // 5


def _looks_like_path(s: str) -> bool:
    parts = re.split(r"[/.\-_@:=]+", s)
    return len(parts) > 1 and all(p == "" or p.isdigit() or re.fullmatch(r"v?\d*[A-Z]?[a-z]*\d{0,4}|[A-Z]+\d{0,4}|\d+[a-z]{0,2}", p) for p in parts)


def _switches(s: str) -> int:
    """Changes of class from one character to the next."""
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]
    return sum(a != b for a, b in zip(kind, kind[1:]))


def live(value: str, quoted: bool) -> bool:
    """A value assigned to a secret's name: entropy enough, neither empty, nor a placeholder, nor a reference, nor a plain word. A
    quoted passphrase is four or more words in lower case, or words with a digit among them."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or (not quoted and _CALLED.match(value)) or not named_random(value):
        return False
    if _NOT_VALUE.match(value) and (value[0].isalnum() or value[-1] in "})]>" or not random_like(value, True)):
        return False
    if " " in value.strip():
        words = value.split()
        return quoted and (len(words) >= 4 and all(re.fullmatch(r"[a-z]{3,}\d*", w) for w in words) or any(re.fullmatch(r"(?=.*\d)(?=.*[A-Za-z])(?=.*[^\w\s])\S{6,}", w) for w in words))
    if any(c.isdigit() for c in value):
        if value.isdigit():
            return quoted and len(value) >= 8
        if re.fullmatch(r"v?\d+(?:\.\d+)+|\d+(?:ms|s|m|h|d|px|kb|mb|gb)", value, re.I):
            return False
        return any(c.isalpha() for c in value)
    body = re.sub(r"[A-Za-z]+", "", value)
    if re.fullmatch(r"[a-z]+(?:[-_.:/][a-z]+)*|[A-Z]+(?:[-_.:/][A-Z]+)*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*", value):
        return False
    return len(value) >= 8 and (bool(body.strip("-_.:/ ,;")) or _switches(value) >= len(value) // 2) and classes(value) >= 2


def _unquote(v: str, at: int) -> tuple[str, int, bool]:
    if v[:1] in "\"'`" and len(v) >= 2 and v[-1] == v[0]:
        return v[1:-1], at + 1, True
    q = v[:1] in "\"'`"
    if q and (end := v.find(v[0], 1)) > 0:
        return v[1:end], at + 1, True
    return v.strip("\"'`"), at + q, q


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every live credential, in order, without overlaps."""
    out: list[tuple[int, int, str]] = []
    shut: list[tuple[int, int]] = []  # stretches where nothing is looked for
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            stop = _PEM_END.search(text, m.end())
            nxt = _PEM.search(text, m.end())
            if stop and (nxt is None or stop.start() < nxt.start()):
                e = stop.end()
            else:  # cut off: the lines of base64 that follow
                e = m.end()
                while (nl := text.find("\n", e)) >= 0:
                    nl2 = text.find("\n", nl + 1)
                    line = text[nl + 1 : nl2 if nl2 >= 0 else len(text)]
                    if not _PEM_BODY.match(line):
                        break
                    e = nl + 1 + len(line)
            shut.append((m.start(), e))
            if "PRIVATE" in m[1]:
                out.append((m.start(), e, "private_key"))
    if "ssh-" in text or "sha" in text or "md5" in text or "ecdsa" in text:
        shut += [m.span() for m in _PUBLIC.finditer(text)]

    def add(a: int, e: int, kind: str) -> None:
        if e > a and not any(s <= a < t for s, t in shut):
            out.append((a, e, kind))

    at = text.find("@")
    while at >= 0:  # user:password@host
        left = text.rfind("\n", 0, at) + 1
        run = max(text.rfind(c, left, at) for c in "\"'`@/ \t")  # the sign before user:password
        left = max(left, run - 2)
        if text.startswith("://", left):
            left -= len(_SCHEME.search(text[max(0, left - 40) : left])[0])
        m = _USERINFO.search(text[left:at])
        if m and live(m[2], True) and (text.startswith("tcp(", at + 1) or re.match(r"[\w\-]+(?:\.[\w\-]+)*|\[", text[at + 1 : at + 60])):
            add(left + m.start(2), left + m.end(2), "url_password")
        at = text.find("@", at + 1)

    at = text.find("fromhex(")
    while at >= 0:  # a hex literal is a digest unless the rest of its line names a secret
        a, e = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        e = e if e >= 0 else len(text)
        m = _HEX_LITERAL.match(text, at, e)
        if m and (_NAMED.search(text, a, at) or _NAMED.search(text, m.end(), e)):
            add(m.start(1), m.end(1), "encoded")
        at = text.find("fromhex(", at + 1)
    for a, e in _cued(text):
        _contextual(text[a:e], a, add)
    if "+" in text or ".join(" in text:
        for m in _JOINED.finditer(text):
            pieces = list(_ONE_LITERAL.finditer(m[2]))
            between = "".join(m[2][p.end() : q.start()] for p, q in zip(pieces, pieces[1:]))
            if "," in between and not m[1] and not m[3]:
                continue  # a plain list
            if random_like("".join(p[0][1:-1] for p in pieces), True):
                for n, p in enumerate(pieces):
                    add(m.start(2) + p.start() + 1, m.start(2) + p.end() - 1, "part" if n else "quoted")

    for m in _QUOTED.finditer(text):
        v = m[1] or m[2] or m[3]
        if not v.isalpha() and (random_like(v, True) or re.match(ISSUED + r"[A-Za-z0-9_\-]{12,}", v)):
            add(m.start() + 1, m.end() - 1, "quoted")
    for m in _LONG.finditer(text):
        v = m[0]
        if v.isalpha() or v.isdigit() or v.islower() or v.isupper() and v[:4] not in ("AKIA", "ASIA"):
            continue
        v = v.rstrip(".-")
        if "=" in v.rstrip("="):  # NAME=value
            head, _, tail = v.partition("=")
            base, v = m.start() + len(head) + 1, tail
        else:
            base = m.start()
        if v and (random_like(v, False) or re.match(ISSUED + r"[A-Za-z0-9_\-]{12,}", v)):
            add(base, base + len(v), "token")
        elif v and decodes(v) and not excluded(v):
            add(base, base + len(v), "encoded")
    return _settle(text, out)


#: What could be a value: letters with digits, letters that change case or meet signs, or a quoted passphrase.
_COULD_BE = re.compile(r"[A-Za-z][!-~]*?\d|\d[!-~]*?[A-Za-z]|[a-z][A-Z!?*#+%^&$]|[!?*#+%^&$][A-Za-z]|[\"'`][a-z]{3,}(?: [a-z]{3,}){3,}[\"'`]")


def _cued(text: str) -> list[tuple[int, int]]:
    """Lines with a cue word that is followed by something that could be a value, each once."""
    low = text.lower()
    if len(low) != len(text):  # lower-casing moved offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: set[tuple[int, int]] = set()
    for cue in _CUES:
        p = low.find(cue)
        while p >= 0:
            e = text.find("\n", p)
            e = e if e >= 0 else len(text)
            if _COULD_BE.search(text, p + len(cue), e):
                spans.add((text.rfind("\n", 0, p) + 1, e))
                p = e
            p = low.find(cue, p + len(cue))
    return sorted(spans)


def _contextual(line: str, at: int, add) -> None:
    for m in _ASSIGN.finditer(line):
        v, s, q = _unquote(m[2], m.start(2))
        if live(v, q):
            add(at + s, at + s + len(v), "named")
    for rx in (_XML, _FLAG):
        for m in rx.finditer(line):
            v, s, q = _unquote(m[1], m.start(1))
            v = v.rstrip("\\\",;)]}") if not q else v
            if live(v, q) and (rx is _XML or any(c.isdigit() for c in v)):
                add(at + s, at + s + len(v), "named")
    for m in _KEYED.finditer(line):
        v, s, q = _unquote(m[1], m.start(1))
        if any(c.isdigit() for c in v) and entropy(v) >= threshold(v) and (len(v) >= 32 and _HEX.match(v) or len(v) >= 16 and classes(v) >= 3 and not excluded(v)) and not _PLACEHOLDER.match(v):
            add(at + s, at + s + len(v), "named")
    for m in _PROSE.finditer(line):
        v, p, _ = _unquote(m[1].rstrip(".,;:!?)"), m.start(1))
        if live(v, False) and any(c.isdigit() for c in v) and (re.fullmatch(r"[A-Za-z]{4,}\d{2,6}", v) or not excluded(v)):
            add(at + p, at + p + len(v), "named")
    for m in _LOGIN.finditer(line):
        v = m[2].rstrip(".,;:)")
        if live(v, False) and any(c.isdigit() for c in v):
            add(at + m.start(2), at + m.start(2) + len(v), "named")
    for m in _HEADER.finditer(line):
        v = m[2]
        if m[1].lower() == "basic" and decodes(v) or m[1].lower() != "basic" and any(c.isdigit() for c in v) and entropy(v) >= threshold(v) and not _PLACEHOLDER.match(v) and classes(v) >= 2 and len(v) >= 16:
            add(at + m.start(2), at + m.end(2), "header")
    for m in _CALL.finditer(line):
        args = list(re.finditer(r"\"([^\"\n]*)\"|'([^'\n]*)'", m[1]))
        if len(args) >= 2:
            v = args[-1][1] or args[-1][2] or ""
            if live(v, True) and not excluded(v) or re.fullmatch(r"[A-Za-z]{3,}\d{2,6}", v):
                add(at + m.start(1) + args[-1].start() + 1, at + m.start(1) + args[-1].end() - 1, "argument")


_GLUE = re.compile(r"[\"'`]\s*(?:[,+.&]|\\\n|\.\.)?\s*[\"'`]\Z")


def _settle(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Sort, drop overlaps, and take literals that are only glued together as parts of one value, kept as one span each with the first's kind."""
    out: list[tuple[int, int, str]] = []
    for a, e, k in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            continue
        if out and k in ("quoted", "named", "part") and a - out[-1][1] < 80 and _GLUE.fullmatch(text[out[-1][1] : a]):
            k = "part"
        out.append((a, e, k))
    return out


def lines_of(text: str) -> list[int]:
    """Line numbers, from 1, on which a value starts."""
    out: list[int] = []
    line, seen = 1, 0
    for a, _, k in find(text):
        line += text.count("\n", seen, a)
        seen = a
        if k != "part" and (not out or out[-1] != line):
            out.append(line)
    return out


def redact(text: str) -> str:
    """The text with every value blanked; quotes, separators, BEGIN and END lines and the number of lines stay."""
    parts, seen = [], 0
    for a, e, k in find(text):
        parts.append(text[seen:a])
        v = text[a:e]
        if k == "private_key":
            head, tail = _PEM.match(v), None
            for tail in _PEM_END.finditer(v):
                pass
            stop = tail.start() if tail else len(v)
            body = re.sub(r"(\\n|\s+|\\r)|[^\s\\]+", lambda m: m[1] or "REDACTED", v[head.end() : stop])
            parts.append(v[: head.end()] + body + v[stop:])
        else:
            parts.append("REDACTED")
        seen = e
    parts.append(text[seen:])
    return "".join(parts)


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, n) for i, t in zip(b["id"], b["content"]) if t for n in lines_of(t)]
        yield pd.DataFrame(rows, columns=["source_id", "line_no"])


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"source_id": b["id"], "content": [redact(t) if t else t for t in b["content"]]})


def find_secrets(sources: DataFrame) -> DataFrame:
    """(source_id, line_no) of sources(id, content)."""
    return sources.select("id", "content").where("content is not null").mapInPandas(_found, "source_id string, line_no long")


def redact_secrets(sources: DataFrame) -> DataFrame:
    """(source_id, content) with credentials blanked."""
    return sources.select("id", "content").mapInPandas(_redacted, "source_id string, content string")
