"""Text garbled by a wrong encoding: found, and restored where nothing was lost.

1. Near-twins: pieces of text (words, and for scripts without ASCII letters runs of words) are keyed by what is left when non-ASCII
   characters are stripped, together with the lengths of what was stripped where little is left. Every form is joined with all forms
   that a change of encoding predicts for it; ASCII stays as it is under each of them, so these have its key.
2. Transformations: the twins are aligned at the ASCII they share, giving pairs (garbled run, clean run). A pair votes for every
   change of encoding (written in A, read as B) that turns the clean run into the garbled one. Which of two is the garbled one is told
   by the change: text written as UTF-8 has bytes that fit, of code pages the detector must turn the one into the other; where it
   can't tell, the rarer one is taken as garbled. Changes with enough different pairs
   are learned; their number is bounded by the list of encodings.
3. The learned changes are applied to all records: stretches that a change explains, and that cannot be text as they stand, are
   found and turned back, again and again for text garbled more than once.

Defined cases: null text is left out; empty text is clean; U+FFFD marks a stretch whose content is lost, so it is found and left as
it is; a repeated row is found once; ties between changes go to the one with more votes, then by name. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillspark.session import spread, write_shared

#: Encodings that text is commonly written in or read as.
ENCODINGS = ("cp1250", "cp1251", "cp1252", "cp1253", "cp437", "cp850", "cp852", "cp866", "iso8859-2", "iso8859-5", "iso8859-7", "koi8-r", "latin-1", "mac-roman", "utf-8")
#: A change is learned from at least so many different aligned pairs.
MIN_PAIRS = 2

_NON = re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"\d+")
_STRANGE = re.compile(r"[^\x00-\x7f]")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_PHRASE = re.compile(r"[^\x00-\x7f]{2,}[,;:]?(?: [^\x00-\x7f]+[,;:]?){2,4}")


def _encode(text: str, enc: str) -> bytes:
    """Bytes of the text; for code pages with holes, C1 controls stand for the holes' bytes, as lenient readers do."""
    if enc == "cp1252" or enc.startswith("cp125"):
        out = bytearray()
        for c in text:
            try:
                out += c.encode(enc)
            except UnicodeEncodeError:
                if 0x80 <= ord(c) <= 0x9F:
                    out.append(ord(c))
                else:
                    raise
        return bytes(out)
    return text.encode(enc)


def _decode(data: bytes, enc: str) -> str:
    if enc.startswith("cp125"):
        try:
            return data.decode(enc)
        except UnicodeDecodeError:
            return "".join(_one(b, enc) for b in data)
    return data.decode(enc)


@lru_cache(maxsize=None)
def _one(b: int, enc: str) -> str:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)


def garble(text: str, written: str, read: str) -> str | None:
    try:
        return _decode(_encode(text, written), read)
    except UnicodeError:
        return None


def restore(text: str, written: str, read: str) -> str | None:
    return garble(text, read, written)


CHANGES = tuple((w, r) for w in ENCODINGS for r in ENCODINGS if w != r and r != "utf-8")


# ---- 1. forms and their keys ------------------------------------------------------------------------------------------------


def keyed_forms(text: str) -> set[tuple[str, str]]:
    """(key, form) of the words and phrases that hold non-ASCII characters."""
    out = set()
    for w in text.split():
        if w.isascii():
            continue
        bare = _DIGITS.sub("9", _NON.sub("", w))
        if any(c.isalnum() for c in bare):
            out.add((bare, _DIGITS.sub("9", w)))
    for m in _PHRASE.finditer(text):
        p = m[0]
        chars = ".".join(str(len(x)) for x in p.split(" "))
        out.add(("#" + chars, p))
        octets = ".".join(str(len(x.encode("utf-8", "surrogatepass"))) for x in p.split(" "))
        out.add(("#" + octets, p))
    return out


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        count: dict[tuple[str, str], int] = {}
        for t in b["text"]:
            if t and not t.isascii():
                for kf in keyed_forms(t):
                    count[kf] = count.get(kf, 0) + 1
        yield pd.DataFrame([(k, f, n) for (k, f), n in count.items()], columns=["key", "form", "n"])


# ---- 2. alignment and votes -------------------------------------------------------------------------------------------------


def align(form: str, twin: str) -> list[tuple[str, str]]:
    """(run of form, run of twin) between equal ASCII; empty if the ASCII differs."""
    if form.isascii() or twin.isascii() or _NON.sub("", form) != _NON.sub("", twin):
        return []

    def runs(s: str) -> dict[int, str]:
        out, cut = {}, 0
        for m in _NON.finditer(s):
            out[m.start() - cut] = m[0]
            cut += len(m[0])
        return out

    a, b = runs(form), runs(twin)
    return [(x, b[p]) for p, x in a.items() if p in b and b[p] != x]


@lru_cache(maxsize=50_000)
def explain(x: str, y: str) -> tuple[str, ...]:
    """Changes, as 'written>read', that turn the clean y into x."""
    return tuple(f"{w}>{r}" for w, r in CHANGES if garble(y, w, r) == x)


def agreed(form: str, twin: str) -> tuple[list[tuple[str, str]], set[str]]:
    """Aligned pairs, and the changes that explain every one of them and leave no other sign as it was."""
    pairs = align(form, twin)
    if not pairs or len(pairs) != len(_NON.findall(twin)):
        return [], set()
    common = set(explain(*pairs[0]))
    for x, y in pairs[1:]:
        common &= set(explain(x, y))
    return pairs, common


def predicted(twin: str) -> set[str]:
    """All that changes of encoding make of a form and that could be a form: those that leave it or lose signs to ASCII are not."""
    out: set[str] = set()
    for w in ENCODINGS:
        try:
            data = _encode(twin, w)
        except UnicodeError:
            continue
        for r in ENCODINGS:
            if r not in (w, "utf-8"):
                try:
                    out.add(_decode(data, r))
                except UnicodeError:
                    pass
    out.discard(twin)
    return {x for x in out if not x.isascii()}


def _predictions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(x, t, m) for t, m in zip(b["form"], b["n"]) for x in predicted(t)], columns=["form", "twin", "m"])


def directed(form: str, twin: str, change: str) -> bool:
    """Whether the change itself tells that the form is the garbled one of the two."""
    w, r = change.split(">")
    return w == "utf-8" or _changes(((w, r),))[0].fix(form)[0] == twin


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = {}
        for form, twin, n, m in zip(b["form"], b["twin"], b["n"], b["m"]):
            pairs, common = agreed(form, twin)
            for t in common:
                if not directed(form, twin, t) and (n >= m or directed(twin, form, ">".join(t.split(">")[::-1]))):
                    continue
                for x, y in pairs:
                    rows[(t, x, y)] = None
        yield pd.DataFrame(list(rows), columns=["change", "x", "y"])


def learn(docs: DataFrame, min_pairs: int = MIN_PAIRS) -> list[tuple[str, str]]:
    """Changes of encoding seen in docs(text), most voted first. What comes to the driver is bounded by the number of changes."""
    forms = docs.select("text").where("text is not null").mapInPandas(_forms, "key string, form string, n long").groupBy("key", "form").agg(F.sum("n").alias("n"))
    forms = write_shared(forms.groupBy("form").agg(F.max("n").alias("n")), "p9-forms")
    twins = spread(forms).mapInPandas(_predictions, "form string, twin string, m long")
    pairs = forms.join(twins, "form").mapInPandas(_votes, "change string, x string, y string").distinct()
    # two code pages may explain the same pairs: a change must have pairs of its own or more than any rival of its reading
    rows = pairs.groupBy("change").agg(F.count("*").alias("pairs"), F.sum(F.length("y")).alias("signs")).where(F.col("pairs") >= min_pairs).collect()
    return [tuple(r["change"].split(">")) for r in sorted(rows, key=lambda r: (-r["pairs"], -r["signs"], r["change"]))]


# ---- 3. application -----------------------------------------------------------------------------------------------------------

_CYRILLIC, _GREEK = frozenset(("cp1251", "koi8-r", "cp866", "iso8859-5")), frozenset(("cp1253", "iso8859-7"))
#: Letters of the scripts whose code pages have no Latin letters but the ASCII ones, and their vowels.
_SCRIPTS = {
    "cyrillic": (frozenset(map(chr, [*range(0x410, 0x450), 0x401, 0x451])), frozenset("аеёиоуыэюяАЕЁИОУЫЭЮЯ")),
    "greek": (frozenset("ΐΰ" + "".join(map(chr, [*range(0x386, 0x38B), 0x38C, 0x38E, 0x38F, *range(0x391, 0x3A2), *range(0x3A3, 0x3CF)]))), frozenset("αεηιουωάέήίόύώϊϋΐΰΑΕΗΙΟΥΩΆΈΉΊΌΎΏ")),
}
_LATIN = "A-Za-zÀ-ÖØ-öø-ſȘ-ț"


class Change:
    """One learned change with its detector."""

    def __init__(self, written: str, read: str) -> None:
        self.written, self.read = written, read
        self.wide = written == "utf-8"
        back = {_one_or_none(b, read): b for b in range(0x80, 0x100)}
        back.pop(None, None)
        chars = {b: c for c, b in back.items()}
        esc = lambda bs: re.escape("".join(chars[b] for b in bs if b in chars))
        if self.wide:
            tail = f"[{esc(range(0x80, 0xC0))}]"
            unit = f"[{esc(range(0xC2, 0xE0))}]{tail}|[{esc(range(0xE0, 0xF0))}]{tail}{{2}}|[{esc(range(0xF0, 0xF5))}]{tail}{{3}}"
            self.rx, self.row = re.compile(unit), re.compile(f"(?:{unit}){{2,}}")
            self.first = frozenset(chars[b] for b in range(0xC2, 0xF5) if b in chars)
        else:
            self.rx = None
            self.first = frozenset(chars.values())
            self.script = "cyrillic" if written in _CYRILLIC else "greek" if written in _GREEK else None
            self.cyr = self.script is not None  # such a page is told by whole words
            self.from_cyr = read in _CYRILLIC

    # -- text written as UTF-8
    def _fix_wide(self, text: str) -> tuple[str, int]:
        hits = 0
        if not self.rx.search(text):
            return text, 0
        # letters of other scripts count in lines where they come in a row, since one alone may be a letter before a sign
        rows = set()
        for m in self.row.finditer(text):
            if (y := restore(m[0], self.written, self.read)) and sum(map(_other_script, y)) >= 2:
                rows.add(text.rfind("\n", 0, m.start()))

        def sub(m: re.Match) -> str:
            nonlocal hits
            y = restore(m[0], self.written, self.read)
            if y is None or len(y) != 1 or not (_plausible(y) or _other_script(y) and rows and text.rfind("\n", 0, m.start()) in rows):
                return m[0]
            if self.read in ("cp1251", "koi8-r", "cp866", "iso8859-5") and _russian_as_is(text, m.start(), m.end(), y):
                return m[0]
            hits += 1
            return y

        return self.rx.sub(sub, text), hits

    # -- text written in a code page
    def _fix_narrow(self, text: str) -> tuple[str, int]:
        lines = [(m, self._impossible(m[0])) for m in _LINES.finditer(text) if not m[0].isascii()]
        if not any(n for _, n in lines):
            return text, 0
        hits = 0
        out, seen = [], 0
        for m, n in lines:
            line = m[0]
            fixed = _ANY_WORD.sub(lambda w: self._word(w[0]) if n else self._signs(w[0]), line)
            if fixed != line:
                hits += n
                out += [text[seen : m.start()], fixed]
                seen = m.end()
        return ("".join(out) + text[seen:], hits) if hits else (text, 0)

    def _word(self, w: str) -> str:
        if w.isascii():
            return w
        y = restore(w, self.written, self.read)
        if y is None:
            return w
        if self.cyr:
            letters = _SCRIPTS[self.script][0]
            return y if any(c in letters for c in y) and all(c in letters or c in _TYPE or c in _PLAIN or ord(c) < 128 for c in y) else self._signs(w)
        return y if all(c.isalpha() or ord(c) < 128 or c in _TYPE for c in y) else w

    def _signs(self, w: str) -> str:
        """Beside garbled lines: a word of signs only, none of them usual, that turns into usual signs."""
        if w.isascii() or all(c in _PLAIN for c in w if ord(c) > 127):
            return w
        y = restore(w, self.written, self.read)
        return y if y and all(c in _PLAIN or ord(c) < 128 for c in y) else w

    def _impossible(self, line: str) -> int:
        """How many signs stand where text has none and are explained by the change."""
        n = 0
        if self.cyr:
            for m in (_SWAPPED if self.from_cyr else _ACCENTED).finditer(line):
                y = restore(m[0], self.written, self.read)
                letters, vowels = _SCRIPTS[self.script]
                if y and all(c in letters for c in y) and _cased(y) and (len(y) < 4 or not vowels.isdisjoint(y)) and (self.script != "greek" or y[-1] in vowels or y[-1] in "ςνΣΝ"):
                    n += len(m[0])
            return n if n >= 4 else 0
        for m in _INNER.finditer(line):
            y = restore(m[0], self.written, self.read)
            if y and y.isalpha() and y != m[0] and _cased(y) and all(c in _LETTERS or ord(c) < 128 for c in y):
                n += 1
        return n

    def fix(self, text: str) -> tuple[str, int]:
        return self._fix_wide(text) if self.wide else self._fix_narrow(text)


def _one_or_none(b: int, enc: str) -> str | None:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b) if enc.startswith("cp125") else None


_LINES = re.compile(r"[^\n]+")
_ANY_WORD = re.compile(r"\S+")
#: Letters of the Latin-script languages that such code pages hold.
_LETTERS = frozenset("ĄąĆćĘęŁłŃńÓóŚśŹźŻżČčĎďĚěŇňŘřŠšŤťŮůÝýŽžÁáÉéÍíÚúĂăÂâÎîȘșȚțŞşŢţŐőŰűÖöÜüÄäßĽľĹĺŔŕÔôÀàÈèÊêËëÏïÇçÙùÛûŒœÑñÃãÕõÅåÆæØøÌìÒò")
_TYPE = frozenset("–—‘’“”„…«»°©®™§·•€£±×½→≤−µ")
_PLAIN = frozenset("¤¡¿ºª¢¥¬¦¨¯´¸¶¹²³¼¾÷‚‹›†‡‰ƒˆ˜−≤≥≠→←↑↓↔⇒■□●○✓✔│─├└┌┐┘┤┬┴┼║═╔╗╚╝╠╣╦╩╬▒░▓█ ­") | _TYPE
#: Three or more accented letters of one Latin word with nothing plain between them.
_ACCENTED = re.compile(r"(?<![A-Za-z])[À-ÖØ-öø-ÿ¸¨]{3,}(?![A-Za-z])")
#: Cyrillic words in the wrong case, as one Cyrillic code page looks in another.
_SWAPPED = re.compile(r"(?<![А-Яа-яЁё])[а-яё][А-ЯЁ]{2,}(?![а-яё])|(?<![А-Яа-яЁё])[А-ЯЁ]{3,}(?![а-яё])")
#: What tells such words from words in capitals.
_MIXED = re.compile(r"(?<![А-Яа-яЁё])[а-яё][А-ЯЁ]{2,}(?![а-яё])")
#: A word with a sign that is no letter between letters, or before letters where no sign stands before a word.
_INNER = re.compile(rf"(?<!\w)[{_LATIN}¹²³¼½¾±¶]*[{_LATIN}¹²³¼½¾±¶](?:[¡-©«-´¶-¹»-¿×÷‚„…†‡‰‹›€™•˜√∂∞∫≈◊Ωπ≠≤≥∏∑░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐▀αΓσΣτΦΘδφε∩≡±⌠⌡°∙·ⁿ²■]+[{_LATIN}])+[{_LATIN}]*|(?<!\w)[A-Za-zÀ-ÿ]*[a-z]{{2}}[³¹](?!\w)|(?<!\w)[A-Za-zÀ-ÿ]*[a-zß-ÿ][ÀÈÌÒÙŸŒŠŽ][a-zß-ÿ]+")


#: Signs and letters that ordinary text holds; only with others, or in odd places, is a word looked at for code pages.
_USUAL = frozenset("±£×§°½→≤€™…“”‘’–—©├─└│«»•·−àáâãäçèéêëíïîñóôõöùúûüßœæÀÁÂÃÄÇÈÉÊËÍÎÏÑÓÔÕÖÙÚÛÜŒąćęłńóśźżĄĆĘŁŃÓŚŹŻ¿¡ºªµ") | frozenset(map(chr, range(0x410, 0x450))) | frozenset("Ёё")
_ODD = re.compile(r"[a-zß-ÿ][ÀÈÌÒÙŒ±¿¡£×§°½©«»][a-zß-ÿ]")


def _plausible(c: str) -> bool:
    """A character that text of Latin and Cyrillic scripts and typography holds."""
    o = ord(c)
    if 0x80 <= o <= 0x9F or 0xC0 <= o <= 0x17F or 0x400 <= o <= 0x45F or 0x218 <= o <= 0x21B:
        return True
    return c in _PLAIN or 0x2010 <= o <= 0x203A or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x22FF or 0x2500 <= o <= 0x27BF or 0x1F300 <= o <= 0x1FAFF or o == 0xFEFF


def _russian_as_is(text: str, a: int, e: int, y: str) -> bool:
    """A Cyrillic pair that stands in an ordinary Cyrillic word, such as a capital before a small letter."""
    pair = text[a:e]
    return all("А" <= c <= "я" or c in "Ёё" for c in pair) and not ("Ѐ" <= y <= "џ")


def _cased(y: str) -> bool:
    body = y[1:]
    return body == body.lower() or y == y.upper()


def _other_script(c: str) -> bool:
    """Greek, Armenian, Hebrew, Arabic, Georgian, Japanese, Chinese or Korean."""
    o = ord(c)
    return 0x370 <= o <= 0x3FF or 0x530 <= o <= 0x6FF or 0x10A0 <= o <= 0x10FF or 0x1F00 <= o <= 0x1FFF or 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF


@lru_cache(maxsize=256)
def _changes(learned: tuple[tuple[str, str], ...]) -> tuple[Change, ...]:
    # text written as UTF-8 first: its stretches are exact, those of code pages are judged by form
    return tuple(sorted((Change(w, r) for w, r in learned), key=lambda c: not c.wide))


def repair(text: str, learned: tuple[tuple[str, str], ...]) -> tuple[str, bool, bool]:
    """(text as first written, garbled?, something lost?). Rounds go on while a change still explains stretches, for text garbled twice."""
    if not text or text.isascii():
        return text, False, False
    seen = {text}
    found = lost = "\ufffd" in text
    while True:  # until nothing is explained any more, or a text comes back
        present = set(_STRANGE.findall(text))
        runs = " ".join(_RUNS.findall(text))  # text written as UTF-8 has at least two such signs in a row
        best: tuple[int, str] | None = None
        cyr = _ACCENTED.search(text)
        swapped = any("А" <= c <= "я" for c in present) and _MIXED.search(text)
        for first in (True, False):  # Latin code pages are judged by single signs, so only where no longer stretch is left
            latin = not first and (not present <= _USUAL or _ODD.search(text)) and _INNER.search(text)
            for c in _changes(learned):
                if c.first.isdisjoint(present) or not (first and (c.wide or c.cyr and (swapped if c.from_cyr else cyr)) or latin and not c.wide and not c.cyr):
                    continue
                if c.wide and not c.rx.search(runs):
                    continue
                fixed, hits = c.fix(text)
                if hits and (best is None or hits > best[0]):
                    best = (hits, fixed)
            if best is not None:
                break
        if best is None or best[1] in seen:
            break
        text, found = best[1], True
        seen.add(text)
        if text.isascii():
            break
    return text, found, lost


def _applied(learned: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                if t and not t.isascii():
                    fixed, found, lost = repair(t, learned)
                    if found:
                        rows.append((d, fixed, lost))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "lost"])

    return run


def repair_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lost) of the garbled documents of docs(doc_id, text), with the text restored; `lost` where U+FFFD remains."""
    learned = tuple(learn(docs))
    return docs.select("doc_id", "text").where("text is not null").mapInPandas(_applied(learned), "doc_id long, text string, lost boolean").dropDuplicates(["doc_id"])
