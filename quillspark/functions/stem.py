"""Suffix stripping for English after the published Porter algorithm, applied to a vocabulary rather than to every token."""

from __future__ import annotations

import re
from functools import lru_cache

#: Suffix tables of the published algorithm, steps 2 to 4.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _form(stem: str) -> str:
    """The stem as a string of c and v."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Words of up to two letters, and words that aren't all ASCII letters, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _form(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _form(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _cvc(w):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz" and _form(w)[-1] == "c":
            w = w[:-1]
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, [*STEP4, "ion"])
    if s:
        head = w[: -len(s)]
        if _measure(head) > 1 and (s != "ion" or head[-1:] in ("s", "t")):
            w = head
    if w.endswith("e"):
        head = w[:-1]
        if _measure(head) > 1 or _measure(head) == 1 and not _cvc(head):
            w = head
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
