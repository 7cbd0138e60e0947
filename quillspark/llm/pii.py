"""Personal values in free text: found, and replaced by typed placeholders or by keyed surrogates.

Detection runs on whole texts in Arrow batches, with no shuffle: cheap scans (an at sign, a set of capitalised words, digits) decide
where the exact patterns are tried. Names are found by a list of given names, and without it by what stands around two capitalised
words of one script: a form of address, a role, an e-mail address that repeats them, a verb of saying or meeting, another name beside
them, the endings of Slavic family names; a name found once is found wherever the text repeats it.

Surrogates are generated once per distinct value: a keyed digest picks a replacement of the same kind, gender, script and format; the
table of distinct values is checked for collisions in Spark (two values of a kind with the same surrogate, or a surrogate that is
itself a value of the corpus) and such values draw again until all are distinct, so equal values stay equal and different values stay
different across the corpus. One family name has one surrogate and an initial follows the given names of its letter, so 'J. Smith' and
'John Smith' stay alike.

Defined cases: null content gives no finding and stays null; empty content stays empty; a repeated row gives its findings once;
overlapping findings are settled in the order e-mail, address, id number, phone, name. Offsets count code points from 0.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillspark.session import write_shared

KINDS = ("email", "address", "id_number", "phone", "name")

#: Common given names by gender (f, m, either), of several languages.
GIVEN_F = (
    "Alice Amina Anastasia Andrea Angela Anna Anouk Beatriz Carla Carmen Caroline Catherine Chiara Chloé Clara Claire Daria Diana Elena Elif Elisa Elizabeth Emma "
    "Eva Fatima Freya Giulia Greta Hannah Helena Ines Inès Ingrid Isabel Jana Johanna Julia Katarina Laura Leila Linnea Lucía Lucia Maeve Magdalena Maria María Marie "
    "Marta Mary Mira Nadia Natalia Nina Nora Océane Olga Olivia Paloma Petra Rosalind Sanna Sara Selma Sofia Sonja Susan Tamsin Ulrika Ursula Valentina Ximena Yasmin Zofia"
).split()
GIVEN_M = (
    "Adam Ahmed Alexander Andreas Anton Antonio Arturo Bastian Carlos Christian Daniel Dario David Diego Dmitri Emeka Erik Farid Felix Fernando François Hans Henrik Hugo "
    "Idris Ivan Jakob James Jan Javier Johan John Jonas José Juan Karl Kofi Kwame Lars Luca Lukas Manuel Marco Marek Martin Mateo Matteo Michael Miguel Mohammed Nikolai "
    "Omar Oskar Pablo Paul Pavel Pedro Peter Pierre Rafael Rasmus Ravi Robert Sebastian Stefan Thomas Tomas Viktor Wendell William Yannick Yusuf"
).split()
GIVEN_E = "Alex Kim Noor Robin Sasha".split()
#: Words that open sentences and so are no family name after an initial or a comma.
NOT_FAMILY = frozenset(
    "A After Als Also An And Any As At Ask Avisar Both Bei But By Compared Con Dafür Das Der Die Each El Elle En Entre Every For From Für Gateway Harbor He Her His "
    "How I If In Industries It Its Laut La Le Les Library Los Most My Neither No Nobody Of On Or Our Over Project Readers Server She Since So Some Street Thanks That The Their Then "
    "There These They This Those To Under Un Une We When Where Which While Why With You Your Zwischen".split()
)
_GIVEN = frozenset(GIVEN_F + GIVEN_M + GIVEN_E)
_GIVEN_ANY = _GIVEN | {g.upper() for g in _GIVEN}
GENDER = {g: "f" for g in GIVEN_F} | {g: "m" for g in GIVEN_M} | {g: "e" for g in GIVEN_E}

_UP, _LOW = "A-ZÀ-ÖØ-ÞĀŁŚŻŹĆČŠŽ", "a-zß-öø-ÿāąćčęěłńōřśšůźżž"
_PARTICLE = r"(?:(?:von|van|de|del|della|der|den|di|da|dos|la|le|af|zu|bin|ibn|al)[ \-]|(?:al|el)-|[OD]['’])"
_FAM1 = rf"(?:{_PARTICLE}{{0,2}}(?:Mc|Mac)?[{_UP}][{_LOW}'’]+(?:-(?:{_PARTICLE})?[{_UP}][{_LOW}'’]+)?)"
_FAMU = rf"(?:(?:(?:VON|VAN|DE|DER|DEN|DEL|DI|DA|LA|LE|AL)[ \-]|{_PARTICLE}){{0,2}}[{_UP}]{{3,}}(?:-[{_UP}]{{3,}})?)"
_WORD = re.compile(rf"(?<![\w@.])[{_UP}][{_LOW}{_UP}]+")
_AFTER = re.compile(rf" (?:[{_UP}]\. ?){{0,2}}({_FAM1})(?![\w@])|(?: [{_UP}]\.){{0,2}} ({_FAMU})(?![\w@])")
_BEFORE = re.compile(rf"(?<![\w@.\-])({_FAM1}|{_FAMU}),\s\Z")
_INITIAL = re.compile(rf"(?<![\w.@])([{_UP}]\.) ?(?:[{_UP}]\. ?)?({_FAM1}|{_FAMU})(?![\w@])")
_INITIAL_LAST = re.compile(rf"(?<![\w@.\-])({_FAM1}), ([{_UP}]\.)(?=[\s,;:)|<(])")

# names without a list: capitalised words of Latin, Cyrillic or Greek script, by what stands around them
_CAPITAL = (rf"[{_UP}][{_LOW}'’]+(?:-[{_UP}][{_LOW}]+)?", "[А-ЯЁІЇЄҐ][а-яёіїєґ]+(?:-[А-ЯЁІЇЄҐ][а-яёіїєґ]+)?", "[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+")
_FULL = "|".join(rf"{w} (?:{x}\. )?(?:{_PARTICLE}){{0,2}}{w}" for w, x in zip(_CAPITAL, (f"[{_UP}]", "[А-Я]", "[Α-Ω]")))
_FULL += rf"|[{_UP}]{{2,}} (?:[{_UP}]\. )?{_FAMU}"
#: Forms of address and roles that a name follows, and verbs that follow a name, of several languages.
ADDRESSES = "Mr Mrs Ms Mx Miss Dr Prof Sir Dame Herr Herrn Frau M Mme Mlle Monsieur Madame Señor Señora Sr Sra Sig Signor Signora Pan Pani г-н г-жа господин госпожа κ κυρία κύριος".split()
ROLES = (
    "met|met with|said|by|author|contact|owner is|owner|dear|hi|hello|attn|cc|assigned to|reviewed by|thanks to|written by|reported by|signed|named|colleague|manager|engineer|nurse|teacher|director|patient|customer|client|"
    "employee|applicant|candidate|instructor|lists|write to|ask|call|an|bitte an|autor|kontakt|avisar a|contacto|contact :|auteur|par|escrito por|von Herrn|von Frau|автор|контакт|встретил|встретила|συνάντησε"
)
VERBS = "met|said|says|wrote|writes|asked|told|lives|works|joined|agreed|replied|signed|reachable|can be called|was born|sagte|schrieb|wohnt|dijo|escribió|vive|dit|écrit|habite|сказал|сказала|написал|написала|встретил|встретила|живёт|είπε|έγραψε|συνάντησε"
#: Words that make two capitalised words a place, a product, a time or a heading.
NOT_PERSON = frozenset(
    "Academy Agency Airport Association Avenue Bank Bay Bridge Building Bureau Center Centre Church City Club College Committee Company Conference Corporation Council Country County Court Day Department District East Engine Europe "
    "Express Foundation Garden Gate Gateway Group Guide Hall Harbor Harbour Hill Hospital Hotel House Industries Institute International Island Lab Labs Lake Library Limited Market Ministry Monday Mountain Museum National New North "
    "Office Park Platform Port Project Republic River Road School Sea Server Service Services Society South Square State States Station Store Street Studio Sunday Support System Systems Team Tower Town Union United University Valley View West World "
    "January February March April May June July August September October November December Tuesday Wednesday Thursday Friday Saturday English Deutsch Français Español Italiano Polski Português "
    "About Blog Careers Community Contact Docs Documentation Doku Download Downloads Guides Help Home Impressum Imprint Jobs Karriere Kontakt Login Menu News Preise Pricing Privacy Search Startseite Subscribe Support Terms Tutorials".split()
)
_PAIR = re.compile(rf"(?<![\w@.])(?=({_FULL})(?![\w@]))")
_LEFT = re.compile(rf"(?:(?<!\w)(?:{'|'.join(map(re.escape, ADDRESSES))})\.? |(?<!\w)(?i:{ROLES})(?::|,)? (?:(?:Dr|Prof|Ms|Mr|Mrs)\.? )?)\Z")
_RIGHT = re.compile(rf" (?:{VERBS})(?!\w)|,? (?:reachable at )?[(<|] ?[^\s@()<>|]+ ?(?:@|&#64;|[(\[{{<](?:at|AT)[)\]}}>]| AT )")
_SIGNS = re.compile(r"(?:[—–]|\[\d\d:\d\d\]|^\|) \Z", re.M)
_SLAVIC = re.compile(r"(?<![\w@.])([А-ЯЁ][а-яё]+ (?:[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|ична) )?[А-ЯЁ][а-яё]+(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|чук|ук|юк))(?![\w@])")
_JOINED = rf"(?:,? or|,? oder|,? ou| или|,| and| und| et| y| e| i| и| και|,? sowie) ({_FULL})(?![\w@])"
_NEXT = re.compile(_JOINED)


def _context_spans(text: str, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Names by context alone, and where the text repeats them."""
    out = []
    for m in _PAIR.finditer(text):
        a, e = m.span(1)
        left = text[max(0, a - 28) : a]
        # more capitalised words in a row are a heading or a menu; in a text of capitals nothing stands out
        alone = text[e : e + 1] != " " or not text[e + 1 : e + 2].isupper()
        shouted = m[1].isupper() and left.rstrip()[-2:].isupper()
        signed = _SIGNS.search(left) and (text[e : e + 1] in ("", ",", ".", ":", ";", "\n", "\r"))
        if alone and not shouted and (signed or _LEFT.search(left)) or _RIGHT.match(text, e):
            out.append((a, e))
    if re.search("[А-Я]", text):
        out += [m.span(1) for m in _SLAVIC.finditer(text)]
    out = [(a, e) for a, e in out if _person(text[a:e])]
    for a, e in [*out, *known]:  # a list of names
        while (m := _NEXT.match(text, e)) and _person(m[1]):
            a, e = m.span(1)
            out.append((a, e))
    for name in {text[a:e] for a, e in out}:
        p = text.find(name)
        while p >= 0:
            e = p + len(name)
            if not (p and (text[p - 1].isalnum() or text[p - 1] in "@_")) and not (text[e : e + 1].isalnum() or text[e : e + 1] == "@"):
                out.append((p, e))
            p = text.find(name, e)
    return out


def _person(name: str) -> bool:
    words = re.split(r"[ \-]", name)
    return not any(w in NOT_PERSON or w in NOT_FAMILY or w.isupper() and (w.title() in NOT_PERSON or w.title() in NOT_FAMILY) for w in words) and all(len(w) > 1 for w in (words[0], words[-1]))


_LOCAL = r"[A-Za-z0-9À-ÿ][A-Za-z0-9À-ÿ._%+\-]*"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"(?<![\w.+\-])({_LOCAL})(?:@|&#64;|%40|＠)({_HOST}(?:\.{_HOST})+)")
_EMAIL_HID = re.compile(
    rf"(?<![\w.+\-])({_LOCAL})(?: ?[(\[{{<](?:at|AT|At|@|arroba)[)\]}}>] ?| (?:AT|\(at\)) )({_HOST}(?:(?:\.| ?[(\[{{<](?:dot|DOT|Dot|punkt|punto|point)[)\]}}>] ?| DOT ){_HOST})+)"
)
_EMAIL_SAID = re.compile(rf"(?<![\w.+\-])({_LOCAL}) at ({_HOST}(?: dot {_HOST})+)")
_ID = re.compile(
    r"(?<![\w./\-])(?:"
    r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]"  # two letters, six digits, a letter
    r"|[A-Z]{6}\d\d[A-EHLMPRST]\d\d[A-Z]\d{3}[A-Z]"  # sixteen signs with a coded birth date
    r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z]"  # digits with a check letter
    r"|[A-Z]{1,2}\d{7}"  # passports
    r"|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"  # three, two, four digits
    r"|\d{2} \d{3} \d{3} \d{3}"  # eleven digits in groups
    r"|[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}"  # fifteen digits
    r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"  # bank account
    r")(?![\w\-/]|\.\d)"
)
_PHONE = re.compile(
    r"(?<![\w./\-+:#=])(?:"
    r"(?:\+|00)\d{1,3}[ .\-]?(?:\(0\)[ ]?)?\d{1,5}(?:[ .\-/]?\d{2,5}){1,5}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}"
    r"|\(0\d{1,5}\) ?\d{3,}(?:[ .\-]?\d{2,}){0,3}"
    r"|\d{3}([.\- ])\d{3}\1\d{4}"
    r"|0\d{1,5}(?:[ .\-/]\d{2,8}){1,5}"
    r"|0\d{9,10}"
    r"|0[67]\d{9}"
    r")(?:,? ?(?:ext\.?|x|extension|Durchwahl|poste|Ap\.?) ?\d{1,5})?(?![\w\-/]|\.\d)"
)
#: Words before digits that make them something else.
_NUMBERED = re.compile(r"(?i)\b(?:order|checksum|build|trace|batch|ticket|version|commit|port|isbn|issn|doi|rev|serial|invoice|bestellung|pedido|commande|prüfsumme|KB)[ #:.\-]*\Z")
_SUFFIX = r"(?:Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Drive|Dr|Court|Ct|Way|Hill|Terrace|Mews|Row|Crescent|Boulevard|Blvd|Place|Pl|Square|Sq|Gardens|Gate|Grove|Park|Parade|Walk|Yard|Wharf|Highway|Pkwy|Parkway)"
_POST = r"(?:,? (?:Apt|Suite|Ste|Unit|Flat|Floor|#)\.? ?[\w\-]+)?(?:(?:,| in|\n(?=\w+ [A-Z]{1,2}\d)) ?[A-ZÀ-Ý][\wÀ-ÿ\-]+(?: [A-Z][a-z\-]+(?=,? [A-Z]{2}))?)?(?:,? [A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}|,? [A-Z]{2} \d{5}(?:-\d{4})?)?"
_POST_EU = r"(?:, \d{4,5} [A-ZÀ-Ý][\wÀ-ÿ\-]+|(?:,| in) [A-ZÀ-Ý][\wÀ-ÿ\-]+)?"
_ADDRESS = (
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}[A-Za-z]? (?:[NSEW]\.? )?(?:[A-Z][\w'’\-]+ ){{1,3}}{_SUFFIX}\b(?! View)\.?{_POST}"),
    re.compile(rf"(?<![\w.\-/])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd\.?|chemin|impasse|allée|allee|quai|place|cours|route|square|passage|sentier|faubourg) (?:(?:de la|de l['’]|du|des|de|d['’]|le|la|les) ?)?[A-ZÀ-Ý][\wÀ-ÿ'’\-]+(?:[ \-](?:de|du|des|la)?[ \-]?[A-ZÀ-Ý][\wÀ-ÿ'’\-]+){{0,3}}{_POST_EU}"),
    re.compile(rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Paseo|Camino|Carrer|Ronda|Travesía|Glorieta|Rua|Travessa|Praça|Via|Viale|Piazza|Corso|ulica|ul\.|aleja|al\.) ?(?:(?:de la|de los|de las|del|de|da|do|dos|della) )?[A-ZÀ-Ý][\wÀ-ÿ\-]+(?: (?:de |del |la )*[A-ZÀ-Ý][\wÀ-ÿ\-]+){{0,3}},? \d{{1,5}}[a-zA-Z]?\b(?:, (?:\d{{1,2}}\.?[ºª°](?: ?[A-Za-z]+\.?)?|bajo|ático))?{_POST_EU}"),
    re.compile(rf"(?<![\w])(?:[A-ZÄÖÜ][a-zäöüß\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|steig|graben|markt|chaussee|pfad)|(?:Am|An der|Im|Zum|Zur|Alte|Neue|Große|Kleine) [A-ZÄÖÜ][a-zäöüß\-]+) \d{{1,4}}(?: ?[a-z](?![\w]))?{_POST_EU}"),
)
_DIGIT_RUN = re.compile(r"\d")


def _email_spans(text: str) -> list[tuple[int, int]]:
    out = []
    if "@" in text or "&#64;" in text or "%40" in text or "＠" in text:
        for m in _EMAIL.finditer(text):
            a, e = m.span()
            host = m[2]
            if not re.search(r"[A-Za-z]{2,}\Z", host) or re.fullmatch(r"v?\d[\d.]*", host):
                continue
            if re.match(r"v\d", host) or text[e : e + 1] in ("/",) or (text[e : e + 1] == ":" and re.match(r":[\w.~/\-]+", text[e:])):
                continue  # versions, remotes and user parts of URLs
            left = text[max(0, a - 40) : a]
            if re.search(r"(?:://[^\s/@]*|\b(?:ssh|scp|sftp|rsync|git clone) (?:-\S+ )*|:)\Z", left) and not left.endswith(("mailto:", ": ")):
                continue
            out.append((a, e))
    if "at" in text or "AT" in text or "arroba" in text:
        if "(at)" in text or "[at]" in text or "{at}" in text or " AT " in text or "<at>" in text or "(AT)" in text or "[AT]" in text or "(@)" in text or "[@]" in text or "arroba" in text:
            out += [m.span() for m in _EMAIL_HID.finditer(text) if "." in m[2] or re.search(r"(?i)dot|punkt|punto|point", m[2])]
        if " dot " in text:
            out += [m.span() for m in _EMAIL_SAID.finditer(text)]
    return out


def _digit_spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    ids, phones = [], []
    for m in _ID.finditer(text):
        if not _NUMBERED.search(text[max(0, m.start() - 14) : m.start()]):
            ids.append(m.span())
    for m in _PHONE.finditer(text):
        if re.fullmatch(r"\d{5}-\d{4}", m[0]):
            continue  # a postal code
        if sum(c.isdigit() for c in m[0]) >= 9 and not _NUMBERED.search(text[max(0, m.start() - 14) : m.start()]):
            phones.append(m.span())
    return ids, phones


def _address_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for rx in _ADDRESS for m in rx.finditer(text)]


def _ok_family(f: str) -> bool:
    first = re.split(r"[ \-]", f)[-1]
    return first not in NOT_FAMILY and len(first) > 1


def _name_spans(text: str, emails: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    seen = set(_WORD.findall(text)) & _GIVEN_ANY
    for g in seen:
        p = text.find(g)
        while p >= 0:
            q = p + len(g)
            if (p == 0 or not (text[p - 1].isalnum() or text[p - 1] in "@_")) and not text[q : q + 1].isalnum():
                m = _AFTER.match(text, q)
                fam = m and (m[1] or m[2])
                if m and _ok_family(fam) and not (g in _GIVEN and g != g.upper() and m[2]):
                    out.append((p, m.end()))
                else:
                    b = _BEFORE.search(text, max(0, p - 60), p)
                    if b and _ok_family(b[1]) and b[1] not in _GIVEN_ANY:
                        out.append((b.start(1), q))
            p = text.find(g, q)
    if ". " in text or "." in text:
        for m in _INITIAL.finditer(text):
            if _ok_family(m[2]) and m[2] not in _GIVEN_ANY and len(m[2]) >= 4:
                out.append(m.span())
    if emails:  # words before an address whose local part repeats the family name
        for a, e in emails:
            local = re.split(r"@|&#64;| ?[(\[]at| AT ", text[a:e], maxsplit=1)[0].lower()
            left = text[max(0, a - 70) : a]
            m = re.search(rf"(?<![\w@.])([{_UP}][{_LOW}]+(?: [{_UP}]\.)? ({_FAM1})|({_FAM1}), [{_UP}][{_LOW}]+)[ ,|<(]{{1,4}}(?:reachable at )?\Z", left)
            if m and (m[2] or m[3]).split(" ")[-1].split("-")[0].lower() in local:
                out.append((a - len(left) + m.start(1), a - len(left) + m.end(1)))
    return out + _context_spans(text, out)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps."""
    emails = _email_spans(text)
    ids, phones = _digit_spans(text) if _DIGIT_RUN.search(text) else ([], [])
    addresses = _address_spans(text) if _DIGIT_RUN.search(text) else []
    names = _name_spans(text, emails)
    taken: list[tuple[int, int, str]] = []
    for kind, spans in zip(KINDS, (emails, addresses, ids, phones, names)):
        for a, e in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not any(a < t and s < e for s, t, _ in taken):
                taken.append((a, e, kind))
    return sorted(taken)


# ---- replacing -------------------------------------------------------------------------------------------------------------


def normal(kind: str, value: str) -> str:
    """The same person's value in another spelling has the same normal form."""
    v = value.strip()
    if kind == "email":
        v = re.sub(r"&#64;|%40| ?[(\[{<](?:at|AT|At)[)\]}>] ?| AT | at ", "@", v)
        v = re.sub(r" ?[(\[{<](?:dot|DOT|Dot)[)\]}>] ?| DOT | dot ", ".", v)
        return re.sub(r"\+[^@]*@", "@", v.lower())
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9A-Z+]", "", v.upper().replace("(0)", ""))
    if kind == "name" and ", " in v:
        fam, given = v.split(", ", 1)
        v = f"{given} {fam}"
    return re.sub(r"\s+", " ", v.lower())


def _bytes(key: bytes, kind: str, value: str, attempt: int) -> bytes:
    return hmac.new(key, f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha512).digest()


#: Syllables and endings of made-up words by script; Cyrillic family names have two forms.
SYLLABLES = {
    "latin": "bar del fos gar hol kel lan mar nor pel ros sel tal ver wel zan".split(),
    "cyrillic": "бар дел гор кол лан мар нор пел рос сел тал вер зан лев мир рам".split(),
    "greek": "βαρ δελ γορ κολ λαν μαρ νορ πελ ροσ σελ ταλ βερ ζαν λεβ μιρ ραμ".split(),
}
ENDINGS = {"latin": "field mann ova ez son ini ier ak".split(), "cyrillic": "ов ев ин енко ский ук цев лин".split(), "greek": "ίδης όπουλος άκης ίου άς ής ούλης έας".split()}
#: Given names of the other scripts by gender.
GIVEN_OTHER = {
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Нина Ольга Полина Раиса Софья Тамара".split(), ("cyrillic", "m"): "Антон Виктор Глеб Денис Егор Захар Игорь Леонид Максим Николай Олег Павел Роман Семён Тимур".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Όλγα Σοφία".split(), ("greek", "m"): "Αντώνης Βασίλης Γιώργος Δημήτρης Ευάγγελος Ζήσης Ιωάννης Κώστας Μιχάλης Νίκος Όθωνας Σπύρος".split(),
}


def script_of(text: str) -> str:
    return "cyrillic" if re.search("[а-яё]", text.lower()) else "greek" if re.search("[α-ωά-ώ]", text.lower()) else "latin"


def gender_of(given: str, family: str) -> str:
    """By the list, else by the endings that the languages use, else either."""
    g = GENDER.get(given.title())
    if g:
        return g
    if re.search(r"(?:ова|ева|ёва|ина|ына|ская|цкая|ová|ska)\Z", family) or re.search(r"[aаяαηή]\Z", given):
        return "f"
    return "m" if re.search(r"(?:ов|ев|ин|ский|цкий|ski)\Z", family) or re.search(r"(?:[oеruns]|ς)\Z", given) else "e"


def _word(d: bytes, script: str, more: int = 0) -> str:
    s = SYLLABLES[script]
    return "".join(s[b % 16] for b in d[: 3 + more])


def _given(letter: str, script: str, g: str, key: bytes, pick: int) -> str:
    """A given name of the gender whose letter follows the letter of the original."""
    pools = {"f": (GIVEN_F, GIVEN_OTHER.get((script, "f"))), "m": (GIVEN_M, GIVEN_OTHER.get((script, "m"))), "e": (GIVEN_E + GIVEN_F + GIVEN_M, (GIVEN_OTHER.get((script, "f")) or []) + (GIVEN_OTHER.get((script, "m")) or []))}
    pool = pools[g][0 if script == "latin" else 1]
    letters = sorted({n[0] for n in pools["f"][0 if script == "latin" else 1]} & {n[0] for n in pools["m"][0 if script == "latin" else 1]})
    to = letters[int.from_bytes(_bytes(key, "letter", letter, 0)[:4]) % len(letters)]
    pool = [n for n in pool if n[0] == to]
    return pool[pick % len(pool)]


def _iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _drawn(value: str, d: bytes, keep: int) -> str:
    """Every digit and letter drawn again behind the first `keep` signs."""
    return "".join(c if p < keep else str(d[p % 64] % 10) if c.isdigit() else chr(65 + d[p % 64] % 26) if c.isalpha() else c for p, c in enumerate(value))


#: Letters that check eight digits.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """A replacement for a normal form: same kind, and the same gender, script, country, check signs and format where the kind has them.
    Later attempts have longer words to draw from."""
    d = _bytes(key, kind, value, attempt)
    if kind == "name":
        given, _, family = value.partition(" ")
        script = script_of(value)
        g = gender_of(given, family)
        f = _bytes(key, "family", family, attempt)
        fam = _word(f, script, min(attempt, 8)).capitalize() + ENDINGS[script][f[12] % 8]
        if script == "cyrillic" and g == "f" and fam[-2:] in ("ов", "ев", "ин"):
            fam += "а"
        if given.endswith("."):
            return f"{_given(given[0], script, 'f', key, 0)[0]}. {fam}"
        return f"{_given(given[0], script, g, key, int.from_bytes(d[:2]))} {fam}"
    if kind == "email":
        host = value.rpartition("@")[2]
        return f"user{int.from_bytes(d[:8]) % 10 ** (10 + min(attempt, 6)):010d}@{'mail.' if host.count('.') > 1 else ''}example.{host.rpartition('.')[2] or 'org'}"
    if kind == "address":
        return _drawn_address(value, key, attempt)
    if kind == "phone":
        return _drawn(value, d, 3 if value.startswith("+") else 1 if value.startswith("0") else 0)
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", value):  # an account number: country kept, check digits made
        account = _drawn(value[4:], d, 0)
        return value[:2] + _iban_digits(value[:2], account) + account
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", value):  # digits with a check letter
        body = _drawn(value[:-1], d, 1 if value[0] in "XYZ" else 0)
        return body + CHECK_LETTERS[int(body.replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23]
    out = _drawn(value, d, 0)
    if re.fullmatch(r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]", value):  # with the letter of a month
        out = out[:8] + "ABCDEHLMPRST"[d[60] % 12] + out[9:]
    return out[:-1] + value[-1] if value[-1:].isalpha() else out


#: Words of addresses that are no names.
STREET_WORDS = frozenset(
    "street st road rd lane ln close avenue ave drive dr court ct way hill terrace mews row crescent boulevard blvd place pl square sq gardens gate grove park parade walk yard wharf highway pkwy parkway apt suite ste unit flat floor in rue av "
    "bd chemin impasse allée quai cours route passage sentier faubourg bis ter quater de la le les du des d l calle c avenida avda plaza paseo camino carrer ronda travesía glorieta rua travessa praça via viale piazza corso ulica ul aleja al los las del da do dos della "
    "bajo ático am an der im zum zur alte neue große kleine straße strasse str gasse weg platz allee ufer damm ring steig graben markt chaussee pfad n s e w".split()
)
_STREET_TAIL = re.compile(r"(?:straße|strasse|str|gasse|weg|platz|allee|ufer|damm|ring|steig|graben|markt|chaussee|pfad)\Z")


def _drawn_address(value: str, key: bytes, attempt: int) -> str:
    """Numbers and names of an address drawn anew, its words for streets and its order kept."""

    def put(m: re.Match) -> str:
        w = m[0]
        d = _bytes(key, "address", f"{value}/{m.start()}", attempt)
        if any(c.isdigit() for c in w):
            out = "".join(str(d[i] % 10) if c.isdigit() else chr(97 + d[i] % 26) if c.isalpha() else c for i, c in enumerate(w))
            return str(1 + d[40] % 9) + out[1:] if out[0] == "0" else out
        if w in STREET_WORDS or len(w) == 1:
            return w
        tail = _STREET_TAIL.search(w)
        return _word(d, script_of(w), min(attempt, 8)) + (tail[0] if tail else "") if len(w) > 2 else "".join(chr(97 + d[i] % 26) for i in range(len(w)))

    return re.sub(r"[^\W_]+", put, value)


def dress(kind: str, original: str, replacement: str) -> str:
    """Give the surrogate the spelling of this mention: order and case of a name or an address, separators of a number."""
    if kind == "name":
        if ", " in original:
            given, _, fam = replacement.partition(" ")
            replacement = f"{fam}, {given}"
        return replacement.upper() if original.isupper() else replacement
    if kind == "address":
        words = re.findall(r"[^\W_]+", original)
        fresh = iter(words)

        def cased(m: re.Match) -> str:
            w = next(fresh, "")
            return m[0].upper() if w.isupper() and len(w) > 1 or w.isupper() and not m[0].isdigit() else m[0].capitalize() if w[:1].isupper() else m[0]

        return re.sub(r"[^\W_]+", cased, replacement)
    if kind == "email" and original.isupper():
        return replacement.upper()
    if kind in ("phone", "id_number"):
        fresh = iter(replacement)
        body = original.replace("(0)", "\0")
        out = "".join(next(fresh, "0") if c.isalnum() or c == "+" else c for c in body)
        return out.replace("\0", "(0)")
    return replacement


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(t, i, k, a) for t, i, x in zip(b["rec_table"], b["rec_id"], b["content"]) if x for a, _, k in find(x)]
        yield pd.DataFrame(rows, columns=["rec_table", "rec_id", "kind", "start_char"])


def find_pii(records: DataFrame) -> DataFrame:
    """(rec_table, rec_id, kind, start_char), each once, of records(rec_table, rec_id, content)."""
    return (
        records.select("rec_table", "rec_id", "content").where("content is not null")
        .mapInPandas(_spans, "rec_table string, rec_id string, kind string, start_char long").distinct()
    )


def redact(text: str | None) -> str | None:
    """Typed placeholders such as [EMAIL]; all other text unchanged."""
    if not text:
        return text
    parts, seen = [], 0
    for a, e, k in find(text):
        parts += [text[seen:a], f"[{k.upper()}]"]
        seen = e
    return "".join(parts) + text[seen:]


def redact_pii(records: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rec_table": b["rec_table"], "rec_id": b["rec_id"], "content": [redact(x) for x in b["content"]]})

    return records.select("rec_table", "rec_id", "content").mapInPandas(run, "rec_table string, rec_id string, content string")


def surrogate_table(records: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for every distinct normal form, with distinct surrogates within a kind, none of them a value of the corpus.

    Each round draws for the values still open; those that collide with a settled value, with a value of the corpus or lose to another
    open one draw again, from a larger space each time, until none is left."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(k, normal(k, x[a:e])) for x in b["content"] if x for a, e, k in find(x)}
            yield pd.DataFrame(sorted(rows), columns=["kind", "value"])

    def draw(attempt: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                s = [surrogate(k, v, key, attempt) for k, v in zip(b["kind"], b["value"])]
                yield pd.DataFrame({"kind": b["kind"], "value": b["value"], "surrogate": s, "like": [normal(k, x) for k, x in zip(b["kind"], s)]})

        return run

    every = write_shared(records.select("content").where("content is not null").mapInPandas(values, "kind string, value string").distinct(), "p2-values")
    open_, done, attempt = every, None, 0
    while True:
        drawn = write_shared(open_.mapInPandas(draw(attempt), "kind string, value string, surrogate string, like string"), "p2-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"), F.first("like").alias("like"))
        won = first.join(every.select("kind", F.col("value").alias("like")), ["kind", "like"], "left_anti").select("kind", "value", "surrogate")
        if done is not None:
            won = won.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = write_shared(won, "p2-won")
        done = won if done is None else done.unionByName(won)
        open_ = write_shared(drawn.join(won.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value"), "p2-open")
        if open_.isEmpty():
            return done.select("kind", "value", "surrogate")
        attempt += 1


def replace_with_surrogates(records: DataFrame, table: DataFrame) -> DataFrame:
    """(rec_table, rec_id, content) with every mention replaced. Mentions meet their surrogates by a join on (kind, value); the
    replacements of a record come back to its text in one more join, keyed by the record, so no task holds more than single records."""

    def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, a, e, k, x[a:e], normal(k, x[a:e])) for h, x in zip(b["rec"], b["content"]) if x for a, e, k in find(x)]
            yield pd.DataFrame(rows, columns=["rec", "a", "e", "kind", "said", "value"])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, ms in zip(b["content"], b["ms"]):
                if x and ms is not None and len(ms):
                    parts, seen = [], 0
                    for m in sorted(ms, key=lambda m: m["a"]):
                        parts += [x[seen : m["a"]], dress(m["kind"], m["said"], m["surrogate"])]
                        seen = m["e"]
                    x = "".join(parts) + x[seen:]
                out.append(x)
            yield pd.DataFrame({"rec_table": b["rec_table"], "rec_id": b["rec_id"], "content": out})

    base = records.select("rec_table", "rec_id", "content", F.sha2(F.concat_ws("\0", "rec_table", "rec_id", "content"), 256).alias("rec"))
    found = base.select("rec", "content").where("content is not null").dropDuplicates(["rec"]).mapInPandas(mentions, "rec string, a long, e long, kind string, said string, value string")
    by_rec = found.join(table, ["kind", "value"]).groupBy("rec").agg(F.collect_list(F.struct("a", "e", "kind", "said", "surrogate")).alias("ms"))
    return base.join(by_rec, "rec", "left").select("rec_table", "rec_id", "content", "ms").mapInPandas(apply, "rec_table string, rec_id string, content string")
