"""Personal information in free text, found and replaced by typed placeholders.

High-recall patterns propose spans of five kinds, which may overlap. Each proposal is described by features of its
format and its context, boosted trees per kind give it a score, and what passes the threshold calibrated for its kind is
kept, the best where spans overlap. There is no list of names: a name is proposed by its shape, and the trees see how
common its words are (whether public vocabularies have them in lower case, with a capital only or not at all), whether
the text has them in lower case or in a mail address, and what stands around them. The trees are fitted on the driver,
once a process, from the sentences of `sentences`; no row of the data is used.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import sentences
from .boosting import Boosted

KINDS = ("email", "phone", "identity", "address", "name")
#: Bound of the labelled sample: so many sentences with and as many without personal information. A quarter of the
#: frames is held out for the thresholds.
SAMPLE = 6000
SEED = 20

#: Particles, titles, street words and common words of several languages.
_PARTICLE = r"(?:van[ \n]der|van den|van de|van|von der|von|de[ \n]la|de los|de|del|della|di|da|dos|du|den|ter|bin|ibn|al|el|la|le)"
_TITLE = re.compile(r"(?:^|[^\w])(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mme|Mlle|Frau|Herrn?|Sra?|Srta|Señora?|Don|Doña|Madame|Monsieur|Sir|Ing)\.?\s$")
_TITLE_WORD = re.compile(r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mme|Mlle|Frau|Herrn?|Sra|Sr|Srta|Señora?|Madame|Monsieur|Sir|Ing|Dear|Hola|Hallo|Hi|Hello|Bonjour|Liebe|Lieber|Querid[oa]|Cher|Chère)\.?$", re.I)
_NO_NAME = set(
    "The This That These Those A An Our My Your Their Its Each Every No And Or But For With From By To In On At Of Is Are Was Were If When While Because Since After Before We You He She It They I "
    "Der Die Das Ein Eine Und Oder Mit Von Für Nach Le La Les Un Une Et Ou Avec Pour Par El Los Las Una Y O Con Por Para "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()
)
_AGENT = set("by from with to for and or as ask asked tell told met cc via of von mit an für und nach bei laut par avec à pour et de selon au por con para y a según called named signed wrote".split())
_KEY = re.compile(r"(?i)(?:author|maintainer|owner|user|contact|review(?:er)?|person|customer|patient|applicant|assignee|attn|name|by|who|from|to|cc|ansprechpartner|kontakt|auteur|contacto|contact)(?:[\"'\s]*[:=]\s*[\"'<]?|\s[\"'])$")
_GREETING = re.compile(r"(?i)(?:dear|hi|hello|hallo|hola|bonjour|liebe[r]?|querid[oa]|estimad[oa]|ch[eè]re?|thanks|thank you|danke|merci|gracias|sorry|well|regards|grüßen|saludo|cordialement)\W{0,3}$")
_CAP = r"(?:[A-Z]['’])?[A-ZÀ-ÖØ-ÞŁŚŻŽŠČ][^\W\d_]+(?:['’][^\W\d_]+)?"
_SURNAME = rf"(?:{_PARTICLE}[ \n])?{_CAP}(?:-{_CAP})*"
_NAMES = re.compile(
    rf"(?<![\w.@/\\-])(?=({_CAP}(?:-{_CAP})?(?:[ \n][A-Z]\.)?[ \u00a0\n]{_SURNAME}|[A-Z]\.[ \n](?:[A-Z]\. )?{_SURNAME}|{_SURNAME},[ \n](?:{_CAP}(?:-{_CAP})?|[A-Z]\.))(?![\w@]|-\w))"
)
#: Three names, beside the two that the pattern above finds at the same place.
_LONGER = re.compile(rf"(?<![\w.@/\\-])(?=({_CAP}(?:-{_CAP})? {_CAP} {_SURNAME})(?![\w@]|-\w))")
_EMAILS = re.compile(
    r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}(?:@(?:[A-Za-z0-9-]{1,63}\.){1,6}[A-Za-z][\w-]*|(?:%40)(?:[A-Za-z0-9-]{1,63}\.){1,6}[A-Za-z]{2,}"
    r"| ?[\[({<] ?(?:at|arroba|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|punkt|point|punto|\.) ?[\])}>] ?)[A-Za-z0-9-]{1,63}){1,6}|(?: at | AT )[A-Za-z0-9-]{1,63}(?:(?: dot | DOT )[A-Za-z0-9-]{1,63}){1,6})"
)
_PHONES = re.compile(r"(?<![\w+(.:/-])(?:\+|\(\+?|00)?\d[\d ().\-/\u00a0\n]{5,22}\d(?!\w|[.:\-]\d)")
_IDS = re.compile(
    r"(?<![\w.\-/+])(?:\d{3}[-\s]\d{2}[-\s]\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|[A-Z]{1,2}\d{6,8}|[XYZ]-?\d{7}-?[A-Z]|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]|[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?|\d{2}\s?\d{3}\s?\d{3}\s?\d{3}|\d{9}|[CFGHJKLMNPRTVWXYZ0-9]{9})(?![\w]|-\w)"
)
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Row|Close|Way|Drive|Dr\.?|Court|Ct\.?|Place|Square|Terrace|Gardens|Grove|Hill|Crescent|Boulevard|Blvd\.?|Mews|Walk|Park)"
_TOWN = rf"(?:,? ?\d{{4,5}})?,? {_CAP}(?:[- ](?:sur|sous|am|an der|de|la|les|upon|on|{_CAP})(?:[- ]{_CAP})?)*(?: \d{{4,5}})?"
_ADDRESSES = re.compile(
    rf"(?<![\w.\-/])(?:(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\d+[A-Za-z]?,?\s)?\d{{1,4}}[A-Za-z]?(?:-\d+)?,?\s(?:{_CAP}\s){{1,3}}{_STREET}(?!\w)(?:(?:,\s|\n){_CAP}(?:-[\w]+)*(?:\s\d{{4,5}})?)?"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|bd|chemin|allée|place|impasse|quai|route|cours|passage|square)(?: (?:de la|des|du|de|d'|la|le|l'))?\s?{_CAP}(?:[ -]{_CAP})*(?:(?:,\s|\n)\d{{5}}\s{_CAP}(?:[- ][\w]+-?\w*)?)?"
    rf"|(?:(?:Am|Im|Zum|Zur|An der|Auf der|Auf dem|Unter den) )?{_CAP}(?:-{_CAP})*\.?(?: ?-?(?:Straße|Strasse|Weg|Platz|Allee|Gasse|Ring))?\s?\d{{1,4}} ?[a-z]?(?:(?:,\s|\n)\d{{5}}\s{_CAP}(?:[- ][\w]+)*)?"
    rf"|(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Carrera|Vía|Via)\s?(?:(?:de la|de los|de|del) )?{_CAP}(?: {_CAP})*,?\s(?:n\.?º ?|núm\.? ?)?\d{{1,4}}(?: ?[a-zA-Z](?!\w))?(?:, \d{{1,2}}[º°] ?\w*)?(?:(?:,\s|\n)\d{{5}}\s{_CAP}(?:[- ][\w]+)*)?)(?!\w)"
)
_GERMAN = re.compile(r"(?:weg|straße|strasse|str\.|gasse|allee|platz|ring|damm|ufer|pfad|steig|Straße|Strasse|Weg|Platz|Allee|Gasse|Ring)\s?\d|^(?:Am|Im|Zum|Zur|An der|Auf der|Auf dem|Unter den) ")

_FORMATS = tuple(
    re.compile(p + r"\Z")
    for p in (
        r"(?:\+?1[ .\-])?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}", r"(?:(?:\+44|0044) ?(?:\(0\) ?)?|0)[127]\d{2,4} ?\d{3} ?\d{3,4}", r"(?:(?:\+49|0049) ?(?:\(0\))? ?|\(?0)\d{2,4}\)?[ /\-]*\d{3,8}(?:[ \-]\d{1,5})?",
        r"(?:(?:\+33|0033) ?(?:\(0\))? ?|0)[1-9](?:[ .\-]?\d{2}){4}", r"\(?(?:\+34|0034)\)? ?[6789]\d{2}(?:[ \-]?\d{2,3}){2,3}", r"[679]\d{2}(?:[ \-]\d{3}){2}|[679]\d{2}(?:[ \-]\d{2}){3}",
    )
)
_REACH = re.compile(r"(?i)(?:call|phone|tel|telefon|téléphone|teléfono|ring|mobile|cell|fax|unter|al|au|number|contact|sms|dial|reach|oder|ou|or|o|at|on|numbers|nummer|numéro|número)\W{0,6}$|[@\]](?:[\w.\[\] ]{3,40})[,;:\" ]+(?:tel\W+)?$|[|,;]\s?$")
_COUNTS = re.compile(r"(?i)(?:build|version|ports?|ids?|run|ticket|order|checksum|sha|commit|took|code|size|offset|lines?|rows?|page|since|job|node|total|sum|ref|serial|batch|case|item|part|range)\W{0,3}$")
_UNITS = re.compile(r"^\W{0,2}(?:ms|s|took|MB|KB|GB|rows|runs|bytes|px|times|of|%|/)\b|^[.:]\d")
_LABEL = re.compile(
    r"(?i)(?:ssn|social security(?: (?:number|no\.?))?|passport(?: (?:number|no\.?))?|national insurance(?: (?:number|no\.?))?|\bni(?:no| number)|tax id|tin|steuer-?(?:id(?:nr)?|identifikationsnummer|nummer)|ausweis(?:nummer|nr)?|reisepass(?:nummer)?|personalausweis(?:nummer)?"
    r"|nir|insee|n[°º] de sécurité sociale|numéro de sécurité sociale|passeport|n[°º] fiscal|dni|nie|nif|pasaporte|seguridad social|sozialversicherungsnummer|id card|identity (?:card|number))[\s.]*(?:n[°ºr.]+|no\.?|number|nummer)?[\s:=#]*\W{0,4}$"
)
def _context(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 48) : start].replace("\n", " "), text[end : end + 24]


def _email(text: str, start: int, end: int) -> list[int]:
    before, after = _context(text, start, end)
    found = text[start:end]
    local = re.split(r"@|%40| ?[\[({<]| at ", found, maxsplit=1)[0]
    tail = re.split(r"@|%40|[\])}>]| at ", found, maxsplit=1)[-1]
    last = re.split(r"[.\s]", found)[-1]
    return [
        0 if "@" in found else 1 if re.search(r"[\[({<]", found) else 2, local.lower() in ("git", "hg", "svn", "ssh"), after[:1] in ":/" and after[1:2].isalnum(), before[-1:] in "/@",
        last.isalpha() and len(last) > 1, any(c.isdigit() for c in tail), bool(re.search(r"(?i)(?:clone|ssh://|remote|git)\W*(?:it with )?$", before)), min(len(local), 15), bool(re.search(r"\[|\(dot|dot", tail)) or "." in tail,
    ]


def _phone(text: str, start: int, end: int) -> list[int]:
    before, after = _context(text, start, end)
    found = text[start:end].replace("\n", " ")
    fits = [bool(f.match(found)) for f in _FORMATS]
    digits = sum(c.isdigit() for c in found)
    return [
        *fits, any(fits), min(digits, 15), found[0] == "+" or found[:2] in ("(+", "00"), bool(_REACH.search(before)), bool(_COUNTS.search(before)), bool(_UNITS.match(after)), bool(re.match(r"\d{4}-\d\d-\d\d|\d+\.\d+\.\d+", found)),
        len(re.findall(r"\d+", found)), bool(_LABEL.search(before)), found[0] == "0", bool(re.search(r"@\S+\W+$", before)),
    ]


_ID_FORMATS = tuple(
    re.compile(p + r"\Z")
    for p in (r"\d{3}[- ]\d{2}[- ]\d{4}", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", r"[A-Z]{1,2}\d{6,8}", r"[XYZ]-?\d{7}-?[A-Z]", r"\d{2}\.?\d{3}\.?\d{3}-?[A-Z]", r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?", r"\d{2} ?\d{3} ?\d{3} ?\d{3}")
)


def _identity(text: str, start: int, end: int) -> list[int]:
    before, after = _context(text, start, end)
    found = text[start:end].replace("\n", " ")
    fits = [bool(f.match(found)) for f in _ID_FORMATS]
    return [*fits, bool(_LABEL.search(before)), bool(_COUNTS.search(before)), bool(_UNITS.match(after)), bool(re.search(r"(?i)(?:\bid|number|no|nr|nummer|numéro|número)\W*$", before)), bool(re.match(r"\W{0,2}(?:[a-z])", after)), bool(_REACH.search(before))]


def _address(text: str, start: int, end: int) -> list[int]:
    before, after = _context(text, start, end)
    found = text[start:end]
    english = bool(_STREETS.search(found)) and found[0].isalnum()
    french = bool(re.match(r"\d+(?:\s?\w+)?,?\s[a-zé]", found))
    german = bool(_GERMAN.search(found))
    spanish = bool(re.match(r"Calle|C/|Aven|Avda|Plaza|Paseo|Camino|Ronda|Carr|V[íi]a", found))
    return [english, french, german, spanish, bool(re.search(r"\d{4,5}", found)), "," in found, bool(re.search(r"(?i)(?:to|home|addr(?:ess|esse)?|lives at|anschrift|domicile|dirección|a|an|au|à|at|en|in|,|;|:|=|\")\W{0,3}$", before)),
            bool(re.match(r"\s[a-z]+", after)), bool(re.match(r"[.,;:|\"\n]|$", after)), bool(re.match(r"[-. /]?\d", after)), any(c.isdigit() for c in found), found[:4] == "Flat"]


_INNER_PARTICLE = re.compile(rf"(?:^|\s){_PARTICLE}\s")
_GOES_ON = re.compile(rf"[ ](?:{_CAP}|{_PARTICLE} {_CAP})")
_CAPITAL_LAST = re.compile(rf"(?:{_CAP}|[A-Z]\.)$")


_NEAR = re.compile(r"@|[\[(]at[\])]|%40|\+?\d[\d ().\-/]{6,}\d")
_REVERSE_NEXT = re.compile(rf",[ \n](?:{_CAP}|[A-Z]\.)")
_DIGIT_OR_LETTER = re.compile(r"[^\W_]+")


@lru_cache(maxsize=4)
def _boxes(text: str) -> str:
    """The local parts of the mail addresses of a text."""
    return " ".join(text[max(0, m.start() - 40) : m.start()].rpartition(" ")[2].lower() for m in _AT.finditer(text))


def _stands(word: str, text: str) -> bool:
    """Whether the text has a word in lower case, between blanks or before a mark."""
    return f" {word} " in text or f" {word}s " in text or f" {word}," in text or f" {word}." in text


def _common(word: str, known: frozenset[str]) -> int:
    """3 for a word that the vocabularies have in lower case, 2 with a capital only, 1 if it ends with such a word, else 0."""
    low = word.lower()
    if low in known:
        return 3
    if low.capitalize() in known:
        return 2
    return int(len(low) > 5 and (low[:-1] in known and low[-1] == "s" or low[:-2] in known))


def _before(before: str) -> int:
    """What stands before: nothing, a mark that opens or parts, the end of a sentence, an agent word, a word, a capital."""
    last = before.rstrip(" ")
    if not last or last[-1] in "\n":
        return 0
    if not last[-1].isalnum():
        return 2 if last[-1] in ".!?" else 1
    word = _DIGIT_OR_LETTER.findall(last)[-1:]
    if not word:
        return 1
    return 3 if word[0].lower() in _AGENT else 5 if word[0][0].isupper() else 4


def _after(after: str) -> int:
    rest = after.lstrip(" ")
    if not rest or rest[0] == "\n":
        return 0
    if rest[0] in "<([":
        return 1
    if rest[0] in ",;|\"'":
        return 2
    if rest[0] in ".:!?":
        return 3
    return 4 if rest[0].islower() else 5 if rest[0].isupper() else 6


def _name(text: str, start: int, end: int) -> list[int]:
    lead = text[max(0, start - 48) : start]
    before, after = lead.replace("\n", " "), text[end : end + 24]
    found = text[start:end]
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", found)
    reverse = "," in found
    capital = [w for w in words if w[0].isupper()]
    given, surname = (capital[-1], capital[0]) if reverse else (capital[0], capital[-1])
    known = sentences.vocabulary()
    initial = bool(re.match(r"[A-Z]\.", found)) or bool(re.search(r",\s[A-Z]\.$", found))
    boxes = _boxes(text)
    last = before.rstrip(" ").rpartition(" ")[2]
    first_part, low = given.lower().split("-")[0], surname.lower().split("-")[0]
    g, s = 0 if initial else _common(first_part, known), _common(low, known)
    return [
        g, s, g * 4 + s, reverse, initial, found.upper() == found and len(given) > 2, bool(_INNER_PARTICLE.search(found)), "-" in surname, bool(_TITLE.search(before)), bool(_KEY.search(before)), bool(_GREETING.search(before)),
        _before(lead), _after(after), bool(_NEAR.search(after)), bool((on := _GOES_ON.match(after)) and on[0].split()[-1] not in _NO_NAME), 0 if not _CAPITAL_LAST.match(last) or _TITLE_WORD.match(last) or last.lower() in _AGENT else 1 if _common(last, known) == 3 else 2, any(w.capitalize() in _NO_NAME for w in (given, surname)), bool(_TITLE_WORD.match(given)) or bool(reverse and _TITLE_WORD.match(surname)),
        min(len(surname), 15), _stands(low, text), _stands(first_part, text), len(low) > 3 and low in boxes, len(first_part) > 2 and first_part in boxes, bool(re.match(r"[-]\w", after)), start == 0 or text[start - 1] == "\n", bool(re.search(r"#\s*$", before)), "\n" in found, len(capital), bool(_REVERSE_NEXT.match(after)),
    ]


_PROPOSE = {"email": (_EMAILS, _email), "phone": (_PHONES, _phone), "identity": (_IDS, _identity), "address": (_ADDRESSES, _address), "name": (_NAMES, _name)}
#: Where a proposal can begin: all patterns but those of emails and of names after a particle start with one of these,
#: and none inside of a run, so that only their places are tried.
_BEGINS = re.compile(r"[+(]|[\dA-ZÀ-ÖØ-ÞŁŚŻŽŠČ]+")
_AT = re.compile(r"@|%40|[\[({<] ?(?:at|arroba|@) ?[\])}>]| (?:at|AT) (?=[\w-]+ (?:dot|DOT) )")
_LOCAL = re.compile(r"[A-Za-z0-9][\w.+%-]{0,63} ?\Z")
_LEADING = re.compile(rf"(?<![\w-]){_PARTICLE}[ \n]\Z")
_GROUP_END = re.compile(r"\d(?!\d)")
_DIGITS_GO_ON = re.compile(r"\w|[.:\-]\d")
_STREETS = re.compile(rf"\s{_STREET}(?!\w)")
_ABROAD = re.compile(r"\d+(?:\s?\w+)?,?\s[a-zé]|Calle|C/|Aven|Avda|Plaza|Paseo|Camino|Ronda|Carr|V[íi]a")


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    past = {"email": 0, "phone": 0, "identity": 0, "address": 0}
    for m in _AT.finditer(text):
        low = max(past["email"], m.start() - 66)
        if local := _LOCAL.search(text[low : m.start()]):
            if found := _EMAILS.match(text, low + local.start()):
                past["email"] = found.end()
                yield "email", found.start(), found.end() - found[0].endswith("-")
    for m in _BEGINS.finditer(text):
        at = m.start()
        first = text[at]
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            continue
        if first in "+(":
            kinds: tuple[str, ...] = ("phone",)
        elif first.isdecimal():
            kinds = ("phone", "identity", "address")
        else:
            kinds = ("identity", "address")
            if found := _NAMES.match(text, at):
                yield "name", at, found.end(1)
                if longer := _LONGER.match(text, at):
                    yield "name", at, longer.end(1)
            if at > 2 and text[at - 1] in " \n":
                begin = max(0, at - 9)
                while lead := _LEADING.search(text, begin, at):
                    begin = lead.start() + 1
                    if found := _NAMES.match(text, lead.start()):
                        yield "name", lead.start(), found.end(1)
        for kind in kinds:
            if at >= past[kind] and (found := _PROPOSE[kind][0].match(text, at)):
                past[kind] = found.end()
                yield kind, at, found.end()


def _overlapping(text: str) -> Iterator[tuple[str, int, int]]:
    """The spans and those of the same kind that begin inside one; a phone number also ends where a group of its digits does."""
    for kind, start, end in _spans(text):
        yield kind, start, end
        if kind == "name":
            continue
        pattern = _PROPOSE[kind][0]
        for begin in range(start, end):
            if not (found := pattern.match(text, begin)):
                continue
            stop = found.end() - (kind == "email" and found[0].endswith("-"))
            if begin > start:
                yield kind, begin, stop
            if kind == "phone":
                for m in _GROUP_END.finditer(text, begin, stop - 1):
                    if _PHONES.fullmatch(text, begin, m.end()) and not _DIGITS_GO_ON.match(text, m.end()):
                        yield kind, begin, m.end()


def proposals(text: str, spans: Callable[[str], Iterator[tuple[str, int, int]]] = _overlapping) -> Iterator[tuple[str, int, int, list[int]]]:
    """(kind, start, end, features) of each span that may be personal information."""
    for kind, start, end in spans(text):
        if kind == "address":
            found = text[start:end]
            if not (_STREETS.search(found) or _GERMAN.search(found) or _ABROAD.match(found)):
                continue
        yield kind, start, end, _PROPOSE[kind][1](text, start, end)


@cache
def models(sample: int = SAMPLE, seed: int = SEED) -> dict[str, Boosted]:
    """The trees and thresholds of each kind, the same for the same arguments."""
    rows: dict[str, list[tuple[list[int], int, str]]] = {k: [] for k in KINDS}
    for text, truth, part in sentences.sample(sample, seed, KINDS):
        joined = part == "joined"
        for kind, start, end, features in proposals(text, _overlapping if joined else _spans):
            if joined and (kind != "phone" or any(a <= start and end <= b and (a, b) != (start, end) for _, a, b in truth)):
                continue  # of a number and its part the longer is kept
            good = any(k == kind and a == start and (b == end or kind == "address") for k, a, b in truth)
            rows[kind].append((features, int(good), part))
    out = {}
    for kind, found in rows.items():
        x, y = np.array([f for f, *_ in found], dtype=np.int64), np.array([g for _, g, _ in found])
        held = np.array([part == "held" for *_, part in found])
        out[kind] = Boosted(trees=60).fit(x[~held], y[~held]).calibrate(x[held], y[held])
    return out


def find(texts: list[str], trees: dict[str, Boosted]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the personal information in each text, disjoint and in order.

    Proposals of one kind are scored together. Where spans overlap the one with the higher score stays, of equal
    scores the longer; an email is never split by what looks like a name in it.
    """
    kept: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    proposed: dict[str, list[tuple[int, int, int, list[int]]]] = {kind: [] for kind in KINDS}
    for n, text in enumerate(texts):
        for kind, start, end, features in proposals(text):
            proposed[kind].append((n, start, end, features))
    for kind, found in proposed.items():
        if not found:
            continue
        score = trees[kind].predict(np.array([f for *_, f in found], dtype=np.int64))
        for (n, start, end, _), p in zip(found, score, strict=True):
            if p >= trees[kind].threshold:
                kept[n].append((float(p) + (1.0 if kind == "email" else 0.0), start, end, kind))
    out = []
    for spans in kept:
        taken: list[tuple[str, int, int]] = []
        for _, start, end, kind in sorted(spans, key=lambda s: (-round(s[0], 3), s[1] - s[2], s[1])):
            if all(end <= a or start >= b for _, a, b in taken):
                taken.append((kind, start, end))
        out.append(sorted(taken, key=lambda t: t[1]))
    return out


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [EMAIL], [PHONE], [IDENTITY], [ADDRESS] or [NAME] instead of each span."""
    out, at = [], 0
    for kind, start, end in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("pii_kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))


def with_mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `mentions` (kind, start, end in code points) to the rows with a text; null and empty texts have none."""
    trees = models()

    @F.arrow_udf("array<struct<pii_kind:string,start_pos:int,end_pos:int>>")
    def mentions(texts: pa.Array) -> pa.Array:
        got = find([t or "" for t in texts.to_pylist()], trees)
        return pa.array([[{"pii_kind": k, "start_pos": a, "end_pos": b} for k, a, b in spans] for spans in got], _SPANS)

    return docs.withColumn("mentions", mentions(F.col(text)))


def mention_rows(docs: DataFrame) -> DataFrame:
    """`doc_id, pii_kind, start_pos, end_pos`, one row for each mention."""
    return with_mentions(docs.select("doc_id", "text").where(F.length("text") > 0)).select("doc_id", F.inline("mentions"))


def redacted(docs: DataFrame) -> DataFrame:
    """`doc_id, text, n_mentions`: every document, its mentions replaced by placeholders; null stays null."""

    @F.arrow_udf("string")
    def hide(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else replaced(t, [(s["pii_kind"], s["start_pos"], s["end_pos"]) for s in m or ()]) for t, m in rows], pa.string())

    return with_mentions(docs.select("doc_id", "text")).select("doc_id", hide("text", "mentions").alias("text"), F.size("mentions").alias("n_mentions"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mention_rows(table(spark, d, "documents")).select("doc_id", "pii_kind", "start_pos").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(table(spark, d, "documents"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
