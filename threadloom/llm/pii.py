"""Personal information in free text: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Candidates are spans with the form of an e-mail address, phone number, identity number, street address or name. Regex,
gazetteer and context labelers vote for or against each (1, -1 or 0). How often each pattern of votes occurs is counted
over all candidates; from those counts expectation-maximisation estimates how far each labeler can be trusted and how
likely each pattern is true. A logistic regression on votes, shapes and neighbouring words learns from those
probabilities and decides on every span.

Of repeated post ids the version with the latest updated_at counts; versions with equal texts and times give one result.
Null and empty fields hold nothing; texts are scanned whole. In HTML, character references are read as the characters
they stand for, tags within a line as nothing, other tags as line ends, and attribute values as texts of their own.
Offsets are those of the stored field.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..sources.tables import columns, latest

KINDS = ("email", "phone", "identity", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
VOTES = 7
#: Candidates of each kind that the classifier is fitted on at most (of a share by hash, which is all where there are fewer), size of its feature space.
FITTED, SPACE = 20_000, 1 << 12
#: Most given names that are sent to the workers.
MOST_NAMES = 200_000
EM_STEPS = 50
#: Of the posts that hold a word, the share with it as a surname: up to which it is none, from which it may be one.
COMMON, SURNAME = 0.02, 0.25

# ---- Forms -----------------------------------------------------------------------------------------------------------

_S = r"[     .\-‐‑–/]"
_SP = r"[     ]"
#: Forms of numbers, the strict ones first: kind, whether the form alone is a strong sign, pattern.
_NUMBERS = [
    (kind, strong, re.compile(pattern))
    for kind, strong, pattern in (
        ("identity", True, r"[A-Z]{5}\d{6}[A-Z]\d[A-Z]{2}"),
        ("identity", True, rf"[A-Z]{{2}}{_SP}?\d\d{_SP}?\d\d{_SP}?\d\d{_SP}?[A-D]"),
        ("identity", True, r"[A-Z]\d{8}[A-Z]?|[A-Z]{2}\d{7}[A-Z]?"),
        ("identity", True, r"\d{8}[-‐‑]?[A-Z]"),
        ("identity", True, rf"\d{{4}}(?P<i>[-‐‑]|{_SP})\d{{4}}(?P=i)\d{{4}}"),
        ("phone", True, rf"\+\d{{1,3}}{_S}?\(0\){_S}?\d{{2,5}}(?:{_S}?\d{{2,6}}){{1,4}}"),
        ("phone", True, rf"\+1(?P<a>{_S}?)\(?\d{{3}}\)?{_S}?\d{{3}}{_S}?\d{{4}}(?:{_SP}?(?:ext\.?|x){_SP}?\d{{1,5}})?"),
        ("phone", True, rf"\+\d{{1,3}}(?:{_S}?\d{{1,8}}){{2,6}}|\+\d{{8,15}}"),
        ("phone", True, rf"1(?P<b>[-.‐‑]|{_SP})\d{{3}}(?P=b)\d{{3}}(?P=b)\d{{4}}(?:{_SP}?(?:ext\.?|x){_SP}?\d{{1,5}})?"),
        ("phone", True, rf"\(\d{{2,5}}\){_S}?\d{{3}}{_S}?\d{{3,4}}(?:{_SP}?(?:ext\.?|x){_SP}?\d{{1,5}})?"),
        ("phone", True, rf"00\d{{2}}{_S}\d{{2,4}}{_S}\d{{3,8}}(?:{_S}\d{{2,4}}){{0,2}}"),
        ("phone", True, rf"\d{{3}}(?P<c>[-.‐‑]|{_SP})\d{{3}}(?P=c)\d{{4}}(?:{_SP}?(?:ext\.?|x){_SP}?\d{{1,5}})?"),
        ("phone", True, rf"0\d(?:(?P<d>[.\-‐‑]|{_SP})\d\d)(?:(?P=d)\d\d){{3}}"),
        ("phone", True, r"0\d{2,4}/\d{5,8}"),
        ("phone", True, rf"0\d{{4}}{_SP}\d{{6}}|0\d{{4}}(?P<e>[-.‐‑]|{_SP})\d{{3}}(?P=e)\d{{3}}|02\d(?P<f>[-.‐‑]|{_SP})\d{{4}}(?P=f)\d{{4}}|0\d{{3}}(?P<g>[-.‐‑]|{_SP})\d{{3}}(?P=g)\d{{3,4}}"),
        ("identity", True, rf"\d{{3}}(?P<h>[-.‐‑]|{_SP})\d{{2}}(?P=h)\d{{4}}"),
        ("identity", True, rf"\d{{2}}{_SP}\d{{3}}{_SP}\d{{3}}{_SP}\d{{3}}"),
        ("identity", False, r"00\d{9}"),
        ("identity", False, r"\d{9}|\d{11}"),
        ("phone", False, r"0\d{9,10}"),
    )
]
#: Digits of a number after the country code, by code; of others at most 12.
_NATIONAL = {"1": 10, "33": 9, "44": 10, "49": 11, "61": 9, "34": 9, "39": 10, "351": 9, "81": 10, "7": 10}
_DIGIT = re.compile(r"\d+")
_AT = re.compile(r"\s?(?:[@＠]|[(\[{<]\s?[@＠]\s?[)\]}>])\s?|\s?[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]\s?|\s(?:at|AT|At)\s")
_LOOK = re.compile(r"[@＠]|[dD][oO][tT]|[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]")
_LOCAL = re.compile(r"[A-Za-z0-9À-ɏ._%+'\-]*")  # of a text read backwards
_LABEL = r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ\-]*[A-Za-z0-9À-ɏ])?"
_DOMAIN = re.compile(rf"{_LABEL}(?:(?:[.．。]|\s?[(\[{{<]\s?(?:\.|dot|DOT|Dot)\s?[)\]}}>]\s?){_LABEL})*(?:[.．]|\s?[(\[{{<]\s?(?:\.|dot|DOT|Dot)\s?[)\]}}>]\s?)[A-Za-z]{{2,24}}(?![A-Za-z0-9À-ɏ@])")
# Last parts of host names that are believed when the dots are spelt out.
_SPOKEN_ENDS = "com|org|net|edu|gov|info|biz|dev|app|example|test|invalid|localhost|co|uk|de|fr|es|pt|br|io|eu|jp|nl|ch|pl|ru|se|ca|au"
_SPOKEN_DOMAIN = re.compile(rf"{_LABEL}(?:\s(?:dot|DOT|Dot)\s{_LABEL})*\s(?:dot|DOT|Dot)\s(?i:{_SPOKEN_ENDS})(?![A-Za-z0-9À-ɏ@])")

# Words for streets by language.
_AFTER = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Terrace|Ter|Place|Pl|Way|Gardens|Gdns|Close|Mews|Crescent|Cres|Square|Sq|Parkway|Pkwy|Row|Grove|Walk|Alley|Circle|Cir|Highway|Hwy|Trail"
_BEFORE_FR = "rue|avenue|boulevard|quai|impasse|place|chemin|allée|cours|route|passage|square|bd|av\\."
_BEFORE_ROMANCE = "Calle|Avenida|Avda\\.|Plaza|Paseo|Camino|Carrera|Ronda|Via|Viale|Piazza|Corso|Largo|Rua|Travessa|Praça|Alameda|Estrada|C/"
_W = r"[  \n]"
_CAP = r"[A-ZÀ-Þ][\w'’\-]*"
_NUMBER_FIRST = re.compile(
    rf"\d{{1,5}}[A-Za-z]?,?{_W}(?:(?:bis|ter|quater){_W})?(?:(?i:{_BEFORE_FR}){_W}(?:(?:du|de|des|d'|de la|de l'|la|le|les){_W}?)?{_CAP}|"
    rf"(?:(?:[NSEW]\.?|North|South|East|West|Old|New|Upper|Lower|Great|Little){_W})?(?:{_CAP}{_W}){{1,3}}(?:{_AFTER})\b(?![\w]))"
)
_STREET_FIRST = re.compile(
    rf"((?:{_BEFORE_ROMANCE})(?:{_W}(?:de la|de los|de las|del|della|delle|dei|de|do|da|dos|das|di|d'))?(?:{_W}{_CAP}){{1,3}},?{_W}(?:n\.?[º°]?{_W}?)?"
    rf"|{_CAP}(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|damm|ufer|ring|STRASSE|WEG|GASSE|PLATZ){_W}|{_CAP}-(?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee){_W}|{_CAP}{_W}(?:Stra(?:ß|ss)e|Str\.|Gasse|Allee){_W})$"
)
# What may follow the street: unit, floor, postcode and town.
_TAIL = re.compile(
    rf"(?:{_W}#\d+\w?|,{_W}(?:Unit|Apt\.?|Suite|Flat|No\.?){_W}\w+|,{_W}\d{{1,2}}[º°]{_W}[A-Z]\b)?"
    rf"(?:,{_W}(?:\d{{4,5}}{_W})?{_CAP}(?:{_W}(?:Falls|Springs|Heights|Bay|Beach|City|Park|Hills|Valley|Grove)\b)?(?:{_W}(?:\d{{5}}\b|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_W}\d[A-Z]{{2}}\b))?)?"
)
_LETTER = re.compile(r"(?:[A-Za-z](?![A-Za-z0-9]))?")
_PARTICLES = r"(?:(?i:von|van|vom|zu|zur|de|der|den|da|das|dos|do|di|du|del|della|la|le|el|al|bin|ten|ter|af|av|O'|Mc)[  ])"
_UP, _ANY = "A-ZÀ-ÞŁŠŽΑ-ΩА-ЯЁ", "A-Za-zÀ-ɏͰ-ӿ"
_FAMILY = rf"(?:[{_UP}](?:['’][{_UP}])?[{_ANY}]+(?:[-‐‑][{_UP}][{_ANY}]+)*)"
_SECOND = re.compile(rf"[-‐‑][{_UP}][{_ANY}]+(?![{_ANY}@_+0-9\-])")
_TOKEN = re.compile(rf"[{_UP}][{_ANY}]+")
_FORWARD = re.compile(rf"(?:{_W}{{1,2}}((?:[A-Z]\.{_W}?)*)((?:{_PARTICLES}){{0,3}})({_FAMILY}))(?![{_ANY}@_+0-9])")
_BACKWARD = re.compile(rf"(?<![{_ANY}@_.+0-9'\-])((?:{_PARTICLES}){{0,3}})({_FAMILY})(,?){_W}{{1,2}}((?:[A-Z]\.{_W})*)$")

# Words that speak for a kind, in the languages of the forum; words that speak for something that is no person's.
_CUES = {
    "email": "mail e-mail email contact write reach account send address registered contacto contactez courriel erreichbar adresse 連絡先",
    "phone": "tel phone call ring rang number whatsapp mobile text fax sms telefon telefono téléphone telefone erreichbar contacto falar contactez 電話 連絡先",
    "identity": "passport social security insurance resident tax id identity card licence license driving dni nie document personal ausweis steuer pasaporte passeport fiscal 番号",
    "address": "live lives address meet ship parcel club delivery poster house calle wohne adresse vivo moro habite",
    "name": "signed regards name cousin ask opened mr mrs ms dr prof herr frau sr sra mme refund brother thanks by falar",
}
_CUES = {k: frozenset(v.split()) for k, v in _CUES.items()}
_SELF = frozenset("mine me myself meins mich mío mía moi".split())
_PERSONAL = frozenset("mine my edit form contact contactez contacto falar copy update delete löschen erreichbar mi 連絡先は signed regards".split())
_IMPERSONAL = frozenset("order ticket checksum train crash part version build ip post level port hash commit reply save serial sku item code page bug issue line the press".split())
_NO_FAMILY = frozenset("the this that a an mr mrs ms dr prof herr frau sr sra mme regards ps contactez contact press my mail hi hello dear thanks if so and but in on at for with by".split())
_NAME_TITLES = frozenset("mr mrs ms dr prof herr frau sr sra mme mlle".split())
_SENTENCE = re.compile(r"(?<!\bno)(?<!\b[A-Z][a-z])(?<!\bMrs)[.!?。！？]\s")
_NEAR = re.compile(r"[A-Za-zÀ-ɏͰ-ӿ]+|[぀-ヿ一-鿿]{2,}")
#: Attributes of user names, which are no names of persons.
_USER_ATTRIBUTES = frozenset(("data-username",))
_GAPS = " \u00a0\n"


@dataclass(slots=True)
class Span:
    kind: str
    start: int
    end: int
    votes: list[int]
    words: list[str]
    given: str | None = None
    family: str | None = None
    group: int = 0
    bare: bool = False  # a family name before a given one, without a comma


def _around(context: _Context, start: int, end: int) -> tuple[list[str], str]:
    """The last words before a span in its sentence, small, nearest first, and the word right after it."""
    text, before = context.text, context.before(start)
    after = _NEAR.match(text, end + (text[end : end + 1] in "  "))
    return before, after[0] if after else text[end : end + 1]


def _shape(text: str) -> str:
    return re.sub(r"[a-zß-öø-ɏ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"\d", "9", text)))[:24]


def _votes(kind: str, form: int, before: list[str], following: list[str]) -> list[int]:
    """Votes by form, cue for the kind, cue for another kind, personal words on either side, impersonal ones before it, a unit after it, and one left for gazetteers."""
    near = before[:3]
    cue = any(w in _CUES[kind] for w in near)
    other = not cue and kind in ("phone", "identity") and any(w in _CUES["identity" if kind == "phone" else "phone"] for w in near)
    return [form, int(cue), -int(other), int(any(w in _PERSONAL for w in near) or any(w in _SELF for w in following)), -int(bool(before) and any(w in _IMPERSONAL for w in near[:2])), 0, 0]


def _local_start(text: str, least: int, end: int) -> int:
    """Where the local part that ends at a place begins, however long it is."""
    size = 64
    while True:
        back = text[max(least, end - size) : end][::-1]
        n = _LOCAL.match(back).end()
        if n < len(back) or end - size <= least:
            return end - n
        size *= 2


def _tokens_back(text: str, end: int, n: int, initials: bool = False) -> int:
    """Where the last n blank-separated tokens before a place begin; initials before it don't count, if so asked."""
    at = end
    while n and at:
        while at and text[at - 1] in _GAPS:
            at -= 1
        stop = at
        while at and text[at - 1] not in _GAPS:
            at -= 1
        if not (initials and stop - at == 2 and text[stop - 1] == "."):
            n -= 1
            initials = False
    return at


class _Context:
    """The words of a text and where its sentences begin, read once, when first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ends: list[int] | None = None

    def before(self, start: int) -> list[str]:
        """The last words before a place in its sentence, small, nearest first."""
        if self.ends is None:
            found = [*_NEAR.finditer(self.text)]
            self.words, self.starts, self.ends = [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]
            self.sentences = [m.end() for m in _SENTENCE.finditer(self.text)]
        last = bisect.bisect_right(self.ends, start)
        s = bisect.bisect_right(self.sentences, start)
        first = bisect.bisect_left(self.starts, self.sentences[s - 1]) if s else 0
        return self.words[max(first, last - 4) : last][::-1]

    def following(self, end: int) -> list[str]:
        """The first words after a place in its sentence, small; to be asked for after `before`."""
        i = bisect.bisect_left(self.starts, end)
        s = bisect.bisect_right(self.sentences, end)
        stop = bisect.bisect_left(self.starts, self.sentences[s]) if s < len(self.sentences) else len(self.words)
        return self.words[i : min(i + 3, stop)]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    if not _LOOK.search(text):
        return
    spoken = "dot" in text or "DOT" in text or "Dot" in text
    taken = 0
    for m in _AT.finditer(text):
        word = m[0].strip() in ("at", "AT", "At")
        if word and not spoken:
            continue
        domain = (_SPOKEN_DOMAIN if word else _DOMAIN).match(text, m.end()) or (None if word or not spoken else _SPOKEN_DOMAIN.match(text, m.end()))
        if not domain or (not word and m[0][-1].isspace() and m[0][0] != m[0][-1] and m[0].strip() in "@＠"):
            continue
        start = _local_start(text, taken, m.start())
        while start < m.start() and text[start] in ".'-+":
            start += 1
        if start < m.start():
            yield start, domain.end()
            taken = domain.end()


def _number_at(text: str, at: int) -> tuple[str, bool, int, int] | None:
    """The strictest form that a number around its first digits takes: kind, whether strong, start, end."""
    first = at
    while first and at - first < 6 and "A" <= text[first - 1] <= "Z":
        first -= 1
    starts = []
    if first == at:
        back = at - 1
        if back >= 0 and text[back] in "  " and 2 <= back and text[back - 2 : back].isalpha() and text[back - 2 : back].isascii() and text[back - 2 : back].isupper():
            starts.append(back - 2)
        if back >= 0 and text[back] == "+":
            starts.append(back)
        elif back >= 0 and text[back] == "(":
            starts.append(back)
        starts.append(at)
    else:
        starts.append(first)
    for start in starts:
        before = text[start - 1 : start] if start else ""
        if before and ((before.isalnum() and before.isascii()) or before in "@_/=%&#+$\\" or (before in ".-‑," and start > 1 and text[start - 2].isdigit()) or (before in ".-" and start > 1 and text[start - 2].isalpha() and before == "-")):
            continue
        for kind, strong, pattern in _NUMBERS:
            m = pattern.match(text, start)
            if not m:
                continue
            end = m.end()
            if text[start] == "+" and (digits := re.sub(r"\D", "", m[0].split("ext")[0].replace("(0)", ""))):
                code = next((c for c in (digits[:1], digits[:2], digits[:3]) if c in _NATIONAL), digits[:2])
                most = len(code) + _NATIONAL.get(code, 12)
                while len(re.sub(r"\D", "", text[start:end].split("ext")[0].replace("(0)", ""))) > most and (cut := re.search(rf"{_S}+\d+$", text[start:end])):
                    end = start + cut.start()
                if len(re.sub(r"\D", "", text[start:end])) < 8:
                    continue
            after, next_ = text[end : end + 1], text[end + 1 : end + 2]
            if after and ((after.isalnum() and after.isascii()) or after in "_@=%&/+" or (after in ".,-‑:" and next_.isdigit()) or (after == "-" and next_.isalpha())):
                continue
            return kind, strong, start, end
    return None


def _touch(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of some spans, in order and apart from each other, has a character from start to end."""
    i = bisect.bisect_left(spans, (end,)) - 1
    return i >= 0 and spans[i][1] > start


def scan(text: str, given: frozenset[str]) -> list[Span]:
    """Every candidate of a text, in order of kind."""
    found: list[Span] = []
    context = _Context(text)
    mails: list[tuple[int, int]] = []
    numbers: list[tuple[int, int]] = []
    for start, end in _emails(text):
        before, after = _around(context, start, end)
        found.append(Span("email", start, end, _votes("email", 1, before, context.following(end)), [_shape(text[start:end])[:8], *before[:2]]))
        mails.append((start, end))
    at = 0
    size = len(text)
    while m := _DIGIT.search(text, at):
        start, stop = m.span()
        at = stop
        if start and (c := text[start - 1]) not in " (+\n \t" and ((c.islower() and c.isascii()) or c in "@_=%&#/"):
            continue
        if mails and _touch(mails, start, start + 1):
            continue
        if stop - start <= 5:
            a = _NUMBER_FIRST.match(text, start) if stop < size and (text[stop] in "  ,\n" or text[stop].isalpha()) else None
            begin = start
            if not a and start and text[start - 1] in "  \n/" and (s := _STREET_FIRST.search(text, _tokens_back(text, start, 8), start)):
                a, begin = m, s.start(1)
            if a and not (begin and (text[begin - 1].isalnum() and text[begin - 1].isascii() or text[begin - 1] in ".#-" and begin > 1 and text[begin - 2].isdigit())):
                before, after = _around(context, begin, a.end())
                end = _TAIL.match(text, a.end() if begin == start else _LETTER.match(text, stop).end()).end()
                found.append(Span("address", begin, end, _votes("address", 1, before, context.following(a.end())), [_shape(text[begin : a.end()])[:8], *before[:2]]))
                numbers.append((begin, end))
                at = max(at, end)
                continue
        if number := _number_at(text, start):
            kind, strong, begin, end = number
            before, after = _around(context, begin, end)
            votes = _votes(kind, 1 if strong else 0, before, context.following(end))
            votes[5] = -int(after.isalpha() and after.islower() and after.isascii() and not strong)
            found.append(Span(kind, begin, end, votes, [_shape(text[begin:end]), *before[:3], f"after {after.lower()}" if after.isascii() else ""]))
            numbers.append((begin, end))
            at = max(at, end)
    group = 0
    for m in _TOKEN.finditer(text):
        word = m[0]
        if word.lower() not in given:
            continue
        start, end = m.span()
        if start and (text[start - 1] in "@_.+'’/=" or (text[start - 1].isdigit())) and not (text[start - 1] == "." and start > 1 and not text[start - 2].islower()):
            continue
        if double := _SECOND.match(text, end):  # a double given name
            end = double.end()
        elif start > 1 and text[start - 1] == "-" and text[start - 2].isalpha():
            continue
        if text[end : end + 1] in ("@", "_", "+", "＠", "-", "’") or text[end : end + 1].isdigit() or (text[end : end + 1] == "." and text[end + 1 : end + 2].isalnum()):
            continue
        group += 1
        ahead, behind = _FORWARD.match(text, end), _BACKWARD.search(text, _tokens_back(text, start, 5, True), start)
        for match, back in ((ahead, False), (behind, True)):
            if not match:
                continue
            family = match[2] if back else match[3]
            begin, stop = (match.start(), end) if back else (start, match.end())
            if back and (family.lower() in given or family.lower() in _NO_FAMILY) or _touch(mails, begin, stop) or _touch(numbers, begin, stop):
                continue
            before, after = _around(context, begin, stop)
            strength = bool(match[3] if back else match[1] or match[2]) or "-" in family or "'" in family or "’" in family
            votes = _votes("name", int(strength), before, context.following(stop))
            votes[2] = -int(after.isalpha() and after.islower() and after.isascii() and not _sentence(before))
            titled = bool(before) and before[0] in _NAME_TITLES
            votes[5] = int(titled or text[max(0, begin - 2) : begin].rstrip("  ").endswith((":", "—", "(", "/")) or "\n" in text[max(0, begin - 1) : begin] or ">" in text[max(0, begin - 1) : begin])
            low = family.lower()
            found.append(Span("name", begin, stop, votes, [f"ends {low[-4:]}", f"begins {low[:3]}", f"family {low}", f"back {back} {bool(back and match[3])}", *before[:2], f"after {after.lower()}"], word.lower(), re.split(r"[-‐‑]", low)[-1], group, back and not match[3]))
    return found


def _sentence(before: list[str]) -> bool:
    """Whether the words before a name belong to a sentence about a person."""
    return any(w in _CUES["name"] for w in before[:3])


# ---- HTML ------------------------------------------------------------------------------------------------------------

_MARKUP = re.compile(r"<(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))")
#: What a span has at least one of: a digit, a capital, a sign for at or one that may hold a word for it.
_SIGN = re.compile(r"[0-9A-ZÀ-ÞŁŠŽΑ-ΩА-ЯЁ@＠(\[{<]|\bat\b|&")
_INLINE = frozenset("a abbr b bdi cite code em i mark q s small span strong sub sup u wbr font del ins".split())


class Decoded:
    """A text read from markup, and where its characters are stored."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.places: list[int] = []  # of the text, where each part begins
        self.stored: list[tuple[int, int, bool]] = []  # where it is stored, how long, whether as a reference
        self.size = 0

    def add(self, text: str, at: int, length: int) -> None:
        if text:
            self.parts.append(text)
            self.places.append(self.size)
            self.stored.append((at, length, length != len(text)))
            self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)

    def start(self, place: int) -> int:
        i = bisect.bisect_right(self.places, place) - 1
        at, _, reference = self.stored[i]
        return at if reference else at + place - self.places[i]

    def end(self, place: int) -> int:
        i = bisect.bisect_right(self.places, place - 1) - 1
        at, length, reference = self.stored[i]
        return at + length if reference else at + place - self.places[i]


def _value(raw: str, at: int) -> Decoded:
    out, done = Decoded(), 0
    for m in _REFERENCE.finditer(raw):
        out.add(raw[done : m.start()], at + done, m.start() - done)
        out.add(html.unescape(m[0]), at + m.start(), len(m[0]))
        done = m.end()
    out.add(raw[done:], at + done, len(raw) - done)
    return out


def decode(raw: str) -> list[Decoded]:
    """The text of markup, and each attribute value that may hold text."""
    body, rest, done = Decoded(), [], 0
    for m in _MARKUP.finditer(raw):
        start, end = m.span()
        body.add(raw[done:start], done, start - done)
        done = end
        token = m[0]
        if token[0] == "&":
            body.add(html.unescape(token), start, end - start)
            continue
        name = re.match(r"</?([A-Za-z0-9]*)", token)[1].lower()
        if name not in _INLINE:
            body.add("\n", start, end - start)
        if "=" in token:
            for a in _ATTRIBUTE.finditer(token):
                g = next(i for i in (2, 3, 4) if a[i] is not None)
                if _SIGN.search(a[g]) and a[1].lower() not in _USER_ATTRIBUTES:
                    rest.append(_value(a[g], start + a.start(g)))
    body.add(raw[done:], done, len(raw) - done)
    return [body, *rest]


def scan_html(raw: str, given: frozenset[str]) -> list[Span]:
    """Candidates of markup, at their stored places."""
    if "<" not in raw and "&" not in raw:
        return scan(raw, given)
    found, group = [], 0
    for part in decode(raw):
        top = 0
        for s in scan(part.text(), given):
            top = max(top, s.group)
            s.start, s.end, s.group = part.start(s.start), part.end(s.end), s.group + group
            found.append(s)
        group += top
    return found


# ---- Labels and classifier -------------------------------------------------------------------------------------------

_SMALL = r"(?<![\p{L}\p{N}@＠_.+/\x27’-])\p{Ll}[\p{Ll}\x27’]*+(?![\p{L}\p{N}@＠_+/-])(?!\.[\p{L}\p{N}])"  # a small word by itself; \x27 is an apostrophe
_CANDIDATE = "post_id long, field_name string, kind string, start_at long, end_at long, votes array<int>, features array<int>, given string, family string, grp long, bare boolean"


def names_of(given_names: DataFrame) -> frozenset[str]:
    """The given names, small, from a table of checked size."""
    rows = columns(given_names, "given_name").select(F.lower("given_name").alias("g")).where("g IS NOT NULL AND length(g) > 1").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return frozenset(r.g for r in rows)


def latest_posts(posts: DataFrame) -> DataFrame:
    """post_id, plain_text, cooked of the latest version of each post."""
    rows = columns(posts, "id", "plain_text", "cooked", "updated_at").select("id", "plain_text", "cooked", F.expr("try_cast(updated_at AS timestamp)").alias("at"))
    return latest(rows, "id", "at", ["plain_text", "cooked"]).select(F.col("id").alias("post_id"), "plain_text", "cooked")


def candidates(posts: DataFrame, given: frozenset[str]) -> DataFrame:
    """Every candidate of both fields with its votes and features, written once."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _CANDIDATE.split(", ")]
        for batch in batches:
            rows = []
            for key, plain, cooked in zip(batch["post_id"], batch["plain_text"], batch["cooked"], strict=True):
                for field, text, look_at in (("plain_text", plain, scan), ("cooked", cooked, scan_html)):
                    if text:
                        rows += [(key, field, s.kind, s.start, s.end, s.votes, [zlib.crc32(f"{s.kind} {i if i < 1 else ''} {w}".encode()) % SPACE for i, w in enumerate(s.words)], s.given, s.family, s.group, s.bare) for s in look_at(text, given)]
            yield pd.DataFrame(rows, columns=names)

    return materialize(posts.mapInPandas(look, _CANDIDATE), "pii")


def ordinary_words(posts: DataFrame) -> DataFrame:
    """word, posts: in how many posts each word stands small and by itself (not within an address, a user name or markup)."""
    words = [F.expr(rf"regexp_extract_all({text}, r'{_SMALL}', 0)") for text in ("plain_text", "regexp_replace(cooked, '<[^<>]*>', ' ')")]
    none = F.array().cast("array<string>")
    return posts.select(F.explode(F.array_union(*[F.coalesce(w, none) for w in words])).alias("word")).groupBy("word").agg(F.count("*").alias("posts"))


def with_gazetteer(found: DataFrame, posts: DataFrame) -> DataFrame:
    """Candidates with the vote of the surnames the corpus itself shows, by shares of posts, so that it is alike at every size.

    A word that at most COMMON of the posts with it use as a surname (the others have it small) is none. A word that is
    a surname in at least SURNAME of them is one unless in half of those posts the other votes speak against a person; how
    many given names it follows doesn't count, nor how often. A word before a given name, without a comma, is no surname
    unless it is seen as one elsewhere.
    """
    sum_ = F.aggregate(F.slice("votes", 1, VOTES - 1), F.lit(0), lambda a, v: a + v)
    seen = found.where("kind = 'name' AND NOT bare").groupBy("family", "post_id").agg((F.max(sum_) < 0).alias("thing"))
    names = seen.groupBy("family").agg(F.count("*").alias("uses"), F.count_if("thing").alias("things"))
    names = names.join(ordinary_words(posts).withColumnRenamed("word", "family"), "family", "left")
    share = F.col("uses") / (F.col("uses") + F.coalesce("posts", F.lit(0)))
    vote = F.when(share <= COMMON, -1).when((share >= SURNAME) & (F.col("things") * 2 < F.col("uses")), 1).otherwise(0)
    surnames = materialize(names.select(F.col("family").alias("_f"), vote.alias("_v")), "surnames")
    others = found.where("family IS NULL")  # no name, so nothing to look up: they don't go through the join
    joined = found.where("family IS NOT NULL").join(surnames, F.col("family") == F.col("_f"), "left")
    seen = F.when(F.col("bare") & (F.coalesce("_v", F.lit(0)) < 1), -1).otherwise(F.col("_v"))
    return joined.withColumn("_v", seen).withColumn("votes", F.when(F.col("_v").isNull(), F.col("votes")).otherwise(F.concat(F.slice("votes", 1, VOTES - 1), F.array("_v")))).drop("_f", "_v").unionByName(others)


def weigh(patterns: pd.DataFrame) -> dict[tuple[str, tuple[int, ...]], float]:
    """How likely each pattern of votes (kind, votes, n) is true.

    Each labeler has, for true and for false spans, probabilities of its three votes; they and the share of true spans
    are estimated by expectation-maximisation, with priors by which a vote is rather right than wrong.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind, group in patterns.groupby("kind"):
        votes = np.array([list(v) for v in group["votes"]])
        n = group["n"].to_numpy(dtype=float)
        total = n.sum()
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        prior = np.array([[2.0, 10.0, 8.0], [8.0, 10.0, 2.0]]) * max(0.5, total / 200)  # true, false; as a share of the spans, so that it is as strong at every size
        prior = np.repeat(prior[:, None, :], VOTES, axis=1)
        for labeler in (0, VOTES - 1):  # a strict form is rarely a coincidence, and the corpus knows its surnames
            prior[1, labeler, 2] /= 20
        prior[0, -1, 0] /= 20
        q = 1 / (1 + np.exp(-1.5 * votes.sum(1) - 3 * votes[:, -1] - 0.2))
        for _ in range(EM_STEPS):
            share = ((n * q).sum() + 2) / (total + 4)
            theta = np.stack([np.einsum("i,ijk->jk", n * w, onehot) + p for w, p in ((q, prior[0]), (1 - q, prior[1]))])
            theta /= theta.sum(axis=2, keepdims=True)
            log = np.einsum("ijk,cjk->ci", onehot, np.log(theta)) + np.log([[share], [1 - share]])
            new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        out |= {(kind, tuple(int(x) for x in v)): float(p) for v, p in zip(votes, q, strict=True)}
    return out


@dataclass(frozen=True)
class Classifier:
    """Logistic regression on votes by kind and on hashed features."""

    weights: np.ndarray

    @staticmethod
    def columns(kind: str, votes: list[int], features: list[int]) -> tuple[list[int], list[float]]:
        base = SPACE + KINDS.index(kind) * (VOTES + 1)
        return [*features, *range(base, base + VOTES + 1)], [*[1.0] * len(features), *map(float, votes), 1.0]

    def scores(self, batch: pd.DataFrame) -> np.ndarray:
        w = self.weights
        out = np.empty(len(batch))
        for r, (kind, votes, features) in enumerate(zip(batch["kind"], batch["votes"], batch["features"], strict=True)):
            at, x = self.columns(kind, votes, features)
            out[r] = w[at] @ np.array(x)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(sample: pd.DataFrame, likely: dict[tuple[str, tuple[int, ...]], float], steps: int = 300) -> Classifier:
    """The classifier of labelled candidates: batch gradient descent with momentum, targets the estimated probabilities."""
    dim = SPACE + len(KINDS) * (VOTES + 1)
    rows, cols, vals, target = [], [], [], np.zeros(len(sample))
    for r, (kind, votes, features) in enumerate(zip(sample["kind"], sample["votes"], sample["features"], strict=True)):
        at, x = Classifier.columns(kind, votes, features)
        rows += [r] * len(at)
        cols += at
        vals += x
        target[r] = likely[kind, tuple(int(v) for v in votes)]
    rows_, cols_, vals_ = np.array(rows, dtype=int), np.array(cols, dtype=int), np.array(vals)
    w, speed = np.zeros(dim), np.zeros(dim)
    for kind in range(len(KINDS)):
        w[SPACE + kind * (VOTES + 1) : SPACE + (kind + 1) * (VOTES + 1)] = 1.0
    n = np.maximum(np.bincount(cols_, minlength=dim), 1.0) if len(cols_) else np.ones(dim)
    for _ in range(steps if len(sample) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows_, weights=w[cols_] * vals_, minlength=len(sample)), -40, 40)))
        gradient = np.bincount(cols_, weights=(p - target)[rows_] * vals_, minlength=dim) / np.sqrt(n) / np.sqrt(len(sample)) + 1e-3 * w
        speed = 0.9 * speed - 0.5 * gradient
        w = w + speed
    return Classifier(w)


def spans(posts: DataFrame, given_names: DataFrame) -> DataFrame:
    """post_id, field_name, kind, start_at, end_at, score of every span that the classifier takes for personal information."""
    versions = latest_posts(posts)
    found = with_gazetteer(candidates(versions, names_of(given_names)), versions)
    patterns = found.groupBy("kind", "votes").agg(F.count("*").alias("n")).toPandas()  # at most 3 ** VOTES rows a kind
    likely = weigh(patterns)
    rank = F.xxhash64("kind", "post_id", "field_name", "start_at")
    sample = found.select("kind", "votes", "features", rank.alias("r"))
    shares = patterns.groupby("kind")["n"].sum()
    chosen = None
    for kind in sorted(shares.index):
        share = min(1.0, 1.1 * FITTED / shares[kind])  # so that no task sends more than it must
        part = sample.where((F.col("kind") == kind) & (F.pmod("r", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).orderBy("r").limit(FITTED)
        chosen = part if chosen is None else chosen.unionByName(part)
    model = fit(chosen.drop("r").toPandas() if chosen is not None else pd.DataFrame({"kind": [], "votes": [], "features": []}), likely)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = model.scores(batch) if len(batch) else []
            yield batch.loc[batch["score"] >= 0.5, ["post_id", "field_name", "kind", "start_at", "end_at", "grp", "score"]]

    kept = found.select("post_id", "field_name", "kind", "start_at", "end_at", "votes", "features", "grp").mapInPandas(decide, "post_id long, field_name string, kind string, start_at long, end_at long, grp long, score double")
    place = F.when(F.col("kind") == "name", F.col("grp")).otherwise(F.col("start_at"))
    best = kept.groupBy("post_id", "field_name", "kind", place.alias("place")).agg(F.max(F.struct("score", "start_at", "end_at")).alias("b"))
    return best.select("post_id", "field_name", "kind", "b.start_at", "b.end_at", "b.score")


def found(posts: DataFrame, given_names: DataFrame) -> DataFrame:
    """p2_found: post_id, field_name, kind, start_at."""
    return spans(posts, given_names).select("post_id", "field_name", "kind", "start_at").distinct()


_TAG = re.compile(r"<[^<>]*>")


def replaced(text: str | None, marks: list) -> str | None:
    """A field with its spans replaced by placeholders; tags within a span stay."""
    if text is None or marks is None or not len(marks):
        return text
    out, done = [], 0
    for m in sorted(marks, key=lambda m: (m["start_at"], -m["end_at"])):
        if m["start_at"] < done:
            continue
        out += [text[done : m["start_at"]], PLACEHOLDERS[m["kind"]], *_TAG.findall(text[m["start_at"] : m["end_at"]])]
        done = m["end_at"]
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def _replaced(texts: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([replaced(t, m) for t, m in zip(texts, marks, strict=True)])


def redacted(posts: DataFrame, given_names: DataFrame) -> DataFrame:
    """post_id, plain_text, cooked with placeholders, and the number of spans, of every post."""
    marks = spans(posts, given_names).groupBy("post_id").agg(*[F.collect_list(F.when(F.col("field_name") == f, F.struct("start_at", "end_at", "kind"))).alias(f"{f}_marks") for f in ("plain_text", "cooked")])
    joined = latest_posts(posts).distinct().join(marks, "post_id", "left")
    n = sum((F.coalesce(F.size(F.col(f"{f}_marks")), F.lit(0)) for f in ("cooked",)), F.coalesce(F.size("plain_text_marks"), F.lit(0)))
    return joined.select("post_id", _replaced("plain_text", "plain_text_marks").alias("plain_text"), _replaced("cooked", "cooked_marks").alias("cooked"), n.cast("long").alias("spans"))
