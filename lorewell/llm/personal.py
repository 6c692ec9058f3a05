"""Personal information in free text, found and replaced with typed placeholders.

Offset-preserving deobfuscation: transducers rewrite a text character by character (full-width and look-alike
letters, invisible characters, spelled digits, "at" and "dot" in words) and keep for every character of the
result the span of the source it stands for. Identifiers are detected in the rewritten text, and their spans
are mapped back, so the rest of the source stays exactly as it was.

A cheap pattern in the JVM first drops texts that hold nothing that could start a detector (no digit, no
at-sign or disguise, no two capitalised words in a row, no part of a known name, plain ASCII), so only the rest is sent to Python.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
#: Decides nothing any more: any number of names meets the words of the texts in one join. Tests still set it.
MAX_PEOPLE = 5_000

# Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјкорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABESIJKMHOPCTYXaesijkopcyxdqwhABEZHIKMNOPTYXovp", strict=True))
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_INVISIBLE = set("\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
_SPACES = set("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000")
_DASHES = set("\u2010\u2011\u2012\u2013\u2212")

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_%+-])?"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_BRACKET_AT = r"(?:\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s*@\s*)"
_SPELLED_DOT = r"(?:\s*[(\[{<]\s*dot\s*[)\]}>]\s*|\s+dot\s+)"
# A bare "at" counts only before a host whose dots are spelled as well.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+'-])(?P<local>{_LOCAL}(?:{_SPELLED_DOT}{_LOCAL}){{0,3}})"
    rf"(?:(?P<at>{_BRACKET_AT})(?P<host>{_HOST}(?:(?:{_SPELLED_DOT}|\.){_HOST})+)|(?P<bare>\s+at\s+)(?P<far>{_HOST}(?:{_SPELLED_DOT}{_HOST})+))(?![A-Za-z0-9])",
    re.I,
)
_DOTS = re.compile(_SPELLED_DOT, re.I)
_DIGIT_RUN = re.compile(r"\b(?:%s)(?:[\s-]+(?:%s)){4,}\b" % (("|".join(DIGIT_WORDS),) * 2), re.I)
_DIGIT_WORD = re.compile("|".join(DIGIT_WORDS), re.I)

EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+'@/-])(?:mailto:)?{_LOCAL}@{_HOST}(?:\.{_HOST})*\.[A-Za-z]{{2,}}(?![A-Za-z0-9@])")
#: Words before a bare number that say whether it is a phone number.
_PHONE_WORD = r"(?:call|called|phone|telephone|tel|ring|mobile|cell|text|dial|reach|fax|whatsapp|hotline|extension|number is|at)"
_OTHER_NUMBER = re.compile(r"(?i)\b(?:build|version|release|revision|commit|ticket|issue|order|invoice|ref|reference|id|job|run|line|port|pid|serial|case|item|part|sku|record|row|offset|size|bytes)\s*(?:no\.?|number)?\s*[#:=]?\s*\Z")
_CUED_PHONE = re.compile(rf"(?i)(?<!\w){_PHONE_WORD}(?:\s+(?:me|us|him|her|them|on|at|is|no\.?|number))*[:\s]\s*(\(?[2-9]\d{{2}}\)?[\s.-]?\d{{3}}[\s.-]?\d{{4}})(?!\w|[.,:/-]\d)")
PHONE = re.compile(
    r"(?<![\w.,:/+-])(?:tel:)?(?:"
    r"(?:\+|00)[1-9]\d{0,2}[\s.-]?(?:\(0?\d{1,4}\)[\s.-]?)?\d{1,5}(?:[\s./-]?\d{2,8}){1,4}"
    r"|\(0?\d{2,5}\)[\s.-]?\d{2,4}(?:[\s.-]\d{3,4}){1,2}"
    r"|0\d{2,4}(?:[\s/-]\d{3,4}[\s-]\d{3,4}|/\d{6,8})|0\d{9,10}"
    r"|1-\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{2}-\d{3}-\d{4}"
    r")(?:\s*(?:ext\.?|x|extension)\s*\d{1,5})?(?![\w]|[.,:/-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w-])(?:"
    r"\d{3}-\d{2}-\d{4}"
    r"|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"
    r"|(?i:social security (?:number|no\.?)|ssn)[:#]?\s*\d{3}[\s-]?\d{2}[\s-]?\d{4}"
    r"|(?i:tax (?:id|no\.?|number)|steuer-?id|nif|tin)[:#]?\s*[A-Z]?\d(?:[\s-]?\d){7,12}[A-Z]?"
    r"|(?i:personal (?:id|no\.?|number)|national (?:id|insurance number))[:#]?\s*[A-Z0-9]{2,6}[/\s-]?\d{2,6}(?:[/\s-]?[A-Z0-9]{1,4})?"
    r"|(?i:driving licen[cs]e|driver'?s licen[cs]e)(?:\s*(?i:no\.?|number))?[:#]?\s*[A-Z]{1,5}[\s-]?\d{5,9}[A-Z0-9]{0,5}"
    r"|(?i:passport)(?:\s*(?i:no\.?|number))?[:#]?\s*[A-Z]{0,2}\d{6,9}"
    r"|(?i:id card|identity card)(?:\s*(?i:no\.?|number))?[:#]?\s*[A-Z]?\d{6,9}(?:-?[A-Z])?"
    r")(?![\w-]|/\d)"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zA-ZÀ-ÖØ-öø-ÿ'’-]+"
_CITY = rf"{_CAP}(?:\s{_CAP})?"
_ROAD = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Drive|Dr|Court|Ct|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Crescent|Row)\b\.?"
ADDRESS = re.compile(
    r"(?<![\w])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\w{{1,4}},\s*)?\d{{1,5}}[a-z]?\s+(?:[NSEW]{{1,2}}\s+)?{_CAP}(?:\s{_CAP})?\s+{_ROAD}(?:,?\s+{_CITY},?\s+(?:[A-Z]{{2}}\s+)?\d{{4,5}})?"
    rf"|{_CAP}(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)\s+\d{{1,4}}\s?[a-z]?(?:,\s*\d{{5}}\s+{_CITY})?"
    rf"|(?:[A-ZÀ-ÖØ-Þ][a-zà-ÿ]+\s)?[A-ZÀ-ÖØ-Þ][a-zà-ÿ]*(?:straße|strasse)\s+\d{{1,4}}\s?[a-z]?(?:,\s*\d{{5}}\s+{_CITY})?"
    rf"|\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s+(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Ii]mpasse|[Qq]uai)\s+(?:de\s+la\s+|de\s+|du\s+|des\s+|d['’])?{_CITY}(?:,\s*\d{{5}}\s+{_CITY})?"
    rf"|(?:[Uu]l|[Aa]l|[Pp]l|[Oo]s)\.\s+{_CITY}\s+\d{{1,4}}\s?[a-z]?(?:/\d{{1,4}})?(?:,\s*\d{{2}}-?\d{{3}}\s+{_CITY})?"
    rf"|(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|C/)\s+(?:de\s+(?:la\s+)?)?{_CITY},?\s+\d{{1,4}}(?:,\s*(?:\d{{5}}\s+)?{_CITY})?"
    r")(?!\w)"
)
_T = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)?"
_U = r"[A-ZÀ-ÖØ-Þ]{3,}(?:[-'’][A-ZÀ-ÖØ-Þ]{2,})?"
_NAME_FORM = rf"(?:{_T}\s(?:[A-ZÀ-ÖØ-Þ]\.\s)?{_T}|{_U}\s(?:[A-ZÀ-ÖØ-Þ]\.\s)?{_U}|{_T},\s{_T}|{_U},\s{_U}|(?:[A-ZÀ-ÖØ-Þ]\.\s?){{1,2}}(?:{_T}|{_U}))"
_CANDIDATE = re.compile(rf"(?<![\w.'’-])(?=({_NAME_FORM})(?!\w))")
# Words that introduce or follow a person's name.
_CALLED = r"[Mm]y name is|[Tt]his is|(?:customer|user|client|person|colleague|contact|manager|engineer|reviewer|author|owner|patient|student|teacher) (?:is called|is|named)|[Nn]amed|[Cc]alled"
_TITLE = r"Mr\.?|Mrs\.?|Ms\.?|Miss|Mx\.?|Dr\.?|Prof\.?|Sir|Herr|Frau|M\.|Mme|Señor|Señora|Sig\.?|Pan|Pani"
_GREETING = r"(?:[Kk]ind |[Bb]est |[Ww]arm )?[Rr]egards,|[Bb]est,|[Tt]hanks,|[Cc]heers,|[Ss]incerely,|[Yy]ours,|[Dd]ear|[Hh]i|[Hh]ello|[Tt]hanks to"
_TOWARDS = (
    r"[Ss]igned(?: off)? by|[Aa]ssigned to|[Pp]aired with|(?:[Rr]eviewed|[Rr]eported|[Ww]ritten|[Aa]pproved|[Ss]ent|[Cc]reated|[Ff]iled|[Oo]wned|[Rr]aised|[Rr]equested) by|[Pp]ing(?:ed)?|[Aa]sk(?:ed)?|[Tt]ell|[Tt]old|[Cc][Cc]"
    r"|[Mm]eet|[Mm]et(?: with)?|[Cc]ontact(?:ed)?|[Ee]mail(?:ed)?|[Cc]all|[Vv]isit(?:ed)?|[Ss]poke (?:to|with)|[Tt]alk(?:ed)? (?:to|with)|[Hh]eard from|[Mm]y (?:colleague|friend|boss|manager|wife|husband|brother|sister|son|daughter)"
)
_BEFORE = rf"(?:{_CALLED}|[Ii] am|{_TITLE}|{_GREETING}|{_TOWARDS})"
_SPOKE = r"(?:said|says|noted|wrote|writes|told|asked|mentioned|confirmed|reported|replied|answered|explained|suggested|agreed|disagreed|added|pointed|called|emailed|insisted|claimed|thinks|thought|lives|moved|joined|left|works|worked)\b"
# Capitalised words that are no part of a person's name.
_NO_NAME = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "the this that these those a an and or but if when while with from for your our my his her its their all any no yes not new old main next last first second every each some "
    "visual studio android google microsoft apple amazon azure windows linux ubuntu debian docker kubernetes github gitlab jira slack chrome firefox safari java python node react spring apache spark kafka hadoop postgres mysql redis "
    "mongo excel word power point team teams support help desk service server client customer user admin system data base cloud code review pull request merge release version build test unit project product manager office "
    "north south east west new york london paris berlin united states kingdom europe america asia africa street road avenue lane customer success human resources quality assurance machine learning open source".split()
)
_INTRODUCED = re.compile(rf"(?<!\w){_BEFORE}\s+(?:(?:{_TITLE})\s+)?({_NAME_FORM})(?!\w)")
_FOLLOWED = re.compile(rf"(?<![\w.'’-])(?=({_NAME_FORM})(?!\w)\s+{_SPOKE})")
_SPLIT_NAME = re.compile(r"[\s,]+")
# Names in lower case: known parts beside one another, or two words that are introduced or speak and of which the second ends like a known family name.
_W = r"[^\W\d_]{3,}(?:[-'’][^\W\d_]+)?"
_LOW_WORD = re.compile(r"(?<![\w.@+'’-])" + _W + r"(?![\w@+])")
_LOW_NEXT = re.compile(rf"(?:\s[^\W\d_]\.)?\s({_W})(?![\w@+])")
_LOW_INITIAL_BEFORE = re.compile(r"(?<![\w.])[^\W\d_]\.\s\Z")
_LOW_PAIR = rf"{_W}\s(?:[^\W\d_]\.\s)?{_W}"
_LOW_FRAMED = re.compile(
    rf"(?<![\w.@+'’-])(?:as|ping|cc|dear|my name is|is called|named)\s({_LOW_PAIR})(?=\s+(?:{_SPOKE}|about\b)|[.,;:!?)]|\s*\Z)|(?<![\w.@+'’-])({_LOW_PAIR})(?=\s+(?:said|wrote|replied|told)\b)", re.I
)
HINT = (
    r"[0-9@＠]|[^\x00-\x7F]|(?i:[(\[{<\s]at[)\]}>\s])|\p{Lu}[\p{L}.'-]*,?\s+\p{Lu}"
    r"|(?i:\b(?:said|wrote|replied|told|as|ping|cc|dear|my name is|is called|named)\b)"
    r"|(?i:\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\s-]+(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b)"
)


class Rewritten:
    """A rewritten text and, for stretches of it, the source offsets."""

    def __init__(self, text: str):
        self.text = text
        #: Starts in the text, and for each the start in the source and whether the stretch runs in step with it.
        self.steps: list[tuple[int, int, int]] = [(0, 0, 1)]

    def replace(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replaces disjoint, ordered spans. A replaced stretch stands for its whole source span."""
        edits = list(edits)
        if not edits:
            return
        parts: list[str] = []
        steps: list[tuple[int, int, int]] = []
        out = at = 0

        def copy(a: int, b: int) -> None:
            nonlocal out
            if a >= b:
                return
            k = bisect_right(self.steps, (a, 1 << 60, 1)) - 1
            p = a
            while p < b:
                start, src, moving = self.steps[k]
                stop = self.steps[k + 1][0] if k + 1 < len(self.steps) else len(self.text)
                q = min(b, stop)
                steps.append((out + p - a, src + (p - start if moving else 0), moving))
                p, k = q, k + 1
            parts.append(self.text[a:b])
            out += b - a

        for a, b, new in edits:
            copy(at, a)
            if new:
                steps.append((out, self.source(a), 0))
                parts.append(new)
                out += len(new)
            at = b
        copy(at, len(self.text))
        self.end_source = self.source_end()
        self.text, self.steps = "".join(parts), steps or [(0, 0, 1)]

    def source_end(self) -> int:
        return getattr(self, "end_source", len(self.text))

    def source(self, at: int) -> int:
        """Where the source span of the character at ``at`` starts."""
        if at >= len(self.text):
            return self.source_end()
        start, src, moving = self.steps[bisect_right(self.steps, (at, 1 << 60, 1)) - 1]
        return src + (at - start if moving else 0)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The source span of text[a:b]; what was dropped behind its last character does not belong to it."""
        start = self.source(a)
        k = bisect_right(self.steps, (b - 1, 1 << 60, 1)) - 1
        first, src, moving = self.steps[k]
        if moving:
            return start, src + (b - 1 - first) + 1
        after = self.steps[k + 1][1] if k + 1 < len(self.steps) else self.source_end()
        return start, after


def _plain(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def rewrite(text: str) -> Rewritten:
    r = Rewritten(text)
    if not text.isascii():
        edits = []
        for i, c in enumerate(text):
            o = ord(c)
            if o < 128:
                continue
            if 0xFF01 <= o <= 0xFF5E:
                edits.append((i, i + 1, chr(o - 0xFEE0)))
            elif c in _INVISIBLE:
                edits.append((i, i + 1, ""))
            elif c in _SPACES:
                edits.append((i, i + 1, " "))
            elif c in _DASHES:
                edits.append((i, i + 1, "-"))
            elif c in LOOKALIKE and (text[max(0, i - 3) : i] + text[i + 1 : i + 4]).isascii():
                edits.append((i, i + 1, LOOKALIKE[c]))
            elif c.isdecimal():
                edits.append((i, i + 1, str(int(c))))
        r.replace(edits)
    low = r.text.lower()
    if " at " in low or "at)" in low or "at]" in low or "at}" in low or "at>" in low or " @" in low or "@ " in low or "dot" in low:
        edits = []
        for m in _DISGUISED.finditer(r.text):
            sign, host = ("at", "host") if m["at"] else ("bare", "far")
            if m[sign].strip() == "@" and (m[sign] != "@" or not _DOTS.search(m[0])) and not _DOTS.search(m[host]):
                continue  # a plain address, or a handle between words
            edits += [(m.start("local") + d.start(), m.start("local") + d.end(), ".") for d in _DOTS.finditer(m["local"])]
            edits.append((*m.span(sign), "@"))
            edits += [(m.start(host) + d.start(), m.start(host) + d.end(), ".") for d in _DOTS.finditer(m[host])]
        r.replace(edits)
        low = r.text.lower()
    if any(w in low for w in ("seven", "three", "eight", "four", "five", "nine", "zero", "six", "two", "one")):
        edits = []
        for m in _DIGIT_RUN.finditer(r.text):
            edits.append((*m.span(), "".join(DIGIT_WORDS[w.lower()] for w in _DIGIT_WORD.findall(m[0]))))
        r.replace(edits)
    return r


class Detector:
    """``given`` and ``family``: known names, any case; the list need not be complete."""

    def __init__(self, given: Iterable[str] = (), family: Iterable[str] = ()):
        self.given = {g.lower() for g in given if g}
        self.family = {f.lower() for f in family if f}
        #: How known family names end; tells an unknown one in lower case from other words.
        self.endings = {_plain(f)[-2:] for f in self.family if len(f) >= 5}

    def _known(self, form: str) -> bool:
        parts = [p for p in _SPLIT_NAME.split(form.lower()) if p]
        full = [p for p in parts if not p.endswith(".") and len(p) > 1]
        if "," in form:
            return full[0] in self.family or full[-1] in self.given
        if len(full) == 1:
            return full[0] in self.family
        return full[-1] in self.family or full[0] in self.given

    def _lower_case(self, norm: str) -> Iterator[tuple[int, int]]:
        for m in _LOW_FRAMED.finditer(norm):
            k = next(g for g in range(1, 3) if m[g])
            words = _SPLIT_NAME.split(m[k].lower())
            if _plain(words[-1])[-2:] in self.endings and not _NO_NAME.intersection(words):
                yield m.span(k)
        for m in _LOW_WORD.finditer(norm):
            word, (a, b) = m[0].lower(), m.span()
            if word in self.given:
                after = _LOW_NEXT.match(norm, b)
                if after and (after[1].lower() in self.family or len(after[1]) >= 6 and _plain(after[1])[-2:] in self.endings and after[1][0].isupper() == m[0][0].isupper()):
                    yield a, after.end()
                elif (start := _family_before(norm, a)) is not None and norm[start : a - 2].lower() in self.family:
                    yield start, b
            elif word in self.family and (first := _LOW_INITIAL_BEFORE.search(norm, max(0, a - 4), a)):
                yield first.start(), b

    def knowing(self, given: Iterable[str] | None, family: Iterable[str] | None) -> Detector:
        """The same detector with the known names that one text holds."""
        d = Detector.__new__(Detector)
        d.given, d.family, d.endings = set(given if given is not None else ()), set(family if family is not None else ()), self.endings
        return d

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """Disjoint spans (start, end, kind) of the source, in order. Null and empty texts have none."""
        if not text:
            return []
        r = rewrite(text)
        norm = r.text
        found: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(a: int, b: int, kind: str) -> None:
            if kind == "address":  # its last word may belong to what follows
                b = min([b, *(x for x, _ in taken if a < x < b)])
                b = a + len(norm[a:b].rstrip(" \t\n,;<(\"'"))
            if any(a < y and x < b for x, y in taken):
                return
            taken.append((a, b))
            found.append((*r.span(a, b), kind))

        if "@" in norm:
            for m in EMAIL.finditer(norm):
                add(*m.span(), "email")
        if any(c.isdigit() for c in norm):
            for pattern, kind in ((ID_NUMBER, "id_number"), (ADDRESS, "address"), (PHONE, "phone")):
                for m in pattern.finditer(norm):
                    if kind == "phone" and (not 7 <= sum(c.isdigit() for c in m[0]) <= 17 or m[0].isdigit() and _OTHER_NUMBER.search(norm, max(0, m.start() - 40), m.start())):
                        continue
                    add(*m.span(), kind)
            for m in _CUED_PHONE.finditer(norm):
                add(*m.span(1), "phone")
        for pattern in (_INTRODUCED, _FOLLOWED):
            for m in pattern.finditer(norm):
                if not _NO_NAME.intersection(_SPLIT_NAME.split(m[1].lower())) or self._known(m[1]):
                    add(*m.span(1), "name")
        for m in _CANDIDATE.finditer(norm):
            if self._known(m[1]):
                add(*m.span(1), "name")
        for a, b in self._lower_case(norm):
            add(a, b, "name")
        found.sort()
        out: list[tuple[int, int, str]] = []
        for f in found:
            if not out or f[0] >= out[-1][1]:
                out.append(f)
        return out

    def mask(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with placeholders, and the kinds it holds."""
        spans = self.find(text)
        if not spans:
            return text, []
        parts, at = [], 0
        for a, b, kind in spans:
            parts += [text[at:a], PLACEHOLDER[kind]]
            at = b
        parts.append(text[at:])
        return "".join(parts), sorted({k for _, _, k in spans})


def _family_before(text: str, at: int) -> int | None:
    """Where a word of letters starts that stands before ", " at a place; None if there is none."""
    if at < 3 or not text[at - 1].isspace() or text[at - 2] != ",":
        return None
    k = at - 2
    while k and (text[k - 1].isalpha() or text[k - 1] in "-'’"):
        k -= 1
    return k if k < at - 2 and not (k and (text[k - 1].isdigit() or text[k - 1] in "_.@+")) else None


def hinted(column: str | Column) -> Column:
    """Whether a text could hold anything at all; drops most rows before they leave the JVM."""
    return (F.col(column) if isinstance(column, str) else column).rlike(HINT)


def _folding() -> tuple[str, str]:
    """Characters and their replacements, those without one last: what ``rewrite`` may turn into one another becomes the same lower-case letter."""
    same: dict[str, str] = {}

    def head(c: str) -> str:
        while same.get(c, c) != c:
            c = same[c]
        return c

    for a, b in [*LOOKALIKE.items(), ("ς", "σ")]:
        x, y = head(a.lower()), head(b.lower())
        same[max(x, y)] = min(x, y)
    to = {c: head(c) for c in same} | {chr(o): head(chr(o - 0xFEE0).lower()) for o in range(0xFF01, 0xFF5F)} | dict.fromkeys(_SPACES, " ") | dict.fromkeys(_DASHES, "-")
    return "".join([*to, *sorted(_INVISIBLE)]), "".join(to.values())


_FROM, _TO = _folding()
_LETTER = r"[\p{L}\p{Nl}\p{No}]"


def folded(text: Column) -> Column:
    """Lower case with look-alike characters made one; equal for a text and its rewritten form, but for spelled signs and digits."""
    return F.translate(F.lower(text), _FROM, _TO)


def tokens(column: str) -> Column:
    """Every folded word of a text that a detector may look up: whole ones, their parts between apostrophes and hyphens, and two such parts in a row."""
    text = folded(F.col(column))
    inner = F.concat(F.split(text, r"[^\p{L}\p{Nl}\p{No}]+"), F.regexp_extract_all(text, F.lit(rf"(?<!{_LETTER})(?=({_LETTER}+['’-]{_LETTER}+)(?!{_LETTER}))"), F.lit(1)))
    whole = F.split(text, r"[^\p{L}\p{Nl}\p{No}'’-]+")
    return F.when(text.rlike("['’-]"), F.concat(whole, inner)).otherwise(whole)


def masked(texts: DataFrame, people: DataFrame | None) -> DataFrame:
    """(source_field, record_key, part, masked, kinds): rows of ``texts`` that hold personal information.

    ``texts`` has source_field, record_key, part (the place inside the record) and text; ``people`` given_name and
    family_name of known persons, any number. Repeated rows give repeated rows; nulls and empty texts none. The
    words of the texts are joined with the names in a form that is the same before and after rewriting, and each
    text brings the names it holds to the detector.
    """
    out = "source_field string, record_key string, part int, masked string, kinds array<string>"
    columns = ["source_field", "record_key", "part", "masked", "kinds"]
    base = Detector()
    keyed = texts.where("text <> ''").select("source_field", "record_key", "part", "text")
    if people is None:
        none = F.lit(None).cast("array<string>")
        rows = keyed.where(hinted("text")).select("*", none.alias("given"), none.alias("family"))
    else:
        parts = people.select(F.inline(F.array(*[F.struct(F.lower(c).alias("name"), F.lit(k).alias("what")) for c, k in (("given_name", "given"), ("family_name", "family"))]))).where("name <> ''").distinct()
        # Endings of two letters: their number has a bound, whatever the number of names.
        family = parts.where("what = 'family' and length(name) >= 5")
        ends = [r[0] for r in family.select(F.right(F.regexp_replace("name", r"\p{M}", ""), F.lit(3)).alias("e")).distinct().collect()]
        base.endings = {_plain(e)[-2:] for e in ends}
        keyed = keyed.withColumn("h", F.unhex(F.md5("text")))
        held = keyed.select("h", F.explode(F.array_distinct(tokens("text"))).alias("word")).where("word <> ''").join(parts.withColumn("word", folded(F.col("name"))), "word")
        held = held.groupBy("h").agg(F.collect_set(F.when(F.col("what") == "given", F.col("name"))).alias("given"), F.collect_set(F.when(F.col("what") == "family", F.col("name"))).alias("family"))
        rows = keyed.join(held, "h", "left").where(hinted("text") | F.col("given").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(f, k, p, *base.knowing(g, n).mask(t)) for f, k, p, t, g, n in zip(b["source_field"], b["record_key"], b["part"], b["text"], b["given"], b["family"], strict=True)]
            yield pd.DataFrame([r for r in found if r[4]], columns=columns)

    return rows.select("source_field", "record_key", "part", "text", "given", "family").mapInPandas(run, out)


def project_texts(messages: DataFrame, experiences: DataFrame) -> DataFrame:
    """The free texts of the project's tables."""
    m = messages.select(F.lit("content").alias("source_field"), F.col("message_id").cast("string").alias("record_key"), F.lit(0).alias("part"), F.col("content").alias("text"))
    e = experiences.select(F.lit("evidence").alias("source_field"), F.col("id").alias("record_key"), F.posexplode("evidence").alias("part", "text"))
    return m.unionByName(e).where("text is not null")
