"""Text that was decoded with a wrong character encoding: found, and restored where it can be.

Garbled sequences are precomputed for all pairs of encodings and matched with one multi-pattern automaton:

* every character of the alphabets below, encoded as UTF-8 (once or twice) and read in a single-byte
  encoding, is a sequence of two or more characters that correct text does not hold;
* frequent words of several languages, encoded in one single-byte encoding and read in another, matched as
  whole tokens;
* the marks that a letter becomes in a single-byte mix-up where it stands for no letter, matched between
  letters. One such mark is no sign, as correct text has a mark between letters too (a formula, a bullet, a
  trade mark). A line counts if some pair of encodings explains at least ``MARKS`` different marks in it, all as
  letters of one alphabet and of fitting case, and leaves no mark of another kind inside a word.

The words and marks of a line tell the pair, with which its garbled tokens are restored. Replacement characters
show a loss that cannot be undone. Only matched spans are replaced; correct text beside them stays untouched.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The characters that are looked for behind UTF-8 read in a single-byte encoding.
LATIN = "¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"
EXTENDED = "ĄąĆćĘęŁłŃńŚśŹźŻżČčĎďĚěŇňŘřŠšŤťŮůŽžĂăȘșȚțŐőŰűĞğİıŞşŒœŸ"
CYRILLIC = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюяЁёЄєІіЇїҐґ"
PUNCTUATION = "–—‘’‚“”„†‡•…‰‹›€™←→√≈≠≤≥∞─│┌┐└┘├┤┬┴┼═║╔╗╚╝ ­​﻿"
UTF8_READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "cp1250", "cp852", "cp866", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "koi8-r", "mac-roman"]
SINGLE_BYTE = {
    "cyrillic": (["cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic"], ["cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic"]),
    "central": (["cp1250", "iso8859-2", "cp852"], ["cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1251", "iso8859-2", "cp1250"]),
    "western": (["cp1252", "cp437", "cp850", "mac-roman"], ["cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1250", "cp1251", "cp866", "koi8-r", "iso8859-2"]),
}
# Frequent words with letters beyond a-z.
FREQUENT = {
    "cyrillic": "в и с не на что это как но он она они мы вы по из за от до для так все всё ещё еще уже или если когда тогда был была было были будет есть нет при без над под очень тоже также после перед только можно надо где там здесь который которые чтобы потому",
    "central": "się są że też już być był była było będzie będą może także więc przez proszę dziękuję można który która które gdyż jeśli żeby nią oraz ją tę za świat człowiek książka žádný být není také které může více když až jsou říká příliš děkuji són től hogy és így még már több között után",
    "western": "où été être même très après déjà à là ça français où voilà élève père mère für über können müssen möchte schön groß straße natürlich während später también más está están qué él día año señor aquí así después según niño español não são também você está até é então coração você però così perché più già città år på är för också då får så också här även först älskar",
}
# Blanks that are not ASCII may be garbled letters, so they do not end a token.
_TOKEN = re.compile(r"[^ \t\n\r\f\v!\"#$%&()*+,/:;<=>?@\[\\\]^_`{|}~-]+")
# Signs that correct text sets between or around words.
TYPOGRAPHIC = "’‘“”„‚‹›«»–—…•·™®©°"
#: Different marks that one pair of encodings must explain in a line.
MARKS = 2
NON_ASCII = re.compile(r"[^\x00-\x7f]")
LOST = "�"


def _read(data: bytes, encoding: str) -> str | None:
    """Bytes read in an encoding; those that cp1252 and its like leave undefined become control characters, as most decoders do."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257"):
            return None
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)


def _write(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257"):
            return None
        out = bytearray()
        for c in text:
            try:
                out += c.encode(encoding)
            except UnicodeEncodeError:
                if not 0x80 <= ord(c) < 0xA0:
                    return None
                out.append(ord(c))
        return bytes(out)


@functools.cache
def garbled_sequences() -> dict[str, str]:
    """Garbled sequence -> original character, for UTF-8 read in a single-byte encoding, up to three times over."""
    out: dict[str, str] = {}
    for encoding in UTF8_READ_AS:  # where two encodings give one sequence, the first of the list counts
        for c in LATIN + EXTENDED + CYRILLIC + PUNCTUATION:
            text = c
            for _ in range(3 if encoding in ("cp1252", "latin-1") else 1):
                text = _read(text.encode("utf-8"), encoding)
                if text is None or len(text) < 2 or text.isascii():
                    break
                out.setdefault(text, c)
    # A Cyrillic letter as UTF-8 read in cp1251 or cp866 is two Cyrillic characters, which real text may hold; two letters in a row must agree.
    single = {t: c for t, c in out.items() if not (c in CYRILLIC and re.fullmatch(r"[А-Яа-яЁё][Ѐ-ӿ‚„…†‡‰‹›‘’“”•–—™ ¤¦§©«¬­®°±µ¶·»№]", t))}
    return single


@functools.cache
def _cyrillic_pairs() -> dict[str, str]:
    """Two characters of UTF-8 Cyrillic read in cp1251 -> the letter."""
    return {t: c for c in CYRILLIC if (t := _read(c.encode("utf-8"), "cp1251"))}


@functools.cache
def _cyrillic_run() -> re.Pattern:
    return re.compile("(?:" + "|".join(map(re.escape, _cyrillic_pairs())) + "){2,}")


@functools.cache
def garbled_words() -> dict[str, tuple[str, str]]:
    """Garbled token -> (true encoding, wrong encoding)."""
    natural = {v for words in FREQUENT.values() for w in words.split() for v in (w, w.capitalize(), w.upper())}
    out: dict[str, tuple[str, str]] = {}
    for group, (true, wrong) in SINGLE_BYTE.items():
        for word in FREQUENT[group].split():
            for variant in {word, word.capitalize()}:
                for t in true:
                    data = _write(variant, t)
                    if data is None:
                        continue
                    for w in wrong:
                        text = _read(data, w) if w != t else None
                        if not text or text == variant or text in natural or not NON_ASCII.search(text) or len(text) < 3:
                            continue
                        if re.fullmatch(r"[A-Za-z]*[à-öø-ÿÀ-ÖØ-ß][A-Za-z]*", text) and group != "cyrillic":
                            continue  # one accented letter in a Latin word: could be a real word of another language
                        out.setdefault(text, (t, w))
    return out


@functools.cache
def marks() -> dict[str, dict[tuple[str, str], str]]:
    """Garbled mark -> (true encoding, wrong encoding) -> letter, for all single-byte pairs of a Latin alphabet.

    A mark is no letter, or a letter of another script than the one it stands for.
    """
    out: dict[str, dict[tuple[str, str], str]] = {}
    letters = {"central": LATIN + EXTENDED, "western": LATIN}
    for group, alphabet in letters.items():
        true, wrong = SINGLE_BYTE[group]
        for t in true:
            for w in (x for x in wrong if x != t):
                for c in alphabet:
                    if not c.isalpha() or c in "ªº" or (data := _write(c, t)) is None:
                        continue
                    g = _read(data, w)
                    if g and len(g) == 1 and g != c and not g.isascii() and not (g.isalpha() and "LATIN" in unicodedata.name(g, "")):
                        out.setdefault(g, {})[t, w] = c
    return out


@functools.cache
def automaton():
    """All sequences, words and marks in one Aho-Corasick automaton; words carry their pair of encodings."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for text in marks():
        a.add_word(text, ("mark", text, None, None))
    for text, (t, w) in garbled_words().items():
        a.add_word(text, ("word", text, t, w))
    for text, c in garbled_sequences().items():
        a.add_word(text, ("chars", text, c, None))
    a.make_automaton()
    return a


def _marked(line: list[tuple[int, int, str]], found: dict[int, str], other: tuple[str, str] | None) -> tuple[str, str] | None:
    """The pair of encodings that explains the marks inside the words (start, end, text) of a line, or None.

    ``found``: places of matched marks; of equals the pair of the ``other`` lines, then one of the common Windows
    encodings, is taken. A mark counts between letters of a word of at least four characters;
    typographic signs, which stand between words of correct text as well, do not count, but must be explained.
    """
    inside = [(s, k, [(p - s, found[p]) for p in range(s, e) if p in found]) for s, e, k in line if e - s >= 4]
    inside = [(s, k, [g for at, g in there if _between_letters(k, at, found, s)]) for s, k, there in inside]
    inside = [(s, k, there) for s, k, there in inside if any(g not in TYPOGRAPHIC for g in there)]
    seen = {g for _, _, there in inside for g in there if g not in TYPOGRAPHIC}
    if len(seen) < MARKS:
        return None
    scores: dict[tuple[str, str], int] = {}
    for pair in sorted({q for g in seen for q in marks()[g]}):
        explained = {g for g in seen if pair in marks()[g]}
        if len(explained) < MARKS:
            continue
        words = [_convert(k.strip(TYPOGRAPHIC + "."), *pair) for _, k, there in inside if explained & set(there)]
        if all(w is not None and _is_word(w) for w in words):
            scores[pair] = len(explained)
    return max(scores, key=lambda q: (scores[q], q == other, q[0].startswith("cp125"), q)) if scores else None


def _between_letters(token: str, at: int, found: dict[int, str], start: int) -> bool:
    """Whether a place has a plain letter on one side, and a plain letter or another mark on the other; a mark may also begin or end the word."""
    plain = lambda k: 0 <= k < len(token) and token[k].isascii() and token[k].isalpha()
    other = lambda k: 0 <= k < len(token) and (start + k) in found or k < 0 or k >= len(token)
    return plain(at - 1) and (plain(at + 1) or other(at + 1)) or plain(at + 1) and other(at - 1)


def _is_word(text: str) -> bool:
    """Letters of one case pattern: lower, capitalised or upper; an apostrophe or hyphen may stand inside."""
    parts = [p for p in re.split(r"['’-]", text) if p]
    return bool(parts) and all(p.isalpha() and (p.islower() or p.isupper() or p[0].isupper() and p[1:].islower()) for p in parts)


def _spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str]], dict[int, str]]:
    """Matched sequences (start, end, original), longest first and disjoint, matched words (start, end, true, wrong), and places of marks."""
    chars, words, found = [], [], {}
    for end, (kind, pattern, x, y) in automaton().iter(text):
        start = end + 1 - len(pattern)
        if kind == "chars":
            chars.append((start, end + 1, x))
        elif kind == "mark":
            found[start] = pattern
        else:
            words.append((start, end + 1, x, y))
    runs, pairs = [(m.start(), m.end()) for m in _cyrillic_run().finditer(text)], _cyrillic_pairs()
    if runs:  # then words of one letter count as well
        runs += [(m.start(), m.end()) for m in re.finditer(r"(?<!\w)\w\S(?![\wЀ-ӿ])", text) if m.group() in pairs]
    for start, end in runs:
        for k in range(start, end, 2):
            chars.append((k, k + 2, pairs[text[k : k + 2]]))
    chars.sort(key=lambda s: (s[0], -s[1]))
    kept, at = [], 0
    for s in chars:
        if s[0] >= at:
            kept.append(s)
            at = s[1]
    return kept, words, found


def _convert(token: str, true: str, wrong: str) -> str | None:
    data = _write(token, wrong)
    if data is None:
        return None
    try:
        return data.decode(true)
    except UnicodeDecodeError:
        return None


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(garbled, restored text, everything restored) of one text.

    A text without garbled parts comes back as it is; so do null and empty texts. Sequences of several
    layers are restored in one step. A lost character (U+FFFD) stays.
    """
    if not text or text.isascii():
        return False, text, True
    chars, words, found = _spans(text)
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text) if NON_ASCII.search(m.group())]
    inside_chars = set()
    for s, e, _ in chars:
        inside_chars.update(range(s, e))
    tokens = [t for t in tokens if not any(p in inside_chars for p in range(t[0], t[1]))]
    starts = {s: e for s, e, _ in tokens}
    # A word counts where it is a whole token, give or take a mark at its end.
    whole = [(s, e, t, w) for s, e, t, w in words if s in starts and text[e : starts[s]].strip(".'’…»“”!?") == ""]
    breaks = [m.start() for m in re.finditer("\n", text)]
    lines: dict[int, list[tuple[int, int, str]]] = {}
    for t in tokens:
        lines.setdefault(bisect.bisect(breaks, t[0]), []).append(t)
    votes: dict[tuple[str, str], int] = {}
    named: dict[int, dict[tuple[str, str], int]] = {}
    for s, _, t, w in whole:
        votes[t, w] = votes.get((t, w), 0) + 1
        mine = named.setdefault(bisect.bisect(breaks, s), {})
        mine[t, w] = mine.get((t, w), 0) + 1
    # Pairs told by frequent words hold for the whole text, as its garbled lines come from one mix-up; marks speak for their line.
    best = max(votes, key=lambda p: (votes[p], p)) if votes else None
    pair_of = {k: best for k in named}
    for k, line in lines.items():
        if k not in pair_of and found and (pair := _marked(line, found, best)):
            pair_of[k] = pair
    lost = LOST in text
    if not (chars or pair_of or lost):
        return False, text, True
    edits = list(chars)
    complete = not lost
    marked = {s for s, _, _, _ in whole}
    for k, pair in pair_of.items():
        for s, e, token in lines[k]:
            fixed = _convert(token, *pair)
            # A word keeps the punctuation that the pair would take for letters.
            if fixed is None or not any(_is_word(x) for x in re.split(r"[^\w'’-]+", fixed) if x):
                complete = complete and s not in marked
            elif fixed != token:
                edits.append((s, e, fixed))
    out, at = [], 0
    for s, e, c in sorted(edits):
        if s >= at:
            out += [text[at:s], c]
            at = e
    out.append(text[at:])
    return True, "".join(out), complete


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, fixed, done) for i, t in zip(b["doc_id"], b["text"], strict=True) for hit, fixed, done in [repair(t)] if hit]
        yield pd.DataFrame(rows, columns=["doc_id", "restored", "complete"])


def repaired(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored, complete): one row per row of ``documents`` with a garbled part.

    Rows of plain ASCII, null and empty texts are dropped in the JVM. Repeated rows give repeated rows. There is
    no shuffle; each text is handled whole, in time linear in its length.
    """
    odd = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return odd.mapInPandas(_run, "doc_id long, restored string, complete boolean")
