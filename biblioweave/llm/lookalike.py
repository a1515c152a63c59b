"""Visually identical text in one form: normalise only the segments whose characters are unstable.

Every character has a quick-check property, that of NFC (yes, no, maybe) widened by what looks the same: stable (it is its
own canonical form and never changes a neighbour), or unstable (NFC says no or maybe, a combining accent, invisible,
an odd blank, another form of a plain letter, a look-alike of another script). A compiled class finds the unstable ones; each run of them, widened to the letter before (accents compose with it) and
to its word (a look-alike is one only beside letters of the other script), is normalised alone and spliced into the
text, which is otherwise copied unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alikes of plain Latin letters in Cyrillic, Greek and a few other scripts (fixed values).
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝӏАВЕЗКМНОРСТУХІЅЈҮԌԜЬгпв", "aeopcyxisjhdqwlABE3KMHOPCTYXISJYGWbrnb", strict=True))
GREEK = dict(zip("αγινορυχϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧκτηω", "ayivopuxcABEZHIKMNOPTYXktnw", strict=True))
OTHER = dict(zip("ոսօհցքԱՍՏꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓥꓦꓪꓫꓬꓮꓯꓰꓲꓳꓴᎪᎫᎬᎳᎷᎻᏀᏃᏞᏟᏢᏚᏙᎡᎢıɑɡ", "nuohgpUUSBPdDTGKJCZFMNLSRAVWXYAAEIOUAJEWMHGZLCPSVRTiag", strict=True))
#: Letters that look like no plain Latin letter, but stand for one where a word is otherwise Latin; never used alone.
_WEAK = set("ЗЬгпвαγικτηωυ")
LOOKALIKE = {**CYRILLIC, **GREEK, **OTHER}
#: Decompositions that make another form of a letter or blank; super- and subscripts, fractions and squares are their own signs.
_FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
_DASHES_AND_DOTS = set("‐‑‒–—―․‥…″‴⁗´¨¯¸")


def _plain_form(ch: str) -> str | None:
    """The plain letters, digits or blank of which ``ch`` is another form; None if it is none."""
    d = unicodedata.decomposition(ch)
    kind = d.split(" ", 1)[0] if d.startswith("<") else ""
    if ch in _DASHES_AND_DOTS:
        return None
    if d and not kind:
        # singletons such as the Kelvin sign; composed accented letters are canonical themselves
        n = unicodedata.normalize("NFC", ch)
        return n if n != ch else None
    if kind in _FORMS:
        n = unicodedata.normalize("NFKC", ch)
        return n if n and all(unicodedata.category(x)[0] in "LN" or x == " " for x in n) or kind in ("<wide>", "<narrow>", "<noBreak>") else None
    return None


@cache
def _seconds() -> frozenset[str]:
    """Characters of which NFC's quick check says maybe: the second ones of canonical pairs, and vowels and ends of Hangul."""
    pairs = (unicodedata.decomposition(chr(n)) for n in range(0xA0, 0x1E000) if not 0xD800 <= n < 0xF900)
    return frozenset(chr(int(d.split(" ")[1], 16)) for d in pairs if d and d[0] != "<" and " " in d) | frozenset(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))


def _quick_check(ch: str) -> str:
    """NFC's quick check of a character: ``yes``, ``no`` or ``maybe``."""
    return "no" if not unicodedata.is_normalized("NFC", ch) else "maybe" if ch in _seconds() else "yes"


@cache
def _tables() -> tuple[re.Pattern[str], dict[str, str]]:
    """The class of unstable characters, and what each of them becomes by itself (accents and look-alikes are left out)."""
    single: dict[str, str] = {}
    unstable: set[str] = set()
    # no characters are assigned between these ranges
    for n in (*range(0x20, 0x32400), *range(0xE0000, 0xE0200)):
        if 0xAC00 <= n < 0xD7A4 or 0x4E00 <= n < 0xA000 or 0x3400 <= n < 0x4DC0 or 0x20000 <= n < 0x2F800 or 0xD800 <= n < 0xF900:
            continue
        ch = chr(n)
        cat = unicodedata.category(ch)
        if cat == "Zs" and ch != " ":
            single[ch] = " "
        elif cat in ("Cf", "Zl", "Zp") or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or n in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800):
            single[ch] = "\n" if cat in ("Zl", "Zp") else ""
        elif cat == "Cc" and n > 0x1F:
            single[ch] = ""
        elif unicodedata.combining(ch) or _quick_check(ch) == "maybe":
            unstable.add(ch)
        elif (plain := _plain_form(ch)) is not None:
            single[ch] = plain
    for n in range(0x20):
        if n not in (9, 10, 11, 12, 13):
            single[chr(n)] = ""
    unstable |= single.keys() | LOOKALIKE.keys()
    points, spans = sorted(map(ord, unstable)), []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return re.compile("[" + "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in spans) + "]+"), single


def _script(ch: str) -> str:
    if ch.isascii():
        return "L" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    n = ord(ch)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "L"
    if 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
        return "G"
    if 0x400 <= n < 0x530:
        return "C"
    return "O"


#: Letters that may look like one of another script: only words with one are looked at.
_FOREIGN = re.compile("[\\u0370-\\u052f\\u1f00-\\u1fff" + "".join(OTHER) + "]")
_LETTERS = re.compile(r"[^\W\d_]*")


def _words(text: str) -> str:
    """``text`` with look-alike letters replaced, word by word.

    A word that mixes scripts takes its Latin form, or its Cyrillic or Greek one if most of its letters have no Latin
    look-alike. A word wholly of look-alikes is Latin if the rest of the text is; a Greek letter alone stays.
    """
    if not _FOREIGN.search(text):
        return text
    scripts = [_script(ch) for ch in text]
    latin = scripts.count("L")
    sure = {s: sum(1 for ch, x in zip(text, scripts, strict=True) if x == s and (ch not in LOOKALIKE or ch in _WEAK)) for s in "GCO"}

    def word(w: str) -> str:
        kinds = [_script(ch) for ch in w]
        foreign = {k for k in kinds if k in "GCO" and k}
        if not foreign:
            return w
        alike = [ch for ch in w if ch in LOOKALIKE]
        if "L" in kinds:
            own = sum(1 for ch, k in zip(w, kinds, strict=True) if k in "GC" and ch not in LOOKALIKE)
            if own > 1 and own >= kinds.count("L"):
                back = {v: k for k, v in (CYRILLIC if "C" in foreign else GREEK).items() if k not in _WEAK}
                return "".join(back.get(ch, ch) if k == "L" else ch for ch, k in zip(w, kinds, strict=True))
            return "".join(LOOKALIKE.get(ch, ch) for ch in w) if alike else w
        if len(foreign) > 1:
            return "".join(LOOKALIKE.get(ch, ch) for ch in w) if len(alike) == len(w) else w
        if len(alike) < len(w) or len(w) == 1 and "G" in foreign or any(ch in _WEAK for ch in w):
            return w
        k = next(iter(foreign))
        return "".join(LOOKALIKE[ch] for ch in w) if latin > 0 and sure[k] == 0 and latin >= kinds.count(k) else w

    out, at = [], 0
    for m in _FOREIGN.finditer(text):
        if m.start() < at:
            continue
        a = m.start()
        while a > at and text[a - 1].isalpha():
            a -= 1
        b = _LETTERS.match(text, m.start()).end()
        out += [text[at:a], word(text[a:b])]
        at = b
    return "".join(out) + text[at:]


_JOINERS, _MARKS_OF_DIRECTION, _PICTURE = "\u200c\u200d", set("\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"), "\ufe0f"
_RIGHT_TO_LEFT = re.compile("[\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufefc]")


def _needed(text: str, k: int) -> bool:
    """Whether an invisible character does its work: joiners within words of Arabic and Indic scripts and between pictures,
    the mark that makes a sign a picture, marks of direction in a text with letters that run from the right."""
    ch, before, after = text[k], text[k - 1 : k], text[k + 1 : k + 2]
    joining = lambda x: x != "" and (0x600 <= ord(x) < 0xE00 or 0xF00 <= ord(x) < 0x10A0 or 0x1780 <= ord(x) < 0x18B0) and unicodedata.category(x)[0] in "LM"
    picture = lambda x: x != "" and (unicodedata.category(x) in ("So", "Sk") or x == _PICTURE or 0x1F3FB <= ord(x) <= 0x1F3FF)
    if ch in _JOINERS:
        return joining(before) and joining(after) or ch == "\u200d" and picture(before) and picture(after)
    if ch == _PICTURE:
        return picture(before) or before in tuple("0123456789#*") and after == "\u20e3"
    return ch in _MARKS_OF_DIRECTION and _RIGHT_TO_LEFT.search(text) is not None


def canonical(text: str) -> str:
    """The one form of ``text``: plain composed letters, plain blanks, nothing invisible that does no work. Idempotent."""
    if text.isascii() and text.isprintable():
        return text
    unstable, single = _tables()
    out, at = [], 0
    for m in unstable.finditer(text):
        a, b = m.span()
        if a < at:
            continue
        # boundary context: the letter before, with which accents compose, and what follows up to a stable letter
        a = max(at, a - 1)
        while b < len(text) and (unicodedata.combining(text[b]) or unstable.match(text[b])):
            b += 1
        segment = "".join(text[k] if text[k] in _WORKING and _needed(text, k) else single.get(text[k], text[k]) for k in range(a, b))
        out += [text[at:a], unicodedata.normalize("NFC", segment)]
        at = b
    if not out:
        return text
    new = _words("".join(out) + text[at:])
    return new if new == text or unicodedata.is_normalized("NFC", new) else unicodedata.normalize("NFC", new)


_WORKING = {*_JOINERS, *_MARKS_OF_DIRECTION, _PICTURE}


def differs(text: str) -> bool:
    """Whether ``text`` holds a character that a reader can't tell from, or that is another form of, a plain one."""
    return canonical(text) != text


def unify(df: DataFrame, key: str, column: str) -> DataFrame:
    """(``key``, before, after) of the rows whose text in ``column`` isn't in its one form.

    Null and empty texts are none; plain ASCII texts are passed over in the JVM. Rows never meet: no shuffle.
    """
    touched = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").alias("before")).where(F.col("before").rlike("[^\\x09-\\x0d\\x20-\\x7e]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["after"] = [canonical(x) for x in b["before"]]
            yield b[b["after"] != b["before"]]

    kind = dict(df.dtypes)[key]
    return touched.mapInPandas(run, f"`{key}` {kind}, before string, after string")
