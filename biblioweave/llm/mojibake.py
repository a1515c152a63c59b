"""Text that was decoded with the wrong character table: found and, where it can be, restored by round trips.

A stretch is encoded again with a table that it may have been read with (strictly) and decoded with one that it may
have been written in (strictly); the result is kept if the garbling cost drops enough, and the step is repeated for
nested layers. Two shapes of stretch are tried: sequences whose bytes are UTF-8 (a wrong reading of UTF-8 almost never
is valid by chance), and whole sentences, for pairs of tables that aren't Unicode.

The cost doesn't know languages, so that no script is dearer than another. Every character has a class (letter of a script and
case, mark, sign, control); the cost counts what proper text of any script rarely has: controls, letters of two scripts or an
inner capital in one word, signs inside words, marks on the wrong side of a word, characters beyond the common ones of
East Asian scripts. A sentence without any such place, and without two characters that make UTF-8 in a Latin
table, is passed over after one look at its classes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One-byte tables in which UTF-8 is read by mistake, likeliest first. cp1252 stands for latin-1 too: see _bytes_of.
READ_AS = (
    "cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "cp1254", "cp1253", "cp1257", "mac_cyrillic",
    "cp852", "cp1255", "cp1256", "cp1258", "cp874", "iso8859_5", "iso8859_7",
)
#: Tables of several bytes in which UTF-8 is read by mistake.
READ_AS_WIDE = ("gb18030", "cp949", "cp932", "big5", "euc_jp")
#: (read as, written in) for texts that never were UTF-8.
PAIRS = tuple(
    (read, written)
    for written, tables in (
        ("cp1251", "cp1252 koi8_r cp866 cp1250 mac_roman"), ("koi8_r", "cp1251 cp1252 cp866"), ("cp866", "cp1251 cp1252 koi8_r"), ("iso8859_5", "cp1252 cp1251"), ("mac_cyrillic", "cp1251 cp1252"),
        ("mac_roman", "cp1252 cp437 cp850"), ("cp1252", "mac_roman cp437 cp850 cp1250 cp1251 cp1253 cp866 koi8_r"), ("cp437", "cp1252 mac_roman"), ("cp850", "cp1252 mac_roman"),
        ("cp1250", "cp1252 iso8859_2 cp852 cp1251"), ("iso8859_2", "cp1252 cp1250"), ("cp852", "cp1252 cp1250"), ("cp1253", "cp1252 cp1251"), ("iso8859_7", "cp1252"), ("cp1255", "cp1252"), ("cp1256", "cp1252"), ("cp874", "cp1252"),
        ("cp932", "cp1252 mac_roman cp437 cp1251 gb18030 euc_jp"), ("euc_jp", "cp1252 mac_roman cp1251 gb18030 cp932"), ("gb18030", "cp1252"), ("cp949", "cp1252"), ("big5", "cp1252"),
    )
    for read in tables.split()
)
_WIDE = {*READ_AS_WIDE}
#: Tables whose upper half is mostly signs: a short run of them standing alone may be proper text, such as a formula.
_SIGNS = {"mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp852", "mac_cyrillic"}
#: Russian letters by frequency in running text, most frequent first (fixed values), and their usual mean.
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RARE = {ord(ch): min(1.0, 0.04 * k) - 0.36 for k, ch in enumerate(_RUSSIAN)}
#: Marks by the side of a word on which they stand (fixed values).
_OPENING, _CLOSING, _EITHER, _NEUTRAL = set("„‚¿¡№"), set("”™®ªº²³¹"), set("“‘«»‹›"), set("·…°‐‑※々〆ー〜～")
#: Letters that are words or symbols of their own.
_ALONE = "àáâéèêóòôúùåæøýðþÀÁÂÉÈÊÓÒÔÚÙÅÆØÝÐÞ"
_MOST_LAYERS = 8


def _common(ch: str) -> bool:
    """Whether a Han character or Hangul syllable is among the common ones: the first level of a national standard."""
    for table, last in (("gb2312", 0xD7), ("euc_jp", 0xCF), ("big5", 0xC6), ("euc_kr", 0xC8)):
        try:
            raw = ch.encode(table)
        except UnicodeEncodeError:
            continue
        if len(raw) == 2 and 0xA4 <= raw[0] <= last:
            return True
    return False


_SCRIPTS: dict[str, str] = {}


class _Classes(dict):
    """Class of each code point, made when first met.

    a A ASCII letters, l U other Latin letters, o those alone, v V rarer Latin, c C d D Cyrillic, g G Greek, h H Han and Hangul (common, rare),
    k kana, K halfwidth kana, a private character for the letters of each other script, m accents, 0 digits, q p Q marks before,
    after, beside a word, y apostrophe, e dash, s S t sign (modifiers, mathematical), z neutral mark, x control or lost, n odd blank, f format.
    """

    def __missing__(self, n: int) -> str:
        self[n] = kind = self._of(n)
        return kind

    @staticmethod
    def _of(n: int) -> str:
        ch = chr(n)
        cat = unicodedata.category(ch)
        if n < 0x80:
            return "a" if cat == "Ll" else "A" if cat == "Lu" else "0" if cat == "Nd" else " " if ch.isspace() else "x" if cat == "Cc" else "?" if ch == "?" else "."
        if n == 0xFFFD or cat in ("Cc", "Co", "Cn", "Cs"):
            return " " if n == 0x85 else "x"
        for group, kind in ((_OPENING, "q"), (_CLOSING, "p"), (_EITHER, "Q"), (_NEUTRAL, "z"), ("’", "y"), ("–—−", "e")):
            if ch in group:
                return kind
        if ch.isspace():
            return " " if n == 0x3000 else "n"
        if cat == "Cf":
            return "f"
        upper = cat in ("Lu", "Lt")
        if cat[0] == "L" or cat in ("Mn", "Mc", "Nd", "Me"):
            if n < 0x180 and n not in (0xB5,):
                return "U" if upper else "l"
            if 0xFF00 <= n < 0xFF60:
                return "z"
            if n < 0x250 or 0x1E00 <= n < 0x1F00:
                return "V" if upper else "v"
            if 0x300 <= n < 0x370:
                return "m"
            if n == 0xB5 or 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
                return "G" if upper else "g"
            if 0x400 <= n < 0x530:
                plain = 0x410 <= n < 0x450 or n in (0x401, 0x451)
                return ("C" if plain else "D") if upper else ("c" if plain else "d")
            if 0x3040 <= n < 0x3100:
                return "k"
            if 0xFF61 <= n < 0xFFA0:
                return "K"
            if 0x3400 <= n < 0xA000 or 0xAC00 <= n < 0xD7A4 or 0xF900 <= n < 0xFB00 or 0x20000 <= n < 0x32000:
                return "h" if _common(ch) else "H"
            # the name of a letter begins with its script
            script = unicodedata.name(ch, "?").split(" ")[0].split("-")[0]
            return _SCRIPTS.setdefault(script, chr(0xE000 + len(_SCRIPTS)))
        if 0x3000 <= n < 0x3040 or 0xFE10 <= n < 0xFE70 or 0xFF00 <= n < 0xFFF0 or 0x600 <= n < 0x700 or 0x900 <= n < 0xF00 or 0x590 <= n < 0x600 or 0x370 <= n < 0x400 or 0x55A <= n < 0x590:
            return "z"  # marks of these scripts
        return "S" if cat == "Sk" else "t" if cat == "Sm" and n > 0x2000 else "s"


_CLASS = _Classes()
_ANY = "\ue000-\ue7ff"
_LET = f"aAlUvVcCdDgGhHkKm{_ANY}"
#: What proper text rarely has, on classes, and what each such place costs.
_COSTS = tuple(
    (re.compile(p), w)
    for p, w in (
        ("x", 3.0), ("f", 0.6), ("K", 0.8), ("H", 0.6),
        # two scripts in a word
        ("[aAlUvV](?=[cCdD])|[cCdD](?=[aAlUvVgG])|[gG](?=[cCdD])", 1.5), ("[aAlUvV](?=[gG])|[gG](?=[aAlUvV])", 0.4), (f"[lUvVcCdDgG](?=[{_ANY}hHkK])|[{_ANY}hHkK](?=[lUvVcCdDgG])", 1.5), (f"[aA](?=[{_ANY}])|[{_ANY}](?=[aA])", 0.7), (f"([{_ANY}])(?!\\1)[{_ANY}]", 2.0), ("(?<=[aA])[hHkK](?=[aA])", 1.0), ("a(?=[hH])|[hH](?=a)", 0.3), (f"[hHkK](?=[{_ANY}])|[{_ANY}](?=[hHkK])", 1.5),
        # letter case inside words
        ("[alvcdg](?=[UVCDG])|[lv](?=A)", 1.5), ("(?<![alvcdgAUVCDG])[lvcdg](?=[UVCDGA][UVCDGA])", 1.5), ("(?<=[AUV])[UV](?=[alv])|(?<=[CD])[CD](?=[cd])", 0.8),
        # letters of one script that rarely stand together or alone
        ("(?<=[lUvV])[lv]", 0.3), ("(?<=[lUvV]{2})[lUvV]", 0.5), ("(?<=[lv])[UV]", 0.5), ("m", 0.4), (f"(?<![{_LET}])[{_ANY}](?![{_LET}])", 0.6), ("(?<=[UV])[UV]", 0.1), ("[vV]", 0.3), (f"(?<![{_LET}o])[lU](?![{_LET}])", 0.8), (f"(?<=[gGlU])[gG](?=[lU])", 0.4),
        # signs beside letters, marks on the wrong side
        (f"(?<=[{_LET}o])s|s(?=[{_LET}o])|S", 1.6), ("(?<=[aAlU])t|t(?=s)", 0.8), ("t(?=[te])|(?<=[se])t", 0.5), ("(?<![aA0l .)])s|s(?=[^aA0l .(])", 0.5), (f"(?<=[{_LET}])q|p(?=[{_LET}])", 1.0), (f"(?<=[{_LET}])[qQ](?=[{_LET}])", 1.0), (f"(?<=[lUvVcC])n(?=[{_LET}])", 0.7), ("(?<=[aA])n(?=[aA])", 0.3), ("(?<=[aAlU])e(?=[aAlU])", 0.3), ("(?<=[aAlUcC])\\?(?=[aAlUcC])", 0.8), ("(?<=[aAlU])z(?=[alU])", 0.5),
        ("(?<![aAlUvVgGm0])p(?=[^ .0]|$)", 0.3), ("(?<=[ (])p", 0.8), ("q(?=[ )]|$)", 0.8),
        # a little for whatever isn't ASCII, so that of two readings of a stretch the shorter is taken
        ("[lU]", 0.05), (f"[gGdDcCkh{_ANY}npqQyes]", 0.02),
    )
)
_SUSPECT = re.compile("|".join(f"(?:{p.pattern})" for p, w in _COSTS if w >= 0.5 and "\\1" not in p.pattern) + f"|C{{3}}|([{_ANY}])(?!\\1)[{_ANY}]")


_SINGLE = re.compile(f"(?<![^\\W\\d_])[{_ALONE}](?![^\\W\\d_])")


def _classes(text: str) -> str:
    """The classes of a text, ``o`` for letters that stand alone where they may."""
    kinds = text.translate(_CLASS)
    for m in _SINGLE.finditer(text):
        kinds = f"{kinds[: m.start()]}o{kinds[m.end() :]}"
    return kinds


def _cost(text: str) -> float:
    if text.isascii():
        return 2.0 * len(_ASCII_CONTROL.findall(text))
    kinds = _classes(text)
    total = sum(w * len(p.findall(kinds)) for p, w in _COSTS)
    if "c" in kinds or "C" in kinds:
        total += max(0.0, 0.3 * sum(_RARE.get(ord(ch), 0.0 if k not in "dD" else 0.5) for ch, k in zip(text.lower(), kinds, strict=False) if k in "cCdD"))
    return total


_short_cost = lru_cache(maxsize=40_000)(_cost)


def cost(text: str) -> float:
    """How garbled ``text`` looks; 0 for plain ASCII, near 0 for proper text of any script. Kept for short stretches, which come again."""
    return _short_cost(text) if len(text) <= 400 else _cost(text)


_ASCII_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


@cache
def _table(name: str) -> dict[str, int]:
    """Characters of a one-byte table with their bytes; a byte without a character stands for the control of its number.

    A reader that falls back on latin-1 leaves controls for the bytes that others show: cp1252 takes both.
    """
    out: dict[str, int] = {chr(b): b for b in range(0x80, 0xA0)} if name == "cp1252" else {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def _bytes_of(text: str, table: str) -> bytes | None:
    """Bytes of ``text`` in ``table``, or None."""
    try:
        return text.encode(table)
    except UnicodeEncodeError:
        if table in _WIDE:
            return None
    m = _table(table)
    try:
        return bytes([m[ch] for ch in text])
    except KeyError:
        return None


@cache
def _sequences(table: str) -> re.Pattern[str]:
    """Characters of a one-byte table whose bytes have the shape of UTF-8, as long a run as there is."""
    m = _table(table)
    some = lambda lo, hi: "[" + "".join(re.escape(ch) for ch, b in m.items() if lo <= b <= hi) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}})+")


@cache
def _pair() -> re.Pattern[str]:
    """Two characters that begin UTF-8 in one of the Latin tables: cp1252 or cp1250."""
    parts = []
    for name in ("cp1252", "cp1250"):
        m = _table(name)
        some = lambda lo, hi, m=m: "[" + "".join(re.escape(ch) for ch, b in m.items() if lo <= b <= hi) + "]"
        parts.append(some(0xC2, 0xF4) + some(0x80, 0xBF))
    return re.compile("|".join(parts))


_SENTENCE = re.compile(r"(\n|(?<=[.?!。！？।])\s+|\s(?=[-•] ))")
_LETTERS = re.compile(r"[^\W\d_]")
_BAD_RESULT = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd\ue000-\uf8ff]")


def _fix_with(sentence: str, table: str, sure: bool) -> tuple[str, int]:
    """(sentence with the stretches that are UTF-8 in a one-byte table decoded, most layers undone in one of them)."""
    most = 0

    def fix(m: re.Match[str]) -> str:
        nonlocal most
        run, a, b = m[0], sentence[max(0, m.start() - 2) : m.start()], sentence[m.end() : m.end() + 2]
        # of the readings of all depths the cheapest: what one layer leaves may itself look worse than the whole
        now, got, at, deep, depth, layers = cost(a + run + b), run, None, run, 0, 0
        while (deeper := _sequences(table).sub(lambda m: _strict(m[0], table), deep)) != deep:
            deep, depth = deeper, depth + 1
            if not _BAD_RESULT.search(deep) and (at is None or cost(a + deep + b) <= at):
                got, at, layers = deep, cost(a + deep + b), depth
        if at is None or now - at < (-0.1 if sure else 0.05 if table in READ_AS[:3] else 0.4):
            return run
        if table in _SIGNS and len(run) < 3 and not (_LETTERS.match(a[-1:]) or _LETTERS.match(b[:1])) and not sure:
            return run
        most = max(most, layers)
        return got

    return _sequences(table).sub(fix, sentence), most


def _unwrap(sentence: str, sure: set[str]) -> tuple[str, str | None, int]:
    """(the best reading of ``sentence`` as UTF-8 read with a wrong table, that table or None, layers undone)."""
    now = cost(sentence)
    best, at, by, layers = sentence, now - 0.04, None, 0
    for rank, table in enumerate(READ_AS):
        if not _sequences(table).search(sentence):
            continue
        new, depth = _fix_with(sentence, table, table in sure)
        if depth:
            # one stretch that is certain settles the others
            new, depth = _fix_with(sentence, table, True)
            if new != sentence and (c := cost(new) + 0.01 * rank) < at - 1e-9:
                best, at, by, layers = new, c, table, depth
    if now < 1.0:
        return best, by, layers
    for table in READ_AS_WIDE:
        # signs that stand for lost bytes part the runs
        new = re.sub(r"[^\x00-\x7f\ufffd]{2,}", lambda m, t=table: _reread(m[0], t), sentence)
        if new != sentence and (c := cost(new)) < at - 0.5:
            best, at, by, layers = new, c, table, 1
    return best, by, layers


def _strict(run: str, table: str) -> str:
    """``run`` decoded as UTF-8 from its bytes in ``table``, or as it is."""
    raw = _bytes_of(run, table)
    try:
        return raw.decode("utf-8") if raw else run
    except UnicodeDecodeError:
        return run


def _reread(run: str, table: str) -> str:
    got = _strict(run, table)
    return run if _BAD_RESULT.search(got) else got


def _japanese(text: str) -> bool:
    """Whether a text reads as Japanese: hiragana make a good part of it, as these tables turn any bytes into some characters."""
    wide = [ch for ch in text if not ch.isascii()]
    return sum("ぁ" <= ch <= "ゟ" for ch in wide) >= 0.2 * len(wide)


@cache
def _quoted() -> tuple[re.Pattern[str], str]:
    """A stretch between two letters that quotation marks become in one of the pairs of one-byte tables, and the first letters of such."""
    found = set()
    for read, written in PAIRS:
        if read in _WIDE or written in _WIDE:
            continue
        ends = ["".join(ch for ch, b in _table(read).items() if b == _table(written).get(q)) for q in "“”"]
        if all(len(e) == 1 and e.isalpha() for e in ends):
            found.add(tuple(ends))
    return re.compile("|".join(rf"(?<!\w){a}(?=[^\W_])[^\n]*\w{b}(?!\w)" for a, b in sorted(found))), "".join(a for a, _ in sorted(found))


def _swap(sentence: str, sure: set[tuple[str, str]]) -> tuple[str, tuple[str, str] | None]:
    """(the reading of ``sentence`` by one of PAIRS that costs least, that pair) if it costs far less, else (sentence, None).

    A pair that is certain for another sentence of the text needs little; quotation marks that come out as a pair count as well.
    """
    now = cost(sentence)
    quoted = 0.8 if _quoted()[0].search(sentence) else 0.0
    odd = sum(not ch.isascii() for ch in sentence)
    weak = now + quoted < 0.7 or now + quoted < min(0.9, 0.12 * odd)
    if weak and not sure:
        return sentence, None
    best, pair, raws = sentence, None, {}
    at = now - max(0.8, 0.5 * now)
    for read, written in sure if weak else PAIRS:
        if read not in raws:
            raws[read] = _bytes_of(sentence, read)
        raw = raws[read]
        if raw is None:
            continue
        try:
            got = raw.decode(written)
        except UnicodeDecodeError:
            continue
        if got == sentence or _BAD_RESULT.search(got) or written in ("cp932", "euc_jp") and not _japanese(got):
            continue
        c = cost(got)
        if quoted and "“" in got and "”" in got:
            c -= quoted
        if (read, written) in sure and c < now - 0.3:
            c = min(c, at - 0.1)
        if c < at - 1e-9:
            best, pair, at = got, (read, written), c
    return best, pair


#: Plain ASCII but for two characters at either end of a run: what stands beside other characters tells all.
_PLAIN = re.compile(r"([\x00-\x7f]{2})[\x00-\x7f]+([\x00-\x7f]{2})")


def _proper(text: str) -> bool:
    """Whether a text has no place that proper text rarely has: nothing is tried on it."""
    short = _PLAIN.sub(r"\1\2", text)
    return not (_pair().search(short) or _SUSPECT.search(_classes(short)) or any(ch in short for ch in _quoted()[1]) and _quoted()[0].search(text))


_LOST = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


def _layer(parts: list[str], which: list[int], tables: set[str], pairs: set[tuple[str, str]]) -> tuple[dict[int, str], int, set[str], set[tuple[str, str]]]:
    """(new sentences by number, layers, tables, pairs) of a reading undone, with what is certain already and what became so."""
    changed, most, by_table, by_pair = {}, 0, set(tables), set(pairs)
    for k in which:
        new, table, layers = _unwrap(parts[k], tables)
        if not table or not _proper(new):
            other, pair = _swap(parts[k], pairs)
            if pair and cost(other) < cost(new) - (0.8 if table else 0.0):
                new, table, layers = other, None, 1
                by_pair.add(pair)
        if table:
            by_table.add(table)
        if new != parts[k]:
            changed[k] = new
            most = max(most, layers)
    return changed, most, by_table, by_pair


def restore(text: str) -> tuple[str, int, bool]:
    """(text restored as far as it can be, layers undone, whether it was or still is garbled).

    Garbled is what a round trip mends, and what holds the marks that a lossy decoding leaves: the replacement character
    or controls of the upper half.
    """
    if text.isascii() or _proper(text):
        return text, 0, _LOST.search(text) is not None
    parts, layers = _SENTENCE.split(text), 0
    some = [k for k, s in enumerate(parts) if not s.isascii()]
    open_ = [k for k in some if not _proper(parts[k])]
    while open_ and layers < _MOST_LAYERS:
        # a table that is certain for one sentence of the text settles the doubtful ones
        changed, most, tables, pairs = _layer(parts, open_, set(), set())
        if tables or pairs:
            changed, most, tables, pairs = _layer(parts, some, tables, pairs)
        if not changed:
            break
        for k, s in changed.items():
            parts[k] = s
        layers += most
        open_ = [k for k in some if not parts[k].isascii() and not _proper(parts[k])]
    new = "".join(parts)
    return new, layers, layers > 0 or _LOST.search(new) is not None


def complete(text: str) -> bool:
    """Whether nothing of a restored text is lost."""
    return _LOST.search(text) is None


def repair(df: DataFrame, key: str, column: str) -> DataFrame:
    """(``key``, restored, layers, complete) of the rows whose text has a stretch decoded with the wrong table.

    restored is the text with every stretch that can be restored; complete is false where something was lost. Null,
    empty and plain ASCII texts are passed over in the JVM; whole texts are read, however long. No shuffle.
    """
    kind = dict(df.dtypes)[key]
    some = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").alias("text_")).where(F.col("text_").rlike("[^\\x00-\\x7f]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b["text_"], strict=True):
                new, layers, bad = restore(t)
                if bad:
                    rows.append((k, new, layers, complete(new)))
            yield pd.DataFrame(rows, columns=[key, "restored", "layers", "complete"])

    return some.mapInPandas(run, f"`{key}` {kind}, restored string, layers int, complete boolean")
