"""Names, titles and slugs as Column functions: folding, splitting, comparing. All stay in the JVM.

The service and the importer fold names differently and both forms are needed: ``normalize_name`` keeps initials and
punctuation, ``importer_name`` drops titles and single letters. Null gives null throughout.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that don't decompose, each to a single plain letter (fixed values).
SPECIAL = {"Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Æ": "A", "æ": "a", "Å": "A", "å": "a", "ß": "s", "Ð": "D", "ð": "d", "Þ": "T", "þ": "t", "Đ": "D", "đ": "d", "İ": "I", "ı": "i", "Ğ": "G", "ğ": "g", "Ş": "S", "ş": "s"}
#: Words that begin a family name (fixed values).
PARTICLES = ("van", "von", "de", "del", "della", "di", "da", "la", "le", "du", "des", "ten", "ter", "vander")
#: Ranges of combining marks that folding drops (fixed values).
COMBINING = "\\u0300-\\u036f\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\ufe20-\\ufe2f"
VENUES = ("QCRYPT", "QIP", "TQC")
#: Words of titles that tell nothing apart (fixed values).
STOPWORDS = ("a", "an", "the", "of", "for", "and", "on", "in", "to", "with", "from", "via", "is", "are", "be", "by", "as", "at", "or")
_WS = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


@cache
def _fold_table(form: str) -> tuple[str, str]:
    """Characters whose decomposition is one plain character and combining marks, and these plain characters."""
    src, dst = [], []
    for n in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        d = unicodedata.normalize(form, chr(n))
        plain = "".join(ch for ch in d if not unicodedata.combining(ch))
        if len(plain) == 1 and plain != chr(n) and chr(n) not in SPECIAL:
            src.append(chr(n))
            dst.append(plain)
    return "".join((*SPECIAL, *src)), "".join((*SPECIAL.values(), *dst))


def collapse(c: Column) -> Column:
    """Runs of white space made one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def fold(c: Column) -> Column:
    """Plain letters: special letters mapped, accents dropped; letter case kept."""
    return F.regexp_replace(F.translate(c, *_fold_table("NFD")), f"[{COMBINING}]", "")


def normalize_name(c: Column) -> Column:
    """The service's form of a name: folded, lower case, single blanks; punctuation and initials stay."""
    return collapse(F.lower(fold(c)))


def normalize_loose(c: Column) -> Column:
    """The same with letters, digits and blanks only."""
    return collapse(F.regexp_replace(normalize_name(c), "[^\\p{L}\\p{N}\\s]", ""))


#: Titles and suffixes that the importer takes out. Without a right boundary, as delivered data were imported so (fixed value).
HONORIFICS = "(?i)\\b(Dr|Prof|Jr|Sr|Ph\\.?D|M\\.?D)\\.?\\s*"
HONORIFICS_FIXED = "(?i)\\b(Dr|Prof|Jr|Sr|Ph\\.?D|M\\.?D)\\b\\.?\\s*"


def importer_name(c: Column, fix_honorifics: bool = False) -> Column:
    """The importer's form of a name: titles out, folded, lower case, single letters dropped; empty for null.

    As imported, a surname that begins like a title loses these letters; ``fix_honorifics`` asks for a word end after it.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), HONORIFICS_FIXED if fix_honorifics else HONORIFICS, " ")
    words = F.split(collapse(F.lower(F.regexp_replace(F.translate(bare, *_fold_table("NFKD")), "\\p{M}", ""))), " ")
    return F.concat_ws(" ", F.filter(words, lambda w: ~w.rlike("^[a-z]\\.?$")))


def importer_split(c: Column) -> Column:
    """struct(family, given) of the importer's form: the last word and the words before."""
    n = importer_name(c)
    return F.struct(F.regexp_extract(n, "([^ ]*)$", 1).alias("family"), F.regexp_extract(n, "^(.*) [^ ]*$", 1).alias("given"))


def words(c: Column) -> Column:
    """Words of a text; an empty array for blank text."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def extract_initials(c: Column) -> Column:
    """First letters of all words, in upper case."""
    return F.concat_ws("", F.transform(words(c), lambda w: F.upper(F.substring(w, 1, 1))))


def display_initials(c: Column) -> Column:
    """``?`` for no word, two letters of a single word, else those of the first and the last word."""
    w = words(c)
    first, last = F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)
    return F.when(F.size(w) == 0, "?").when(F.size(w) == 1, F.upper(F.substring(first, 1, 2))).otherwise(F.concat(F.upper(F.substring(first, 1, 1)), F.upper(F.substring(last, 1, 1))))


def split_name(c: Column) -> Column:
    """struct(given, family): the last word with the particles right before it is the family name; one word is a family name."""
    w = words(c)
    # particles right before the last word: fold from the left, a run of them is reset by any other word
    run = F.aggregate(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.lit(0), lambda n, x: F.when(F.lower(x).isin(*PARTICLES), n + 1).otherwise(F.lit(0)))
    head = F.size(w) - 1 - run
    given = F.when((F.size(w) > 1) & (head > 0), F.concat_ws(" ", F.slice(w, 1, F.greatest(head, F.lit(0)))))
    family = F.when(F.size(w) > 0, F.concat_ws(" ", F.slice(w, F.greatest(head, F.lit(0)) + 1, F.size(w))))
    return F.struct(given.alias("given"), family.alias("family"))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for the same form, 0.95 for the same loose form, else the share of common words."""
    na, nb = normalize_name(a), normalize_name(b)
    return F.when(na == nb, 1.0).when(normalize_loose(a) == normalize_loose(b), 0.95).otherwise(jaccard(words(na), words(nb)))


def name_variants(c: Column) -> Column:
    """Forms to look a name up by, each once: normal, loose, family name, initials and family name."""
    s = split_name(c)
    family = normalize_name(s["family"])
    initials = F.concat(F.lower(extract_initials(s["given"])), F.lit(" "), family)
    return F.array_distinct(F.filter(F.array(normalize_name(c), normalize_loose(c), family, initials), lambda x: x.isNotNull()))


#: Letters that a slug writes as two (fixed values).
_TWO = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th"}


def slugify(c: Column) -> Column:
    """Lower case letters and digits with single hyphens; null where nothing is left."""
    for k, v in _TWO.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    s = F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit(""))


def base_slug(family: Column, given: Column, full: Column) -> Column:
    """Slug of family and given name, else of the full name, else ``anon``."""
    return F.coalesce(F.nullif(F.concat_ws("-", slugify(family), slugify(given)), F.lit("")), slugify(full), F.lit("anon"))


def conference_slug(c: Column) -> Column:
    """struct(venue, year) of ``qip-2024``, ``QIP2024`` and the like; null for an unknown venue or a year outside 1990 to 2100."""
    p = f"^({'|'.join(VENUES)})[^0-9]*([0-9]+)$"
    year = F.regexp_extract(F.upper(c), p, 2).try_cast("int")
    return F.when(year.between(1990, 2100), F.struct(F.regexp_extract(F.upper(c), p, 1).alias("venue"), year.alias("year")))


def make_slug(venue: Column, year: Column) -> Column:
    """``qip-2024``."""
    return F.concat(F.lower(venue), F.lit("-"), year.cast("string"))


def title_folded(c: Column) -> Column:
    """Title to compare by: bracketed remarks out, folded, punctuation to blanks."""
    return collapse(F.regexp_replace(F.lower(fold(F.regexp_replace(c, "\\[.*?\\]", " "))), "[^\\p{L}\\p{N}\\s]", " "))


def title_unprefixed(c: Column) -> Column:
    """Title without a leading type of session, folded, punctuation dropped, underscores kept."""
    bare = F.regexp_replace(c, "(?i)^(?:TUTORIAL|PLENARY|SHORT PLENARY \\d+|INVITED PLENARY \\d*):?\\s*", "")
    return collapse(F.regexp_replace(F.lower(fold(bare)), "[^\\p{L}\\p{N}_\\s]", ""))


def title_plain(c: Column) -> Column:
    """Title in lower case, punctuation to blanks, accents kept."""
    return collapse(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_\\s]", " "))


def title_tokens(c: Column) -> Column:
    """Distinct words of a title that tell it apart: no stop words, conference tags, years or single letters."""
    found = F.regexp_extract_all(importer_name(c), F.lit("([a-z0-9]+)"))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOPWORDS) & ~t.rlike("^(?:(?:qip|qcrypt|tqc)\\d{0,4}|\\d{4}|.)$")))


#: What stands before a mark at the beginning of a video's title without belonging to it: conferences, years, days.
_LABEL = f"(?:{'|'.join(VENUES)})(?:\\s*\\d{{1,4}})?|\\[?\\d{{4}}\\]?|day\\s*\\d+"


def strip_tags(c: Column) -> Column:
    """Title without the labels before its first marks (colon, bar, dash), however many."""
    return F.trim(F.regexp_replace(c, f"(?i)^(?:\\s*(?:{_LABEL})\\s*[:|–—-])+\\s*", ""))


def truncate(c: Column, n: int = 80) -> Column:
    """At most ``n`` characters and an ellipsis if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def affiliation(c: Column) -> Column:
    """Single blanks; null where nothing is left."""
    return F.nullif(collapse(c), F.lit(""))


def clean_latex(c: Column) -> Column:
    """Text of a LaTeX title: formulas and emphasis unwrapped, a few symbols spelt, other backslashes dropped."""
    c = F.regexp_replace(c, "\\$([^$]+)\\$", "$1")
    c = F.regexp_replace(c, "\\\\(?:emph|textbf|textit)\\{([^}]+)\\}", "$1")
    for k, v in (("\\leq", "≤"), ("\\geq", "≥"), ("\\cdot", "·"), ("\\circ", "∘"), ("\\times", "×")):
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.regexp_replace(c, "\\\\([^A-Za-z])", "$1")
