"""Full-text search: weighted lexemes of title and abstract, AND of the words asked for, ranked by weighted frequency."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English words that carry no meaning in a search (fixed values).
STOP = ("a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "could", "do", "does", "for", "from", "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "more", "my", "no", "not", "of", "on", "or", "our", "out", "over", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "too", "under", "up", "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your")
#: Weights of lexemes of the title and of the abstract (fixed values).
WEIGHTS = {"A": 1.0, "B": 0.4}


def lexemes(c: Column) -> Column:
    """Words of a text without stop words, in order, unstemmed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"))
    return F.filter(found, lambda w: ~w.isin(*STOP))


def matches(stems: Column, query: str) -> Column:
    """Whether the array of a document's ``stems`` has the stem of every word of the query; a query without words matches nothing."""
    words = [stem(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP]
    return F.lit(False) if not words else F.size(F.array_except(F.array(*map(F.lit, words)), stems)) == 0


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences of a stem."""
    return len(re.findall(r"v+c+", "".join("v" if _vowel(stem, k) else "c" for k in range(len(stem)))))


def _vowel(w: str, k: int) -> bool:
    return w[k] in "aeiou" or w[k] == "y" and k > 0 and not _vowel(w, k - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, k) for k in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


#: Suffixes of the second and third step with what takes their place, and of the fourth, which drop (fixed values).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of an English word by the published suffix-stripping algorithm of 1980; short or foreign words stay."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") and _has_vowel(w[:-2]) else 3 if w.endswith("ing") and _has_vowel(w[:-3]) else 0
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        for suffix, put in sorted(steps, key=lambda s: -len(s[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + put
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(df: DataFrame, source: str, into: str) -> DataFrame:
    """``df`` with the array ``source`` of words stemmed as ``into``, in Arrow batches."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{into}` array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[into] = [None if ws is None else [stem(w) for w in ws] for ws in b[source]]
            yield b

    return df.mapInPandas(run, schema)


def ranked(docs: DataFrame, key: str, title: str, abstract: str, query: str) -> DataFrame:
    """(``key``, rank): documents that hold every word of the query by its stem, with a weighted frequency rank, largest first.

    A word of the title weighs 1, of the abstract 0.4; occurrences add as 1 + 1/2 + 1/3 and so on, over the number of words asked for.
    """
    words = [stem(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP]
    base = docs.select(key, lexemes(F.col(title)).alias("t_"), lexemes(F.col(abstract)).alias("b_"))
    both = stemmed(stemmed(base, "t_", "ts_"), "b_", "bs_")
    if not words:
        return both.select(key, F.lit(0.0).alias("rank")).limit(0)
    hit = both.where(F.size(F.array_except(F.array(*map(F.lit, dict.fromkeys(words))), F.concat("ts_", "bs_"))) == 0)

    def harmonic(arr: str, w: str, weight: float) -> Column:
        n = F.size(F.filter(arr, lambda x: x == w))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + weight / k)).otherwise(0.0)

    score = sum((harmonic("ts_", w, WEIGHTS["A"]) + harmonic("bs_", w, WEIGHTS["B"]) for w in words), F.lit(0.0)) / len(words)
    return hit.select(key, F.round(score, 6).alias("rank")).orderBy(F.desc("rank"), key)
