"""Evaluation items inside a corpus: q-gram lemma filtering in diagonal bands, then banded alignment of the words.

If a passage of an item stands in a document with few edits, the two share many character q-grams, and the words in which
shared q-grams begin differ in position by nearly the same number: they lie in a narrow band of diagonals. A word put
in moves the rest by one diagonal, however long it is. Bands of twice the largest shift, each overlapping half of
the next, are counted; those with fewer shared q-grams than the edit budget leaves (the q-gram lemma) are dropped, and the
words of the others are aligned within the band.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioweave.session import cut

#: Characters in a q-gram; long enough that common phrases of a language share few.
Q = 12
#: Running words that make a leak, and words of which one may be changed or put in.
LEAST_WORDS, ONE_IN = 20, 9
#: Most edits of a passage that holds no shorter one: of two halves of a longer passage one is within the budget, so that
#: every passage holds one of less than twice LEAST_WORDS words.
MOST_EDITS = (2 * LEAST_WORDS - 1) // ONE_IN
#: Diagonals (document word less item word) in a band; bands begin at every multiple of half of it, so that the
#: MOST_EDITS + 1 diagonals of such a passage lie in one.
BAND = 2 * MOST_EDITS
#: Bytes of item text that go to every task; larger sets of items meet the documents by a join on q-grams.
BLOCK_BYTES = 8 << 20
#: Characters of text hashed at a time.
PART = 2 << 20
#: 64-bit words of the filter of item q-grams that the join's document side is sent through.
FILTER_WORDS = 1 << 22
_WORD = re.compile(r"\w+")
_MASK = (1 << 22) - 1
_BASE = 1099511628211


def words(text: str | None) -> list[str]:
    """The words of a text: letter case, accents' composition, punctuation and layout don't matter."""
    if not text:
        return []
    text = text.lower()
    return _WORD.findall(text if text.isascii() else unicodedata.normalize("NFKC", text).replace("­", "").replace("​", ""))


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of words parted by blanks, the texts parted by line breaks."""
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the q-grams of a code point array, put together from those of 4 and 8 characters."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    one = codes.astype(np.uint64)
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    h = eight[:n] * power(4) + four[8 : 8 + n]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _word_of(codes: np.ndarray) -> np.ndarray:
    """Number of the word of each character, a blank counted to the word before it."""
    return np.cumsum(np.r_[0, codes[:-1] <= 32]) if len(codes) else np.zeros(0, np.int64)


def _bound(w: list[str]) -> int:
    """Fewest q-grams that a passage of the item keeps after its budget of edits: the q-gram lemma.

    An edit takes the q-grams that touch its word; of a passage of n words the n // ONE_IN longest words count. It is 1 or
    more, as LEAST_WORDS words keep more than two edits can take.
    """
    if len(w) < LEAST_WORDS:
        return 1 << 30
    size = np.array([len(x) for x in w])
    upto, longest = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(np.sort(size)[::-1])]
    best = 1 << 30
    for edits in range(LEAST_WORDS // ONE_IN, MOST_EDITS + 1):
        n = max(LEAST_WORDS, edits * ONE_IN)
        if n > len(w):
            break
        totals = upto[n:] - upto[:-n] + n - Q
        if edits == LEAST_WORDS // ONE_IN:
            gone = np.array([np.sort(size[a : a + n])[-edits:].sum() for a in range(len(totals))])
        else:
            gone = longest[edits]  # never less than in the passage
        best = min(best, int((totals - gone - edits * Q).min()))
    return max(best, 1)


class Index:
    """The q-grams of a block of items, with what each item's edit budget leaves of the q-grams of a passage."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.ids, self.words = list(ids), [words(t) for t in texts]
        self.least = np.array([_bound(w) for w in self.words], np.int64)
        grams, owner, place, word = [], [], [], []
        for k, w in enumerate(self.words):
            if len(w) < LEAST_WORDS:
                continue
            codes = _codes([" ".join(w)])
            h = _hashes(codes)
            grams.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
            word.append(_word_of(codes)[: len(h)])
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.owner, self.place, self.word = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (owner, place, word))
        self.keys, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.seen = np.zeros(_MASK + 1, bool)
        self.seen[(self.keys & np.uint64(_MASK)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, posting) of every shared q-gram."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(h & np.uint64(_MASK)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[maybe])
        at[at == len(self.keys)] = 0
        good = self.keys[at] == h[maybe]
        where, at = maybe[good], at[good]
        n = self.count[at]
        rows = np.repeat(np.arange(len(at)), n)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        return where[rows], self.first[at][rows] + inner


def passage(item: list[str], doc: list[str], lo: int, hi: int) -> tuple[int, int]:
    """(words of the item, edits) of the longest passage within the budget on the diagonals lo to hi - 1, document word less item word.

    The alignment table of the band holds equal words only: between two of them the longer gap is the number of words changed,
    put in or left out. For each such cell and each number of edits up to the item's budget the table has the most item
    words of a passage that ends there. Changed words at the ends count as far as the item and the budget go. (0, 0) if
    no passage has LEAST_WORDS words.
    """
    budget = len(item) // ONE_IN
    where: dict[str, list[int]] = {}
    for j, x in enumerate(doc):
        where.setdefault(x, []).append(j)
    cells: list[tuple[int, int, list[int]]] = []
    found = (0, 0)
    for i, x in enumerate(item):
        for j in where.get(x, ()):
            if not lo <= j - i < hi:
                continue
            most = [1] + [0] * budget
            for pi, pj, before in reversed(cells):
                if i - pi > budget + 1:
                    break
                gap = max(i - pi, j - pj) - 1
                if pi == i or pj >= j or gap > budget:
                    continue
                for e in range(budget + 1 - gap):
                    if before[e] and before[e] + i - pi > most[e + gap]:
                        most[e + gap] = before[e] + i - pi
            cells.append((i, j, most))
            for e, n in enumerate(most):
                if not n:
                    continue
                spare = min(max(0, LEAST_WORDS - n), len(item) - n)
                if n > found[0] and n + spare >= LEAST_WORDS and (e + spare) * ONE_IN <= n + spare:
                    found = (n, e)
    return found


def _bands(pair: np.ndarray, diagonal: np.ndarray, place: np.ndarray, least: np.ndarray) -> list[tuple[int, list[int]]]:
    """(row of a hit, first diagonals) of every pair with bands that keep ``least`` places of the item or more; least is by hit."""
    half = BAND // 2
    low = int(diagonal.min()) // half - 1
    span = int(diagonal.max()) // half - low + 3
    # hits by half band: two neighbours make a band
    key = pair * span + diagonal // half - low
    order = np.argsort(key, kind="stable")
    halves, first, count = np.unique(key[order], return_index=True, return_counts=True)
    after = np.r_[halves[1:] == halves[:-1] + 1, False]
    follow = np.where(after, np.r_[count[1:], 0], 0)
    head = order[first]
    found: dict[int, tuple[int, list[int]]] = {}
    empty = ~np.r_[False, after[:-1]]  # no hit in the half before
    for k in np.flatnonzero(count + follow >= least[head]):
        rows = order[first[k] : first[k] + count[k] + follow[k]]
        # a q-gram that a document repeats counts once for a place of the item
        if len(np.unique(place[rows])) >= least[head[k]]:
            firsts = found.setdefault(int(pair[head[k]]), (int(head[k]), []))[1]
            start = int(halves[k] % span) + low
            # a band may begin in a half without hits
            firsts += [x * half for x in ([start - 1, start] if empty[k] else [start])]
    return list(found.values())


def _leaks(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(row, item, words, edits) of every leak in the texts."""
    doc_words = [words(t) for t in texts]
    joined = [" ".join(w) for w in doc_words]
    codes = _codes(joined)
    where, posting = index.hits(_hashes(codes))
    if not len(where):
        return []
    starts = np.cumsum([0, *(len(x) + 1 for x in joined)])
    doc, item = np.searchsorted(starts, where, side="right") - 1, index.owner[posting]
    # pairs that share too few q-grams over all bands go first
    pair = doc * len(index.ids) + item
    _, back, n = np.unique(pair, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(n[back] >= index.least[item])
    if not len(keep):
        return []
    doc, item, where, posting, pair = doc[keep], item[keep], where[keep], posting[keep], pair[keep]
    of = _word_of(codes)
    diagonal = of[where] - of[np.minimum(starts[doc], len(of) - 1)] - index.word[posting]
    out = []
    for row, firsts in _bands(pair, diagonal, index.place[posting], index.least[item]):
        got = _aligned(index.words[item[row]], doc_words[doc[row]], firsts)
        if got[0]:
            out.append((int(doc[row]), int(item[row]), *got))
    return out


def _aligned(item: list[str], doc: list[str], firsts: list[int]) -> tuple[int, int]:
    """The longest passage of the bands that begin at these diagonals; bands that touch are aligned as one.

    Only the words that a band can touch are looked at.
    """
    best, at = (0, 0), 0
    while at < len(firsts):
        lo = hi = firsts[at]
        while at < len(firsts) and firsts[at] <= hi:
            hi = firsts[at] + BAND
            at += 1
        a = max(0, lo)
        best = max(best, passage(item, doc[a : max(0, hi + len(item))], lo - a, hi - a))
    return best


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of the batch of about PART characters, each text whole, so that memory doesn't follow the batch."""
    a = size = 0
    for z, t in enumerate(texts):
        size += len(t or "")
        if size >= PART:
            yield a, z + 1
            a, size = z + 1, 0
    if a < len(texts):
        yield a, len(texts)


def leaked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(``doc_key``, ``item_key``, words, edits): the documents that hold a passage of an item, once for each of its items.

    A passage has at least LEAST_WORDS running words of the item, up to one word in ONE_IN changed or put in; words and edits are
    those of the longest one in a band. Whole texts are read. The items are the stated query set: up to BLOCK_BYTES of
    them (measured) go to every task and the documents are read once, without a shuffle; more meet the documents by a
    join on q-grams. Null and empty texts hold nothing; items shorter than LEAST_WORDS words are never found. Rows with
    the same key give a row each.
    """
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    asked = items.select(F.col(f"`{item_key}`").alias("item_"), F.col(f"`{text}`").alias("said_")).where("said_ is not null")
    corpus = docs.select(F.col(f"`{doc_key}`").alias("doc_"), F.col(f"`{text}`").alias("text_")).where(F.length("text_") > LEAST_WORDS)
    size = asked.agg(F.sum(F.octet_length("said_"))).first()[0] or 0
    found = _by_broadcast(corpus, asked, kinds) if size <= BLOCK_BYTES else _by_join(corpus, asked, kinds)
    return found.select(F.col("doc_").alias(doc_key), F.col("item_").alias(item_key), "words", "edits")


def _by_broadcast(corpus: DataFrame, asked: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    rows = asked.collect()  # BLOCK_BYTES of text at most
    shared = corpus.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for b in batches:
            keys, texts, rows = b["doc_"].to_numpy(), b["text_"].tolist(), []
            for a, z in _parts(texts):
                rows += [(keys[a + d], index.ids[k], n, e) for d, k, n, e in _leaks(index, texts[a:z])]
            yield pd.DataFrame(rows, columns=["doc_", "item_", "words", "edits"])

    return corpus.mapInPandas(run, f"doc_ {kinds[0]}, item_ {kinds[1]}, words int, edits int")


def _by_join(corpus: DataFrame, asked: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """The same where the items are too many for a task: q-grams of items and documents meet in a shuffle.

    A filter of fixed size with a bit for each item q-gram goes to the document side first, so that only q-grams
    that may be shared are sent. The postings are reduced to bands before texts are fetched for the alignment.
    """

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in zip(b["item_"], b["said_"], strict=True):
                w = words(t)
                if len(w) < LEAST_WORDS:
                    continue
                codes = _codes([" ".join(w)])
                h = _hashes(codes)
                out = pd.DataFrame({"h_": h.view(np.int64), "place_": np.arange(len(h)), "word_": _word_of(codes)[: len(h)], "least_": _bound(w)})
                out.insert(0, "item_", k)
                yield out

    grams = cut(asked.mapInPandas(item_grams, f"item_ {kinds[1]}, h_ long, place_ int, word_ int, least_ int"))
    mask = FILTER_WORDS - 1
    bits = grams.groupBy(F.shiftright("h_", 6).bitwiseAND(mask).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h_ & 63 as int))")).alias("b")).collect()  # FILTER_WORDS rows at most
    table = np.zeros(FILTER_WORDS, np.int64)
    table[[r["i"] for r in bits]] = [r["b"] for r in bits]
    shared = corpus.sparkSession.sparkContext.broadcast(table)
    # texts that come twice are looked at once
    texts = corpus.withColumn("print_", F.xxhash64("text_"))

    def doc_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = shared.value.view(np.uint64)
        for b in batches:
            for key, mark, t in zip(b["doc_"], b["print_"], b["text_"], strict=True):
                codes = _codes([" ".join(words(t))])
                h = _hashes(codes)
                at = np.flatnonzero((seen[((h.view(np.int64) >> 6) & mask)] >> (h & np.uint64(63))) & np.uint64(1))
                if len(at):
                    out = pd.DataFrame({"print_": mark, "h_": h[at].view(np.int64), "spot_": _word_of(codes)[at]})
                    out.insert(0, "doc_", key)
                    yield out

    said = texts.select("doc_", "print_", "text_").mapInPandas(doc_grams, f"doc_ {kinds[0]}, print_ long, h_ long, spot_ int")
    near = said.join(grams.hint("merge"), "h_").withColumn("d_", F.col("spot_") - F.col("word_"))
    near = near.withColumn("first_", F.explode(F.array(*[F.floor((F.col("d_") + s) / BAND) * BAND - s for s in (0, BAND // 2)])))
    places = near.groupBy("doc_", "print_", "item_", "first_", "place_").agg(F.first("least_").alias("least_"))
    bands = places.groupBy("doc_", "print_", "item_", "first_").agg(F.count("*").alias("n_"), F.first("least_").alias("least_")).where("n_ >= least_")
    # the bands of an item in a document in one row, and the texts beside them
    pairs = bands.groupBy("doc_", "print_", "item_").agg(F.array_sort(F.collect_set(F.col("first_").cast("int"))).alias("bands_"))
    full = texts.join(pairs.hint("merge"), ["doc_", "print_"]).join(asked.hint("merge"), "item_").select("doc_", "text_", "item_", "said_", "bands_")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, t, item, s, bands in zip(b["doc_"], b["text_"], b["item_"], b["said_"], b["bands_"], strict=True):
                doc, w = words(t), words(s)
                got = _aligned(w, doc, [int(f) for f in bands])
                if got[0]:
                    rows.append((key, item, *got))
            yield pd.DataFrame(rows, columns=["doc_", "item_", "words", "edits"])

    return full.mapInPandas(align, f"doc_ {kinds[0]}, item_ {kinds[1]}, words int, edits int")
