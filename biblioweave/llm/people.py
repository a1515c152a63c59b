"""Spellings of one person or group linked: merge-and-rematch resolution.

Every distinct spelling is parsed into a profile: given name (or its initials), middle initials and family name, or
for a group its own word and the initials of the rest. Profiles meet under blocking keys built so that those that meet
agree but for a typing slip; a merge unions the spellings, given names and middle initials of both, and the richer
profile is matched again, until a round merges nothing. Blocks are resolved by aggregation (smallest member, least
and largest conflicting mark; one sub-block a mark where they conflict), never by forming pairs, so that a name shared by a third of all rows costs no more
than its rows. Every join is by merge: a profile has some thirty keys, which the planner doesn't see when it judges by
the size of the files whether a side may be broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioweave.llm.lookalike import canonical
from biblioweave.session import BROADCAST_BYTES, cut

#: Short forms of given names, each with the full names it may stand for (fixed values).
SHORT = {
    "abe": "abraham", "al": "albert alan alexander", "alex": "alexander alexandra", "andy": "andrew andreas andrea anders", "angie": "angela", "babs": "barbara", "barb": "barbara", "bea": "beatrice beatrix",
    "beate": "beatrix", "becky": "rebecca", "becca": "rebecca", "ben": "benjamin benedict", "benny": "benjamin benedict", "bert": "albert robert", "beth": "elizabeth elisabeth", "betty": "elizabeth bettina", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chuck": "charles", "chris": "christopher christina christian", "christa": "christina", "connie": "cornelia constance", "dan": "daniel",
    "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dimitri dmitry", "dora": "dorothea", "dori": "dorothea", "dorle": "dorothea", "ed": "edward edwin", "eddie": "edward",
    "elli": "elena elizabeth", "ellie": "elena eleanor elizabeth", "fran": "frances franziska", "francie": "frances", "franzi": "franziska", "fred": "frederick alfred", "freddy": "frederick", "fritz": "friedrich frederick", "gabe": "gabriel", "gene": "eugene",
    "greg": "gregory", "gus": "gustav", "hal": "harald henry", "hank": "henry", "hannes": "johannes", "harry": "harald henry", "jack": "john jacob", "jake": "jacob", "jan": "johannes", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jim": "james",
    "jimmy": "james", "jo": "joanna josephine johannes", "joe": "joseph", "joey": "joseph", "john": "jonathan", "jon": "jonathan", "josie": "josephine", "judy": "judith", "kasia": "katarzyna", "kate": "catherine katherine", "kathy": "catherine katherine",
    "katie": "catherine katherine", "kris": "kristina", "larry": "lawrence lorenzo", "laurie": "laura", "lena": "magdalena helena", "leni": "magdalena helena", "lenny": "leonard", "leo": "leonard leopold", "leon": "leonard", "lisa": "elizabeth", "liz": "elizabeth",
    "lizzy": "elizabeth", "lou": "louise louis", "lucy": "lucia", "maggie": "margaret magdalena", "magda": "magdalena", "manu": "manuel manuela", "marge": "margaret", "mark": "marcus", "matt": "matthew matthias", "max": "maximilian", "meg": "margaret", "mick": "michael",
    "mike": "michael", "mischa": "michael", "misha": "michael", "moni": "monica", "nate": "nathaniel", "nat": "nathaniel natalie", "ned": "edward", "nell": "helena eleanor", "nick": "nicholas", "nico": "nicholas", "ollie": "oliver", "pat": "patricia patrick", "patty": "patricia", "paul": "pablo",
    "peg": "margaret", "peggy": "margaret", "pete": "peter", "phil": "philip", "rafa": "rafael", "ray": "raymond", "rich": "richard", "rick": "richard frederick", "rob": "robert", "robbie": "robert", "rolf": "rudolf", "ron": "ronald", "rudi": "rudolf", "sam": "samuel samantha samir",
    "sandy": "sandra alexander alexandra", "sanna": "susanna", "sasha": "alexander alexandra", "seb": "sebastian", "basti": "sebastian", "simo": "simon", "sofie": "sofia", "steffen": "stefan", "steve": "stefan stephen steven", "sue": "susanna susan", "susie": "susanna susan", "susi": "susanna", "tara": "tamara",
    "ted": "edward theodor", "teddy": "theodor edward", "terry": "theresa", "tess": "theresa", "thea": "dorothea theodora", "theo": "theodor", "tilda": "matilda", "tilly": "matilda", "tim": "timothy", "tina": "christina martina bettina kristina", "tobi": "tobias", "tom": "thomas", "tommy": "thomas", "tony": "anton antonia",
    "val": "valentin", "vic": "victor victoria", "vicky": "victoria", "vince": "vincent", "walt": "walter", "will": "william", "xandra": "alexandra", "zach": "zacharias",
}
_FULL = {f for v in SHORT.values() for f in v.split()}
_HONORIFIC = re.compile(r"^(?:(?:prof|professor|dr|doctor|mr|mrs|ms|miss|sir|dame|herr|frau|dipl|ing)\b\.?[- ,]*)+", re.I)
_SUFFIX = re.compile(r"[ ,]+(?:jr|sr|ph\.? ?d|m\.? ?sc|b\.? ?sc|md)\.?$", re.I)
_PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "du", "del", "della", "do", "dos", "das", "el", "al", "la", "le", "ten", "ter", "zu", "zur", "vom", "af", "av", "bin", "ibn", "y"}
_FUSED = re.compile(r"\b(van|von|der|den|del|de|da|di|du|el|al|la|le)(?=[A-ZÀ-Ž])")
_GROUP = re.compile(r"^(?:group|grp|collaboration|collab|consortium|consort|team|network|society|association|committee|project|initiative|alliance|laboratory|lab|institute|council|board|forum|task|force|union)$")
_LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "’": "'", "‐": "-", "‑": "-", "–": "-"})
#: A given name is established from this share of the usual number of families on: a share, as a table twice as large has
#: twice the families a name.
ESTABLISHED = 0.2
#: Bytes of established names that go to every task; more are joined to the words of each spelling.
GIVEN_BYTES = 32 << 20
#: Letters at least that two family names two slips apart have in common, in order.
SHARED = 5


def fold(text: str) -> str:
    """Plain letters of a name in their case: look-alikes, accents and special letters undone, blanks made one."""
    t = unicodedata.normalize("NFKD", canonical(text).translate(_LETTERS))
    return re.sub(r"\s+", " ", "".join(ch for ch in t if not unicodedata.combining(ch))).strip(" \"'“”„;,")


def skeleton(word: str) -> str:
    """A word without the differences of spelling by ear (c and k, s and z, v and w, ie and y and i, au and aw, doubled letters)."""
    w = word.replace("ph", "f").replace("ck", "k").replace("aw", "au").replace("ie", "i").replace("y", "i").replace("x", "ks")
    w = w.translate(str.maketrans("czwq", "ksvk")).replace("th", "t")
    return re.sub(r"(.)\1+", r"\1", w)


def parse(text: str, established: frozenset[str] | set[str] = frozenset()) -> tuple[str, str, str, str, str]:
    """(kind, given, initials, middle, family) of a spelling; kind is ``p``, ``g`` or ``x`` for text that is no name.

    given is empty where only initials are written; middle holds middle initials; family is without particles,
    hyphens and blanks. ``established`` given names tell the order of a name without a comma and where given names end.
    """
    t = _HONORIFIC.sub("", _FUSED.sub(r"\1 ", fold(text)))
    t = _SUFFIX.sub("", t)
    if not any(ch.isalpha() for ch in t):
        return "x", "", "", "", t.lower()
    raw = [x for x in re.split(r"[\s./]+", t.replace(",", " , ")) if x]
    low = [x.lower() for x in raw]
    if any(_GROUP.match(x) for x in low) and len(low) > 1:
        words = [(a, b) for a, b in zip(raw, low, strict=True) if b not in ("the", "of", "for", "and", ",")]
        last = max(i for i, (_, b) in enumerate(words) if _GROUP.match(b))
        letters = lambda part: "".join(b if a.isupper() and len(a) <= 4 else b[0] for a, b in part)
        if 0 < last < len(words) - 1:  # Quantum Group Xyz: shortened, its own word last
            return "g", "", letters(words[: last + 1]), "", re.sub(r"[^a-z0-9]", "", "".join(b for _, b in words[last + 1 :]))
        return "g", letters(words[1:]), "", "", re.sub(r"[^a-z0-9]", "", words[0][1])
    known = lambda x: x in established or x in SHORT or x in _FULL
    if "," in low:
        k = low.index(",")
        family, given = low[:k], [x for x in low[k + 1 :] if x != ","]
        if not given or not family:
            family, given = given or family, []
    else:
        upper = [len(x) > 2 and x.isupper() for x in raw]
        if upper[0] and not all(u or len(x) < 3 for u, x in zip(upper, raw, strict=True)):
            k = next((i for i, (u, x) in enumerate(zip(upper, low, strict=True)) if not u and x not in _PARTICLES), len(low))
            family, given = low[:k], low[k:]
        elif len(low) == 1:
            family, given = low, []
        else:
            # initials and established names lead; a particle or any other word begins the family name
            k = 1
            head = low[0].split("-")[0]
            if len(low) > 1 and not known(head) and len(head) > 1 and (low[-1] in established or low[-1].split("-")[0] in established) and low[0] not in _PARTICLES:
                cutoff = len(low) - 1
                while cutoff > 1 and (len(low[cutoff - 1]) == 1 or low[cutoff - 1] in established):
                    cutoff -= 1
                family, given = low[:cutoff], low[cutoff:]
            else:
                while k < len(low) - 1 and (len(low[k].replace("-", "")) == 1 or low[k] in established and low[k] not in _PARTICLES):
                    k += 1
                family, given = low[k:], low[:k]
    while given and given[-1] in _PARTICLES and len(given) > 1:
        family.insert(0, given.pop())
    while len(family) > 1 and family[0] in _PARTICLES:
        family = family[1:]
    names = [p for x in given for p in x.split("-") if p]
    full = [x for x in names if len(x) > 1]
    if full:
        first = names.index(full[0])
        inits = "".join(x[0] for x in full)
        middle = "".join(sorted({x for x in names[first:] if len(x) == 1}))
    else:
        # J.-E. is a compound name, J. E. a name and a middle initial
        compound = given[0].split("-") if given else []
        if len(given) > 1 and given[1].startswith("-"):
            compound = [given[0], given[1].strip("-")]
        inits = "".join(x for x in compound if x)
        middle = "".join(sorted({x.strip("-") for x in given[1:]} - ({compound[1]} if len(compound) > 1 and given[0].find("-") < 0 else set())))
    clean = lambda s: re.sub(r"[^\w]|_", "", s)
    return "p", clean("".join(full)), clean(inits), clean(middle), clean("".join(family)) or clean("".join(given))


@lru_cache(maxsize=50_000)
def _less(word: str) -> tuple[str, ...]:
    """The word and every form of it with one character left out: two words share one if a slip parts them."""
    return (word, *sorted({word[:k] + word[k + 1 :] for k in range(len(word))} - {word}))


def _keys(kind: str, given: str, inits: str, family: str, established: set[str] | frozenset[str]) -> Iterator[tuple[str, str, str]]:
    """(rule, role, key) of a profile. Rules in the order in which they apply:

    a  same given name, family names a slip or a spelling by ear apart: all merge
    b  same family name, given names a slip apart: merge unless two established names meet
    i, j, k  initials only (role i) with the same, the same-sounding, a slightly different family name: merge with the
       only full name (role f) that fits
    n, m  short form (role s) and full name (role f) with the same, a slightly different family name: merge if only one fits
    Rule d isn't among them: it has a key for each pair of family names that it confirms (``_two_slips``).
    """
    if kind == "x":
        return
    s = skeleton(family)
    if kind == "g":
        short = inits or given
        yield "n", "f" if given else "s", f"g|{short[:1]}{short[-1:]}|{family}"
        for w in _less(family):
            yield "a", "f", f"g|{given}|{inits}|{w}"
        return
    if given:
        for w in {*_less(family), *(_less("~" + s) if len(s) > 3 else ("~" + s,))}:
            if len(w.strip("~")) > 2 or w == family:
                yield "a", "f", f"{given}|{w}"
        for part in _PARTICLES:
            if len(part) > 1 and family.startswith(part) and len(family) - len(part) > 4:
                yield "a", "f", f"{given}|{family[len(part):]}"
        if len(given) > 2:
            for w in _less(given):
                yield "b", "f", f"{w}|{s}"
        for ini in {inits, inits[0]}:
            for w in {s, *(_less(s) if len(s) > 5 else ())}:
                yield "k", "f", f"{ini}|{w}"
            yield "i", "f", f"{ini}|{family}"
            yield "j", "f", f"{ini}|{s}"
        for full in SHORT.get(given, "").split():
            yield "n", "s", f"{full}|{s}"
            for w in _less(s):
                yield "m", "s", f"{full}|{w}"
        if given not in established and 3 <= len(given) <= 6:
            yield "n", "s", f"{given}*|{s}"
        yield "n", "f", f"{given}|{s}"
        if given in _FULL:
            for w in _less(s):
                yield "m", "f", f"{given}|{w}"
        if given in established:
            for k in range(3, min(7, len(given))):
                yield "n", "f", f"{given[:k]}*|{s}"
    elif inits:
        yield "i", "i", f"{inits}|{family}"
        yield "j", "i", f"{inits}|{s}"
        for w in {s, *(_less(s) if len(s) > 5 else ())}:
            yield "k", "i", f"{inits}|{w}"
    else:
        yield "a", "f", f"|{family}"


def _kept(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is in the one column of ``wanted``, which is broadcast if its measured size allows."""
    few = wanted.count() * 48 <= BROADCAST_BYTES
    return rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), key, "left_semi")


def _two_slips(profiles: DataFrame) -> DataFrame:
    """(pid, rule, role, key) of rule d: same given name, family names two slips apart, confirmed by their edit distance.

    Names meet under their forms with none, one and two letters left out, whatever the length of each. Only hashes of forms
    travel, to be counted; forms that one name has alone are gone before names are paired. The distinct family names of one
    given name that hold one form and two letters more at most are few, however many rows bear them. The form that two share
    has at least SHARED letters; of a shorter name two slips leave too little to tell it from another name.
    """
    named = profiles.where("kind = 'p' and given <> ''")
    words = named.select("given", "family").repartition(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "given", "family").distinct()
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    once = F.array_distinct(F.concat(F.array("family"), less(F.col("family"))))
    forms = F.filter(F.flatten(F.transform(once, lambda w: F.concat(F.array(w), less(w)))), lambda w: F.length(w) >= SHARED)
    formed = words.select(F.xxhash64("given", "family").alias("word"), F.explode(F.array_distinct(F.transform(forms, lambda w: F.xxhash64("given", w)))).alias("form"))
    common = cut(formed.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form"))
    kept = _kept(formed, common, "form")
    groups = kept.groupBy("form").agg(F.array_sort(F.collect_set("word")).alias("ws"))
    pairs = groups.select(F.explode(F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, F.size("ws")), lambda y: F.struct(x.alias("word"), y.alias("other")))))).alias("p")).select("p.word", "p.other").distinct()
    spelt = words.select(F.xxhash64("given", "family").alias("word"), "family")
    near = pairs.join(spelt.hint("merge"), "word").join(spelt.toDF("other", "family_b").hint("merge"), "other")
    # swapped letters are one slip but count twice in the edit distance: two swaps, or a swap and another slip; one slip is rule a's
    slips, letters = F.levenshtein("family", "family_b"), lambda c: F.array_sort(F.split(c, ""))
    swapped = F.transform(F.sequence(F.lit(1), F.greatest(F.length("family") - 1, F.lit(1))), lambda k: F.concat(F.substring("family", F.lit(1), k - 1), F.substring("family", k + 1, F.lit(1)), F.substring("family", k, F.lit(1)), F.substring("family", k + 2, F.length("family"))))
    one_more = F.exists(swapped, lambda w: F.levenshtein(w, F.col("family_b")) <= 1)
    near = near.where((slips == 2) | (slips > 2) & (slips <= 4) & (letters("family") == letters("family_b")) | (slips == 3) & one_more)
    met = near.select(F.explode(F.array("word", "other")).alias("word"), F.xxhash64("word", "other").alias("key"))
    mine = named.select("pid", F.xxhash64("given", "family").alias("word"))
    return mine.join(met.hint("merge"), "word").select("pid", F.lit("d").alias("rule"), F.lit("f").alias("role"), "key")


def established_names(names: DataFrame, column: str) -> DataFrame:
    """(g): given names borne by people of many families: at least ESTABLISHED of the usual number, and 3; each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b[column]:
                kind, given, inits, _, family = parse(t)
                if kind == "p" and len(given) > 1 and len(inits) == 1:
                    rows.append((given, family))
            yield pd.DataFrame(rows, columns=["g", "f"])

    pairs = names.select(column).mapInPandas(run, "g string, f string").distinct()
    counts = cut(pairs.groupBy("g").agg(F.count("*").alias("n")))
    usual = counts.agg(F.expr("percentile(n, 0.5D, n)")).first()[0] or 0
    return counts.where(F.col("n") >= max(3, ESTABLISHED * usual)).select("g")


def _with_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (key_, text_) with known_: the established given names among the words of the text, null where all tasks have them all."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {(t, w) for t in b["text_"] for x in re.split(r"[\s./,]+", fold(t).lower()) for w in (x, *x.split("-"), re.sub(r"[^\w]|_", "", x), *(re.sub(r"^(?:van|von|der|den|del|de|da|di|du|el|al|la|le)", "", x),)) if w}
            yield pd.DataFrame(sorted(out), columns=["text_", "g"])

    own = rows.select("text_").distinct().mapInPandas(words, "text_ string, g string").distinct()
    mine = own.join(known.hint("merge"), "g").groupBy("text_").agg(F.collect_set("g").alias("known_"))
    return rows.join(mine.hint("merge"), "text_", "left").select("key_", "text_", F.coalesce("known_", F.array().cast("array<string>")).alias("known_"))


#: Rules whose profiles of role f are the only ones that a profile of another role may join, with their rank.
_PARTIAL = {"i": 0, "I": 0, "n": 0, "j": 1, "k": 2, "m": 2}


def _split(met: DataFrame) -> DataFrame:
    """(cid, star): merges within blocks of rules a and b whose marks conflict, one sub-block a mark.

    Where middle initials conflict only equal ones meet, none with none. Of rule b, a profile without an established name
    goes to the one that it is a slip away from; if it is so from two it goes to none.
    """
    mine, letters = F.coalesce("name", F.when(F.col("name_lo") == F.col("name_hi"), F.col("name_lo"))), lambda c: F.array_sort(F.split(c, ""))
    slip = lambda n: (F.levenshtein("given", n) <= 1) | (F.levenshtein("given", n) == 2) & (letters("given") == letters(n))
    near = F.when(F.col("rule") == "b", F.filter("names", slip)).otherwise(F.array().cast("array<string>"))
    # '' for no mark; no sub-block for two
    name = F.when(F.col("rule") == "a", "").when(mine.isNotNull(), mine).when(F.col("name_lo").isNotNull() | (F.size(near) > 1), None).otherwise(F.coalesce(F.try_element_at(near, F.lit(1)), F.lit("")))
    middle = F.when(F.col("m0").isNull() | (F.col("m0") == F.col("m1")), "").when(F.col("mid_lo").isNull(), "").when(F.col("mid_lo") == F.col("mid_hi"), F.col("mid_lo"))
    marked = met.select("cid", "rule", "key", name.alias("name"), middle.alias("middle")).where("name is not null and middle is not null")
    heads = marked.groupBy("rule", "key", "name", "middle").agg(F.min("cid").alias("star"), F.max("cid").alias("last")).where("star <> last").drop("last")
    return marked.join(heads.hint("merge"), ["rule", "key", "name", "middle"]).select("cid", "star").distinct()


def _blocks(keyed: DataFrame) -> DataFrame:
    """The rows (rule, key, role, cid, given, name, mid_lo, mid_hi, name_lo, name_hi, solo) of blocks of several clusters, each with its block's summary.

    mid_lo, mid_hi: least and largest middle initial of the cluster; name_lo, name_hi: of its established given names;
    solo: whether all of the cluster are initials only. Every block is summed up once and the summary goes back to its
    members. A middle initial makes a second, narrower block: A of rule a, I of rule i.
    """
    own = (F.col("mid_lo") == F.col("mid_hi")) & F.col("rule").isin("a", "i")
    wide = F.struct(F.col("rule").alias("rule"), F.col("key").alias("key"))
    narrow = F.struct(F.upper("rule").alias("rule"), F.xxhash64("key", "mid_lo").alias("key"))
    rows = keyed.withColumn("block", F.explode(F.when(own, F.array(wide, narrow)).otherwise(F.array(wide)))).drop("rule", "key").select("*", "block.rule", "block.key").drop("block")
    full, sole_name = F.col("role") == "f", F.when(F.col("name_lo") == F.col("name_hi"), F.col("name_lo"))
    blocks = rows.groupBy("rule", "key").agg(
        F.min("cid").alias("head"), F.max("cid").alias("tail"), F.min("mid_lo").alias("m0"), F.max("mid_hi").alias("m1"), F.min("name_lo").alias("g0"), F.max("name_hi").alias("g1"), F.collect_set(F.when(F.col("rule") == "b", F.coalesce("name", sole_name))).alias("names"),
        F.min(F.when(full, F.col("cid"))).alias("f0"), F.max(F.when(full, F.col("cid"))).alias("f1"), F.min(F.when(full, F.col("mid_lo"))).alias("fm0"), F.max(F.when(full, F.col("mid_hi"))).alias("fm1"),
    ).where("head <> tail")
    return rows.join(blocks.hint("merge"), ["rule", "key"])


def _moves(met: DataFrame) -> DataFrame:
    """(cid, to): clusters that merge into another, from the rows of ``_blocks``; a cluster moves to the smallest one that it may join."""
    full = F.col("role") == "f"
    one_middle = F.col("m0").isNull() | (F.col("m0") == F.col("m1"))
    one_name = F.col("g0").isNull() | (F.col("g0") == F.col("g1"))
    whole = (
        F.col("rule").isin("a", "A", "d") & one_middle
        | (F.col("rule") == "b") & one_middle & one_name
        | F.col("rule").isin("i", "I") & F.col("f0").isNull() & F.col("solo") & one_middle
    )
    part = F.col("rule").isin(*_PARTIAL) & (~full) & F.col("f0").isNotNull() & (F.col("solo") | F.col("rule").isin("n", "m"))
    fits = F.col("mid_lo").isNull() | F.col("fm0").isNull() | ((F.col("mid_lo") == F.col("fm0")) & (F.col("mid_hi") == F.col("fm1")))
    ranks = F.create_map(*[F.lit(x) for kv in _PARTIAL.items() for x in kv])
    found = met.where(whole | part).select("cid", F.when(whole, F.col("head")).alias("star"), F.when(~whole, F.try_element_at(ranks, F.col("rule"))).alias("rank"), "f0", "f1", (fits | (F.col("rule") == "I")).alias("fits"), (F.col("rule") == "I").alias("mid"))
    # what a partial profile may join: all blocks of its narrowest rule must name one cluster; a matching middle initial settles it
    found = found.unionByName(_split(met.where(F.col("rule").isin("a", "b") & ~(one_middle & ((F.col("rule") == "a") | one_name)))), allowMissingColumns=True)
    each = found.groupBy("cid", "star", "rank").agg(F.min("f0").alias("t0"), F.max("f1").alias("t1"), F.min("fits").alias("ok"), F.min(F.when(F.col("mid"), F.col("f0"))).alias("i0"), F.max(F.when(F.col("mid"), F.col("f1"))).alias("i1"))
    best = each.groupBy("cid").agg(F.min("star").alias("star"), F.min_by(F.struct("t0", "t1", "ok", "i0", "i1"), "rank").alias("p"))
    sole = F.when(F.col("p.i0") == F.col("p.i1"), F.col("p.i0")).when((F.col("p.t0") == F.col("p.t1")) & F.col("p.ok") & F.col("p.i0").isNull(), F.col("p.t0"))
    both = best.select("cid", F.explode(F.array("star", sole)).alias("other")).where("other is not null and other <> cid")
    return both.select(F.greatest("cid", "other").alias("cid"), F.least("cid", "other").alias("to")).groupBy("cid").agg(F.min("to").alias("to"))


def resolve(names: DataFrame, key: str, column: str) -> DataFrame:
    """(``key``, entity): the smallest profile id of the person or group that each spelling names.

    Spellings that differ only in odd characters, accents, letter case, titles or order fall together before any
    matching. Nulls have no entity; a text without letters is an entity of its own kind; the same spelling in
    several rows is one profile. Entities don't depend on the order of rows. An empty table gives none.
    """
    rows = names.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{column}`").alias("text_")).where("text_ is not null")
    known = established_names(rows, "text_")
    size = known.agg(F.sum(F.octet_length("g") + 64)).first()[0] or 0
    few = size <= GIVEN_BYTES
    shared = names.sparkSession.sparkContext.broadcast(frozenset(r["g"] for r in known.toLocalIterator()) if few else frozenset())
    if not few:
        rows = _with_known(rows, known)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = shared.value | _FULL
        for b in batches:
            sets = [every] * len(b) if few else [_FULL.union(x) for x in b["known_"]]
            p = [parse(t, k) for t, k in zip(b["text_"], sets, strict=True)]
            out = pd.DataFrame(p, columns=["kind", "given", "inits", "middle", "family"])
            out.insert(0, "key_", b["key_"].to_numpy())
            out["name"] = [g if g in k else None for g, k in zip(out["given"], sets, strict=True)]
            yield out

    kind = dict(rows.dtypes)["key_"]
    fields = ["kind", "given", "inits", "middle", "family"]
    parsed = rows.mapInPandas(read, f"key_ {kind}, " + ", ".join(f"{f} string" for f in [*fields, "name"]))
    parsed = cut(parsed.withColumn("pid", F.xxhash64(*fields)))
    # each profile has some thirty keys and forms: as many tasks as a shuffle has, however small the profiles are
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    profiles = cut(parsed.drop("key_").repartition(tasks, "pid").dropDuplicates(["pid"]))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (pid, rule, role, k)
                for pid, kd, g, i, f, n in zip(b["pid"], b["kind"], b["given"], b["inits"], b["family"], b["name"], strict=True)
                for rule, role, k in set(_keys(kd, g, i, f, {n} if n else frozenset()))
            ]
            yield pd.DataFrame(out, columns=["pid", "rule", "role", "k"])

    made = profiles.select("pid", "name", *fields).mapInPandas(emit, "pid long, rule string, role string, k string")
    made = cut(made.select("pid", "rule", "role", F.xxhash64("rule", "k").alias("key")))
    # most keys are held by one profile and can never merge anything: only their counts travel
    counts = made.groupBy("key").agg(F.count("*").alias("n"), F.max((F.col("role") != "f").cast("int")).alias("s"), F.min("rule").alias("r"))
    several = cut(counts.where("n > 1 and (r not in ('i', 'j', 'k', 'n', 'm') or s = 1)").select("key"))
    keys = _kept(made, several, "key").select("pid", "rule", "role", "key").union(_two_slips(profiles))
    only_b = lambda c: F.when(F.col("rule") == "b", F.col(c)).alias(c)
    keys = cut(keys.join(profiles.select("pid", "given", "name").hint("merge"), "pid").select("rule", "key", "role", F.col("pid").alias("cid"), only_b("given"), only_b("name")))
    facts = cut(profiles.select("pid", F.nullif("middle", F.lit("")).alias("middle"), "name", ((F.col("given") == "") & (F.col("inits") != "")).alias("solo"), F.col("pid").alias("cid")))

    late, turn = F.col("rule").isin("j", "k", "m", "d"), 0
    open_, waiting = keys.where(~late), keys.where(late)
    while True:
        whole = facts.groupBy("cid").agg(F.min("middle").alias("mid_lo"), F.max("middle").alias("mid_hi"), F.min("name").alias("name_lo"), F.max("name").alias("name_hi"), F.min("solo").alias("solo"))
        # blocks that have come down to one cluster can merge nothing any more and are left behind
        met = cut(_blocks(open_.join(whole.hint("merge"), "cid")))
        moves = _moves(met)
        # a move to a cluster that moves itself goes on to where that goes
        onward = moves.select(F.col("cid").alias("to"), F.col("to").alias("further"))
        moves = cut(moves.join(onward.hint("merge"), "to", "left").select("cid", F.coalesce("further", "to").alias("to")))
        if moves.isEmpty():
            if turn:
                break
        facts = cut(facts.join(moves.hint("merge"), "cid", "left").withColumn("cid", F.coalesce("to", "cid")).drop("to"))
        left = met.where(~F.col("rule").isin("A", "I")).select(*keys.columns)
        left = left.union(waiting) if turn == 0 else left
        open_ = left.join(moves.hint("merge"), "cid", "left").withColumn("cid", F.coalesce("to", "cid")).select(*keys.columns).distinct()
        turn += 1
    return parsed.join(facts.select("pid", F.col("cid").alias("entity")).hint("merge"), "pid").select(F.col("key_").alias(key), "entity")


def linked_pairs(entities: DataFrame, key: str) -> DataFrame:
    """(``key``_a, ``key``_b): each pair of spellings of one entity, smaller key first."""
    left, right = entities.select(F.col(key).alias(f"{key}_a"), "entity"), entities.select(F.col(key).alias(f"{key}_b"), "entity")
    return left.join(right.hint("merge"), "entity").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
