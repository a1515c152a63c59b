"""Operators for training data against brute force, round trips and hard cases."""

from __future__ import annotations

import random
from itertools import combinations
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biblioweave.llm import leakage, lookalike, mixing, mojibake, people, together


def test_canonical_forms() -> None:
    for text, wanted in (
        ("Аdelа Сole", "Adela Cole"), ("Ｃｏｌｅ", "Cole"), ("Mosórben", "Mosórben"), ("Jo​hn C.", "John C."), ("ﬁne Guﬆav", "fine Gustav"), ("\U0001d400da", "Ada"), ("Kira", "Kira"), ("Frances Mosórben", "Frances Mosórben"),
        ("Коды исправления", "Коды исправления"), ("A δ-family", "A δ-family"), ("Коды исправления ошибок", "Коды исправления ошибок"), ("“a” – b’s … é", "“a” – b’s … é"), ("αlpha", "alpha"), ("", ""), ("a\tb\nc ", "a\tb\nc "), ("量子鍵配送 4", "量子鍵配送 4"),
    ):
        assert lookalike.canonical(text) == wanted, text


def test_working_characters_stay() -> None:
    for text in ("می\u200cخواهم", "क\u094d\u200dष", "👩\u200d🔬 and ☕\ufe0f, 1\ufe0f\u20e3", "\u200fשלום (QKD)\u200e", "한국어", "வணக்கம்"):
        assert lookalike.canonical(text) == text, text
    for text, wanted in (("Co\u200dle", "Cole"), ("A\u200c\u200cda", "Ada"), ("Ada\ufe0f", "Ada"), ("\u200eAda", "Ada"), ("\u1112\u1161\u11ab", "한"), ("so\u00adft", "soft"), ("क\u200d ", "क ")):
        assert lookalike.canonical(text) == wanted, text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_canonical_is_idempotent(text: str) -> None:
    once = lookalike.canonical(text)
    assert lookalike.canonical(once) == once


def test_unify(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "plain"), (2, None), (3, ""), (4, "Аda"), (5, "é"), (6, "x" * 200_000 + "​"), (6, "Аda")], "Id long, t string").withColumnRenamed("Id", "id")
    assert sorted((r["id"], len(r["after"])) for r in lookalike.unify(df.selectExpr("id", "t", "1 as before", "2 as after"), "id", "t").collect()) == [(4, 3), (6, 3), (6, 200_000)]
    assert lookalike.unify(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(together, "TILE", 4)
    rng = random.Random(seed)
    rows = [(f"p{rng.randrange(25)}", f"a{rng.randrange(12)}") for _ in range(150)] + [("big", f"a{k}") for k in range(12)] + [(None, "a1"), ("p1", None)]
    df = spark.createDataFrame(rows, "basket string, item string").selectExpr("basket", "item", "1 as n_", "2 as pair_")
    sets: dict[str, set[str]] = {}
    for b, i in rows:
        if b and i:
            sets.setdefault(b, set()).add(i)
    count: dict = {}
    for s in sets.values():
        for pair in combinations(sorted(s), 2):
            count[pair] = count.get(pair, 0) + 1
    got = {(r["item_a"], r["item_b"]): r for r in together.associations(df, "basket", "item").collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == count
    n, na = len(sets), {i: sum(i in s for s in sets.values()) for i in {x for s in sets.values() for x in s}}
    assert all(r["n"] == n and r["n_a"] == na[k[0]] and abs(r["lift"] - r["n_ab"] * n / (na[k[0]] * na[k[1]])) < 1e-9 for k, r in got.items())
    some = {(r["item_a"], r["item_b"]) for r in together.associations(df, "basket", "item", 2, 1.2).collect()}
    assert some == {k for k, c in count.items() if c >= 2 and c * n >= 1.2 * na[k[0]] * na[k[1]]}
    assert together.associations(df.limit(0), "basket", "item").count() == 0


def _brute(item: list[str], doc: list[str]) -> bool:
    """Whether some stretch of 20 item words or more aligns with a stretch of the document by one edit in nine words."""
    n, m = len(item), len(doc)
    for a in range(n):
        # edit distance of item[a:] prefixes to document stretches from every start
        row = [0] * (m + 1)
        for i in range(a, n):
            new = [i - a + 1]
            for j in range(1, m + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (item[i] != doc[j - 1])))
            row = new
            if i - a + 1 >= 20 and min(row) * 9 <= i - a + 1:
                return True
    return False


def test_leaks_equal_brute_force(spark) -> None:  # noqa: ANN001
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(25, 60))] for _ in range(6)]
    docs = []
    for _ in range(60):
        item, size = rng.choice(items), rng.choice([8, 12, 15, 22, 24])
        a = rng.randrange(len(item) - size + 1)
        part = list(item[a : a + size])
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(1, len(part) - 1)
            part[k : k + 1] = [rng.choice(vocab)] if rng.random() < 0.5 else [part[k], rng.choice(vocab)]
        docs.append([rng.choice(vocab) for _ in range(rng.randrange(40))] + part + [rng.choice(vocab) for _ in range(rng.randrange(40))])
    text = [(k, (", ".join(d).upper() if k % 2 else " \n".join(d))) for k, d in enumerate(docs)] + [(90, None), (91, ""), (92, "short")]
    ddf, idf = spark.createDataFrame(text, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, None), (51, "few words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(ddf, idf).collect()}
    want = {(k, i) for k, d in enumerate(docs) for i, x in enumerate(items) if _brute(x, d)}
    assert got == want and want
    assert leakage.leaked(ddf, idf.limit(0)).count() == 0 and leakage.leaked(ddf.limit(0), idf).count() == 0


def test_items_beyond_one_block(spark, monkeypatch) -> None:  # noqa: ANN001
    words = [f"word{k}" for k in range(60)]
    rng = random.Random(8)
    texts = [" ".join(words)] * 2 + [" ".join(words[a : a + rng.randrange(15, 40)]) for a in range(0, 40, 3)] + [None, "", "short"]
    items = spark.createDataFrame([*((k, " ".join(words[k : k + 25])) for k in range(0, 30, 10)), (77, None), (78, "few words")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as item_", "2 as h_")
    docs = docs.union(docs.where("doc_id = 0"))
    whole = sorted(map(tuple, leakage.leaked(docs, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 150)
    assert sorted(map(tuple, leakage.leaked(docs, items).collect())) == whole and len([r for r in whole if r[0] == 0]) == 6
    assert leakage.leaked(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("length", [1, 10, 30, 60])
def test_words_put_in_however_long(length) -> None:  # noqa: ANN001
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for size in (2, 6):
        item = [word(size) for _ in range(40)]
        index = leakage.Index([7], [" ".join(item)])
        assert index.least[0] >= 1
        for _ in range(40):
            a = rng.randrange(20)
            part = item[a : a + 20]
            for k in sorted(rng.sample(range(1, 19), 2), reverse=True):
                part.insert(k, word(length))
            assert leakage._leaks(index, [" ".join(["other", "words", *part, "then", "more"])]), (length, part)


def test_passage_equals_brute_force() -> None:
    rng = random.Random(11)
    for _ in range(150):
        vocab = [f"w{k}" for k in range(rng.choice([6, 30, 200]))]
        item = [rng.choice(vocab) for _ in range(rng.randrange(20, 40))]
        doc = list(item)
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(doc))
            doc[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [doc[k], rng.choice(vocab)]])
        assert (leakage.passage(item, doc, -60, 60)[0] > 0) == _brute(item, doc), (item, doc)


SAMPLES = {
    "Für Messgeräte genügt Kühlung, falls die Störung zuverlässig bleibt – “so” Zoë’s Idee.": ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250"],
    "Кроме того, квантовой памяти остаётся устойчиво.": ["cp1252", "cp1251", "latin-1"],
    "Źródło opisuje pamięci długożyjącej i część łączności.": ["cp1250", "cp1252", "latin-1"],
}


def _misread(text: str, table: str) -> str:
    """UTF-8 read in a one-byte table, undefined bytes as controls."""
    back = {v: k for k, v in mojibake._table("cp1252" if table == "latin-1" else table).items()}
    return text.encode().decode("latin-1") if table == "latin-1" else "".join(back[b] for b in text.encode())


def test_round_trips() -> None:
    for text, tables in SAMPLES.items():
        assert mojibake.restore(text) == (text, 0, False)
        for t in tables:
            bad = _misread(text, t)
            got, layers, flagged = mojibake.restore("Plain words first. " + bad)
            assert flagged and got == "Plain words first. " + text, (t, got)
            if t == "cp1252":
                assert mojibake.restore(_misread(bad, t))[:2] == (text, 2)
    for written, read in (("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r")):
        text = "Кроме того, квантовой памяти остаётся устойчиво."
        assert mojibake.restore(text.encode(written).decode(read))[0] == text
    assert mojibake.restore("Caf\ufffd talk")[2]


#: One proper sentence a script or language.
PROPER = {
    "Korean": "양자 키 분배는 두 당사자가 안전한 비밀 키를 공유하도록 한다.", "Arabic": "تتيح ميكانيكا الكم توزيع المفاتيح بطريقة آمنة بين طرفين.", "Hebrew": "הפצת מפתחות קוונטית מאפשרת לשני צדדים לשתף מפתח סודי.",
    "Hindi": "क्वांटम कुंजी वितरण दो पक्षों को एक गुप्त कुंजी साझा करने देता है।", "Thai": "การแจกจ่ายกุญแจควอนตัมช่วยให้สองฝ่ายแบ่งปันกุญแจลับได้", "Chinese": "量子密钥分发使双方能够共享一个安全的秘密密钥。",
    "Greek": "Η κβαντική διανομή κλειδιών επιτρέπει σε δύο μέρη να μοιραστούν ένα μυστικό κλειδί.", "Georgian": "კვანტური გასაღების განაწილება ორ მხარეს საშუალებას აძლევს.", "Bengali": "কোয়ান্টাম কী বিতরণ দুটি পক্ষকে একটি গোপন কী ভাগ করতে দেয়।",
    "Tamil": "குவாண்டம் விசை பகிர்வு இரு தரப்பினரையும் ரகசிய விசையைப் பகிர அனுமதிக்கிறது.", "Armenian": "Քվանտային բանալիների բաշխումը թույլ է տալիս երկու կողմերին կիսվել։", "Japanese": "量子鍵配送は二者が安全な秘密鍵を共有することを可能にする。",
    "Serbian": "Квантна расподела кључева омогућава двема странама да деле тајни кључ.", "Turkish": "Kuantum anahtar dağıtımı iki tarafın gizli bir anahtarı paylaşmasını sağlar.", "Icelandic": "Það er þessi þjóð sem á sér ævintýri og ást.",
    "Persian": "توزیع کلید کوانتومی به دو طرف اجازه می\u200cدهد کلیدی مخفی را به اشتراک بگذارند.",
}


@pytest.mark.parametrize("name", sorted(PROPER))
def test_every_script(name) -> None:  # noqa: ANN001
    text = PROPER[name]
    assert mojibake.restore(text) == (text, 0, False)
    for table in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp1253", "koi8_r"):
        got, _, flagged = mojibake.restore(_misread(text, table))
        assert flagged and got == text, (table, got)


def test_more_proper_texts() -> None:
    for text in ("Phân phối khóa lượng tử cho phép hai bên chia sẻ một khóa bí mật.", "Great talk 👍🏽👩\u200d🔬 – café ☕ → done ✅", "The QKD 프로토콜 and 量子 memory: α-particles, µm, 25 °C, naïve façade (“quoted”) – ok… © 2020 ™ → ≤ ∞ ✓ €5", "Let ψ∈ℋ, then ⟨ψ|A|ψ⟩ ≥ 0 ∀ψ; ∑ᵢ pᵢ = 1, x² + y³ ≠ z⁴, ½ ≈ 0.5, Δt·ΔE ≥ ħ/2.", "ÉCOLE NORMALE SUPÉRIEURE – ÜBERSICHT, GRÖSSE, ŁÓDŹ, ŻÓŁĆ", "¿Qué país está más allá? El niño de París.", "Квантовий розподіл ключів дозволяє двом сторонам її обмінятися ключем.", "量子金鑰分發使雙方能夠共享一個安全的祕密金鑰。"):
        assert mojibake.restore(text) == (text, 0, False), text


def test_proper_texts_stay() -> None:
    for text in ("SÃO BRÁS ROOM — CAFÉ À LA CARTE, 23 places", "Operator Â acts on |ψ⟩ with α ≤ 60.", "│ 70 │ 358 │ Ångström scale", "Registration: £ 32 or € 64; set-point 32 °C ± 2.", "Ð and þ label the 28 edges.", "© archive team – naïve reader’s guide, 72 pp.", "Résumé: 75 × 145 pixels", "ATENÇÃO: A SESSÃO SOBRE A FUNÇÃO DE DECISÃO MUDOU DE SALÃO.", "次の課題は雑音モデルである。", "СЕКЦИЯ О КВАНТОВОЙ ПАМЯТИ", "√π and ∫", ""):
        assert mojibake.restore(text) == (text, 0, False), text


def test_repair(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(1, "CafÃ©"), (2, None), (3, ""), (4, "ok"), (5, "x" * 100_000 + " CafÃ©"), (1, "CafÃ©")], "doc_id long, text string").selectExpr("*", "1 as restored", "2 as layers")
    got = sorted((r["doc_id"], r["restored"][-4:], r["complete"]) for r in mojibake.repair(df, "doc_id", "text").collect())
    assert got == [(1, "Café", True), (1, "Café", True), (5, "Café", True)]


VOCABULARY = pytest.mark.skipif(not Path(mixing.VOCABULARY).exists(), reason="no vocabulary here")


@VOCABULARY
def test_mix(spark) -> None:  # noqa: ANN001
    rng = random.Random(3)
    rows = [(k, s, "word " * rng.randrange(5, 40)) for k, s in enumerate(["a"] * 400 + ["b"] * 60 + ["c"] * 20)] + [(900, None, "x"), (901, "z", "x"), (902, "a", None), (903, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as slot", "2 as tokens")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets, block_tokens=100)
    s = {r["source"]: r for r in mixing.shares(m).collect()}
    total = sum(r["tokens"] for r in s.values())
    for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(s[k]["reached_share"] - share) < 0.02 and abs(s[k]["tokens"] / total - s[k]["reached_share"]) < 1e-9
    uses = m.groupBy("source", "doc_id").count().collect()
    most = {"a": 1, "b": 3, "c": 4}
    assert all(r["count"] <= most[r["source"]] for r in uses) and not {900, 901, 902, 903} & {r["doc_id"] for r in uses}
    assert mixing.mix(docs.limit(0), targets).count() == 0
    half = sum(r["tokens"] for r in mixing.mix(docs, targets, total=total // 2).collect())
    assert abs(half - total / 2) < total * 0.05
    # every stretch of the schedule is mixed: the first half has the shares as well
    order = [r["source"] for r in m.orderBy("slot").collect()]
    head = order[: len(order) // 2]
    assert abs(head.count("c") / len(head) - order.count("c") / len(order)) < 0.05


@VOCABULARY
def test_token_counts(spark, monkeypatch) -> None:  # noqa: ANN001
    text = "hello world, it's  a\n\ntest   of 17 things;\t" * 3_000 + "x" * 3_000
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, text)], "id long, t string")
    whole = {r["id"]: r["tokens"] for r in mixing.token_counts(df, "t").collect()}
    assert whole[1] == 2 and whole[2] == whole[3] == 0
    assert "".join(mixing._segments(text)) == text and "".join(mixing._segments("y" * 500_000)) == "y" * 500_000
    monkeypatch.setattr(mixing, "_SEGMENT", 1_000)
    assert len(list(mixing._segments(text))) > 50
    assert {r["id"]: r["tokens"] for r in mixing.token_counts(df, "t").collect()} == whole


@VOCABULARY
def test_blocks_are_equal(spark) -> None:  # noqa: ANN001
    rng = random.Random(4)
    rows = [(k, "abc"[k % 3], "word " * rng.randrange(5, 40)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 2), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets, block_tokens=200)
    sizes = sorted(r["n"] for r in m.groupBy("slot").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect())
    # all but the last block of each source hold as many tokens, give or take a document at either end
    assert all(150 <= n <= 250 for n in sizes[3:])
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.01 for r in mixing.shares(m).collect())


def test_parse_names() -> None:
    known = {"ada", "eva", "hiro", "cyril", "esther"}
    for text, wanted in (
        ("Ada B. Cole", ("p", "ada", "a", "b", "cole")), ("COLE, Ada", ("p", "ada", "a", "", "cole")), ("COLE Ada", ("p", "ada", "a", "", "cole")), ("Zaurkuge Esther", ("p", "esther", "e", "", "zaurkuge")), ("A.B. Cole", ("p", "", "a", "b", "cole")),
        ("Prof. Dr. Ada van der Cole-Dunn", ("p", "ada", "a", "", "coledunn")), ("Hiro Cyril R. Cole", ("p", "hirocyril", "hc", "r", "cole")), ("A.-E. Cole", ("p", "", "ae", "", "cole")), ("Ada Cole Dunn", ("p", "ada", "a", "", "coledunn")), ("C.van der Cole", ("p", "", "c", "", "cole")),
        ("The Foo Quantum Optics Group", ("g", "qog", "", "", "foo")), ("Foo QO Group", ("g", "qog", "", "", "foo")), ("Quantum Group Foo", ("g", "", "qg", "", "foo")), ("", ("x", "", "", "", "")), ("17", ("x", "", "", "", "17")),
    ):
        assert people.parse(text, known) == wanted, text


def test_resolve(spark) -> None:  # noqa: ANN001
    groups = [
        ["Ada B. Kovalenkov", "Ada Kovalenkov", "KOVALENKOV, Ada", "A. Kovalenkov", "Аda Kovalenkov", "Ada Kovalenkow", "Ada Kovlaenkov", "Adda Kovalenkov", "A. B. Kovalenkov"],
        ["Eva Kovalenkov"], ["Edward van der Sturmen", "Ted Sturmen", "Sturmen Edward"], ["Edith Sturmeni"],
        ["Nardoval Quantum Optics Group", "The Nardoval QO Group", "Quantum Group Nardoval"], ["Zermatin Quantum Optics Group"], ["E. Dunwoody"], ["Emil Dunwoody"] , ["Ernst Dunwoody"], [""], ["--"],
    ]
    fill = [f"{g} {f}" for g in ("Ada", "Eva", "Edward", "Edith", "Emil", "Ernst") for f in ("Brastinok", "Clumvert", "Dropsig", "Frandul", "Glostem")]
    rows = [(k, t, g) for k, (t, g) in enumerate([(t, n) for n, x in enumerate(groups) for t in x] + [(t, 100 + n) for n, t in enumerate(fill)])]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(999, None)], "id long, name string").selectExpr("*", "1 as cid", "2 as pid")
    got = {r["id"]: r["entity"] for r in people.resolve(df, "id", "name").collect()}
    assert 999 not in got
    pairs = {(a, b) for (a, _, _), (b, _, _) in combinations(rows, 2) if got[a] == got[b]}
    want = {(a, b) for (a, _, g), (b, _, h) in combinations(rows, 2) if g == h}
    assert pairs == want, [(rows[a][1], rows[b][1]) for a, b in pairs ^ want]
    assert people.resolve(df.limit(0), "id", "name").count() == 0


def _linked(spark, names: list[str], fill: list[str]) -> set[frozenset[str]]:  # noqa: ANN001
    """The entities with two spellings or more among ``names``; ``fill`` only makes given names established."""
    df = spark.createDataFrame(list(enumerate([*names, *fill])), "id long, name string")
    found: dict = {}
    for r in people.resolve(df, "id", "name").collect():
        if r["id"] < len(names):
            found.setdefault(r["entity"], set()).add(names[r["id"]])
    return {frozenset(v) for v in found.values() if len(v) > 1}


def test_two_slips_of_unequal_length(spark) -> None:  # noqa: ANN001
    fill = [f"{g} {f}" for g in ("Ada", "Eva", "Hiro", "Emil") for f in ("Brastinok", "Clumvert", "Dropsigan", "Frandulmo")]
    pairs = [("Ada Drelvebas", "Ada Dtelveas"), ("Eva Tingaurso", "Eva Tngurso"), ("Hiro Jauznankum", "Hiro Jauznnum"), ("Emil Pauoroevil", "Emil Pauprievil"), ("Ada Kestromal", "Ada Ketsroaml")]
    others = ["Ada Kraus", "Ada Braun", "Eva Drelvebas", "Hiro Tngurso"]
    assert _linked(spark, [x for p in pairs for x in p] + others, fill) == {frozenset(p) for p in pairs}


def test_third_member_cancels_no_merge(spark) -> None:  # noqa: ANN001
    fill = [f"{g} {f}" for g in ("Maria", "Marina", "Anna", "Emil") for f in ("Brastinok", "Clumvert", "Dropsigan", "Frandulmo")]
    names = ["Maria Rosi", "Marria Rosi", "Marina Rosi", "Anna Kowalski", "Anna Kowalsko", "Anna B. Kowalski", "Anna C. Kowalski", "Anna B. Kowalsko", "Anna C. Kowalsko"]
    assert _linked(spark, names, fill) == {frozenset(names[k] for k in ks) for ks in ((0, 1), (3, 4), (5, 7), (6, 8))}


def test_two_slips_with_a_swap(spark) -> None:  # noqa: ANN001
    fill = [f"{g} {f}" for g in ("Ada", "Hiro", "Emil") for f in ("Brastinok", "Clumvert", "Dropsigan", "Frandulmo")]
    pairs = [("Ada Trevriznik", "Ada Trevrzink"), ("Hiro Feldovrie", "Hiro Felldovire"), ("Emil Skarludruvi", "Emil Slaruldruvi")]
    assert _linked(spark, [x for p in pairs for x in p], fill) == {frozenset(p) for p in pairs}


def test_planted_people(spark, capsys, monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(21)
    part = lambda: rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "", "l", "n", "r"])
    given = ["Ada", "Eva", "Hiro", "Emil", "Oskar", "Paula", "Rosa", "Tilo", "Vera", "Wanda"]
    families = sorted({(part() + part() + part() + part()).capitalize() for _ in range(70)})
    rows = []
    for n, f in enumerate(families):
        for g in rng.sample(given, 1 + (n % 3 == 0)):
            k, j = rng.randrange(1, len(f) - 2), rng.randrange(1, len(f) - 1)
            spelt = {f"{g} {f}", f"{f}, {g}", f"{f.upper()} {g}", f"Dr. {g} {f}", f"{g} {f[:k]}{f[k + 1]}{f[k]}{f[k + 2:]}", f"{g} {f[:j]}{f[j + 1:]}", f"{g}  {f}"}
            rows += [(x, (g, f)) for x in sorted(spelt)]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "id long, name string")
    got = {r["id"]: r["entity"] for r in people.resolve(df, "id", "name").collect()}
    pairs = {(a, b) for a, b in combinations(range(len(rows)), 2) if got[a] == got[b]}
    want = {(a, b) for a, b in combinations(range(len(rows)), 2) if rows[a][1] == rows[b][1]}
    recall, precision = len(pairs & want) / len(want), len(pairs & want) / len(pairs)
    with capsys.disabled():
        print(f" planted people: recall {recall:.3f}, precision {precision:.3f} of {len(want)} pairs")
    assert recall >= 0.97 and precision >= 0.99
    # established names beyond what every task may hold are joined to the spellings instead: the same entities
    monkeypatch.setattr(people, "GIVEN_BYTES", 0)
    assert {r["id"]: r["entity"] for r in people.resolve(df, "id", "name").collect()} == got
