"""Literal expectations of names, slugs, pages and checks."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.functions import names as N
from biblioweave.functions import validate as V


def evaluate(spark, f, *args):  # noqa: ANN001, ANN202
    schema = ", ".join(f"c{k} string" for k in range(len(args)))
    return spark.createDataFrame([tuple(args)], schema).select(f(*[F.col(f"c{k}") for k in range(len(args))]).alias("r")).first()["r"]


CASES = [
    (N.normalize_name, "Alice", "alice"), (N.normalize_name, "  alice  ", "alice"), (N.normalize_name, "José García", "jose garcia"), (N.normalize_name, "Müller", "muller"), (N.normalize_name, "Schrödinger", "schrodinger"),
    (N.normalize_name, "Cañón", "canon"), (N.normalize_name, "Čech", "cech"), (N.normalize_name, "Łukasz", "lukasz"), (N.normalize_name, "Alice\t\nBob", "alice bob"), (N.normalize_name, "Øresund", "oresund"), (N.normalize_name, "Åsa", "asa"),
    (N.normalize_name, "Jean-François", "jean-francois"), (N.normalize_name, "Nguyễn", "nguyen"), (N.normalize_name, "", ""), (N.normalize_name, None, None), (N.normalize_name, "é", "e"),
    (N.normalize_loose, "O'Brien", "obrien"), (N.normalize_loose, "Jean-Pierre", "jeanpierre"), (N.normalize_loose, "Dr. Smith", "dr smith"), (N.normalize_loose, "Smith, Jr.", "smith jr"),
    (N.extract_initials, "John von Neumann", "JVN"), (N.extract_initials, "Alice", "A"), (N.display_initials, "", "?"), (N.display_initials, "Ada", "AD"), (N.display_initials, "Ada B. Cole", "AC"),
    (N.importer_name, "Ravi V. Kulmenda", "ravi kulmenda"), (N.importer_name, "Srinivasan", "inivasan"), (N.importer_name, None, ""),
    (N.slugify, "Ådne Straße!", "adne-strasse"), (N.slugify, "--", None), (N.truncate, "x" * 81, "x" * 80 + "…"), (N.truncate, "short", "short"),
    (N.title_folded, "Naïve [remote] Codes!", "naive codes"), (N.title_plain, "Naïve: Codes", "naïve codes"), (N.title_unprefixed, "TUTORIAL: A_b c", "a_b c"), (N.strip_tags, "QIP2023 | Day 3: 2024 - Title", "Title"), (N.clean_latex, "$x$ \\emph{y} \\leq 3\\%", "x y ≤ 3%"),
    (X.youtube_id, "https://youtu.be/abcdefghijk", "abcdefghijk"), (X.youtube_id, "https://x.org", None), (X.arxiv_from_list, "https://doi.org/1, arXiv:2401.12345v2", "2401.12345"), (X.arxiv_bare, "arXiv:2401.12345v2", "2401.12345"),
    (X.loose_time, "at 9.05", "09:05"), (X.loose_time, "25:00", None), (X.importer_time, "9:05", "09:05:00"), (X.importer_time, "morning", None), (X.committee_of_heading, "Local Organising Committee", "local_organizing"), (X.committee_of_heading, "Programme Committee", "program"),
    (X.position_code, "co_chair", "member"), (X.position_code, "Co-Chair", "co_chair"), (X.position_code, None, "member"), (X.without_role, "Ada Cole, Uni X - co-chair", "Ada Cole, Uni X"), (X.flip_family_first, "Cole, Ada", "Ada Cole"),
    (X.speaker_of_summary, "A) Ada Cole - Title", "Ada Cole"), (X.speaker_of_summary, "A: Title | Ada Cole, Bob", "Ada Cole"), (X.title_of_summary, "A: Title | Ada", "Title"),
]


@pytest.mark.parametrize(("f", "given_", "wanted"), CASES)
def test_literal(spark, f, given_, wanted) -> None:  # noqa: ANN001
    assert evaluate(spark, f, given_) == wanted


def test_split_and_similarity(spark) -> None:  # noqa: ANN001
    for name, parts in (("John Smith", ("John", "Smith")), ("Ludwig van Beethoven", ("Ludwig", "van Beethoven")), ("Leonardo da Vinci", ("Leonardo", "da Vinci")), ("Galileo", (None, "Galileo")), ("", (None, None)), ("van Gogh", (None, "van Gogh"))):
        assert tuple(evaluate(spark, N.split_name, name)) == parts
    assert evaluate(spark, N.name_similarity, "José García", "Jose Garcia") == 1.0
    assert evaluate(spark, N.name_similarity, "O'Brien", "OBrien") == 0.95
    assert 0.3 < evaluate(spark, N.name_similarity, "Alice Smith", "Bob Smith") < 0.7
    assert evaluate(spark, N.name_similarity, "", "") == 1.0
    assert evaluate(spark, N.name_variants, "Albert Einstein") == ["albert einstein", "einstein", "a einstein"]
    assert evaluate(spark, N.title_tokens, "QIP2023: The Power of 2024 a codes") == ["qip2023", "power", "codes"][1:]


def test_conference_slugs(spark) -> None:  # noqa: ANN001
    good = {"qip-2024": ("QIP", 2024), "QCRYPT2011": ("QCRYPT", 2011), "Qcrypt-2018": ("QCRYPT", 2018), "tqc-2022": ("TQC", 2022), "qip-1998": ("QIP", 1998)}
    for s, v in good.items():
        assert tuple(evaluate(spark, N.conference_slug, s)) == v
    for s in ("invalid-2024", "ABC2024", "qip", "qcrypt-", "qip-abcd", "qip-1800", "qip-2200", None):
        assert evaluate(spark, N.conference_slug, s) is None


def test_pages_and_checks(spark) -> None:  # noqa: ANN001
    assert V.clamp(None, None) == (100, 0)
    assert V.clamp(10**18, None) == (1000, 0)
    assert V.clamp(-5, -100) == (1, 0)
    assert V.clamp(50, 200) == (50, 200)
    for url, ok in (("http://example.com", True), ("HTTPS://EXAMPLE.COM", True), ("javascript:alert(1)", False), ("https://", False), ("http://   ", False), ("file:///etc", False), ("", True), (None, True), ("https://x.org/" + "a" * 2048, False)):
        assert evaluate(spark, V.url_ok, url) is ok
    assert evaluate(spark, lambda c: V.text_fits(c, "name"), "é" * 128) is False
    for m, ok in (('{"a": 1}', True), ("[1]", False), ('"x"', False), (None, True), ('{"b": "' + "x" * 4096 + '"}', False)):
        assert evaluate(spark, V.metadata_ok, m) is ok
    assert evaluate(spark, V.orcid_ok, "0000-0001-2345-678X") is True
    assert evaluate(spark, V.orcid_ok, "0000-0001") is False


def test_extraction(spark) -> None:  # noqa: ANN001
    assert evaluate(spark, X.arxiv_ids, "arXiv:2401.12345 and arxiv.org/abs/2402.00001, 2401.12345") == ["2401.12345", "2402.00001"]
    assert evaluate(spark, X.arxiv_ids_any, "see quant-ph/0601001v2 and 1203.4567") == ["1203.4567", "quant-ph/0601001"]
    assert evaluate(spark, X.list_items, " a ;; b ;") == ["a", "b"]
    assert evaluate(spark, X.list_items_kept, "A;;C") == ["A", "", "C"]
    assert evaluate(spark, X.list_items, "  ") is None
    assert evaluate(spark, X.authors_of_text, "Ada Cole, Bob Dunn and Ada Cole.") == ["Ada Cole", "Bob Dunn"]
    assert tuple(evaluate(spark, X.name_and_affiliation, "Ada Cole (Uni (X), Y)")) == ("Ada Cole", "Uni (X), Y")
    assert tuple(evaluate(spark, X.name_and_affiliation, "Ada Cole, QMATH, Uni")) == ("Ada Cole", "QMATH, Uni")
    assert tuple(evaluate(spark, X.position_and_role, "PC chair")) == ("chair", "Program Chair")
    assert tuple(evaluate(spark, X.time_range, "9.30 - 10.20")) == ("09:30", 50)
    assert tuple(evaluate(spark, X.time_range, "10:00-09:00")) == ("10:00", -60)
    got = evaluate(spark, X.speaker_candidates, "Great codes - Ada Cole", "Speaker: Bob Dunn\nmore")
    assert [(r["name"], r["source"]) for r in got][:2] == [("Bob Dunn", "video_desc"), ("Ada Cole", "video_title")]
    assert evaluate(spark, lambda c: X.update_notes(c, {"yt_match": F.lit(0.5)}), "a; yt_match=0.9; x=1") == "a; x=1; yt_match=0.5"
    assert evaluate(spark, lambda c: X.paper_type(c, F.lit("")), "Invited plenary") == "invited"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalize_is_idempotent(spark, texts) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(N.normalize_name(F.col("t")).alias("a")).withColumn("b", N.normalize_name(F.col("a")))
    assert df.where("a <> b").count() == 0
