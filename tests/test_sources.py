"""Sources and schedules on hand-made files."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from biblioweave.functions import registered
from biblioweave.operators import linkage, matching, mutate, schedule
from biblioweave.sources import files

VOLUME = """<div class="card" data-permanent-id="document/10.1/V.2020.0"><h5>Front Matter</h5></div>
<div class="card" data-permanent-id="document/10.1/V.2020.3"><div class="category">Paper</div><h5 class="card-title"> On <i>graph</i> states </h5>
<span data-key="x.contributor.author" data-value="Cole, Ada"></span><span data-key="x.contributor.author" data-value="Bob Dunn"></span><div class="doi">DOI: 10.1/V.2020.3</div><a href="/p.pdf">PDF</a></div>
<div class="card" data-permanent-id="document/10.1/V.2020.4"><div class="category">Front Matter</div><h5>Preface</h5><span data-key="x.contributor.author" data-value="Fox, Eve"></span></div>
<div class="card" data-permanent-id="document/10.1/V.2020.5"><h5>No authors</h5></div>"""


def test_volume(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "v.html").write_text(VOLUME)
    rows = files.read_volume(spark, str(tmp_path)).collect()
    assert [(r["title"], r["authors"], r["doi"], r["presentation_url"]) for r in rows] == [("On graph states", "Ada Cole;Bob Dunn", "10.1/V.2020.3", "/p.pdf")]


def test_videos(spark, tmp_path) -> None:  # noqa: ANN001
    for k, v in enumerate(({"id": "a", "playlist_id": "P1", "channel_url": "https://c/x/"}, {"id": "b", "playlist_id": "P2"}, {"id": "c", "playlist_id": "P2", "title": "T"}, {"title": "no id"})):
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    (tmp_path / "bad.json").write_text("{broken")
    v = files.read_videos(spark, str(tmp_path))
    assert sorted(r["id"] for r in v.collect()) == ["a", "b", "c"]
    assert files.video_source(v).first()["source"].endswith("list=P2")
    assert files.video_source(v.withColumn("playlist_id", F.lit(""))).first()["source"] == "https://c/x/videos"
    assert files.video_source(v.limit(0)).count() == 0


SEEDS = """-- a comment, with (brackets)
INSERT INTO conferences (venue, year, city, is_virtual, url) VALUES
('QIP', 1999, 'Chicago', false, 'https://x/1999/'),
-- two
('TQC', 2010, 'L''Aquila (AQ)', true, NULL)
ON CONFLICT (venue, year) DO UPDATE SET url = EXCLUDED.url;"""


def test_seeds_are_upserted(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "s.sql").write_text(SEEDS)
    s = files.read_seeds(spark, str(tmp_path), "venue", "year", "city", "is_virtual", "url")
    assert sorted(map(tuple, s.collect())) == [("QIP", "1999", "Chicago", "false", "https://x/1999/"), ("TQC", "2010", "L'Aquila (AQ)", "true", None)]
    old = spark.createDataFrame([("QIP", "1999", "Old city", "old"), ("QIP", "2000", "Here", "kept")], "venue string, year string, city string, url string")
    new = mutate.upsert(old, s.select("venue", "year", "city", "url"), ["venue", "year"], "url")
    assert sorted((r["venue"], r["year"], r["city"], r["url"] or "") for r in new.collect()) == [("QIP", "1999", "Old city", "https://x/1999/"), ("QIP", "2000", "Here", "kept"), ("TQC", "2010", "L'Aquila (AQ)", "")]


def test_importer_columns(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([("Ada", "", "Uni", "1401.1, 1402.2", "TRUE")], "speaker string, affiliation string, affiliations string, arxiv_ids string, is_proceedings_track string")
    old, new = files.importer_columns(df).first(), files.importer_columns(df, True).first()
    assert (old["speakers"], old["affiliation"], old["arxiv_ids"], old["is_proceedings_track"]) == (None, None, ["1401.1, 1402.2"], False)
    assert (new["speakers"], new["affiliation"], new["arxiv_ids"], new["is_proceedings_track"]) == ("Ada", "Uni", ["1401.1", "1402.2"], True)


PAGE = """<h1>Programme</h1><h2>Committee</h2><h3>Chairs</h3><h2>Programme Committee</h2><p>Ada Cole</p><h3>Locals</h3><p>Bob Dunn</p><h2>Talks</h2><p>other</p>
<h2>Programme committee again</h2><p>late</p>"""


def test_section(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "p.html").write_text(PAGE)
    got = files.section(files.read_pages(spark, str(tmp_path)), "(?i)^(?:programme )?committee").orderBy("pos").collect()
    assert [r["text"] for r in got] == ["Ada Cole", "Bob Dunn"]


SCHEDULE = """<h3>Monday 27 January</h3><p>09:00-09:20 <strong>Codes for the noisy road</strong> Ada Cole, Bob Dunn</p>
<p>09:20-09:40 Merge: <strong>First merged contribution</strong> Eve Fox</p><p><strong>Second merged contribution</strong> Kim Lund</p><p><strong>Third merged contribution</strong></p>
<p>10:00-10:20 <strong>Short</strong></p><p><strong>An orphan without a time</strong></p><p>words</p><p><strong>Too far away for a time</strong></p>"""


def test_merged_schedule(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "s.html").write_text(SCHEDULE)
    got = {r["title"]: (r["day"], r["start"], r["minutes"], r["speaker"], r["is_merged"]) for r in schedule.merged_schedule(files.read_pages(spark, str(tmp_path)), F.col("text")).collect()}
    assert got["Codes for the noisy road"] == ("Monday 27 January", "09:00", 20, "Ada Cole", False)
    assert got["First merged contribution"][1:] == ("09:20", 20, "Eve Fox", True) and got["Second merged contribution"][1:] == ("09:20", 20, "Kim Lund", True) and got["Third merged contribution"][1] == "09:20"
    assert got["An orphan without a time"][1] == "10:00" and len(got) == 5


def test_timetable(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "t.html").write_text("<h2>Tuesday</h2><p>9:00 - 10:00 Codes</p><p>10:00-10:30 Coffee</p><p>10.30-11.00 Invited: more codes</p><p>11:00-11:20 <b>Lunch</b> codes</p><p>no time</p>")
    got = schedule.timetable(files.read_pages(spark, str(tmp_path)), F.lit("2026-01-26").cast("date")).orderBy("pos").collect()
    assert [(r["date"], r["start"], r["minutes"], r["paper_type"]) for r in got] == [(dt.date(2026, 1, 27), "09:00", 60, "invited"), (dt.date(2026, 1, 27), "10:30", 30, "invited"), (dt.date(2026, 1, 27), "11:00", 20, "regular")]


def test_rewrite_and_functions(spark, tmp_path) -> None:  # noqa: ANN001
    path = str(tmp_path / "c")
    files.write_csv(spark.createDataFrame([("a",)], "title string"), path)
    new = spark.createDataFrame([("b",), ("c",)], "title string")
    assert not files.rewrite_csv(new, path) and spark.read.csv(path, header=True).count() == 1
    assert files.rewrite_csv(new, path, commit=True) and spark.read.csv(path, header=True).count() == 2
    registered.register(spark)
    assert tuple(spark.sql("SELECT normalize_name(' José  García '), slugify('Ådne Straße!'), title_plain('A: b')").first()) == ("jose garcia", "adne-strasse", "a b")


def test_sticky_slugs(spark) -> None:  # noqa: ANN001
    schema = "author_id string, full_name string, family_name string, given_name string, created_at string"
    new = spark.createDataFrame([("n1", "Ada Cole", "Cole", "Ada", "2"), ("n2", "Ada Cole", "Cole", "Ada", "3"), ("n3", "Eve Fox", "Fox", "Eve", "1")], schema)
    taken = spark.createDataFrame([("cole-ada",), ("cole-ada-4",), ("dunn-bob",)], "slug string")
    assert {r["author_id"]: r["slug"] for r in linkage.sticky_slugs(new, taken).collect()} == {"n1": "cole-ada-5", "n2": "cole-ada-6", "n3": "fox-eve"}


def test_greedy_in_rounds(spark) -> None:  # noqa: ANN001
    import random

    rng = random.Random(2)
    rows = [("QIP", a, b, round(rng.random(), 1)) for a in range(12) for b in range(12) if rng.random() < 0.5]
    used, want = set(), set()
    for v, a, b, s in sorted(rows, key=lambda r: (-r[3], -r[1], -r[2])):
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            want.add((v, a, b, s))
    df = spark.createDataFrame(rows, "venue string, left_id long, right_id long, score double")
    got = matching.greedy_assignment(df, ["venue"])
    assert {(r["venue"], r["left_id"], r["right_id"], r["score"]) for r in got.collect()} == want
    assert matching.greedy_assignment(df.limit(0), ["venue"]).count() == 0


def test_a_repeated_batch_counts_once(spark, tmp_path) -> None:  # noqa: ANN001
    from biblioweave.streaming.incremental import upsert_batch

    apply = upsert_batch(str(tmp_path / "t"), ["venue"])
    batch = spark.createDataFrame([("QIP",), ("QIP",), ("TQC",)], "venue string")
    for number in (1, 1, 2):
        apply(batch, number)
    got = spark.read.parquet(str(tmp_path / "t")).groupBy("venue").agg(F.sum("n").alias("n")).collect()
    assert {r["venue"]: r["n"] for r in got} == {"QIP": 4, "TQC": 2}


def test_numbering_in_two_levels(spark, monkeypatch) -> None:  # noqa: ANN001
    from biblioweave.operators import ranks

    rows = [("ab"[k % 2] if k % 5 else None, (k * 7) % 31, None if k % 3 else f"v{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "g string, o int, v string").withColumn("id", F.monotonically_increasing_id())
    order = [F.col("o"), F.col("id")]
    run = lambda: (sorted(map(tuple, ranks.numbered(df, ["g"], order, "n").select("id", "n").collect())), sorted(map(str, ranks.carried(df, ["g"], order, F.col("v"), "c").select("id", "c").collect())))
    one = run()
    monkeypatch.setattr(ranks, "MOST_IN_TASK", 0)
    assert run() == one


def test_outcomes(spark) -> None:  # noqa: ANN001
    schema = "id long, p string, a string, pos int"
    old = spark.createDataFrame([(1, "p1", "a1", 1)], schema)
    new = spark.createDataFrame([(2, "p1", "a1", 2), (3, "p1", "a2", 1), (4, "p1", "a2", 2), (5, "p1", "a2", 3), (6, "p9", "a1", 1), (7, "p2", None, 1), (8, "p2", None, 0)], schema)
    parents = {"p": (spark.createDataFrame([("p1",), ("p2",)], "k string"), "k")}
    got = {r["id"]: (r["outcome"], r["code"]) for r in mutate.insert_outcomes(old, new, "id", [["p", "a"], ["p", "pos"]], parents, {"pos": F.col("pos") >= 1}).collect()}
    assert {k: v[0] for k, v in got.items()} == {2: "conflict", 3: "conflict", 4: "conflict", 5: "conflict", 6: "invalid", 7: "created", 8: "invalid"} and got[6][1] == 400
