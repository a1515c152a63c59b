"""Statistics, linkage, matching, search, changes and sources on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from biblioweave.functions import extract as X
from biblioweave.operators import linkage, matching, mutate, search, statistics
from biblioweave.sources import files
from biblioweave.streaming import incremental


def test_author_stats_equal_the_or_join(spark) -> None:  # noqa: ANN001
    rng = random.Random(1)
    for _ in range(3):
        conf = [(f"c{k}", rng.choice(["QIP", "TQC"]), 2000 + rng.randrange(3)) for k in range(4)]
        pubs = [(f"p{k}", rng.choice(conf)[0]) for k in range(6)]
        ships = list({(rng.choice(pubs)[0], f"a{rng.randrange(4)}") for _ in range(10)})
        roles = [(f"r{k}", f"a{rng.randrange(4)}", rng.choice(conf)[0], rng.choice(["chair", "co_chair", "area_chair", "member"])) for k in range(5)]
        cdf, pdf = spark.createDataFrame(conf, "conference_id string, venue string, year int"), spark.createDataFrame(pubs, "publication_id string, conference_id string")
        sdf = spark.createDataFrame(ships, "publication_id string, author_id string").withColumn("affiliation", F.lit(None).cast("string"))
        rdf = spark.createDataFrame(roles, "role_id string, author_id string, conference_id string, position string").withColumn("affiliation", F.lit(None).cast("string"))
        adf = spark.createDataFrame([(f"a{k}", None) for k in range(5)], "author_id string, affiliation string")
        for n, d in (("cdf", cdf), ("pdf", pdf), ("sdf", sdf), ("rdf", rdf), ("adf", adf)):
            d.createOrReplaceTempView(n)
        naive = spark.sql("""SELECT a.author_id, count(DISTINCT s.publication_id) p, count(DISTINCT r.role_id) r, count(DISTINCT CASE WHEN r.position IN ('chair', 'co_chair') THEN r.role_id END) l, min(c.year) f, max(c.year) t
            FROM adf a LEFT JOIN sdf s ON s.author_id = a.author_id LEFT JOIN pdf p ON p.publication_id = s.publication_id LEFT JOIN rdf r ON r.author_id = a.author_id
            LEFT JOIN cdf c ON c.conference_id = p.conference_id OR c.conference_id = r.conference_id GROUP BY 1 ORDER BY 1""").collect()
        ours = statistics.author_stats(adf, statistics.appearances(sdf, pdf, rdf), cdf).orderBy("author_id")
        got = ours.select("author_id", "publication_count", "committee_role_count", "leadership_count", "first_year", "last_year").collect()
        assert [tuple(x) for x in got] == [tuple(x) for x in naive]
        assert ours.where("author_id = 'a4'").first()["venues"] is None


def test_correlated_latest_is_safe(spark) -> None:  # noqa: ANN001
    x = spark.createDataFrame([(1, "x", 2001), (1, "y", 2003), (2, "z", 2000)], "k int, a string, y int")
    got = x.groupBy("k").agg(F.max_by("a", "y").alias("a"))
    assert {r["k"]: r["a"] for r in got.collect()} == {1: "y", 2: "z"}


def test_slugs_are_unique(spark) -> None:  # noqa: ANN001
    rows = [(f"{k:02}", full, fam, giv, k) for k, (full, fam, giv) in enumerate([("A", "a", None), ("A", "a", None), ("A 2", "a 2", None), ("A", "a", None), (None, None, None), (None, None, None)])]
    got = {r["author_id"]: r["slug"] for r in linkage.assign_slugs(spark.createDataFrame(rows, "author_id string, full_name string, family_name string, given_name string, created_at int")).collect()}
    assert got["00"] == "a" and got["02"] == "a-2" and got["04"] == "anon"
    assert len(set(got.values())) == len(rows)


def test_merge_keeps_one_row_a_publication(spark) -> None:  # noqa: ANN001
    authors = spark.createDataFrame([("1", "Ravi Kulmenda"), ("2", "Ravi V. Kulmenda"), ("3", "Ada"), ("4", ""), ("5", None)], "author_id string, full_name string")
    plan = linkage.merge_plan(authors)
    assert [tuple(r) for r in plan.collect()] == [("1", "2", "ravi kulmenda")]
    ships = spark.createDataFrame([(1, "p", "1", 1), (2, "p", "2", 2), (3, "q", "1", 1), (4, "q", "3", 2)], "authorship_id long, publication_id string, author_id string, author_position int")
    assert sorted(tuple(r) for r in linkage.merge_authorships(ships, plan).select("authorship_id", "publication_id", "author_id").collect()) == [(2, "p", "2"), (3, "q", "2"), (4, "q", "3")]


def test_get_or_create(spark) -> None:  # noqa: ANN001
    m = spark.createDataFrame([("Ada Cole", "X", 1), ("ada cole", "", 2), ("Bob", None, 3), ("", "y", 4), (None, "y", 5)], "name string, affiliation string, load_order int")
    a = spark.createDataFrame([("7", "Ada Cole")], "author_id string, full_name string")
    got = {r["name_key"]: r for r in linkage.get_or_create(m, a).collect()}
    assert set(got) == {"ada cole", "bob"}
    assert (got["ada cole"]["author_id"], got["ada cole"]["is_new"], got["ada cole"]["affiliation"]) == ("7", False, "X")
    assert got["bob"]["is_new"]


@pytest.mark.parametrize(("name", "wanted"), [("Ada Cole", ("Ada Cole", "exact")), ("A. Cole", ("Ada Cole", "family_only")), ("Cole", ("Ada Cole", "family_only")), ("Dunn", (None, "ambiguous")), ("Zed", (None, "none")), ("", (None, "none"))])
def test_match_person(spark, name, wanted) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(name, ["Ada Cole", "Bob Dunn", "Eve Dunn"])], "n string, a array<string>")
    assert tuple(df.select(linkage.match_person(F.col("n"), F.col("a")).alias("m")).first()["m"]) == wanted


def test_title_candidates_lose_none_and_assignment_is_one_to_one(spark) -> None:  # noqa: ANN001
    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(12)]
    make = lambda n: [(k, "v", " ".join(rng.sample(vocab, rng.randrange(1, 5)))) for k in range(n)]
    left, right = make(25), make(25)
    l, r = (spark.createDataFrame(x, "id long, block string, title string") for x in (left, right))
    got = {(x["left_id"], x["right_id"]): x["score"] for x in matching.title_candidates(l, r, ["block"]).collect()}
    brute = {}
    for a, _, s in left:
        for b, _, t in right:
            x, y = set(s.split()), set(t.split())
            if len(x & y) / len(x | y) >= matching.WEAK:
                brute[a, b] = len(x & y) / len(x | y)
    assert got == brute
    chosen = matching.greedy_assignment(matching.title_candidates(l, r, ["block"]), ["block"]).collect()
    assert len({x["left_id"] for x in chosen}) == len({x["right_id"] for x in chosen}) == len(chosen)
    order, used_l, used_r, want = sorted(((s, a, b) for (a, b), s in brute.items()), reverse=True), set(), set(), set()
    for _, a, b in order:
        if a not in used_l and b not in used_r:
            used_l.add(a), used_r.add(b), want.add((a, b))
    assert {(x["left_id"], x["right_id"]) for x in chosen} == want


def test_search(spark) -> None:  # noqa: ANN001
    assert [search.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "rate", "generalizations", "sky", "x1")] == ["caress", "poni", "relat", "hop", "rate", "gener", "sky", "x1"]
    docs = spark.createDataFrame([(1, "Quantum codes", None), (2, "On codes", "coding of codes"), (3, None, None)], "id long, title string, abstract string")
    assert [r["id"] for r in search.ranked(docs, "id", "title", "abstract", "code").collect()] == [2, 1]
    assert search.ranked(docs, "id", "title", "abstract", "the of").count() == 0


def test_changes(spark) -> None:  # noqa: ANN001
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "y")], "k int, v string, w string")
    assert sorted(map(tuple, mutate.patch(t, new, "k", "v", "w").collect())) == [(1, "a", "x"), (2, "b", "z")]
    assert sorted(map(tuple, mutate.upsert(t, new, ["k"], "w").collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "y")]
    assert sorted(map(tuple, mutate.insert_new(t, new.union(new), ["k"]).collect())) == [(1, "a", "x"), (2, "b", None), (3, "c", "y")]
    assert sorted(map(tuple, mutate.replace_children(t, new.where("k = 2"), "k").collect())) == [(1, "a", "x"), (2, None, "z")]
    good, bad = mutate.quarantine(t, {"w": F.col("w") == "x"})
    assert good.count() == bad.count() == 1


def test_refresh_swaps_versions(spark, tmp_path) -> None:  # noqa: ANN001
    base = str(tmp_path / "gold")
    mutate.refresh(spark, base, {"a": spark.range(3)})
    first = mutate.current(spark, base, "a")
    mutate.refresh(spark, base, {"a": spark.range(5)})
    assert (first.count(), mutate.current(spark, base, "a").count()) == (3, 5)


def test_csv_round_trip(spark, tmp_path) -> None:  # noqa: ANN001
    p, q = tmp_path / "one.csv", tmp_path / "two.csv"
    p.write_text('venue,year,title,speaker\r\nqip,2001,"a ""b"",\r\nc",Ada\r\nTQC,2002,d,\r\n')
    q.write_text("venue,year,title,authors\ntqc,2003,e,Ada; Bob\n")
    df = files.first_row_conference(files.read_csv(spark, str(p), str(q)))
    rows = {r["title"].replace("\r", ""): r for r in df.collect()}
    assert rows['a "b",\nc']["speaker"] == "Ada" and rows["d"]["venue"] == "QIP" and rows["d"]["year"] == 2001 and rows["e"]["speaker"] is None
    out = str(tmp_path / "out")
    files.write_csv(df.withColumn("authors", X.list_items(F.col("authors"))), out)
    back = files.read_csv(spark, out)
    assert back.where("title = 'e'").first()["authors"] == "Ada;Bob"
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_csv(df, out)


def test_other_sources(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "x.bib").write_text('@Talk{k1, title = {A {Nested} \n title}, author = "Ada and Bob", year = 2023}\n@Misc{k2, title={no}}')
    b = files.read_bibtex(spark, str(tmp_path / "x.bib")).collect()
    assert [(r["entry_id"], r["title"], r["author"], r["year"], r["url"]) for r in b] == [("k1", "A {Nested} title", "Ada and Bob", "2023", None)]
    (tmp_path / "x.ics").write_text("BEGIN:VEVENT\r\nDTSTART:20230724T090000Z\r\nDTEND:20230724T093000Z\r\nSUMMARY:A) Ada - Long\r\n  title\\, more\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20220101\r\nEND:VEVENT\r\n")
    e = files.read_calendar(spark, str(tmp_path / "x.ics"), 2023, 1).collect()
    assert [(r["date"], r["time"], r["duration_minutes"], r["summary"]) for r in e] == [("2023-07-24", "10:00:00", 30, "A) Ada - Long title, more")]
    (tmp_path / "x.html").write_text("<h2>Programme Committee</h2><ul><li>Ada <b>Cole</b> (X)<li><a href='u'>Bob</a></ul><h2>Venue</h2><p>Hall</p><script>no</script>")
    blocks = files.read_pages(spark, str(tmp_path / "x.html"))
    m = files.members_under_headings(blocks, X.committee_of_heading(F.col("text"))).collect()
    assert [(r["committee_type"], r["text"]) for r in m] == [("program", "Ada Cole (X)"), ("program", "Bob")]
    (tmp_path / "p.json").write_text('[{"title": "T", "decision": "Accepted", "authors": [{"first": "Ada", "last": "Cole", "affiliation": null}], "tags": [], "topics": ["a", "b"]}, {"title": "U", "decision": "Rejected"}]')
    j = files.papers_of_json(spark, str(tmp_path / "p.json")).collect()
    assert [(r["title"], r["authors"], r["topics"]) for r in j] == [("T", "Ada Cole", "a;b")]
    urls = spark.createDataFrame([("http://x.org/a/b",), ("https://x.org/a/c.pdf",), ("http://x.org",), ("http://x.org/a/",)], "u string")
    assert [r[0] for r in urls.select(files.local_path(F.col("u"), "/w")).collect()] == ["/w/x.org/a/b/index.html", "/w/x.org/a/c.pdf", "/w/x.org/index.html", "/w/x.org/a/index.html"]


def test_stream_counts(spark, tmp_path) -> None:  # noqa: ANN001
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,cast(id as int)) ts, 'k' kind from range(6)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    q = incremental.counts_by_window(stream, "ts", "kind").writeStream.outputMode("append").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] >= 1


def test_numbers_and_carried_values(spark) -> None:  # noqa: ANN001
    from biblioweave.operators.ranks import carried, numbered

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([None, "x", "y"])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v string")
    counts: dict = {}
    want = {}
    last: dict = {}
    carry = {}
    for g, k, v in rows:
        counts[g] = counts.get(g, 0) + 1
        want[k] = counts[g]
        last[g] = v if v is not None else last.get(g)
        carry[k] = last[g]
    assert {r["k"]: r["n"] for r in numbered(df, ["g"], [F.col("k")], "n").collect()} == want
    assert {r["k"]: r["c"] for r in carried(df, ["g"], [F.col("k")], F.col("v"), "c").collect()} == carry
