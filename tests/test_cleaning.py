"""Packed cells, written times and drifting files on small tables, hard cases included."""

from __future__ import annotations

import datetime as dt

from biblioweave.operators import drift, instants, packed

WORKSHOP = "record_id long, authors string, affiliations string, arxiv_ids string, speakers string, `Field_Name` string"


def unpacked(spark, authors=None, affiliations=None, arxiv=None, speakers=None):  # noqa: ANN001, ANN202
    df = spark.createDataFrame([(1, authors, affiliations, arxiv, speakers, "clash")], WORKSHOP)
    return [(r["field_name"], r["pos"], r["item"]) for r in packed.unpack(df, "record_id").orderBy("field_name", "pos").collect()]


def test_packed_cells(spark) -> None:  # noqa: ANN001
    a = lambda text: [(p, i) for _, p, i in unpacked(spark, authors=text)]
    assert a("Ada Cole; Bob Dunn") == [(1, "Ada Cole"), (2, "Bob Dunn")]
    assert a("Ada Cole, Bob Dunn and Eve Fox") == [(1, "Ada Cole"), (2, "Bob Dunn"), (3, "Eve Fox")]
    assert a("Ada Cole, Bob Dunn, and Eve Fox;") == [(1, "Ada Cole"), (2, "Bob Dunn"), (3, "Eve Fox")]
    assert a("Cole, Ada") == [(1, "Cole, Ada")]
    assert a("COLE, A.") == [(1, "COLE, A.")]
    assert a('"Cole, Ada", "Dunn ""Bo"" X"') == [(1, "Cole, Ada"), (2, 'Dunn "Bo" X')]
    assert a("Ada Cole;\nBob Dunn") == [(1, "Ada Cole"), (2, "Bob Dunn")]
    assert a("Ada Cole | Bob Dunn") == a("Ada Cole / Bob Dunn") == a("Ada Cole\tBob Dunn") == [(1, "Ada Cole"), (2, "Bob Dunn")]
    assert a('an odd " quote') == [(1, 'an odd " quote')]
    assert a("") == a(None) == a(" ; ; ") == []
    f = lambda text: [(p, i) for _, p, i in unpacked(spark, affiliations=text)]
    assert f("School of X, University of Y") == [(1, "School of X, University of Y")]
    assert f("A;;C") == [(1, "A"), (3, "C")]
    assert f('"A, B",,"C"') == [(1, "A, B"), (3, "C")]
    assert f("LQM/Foo; Labs R&D") == [(1, "LQM/Foo"), (2, "Labs R&D")]
    assert unpacked(spark, arxiv="1 2;3") == [("arxiv_ids", 1, "1 2"), ("arxiv_ids", 2, "3")]
    assert unpacked(spark, arxiv="1404.1 1405.2") == [("arxiv_ids", 1, "1404.1"), ("arxiv_ids", 2, "1405.2")]
    long = ";".join(f"Name{k} Last{k}" for k in range(20_000))
    assert len(a(long)) == 20_000
    assert packed.unpack(spark.createDataFrame([], WORKSHOP), "record_id").count() == 0


CONFERENCES = "venue string, year int, start_date date, end_date date, timezone string"
ROWS = "id long, venue string, year int, scheduled_date string, scheduled_time string, `Status` string"


def utc(spark, day, time, zone="Europe/Paris", start=dt.date(2013, 3, 28), end=dt.date(2013, 4, 2)):  # noqa: ANN001, ANN202
    conf = spark.createDataFrame([("QIP", 2013, start, end, zone)], CONFERENCES)
    rows = spark.createDataFrame([(1, "QIP", 2013, day, time, "x")], ROWS)
    r = instants.instants(rows, conf, "id").first()
    return (r["utc_start"] or "")[:16], r["status"]


def test_written_times(spark) -> None:  # noqa: ANN001
    for day, time, wanted in (
        ("2013-03-30", "14:00", "2013-03-30 13:00"), ("2013-04-01", "14:00", "2013-04-01 12:00"), ("30/3/2013", "2:00 PM", "2013-03-30 13:00"), ("03/30/2013", "14.00", "2013-03-30 13:00"), ("04/01/2013", "8h20", "2013-04-01 06:20"),
        ("30.03.13", "1400", "2013-03-30 13:00"), ("Sat 30 Mar 2013", "14:00-14:30", "2013-03-30 13:00"), ("30 March", "14:00-05:00", "2013-03-30 19:00"), ("March 30, 2013", "14:00 (EDT)", "2013-03-30 18:00"), ("41363", "2.00 p.m.", "2013-03-30 13:00"),
        ("20130330", "14:00 UTC+9", "2013-03-30 05:00"), ("2013-03-30T14:00:00Z", "", "2013-03-30 14:00"), ("1364652000", None, "2013-03-30 14:00"), (None, "1364652000000", "2013-03-30 14:00"), (None, "2013-03-30 14:00:00.000", "2013-03-30 13:00"),
        ("2013-03-30 00:00:00", "14:00 Uhr", "2013-03-30 13:00"), ("2013-03-30", "2:00 PM – 2:30 PM", "2013-03-30 13:00"), ("2013-03-30", "14:00 Asia/Tokyo", "2013-03-30 05:00"),
    ):
        assert utc(spark, day, time) == (wanted, "clear"), (day, time)
    assert utc(spark, "2013-03-30", "morning")[1] == "no time"
    assert utc(spark, "2013-03-30 00:00:00", "")[1] == "no time"
    assert utc(spark, "TBA", "14:00")[1] == utc(spark, None, None)[1] == "no day"
    assert utc(spark, "2013-02-30", "14:00")[1] == "no day"
    assert utc(spark, "2013-03-30", "14:00", None)[1] == "no zone"
    assert utc(spark, "1913-03-30", "14:00") == ("", "beyond")
    assert utc(spark, "2013-03-31", "02:30") == ("", "nonexistent")
    assert utc(spark, "2013-10-27", "02:30", start=dt.date(2013, 10, 27), end=dt.date(2013, 10, 28)) == ("2013-10-27 00:30", "ambiguous")


def test_times_without_rows_or_conferences(spark) -> None:  # noqa: ANN001
    conf, rows = spark.createDataFrame([], CONFERENCES), spark.createDataFrame([], ROWS)
    assert instants.instants(rows, conf, "id").count() == 0
    some = spark.createDataFrame([(1, None, None, "2013-03-30", "14:00Z", None)] * 2, ROWS)
    assert [r["utc_start"] for r in instants.instants(some, conf, "id").collect()] == ["2013-03-30 14:00:00"] * 2


FILES, RAW, STD = "file_id long, kind string, header_line string", "raw_id long, file_id long, record_line string", "kind string, pos int, field_name string, data_type string"


def test_drift(spark) -> None:  # noqa: ANN001
    std = spark.createDataFrame([("talks", 1, "year", "integer"), ("talks", 2, "title", "text"), ("talks", 3, "speakers", "text"), ("talks", 4, "scheduled_date", "date"), ("talks", 5, "scheduled_time", "time")], STD)
    files = spark.createDataFrame([(1, "talks", " YEAR ,title,speakers,scheduled_time,scheduled_date"), (2, "talks", 'year,"paper title",presenter,scheduled_date,,,room'), (3, "talks", None), (4, "talks", "year,title,speakers,scheduled_date,scheduled_time")], FILES)
    raw = spark.createDataFrame([(1, 1, '2013,"a, ""b""\nc",Ada,9:00,2013-03-01'), (2, 2, "'13,t,Ada,Friday,,x,"), (3, 2, "2013,t,Ada,2013-03-02,,,A1"), (4, 1, None), (5, 4, "")], RAW)
    got = {tuple(r) for r in drift.changes(files, raw, std).collect()}
    assert {x for x in got if x[0] == 1} == set()
    assert {x[1:] for x in got if x[0] == 2} == {("renamed", "title"), ("renamed", "speakers"), ("removed", "scheduled_time"), ("added", "c1"), ("added", "room"), ("retyped", "year"), ("retyped", "scheduled_date")}
    assert {x[1:] for x in got if x[0] == 3} == {("removed", f) for f in ("year", "title", "speakers", "scheduled_date", "scheduled_time")}
    assert {x for x in got if x[0] == 4} == set()
    rows = {r["raw_id"]: r for r in drift.consistent(files, raw, std, "talks").collect()}
    assert (rows[1]["year"], rows[1]["title"], str(rows[1]["scheduled_date"]), rows[1]["scheduled_time"]) == (2013, 'a, "b"\nc', "2013-03-01", "09:00:00")
    assert (rows[2]["year"], rows[2]["year_text"], rows[2]["scheduled_date"], rows[2]["scheduled_date_text"], rows[2]["extra"]) == (2013, "'13", None, "Friday", {"c1": "x"})
    union = {(r["field_name"], r["alternative"]) for r in drift.fused_schema(files, raw, std).collect()}
    assert ("year", "text") in union and ("year", "integer") in union
    assert drift.changes(files.limit(0), raw.limit(0), std).count() == 0


def test_drift_without_known_names(spark, monkeypatch) -> None:  # noqa: ANN001
    """Renamed fields are told by their values and place, added ones aren't taken for missing fields; headers may come twice."""
    monkeypatch.setattr(drift, "ALIASES", {"title": ()})
    std = spark.createDataFrame([("talks", k, f, t) for k, (f, t) in enumerate((("year", "integer"), ("title", "text"), ("speakers", "text"), ("scheduled_time", "time"), ("arxiv_ids", "text")))], STD)
    heads = {1: "year,title,speakers,scheduled_time,arxiv_ids", 2: "year,title,given by whom,scheduled_time,arxiv_ids", 3: "year,title,speakers,when,arxiv_ids", 4: "year,title,speakers,scheduled_time,room,room", 5: "jahr,title,speakers,scheduled_time,arxiv_ids"}
    files = spark.createDataFrame([(k, "talks", h) for k, h in heads.items()], FILES)
    names = ("Ada Cole", "Bob Dunn", "Eve Fox", "Kim Lund")
    line = lambda k, n: [str(2000 + k), f"On quantum codes number {n}", names[n % 4], f"{9 + n % 8}:30", f"140{n}.12345"]
    raw = []
    for k in heads:
        for n in range(8):
            cells = line(k, n)
            raw.append((len(raw), k, ",".join(cells[:4] + ["B12", "Aula"] if k == 4 else cells)))
    rows = spark.createDataFrame(raw, RAW)
    got = {tuple(r) for r in drift.changes(files, rows, std).collect()}
    assert got == {(2, "renamed", "speakers"), (3, "renamed", "scheduled_time"), (4, "added", "room"), (4, "removed", "arxiv_ids"), (5, "renamed", "year")}
    table = drift.consistent(files, rows, std, "talks")
    assert table.where("file_id = 4").first()["extra"] == {"room": "B12", "room#2": "Aula"}
    assert table.where("speakers is null").count() == 0 and table.count() == len(raw)


def test_drift_never_broadcasts_what_follows_the_files(spark, monkeypatch, tmp_path) -> None:  # noqa: ANN001
    """Parquet of headers is far smaller than their columns, so that Spark would take tables by file for small: driver memory."""
    plans, cut = [], drift.cut
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(drift, "cut", lambda df: cut(planned(df)))
    std = [("talks", 1, "year", "integer"), ("talks", 2, "title", "text"), ("talks", 3, "scheduled_time", "time")]
    files = [(k, "talks", "year,paper title,room,when" if k % 2 else "year,title,scheduled_time") for k in range(40)]
    raw = [(k, k, "2013,On codes,B12,9:30" if k % 2 else "2013,On codes,9:30") for k in range(40)]
    for name, rows, schema in (("files", files, FILES), ("raw", raw, RAW), ("std", std, STD)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    delivered = [spark.read.parquet(str(tmp_path / name)) for name in ("files", "raw", "std")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        got = {tuple(r) for r in planned(drift.changes(*delivered)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(k, *c) for k in range(1, 40, 2) for c in (("renamed", "title"), ("renamed", "scheduled_time"), ("added", "room"))}
    assert any("SortMergeJoin [file_id" in p for p in plans)
    assert not any("BroadcastHashJoin [file_" in p or "BroadcastNestedLoopJoin" in p for p in plans)
