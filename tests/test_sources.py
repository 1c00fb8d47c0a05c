"""Readers, catalog, recorder and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylane.operators import snapshots
from skylane.sources import navdata, positions, sinks
from skylane.streaming import replay

HEADER = ",".join(positions.HEADER)
T0 = datetime(2026, 3, 21, 16)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEADER}\n2026-03-21T16:04:03Z,2026-03-21T16:02:14Z,PO1,S22T,LKLT,LKTB,49.305,16.093,68,N0181F090 BEKVI\n2026-03-21T16:04:03Z,,X,,,,1,2,3,\n")
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "b.csv").write_text(f"{HEADER}\n2026-03-21T16:04:03,2026-03-21T16:02:14Z,NULLGEO,,,,,,,\n")
    (tmp_path / "bad.csv").write_text("wrong,header\n1,2\n")
    return tmp_path


def test_csv(spark, folder):
    rows, skipped = positions.import_positions(spark, str(folder / "a.csv"), str(folder / "set"))
    got = {r.flight_id: r for r in rows.collect()}
    assert skipped == 1 and got["PO1"].flight_level == 68 and got["PO1"].route_string == "N0181F090 BEKVI" and got["NULLGEO"].lat is None
    assert got["NULLGEO"].sample_time == got["PO1"].sample_time
    with pytest.raises(ValueError, match="header"):
        positions.read_positions(spark, str(folder / "bad.csv"))


def test_counts_of_an_import(spark, tmp_path):
    """Every kind of bad row, over two files; the counters equal those of the rows themselves."""
    time = "2026-03-21T16:04:03Z"
    lines = [f"{a},{b},{f},,,,{lat},{lon},{fl}," for a in (time, "", "soon") for b in (time, " ", "31.12.") for f in ("X", "") for lat in ("1.5", "", "north") for lon in ("2", "-") for fl in ("68", "F90")]
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text("\n".join([HEADER, *lines[i::2]]) + "\n")
    got = positions.import_to(spark, str(tmp_path / "out"), str(tmp_path))
    fields = [x.split(",") for x in lines]
    full = [x for x in fields if x[2] and x[0] and x[1].strip()]
    good = [x for x in full if x[0] == x[1] == time]
    bad = [x for x in good if x[6] == "north" or x[7] == "-" or x[8] == "F90"]
    assert (got.imported, got.skipped, got.failed, got.unread) == (len(good), len(fields) - len(full), len(full) - len(good), len(bad))
    rows, left_out = positions.import_positions(spark, str(tmp_path))
    assert left_out == got.skipped + got.failed
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(rows).count() == 0 and rows.count() == got.imported


def test_catalog(folder):
    assert [x[0] for x in positions.import_options(str(folder))] == ["a.csv", "bad.csv", "set"]
    assert positions.resolve(str(folder), "a").endswith("a.csv") and positions.resolve(str(folder), "set").endswith("set")
    with pytest.raises(ValueError, match="no data set"):
        positions.resolve(str(folder), "zzz")


def test_members(spark, tmp_path):
    point = '<x:hasMember><a:DesignatedPoint><g:identifier codeSpace="u">U1</g:identifier><a:designator>LAM</a:designator><a:location><g:pos>51.6 0.15</g:pos></a:location></a:DesignatedPoint></x:hasMember>'
    nav = "<x:hasMember><a:Navaid><g:identifier>U2</g:identifier><a:designator>OKL</a:designator><g:pos>50.1 x</g:pos></a:Navaid></x:hasMember>"
    route = "<x:hasMember><a:Route><g:identifier>R1</g:identifier><a:designatorPrefix>U</a:designatorPrefix><a:designatorSecondLetter>L</a:designatorSecondLetter><a:designatorNumber>610</a:designatorNumber></a:Route></x:hasMember>"
    segment = '<x:hasMember><a:RouteSegment><a:routeFormed l:href="urn:uuid:R1"/><a:start><a:pointChoice_fixDesignatedPoint l:href="urn:uuid:U1"/></a:start><a:end><a:pointChoice_navaidSystem l:href="urn:uuid:U2"/></a:end></a:RouteSegment></x:hasMember>'
    (tmp_path / "m.xml").write_text("\n".join(["<root>", point, nav, route, segment, "broken"]))
    rows = navdata.members(spark, str(tmp_path / "m.xml"))
    assert [(r.uuid, r.identificator, r.lat, r.lon) for r in navdata.fixes(rows).collect()] == [("U1", "LAM", 51.6, 0.15)]
    assert navdata.navaids(rows).count() == 0
    assert [(r.uuid, r.airway_id) for r in navdata.airway_names(rows).collect()] == [("R1", "UL610")]
    assert [tuple(r) for r in navdata.route_segments(rows).collect()] == [("R1", "U1", "U2")]


def test_replies(spark):
    def flight(i, level, extra=""):
        return f"<f:flight><aircraftId>{i}</aircraftId><lastKnownPosition><timeOver>2026-03-21 16:02</timeOver><position><latitude>50.5</latitude><longitude>14</longitude></position><flightLevel><unit>F</unit><level>{level}</level>{extra}</flightLevel></lastKnownPosition><icaoRoute>LAM</icaoRoute></f:flight>"

    xml = "<reply>" + flight("A", 35000) + flight("B", 1, "<ground>true</ground>") + "<flight><aircraftId>C</aircraftId></flight></reply>"
    rows = spark.createDataFrame([("LK", T0, xml), ("ED", T0, "<reply>" + flight("A", 90) + "</reply>")], "airspace string, sample_time timestamp, xml string")
    got = navdata.first_of_each_flight(navdata.flights_of_replies(rows), ["LK", "ED"]).collect()
    assert [(r.flight_id, r.flight_level, r.time_over, r.route_string, r.airspace) for r in got] == [("A", 350, "2026-03-21T16:02:00Z", "LAM", "LK")]


def test_recorder(spark, tmp_path):
    rows = spark.createDataFrame([("A", T0, T0, None, None, None, 1.0, 2.0, 90, None)], "flight_id string, sample_time timestamp, time_over timestamp, aircraft_type string, origin string, destination string, lat double, lon double, flight_level int, route_string string")
    sinks.record_csv(rows, str(tmp_path / "out"), hourly=True)
    back = positions.read_positions(spark, str(tmp_path / "out" / "hour=2026-03-21_16"))
    assert back.first().flight_level == 90 and back.first().aircraft_type is None


def trips(spark):
    rows = [("A", T0 + timedelta(seconds=s), 50.0 + s / 1000, 14.0) for s in (0, 5, 10, 200)] + [("B", T0 + timedelta(seconds=s), 49.0, 15.0) for s in (3, 60)]
    return spark.createDataFrame(rows, "flight_id string, sample_time timestamp, lat double, lon double")


def test_replay_equals_snapshots(spark):
    rows = trips(spark)
    bounds = rows.agg(F.min("sample_time").alias("min_time"), F.max("sample_time").alias("max_time"))
    at = replay.ticks(bounds, 5, 2).collect()
    assert [round(t.progress) for t in at][:2] == [0, 5] and at[-1].progress == 100 and at[-1].tick == T0 + timedelta(seconds=200)
    found = replay.snapshots(rows, replay.ticks(bounds, 5, 2)).collect()
    for t in at:
        want = {(r.flight_id, r.lat) for r in snapshots.snapshot_at(rows, F.lit(t.tick)).collect()}
        assert {(r.flight_id, r.lat) for r in found if r.n == t.n} == want


def test_streams(spark, tmp_path):
    for i, s in enumerate((60, 1000, 3000)):
        trips(spark).filter(F.col("sample_time") <= F.lit(T0 + timedelta(seconds=s))).withColumn("sample_time", F.col("sample_time") + F.make_dt_interval(secs=F.lit(float(i * 1000)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for name, make, mode in (("latest", replay.stream_latest, "update"), ("spans", replay.stream_activity, "append")):
        q = make(replay.stream_samples(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.flight_id for r in spark.table("latest").collect()} == {"A", "B"}
    assert all(r.samples >= 1 for r in spark.table("spans").collect()) and spark.table("spans").count() > 0


@pytest.mark.parametrize("where", [
    "<point><position><latitude>50.1</latitude><longitude>14.2</longitude></position></point><latitude>9</latitude><longitude>9</longitude>",
    "<position><latitude>50.1</latitude><longitude>14.2</longitude></position><latitude>9</latitude><longitude>9</longitude>",
    "<other><latitude>9</latitude></other><latitude>50.1</latitude><longitude>14.2</longitude>",
    "<coordinates><latitude>50.1</latitude><longitude>14.2</longitude></coordinates>",
    "<pos>50.1 14.2</pos>",
    "<a><g:pos>50.1, 14.2 7</g:pos></a>",
    "<coordinates> 50.1,14.2 </coordinates>",
    "<latitude>x</latitude><longitude>14</longitude><pos>50.1 14.2</pos>",
    "<pos>50.1</pos><coordinates>50.1 14.2</coordinates>",
])
@pytest.mark.parametrize("source", ["lastKnownPosition", "ctfmPointProfile"])
def test_positions_of_replies(spark, where, source):
    xml = f"<reply><flight><aircraftId>A</aircraftId><{source}>{where}<flightLevel><unit>F</unit><level>90</level></flightLevel></{source}></flight></reply>"
    (row,) = navdata.flights_of_replies(spark.createDataFrame([("LK", T0, xml)], "airspace string, sample_time timestamp, xml string")).collect()
    assert (row.lat, row.lon, row.flight_level) == (50.1, 14.2, 90)


def test_replies_without_a_position_are_dropped(spark):
    flights = "".join(f"<flight><aircraftId>A</aircraftId><lastKnownPosition>{w}</lastKnownPosition></flight>" for w in ("<pos>a b</pos>", "<latitude>1</latitude>", "<coordinates>5</coordinates>", "<x/>"))
    assert navdata.flights_of_replies(spark.createDataFrame([("LK", T0, f"<r>{flights}</r>")], "airspace string, sample_time timestamp, xml string")).count() == 0
