"""Keyed state with timers, the versioned event table and the loop that fills it."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylane.operators import events, snapshots
from skylane.plans import demo
from skylane.streaming import activity, event_table, replay

T0 = datetime(2026, 3, 21, 16)
SAMPLES = "flight_id string, sample_time timestamp, lat double, lon double"


def run(spark, tmp_path, batches, gap=35, late="35 seconds"):
    """All changes after the batches, one after another, and the number of keys that are still kept."""
    for rows in batches:
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = activity.stream_changes(replay.stream_samples(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), gap, late)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(activity.CHANGES).parquet(str(tmp_path / "out")).collect(), left[-1]


def at(s):
    return T0 + timedelta(seconds=s)


def test_spans_equal_sessions_whatever_the_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"F{rng.randint(0, 5)}", at(rng.randint(0, 900) + rng.choice([0, 0.4])), rng.random(), 1.0) for _ in range(160)]
    rows = sorted(rows, key=lambda r: r[1].timestamp() + rng.random() * 25)  # out of order, within the watermark
    batches = [rows[i : i + 40] for i in range(0, 160, 40)] + [[("END", at(5000), 0.0, 0.0)]]
    changes, left = run(spark, tmp_path, batches)
    gone = {(r.flight_id, r.start, r.last, r.samples) for r in changes if r.kind == "gone"}
    want = snapshots.activity_sessions(spark.createDataFrame(rows, SAMPLES), 35).collect()
    assert gone == {(r.flight_id, r.start, r.end, r.samples) for r in want}
    # The newest position of each flight that the stream gave is that of a snapshot over all samples.
    newest = {}
    for r in changes:
        if r.kind != "gone":
            newest[r.flight_id] = max(newest.get(r.flight_id, (T0, 0)), (r.last, r.samples, r.lat))
    snapshot = snapshots.snapshot_at(spark.createDataFrame(rows, SAMPLES), F.lit(at(901)), 901, 30).collect()
    assert {i: n[0] for i, n in newest.items() if i != "END"} == {r.flight_id: r.sample_time for r in snapshot}
    assert left <= 4  # what one flight keeps: nothing is left of those that are gone


def test_flights_come_move_and_leave(spark, tmp_path):
    batches = [
        [("A", at(0), 1.0, 1.0), ("B", at(0), 2.0, 1.0), (None, at(0), 1.0, 1.0), ("C", at(0), None, 1.0), ("D", None, 1.0, 1.0)],
        [("A", at(20), 1.5, 1.0), ("A", at(20), 1.5, 1.0)],
        [("A", at(100), 3.0, 1.0)],
        [("E", at(400), 3.0, 1.0)],
    ]
    changes, _ = run(spark, tmp_path, batches)
    got = sorted((r.flight_id, r.last, r.kind, r.samples, r.lat) for r in changes)
    assert got == sorted([
        ("A", at(0), "seen", 1, 1.0), ("B", at(0), "seen", 1, 2.0), ("A", at(20), "moved", 3, 1.5), ("A", at(100), "seen", 1, 3.0),
        ("A", at(20), "gone", 3, 1.5), ("B", at(0), "gone", 1, 2.0), ("A", at(100), "gone", 1, 3.0), ("E", at(400), "seen", 1, 3.0),
    ])


def counted(table):
    return sorted((r.n, r.batch) for r in table.read().collect())


def test_a_version_counts_once_it_is_in_the_ledger(spark, tmp_path):
    table = event_table.VersionedTable(spark, f"file://{tmp_path}/t", "n long, batch int")
    add = lambda i: lambda now: now.union(spark.range(1).select(F.lit(i).cast("long"), F.lit(i)))
    assert table.read().collect() == [] and table.ledger() == {}
    assert table.apply(0, add(0)) and not table.apply(0, add(7)) and counted(table) == [(0, 0)]

    enter, table._enter = table._enter, lambda *a: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError, match="killed"):
        table.apply(1, add(1))  # written, never entered
    table._enter = enter
    again = event_table.VersionedTable(spark, f"file://{tmp_path}/t", "n long, batch int")
    assert counted(again) == [(0, 0)]
    with pytest.raises(Exception, match="lost"):
        again.apply(1, lambda now: now.withColumn("n", F.raise_error(F.lit("lost")).cast("long")))  # not even written whole
    assert counted(again) == [(0, 0)]
    assert again.apply(1, add(1)) and again.apply(2, add(2)) and not again.apply(1, add(9)) and counted(again) == [(0, 0), (1, 1), (2, 2)]
    again.clean(keep=1)
    assert counted(again) == [(0, 0), (1, 1), (2, 2)] and sorted(again.ledger()) == [0, 1, 2]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 1


def test_the_loop_writes_each_batch_once(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = demo.traffic(spark, sf).withColumn("route", F.lit(None).cast("string")).drop("user_id")
    moved = rows.withColumns({"ts": F.col("ts") + F.make_dt_interval(mins=F.lit(5)), "lat": F.col("lat") + 0.02}).filter("flight_id <> '3'")
    plans = demo.traffic_plans(spark, sf)
    clean, dirty = (event_table.VersionedTable(spark, f"file://{tmp_path}/{n}", event_table.EVENTS) for n in ("clean", "dirty"))
    step = event_table.detection_step(clean, plans, mode="sphere")
    for number, batch in enumerate((rows, moved, rows.limit(0))):
        step(batch, number)
    step = event_table.detection_step(dirty, plans, mode="sphere")
    step(rows, 0)
    enter, dirty._enter = dirty._enter, lambda *a: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        step(moved, 1)
    dirty._enter = enter
    for number, batch in ((0, rows), (1, moved), (1, moved), (2, rows.limit(0))):  # as a restarted stream would
        step(batch, number)
    got, want = (sorted(map(tuple, t.read().collect())) for t in (dirty, clean))
    assert got == want and want and sorted(dirty.ledger()) == [0, 1, 2]
    # The same as two reconciliations by hand.
    from skylane.operators import blocking
    from skylane.plans.detection import detect

    table = spark.createDataFrame([], event_table.EVENTS)
    for batch in (rows, moved):
        now = batch.agg(F.max("ts")).first()[0]
        pairs = blocking.candidate_pairs(batch, 0.25, mode="sphere")
        table = spark.createDataFrame(events.reconcile(events.events_from(detect(pairs, batch, plans), F.lit(now)), table, pairs, F.lit(now)).collect(), event_table.EVENTS)
    assert sorted(map(tuple, table.collect())) == want
