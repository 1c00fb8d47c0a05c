"""The change feed against a fold over all ticks in plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row

from skylane.operators import change_feed, snapshots, trajectories

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SAMPLE = "flight_id string, sample_time timestamp, event_id long, lat double, lon double, flight_level int, n_to string"
EVENT = "id long, flight_id_1 string, flight_id_2 string, detected_at timestamp, active boolean"


def fold(samples, tick_s, width):
    """(n, flight, event) of every tick's snapshot, tick by tick."""
    times = [s.sample_time for s in samples if s.sample_time]
    low, high = min(times), max(times)
    out, n = [], 0
    while True:
        tick = min(low + timedelta(seconds=tick_s * n), high)
        table = {}
        for s in samples:
            if s.flight_id is None or s.sample_time is None or s.lat is None or s.lon is None or not tick - timedelta(seconds=width) < s.sample_time <= tick:
                continue
            key = (s.sample_time, s.event_id)
            if s.flight_id not in table or key > table[s.flight_id]:
                table[s.flight_id] = key
        out.append({f: e for f, (_, e) in table.items()})
        if tick == high:
            return low, out
        n += 1


def expected_changes(tables):
    found = set()
    for n, (before, now) in enumerate(zip([{}, *tables], tables, strict=False)):
        found |= {(n, f, e, "moved" if f in before else "seen") for f, e in now.items() if before.get(f) != e}
        found |= {(n, f, e, "gone") for f, e in before.items() if f not in now}
    return found


def random_samples(seed, flights=6, rows=500, span=1500):
    r = random.Random(seed)
    place = lambda: None if r.random() < 0.05 else r.random()
    # a third of the rows are one flight's
    ids = ["hot" if r.random() < 0.33 else str(r.randrange(flights)) for _ in range(rows)]
    times = [T0 + timedelta(seconds=r.randrange(span), microseconds=r.choice([0, 0, 1, 999_999])) for _ in range(rows)]
    return [Row(flight_id=f, sample_time=t, event_id=i, lat=place(), lon=place(), flight_level=100, n_to="x") for i, (f, t) in enumerate(zip(ids, times, strict=True))]


@pytest.mark.parametrize(("seed", "tick_s", "block"), [(1, 5.0, 4096), (2, 5.0, 7), (3, 11.0, 5), (4, 1.0, 36), (5, 60.0, 1)])
def test_feed_is_the_fold(spark, seed, tick_s, block):
    rows = random_samples(seed)
    samples = spark.createDataFrame(rows, SAMPLE).drop("n_to")
    bounds = trajectories.dataset_bounds(samples)
    low, tables = fold(rows, tick_s, 35)
    versions = change_feed.position_versions(samples, bounds, tick_s, order=("sample_time", "event_id"), block=block).cache()
    feed = change_feed.changes(versions, bounds, tick_s)
    found = [(c.n, c.flight_id, c.event_id, c.change) for c in feed.collect()]
    expected = expected_changes(tables)
    assert len(found) == len(expected) and set(found) == expected
    held = {}
    for v in versions.collect():
        for n in range(v.n_from, v.n_to):
            assert (n, v.flight_id) not in held
            held[n, v.flight_id] = v.event_id
    assert held == {(n, f): e for n, t in enumerate(tables) for f, e in t.items()}
    known = {}
    for n, t in enumerate(tables):
        known |= t
        if n in (0, len(tables) // 2, len(tables) - 1):
            assert {(x.flight_id, x.event_id, x.active) for x in change_feed.flights_at(versions, n, ("event_id",)).collect()} == {(f, e, f in t) for f, e in known.items()}
            assert {(x.flight_id, x.event_id) for x in change_feed.positions_at(versions, n).collect()} == set(t.items())


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_events_are_archived_as_the_fold_archives_them(spark, block):
    rows = random_samples(7, flights=4, rows=120, span=4000)
    samples = spark.createDataFrame(rows, SAMPLE).drop("n_to")
    bounds = trajectories.dataset_bounds(samples)
    low, tables = fold(rows, 5.0, 35)
    r = random.Random(8)
    pick = lambda: r.choice(["hot", "0", "1", "2", "3", "never", None])
    events = [Row(id=i, flight_id_1=pick(), flight_id_2=pick(), detected_at=None if i % 17 == 0 else T0 + timedelta(seconds=r.randrange(-50, 4100)), active=None if i % 19 == 0 else i % 5 > 0) for i in range(150)]
    events += events[:3]
    gone = {n: {f for f in before if f not in now} for n, (before, now) in enumerate(zip(tables, tables[1:], strict=False), 1)}
    expected = []
    for e in events:
        at = [n for n in sorted(gone) if e.active and e.detected_at and low + timedelta(seconds=5 * n) >= e.detected_at and gone[n] & {e.flight_id_1, e.flight_id_2}]
        expected.append((e.id, at[0] if at else None))
    assert any(n is None for _, n in expected) and len({n for _, n in expected}) > 10
    feed = change_feed.changes(change_feed.position_versions(samples, bounds, order=("sample_time", "event_id"), block=max(block, 7)), bounds)
    found = change_feed.archived_at(spark.createDataFrame(events, EVENT), feed, bounds, block=block)
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    assert sorted([(x.id, x.archived_n) for x in found.collect()], key=key) == sorted(expected, key=key)


def test_no_samples_no_changes(spark):
    samples = spark.createDataFrame([], SAMPLE).drop("n_to")
    bounds = trajectories.dataset_bounds(samples)
    versions = change_feed.position_versions(samples, bounds)
    assert versions.count() == 0 and change_feed.changes(versions, bounds).count() == 0
    events = spark.createDataFrame([Row(id=1, flight_id_1="a", flight_id_2="b", detected_at=T0, active=True)], EVENT)
    assert [x.archived_n for x in change_feed.archived_at(events, change_feed.changes(versions, bounds), bounds).collect()] == [None]


def test_snapshot_of_a_tick_is_that_of_snapshot_at(spark):
    rows = random_samples(9)
    samples = spark.createDataFrame(rows, SAMPLE).drop("n_to")
    bounds = trajectories.dataset_bounds(samples)
    from pyspark.sql import functions as F

    low = min(x.sample_time for x in rows)
    versions = change_feed.position_versions(samples, bounds, order=("sample_time", "event_id"))
    one = snapshots.snapshot_at(samples, F.lit(low + timedelta(seconds=500)), order=("sample_time", "event_id"))
    assert {x.event_id for x in change_feed.positions_at(versions, 100).collect()} == {x.event_id for x in one.collect()}


def test_blocks_shorter_than_a_window_are_refused(spark):
    samples = spark.createDataFrame([], SAMPLE).drop("n_to")
    with pytest.raises(ValueError, match="block"):
        change_feed.position_versions(samples, trajectories.dataset_bounds(samples), block=6)
