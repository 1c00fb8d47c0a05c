"""What only larger tables show, on small ones: numbers past the smallest sizes, ranges drawn anew, work that must not grow with pairs."""

import pytest
from pyspark.sql import functions as F

from skylane.operators import events
from skylane.plans import more_queries  # noqa: F401  registers more
from skylane.plans.queries import ORACLE_SQL, QUERIES
from skylane.sources import navdata

SF = "/root/testdata/sf0.001"


def later_events(spark, tmp_path, times=1, shift=1_000_000, users=0):
    """A folder with the smallest events, again and again with shifted keys."""
    rows = spark.read.parquet(f"{SF}/events.parquet").select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_k"))
    rows = rows.withColumns({"event_id": F.col("event_id") + F.col("_k") * shift, "user_id": F.col("user_id") + (F.col("_k") - 1) * users}).drop("_k")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def as_sql(sf, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{sf}/events.parquet/*.parquet')")
    found = c.execute(ORACLE_SQL[name])
    return [d[0] for d in found.description], found.fetchall()


def equals_sql(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    columns, want = as_sql(sf, name)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in rows.collect()))) == sorted(map(str, want)) and want


def test_clocks_of_numbers_beyond_five_digits(spark, tmp_path):
    equals_sql(spark, later_events(spark, tmp_path, shift=123_457), "d1_d4_times")


def test_numbers_follow_the_order_though_ranges_are_drawn_anew(spark):
    small = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 20).alias("more"))
        got = [r._n for r in events._numbered(rows, ("k",)).orderBy("k").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == list(range(1, 20_001))


def test_a_segment_is_parsed_once(spark):
    xml = [
        ("<hasMember><RouteSegment><routeFormed href='urn:uuid:R1'/><start><a><pointChoice_fixDesignatedPoint href='urn:uuid:U1'/></a></start><end><pointChoice_navaidSystem href='urn:uuid:U2'/></end></RouteSegment></hasMember>",),
        ("<hasMember><routeFormed href='R2'/><start><pointChoice_fixDesignatedPoint/><pointChoice_navaidSystem href='U3'/></start><end><pointChoice_navaidSystem href='U2'/></end></hasMember>",),  # named, so final
        ("<hasMember><routeFormed href='R3'/><start><pointChoice_navaidSystem href='U3'/></start></hasMember>",),
        ("<hasMember><start><pointChoice_navaidSystem href='U3'/></start><end><pointChoice_navaidSystem href='U3'/></end></hasMember>",),
        ("<hasMember><routeFormed href='R4|a, b'/><start><pointChoice_navaidSystem href='&#9;'/></start><end><pointChoice_navaidSystem href='U3'/></end></hasMember>",),
    ]
    found = navdata.route_segments(spark.createDataFrame(xml, "xml string"))
    assert [tuple(r) for r in found.collect()] == [("R1", "U1", "U2"), ("R4|a, b", "\t", "U3")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xpath") + plan.count("XPath") == 1


PAIRWISE = ("c1_closest_approach", "c2_conflict_interval", "c4_f8_separation_filter", "c3_straight_conflicts", "j13_time_align", "c5_meeting_plans", "j5_j6_meeting_legs")


@pytest.mark.parametrize("name", PAIRWISE)
def test_pairs_are_neither_written_nor_joined_again(spark, name, monkeypatch):
    """Tables between the steps have a row for a flight or a waypoint, and after the join that finds pairs there is no other exchange."""
    from skylane.operators import blocking, conflicts, staging
    from skylane.plans import demo, detection, queries

    sf, written = "/root/testdata/sf0.01", []

    def counted(df, name="stage"):
        out = staging.staged(df, name)
        written.append((name, out.count()))
        return out

    for module in (blocking, conflicts, detection, queries):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", counted)
    found = QUERIES[name](spark, sf)
    flights = demo.latest(spark, sf).count()
    assert dict(written)["latest"] == flights and {n for n, _ in written} <= {"latest", "clipped"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange") == 2


def _random_traffic(spark):
    """Flights in neighbouring cells and on both sides of the skew, plans of no, one and several waypoints."""
    import random
    from datetime import datetime, timedelta

    rng, at = random.Random(23), datetime(2024, 1, 1)
    rows, plans = [], []
    for i in range(220):
        lat, lon, level = rng.uniform(49, 50), rng.uniform(14, 15.5), rng.choice((300, 305, 310))
        seconds = rng.choice((0, 9, 10, 11, 40, 120, 299, 300, 301))
        rows.append((f"F{i:03d}", lat, lon, level, rng.choice((280, 350, 420, 480)), rng.uniform(0, 360), rng.choice((0, 0, 50, 900, -1500)), at + timedelta(seconds=seconds), rng.choice((None, "filed", "filed"))))
        for k in range(rng.choice((0, 1, 2, 4, 6)) if rows[-1][-1] else 0):
            plans.append((f"F{i:03d}", k, f"P{k}", lat + rng.uniform(-0.6, 0.6), lon + rng.uniform(-0.9, 0.9), 300, level + (rng.choice((10, -20)) if i % 4 == 0 else 0)))
    state = "flight_id string, lat double, lon double, flight_level int, ground_speed_kt int, track_heading double, vertical_rate_fpm int, ts timestamp, route string"
    return spark.createDataFrame(rows, state), spark.createDataFrame(plans, "flight_id string, idx int, ident string, lat double, lon double, tas int, level int")


def test_detection_writes_no_candidates(spark, monkeypatch):
    """The conflicts of the detection over written candidate pairs, though no table has as many rows as there are candidates."""
    from skylane.operators import blocking, staging
    from skylane.plans import detection

    states, plans = _random_traffic(spark)
    pairs = staging.staged(blocking.candidate_pairs(states, 0.25, mode="sphere").select("flight_id_1", "flight_id_2"))
    want = sorted(map(str, detection.detect(pairs, states, plans).collect()))
    written = []

    def counted(df, name="stage"):
        out = staging.staged(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(detection, "staged", counted)
    got = sorted(map(str, detection.detect_among(states, plans, 0.25, mode="sphere").collect()))
    assert got == want and len(want) > 100
    assert max(n for name, n in written if name in ("near", "predicted")) < pairs.count() / 4
    assert {n for n, _ in written} == {"flights", "late", "planned", "moved", "there", "states", "clipped", "paths", "near", "predicted"}


def test_only_pairs_of_events_are_checked(spark):
    from skylane.operators import blocking

    states, _ = _random_traffic(spark)
    whole = {tuple(r) for r in blocking.candidate_pairs(states, 0.25, mode="sphere").select("flight_id_1", "flight_id_2").collect()}
    some = [(f"F{b:03d}", f"F{a:03d}") for a in range(40) for b in range(a + 1, 60)] + [("F001", "F001"), ("F001", "none"), (None, "F002")]
    found = blocking.candidates_among(spark.createDataFrame(some, "flight_id_1 string, flight_id_2 string"), states, 0.25, mode="sphere")
    assert {tuple(r) for r in found.collect()} == whole & {tuple(sorted(p)) for p in some if all(p)}


@pytest.mark.parametrize("span, knots", [((40, 60, -180, 180), (200, 500)), ((-5, 5, 170, 190), (0, 500)), ((80, 90, -180, 180), (200, 500)), ((45, 46, 5, 6), (1, 9)), ((-60, 60, -180, 180), (9_000, 30_000))])
def test_partner_lists_are_partners_of_the_pairs(spark, span, knots, monkeypatch):
    """By single precision, by distance where that isn't sure, and for reaches beyond a quarter of the circle."""
    import random
    from datetime import datetime, timedelta

    from skylane.operators import blocking

    rng, at = random.Random(31), datetime(2024, 1, 1)
    rows = [(f"F{i}", at + timedelta(seconds=rng.choice((0, 299, 300, 301, rng.randint(0, 1200)))), rng.uniform(*span[:2]), (rng.uniform(*span[2:]) + 180) % 360 - 180, rng.randint(*knots)) for i in range(300)]
    rows += [("twin", at, *rows[0][2:4], knots[1]), ("twin2", at, *rows[0][2:4], knots[1]), ("nowhere", at, None, 5.0, 300), (None, at, *rows[0][2:])]
    df = spark.createDataFrame(rows, "flight_id string, ts timestamp, lat double, lon double, ground_speed_kt int")
    want = blocking.partners(blocking.candidate_pairs(df.dropna(), 0.25, 300, "sphere")).collect()
    monkeypatch.setattr(blocking, "_close", None)
    got = blocking.partner_lists(df, 0.25, 300, "|").collect()
    assert sorted((r.flight_id_1, r.partners.split("|"), r.n_partners) for r in got) == sorted((r.flight_id_1, r.partners, r.n_partners) for r in want) and len(want) > 5


def test_partners_are_found_without_pairs(spark, tmp_path, monkeypatch):
    """a4_partners on repeated flights equals its SQL, without the join that makes pairs."""
    from skylane.operators import blocking

    monkeypatch.setattr(blocking, "meeting_pairs", None)
    equals_sql(spark, later_events(spark, tmp_path, times=20, users=1_000), "a4_partners")


@pytest.mark.parametrize("mode", ["sphere", "spheroid"])
def test_flights_of_shared_states_are_paired(spark, mode):
    """More flights of one state than a row holds, still ones, places on both sides of a cell's edge, rows without a place or number; the same pairs and distances as flight by flight."""
    import random
    from datetime import datetime, timedelta

    from skylane.operators import blocking

    rng, at = random.Random(5), datetime(2024, 1, 1)
    states = [(at + timedelta(seconds=rng.choice((0, 299, 300, 301, 700))), rng.uniform(44, 47), rng.choice((179.9, -179.9)) + rng.uniform(-0.1, 0.1), rng.choice((0, 200, 480))) for _ in range(40)]
    sizes = [2 * blocking.MEMBERS + 5, blocking.MEMBERS, blocking.MEMBERS + 1, *[rng.choice((1, 1, 2, 3, 9)) for _ in states[3:]]]
    states[0], states[1] = (*states[0][:3], 0), (*states[1][:3], 200)
    names = [f"F{i}" for i in range(sum(sizes))]
    rng.shuffle(names)
    rows = [(names.pop(), *state) for state, n in zip(states, sizes, strict=True) for _ in range(n)]
    rows += [("nowhere", at, None, 5.0, 300), (None, *states[1]), ("never", None, *states[1][1:]), ("unknown", *states[1][:3], None)]
    df = spark.createDataFrame(rows, "flight_id string, ts timestamp, lat double, lon double, ground_speed_kt int")
    want = blocking.candidate_pairs(df.dropna(), 0.25, 300, mode).collect()
    got = blocking.flight_pairs(blocking.state_pairs(df, 0.25, 300, mode)).select(*want[0].__fields__).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10_000


@pytest.mark.parametrize("name", ["j2_blocking_pairs", "j2_blocking_pairs_spheroid"])
def test_pairs_of_repeated_states_take_few_bytes(spark, tmp_path, name, monkeypatch):
    """Flights in the same place at the same time with the same speed are measured once for all of them, and their rows are written as runs."""
    from skylane.operators import blocking

    measured, close = [], blocking._close

    def counted(pairs, *how):
        measured.append(pairs.count())
        return close(pairs, *how)

    monkeypatch.setattr(blocking, "_close", counted)
    sf = later_events(spark, tmp_path, times=70, shift=2_100, users=3_000)
    out = str(tmp_path / "pairs.parquet")
    QUERIES[name](spark, sf).write.parquet(out)
    rows = spark.read.parquet(out).count()
    assert sum(measured) < rows / 100
    assert sum(p.stat().st_size for p in (tmp_path / "pairs.parquet").glob("*.parquet")) < 3 * rows
    columns, want = as_sql(sf, name)
    assert sorted(map(str, map(tuple, spark.read.parquet(out).select(*columns).collect()))) == sorted(map(str, want))


def test_flights_share_state_and_slices_are_single_batches(spark, tmp_path):
    """State has rows for buckets, not for flights; a slice of time written by several tasks is one batch, so that none of its rows is late."""
    import random
    from datetime import datetime, timedelta

    from skylane.operators import snapshots
    from skylane.streaming import activity

    rng, at = random.Random(12), datetime(2024, 1, 1)
    rows = [(f"F{rng.randrange(2_500)}", at + timedelta(seconds=rng.randrange(6_000)), rng.random(), 1.0) for _ in range(10_000)] + [("END", at + timedelta(seconds=9_000), 0.0, 0.0)]
    samples, runs = spark.createDataFrame(rows, "flight_id string, sample_time timestamp, lat double, lon double").repartition(4), []

    def read(stream):
        changes = activity.stream_changes(stream, 600, "35 seconds")
        runs.append(changes.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")))
        return runs[-1]

    more_queries._fed(spark, samples, "sample_time", read, 3)
    progress = [p for q in runs for p in q.recentProgress]
    assert [p["numInputRows"] > 0 for p in progress].count(True) == 3 and sum(p["numInputRows"] for p in progress) == len(rows)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 3 * activity.BUCKETS
    found = spark.read.schema(activity.CHANGES).parquet(str(tmp_path / "out")).filter("kind = 'gone'").select("flight_id", "start", "last", "samples")
    want = snapshots.activity_sessions(samples.filter("flight_id <> 'END'"), 600).select("flight_id", "start", "end", "samples")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5_000
