"""Queries of imports and look-ups: files are written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions import geo
from skylane.operators import blocking, events, navpoints, routes, snapshots
from skylane.sources import navdata, positions, sinks

from . import demo
from .more_queries import _shared
from .queries import P, L, query, r6


def _xml(tag: str, *parts: str | Column) -> Column:
    """A one-line member of a feature."""
    body = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.concat(F.lit(f"<message:hasMember><aixm:{tag}>"), body, F.lit(f"</aixm:{tag}></message:hasMember>"))


def _text(tag: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), value.cast("string"), F.lit(f"</{tag}>"))


def _read(spark, lines: DataFrame) -> DataFrame:
    path = _shared(spark)
    lines.toDF("value").write.text(path)
    return navdata.members(spark, path)


def _features(spark, sf, table: str, key: str, tag: str, name: str, letter: str) -> DataFrame:
    k = F.col(key)
    place = F.concat_ws(" ", F.format_string("%.2f", 44 + (k * 31 % 900) / F.lit(100.0)), F.format_string("%.2f", 4 + (k * 17 % 1700) / F.lit(100.0)))
    line = _xml(tag, _text("gml:identifier", F.concat(F.lit(letter), k.cast("string"))), _text(f"aixm:{name}", F.concat(F.lit("N"), k.cast("string"))), F.when(k % 5 != 0, _text("gml:pos", place)).otherwise(""))
    return _read(spark, demo._table(spark, sf, table).select(line))


_PLACE = "round(44e0 + (k * 31 % 900) / 100e0, 6) + 0 AS lat, round(4e0 + (k * 17 % 1700) / 100e0, 6) + 0 AS lon"


@query(f"""SELECT kind, letter || CAST(k AS VARCHAR) AS uuid, 'N' || CAST(k AS VARCHAR) AS name, {_PLACE} FROM (SELECT 'airport' AS kind, 'A' AS letter, c_custkey AS k FROM customer UNION ALL SELECT 'fix', 'F', p_partkey FROM part UNION ALL SELECT 'navaid', 'V', s_suppkey FROM supplier) WHERE k % 5 <> 0""")
def s4_s5_navigation_features(spark, sf):
    """Airports, fixes and navaids of one-line XML; features without a position are left out."""
    ports = navdata.airports(_features(spark, sf, "customer", "c_custkey", "AirportHeliport", "designator", "A")).select(F.lit("airport").alias("kind"), "uuid", F.col("code").alias("name"), "lat", "lon")
    points = navdata.fixes(_features(spark, sf, "part", "p_partkey", "DesignatedPoint", "designator", "F")).select(F.lit("fix").alias("kind"), "uuid", F.col("identificator").alias("name"), "lat", "lon")
    navs = navdata.navaids(_features(spark, sf, "supplier", "s_suppkey", "Navaid", "designator", "V")).select(F.lit("navaid").alias("kind"), "uuid", F.col("identificator").alias("name"), "lat", "lon")
    return ports.unionByName(points).unionByName(navs).select("kind", "uuid", "name", *r6(lat=F.col("lat"), lon=F.col("lon")))


@query("""SELECT 'R' || CAST(o_custkey % 50 AS VARCHAR) AS route_uuid, 'U' || CAST(o_custkey AS VARCHAR) AS start_uuid, 'U' || CAST(o_orderkey % 90 AS VARCHAR) AS end_uuid, 'L' || CAST(o_custkey % 50 AS VARCHAR) AS airway_id FROM orders WHERE o_orderkey % 7 <> 0""")
def s6_s7_route_segments(spark, sf):
    """Segments and their routes' names; a designated point or else a navaid is the end, and a segment without one is left out."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    end = lambda side, kind, key: F.concat(F.lit(f'<aixm:{side}><aixm:EnRouteSegmentPoint><aixm:{kind} xlink:href="urn:uuid:U'), key.cast("string"), F.lit(f'"/></aixm:EnRouteSegmentPoint></aixm:{side}>'))
    start = F.when(o % 2 == 0, end("start", "pointChoice_fixDesignatedPoint", c)).otherwise(end("start", "pointChoice_navaidSystem", c))
    line = _xml("RouteSegment", F.concat(F.lit('<aixm:routeFormed xlink:href="urn:uuid:R'), (c % 50).cast("string"), F.lit('"/>')), start, F.when(o % 7 != 0, end("end", "pointChoice_fixDesignatedPoint", o % 90)).otherwise(""))
    segments = navdata.route_segments(_read(spark, demo._table(spark, sf, "orders").select(line)))
    r = F.col("id")
    names = _xml("Route", _text("gml:identifier", F.concat(F.lit("R"), r.cast("string"))), "<aixm:designatorSecondLetter>L</aixm:designatorSecondLetter>", _text("aixm:designatorNumber", r))
    named = navdata.airway_names(_read(spark, spark.range(50).select(names)))
    return segments.join(named.select(F.col("uuid").alias("route_uuid"), "airway_id"), "route_uuid").select("route_uuid", "start_uuid", "end_uuid", "airway_id")


@query("""SELECT flight_id, fl AS flight_level, round(CAST(round(lat, 3) AS DOUBLE), 6) + 0 AS lat, CASE WHEN user_id % 4 = 0 THEN 'FILED' ELSE 'ICAO' END AS route_string FROM latest WHERE user_id % 5 <> 0""", P, L)
def s8_flight_list_replies(spark, sf):
    """Flights of XML replies; those on the ground are left out, a level that says it isn't there stays."""
    u = F.col("user_id")
    level = F.concat(F.lit("<flightLevel><unit>F</unit>"), _text("level", F.col("flight_level")), _text("ground", F.when(u % 5 == 0, "true").otherwise("false")), F.lit("</flightLevel>"))
    place = F.concat(F.lit("<position>"), _text("latitude", F.round("lat", 3)), _text("longitude", F.round("lon", 3)), F.lit("</position>"))
    at = lambda tag: F.concat(F.lit(f"<{tag}><timeOver>2024-01-15 00:00:00</timeOver>"), level, place, F.lit(f"</{tag}>"))
    where = F.when(u % 2 == 0, at("lastKnownPosition")).otherwise(at("ctfmPointProfile"))
    route = F.when(u % 4 == 0, "<filedRoute>FILED</filedRoute>").otherwise("<icaoRoute>ICAO</icaoRoute>")
    xml = F.concat(F.lit("<reply><flight>"), _text("aircraftId", F.col("flight_id")), where, route, F.lit("</flight></reply>"))
    rows = demo.latest(spark, sf).select(F.lit("LK").alias("airspace"), F.col("ts").alias("sample_time"), xml.alias("xml"))
    return navdata.flights_of_replies(rows).select("flight_id", "flight_level", *r6(lat=F.col("lat")), "route_string")


@query("SELECT r_name AS scenario, n_name AS flight_id, CAST(n_nationkey AS BIGINT) AS height FROM nation JOIN region ON n_regionkey = r_regionkey")
def s13_scenarios(spark, sf):
    nations = demo._table(spark, sf, "nation").join(demo._table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flight = F.struct(F.trim("n_name").alias("flightID"), F.struct(F.col("n_nationkey").alias("height")).alias("planePosition"))
    each = nations.groupBy("r_name").agg(F.collect_list(flight).alias("flights")).select(F.struct(F.col("r_name").alias("name"), "flights").alias("s"))
    path = _shared(spark)
    each.agg(F.to_json(F.collect_list("s")).alias("value")).write.text(path)  # five scenarios, which are one JSON text
    return navdata.read_scenarios(spark, path).select("scenario", F.col("flightID").alias("flight_id"), F.col("planePosition.height").alias("height"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def k1_replace_trajectories(spark, sf):
    path = _shared(spark)
    for _ in range(2):  # the second one replaces the first
        sinks.replace_trajectories(demo.positions(spark, sf).withColumnRenamed("ts", "sample_time"), path)
    return spark.read.parquet(path).select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("SELECT CAST(c_custkey AS BIGINT) AS code FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_custkey % 3 <> 0)")
def j12_k9_new_airports(spark, sf):
    codes = demo._table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("code"))
    there = demo._table(spark, sf, "orders").filter(F.col("o_custkey") % 3 != 0).select(F.col("o_custkey").cast("long").alias("code"))
    return navpoints.new_airports(codes, there)


@query("SELECT event_id AS id FROM events WHERE event_id % 11 <> 0 AND user_id <> (user_id * 7 + 1) % 20")
def f9_valid_pairs(spark, sf):
    rows = demo.conflict_events(spark, sf).withColumn("flight_id_1", F.when(F.col("id") % 11 != 0, F.col("flight_id_1")))
    return blocking.valid_pairs(rows).select("id")


@query("SELECT l.flight_id, l.event_id FROM latest l WHERE user_id = (SELECT min(user_id) FROM events)", P, L)
def j4_latest_of_flight(spark, sf):
    rows = blocking.can_conflict(demo.positions(spark, sf))
    first = rows.agg(F.min("user_id")).first()[0]
    return snapshots.latest_of_flight(rows, demo.flights(spark, sf), str(first), ("ts", "event_id")).select("flight_id", "event_id")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS flight_id FROM events")
def a3_t5_flight_ids(spark, sf):
    return snapshots.flight_ids(demo.positions(spark, sf))


@query("SELECT o_orderkey AS id, 'L' || CAST(o_custkey % 40 AS VARCHAR) AS airway_id FROM orders WHERE o_custkey % 40 IN (SELECT n_nationkey FROM nation)")
def j10_segments_of_airways(spark, sf):
    name = lambda c: F.concat(F.lit("L"), c.cast("string")).alias("airway_id")
    edges = demo._table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), name(F.col("o_custkey") % 40))
    return routes.segments_of_airways(demo._table(spark, sf, "nation").select(name(F.col("n_nationkey"))), edges).select("id", "airway_id")


@query("""SELECT CAST(user_id AS VARCHAR) AS flight_id, event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 360 AS DOUBLE) END AS wind_heading, CASE WHEN event_id % 3 <> 0 THEN 'A,B' END AS plan, CAST(CASE WHEN event_id % 4 <> 0 THEN event_id % 900 ELSE 0 END AS INT) AS vertical_rate_fpm FROM events""")
def k6_f13_live_positions(spark, sf):
    e = F.col("event_id")
    wind = F.when(e % 2 == 0, F.struct((e % 360).cast("double").alias("heading"), F.lit(5.0).alias("speed"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(100).alias("altitude")))
    name = lambda x: F.struct(F.lit(x).cast("string").alias("name"))
    rows = demo.positions(spark, sf).select("flight_id", e.alias("flight_level"), "lat", "lon", F.lit(1).alias("speed"), F.lit(1).alias("heading"), F.lit(1).alias("track_heading"), F.when(e % 4 != 0, e % 900).alias("vertical_speed"), F.lit(1).alias("target_flight_level"), F.lit("A DCT B").alias("route_string"), wind.alias("wind"), F.when(e % 3 != 0, F.array(name("A"), name(""), name("B"), name(None))).alias("flight_plan"))
    found = snapshots.live_positions(rows, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return found.select("flight_id", F.col("flight_level").alias("id"), "wind_heading", F.array_join("flight_plan_json", ",").alias("plan"), "vertical_rate_fpm")


@query("SELECT id, round((id % 40) / 20e0 * 6076.12e0, 6) + 0 AS feet, printf('%.2f', CAST(id % 900 AS DOUBLE) / 4) AS shown FROM (SELECT event_id AS id FROM events WHERE event_id % 3 <> 0)")
def f11_f15_conflict_items(spark, sf):
    rows = demo.conflict_events(spark, sf).withColumns({"vertical_distance": (F.col("id") % 40) / F.lit(20.0), "horizontal_distance": (F.col("id") % 900).cast("double") / 4})
    return events.conflict_items(rows).select("id", *r6(feet=F.col("vertical_distance_ft")), geo.fixed_text(F.col("horizontal_distance")).alias("shown"))


#: Routes in turn, and the names of their waypoints once expanded.
_ROUTES = (
    ("N0450F310 AAA L1 CCC DCT DDD/N0400F200", "AAA,BBB,CCC,DDD"), ("dct DCT VLM", "VLM"), ("N0447F380 DCT dct AMULU", "AMULU"), ("DENUT DCT LAM", "DENUT,LAM"),
    ("PEREN L9 EVIVI", "EVIVI"), ("???", None), ("BBB L1 AAA", "BBB,AAA"),
)
_CASES = " ".join(f"WHEN {i} THEN {repr(names) if names else 'NULL'}" for i, (_, names) in enumerate(_ROUTES))


@query(f"SELECT 'F' || CAST(event_id AS VARCHAR) AS flight_id, CASE event_id % {len(_ROUTES)} {_CASES} END AS names FROM events")
def c9_waypoint_names(spark, sf):
    e = F.col("event_id")
    edges = spark.createDataFrame([(1, "L1", "AAA", "BBB"), (2, "L1", "BBB", "CCC")], "id int, airway_id string, start_waypoint string, end_waypoint string").withColumns({"start_lat": F.lit(50.0), "start_lon": F.lit(14.0)})
    route = F.element_at(F.array(*[F.lit(r) for r, _ in _ROUTES]), (e % len(_ROUTES) + 1).cast("int"))
    rows = demo._table(spark, sf, "events").select(F.concat(F.lit("F"), e.cast("string")).alias("flight_id"), route.alias("route"), F.lit(50.0).alias("lat"), F.lit(14.0).alias("lon"), F.lit(300).alias("ground_speed_kt"), F.lit(100).alias("flight_level"))
    return routes.waypoint_names(routes.parse_routes(rows), edges).select("flight_id", F.array_join("names", ",").alias("names"))


@query("""SELECT CAST(count(*) FILTER (has AND event_id % 11 <> 0) AS BIGINT) AS imported, CAST(count(*) FILTER (NOT has) AS BIGINT) AS skipped, CAST(count(*) FILTER (has AND event_id % 11 = 0) AS BIGINT) AS failed,
  CAST(count(*) FILTER (has AND event_id % 11 <> 0 AND event_id % 13 = 0) AS BIGINT) AS unread FROM (SELECT event_id, event_id % 7 <> 0 AS has FROM events)""")  # fmt: skip
def a7_import_counts(spark, sf):
    """Counters of an import of all samples: some without a flight, some with a time or a level that can't be read."""
    e, path = F.col("event_id"), _shared(spark)
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = demo.positions(spark, sf).select(
        time.alias("sample_time"), F.when(e % 11 == 0, "noon").otherwise(time).alias("time_over"), F.when(e % 7 != 0, F.col("flight_id")).alias("flight_id"), F.lit("").alias("aircraft_type"), F.lit("").alias("origin"),
        F.lit("").alias("destination"), "lat", "lon", F.when(e % 13 == 0, "high").otherwise(F.col("flight_level").cast("string")).alias("flight_level"), F.lit("A DCT B").alias("route_string"),
    )
    rows.write.csv(path, header=True, emptyValue="", nullValue="")
    counts = positions.import_to(spark, _shared(spark), path)
    return spark.createDataFrame([(counts.imported, counts.skipped, counts.failed, counts.unread)], "imported long, skipped long, failed long, unread long")
