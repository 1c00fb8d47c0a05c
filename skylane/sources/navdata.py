"""Navigation data in one-line XML members, flight lists in XML replies, simulator records and scenarios."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylane.functions.geo import FOOT_M, KM_PER_LEVEL, mps_to_fpm, wind
from skylane.functions.parsing import b2b_time, feature_type, level_from, to_bool


def text_of(xml: Column, *path: str) -> Column:
    """Trimmed text of the first element at path, whatever its namespace prefix; null if blank or absent."""
    steps = "".join(f"//*[local-name()='{p}']" if not i else f"/*[local-name()='{p}']" for i, p in enumerate(path))
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"string(({steps})[1])"))), F.lit(""))


def text_below(xml: Column, *names: str) -> Column:
    """Trimmed text of the first element of the last name at any depth below one of the name before, and so on; null if blank or absent."""
    steps = "".join(f"//*[local-name()='{n}']" for n in names)
    return F.nullif(F.trim(F.xpath_string(xml, F.lit(f"string(({steps})[1])"))), F.lit(""))


def members(spark: SparkSession, path: str) -> DataFrame:
    """(line, xml) of a file with one member a line after a first line; prefixes are dropped so that each line parses alone."""
    rows = spark.read.text(path).withColumn("line", F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).filter("trim(value) <> ''")
    bare = F.regexp_replace(F.regexp_replace("value", r"(</?)[A-Za-z0-9_.-]+:", "$1"), r"\s(?:xmlns(?::\w+)?)=\"[^\"]*\"", "")
    bare = F.regexp_replace(bare, r"\s[A-Za-z0-9_.-]+:([A-Za-z0-9_.-]+=)", " $1")
    return rows.select("line", F.trim(bare).alias("xml")).filter(F.col("xml").rlike(r"^<hasMember\b.*</hasMember>$"))


def _place(rows: DataFrame) -> DataFrame:
    """lat, lon from pos ("lat lon"); rows without two numbers are dropped."""
    parts = F.split(F.col("pos"), r"\s+")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return rows.withColumns({"lat": at(1), "lon": at(2)}).filter((F.size(parts) == 2) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).drop("pos")


def airports(rows: DataFrame) -> DataFrame:
    x = F.col("xml")
    found = rows.select(text_of(x, "AirportHeliport", "identifier").alias("uuid"), F.coalesce(text_of(x, "designator"), text_of(x, "locationIndicatorICAO")).alias("code"), text_of(x, "name").alias("name"), text_of(x, "pos").alias("pos"))
    return _place(found.filter("uuid is not null and code is not null"))


def fixes(rows: DataFrame) -> DataFrame:
    """The name identifies a fix, else its designator."""
    x = F.col("xml")
    found = rows.select(text_of(x, "DesignatedPoint", "identifier").alias("uuid"), F.coalesce(text_of(x, "name"), text_of(x, "designator")).alias("identificator"), text_of(x, "pos").alias("pos"))
    return _place(found.filter("uuid is not null and identificator is not null"))


def navaids(rows: DataFrame) -> DataFrame:
    x = F.col("xml")
    found = rows.select(text_of(x, "Navaid", "identifier").alias("uuid"), text_of(x, "designator").alias("identificator"), text_of(x, "pos").alias("pos"))
    return _place(found.filter("uuid is not null and identificator is not null"))


def airway_names(rows: DataFrame) -> DataFrame:
    """uuid, airway_id (prefix, letter and number, else the name) and line."""
    x = F.col("xml")
    built = F.nullif(F.concat_ws("", text_of(x, "designatorPrefix"), text_of(x, "designatorSecondLetter"), text_of(x, "designatorNumber")), F.lit(""))
    return rows.select("line", text_of(x, "Route", "identifier").alias("uuid"), F.coalesce(built, text_of(x, "name")).alias("airway_id")).filter("uuid is not null and airway_id is not null")


#: Between the parts of a text: no XML document can have it, not even as a reference.
_BETWEEN = "\x01"


def texts_at(xml: Column, *paths: str) -> Column:
    """The string values of XPath expressions, in an array; the document is parsed once for all of them."""
    between = f", '{_BETWEEN}', "
    return F.split(F.xpath_string(xml, F.lit(f"concat({between.join(paths)}, '')")), _BETWEEN)


def route_segments(rows: DataFrame) -> DataFrame:
    """route_uuid, start_uuid, end_uuid; a designated point goes before a navaid, and is final where it is named."""
    fix, navaid = "pointChoice_fixDesignatedPoint", "pointChoice_navaidSystem"
    href = lambda *path: f"string(({''.join(f'//{p}' for p in path)})[1]/@href)"
    end = lambda side: (f"boolean(//{side}//{fix})", href(side, fix), href(side, navaid))
    # A filter behind explode stays there: it would be given the expression, and so another parse, for each of its terms.
    found = rows.select(F.explode(F.array(texts_at(F.col("xml"), href("routeFormed"), *end("start"), *end("end")))).alias("t"))
    uuid = lambda x: F.nullif(F.regexp_replace(x, "^urn:uuid:", ""), F.lit(""))
    part = lambda i: F.get("t", F.lit(i))
    side = lambda i: uuid(F.when(part(i) == "true", part(i + 1)).otherwise(part(i + 2)))
    return found.select(uuid(part(0)).alias("route_uuid"), side(1).alias("start_uuid"), side(4).alias("end_uuid")).filter("route_uuid is not null and start_uuid is not null and end_uuid is not null")


def flights_of_replies(replies: DataFrame, xml: str = "xml", route_field: str = "icao") -> DataFrame:
    """A row for every <flight> of replies (airspace, sample_time, xml) with a position and a level above ground.

    The position is the last known one, else that of the profile. Its latitude and longitude are those of point/position, of position, of the element
    itself or of any below it, whichever comes first; without two numbers there, the first two of a ``pos`` below it, then of ``coordinates``.
    The route is the requested kind, else filed, else icao.
    """
    bare = F.regexp_replace(F.col(xml), r"(</?)[A-Za-z0-9_.-]+:", "$1")
    each = replies.select("airspace", "sample_time", F.posexplode(F.regexp_extract_all(bare, F.lit(r"(?s)<flight>.*?</flight>"), F.lit(0))).alias("pos", "f"))
    f = F.col("f")
    first = lambda *names: F.coalesce(*[text_of(f, n) for n in names])
    where = F.when(text_of(f, "lastKnownPosition").isNotNull(), F.lit("lastKnownPosition")).otherwise(F.lit("ctfmPointProfile"))
    inside = lambda *path: F.when(where == "lastKnownPosition", text_of(f, "lastKnownPosition", *path)).otherwise(text_of(f, "ctfmPointProfile", *path))
    source = lambda text, *path: F.when(where == "lastKnownPosition", text(f, "lastKnownPosition", *path)).otherwise(text(f, "ctfmPointProfile", *path))
    degrees = lambda name: F.coalesce(*[source(text_of, *path, name) for path in (("point", "position"), ("position",), ())], source(text_below, name)).try_cast("double")
    numbers = lambda name: F.transform(F.slice(F.split(F.trim(F.translate(source(text_below, name), ",", " ")), r"\s+"), 1, 2), lambda t: t.try_cast("double"))
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lon")))
    two = lambda name: pair(F.get(numbers(name), F.lit(0)), F.get(numbers(name), F.lit(1)))
    place = F.coalesce(pair(degrees("latitude"), degrees("longitude")), two("pos"), two("coordinates"))
    unit = inside("flightLevel", "unit")
    yes = lambda x: F.coalesce(to_bool(x), F.lit(False))
    rows = each.select(
        "airspace", "sample_time", "pos", first("aircraftId").alias("flight_id"), first("aircraftType").alias("aircraft_type"),
        first("aerodromeOfDeparture").alias("origin"), first("aerodromeOfDestination").alias("destination"), b2b_time(inside("timeOver")).alias("time_over"),
        place.alias("_place"),
        level_from(unit, inside("flightLevel", "level")).alias("flight_level"), (yes(inside("flightLevel", "ground")) | yes(inside("flightLevel", "ceiling"))).alias("_edge"),
        first(f"{route_field}Route", "filedRoute", "icaoRoute").alias("route_string"),
    )
    found = rows.filter("flight_id is not null and _place is not null and not _edge")
    columns = [c for c in rows.columns if c not in ("_edge", "_place")]
    at = columns.index("time_over") + 1
    return found.select(*columns[:at], F.col("_place.lat").alias("lat"), F.col("_place.lon").alias("lon"), *columns[at:])


def check_window(start: datetime, end: datetime, now: datetime | None = None) -> None:
    """Raises ValueError for a query window that ends before it starts, or starts over a minute in the future."""
    aware = lambda t: t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    if aware(start) > aware(end):
        raise ValueError(f"the window starts at {start}, after its end at {end}")
    if aware(start) > aware(now or datetime.now(timezone.utc)) + timedelta(seconds=60):
        raise ValueError(f"the window starts in the future: {start}")


def stamped(records: DataFrame, sample_time: datetime) -> DataFrame:
    """Records of one poll, all with its time."""
    return records.withColumn("sample_time", F.lit(sample_time))


def first_of_each_flight(records: DataFrame, airspaces: list[str]) -> DataFrame:
    """Of a flight's records at a time, the one of the airspace asked first, then by position in the reply."""
    order = F.array_position(F.array(*[F.lit(a) for a in airspaces]), F.col("airspace"))
    w = Window.partitionBy("sample_time", "flight_id").orderBy(order, "pos")
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_files(index: DataFrame, features: list[str]) -> DataFrame:
    """(file_id, update_id) of the latest update for the features wanted."""
    top = index.agg(F.max("update_id").alias("update_id"))
    return index.join(F.broadcast(top), "update_id").withColumn("feature", feature_type(F.col("file_id"))).filter(F.col("feature").isin(features))


def simulator_flights(raw: DataFrame) -> DataFrame:
    """Simulator records (metres, metres per second, wind east and north) in feet, levels, knots and feet per minute."""
    speed, from_ = wind(F.col("wind_east"), F.col("wind_north"))
    return raw.select(
        "flight_id", "lat", "lon", (F.col("alt_m") / FOOT_M).alias("altitude_ft"), F.rint(F.col("alt_m") / 1000 / KM_PER_LEVEL).cast("int").alias("flight_level"),
        (F.col("gs_mps") * 1.94384449).alias("ground_speed_kt"), mps_to_fpm(F.col("vs_mps")).alias("vertical_rate_fpm"), speed.alias("wind_speed"), from_.alias("wind_heading"),
    )


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """A row for each flight of each scenario of a JSON list."""
    return spark.read.json(path, multiLine=True).select(F.col("name").alias("scenario"), F.explode("flights").alias("f")).select("scenario", "f.*")
