"""Column builders for texts: numbers, times, durations, levels, route tokens, coordinates, JSON lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylane.functions.geo import enu_to_position, nm_to_km

# Knots of Mach 1, knots per km/h, levels per ten metres and per metre.
MACH_KT, KMH_KT, LEVEL_S, LEVEL_M = 580.0, 0.539957, 0.328084, 0.0328084
SPEED_LEVEL = r"^(?:(N|K)([0-9]{4})|(M)([0-9]{3}))(F|A|S|M)([0-9]{3,4})$"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def to_double(x: Column) -> Column:
    return blank_to_null(x).try_cast("double")


def to_int(x: Column) -> Column:
    """Whole part of a number."""
    return to_double(x).try_cast("int")


def to_bool(x: Column) -> Column:
    t = F.lower(blank_to_null(x))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def iso_utc(x: Column) -> Column:
    """ISO 8601 time; without an offset it is UTC (the session's zone)."""
    return F.try_to_timestamp(blank_to_null(x))


def b2b_time(x: Column) -> Column:
    """Times to the second or minute as ISO text; others stay as they are."""
    found = F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm")))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd'T'HH:mm:ss'Z'"), x)


def duration_s(x: Column) -> Column:
    """Seconds of 300, 300s, 10m or 2h; null otherwise or if not positive."""
    n, unit = F.regexp_extract(x, r"^\s*([0-9]+)\s*([smhSMH]?)\s*$", 1).try_cast("long"), F.lower(F.regexp_extract(x, r"^\s*([0-9]+)\s*([smhSMH]?)\s*$", 2))
    s = n * F.when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.when(s > 0, s)


def clock_text(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)


def level_from(unit: Column, text: Column) -> Column:
    """Levels in feet (four digits or more) become hundreds of feet; unit A is taken as it is; other texts are null."""
    n = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(unit == "A", n).when(n >= 1000, F.floor(n / 100).cast("int")).otherwise(n)


def speed_level(token: Column) -> Column:
    """struct(tas, level) of tokens like N0459F340, M078F350 or K0500S1110; null for others."""
    part = lambda i: F.regexp_extract(token, SPEED_LEVEL, i)
    speed = F.when(part(1) == "N", part(2).try_cast("double")).when(part(1) == "K", part(2).try_cast("double") * KMH_KT).otherwise(part(4).try_cast("double") / 100 * MACH_KT)
    n = part(6).try_cast("double")
    level = F.when(part(5) == "S", n * LEVEL_S).when(part(5) == "M", n * LEVEL_M).otherwise(n)
    return F.when(token.rlike(SPEED_LEVEL), F.struct(speed.cast("int").alias("tas"), level.cast("int").alias("level")))


def coordinate(token: Column) -> Column:
    """struct(lat, lon) of literals like 52N020E or 5230N02030E; null for others."""
    pattern = r"^([0-9]{2})([0-9]{2})?([NS])([0-9]{3})([0-9]{2})?([EW])$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(token, pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))
    sign = lambda i, minus: F.when(F.regexp_extract(token, pattern, i) == minus, -1.0).otherwise(1.0)
    return F.when(token.rlike(pattern), F.struct((sign(3, "S") * (part(1) + part(2) / 60)).alias("lat"), (sign(6, "W") * (part(4) + part(5) / 60)).alias("lon")))


PBD = r"^([A-Z]{2,3})([0-9]{3})([0-9]{3})$"


def pbd_position(token: Column, lat: Column, lon: Column) -> Column:
    """struct(lat, lon) at a bearing and distance (NM) from the anchor's position; null for other tokens or without an anchor."""
    km = nm_to_km(F.regexp_extract(token, PBD, 3).try_cast("double"))
    a = F.radians(F.regexp_extract(token, PBD, 2).try_cast("double"))
    new_lat, new_lon, _ = enu_to_position(km * F.sin(a), km * F.cos(a), F.lit(0.0), lat, lon, F.lit(0.0))
    return F.when(token.rlike(PBD) & lat.isNotNull(), F.struct(new_lat.alias("lat"), new_lon.alias("lon")))


def json_names(x: Column) -> Column:
    """Names of a JSON list of strings or of objects with a name: trimmed, blanks dropped; invalid JSON is null."""
    items = F.from_json(x, "array<string>")
    name = lambda s: F.trim(F.coalesce(F.when(s.startswith("{"), F.get_json_object(s, "$.name")), F.when(~s.startswith("{"), s)))
    return F.filter(F.transform(items, name), lambda s: s.isNotNull() & (s != ""))


def feature_type(file_id: Column) -> Column:
    return F.nullif(F.regexp_extract(file_id, r"([^/]+)\.(BASELINE|PERM_DELTA)\.zip$", 1), F.lit(""))


def route_text(names: Column) -> Column:
    return F.array_join(names, " DCT ")


def without_rules(route: Column) -> Column:
    """Drops flight-rule tokens and collapses blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(route, r"\b(IFR|VFR|OAT|GAT|TR\d+)\b", " "), r"\s+", " "))
