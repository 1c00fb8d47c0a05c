"""Column builders for positions, speeds and units. Angles are degrees, distances km or nautical miles as named, levels hundreds of feet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius (km), foot (m), nautical mile (m), WGS84 semi-axis (m) and flattening.
EARTH_KM, FOOT_M, NM_M = 6371.0, 0.3048, 1852.0
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
FEET_PER_NM = NM_M / FOOT_M
KM_PER_LEVEL = 100 * FOOT_M / 1000


def feet_to_meters(x: Column) -> Column:
    return x * FOOT_M


def meters_to_feet(x: Column) -> Column:
    return x / FOOT_M


def feet_to_nm(x: Column) -> Column:
    return x * FOOT_M / NM_M


def mps_to_fpm(x: Column) -> Column:
    return x / FOOT_M * 60


def fpm_to_knots(x: Column) -> Column:
    return x * 60 / FEET_PER_NM


def km_to_nm(x: Column) -> Column:
    return x / 1.852


def nm_to_km(x: Column) -> Column:
    return x * 1.852


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(p1) * F.cos(p2) * t * t
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return km_to_nm(haversine_km(lat1, lon1, lat2, lon2))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the WGS84 spheroid by Lambert's formula for long lines (within about a metre for some hundred km)."""
    reduced = lambda x: F.atan((1 - WGS84_F) * F.tan(F.radians(x)))
    b1, b2 = reduced(lat1), reduced(lat2)
    s, t = F.sin((b2 - b1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(b1) * F.cos(b2) * t * t
    sigma = 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    square = lambda x: x * x
    x = (sigma - F.sin(sigma)) * square(F.sin(p) * F.cos(q)) / square(F.cos(sigma / 2))
    y = (sigma + F.sin(sigma)) * square(F.cos(p) * F.sin(q)) / F.nullif(square(F.sin(sigma / 2)), F.lit(0.0))
    return F.when(sigma == 0, 0.0).otherwise(WGS84_A * (sigma - WGS84_F / 2 * (x + y)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def horizontal_speed_kmh(km: Column, hours: Column) -> Column:
    """Null where no time has passed."""
    return F.abs(F.try_divide(km, hours))


def vertical_speed_m_min(level_from: Column, level_to: Column, minutes: Column) -> Column:
    return F.try_divide((level_to - level_from) * 100 * FOOT_M, minutes)


def ecef(lat: Column, lon: Column, level: Column) -> tuple[Column, Column, Column]:
    """Cartesian km on a sphere raised by the flight level."""
    r, p, q = EARTH_KM + level * KM_PER_LEVEL, F.radians(lat), F.radians(lon)
    return r * F.cos(p) * F.cos(q), r * F.cos(p) * F.sin(q), r * F.sin(p)


def enu_km(lat1: Column, lon1: Column, level1: Column, lat2: Column, lon2: Column, level2: Column) -> tuple[Column, Column, Column]:
    """East, north and up (with the sagitta of the sphere) of the second position as seen from the first."""
    a, b = ecef(lat1, lon1, level1), ecef(lat2, lon2, level2)
    dx, dy, dz = (v - u for u, v in zip(a, b, strict=True))
    p, q = F.radians(lat1), F.radians(lon1)
    east = -F.sin(q) * dx + F.cos(q) * dy
    north = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    up = F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz
    return east, north, up + (east * east + north * north) / (2 * EARTH_KM)


def enu_to_position(east: Column, north: Column, up: Column, lat: Column, lon: Column, level: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and level of km offsets from a reference, on a flat earth."""
    return (
        lat + F.degrees(north / EARTH_KM),
        lon + F.degrees(east / (EARTH_KM * F.cos(F.radians(lat)))),
        level + up / KM_PER_LEVEL,
    )


def speed_vector(knots: Column, track: Column, fpm: Column) -> tuple[Column, Column, Column]:
    """East, north and up in knots."""
    a = F.radians(track)
    return knots * F.sin(a), knots * F.cos(a), fpm_to_knots(fpm)


def position_after(lat: Column, lon: Column, level: Column, knots: Column, track: Column, fpm: Column, hours: Column) -> tuple[Column, Column, Column]:
    """Position at constant velocity; unchanged for no or negative time."""
    moved = enu_to_position(*[nm_to_km(v * hours) for v in speed_vector(knots, track, fpm)], lat, lon, level)
    return tuple(F.when(hours > 0, m).otherwise(x.cast("double")) for m, x in zip(moved, (lat, lon, level), strict=True))


def leg_progress(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Share of the leg a-b that lies behind a position (below 0: before it); 1.1 for a leg without length."""
    c = F.cos(F.radians((a_lat + b_lat) / 2))
    ux, uy, vx, vy = b_lat - a_lat, (b_lon - a_lon) * c, lat - a_lat, (lon - a_lon) * c
    return F.coalesce(F.try_divide(vx * ux + vy * uy, ux * ux + uy * uy), F.lit(1.1))


def projected_level(level: Column, fpm: Column, planned: Column, hours: Column) -> Column:
    """Level at the first waypoint: kept in level flight, else extrapolated and not beyond a planned level it moves to."""
    ahead = level + fpm * 60 / 100 * hours
    toward = ((planned > level) & (fpm > 0)) | ((planned < level) & (fpm < 0))
    held = F.when(fpm > 0, F.least(ahead, planned.cast("double"))).otherwise(F.greatest(ahead, planned.cast("double")))
    return F.when(F.abs(fpm) < 100, level.cast("int")).otherwise(F.rint(F.when(toward, held).otherwise(ahead)).cast("int"))


def levels_close(a: Column, b: Column, tolerance: int = 4) -> Column:
    return F.abs(a - b) <= tolerance


def wind(east_mps: Column, north_mps: Column) -> tuple[Column, Column]:
    """Speed in knots, and the direction the wind blows from."""
    return F.sqrt(east_mps * east_mps + north_mps * north_mps) * 1.944, F.pmod(F.degrees(F.atan2(-east_mps, -north_mps)) + 360, F.lit(360.0))


def heat_intensity(remaining_hours: Column) -> Column:
    """0.3 to 1 as the time left falls from half an hour to none; 0.3 without a time."""
    near = 1 - F.coalesce(remaining_hours, F.lit(0.5)) / 0.5
    return 0.3 + 0.7 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), near))


def grid(x: Column) -> Column:
    """x to one decimal, by its exact value: ties, which only quarters can be, go to the even digit.

    Ten times x is 8 x + 2 x, both exact; what their sum s loses by rounding, e, decides where s alone looks like a tie.
    """
    eight, two = x * 8, x * 2
    s = eight + two
    e = (eight - (s - (s - eight))) + (two - (s - eight))
    tie = s - F.floor(s) == 0.5
    return F.when(tie & (e > 0), F.ceil(s)).when(tie & (e < 0), F.floor(s)).otherwise(F.rint(s)).cast("double") / 10


def minutes_text(hours: Column) -> Column:
    """Minutes as a number, halves rounded up."""
    return F.floor(hours * 60 + 0.5).cast("int")


def fixed_text(x: Column) -> Column:
    """Two decimals as text; N/A where unknown."""
    return F.coalesce(F.format_string("%.2f", x), F.lit("N/A"))
