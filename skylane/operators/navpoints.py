"""Navigation points: nearest by name, precedence of literals, lookups and loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.geo import EARTH_KM, geodesic_m, haversine_km
from skylane.functions.parsing import PBD, coordinate, pbd_position

from .staging import staged


#: Sizes of the nested cells in degrees, from the finest; each divides 360.
CELLS = (1 / 16, 1 / 2, 4.0, 30.0)
#: Parts into which asked rows of the same name and cell are split.
SALTS = 8
#: Distances on spheroid and sphere differ by less than this share.
_SURE = 0.99


def _cells(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size).cast("int"), F.pmod(F.floor(lon / size), F.lit(round(360 / size))).cast("int")


def _reach_m(lat: Column, lon: Column, size: float) -> Column:
    """Metres around a position that surely lie within its cell and the eight around it.

    A way out crosses a parallel or a meridian at the block's edge; the least angle to a meridian has the sine of cos(latitude) * sin(difference).
    """
    gap = lambda x: F.least(1 + x / size - F.floor(x / size), 2 - (x / size - F.floor(x / size))) * size
    return _SURE * EARTH_KM * 1000 * F.least(F.radians(gap(lat)), F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(gap(lon)))))


def _measured(asked: DataFrame, points: DataFrame, on: Sequence[str], row: Sequence[str], mode: str) -> DataFrame:
    """asked with best (struct of m and p) among the points that agree on the columns of on, and with how many were measured so far."""
    far = geodesic_m if mode == "spheroid" else lambda *x: haversine_km(*x) * 1000
    salted = asked.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int"))
    copies = points.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    met = salted.join(copies, [*on, "_salt"], "left")
    # No condition around the distance: the terms it repeats are computed once only where they always are.
    metres = F.coalesce(far(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")), F.lit(float("inf")))
    best = F.min(F.struct(metres.alias("m"), "p"))
    found = met.groupBy(*row).agg(best.alias("best"), (F.max("measured") + F.count("p_lat")).alias("measured"))
    return found.withColumn("best", F.when(F.col("best.m") < float("inf"), F.col("best")))


def nearest_points(asked: DataFrame, points: DataFrame, key: Sequence[str], name: str, mode: str = "spheroid") -> DataFrame:
    """The nearest point of the same name for every distinct asked row (key, name, lat, lon): best, a struct of metres m and p, and measured, the number of distances taken.

    points: name, p_lat, p_lon and p, a struct by whose order ties go. Rows and points without a position take no part. Points stand in cells that are
    widened from round to round, in their own cell and the eight around it, so that an asked row joins one cell. A row is settled once its best
    point is nearer than anything outside can be; what no cell settles is measured against all places of its name. Every round writes a table.
    """
    row = [*key, name, "lat", "lon"]
    known = points.filter(known_position(F.col("p_lat"), F.col("p_lon")))
    known = staged(known.groupBy(name, "p_lat", "p_lon").agg(F.min("p").alias("p")), "points")  # of points in one place only the first can be the nearest
    left = asked.select(*row).filter(known_position(F.col("lat"), F.col("lon"))).join(known.select(name).distinct(), name, "left_semi").select(*row, F.lit(0).cast("long").alias("measured"))
    done = []
    for size in CELLS:
        at = dict(zip(("_y", "_x"), _cells(F.col("lat"), F.col("lon"), size), strict=True))
        y, x = _cells(F.col("p_lat"), F.col("p_lon"), size)
        steps = F.array(*[F.struct(F.lit(i).alias("y"), F.lit(j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        near = known.withColumn("_d", F.explode(steps)).withColumns({"_y": y + F.col("_d.y"), "_x": F.pmod(x + F.col("_d.x"), F.lit(round(360 / size)))}).drop("_d")
        rows = staged(_measured(left.withColumns(at), near, [name, "_y", "_x"], row, mode), "nearest")
        settled = F.coalesce(F.col("best.m") < _reach_m(F.col("lat"), F.col("lon"), size), F.lit(False))
        done.append(rows.filter(settled))
        left = rows.filter(~settled).drop("best")
        if left.isEmpty():
            break
    else:
        done.append(_measured(left, known, [name], row, mode))
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out


def _nearest(asked: DataFrame, points: DataFrame, key: Sequence[str], name: str, mode: str, rest: Sequence[str | Column]) -> DataFrame:
    """key, m and p of the nearest point; where nothing can be measured, the name's first point by the columns of rest.

    Of rows that share a key, the nearest counts.
    """
    first = points.groupBy(name).agg(F.min(F.struct(F.struct(*rest).alias("o"), "p"))["p"].alias("p"))
    near = nearest_points(asked, points, key, name, mode).groupBy(*key).agg(F.min("best").alias("best"))
    names = asked.select(*key, name).join(first, name).groupBy(*key).agg(F.min("p").alias("first"))
    near = near.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "best")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return names.join(near, same, "left").select(*key, F.col("best.m").alias("m"), F.coalesce("best.p", "first").alias("p"))


def nearest_by_name(asked: DataFrame, points: DataFrame, key: Sequence[str], name: str = "ident", mode: str = "spheroid") -> DataFrame:
    """The point of the same name nearest to each asked row's lat, lon; key names the asked rows. Ties go to the least id.

    Where either side has no position, the name's point of the least id is taken, without a distance. See nearest_points for how it is found.
    """
    named = points.select(F.col("identificator").alias(name), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.struct("id", "lat", "lon").alias("p"))
    found = _nearest(asked, named, key, name, mode, ["p.id"])
    return found.select(*key, F.col("p.id").alias("point_id"), F.col("p.lat").alias("point_lat"), F.col("p.lon").alias("point_lon"), F.col("m").alias("distance_m"))


def nearest_of_either(asked: DataFrame, fixes: DataFrame, navs: DataFrame, key: Sequence[str], name: str = "ident", mode: str = "spheroid") -> DataFrame:
    """Nearest of fixes and navaids of a name: those with a position first, then by distance, then fixes, then id."""
    both = fixes.withColumn("src", F.lit("fix")).unionByName(navs.withColumn("src", F.lit("nav")), allowMissingColumns=True)
    named = both.select(F.col("identificator").alias(name), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.struct("src", "id", "lat", "lon").alias("p"))
    found = _nearest(asked, named, key, name, mode, [F.col("p_lat").isNull().alias("bare"), "p.src", "p.id"])
    return found.select(*key, F.col("p.src").alias("src"), F.col("p.id").alias("point_id"), F.col("p.lat").alias("point_lat"), F.col("p.lon").alias("point_lon"), F.col("m").alias("distance_m"))


def _found(asked: DataFrame, fixes: DataFrame, navs: DataFrame, key: Sequence[str], name: str, mode: str) -> DataFrame:
    """asked with fix and nav: structs of the nearest fix, or null, and of the nearest navaid where there is no fix."""
    known = F.col(name).isNotNull()
    for kind, points, open_ in (("fix", fixes, known), ("nav", navs, known & F.col("fix").isNull())):
        near = nearest_by_name(asked.filter(open_), points, key, name, mode).filter("point_lat is not null")
        asked = asked.join(near.select(*key, F.struct(F.col("point_lat").alias("lat"), F.col("point_lon").alias("lon")).alias(kind)), list(key), "left")
        asked = staged(asked, kind) if kind == "fix" else asked  # read for its open rows and for all
    return asked


def resolve_points(asked: DataFrame, fixes: DataFrame, navs: DataFrame, key: Sequence[str], mode: str = "spheroid") -> DataFrame:
    """Adds point: struct(lat, lon) of ident from a coordinate literal, else a place, bearing and distance, else the nearest fix, else the nearest navaid; null if unknown.

    A place's anchor is looked up in the same way, near the asked row.
    """
    anchor = F.when(F.col("ident").rlike(PBD), F.regexp_extract("ident", PBD, 1))
    rows = asked.withColumn("anchor", anchor)
    anchors = _found(rows, fixes, navs, key, "anchor", mode).withColumn("_a", F.coalesce("fix", "nav")).drop("fix", "nav")
    rows = _found(anchors, fixes, navs, key, "ident", mode)
    point = F.coalesce(coordinate(F.col("ident")), pbd_position(F.col("ident"), F.col("_a.lat"), F.col("_a.lon")), F.col("fix"), F.col("nav"))
    return rows.withColumn("point", point).drop("anchor", "_a", "fix", "nav")


def airway_edges(segments: DataFrame, routes: DataFrame, fixes: DataFrame, navs: DataFrame) -> DataFrame:
    """Route segments with the airway's name and both ends' names and positions; segments with an unknown part are left out.

    Of repeated routes the last line counts; navaids go before fixes of the same uuid.
    """
    named = routes.groupBy("uuid").agg(F.max_by("airway_id", "line").alias("airway_id"))
    both = fixes.withColumn("p", F.lit(0)).unionByName(navs.withColumn("p", F.lit(1)), allowMissingColumns=True)
    points = both.groupBy("uuid").agg(F.max_by(F.struct("identificator", "lat", "lon"), "p").alias("at"))
    end = lambda side: points.select(F.col("uuid").alias(f"{side}_uuid"), F.col("at.identificator").alias(f"{side}_waypoint"), F.col("at.lat").alias(f"{side}_lat"), F.col("at.lon").alias(f"{side}_lon"))
    return segments.join(named.withColumnRenamed("uuid", "route_uuid"), "route_uuid").join(end("start"), "start_uuid").join(end("end"), "end_uuid")


def new_airports(airports: DataFrame, existing: DataFrame, replace: bool = False) -> DataFrame:
    """Airports to add: those whose code isn't there, or all if they replace."""
    return airports if replace else airports.join(existing.select("code"), "code", "left_anti")


def known_position(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat.cast("double")) & ~F.isnan(lon.cast("double"))
