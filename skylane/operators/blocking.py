"""Candidate pairs of flights that can meet within a time."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.geo import EARTH_KM, NM_M, WGS84_A, WGS84_F, km_to_nm

from .staging import staged

MIN_LEVEL, MAX_SKEW_S, THRESHOLD_H = 60, 300, 0.5
#: Parts into which a cell's flights are split on either side, so that a busy cell isn't one task.
SALTS, PARTS = 8, 4
#: Flights of one state that a row holds; further ones have further rows.
MEMBERS = 64
#: Flights whose partners a task looks for at once, and flights they are measured against at once.
ROWS, COLUMNS = 32, 8192
#: Cosines of single precision closer than this are told apart by the distance itself; five products of numbers up to one are out by less.
SURE = 1e-6
BASE = ("flight_id", "ts", "lat", "lon", "ground_speed_kt")


def latest_per_flight(positions: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last row of each flight; ties in ts go by further columns of order."""
    w = Window.partitionBy("flight_id").orderBy(*[F.desc(c) for c in order])
    return positions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def can_conflict(positions: DataFrame) -> DataFrame:
    """Positions with a place and a speed, above the lowest level."""
    return positions.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("ground_speed_kt") > 0) & (F.col("flight_level") > MIN_LEVEL))


def active_positions(positions: DataFrame, flights: DataFrame) -> DataFrame:
    return positions.join(flights.filter("active").select("flight_id"), "flight_id", "left_semi")


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of two known, different flights."""
    return pairs.filter("flight_id_1 is not null and flight_id_2 is not null and flight_id_1 <> flight_id_2")


def _points(latest: DataFrame, mode: str, carry: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """Positions with their carried columns as own (a column that may be there already) and further ones as they are, with points on the unit sphere: of the latitude, or of the reduced latitude of the spheroid.

    All sines and cosines are taken here, once for a position, so that a pair costs differences, a root and an arc sine.
    """
    b, l = F.radians("lat"), F.radians("lon")  # noqa: E741
    if mode == "spheroid":
        b = F.atan((1 - WGS84_F) * F.tan(b))
    return latest.select("flight_id", "ts", "lat", "lon", "ground_speed_kt", (F.cos(b) * F.cos(l)).alias("x"), (F.cos(b) * F.sin(l)).alias("y"), F.sin(b).alias("z"), *(["own"] if "own" in latest.columns else [F.struct(*carry).alias("own")] if carry else []), *more)


def _sides(latest: DataFrame, mode: str, carry: Sequence[str] = (), more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """_points as sides 1 and 2."""
    rows = _points(latest, mode, carry, more)
    return tuple(rows.select(*[F.col(c).alias(f"{c}_{i}") for c in rows.columns]) for i in (1, 2))


def _distance_nm(mode: str) -> Column:
    """Distance of the sides' points: along the sphere, or by Lambert's formula, whose terms are sums and differences of sines."""
    square = lambda x: x * x
    a = (square(F.col("x_1") - F.col("x_2")) + square(F.col("y_1") - F.col("y_2")) + square(F.col("z_1") - F.col("z_2"))) / 4  # squared sine of half the angle
    angle = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    if mode != "spheroid":
        return km_to_nm(EARTH_KM * angle)
    sine = 2 * F.sqrt(a * F.greatest(F.lit(0.0), 1 - a))
    x = F.try_divide((angle - sine) * square(F.col("z_1") + F.col("z_2")) / 4, 1 - a)
    y = F.try_divide((angle + sine) * square(F.col("z_1") - F.col("z_2")) / 4, a)
    return WGS84_A / NM_M * (angle - WGS84_F / 2 * (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))


def _close(pairs: DataFrame, threshold_h: float, max_skew_s: float, mode: str, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs close enough in time and closing time, the smaller id first; the distance is the same either way round."""
    skew = F.abs(F.unix_micros(F.col("ts_1").cast("timestamp")) - F.unix_micros(F.col("ts_2").cast("timestamp")))
    near = pairs.filter(skew < max_skew_s * 1e6).withColumn("distance_nm", _distance_nm(mode))
    near = near.withColumn("time_to_meeting_hours", F.try_divide("distance_nm", F.col("ground_speed_kt_1") + F.col("ground_speed_kt_2")))
    first = F.col("flight_id_1") < F.col("flight_id_2")
    own = lambda i, c: F.when(first, F.col(f"own_{i}.{c}")).otherwise(F.col(f"own_{3 - i}.{c}")).alias(f"{c}_{i}")
    carried = [own(i, c) for i in (1, 2) for c in carry]
    return near.filter(F.col("time_to_meeting_hours") <= threshold_h).select(F.least("flight_id_1", "flight_id_2").alias("flight_id_1"), F.greatest("flight_id_1", "flight_id_2").alias("flight_id_2"), "distance_nm", "time_to_meeting_hours", *carried)


def candidate_pairs(latest: DataFrame, threshold_h: float = THRESHOLD_H, max_skew_s: float = MAX_SKEW_S, mode: str = "spheroid", carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of latest positions whose closing time is within the threshold, with both flights' columns of carry as _1 and _2.

    Only flights of the same or of neighbouring cells are compared. A cell is a latitude band, a range of longitudes and a
    time slot. A band is as wide as two of the fastest flights can close in the threshold, padded by 2 % for short degrees;
    a range of longitudes is as wide at the latitude farthest from the equator, and all of them where that is near a pole;
    a slot is as long as the skew. What this needs, the top speed and the highest latitude, is aggregated first, over
    positions that are written once. One flight of a pair is copied to its own cell and half of the neighbouring ones, so
    every pair is met once. Flights are few and pairs are many, so what a pair needs of its flights is carried here rather than joined to
    pairs later, and a cell's flights are split by a salt on either side, the other side having a copy for each.
    """
    rows = staged(latest.select(*BASE, *[c for c in carry if c not in BASE]), "latest")
    return meeting_pairs(rows, grid_of(rows, threshold_h), threshold_h, max_skew_s, mode, carry)


def grid_of(rows: DataFrame, threshold_h: float) -> tuple[float, int]:
    """Width of a latitude band in degrees, and the number of ranges of longitudes."""
    most = rows.agg(F.max("ground_speed_kt").alias("top"), F.max(F.abs("lat")).alias("lat")).first()
    top = float(most.top or 0)
    width = max(1e-3, 2 * top * threshold_h / 60 * 1.02)
    polar = min(90.0, (most.lat or 0.0) + width)
    around = int(360 * math.cos(math.radians(polar)) / width) if polar < 85 else 1  # ranges of longitudes
    return width, around if around >= 3 else 1


def _cell(grid: tuple[float, int], i: str = "") -> tuple[Column, Column]:
    width, lons = grid
    return F.floor(F.col(f"lat{i}") / width), F.pmod(F.floor((F.col(f"lon{i}") + 180) * (lons / 360)), F.lit(lons))


def _slot(time: Column, max_skew_s: float) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (max_skew_s * 1e6))


def _sideways(lons: int) -> tuple[int, ...]:
    return (-1, 0, 1) if lons > 1 else (0,)


def _salt(i: int, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(f"flight_id_{i}"), F.lit(n)).cast("int")


def _copies(n: int = SALTS) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(n)]))


def meeting_pairs(rows: DataFrame, grid: tuple[float, int], threshold_h: float, max_skew_s: float, mode: str, carry: Sequence[str], tasks: int | None = None) -> DataFrame:
    """candidate_pairs of written rows in a grid of theirs, by so many tasks if that is told."""
    lons = grid[1]
    a, b = _sides(rows, mode, carry)
    cell = lambda i: (*_cell(grid, f"_{i}"), _slot(F.col(f"ts_{i}"), max_skew_s))
    # Half of the neighbouring cells: a step and its reverse never both.
    steps = [(x, y % lons, z) for x, y, z in itertools.product((0, 1), _sideways(lons), (-1, 0, 1)) if (x, y, z) >= (0, 0, 0)]
    names = ("band", "range", "slot")
    a = a.withColumns(dict(zip(names, cell(1), strict=True))).withColumns({"salt": _salt(1), "part": _copies(PARTS)})
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, step, strict=True)]) for step in steps])
    b = b.withColumns({f"_{n}": c for n, c in zip(names, cell(2), strict=True)}).withColumn("_d", F.explode(offsets))
    b = b.select(*[c for c in b.columns if not c.startswith("_")], (F.col("_band") + F.col("_d.band")).alias("band"), F.pmod(F.col("_range") + F.col("_d.range"), F.lit(lons)).alias("range"), (F.col("_slot") + F.col("_d.slot")).alias("slot"), ((F.col("_d.band") == 0) & (F.col("_d.range") == 0) & (F.col("_d.slot") == 0)).alias("_own"), _copies().alias("salt"))
    b = b.withColumn("part", F.pmod(F.xxhash64("flight_id_2", F.lit(1)), F.lit(PARTS)).cast("int"))
    if tasks:
        a, b = (side.repartition(tasks, *names, "salt", "part") for side in (a, b))
    # Flights fit a broadcast long after their pairs need all cores, so the join is told to shuffle.
    met = a.hint("shuffle_hash").join(b, [*names, "salt", "part"]).filter(~F.col("_own") | (F.col("flight_id_1") < F.col("flight_id_2")))
    return _close(met, threshold_h, max_skew_s, mode, carry)


def state_pairs(latest: DataFrame, threshold_h: float = THRESHOLD_H, max_skew_s: float = MAX_SKEW_S, mode: str = "spheroid") -> DataFrame:
    """candidate_pairs of states, with the flights on either side as flights_1 and flights_2: all pairs of one of either are candidates, see flight_pairs.

    Flights of the same time, place and speed are one state, so a distance is taken once for a pair of states, however many flights share them. A row has MEMBERS flights at
    most; where both sides are the same row, they stand for the pairs among its flights. latest has one row for a flight.
    """
    state = BASE[1:]
    numbered = F.row_number().over(Window.partitionBy(*state).orderBy("flight_id")) - 1
    rows = latest.select(*BASE).dropna().withColumn("_row", F.floor(numbered / MEMBERS))
    rows = rows.groupBy(*state, "_row").agg(F.array_sort(F.collect_list("flight_id")).alias("flights"))
    rows = staged(rows.select(F.col("flights")[0].alias("flight_id"), *state, "flights"), "states")
    tasks = 8 * rows.sparkSession.sparkContext.defaultParallelism  # states are few bytes for the rows they become
    met = meeting_pairs(rows, grid_of(rows, threshold_h), threshold_h, max_skew_s, mode, ("flights",), tasks).drop("flight_id_1", "flight_id_2")
    shared = rows.filter((F.size("flights") > 1) & (F.col("ground_speed_kt") != 0))
    zero = F.lit(0.0)
    return met.unionByName(shared.select(zero.alias("distance_nm"), zero.alias("time_to_meeting_hours"), F.col("flights").alias("flights_1"), F.col("flights").alias("flights_2")))


def flight_pairs(pairs: DataFrame) -> DataFrame:
    """A row for each pair of flights of state_pairs, the smaller id first, with the other columns of pairs.

    Rows of a pair of states follow one another, and those of a first flight among them, so that in a columnar file equal values are one run.
    """
    others = [c for c in pairs.columns if c not in ("flights_1", "flights_2")]
    either = F.array(*[F.struct(F.col(f"flights_{i}").alias("one"), F.col(f"flights_{3 - i}").alias("other")) for i in (1, 2)])
    ways = F.when(F.col("flights_1")[0] == F.col("flights_2")[0], F.slice(either, 1, 1)).otherwise(either)
    each = pairs.select(*others, F.explode(ways).alias("_way")).select(*others, F.col("_way.other").alias("_other"), F.explode("_way.one").alias("flight_id_1"))
    return each.select("flight_id_1", F.explode("_other").alias("flight_id_2"), *others).filter("flight_id_1 < flight_id_2")


def times_ahead(rows: DataFrame, among: DataFrame, grid: tuple[float, int], min_skew_s: float, max_skew_s: float) -> DataFrame:
    """rows with each time at among which they may meet a flight of among that is newer by more than min_skew_s and less than max_skew_s.

    Times are those of flights in the same or a neighbouring cell, each once, so there are as many rows as a flight has later times around it, however many flights share them.
    """
    lons = grid[1]
    names = ("_band", "_range", "_slot")
    times = among.select(*[c.alias(n) for n, c in zip(names, (*_cell(grid), _slot(F.col("ts"), max_skew_s)), strict=True)], F.col("ts").alias("at")).distinct()
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, step, strict=True)]) for step in itertools.product((-1, 0, 1), _sideways(lons), (0, 1))])
    band, range_ = _cell(grid)
    asking = rows.select("flight_id", "ts", band.alias("_b"), range_.alias("_r"), _slot(F.col("ts"), max_skew_s).alias("_s"), F.explode(steps).alias("_d"))
    asking = asking.select("flight_id", "ts", (F.col("_b") + F.col("_d._band")).alias("_band"), F.pmod(F.col("_r") + F.col("_d._range"), F.lit(lons)).alias("_range"), (F.col("_s") + F.col("_d._slot")).alias("_slot"))
    ahead = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    found = asking.join(times, list(names)).filter((ahead > min_skew_s * 1e6) & (ahead < max_skew_s * 1e6)).select("flight_id", "at").distinct()
    return rows.join(found, "flight_id")


def candidates_among(pairs: DataFrame, latest: DataFrame, threshold_h: float = THRESHOLD_H, max_skew_s: float = MAX_SKEW_S, mode: str = "spheroid") -> DataFrame:
    """Those of the given pairs (flight_id_1, flight_id_2) that are candidate pairs of latest, the smaller id first."""
    a, b = _sides(latest.select(*BASE), mode)
    known = valid_pairs(pairs).select(F.least("flight_id_1", "flight_id_2").alias("flight_id_1"), F.greatest("flight_id_1", "flight_id_2").alias("flight_id_2")).distinct()
    return _close(known.join(a, "flight_id_1").join(b, "flight_id_2"), threshold_h, max_skew_s, mode).select("flight_id_1", "flight_id_2")


def partners(pairs: DataFrame) -> DataFrame:
    """Sorted partners and their number for every first flight of a pair."""
    grouped = pairs.groupBy("flight_id_1").agg(F.array_sort(F.collect_list("flight_id_2")).alias("partners"))
    return grouped.withColumn("n_partners", F.size("partners"))


def _reached(x: np.ndarray, knots: np.ndarray, threshold_h: float, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whether the closing times of flights rows and columns are within the threshold, as _close has it on the sphere."""
    a = ((x[:, rows] - x[:, columns]) ** 2).sum(axis=0) / 4
    nm = EARTH_KM * 2 * np.arcsin(np.sqrt(np.minimum(1.0, a))) / (NM_M / 1000)
    speed = knots[rows] + knots[columns]
    return (speed != 0) & (nm <= threshold_h * speed)


def _partner_lists(threshold_h: float, max_skew_s: float, separator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partners with greater ids of the flights of a group that ask, among all flights of the group.

    An angle is within the sum of two reaches if its cosine is at least that of the sum, and the difference of these cosines is one product of five terms a flight. Where it is too
    small to be sure of, or a reach is beyond a quarter of the circle, the distance is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).select(["flight_id", "lat", "lon", "knots", "micros", "asks"])
        table = table.take(pc.sort_indices(table, [("flight_id", "ascending")])).combine_chunks()
        ids = table["flight_id"].chunk(0)
        lat, lon, knots, micros, asks = (table[c].to_numpy() for c in table.column_names[1:])
        b, l = np.radians(lat), np.radians(lon)  # noqa: E741
        x = np.stack([np.cos(b) * np.cos(l), np.cos(b) * np.sin(l), np.sin(b)])
        reach = knots * (threshold_h * NM_M / 1000 / EARTH_KM)
        sure = SURE if reach.max() < math.pi / 2 else math.inf
        left, right = (np.concatenate([x, [sign * np.cos(reach), np.sin(reach)]]).astype(np.float32) for sign in (-1, 1))
        skew = math.ceil(max_skew_s * 1e6) - 1
        asking = np.flatnonzero(asks)
        for at in range(0, len(asking), ROWS):
            rows = asking[at : at + ROWS]
            begin = int(rows[0]) + 1  # flights are in order of their ids, so partners come after
            mine, earliest = np.ascontiguousarray(left[:, rows].T), micros[rows][:, None] - skew
            met = np.zeros((len(rows), len(ids) - begin), bool)
            for low in range(begin, len(ids), COLUMNS):
                high = min(len(ids), low + COLUMNS)
                inside = mine @ right[:, low:high]
                found = inside >= sure
                unsure = inside > -sure
                unsure ^= found
                if unsure.any():
                    i, j = np.divmod(np.flatnonzero(unsure), high - low)
                    found[i, j] = _reached(x, knots, threshold_h, rows[i], low + j)
                found &= (micros[None, low:high] - earliest).view(np.uint64) <= 2 * skew  # earlier ones are very large without a sign
                met[:, low - begin : high - begin] = found
            for i, row in enumerate(rows):
                met[i, : row + 1 - begin] = False
            counts = met.sum(axis=1, dtype=np.int32)
            columns = np.flatnonzero(met) - np.repeat(np.arange(len(rows)) * met.shape[1] - begin, counts)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids.take(pa.array(columns)))
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pc.binary_join(lists, separator), pa.array(counts)], ["flight_id_1", "partners", "n_partners"])
            yield out.filter(pa.array(counts > 0))

    return run


def partner_lists(latest: DataFrame, threshold_h: float = THRESHOLD_H, max_skew_s: float = MAX_SKEW_S, separator: str = ",") -> DataFrame:
    """partners of candidate_pairs in "sphere" mode, as text, without making the pairs.

    Pairs grow with the square of the flights, so they are neither rows nor shuffled: a flight is copied to the neighbouring cells in which there are flights, once for each salt, and the
    flights of a cell and salt find their partners in one task, a few at a time. A task holds the flights around a cell and a few finished rows. latest has one row for a flight, and is written.
    """
    rows = staged(latest.select(*BASE).dropna(), "latest")
    grid = grid_of(rows, threshold_h)
    lons, names = grid[1], ("band", "range", "slot")
    cell = [c.alias(n) for n, c in zip(names, (*_cell(grid), _slot(F.col("ts"), max_skew_s)), strict=True)]
    steps = [(x, y, z) for x, y, z in itertools.product((-1, 0, 1), _sideways(lons), (-1, 0, 1))]
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, step, strict=True)]) for step in steps])
    copies = rows.select("flight_id", "lat", "lon", F.col("ground_speed_kt").cast("double").alias("knots"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), *cell, F.explode(offsets).alias("_d"))
    own = (F.col("_d.band") == 0) & (F.col("_d.range") == 0) & (F.col("_d.slot") == 0)
    copies = copies.select("flight_id", "lat", "lon", "knots", "micros", (F.col("band") + F.col("_d.band")).alias("band"), F.pmod(F.col("range") + F.col("_d.range"), F.lit(lons)).alias("range"), (F.col("slot") + F.col("_d.slot")).alias("slot"), own.alias("asks"))
    copies = copies.join(rows.select(*cell).distinct(), list(names), "left_semi").withColumn("salt", _copies())
    copies = copies.withColumn("asks", F.col("asks") & (F.pmod(F.xxhash64("flight_id"), F.lit(SALTS)) == F.col("salt")))
    # Flights are few bytes for the work in them, so the number of tasks is told.
    spread = copies.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *names, "salt")
    return spread.groupBy(*names, "salt").applyInArrow(_partner_lists(threshold_h, max_skew_s, separator), "flight_id_1 string, partners string, n_partners int")
