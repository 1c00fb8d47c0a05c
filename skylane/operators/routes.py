"""Filed routes: tokens, segments, airway paths, and waypoints with positions.

A route's grammar here: blank-separated tokens; the first may be a speed and level; then may come a departure procedure,
and last an arrival procedure; between them waypoints (with an optional /speed-level change), each optionally followed by
a connection (DCT or an airway). A token may fit several of these, so all readings are followed at once, token by token, and
of those that reach the end the one with the fewest waypoints is taken.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.parsing import SPEED_LEVEL, speed_level

from .staging import staged

# Token patterns of the grammar.
AIRWAY = r"^(?:U[A-Z][0-9]{1,4}|[A-Z][0-9]{1,4}[A-Z]?)$"
WAYPOINT = r"^(?:[A-Z]{2,3}[0-9]{6}|[0-9]{2}[NS][0-9]{3}[EW]|[0-9]{4}[NS][0-9]{5}[EW]|(?!DCT$)[A-Z0-9]{2,5})$"
PROCEDURE = r"^[A-Z][A-Z0-9]{1,4}[1-9](?:[A-HJ-NP-Z]|[0-9])$"


def tokens(route: Column) -> Column:
    """Tokens, without those DCT, in any case, that stand at the start or right after the initial speed and level."""
    bare = F.regexp_replace(F.trim(route), r"^(?i:DCT(?:\s+|$))+", "")
    bare = F.regexp_replace(bare, rf"^({SPEED_LEVEL.strip('^$')})(?:\s+(?i:DCT)(?=\s|$))+", "$1")
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def _from_second(array: str) -> Column:
    """An array without its first element."""
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


#: What a reading costs: a waypoint 1; a procedure that could be an airway, and a connection that leads nowhere, 2, so that a waypoint is preferred there.
POINT_COST, ODD_COST = 1, 2
READING = "struct<cost:int,text:string>"


def _readings(kinds: Column) -> Column:
    """struct(text, reach): the best reading of tokens of the given kinds, a letter each (D departure, W waypoint, C connection, A arrival), null if there is none, and how many tokens any reading takes in.

    kinds: array of struct(w, c, p, odd). A reading is kept for each state of the grammar, as all that follows depends on the state alone.
    """
    none = F.lit(None).cast(READING)
    begin = F.struct(F.lit(0).alias("cost"), F.lit("").alias("text"))

    def then(states: list[Column], fits: Column, letter: str, cost: Column) -> Column:
        best = F.array_min(F.array(*states))  # nulls, for states not reached, are passed over
        return F.when(fits & best.isNotNull(), F.struct((best["cost"] + cost).cast("int").alias("cost"), F.concat(best["text"], F.lit(letter)).alias("text"))).otherwise(none)

    def step(s: Column, k: Column) -> Column:
        procedure = F.when(k["odd"], F.lit(ODD_COST)).otherwise(F.lit(0))
        moved = {
            "begin": none,
            "departed": then([s["begin"]], k["p"], "D", procedure),
            "point": then([s["begin"], s["departed"], s["point"], s["connection"]], k["w"], "W", F.lit(POINT_COST)),
            "connection": then([s["point"]], k["c"], "C", F.lit(0)),
            "arrived": then([s["point"], s["connection"]], k["p"], "A", procedure),
        }
        alive = F.coalesce(*moved.values()).isNotNull()
        return F.struct(*[v.alias(n) for n, v in moved.items()], (s["reach"] + alive.cast("int")).alias("reach"))

    start = F.struct(begin.cast(READING).alias("begin"), *[none.alias(n) for n in ("departed", "point", "connection", "arrived")], F.lit(0).alias("reach"))

    def finish(s: Column) -> Column:
        dangling = F.when(s["connection"].isNotNull(), F.struct((s["connection"]["cost"] + ODD_COST).cast("int").alias("cost"), s["connection"]["text"].alias("text")))
        return F.struct(F.array_min(F.array(s["point"], dangling, s["arrived"]))["text"].alias("text"), s["reach"].alias("reach"))

    return F.aggregate(kinds, start, step, finish)


def parse_routes(routes: DataFrame, text: str = "route") -> DataFrame:
    """Adds parsed: struct(config, departure, arrival, segments, valid, reason).

    segments: array of ident, via (the connection that follows, DCT or an airway), tas, level. Where no reading takes in all tokens, and for routes without
    tokens or null, valid is false, departure, arrival and segments are null, and reason says why: the first token that no reading takes in, or that the route is empty or ends before a waypoint.
    """
    rows = routes.withColumn("_t", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    rows = rows.withColumn("_config", speed_level(F.try_element_at("_t", F.lit(1))))
    rows = rows.withColumn("_t", F.when(F.col("_config").isNotNull(), _from_second("_t")).otherwise(F.col("_t")))
    ident = lambda t: F.element_at(F.split(t, "/"), 1)
    changed = lambda t: speed_level(F.nullif(F.element_at(F.split(t, "/"), -1), t))

    def kind(t: Column) -> Column:
        airway = t.rlike(AIRWAY)
        return F.struct((ident(t).rlike(WAYPOINT) & (~t.contains("/") | changed(t).isNotNull())).alias("w"), ((t == "DCT") | airway).alias("c"), t.rlike(PROCEDURE).alias("p"), airway.alias("odd"))

    rows = rows.withColumn("_k", F.transform("_t", kind)).withColumn("_r", _readings(F.col("_k")))
    read, size = F.col("_r.text"), F.size("_t")
    at = lambda i: F.substring(read, i, F.lit(1))
    token = lambda i: F.element_at(F.col("_t"), i)
    places = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: at(i) == "W")
    segment = lambda i: F.struct(ident(token(i)).alias("ident"), F.when((i < size) & (at(i + 1) == "C"), token(F.least(i + 1, size))).alias("via"), changed(token(i))["tas"].alias("tas"), changed(token(i))["level"].alias("level"))
    known = read.isNotNull()
    reason = F.when(~known, F.when(size == 0, "empty").when(F.col("_r.reach") < size, F.get("_t", F.col("_r.reach"))).otherwise("no waypoint"))
    parsed = F.struct(
        F.col("_config").alias("config"), F.when(known & read.startswith("D"), F.get("_t", F.lit(0))).alias("departure"), F.when(known & read.endswith("A"), F.try_element_at("_t", F.lit(-1))).alias("arrival"),
        F.when(known, F.transform(places, segment)).alias("segments"), known.alias("valid"), reason.alias("reason"),
    )
    return rows.withColumn("parsed", parsed).drop("_t", "_config", "_k", "_r")


def rejected_routes(parsed: DataFrame) -> DataFrame:
    """The rows whose route didn't parse, with the reason in place of parsed."""
    return parsed.filter(~F.col("parsed.valid")).withColumn("reason", F.col("parsed.reason")).drop("parsed")


def running_values(segments: DataFrame, key: tuple[str, ...], columns: tuple[str, ...] = ("tas", "level"), order: str = "idx") -> DataFrame:
    """Each column's last known value along the route, else its default_<column>."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"default_{c}")) for c in columns})


def without_repeats(points: DataFrame, key: tuple[str, ...], order: tuple[str, ...] = ("idx",), column: str = "ident") -> DataFrame:
    """Drops points of the same name as the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return points.withColumn("_b", F.lag(column).over(w)).filter(~F.col(column).eqNullSafe(F.col("_b"))).drop("_b")


def airway_path(edges: list[tuple[int, str, str]], start: str, end: str) -> list[str]:
    """Waypoints from start to end: the first edge is one that touches start (in id order), then the shortest way.

    No such edge, or more than two, give no path. Ties go to the neighbour of the least name.
    """
    touching = [e for e in sorted(edges) if start in e[1:]]
    if not 1 <= len(touching) <= 2:
        return []
    near: dict[str, set[str]] = {}
    for _, a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for _, a, b in touching:
        first = b if a == start else a
        came: dict[str, str | None] = {start: None, first: start}
        open_ = deque([first])
        while open_ and end not in came:
            at = open_.popleft()
            for other in sorted(near[at] - came.keys()):
                came[other] = at
                open_.append(other)
        if end in came:
            path, at = [], end
            while at is not None:
                path.append(at)
                at = came[at]
            return path[::-1]
    return []


def airway_paths(requests: DataFrame, airways: DataFrame, most: int = 100_000) -> DataFrame:
    """(airway_id, start, end, pos, ident) for distinct requests (airway_id, start, end); no rows where there is no path.

    The same as airway_path(), for all requests at once: a breadth-first search whose frontier is a table of searches and the nodes they have
    come to, each with its path so far. A round joins the frontier with the edges by airway and node, so an airway that everybody asks for is spread over
    its nodes, and keeps of each search's new nodes the path that is least by name, which is the one a queue in order of names finds first.
    A search starts with a first edge, and a request with two edges at its start makes two, of which the first that gets there counts. The
    longest path bounds the rounds (``most`` is a guard against bad input only).
    """
    asked = requests.select("airway_id", "start", "end").distinct().filter("airway_id is not null and start is not null and end is not null")
    edges = airways.select("airway_id", "id", F.col("start_waypoint").alias("a"), F.col("end_waypoint").alias("b")).filter("a is not null and b is not null")
    ways = staged(edges.select("airway_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("airway_id", "e.*").distinct(), "ways")
    touching = edges.select("airway_id", "id", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("first")))).otherwise(F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("first")), F.struct(F.col("b").alias("start"), F.col("a").alias("first"))))).alias("e")).select("airway_id", "id", "e.*")
    # More than two edges at a waypoint, and no search starts there: three are enough to know.
    firsts = touching.groupBy("airway_id", "start").agg(F.count("*").alias("n"), F.min(F.struct("id", "first")).alias("one"), F.max(F.struct("id", "first")).alias("two")).filter("n <= 2")
    firsts = firsts.select("airway_id", "start", F.explode(F.when(F.col("n") == 1, F.array("one")).otherwise(F.array("one", "two"))).alias("f")).select("airway_id", "start", F.col("f.id").alias("try"), F.col("f.first").alias("node"))
    key = ["airway_id", "start", "end", "try"]
    open_ = asked.join(firsts, ["airway_id", "start"]).withColumn("path", F.when(F.col("start") == F.col("end"), F.array("start")).otherwise(F.array("start", "node"))).withColumn("node", F.element_at("path", -1))
    open_ = staged(open_.dropDuplicates(key), "open")
    seen = open_.select(*key, F.explode(F.array_distinct(F.array("start", "node"))).alias("node"))
    found: DataFrame | None = None
    for _ in range(most):
        here = open_.filter(F.col("node") == F.col("end")).select(*key, "path")
        found = here if found is None else found.union(here)
        left = open_.join(here.select(*key), key, "left_anti")
        met = left.join(ways.withColumnRenamed("a", "node"), ["airway_id", "node"]).select(*key, F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        fresh = staged(met.join(seen, [*key, "node"], "left_anti").groupBy(*key, "node").agg(F.min("path").alias("path")), "frontier")
        if fresh.isEmpty():
            break
        # Among searches that are still open only nodes of the last two levels can be met again, as edges go both ways.
        seen, open_ = open_.select(*key, "node").union(fresh.select(*key, "node")).union(fresh.select(*key, F.col("start").alias("node")).distinct()), fresh
    else:
        raise RuntimeError(f"paths did not end in {most} rounds")
    best = found.groupBy("airway_id", "start", "end").agg(F.min_by("path", "try").alias("path"))
    return best.select("airway_id", "start", "end", F.posexplode("path").alias("pos", "ident"))


def expand_segments(parsed: DataFrame, airways: DataFrame) -> DataFrame:
    """Waypoints of parsed routes: flight_id, idx, sub, ident, tas, level and the position names are looked up near.

    parsed has flight_id, parsed, lat, lon, ground_speed_kt and flight_level. A waypoint followed by an airway gives the
    airway's path to the next waypoint, or nothing if there is none; consecutive repeats are dropped.
    """
    parsed = staged(parsed.select("flight_id", "parsed", "lat", "lon", "ground_speed_kt", "flight_level"), "parsed")  # the parser's expression is long
    rows = parsed.filter("parsed.valid").select("flight_id", "lat", "lon", F.coalesce("parsed.config.tas", F.when(F.col("parsed.config").isNull(), F.col("ground_speed_kt"))).alias("default_tas"), F.coalesce("parsed.config.level", F.when(F.col("parsed.config").isNull(), F.col("flight_level"))).alias("default_level"), F.posexplode("parsed.segments").alias("idx", "s"))
    rows = rows.select("flight_id", "lat", "lon", "default_tas", "default_level", "idx", "s.*")
    rows = running_values(rows, ("flight_id",)).withColumn("next", F.lead("ident").over(Window.partitionBy("flight_id").orderBy("idx")))
    single = F.col("via").isNull() | (F.col("via") == "DCT")
    rows = staged(rows, "segments")
    direct = rows.filter(single).select("flight_id", "idx", F.lit(0).alias("sub"), "ident", "tas", "level", "lat", "lon")
    asked = rows.filter(~single).select("flight_id", "idx", "tas", "level", F.col("via").alias("airway_id"), F.col("ident").alias("start"), F.col("next").alias("end"))
    anchor = airways.select("airway_id", "id", "start_lat", "start_lon", F.explode(F.array("start_waypoint", "end_waypoint")).alias("start")).groupBy("airway_id", "start").agg(F.min_by(F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")), "id").alias("a"))
    flown = asked.join(airway_paths(asked, airways), ["airway_id", "start", "end"]).join(anchor, ["airway_id", "start"])
    flown = flown.select("flight_id", "idx", F.col("pos").alias("sub"), "ident", "tas", "level", F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"))
    return without_repeats(direct.unionByName(flown), ("flight_id",), ("idx", "sub"))


def waypoint_names(parsed: DataFrame, airways: DataFrame) -> DataFrame:
    """flight_id and names: the waypoints of the expanded route in order, else those of the parsed one, else null.

    Rows without a route, or with one that doesn't parse, stay, with null names.
    """
    found = expand_segments(parsed, airways).groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct("idx", "sub", "ident"))).alias("_e"))
    named = parsed.select("flight_id", F.when(F.col("parsed.valid"), F.transform("parsed.segments", lambda s: s["ident"])).alias("_p")).join(found, "flight_id", "left")
    full = lambda x: F.when(F.size(x) > 0, x)
    return named.select("flight_id", F.coalesce(full(F.transform("_e", lambda x: x["ident"])), full(F.col("_p"))).alias("names"))


def segments_of_airways(requests: DataFrame, airways: DataFrame) -> DataFrame:
    """The segments of the airways asked for (airway_id)."""
    return airways.join(requests.select("airway_id").distinct(), "airway_id", "left_semi")
