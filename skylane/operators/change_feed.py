"""The replay's live tables at all ticks at once: versions of positions with the ticks they hold for, and what each tick changes.

Ticks are those of streaming.replay.ticks: the first at min_time, each ``step`` later, the last one at max_time. A sample is in a flight's snapshot from the first
tick that isn't before it to the last one within the window and grace after it, unless a later sample of the flight takes its place. So the ticks it holds for
follow from its time and its successor's by arithmetic; no row for each flight and tick is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.streaming.replay import GRACE_S, WINDOW_S

#: Ticks of a flight that one group of rows spans, at least as many as a sample can hold for.
BLOCK = 4096


def _micros(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _tick_number(time: str, step: int) -> Column:
    """The number of the first tick that isn't before a time, in rows with the dataset's start as _low."""
    return F.ceil((_micros(time) - F.col("_low")) / step).cast("long")


def _with_start(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with the first and last time of the dataset, in micros: one row, as an aggregate without keys has."""
    one = bounds.agg(_micros(F.min("min_time")).alias("_low"), _micros(F.max("max_time")).alias("_high"))
    return rows.crossJoin(F.broadcast(one))


def step_of(tick_s: float, speed: float = 1.0) -> int:
    """Micros between two ticks."""
    return max(1, round(tick_s * max(1.0, speed) * 1_000_000))


def position_versions(
    samples: DataFrame, bounds: DataFrame, tick_s: float = 5.0, window_s: float = WINDOW_S, grace_s: float = GRACE_S, speed: float = 1.0, order: Sequence[str] = ("sample_time",), block: int = BLOCK
) -> DataFrame:
    """Samples that are in the snapshot of some tick, with n_from (the first such tick), n_to (the first tick for which they no longer are) and their flight's
    state at either side: starts (the flight is in no snapshot of the tick before n_from) and ends (in none of tick n_to).

    n_to is one more than the last tick where the sample still holds at the end. Samples without a flight, a time or a position, and those outside the dataset's bounds, hold for no
    tick. Of samples that come first at the same tick only the last by ``order`` is seen, so a flight has at most one row a tick before anything is sorted; ties in all of
    ``order`` go to the larger row. Rows are then grouped by flight and block of ticks, with copies of the rows at most one window beyond its edges, so a flight that most
    rows belong to is split. An empty table gives no rows; further columns are carried.
    """
    step, width = step_of(tick_s, speed), round((window_s + grace_s) * 1_000_000)
    reach = -(-width // step)  # ticks that a sample can hold for
    if block < reach:
        raise ValueError(f"a block of {block} ticks is shorter than the {reach} that a sample holds for")
    columns = samples.columns
    timed = _with_start(samples.filter("flight_id is not null and sample_time is not null and lat is not null and lon is not null"), bounds)
    timed = timed.filter(_micros("sample_time").between(F.col("_low"), F.col("_high"))).withColumn("n_from", _tick_number("sample_time", step))
    until = _micros("sample_time") + width
    # the last tick is at _high, however short the step before it
    over = F.when(until > F.col("_high"), F.ceil((F.col("_high") - F.col("_low")) / step) + 1).otherwise(F.ceil((until - F.col("_low")) / step))
    timed = timed.withColumn("_until", over.cast("long"))
    rest = [c for c in columns if c not in ("flight_id", *order)]
    seen = timed.groupBy("flight_id", "n_from").agg(F.max(F.struct(*order, *rest, "_until")).alias("_s"))
    # only the last of a tick can be in its snapshot, unless no tick lies within its window
    seen = seen.select("flight_id", "n_from", "_s.*").filter("_until > n_from")
    own = F.floor(F.col("n_from") / block)
    offset = F.col("n_from") - own * block
    copies = F.array_compact(F.array(own, F.when(offset < reach, own - 1), F.when(offset >= block - reach, own + 1)))
    spread = seen.withColumn("_block", F.explode(copies))
    w = Window.partitionBy("flight_id", "_block").orderBy("n_from")
    follower = F.lead("n_from").over(w)
    spread = spread.withColumn("n_to", F.least(F.col("_until"), follower)).withColumn("ends", F.coalesce(follower > F.col("_until"), F.lit(True)))
    spread = spread.withColumn("starts", F.coalesce(F.lag("n_to").over(w) < F.col("n_from"), F.lit(True)))
    return spread.filter(F.col("_block") == F.floor(F.col("n_from") / block)).select(*columns, "n_from", "n_to", "starts", "ends")


def last_tick(bounds: DataFrame, tick_s: float = 5.0, speed: float = 1.0) -> DataFrame:
    """One row with the number of the last tick, n_last."""
    span = _micros(F.max("max_time")) - _micros(F.min("min_time"))
    return bounds.agg(F.ceil(span / step_of(tick_s, speed)).cast("long").alias("n_last"))


def changes(versions: DataFrame, bounds: DataFrame, tick_s: float = 5.0, speed: float = 1.0) -> DataFrame:
    """What each tick does to the live tables: (n, change, and the version's columns).

    ``seen``: the flight wasn't in the snapshot before, and is set active; ``moved``: another sample takes its place; ``gone``: the flight is in the snapshot no longer, and is
    deactivated (the row is that of its last sample). A tick on which a flight's sample stays the same has no row for it. Flights that are there at the last tick never go.
    """
    marked = versions.crossJoin(F.broadcast(last_tick(bounds, tick_s, speed)))
    came = F.struct(F.col("n_from").alias("n"), F.when(F.col("starts"), "seen").otherwise("moved").alias("change"))
    went = F.when(F.col("ends") & (F.col("n_to") <= F.col("n_last")), F.struct(F.col("n_to").alias("n"), F.lit("gone").alias("change")))
    rest = [c for c in versions.columns if c not in ("n_from", "n_to", "starts", "ends")]
    return marked.select(F.explode(F.array_compact(F.array(came, went))).alias("_c"), *rest).select("_c.*", *rest)


def positions_at(versions: DataFrame, n: int) -> DataFrame:
    """The snapshot of tick n, by a filter alone."""
    return versions.filter((F.col("n_from") <= n) & (F.col("n_to") > n)).drop("n_from", "n_to", "starts", "ends")


def flights_at(versions: DataFrame, n: int, attributes: Sequence[str] = ()) -> DataFrame:
    """The flight table after tick n: every flight seen so far, the attributes it was last seen with, and whether it is active."""
    best = F.max(F.struct("n_from", "n_to", *attributes)).alias("_v")
    return versions.filter(F.col("n_from") <= n).groupBy("flight_id").agg(best).select("flight_id", *[F.col(f"_v.{c}").alias(c) for c in attributes], (F.col("_v.n_to") > n).alias("active"))


def archived_at(events: DataFrame, feed: DataFrame, bounds: DataFrame, tick_s: float = 5.0, speed: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Active events with archived_n: the first tick, not before their detection, at which a flight of either side is gone; null if there is none, and for inactive events.

    feed: rows of changes(). Each side asks for the next departure of its flight at or after its tick. Questions are made distinct by flight and tick first; they are answered
    within blocks of ticks, and those with no departure left in their block by the first one of a later block, so neither a flight with most events nor a long dataset makes a large group. Events
    without a time, and those before the dataset, are never or from the first tick on archived; flights that are null never leave. Repeated events are answered alike.
    """
    step = step_of(tick_s, speed)
    asked = _with_start(events, bounds).withColumn("_n", F.when(F.col("active"), F.greatest(_tick_number("detected_at", step), F.lit(0).cast("long")))).drop("_low", "_high")
    asked = asked.withColumn("_n", F.when(F.col("detected_at").isNotNull(), F.col("_n")))
    sides = asked.filter("_n is not null").select(F.explode(F.array("flight_id_1", "flight_id_2")).alias("_f"), F.col("_n").alias("_at")).filter("_f is not null").distinct()
    left = feed.filter("change = 'gone'").select(F.col("flight_id").alias("_f"), F.col("n").alias("_at")).distinct()
    in_block = F.floor(F.col("_at") / block).alias("_block")
    both = sides.select("_f", "_at", in_block, F.lit(None).cast("long").alias("_gone"), F.lit(True).alias("_ask"))
    both = both.unionByName(left.select("_f", "_at", in_block, F.col("_at").alias("_gone"), F.lit(False).alias("_ask")))
    ahead = Window.partitionBy("_f", "_block").orderBy("_at").rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumn("_next", F.min("_gone").over(ahead)).filter("_ask").select("_f", "_at", "_block", "_next")
    blocks = both.groupBy("_f", "_block").agg(F.min("_gone").alias("_first"))
    later = Window.partitionBy("_f").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    beyond = blocks.withColumn("_later", F.min("_first").over(later)).filter("_later is not null").select("_f", "_block", "_later")
    answers = near.join(beyond, ["_f", "_block"], "left").select("_f", "_at", F.coalesce("_next", "_later").alias("_next")).filter("_next is not null")
    for side in (1, 2):
        mine = answers.select(F.col("_f").alias(f"flight_id_{side}"), F.col("_at").alias("_n"), F.col("_next").alias(f"_next_{side}"))
        asked = asked.join(mine, [f"flight_id_{side}", "_n"], "left")
    return asked.select(*events.columns, F.least("_next_1", "_next_2").alias("archived_n"))
