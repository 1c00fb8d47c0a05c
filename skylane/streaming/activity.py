"""Flights coming, moving and leaving on a live stream, as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "flight_id string, kind string, start timestamp, last timestamp, samples long, lat double, lon double"
#: Keys that flights share: a key costs some calls to the state store each batch, so there is one for many flights.
BUCKETS = 256
_SPANS = ["flight_id", "start", "last", "samples", "lat", "lon"]


class FlightActivity(StatefulProcessor):
    """Keeps the open spans of a bucket of flights: stretches of a flight's samples at most gap_ms apart, in microseconds.

    A batch gives a row ``seen`` for a span that begins with it and ``moved`` for one that it adds to, with the span's newest position. A span is closed, and
    gives ``gone``, when the watermark has passed its last sample by more than the gap: no sample that could still lengthen it would be let in after
    that, so spans are the same however samples are dealt into batches, unless they come later than the watermark allows. A timer for
    the span that is due first does that where its flights send nothing more. State is as large as the flights heard of within gap and watermark; a bucket's is one
    value, an Arrow stream, and its spans are merged at once.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "spans binary")

    def _known(self) -> pd.DataFrame | None:
        value = self.spans.get()
        return pa.ipc.open_stream(value[0]).read_pandas() if value is not None else None

    def _due(self, spans: pd.DataFrame) -> pd.Series:
        """The first watermark, in milliseconds, that lies beyond the gap after each span."""
        return spans["last"] // 1000 + self.gap_ms + 2

    def _settle(self, spans: pd.DataFrame, watermark: int, timer: int | None) -> pd.DataFrame:
        """Keeps spans that are still open, with a timer in place of the one set, and gives the others."""
        due = self._due(spans)
        closed = due <= watermark
        if closed.all():
            self.spans.clear()
            first = None
        else:
            table = pa.Table.from_pandas(spans.loc[~closed, _SPANS], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            self.spans.update((sink.getvalue().to_pybytes(),))
            first = int(due[~closed].min())
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        return spans[closed].assign(kind="gone")

    def _frames(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            rows = rows[[c.split()[0] for c in CHANGES.split(", ")]].reset_index(drop=True)
            yield rows.assign(**{c: rows[c].astype("datetime64[us]") for c in ("start", "last")})

    def _merged(self, spans: pd.DataFrame) -> pd.DataFrame:
        """Spans, some of them fresh, with those of a flight at most a gap apart as one, that of the newest position's place."""
        spans = spans.assign(_flight=pd.factorize(spans["flight_id"])[0]).sort_values(["_flight", "start", "last", "samples", "lat", "lon", "fresh"], ignore_index=True)
        start, last, flight, fresh = (spans[c].to_numpy() for c in ("start", "last", "_flight", "fresh"))
        top = spans.groupby("_flight", sort=False)["last"].cummax().to_numpy()
        opens = np.ones(len(spans), bool)
        opens[1:] = (flight[1:] != flight[:-1]) | (start[1:] - top[:-1] > self.gap_ms * 1000)
        first = np.flatnonzero(opens)
        newest = np.maximum.reduceat(np.where(last == top, np.arange(len(spans)), -1), first)
        began = np.logical_or.reduceat(~fresh & (start == start[first][np.cumsum(opens) - 1]), first)
        out = spans.loc[newest, ["flight_id", "lat", "lon"]].reset_index(drop=True)
        return out.assign(start=start[first], last=last[newest], samples=np.add.reduceat(spans["samples"].to_numpy(), first), fresh=np.logical_or.reduceat(fresh, first), kind=np.where(began, "moved", "seen"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        spans = [] if known is None else [known.assign(fresh=False)]
        for part in rows:
            times = part["sample_time"].astype("datetime64[us]").astype("int64")
            spans.append(pd.DataFrame({"flight_id": part["flight_id"], "start": times, "last": times, "samples": 1, "lat": part["lat"].astype(float), "lon": part["lon"].astype(float), "fresh": True}))
        merged = self._merged(pd.concat(spans, ignore_index=True))
        gone = self._settle(merged, timerValues.getCurrentWatermarkInMs(), None if known is None else int(self._due(known).min()))
        yield from self._frames(pd.concat([merged[merged["fresh"]], gone]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        if known is not None:
            # The timer that has fired is deleted by Spark.
            yield from self._frames(self._settle(known, timerValues.getCurrentWatermarkInMs(), None))

    def close(self) -> None:
        pass


def with_state_store(spark) -> None:
    """Keyed state with timers needs the state store that keeps it on disk; it is read when a query starts, and streams without such state can use it, too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_changes(samples: DataFrame, gap_s: float = 35, late: str = "35 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Changes (CHANGES) of the flights of a stream of samples (flight_id, sample_time, lat, lon); rows without a flight, time or position don't count.

    Append mode. Samples later than the watermark are dropped. Flights share buckets of state; their number can't change between runs from one checkpoint. See FlightActivity.
    """
    with_state_store(samples.sparkSession)
    rows = samples.select("flight_id", "sample_time", "lat", "lon").dropna().withWatermark("sample_time", late)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("flight_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=FlightActivity(round(gap_s * 1000)), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
