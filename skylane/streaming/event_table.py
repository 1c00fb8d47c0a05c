"""A table kept in versions with a ledger of batches, and the loop that writes detected conflicts to it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylane.operators import blocking, events
from skylane.operators.staging import staged
from skylane.plans.detection import detect_among

EVENTS = "id long, flight_id_1 string, flight_id_2 string, detected_at timestamp, last_checked timestamp, middle_point_lat double, middle_point_lon double, horizontal_distance double, vertical_distance double, remaining_time double, active boolean"


class VersionedTable:
    """Versions of a table in a folder of any store Spark reads; each batch makes one, once.

    A version is written under a name of its own, and counts from the moment its batch's entry in the ledger is put in place by a rename,
    which is one step. So a batch that ends halfway leaves files that nothing names, one that comes again is passed over, and readers see the
    version of the highest batch. One writer is assumed, as a stream's checkpoint allows no more; a new stream needs a new table, as batch numbers begin again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._paths("/".join((self.folder, *names)))

    def ledger(self) -> dict[int, str]:
        """Batch number -> name of the version."""
        entries = self._path("ledger")
        if not self._files.exists(entries):
            return {}
        names = [x.getPath().getName() for x in self._files.listStatus(entries)]
        return {int(n.split(".")[0]): n.split(".", 1)[1] for n in names if n[0].isdigit()}

    def read(self) -> DataFrame:
        """The newest version; no rows before the first."""
        found = self.ledger()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{found[max(found)]}")

    def apply(self, batch: int, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Makes the batch's version out of the newest one, unless the ledger has the batch or a later one already."""
        found = self.ledger()
        if found and max(found) >= batch:
            return False
        version = f"version-{batch}-{uuid.uuid4().hex}"
        change(self.read()).write.parquet(f"{self.folder}/{version}")
        self._enter(batch, version)
        return True

    def _enter(self, batch: int, version: str) -> None:
        """The ledger's entry is an empty file that names batch and version."""
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        self._files.mkdirs(self._path("ledger"))
        self._files.create(draft, True).close()
        if not self._files.rename(draft, self._path("ledger", f"{batch}.{version}")):
            raise OSError(f"batch {batch} couldn't be entered in the ledger of {self.folder}")

    def clean(self, keep: int = 2) -> None:
        """Deletes versions and drafts that nothing names, or that are older than the last ``keep``; the ledger stays whole."""
        found = self.ledger()
        wanted = {found[b] for b in sorted(found)[-keep:]}
        for x in self._files.listStatus(self._path()):
            name = x.getPath().getName()
            if name.startswith(("version-", "draft-")) and name not in wanted:
                self._files.delete(x.getPath(), True)


def detection_step(table: VersionedTable, plans: DataFrame, threshold_h: float = 0.25, mode: str = "spheroid", order: tuple[str, ...] = ("ts",)) -> Callable[[DataFrame, int], None]:
    """What a batch of positions does to the event table, for foreachBatch: candidate pairs of its latest positions, detection, reconciliation.

    The time of the check is that of the batch's newest position, so a batch that comes again writes the same; the pairs checked are the candidates, and the active
    events of those of them in which no conflict is found are archived. A batch without positions changes nothing. Candidates aren't written: detection meets them itself, and of
    those without a conflict only the pairs of active events matter.
    """

    def step(batch: DataFrame, number: int) -> None:
        done = table.ledger()
        if done and max(done) >= number:
            return
        rows = staged(blocking.latest_per_flight(blocking.can_conflict(batch), order), "latest")
        newest = rows.agg(F.max("ts")).first()[0]
        predicted = staged(events.events_from(detect_among(rows, plans, threshold_h, mode=mode), F.lit(newest)), "predicted")
        # Only pairs with an event can have one to archive.
        checked = lambda now: blocking.candidates_among(now.filter("active"), rows, threshold_h, mode=mode)
        table.apply(number, lambda now: events.reconcile(predicted, now, checked(now), F.lit(newest)) if newest is not None else now)

    return step


def start_loop(positions: DataFrame, table: VersionedTable, plans: DataFrame, checkpoint: str, every: str | None = "35 seconds", **how) -> StreamingQuery:
    """The detection as a stream over positions; without ``every`` it ends when what is there now has been read."""
    timing = {"processingTime": every} if every else {"availableNow": True}
    return positions.writeStream.foreachBatch(detection_step(table, plans, **how)).option("checkpointLocation", checkpoint).trigger(**timing).start()
