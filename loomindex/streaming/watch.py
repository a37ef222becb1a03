"""Keeping an index fresh: tables whose rows are replaced by path, and a stream of changes that does so."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomindex.operators.changes import merge_rows
from loomindex.session import materialize

#: Fixed values. Default poll interval; a watcher is active for three of them, five seconds at least.
INTERVAL_MS, LEAST_ACTIVE_MS = 2000, 5000


@dataclass(frozen=True)
class PathTable:
    """A Parquet table whose rows are replaced by ``path``, partitioned by hash of the path (``slot``).

    Replacing some paths reads and writes only the partitions that they are in, by Spark's dynamic
    partition overwrite. Doing the same replacement again changes nothing, so a step that was cut off is
    simply repeated. ``slots`` must stay the same for a table.
    """

    spark: SparkSession
    root: str
    slots: int = 64

    def _slotted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", F.pmod(F.xxhash64("path"), F.lit(self.slots)).cast("int"))

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.root)
        except Exception as e:  # the table does not exist yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self) -> DataFrame | None:
        rows = self._stored()
        return None if rows is None else rows.filter("path is not null").drop("slot")

    def write(self, rows: DataFrame) -> None:
        """All rows anew."""
        self._slotted(rows).repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slot").parquet(self.root)

    def replace(self, fresh: DataFrame, diff: DataFrame) -> None:
        """The rows of the paths in ``diff`` (path, change) give way to their rows in ``fresh``."""
        touched = [r.slot for r in self._slotted(diff.select("path")).select("slot").distinct().collect()]  # at most ``slots`` numbers
        stored = self._stored()
        if not touched:
            return
        if stored is None:
            self.write(fresh.join(diff.filter("change <> 'deleted'").select("path"), "path", "left_semi"))
            return
        old = stored.filter(F.col("slot").isin(touched)).drop("slot")
        rows = self._slotted(merge_rows(old.filter("path is not null"), fresh, diff).select(*old.columns))
        # A row without path keeps a slot that has no other row, so that its old rows are overwritten too.
        keep = self.spark.createDataFrame([(t,) for t in touched], "slot int").select(*[F.col(f.name) if f.name == "slot" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        # What is overwritten is read first, and written as a whole before it is replaced.
        staged = materialize(rows.unionByName(keep), "replaced")
        staged.repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(self.root)


def newest_per_path(changes: DataFrame) -> DataFrame:
    """The last change of each path (by seen_at, then change_id)."""
    last = F.max(F.struct("seen_at", "change_id", "change_kind")).alias("last")
    return changes.filter("path is not null").groupBy("path").agg(last).select("path", F.col("last.change_kind").alias("change"))


def apply_batch(table: PathTable, extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: replaces the symbols of changed paths. A batch may be repeated.

    ``extract`` gets (path, change) rows and gives the fresh rows of the paths that still exist; a path
    that vanished meanwhile gives none and so is removed.
    """

    def run(changes: DataFrame, batch: int) -> None:
        diff = materialize(newest_per_path(changes), "changes")
        table.replace(extract(diff.filter("change <> 'deleted'")), diff)

    return run


def watch(changes: DataFrame, table: PathTable, extract: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = False, interval_ms: int = INTERVAL_MS) -> StreamingQuery:
    """Starts the stream; ``once`` handles what is there and stops."""
    if interval_ms < 1:
        raise ValueError("the interval must be positive")
    writer = changes.writeStream.foreachBatch(apply_batch(table, extract)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_ms} milliseconds")).start()


def is_active(query: StreamingQuery, interval_ms: int = INTERVAL_MS, now: float | None = None) -> bool:
    """Whether the stream has shown life within three intervals."""
    progress = query.lastProgress
    if not query.isActive or progress is None:
        return query.isActive
    from datetime import datetime

    seen = datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp()
    return (now or time.time()) - seen <= max(3 * interval_ms, LEAST_ACTIVE_MS) / 1000
