"""Tables and events of one run: what is stored is not computed again, what is said is said once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_folder

EVENT = "stage string, level int, status string, detail string"


class Job:
    """A run's folder, which outlives the session: a run that is started on it again goes on where it stopped.

    A table counts as stored once its write was committed. Events carry a number, one more than the event before
    whichever session wrote it; an event that was said (same stage, level, status and phase) is not said again, so
    the log is the order of the run, once over restarts.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, listener: Callable[[dict], None] | None = None):
        self.spark, self.listener = spark, listener
        self.folder = folder.rstrip("/") if folder else shared_folder(spark, "job")
        self.said = {self._key(e): e for e in self._log()}

    def _committed(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def has(self, name: str) -> bool:
        return self._committed(f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def store(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name, made and written if no run has committed it yet."""
        if not self.has(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    @staticmethod
    def _key(event: dict) -> tuple:
        return event["stage"], event["level"], event["status"], event["detail"].get("phase")

    def _log(self) -> list[dict]:
        """A run has a few dozen events."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/events")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        return [{"seq": r["seq"], "stage": r["stage"], "level": r["level"], "status": r["status"], "detail": json.loads(r["detail"])} for r in self.events().collect() if r["stage"]]

    def events(self) -> DataFrame:
        """``stage, level, status, detail, seq`` in the order in which they were said."""
        return self.spark.read.schema(f"{EVENT}, seq int").json(f"{self.folder}/events").orderBy("seq")

    def emit(self, stage: str, level: int, status: str, **detail) -> None:
        """Stored first, then handed to the listener."""
        event = {"seq": len(self.said) + 1, "stage": stage, "level": level, "status": status, "detail": detail}
        if self._key(event) in self.said:
            return
        row = self.spark.createDataFrame([(stage, level, status, json.dumps(detail))], EVENT)
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/events/seq={event['seq']}")
        self.said[self._key(event)] = event
        if self.listener is not None:
            self.listener(event)

    def outcome(self, stage: str, level: int) -> dict | None:
        """The last event of a stage that says how it ended."""
        ended = [e for e in self.said.values() if (e["stage"], e["level"]) == (stage, level) and e["status"] != "running"]
        return max(ended, key=lambda e: e["seq"], default=None)
