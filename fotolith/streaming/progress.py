"""How far a pass is, and whether a folder has changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_SECONDS, LEAST_RATE = 3.0, 0.01


@dataclass
class Progress:
    """Reports of tasks come in the order they end in, so the highest count is shown. The rate is that between two
    samples, three seconds apart at least; without a total or a rate there is no estimate."""

    highest: int = 0
    rate: float = 0.0
    share: float | None = None
    eta: float | None = None
    _at: float | None = None
    _done: int = 0

    def record(self, done: int, total: int, now: float) -> None:
        self.highest = max(self.highest, done)
        self.share = self.highest / total if total > 0 else None
        if self._at is None:
            self._at, self._done = now, done
        elif now - self._at >= SAMPLE_SECONDS and done > self._done:
            self.rate = (done - self._done) / (now - self._at)
            self._at, self._done = now, done
        self.eta = (total - self.highest) / self.rate if total > 0 and self.rate > LEAST_RATE else None


def high_water(reports: DataFrame, keys: list[str], at: str = "at", done: str = "done") -> DataFrame:
    """Reports with ``highest``, the largest count of their pass (``keys``) so far."""
    w = Window.partitionBy(*keys).orderBy(at, done).rowsBetween(Window.unboundedPreceding, 0)
    return reports.withColumn("highest", F.max(done).over(w))


class PollWatcher:
    """Looks every few seconds whether the newest file of a folder is another one; a change asks for a full index."""

    def __init__(self, spark: SparkSession, root: str, seconds: float = 5.0):
        self.spark, self.root, self.seconds = spark, root, seconds
        self.last = self.newest()

    def newest(self):
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(self.root)
        return files.agg(F.max("modificationTime")).first()[0]

    def changed(self) -> bool:
        now = self.newest()
        was, self.last = self.last, now
        return now != was

    def run(self, on_change, stop) -> None:
        """Calls ``on_change()`` after each change until ``stop`` (a threading.Event) is set."""
        while not stop.wait(self.seconds):
            if self.changed():
                on_change()
