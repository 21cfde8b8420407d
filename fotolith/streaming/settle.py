"""Change streams: a path counts once it has been quiet for a while; its last change wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.paths import is_watched

SETTLE_SECONDS = 3


def classify(events: DataFrame) -> DataFrame:
    """Raw file events (path, kind, ts) as changes: removals vanish, everything else appears."""
    return events.withColumn("change", F.when(F.lower("kind").startswith("remove"), "vanished").otherwise("appeared"))


def settled(events: DataFrame, seconds: int = SETTLE_SECONDS) -> DataFrame:
    """Streaming form: (path, change, at) for events (path, change, ts) with a watermark on ts. A path's session ends
    when nothing came for ``seconds``; its last change is emitted when the watermark has passed."""
    s = events.groupBy(F.session_window("ts", f"{seconds} seconds"), "path").agg(F.max_by("change", "ts").alias("change"), F.max("ts").alias("at"))
    return s.select("path", "change", "at")


def settled_batch(events: DataFrame, now: int, seconds: int = SETTLE_SECONDS, order: str = "event_id") -> DataFrame:
    """Batch form over events (path, change, at in seconds): an event settles if the path's next one, or ``now``, is at
    least ``seconds`` later."""
    following = F.lead("at").over(Window.partitionBy("path").orderBy("at", order))
    return events.withColumn("__next", F.coalesce(following, F.lit(now))).where(F.col("__next") - F.col("at") >= seconds).drop("__next")


def watch(events: DataFrame, root: str, delay: str = "3 seconds", seconds: int = SETTLE_SECONDS) -> DataFrame:
    """From raw events under a root to settled changes."""
    wanted = classify(events).where(is_watched(F.col("path"), root))
    return settled(wanted.withWatermark("ts", delay), seconds)


class Deferred:
    """Changes that wait while a delete is pending, in a folder that outlives the query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def add(self, changes: DataFrame) -> None:
        changes.select("path", "change", "at").write.mode("append").parquet(self.folder)

    def with_waiting(self, changes: DataFrame) -> DataFrame:
        """The changes and those that waited, the last one of each path."""
        if not self._fs.exists(self._path):
            return changes
        every = changes.select("path", "change", "at").unionByName(self.spark.read.parquet(self.folder))
        return every.groupBy("path").agg(F.max_by("change", "at").alias("change"), F.max("at").alias("at"))

    def pending(self) -> int:
        return self.spark.read.parquet(self.folder).select("path").distinct().count() if self._fs.exists(self._path) else 0

    def clear(self) -> None:
        self._fs.delete(self._path, True)


def start(changes: DataFrame, on_batch, checkpoint: str, busy=lambda: False, deferring=lambda: False, every: str = "250 milliseconds"):
    """Runs settled changes through ``on_batch(appeared, vanished)``. While ``deferring()`` (a delete is pending) they
    wait; a batch that comes while another is handled is dropped, as a full scan follows anyway."""
    deferred = Deferred(changes.sparkSession, f"{checkpoint.rstrip('/')}-deferred")

    def handle(df: DataFrame, batch_id: int) -> None:
        if deferring():
            deferred.add(df)
        elif busy():
            deferred.clear()
        else:
            rows = deferred.with_waiting(df)
            appeared, vanished = (rows.where(F.col("change") == c).select("path").orderBy("path") for c in ("appeared", "vanished"))
            on_batch(appeared, vanished)
            deferred.clear()

    return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(handle).start()


def status(query) -> dict:
    """running, seen and busy of a watch."""
    p = query.lastProgress
    return {"running": query.isActive, "seen": int(p["numInputRows"]) if p else 0, "busy": query.status["isTriggerActive"]}
