"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a write that has ended are wanted no more: its result is a table. Spark deletes them then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset, on one machine."""
    sc = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base := "file://" + tempfile.mkdtemp(prefix="fotolith-"))
    return base.rstrip("/")


class Scratch:
    """Parquet tables of one run under a folder of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.names: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it again."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            if name in self.names:
                self.names.remove(name)

    def clear(self, keep: Iterable[str] = ()) -> None:
        """Drops all tables but those that a result is still read from."""
        self.drop(*(n for n in list(self.names) if n not in set(keep)))
