"""A catalog of Parquet tables under one folder, and the plan that scores a library."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith import schemas
from fotolith.operators import scoring
from fotolith.operators.tables import upsert


class TooNew(RuntimeError):
    """The catalog was written by a later version."""


class Catalog:
    """Tables are snapshots: a change is written beside the current one, then a new state file names it, so readers see the
    old tables or the new ones. Row counts don't matter to the driver; it handles names only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        state = self._read()
        if state["version"] > schemas.VERSION:
            raise TooNew(f"catalog version {state['version']}, this is {schemas.VERSION}")
        if state["version"] < schemas.VERSION:
            if state["tables"]:
                self._write(state, f".v{state['version']}.bak")
            self._write(state | {"version": schemas.VERSION})

    def _versions(self) -> list[str]:
        """Names of the state files, the newest first."""
        top = self._path(self.root)
        if not self._fs.exists(top):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(top)]
        return sorted((n for n in names if re.fullmatch(r"catalog-[0-9]{12}\.json", n)), reverse=True)

    def _read(self) -> dict:
        names = self._versions()
        if not names:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/{names[0]}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _write(self, state: dict, suffix: str = "") -> None:
        """A new state file under the next number: written whole under another name, then renamed, so a writer that dies
        leaves the state before it. The last few are kept."""
        names = self._versions()
        after = int(names[0][8:20]) + 1 if names else 1
        new = self._path(f"{self.root}/.state-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        to = self._path(f"{self.root}/catalog.json{suffix}" if suffix else f"{self.root}/catalog-{after:012d}.json")
        if not self._fs.rename(new, to):
            self._fs.delete(new, False)
            if not suffix:
                raise RuntimeError("another writer has changed the catalog")
        for old in names[8:]:
            self._fs.delete(self._path(f"{self.root}/{old}"), False)

    def table(self, name: str) -> DataFrame:
        at = self._read()["tables"].get(name)
        ddl = schemas.schema(name)
        return self.spark.createDataFrame([], ddl) if at is None else self.spark.read.schema(ddl).parquet(f"{self.root}/{at}")

    def replace(self, **tables: DataFrame) -> None:
        """New snapshots of one or more tables, which become current together."""
        state = self._read()
        for name, df in tables.items():
            at = f"{name}/{int(state['tables'].get(name, '/0').rsplit('/', 1)[1]) + 1}"
            want = self.spark.createDataFrame([], schemas.schema(name)).schema
            df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want)).write.mode("overwrite").parquet(f"{self.root}/{at}")
            state["tables"][name] = at
        self._write(state)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.replace(**{name: upsert(self.table(name), rows, list(schemas.KEYS[name]))})

    def views(self) -> None:
        """Temporary views of all tables for spark.sql."""
        for name in schemas.tables():
            self.table(name).createOrReplaceTempView(name)


def score_library(frames: DataFrame, preset: str = "Balanced", gap: int = 1800, keep: float = 70.0, reject: float = 35.0) -> DataFrame:
    """Measured frames to composites and bands."""
    return scoring.score(scoring.normalise(frames, gap, scoring.SCORED, library_for_all=False), scoring.preset(preset), keep, reject)


def rescore(catalog: Catalog, version: str, now: int, preset: str = "Balanced") -> None:
    """Scores all measurements of a version and stores the rows."""
    m = catalog.table("measurement").where(F.col("scorer_version") == version)
    photos = catalog.table("photo").where("trashed_at is null").select(F.col("id").alias("photo_id"), "dir")
    scored = score_library(m.join(photos, "photo_id").select("photo_id", "dir", "camera", "captured_at", *(f"m{i}" for i in range(8))), preset)
    old = catalog.table("score").where(F.col("scorer_version") != version)
    catalog.replace(score=old.unionByName(scoring.score_rows(scored, version, now)))


def register(spark: SparkSession) -> None:
    """Functions under SQL names."""
    from pyspark.sql.functions import udtf

    from fotolith.functions import imaging, paths
    from fotolith.sources.files import previews

    spark.udf.register("normalise_nfc", paths._nfc)
    spark.udf.register("measure_raster", imaging.measured)

    @udtf(returnType="start: long, stop: long, width: int, height: int")
    class PreviewSpans:
        def eval(self, content: bytes):
            yield from previews(content)

    spark.udtf.register("preview_spans", PreviewSpans)
