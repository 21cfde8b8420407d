"""A library on disk, from a scan to scores: the passes in their order over one catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.functions import imaging
from fotolith.functions.media import camera_name, exif_time
from fotolith.operators import indexing, passes, reads, tables
from fotolith.operators.resolve import group_files
from fotolith.operators.sessions import shoots
from fotolith.plans.catalog import Catalog, rescore
from fotolith.plans.checkpoint import cutter
from fotolith.sources import files as sources

SCORER, READER = "composite-1", 1


def gray(content: bytes) -> np.ndarray | None:
    """The decoder that is there without further libraries."""
    found = sources.decode_gray(content)
    return None if found is None else np.frombuffer(found[2], np.uint8).reshape(found[1], found[0])


class Library:
    """One library of a catalog. ``decode`` turns a file's bytes into luma, or None."""

    def __init__(self, catalog: Catalog, root: str, decode: Callable[[bytes], np.ndarray | None] = gray, preset: str = "Balanced"):
        self.catalog, self.root, self.decode, self.preset = catalog, root.rstrip("/"), decode, preset
        self.spark, self.checkpoint = catalog.spark, cutter(catalog.spark)

    def _id(self, now: int) -> int:
        self.catalog.replace(library=indexing.upsert_library(self.catalog.table("library"), self.root, now))
        return self.catalog.table("library").where(F.col("root") == self.root).first()["id"]

    def _contents(self, paths: DataFrame) -> DataFrame:
        """(path, content) of the given paths, read by the executors."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for p in batch["path"]:
                    try:
                        with open(p, "rb") as f:
                            yield pd.DataFrame({"path": [p], "content": [f.read()]})
                    except OSError:
                        yield pd.DataFrame({"path": [p], "content": [None]})

        return paths.select("path").mapInPandas(run, "path string, content binary")

    def index(self, now: int, mode: str = "incremental") -> dict:
        """Scans, reconciles, reads metadata, measures what is new (all of it in mode ``full``), scores, and returns counts
        and broken invariants."""
        if mode not in ("incremental", "full"):
            raise ValueError(mode)
        c, cut = self.catalog, self.checkpoint
        library = self._id(now)
        found, empty, unreadable = sources.walk(self.spark, self.root, cut)
        current = {n: c.table(n) for n in ("library", "photo", "file", *indexing.OF_PHOTO, *indexing.OF_FILE, *indexing.OF_FACE)}
        new, stats = indexing.index_groups(current, group_files(found.select("path")), found, library, now, cut)
        counts = stats.first().asDict()
        c.replace(**new)
        if mode == "full":
            c.replace(measurement=reads.delete_at_version(c.table("measurement"), SCORER))
        self._read_metadata(now)
        reused = cut(tables.reusable(c.table("measurement").where(F.col("scorer_version") == SCORER), c.table("file")).select("photo_id").distinct())
        self._measure(reused, now)
        rescore(c, SCORER, now, self.preset)
        counts |= {"empty": empty.count(), "unreadable": unreadable.count(), "reused": reused.count()}
        return counts | {"problems": [r[0] for r in tables.inconsistencies(self.report(reused)).collect()]}

    def _read_metadata(self, now: int) -> None:
        c = self.catalog
        due = tables.stale_exif(c.table("file"), c.table("exif"), READER).select(F.col("id").alias("file_id"), "path", "mtime_ns")
        rows = sources.read_exif(self._contents(due)).where("status != 'unreadable'").join(due, "path")
        made = rows.select(
            "file_id", F.col("mtime_ns").alias("source_mtime_ns"), exif_time(F.col("taken")).alias("captured_at"), "make", "model", "lens", F.col("iso").cast("int").alias("iso"),
            "f_number", "exposure_time", "focal_length", F.col("orientation").cast("int").alias("orientation"), F.lit(now).cast("long").alias("read_at"), F.lit(READER).alias("reader_version"),
        )
        c.upsert("exif", self.checkpoint(made))

    def _measure(self, reused: DataFrame, now: int) -> None:
        """Renderings are measured before raws, as their pixels are what is seen."""
        c, decode = self.catalog, self.decode
        photos = c.table("photo").where("trashed_at is null").select(F.col("id").alias("photo_id")).join(reused, "photo_id", "left_anti")
        files = c.table("file").where("role in ('raw', 'raster')").join(photos, "photo_id", "left_semi")
        first = files.groupBy("photo_id").agg(F.min_by(F.struct("path", "size_bytes", "mtime_ns", "id"), F.struct("role", "path")).alias("x")).select("photo_id", "x.*")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for p, content in zip(batch["path"], batch["content"], strict=True):
                    picture = decode(bytes(content)) if content is not None else None
                    if picture is not None:
                        out.append((p, *map(float, imaging.measure(picture)[:8])))
                yield pd.DataFrame(out, columns=["path", *(f"m{i}" for i in range(8))])

        measured = self._contents(first).mapInPandas(run, "path string, " + ", ".join(f"m{i} double" for i in range(8)))
        meta = c.table("file").select("photo_id", "role", F.col("id").alias("file_id")).join(c.table("exif"), "file_id")
        meta = meta.groupBy("photo_id").agg(F.min_by(F.struct("make", "model", "captured_at"), F.struct(F.when(F.col("role") == "raw", 0).otherwise(1), "file_id")).alias("x"))
        rows = measured.join(first, "path").join(meta, "photo_id", "left")
        made = rows.select(
            "photo_id", F.lit(SCORER).alias("scorer_version"), F.col("path").alias("measured_path"), F.col("size_bytes").alias("measured_size"), F.col("mtime_ns").alias("measured_mtime"),
            camera_name(F.col("x.make"), F.col("x.model")).alias("camera"), F.col("x.captured_at").alias("captured_at"), *(f"m{i}" for i in range(8)), F.lit(now).cast("long").alias("measured_at"),
        )
        c.upsert("measurement", self.checkpoint(made))

    def report(self, reused: DataFrame) -> DataFrame:
        c = self.catalog
        composite = c.table("score").where((F.col("metric") == "band") & (F.col("scorer_version") == SCORER))
        scored = composite.select("photo_id", reads.band_name(F.col("value")).alias("band"))
        m = c.table("measurement").where(F.col("scorer_version") == SCORER)
        frames = m.join(c.table("photo").where("trashed_at is null").select(F.col("id").alias("photo_id"), "dir"), "photo_id")
        return indexing.report(c.table("photo"), c.table("file"), scored, shoots(frames.select("photo_id", "dir", "camera", "captured_at")), reused)

    def totals(self) -> DataFrame:
        c = self.catalog
        return reads.totals(c.table("photo"), c.table("person"), c.table("tag"), c.table("score"))

    def detail(self, photo_id: int) -> DataFrame:
        c = self.catalog
        return reads.photo_details(c.table("photo").where(F.col("id") == photo_id), c.table("file"), c.table("exif"), c.table("score"), c.table("decision"), SCORER)

    def faces(self, detector: passes.Detector, embedder: passes.Embedder, now: int) -> dict:
        return passes.face_pass(self.catalog, self._contents(self.catalog.table("file").where("role in ('raw', 'raster')")), self.decode, detector, embedder, now, self.checkpoint)

    def clip(self, embedder: passes.Embedder, vocabulary: DataFrame, now: int, keep: int = 5, least: float = 0.2) -> dict:
        return passes.clip_pass(self.catalog, self._contents(self.catalog.table("file").where("role in ('raw', 'raster')")), self.decode, embedder, vocabulary, now, self.checkpoint, keep, least)

    def tags(self, client: Callable[[bytes], dict], model: str, now: int, limit: int = 200) -> dict:
        return passes.tag_pass(self.catalog, self._contents(self.catalog.table("file").where("role in ('raw', 'raster')")), client, model, limit, now, self.checkpoint)

    def write_sidecars(self) -> DataFrame:
        """Writes decisions beside their files; (status, n, first_path)."""
        c = self.catalog
        rows = c.table("file").where("role in ('raw', 'raster')").groupBy("photo_id").agg(F.min_by("path", F.struct("role", "path")).alias("path"))
        return sources.write_sidecars(sources.sidecar_plan(c.table("photo"), c.table("decision").select("photo_id", "rating", "rejected"), rows), c.table("decision"))
