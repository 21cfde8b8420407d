"""One index pass as new snapshots of the catalog's tables: what upserts, sweeps and cascades would do in a transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.operators.decisions import adopt
from fotolith.operators.numbering import numbered
from fotolith.operators.resolve import files_of
from fotolith.operators.tables import reconcile_files

#: Tables that lose the rows of photographs or files that went.
OF_PHOTO, OF_FILE, OF_FACE = ("photo_review", "score", "measurement", "decision", "tag", "photo_caption"), ("exif", "face"), ("face_embedding", "person_face")


def upsert_library(libraries: DataFrame, root: str, now: int) -> DataFrame:
    """The libraries with one for the root, unless it is there."""
    new = libraries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.count_if(F.col("root") == root).alias("have")).where("have = 0")
    row = new.select((F.col("last") + 1).alias("id"), F.lit(root).alias("root"), F.lit(now).cast("long").alias("created_at"), F.lit(None).cast("long").alias("last_indexed_at"))
    return libraries.select("id", "root", "created_at", "last_indexed_at").unionByName(row)


def index_groups(tables: dict[str, DataFrame], groups: DataFrame, meta: DataFrame, library_id: int, now: int, checkpoint: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(changed tables, one row of counts) after groups (``resolve.group_files``) with file metadata (path, size_bytes,
    mtime_ns) were found in a library.

    Photographs are known by folder and stem; one that is found leaves the trash. Review reasons are replaced. Files
    without metadata are left out, a changed file loses its hash, files not found go. Photographs without files go
    unless they are in the trash, with all that hangs on them; a decision of one that goes is adopted by a photograph
    with a file of the same size and time.
    """
    others = {n: t.where(F.col("library_id") != library_id) for n, t in tables.items() if n in ("photo", "file")}
    own = {n: t.where(F.col("library_id") == library_id) for n, t in tables.items() if n in ("photo", "file")}
    groups = checkpoint(groups)
    key = ["dir", "stem"]
    last = tables["photo"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    fresh = numbered(groups.select(*key).join(own["photo"].select(*key), key, "left_anti"), key, checkpoint).crossJoin(F.broadcast(last))  # one row
    known = groups.join(own["photo"].select(*key, F.col("id").alias("__id")), key, "left").join(fresh.select(*key, (F.col("__last") + F.col("n")).alias("__new")), key, "left")
    found = known.select(F.coalesce("__id", "__new").alias("id"), F.lit(library_id).cast("long").alias("library_id"), *key, "state", "needs_review", F.lit(None).cast("long").alias("trashed_at"), "review")
    found = checkpoint(found)
    photo = own["photo"].join(found.select("id"), "id", "left_anti").select(*(c for c in found.columns if c != "review")).unionByName(found.drop("review"))

    paths = files_of(groups).join(found.select("id", *key), key).select(F.col("id").alias("photo_id"), "role", "path").join(meta.select("path", "size_bytes", "mtime_ns"), "path")
    numbers = tables["file"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    files = checkpoint(reconcile_files(own["file"], paths, now, checkpoint, after=numbers).withColumn("library_id", F.lit(library_id).cast("long")))

    gone = photo.where("trashed_at is null").select("id").join(files.select(F.col("photo_id").alias("id")), "id", "left_anti")
    gone = checkpoint(gone.withColumnRenamed("id", "photo_id"))
    photo = photo.join(gone.select(F.col("photo_id").alias("id")), "id", "left_anti")
    gone_files = checkpoint(own["file"].select("id").join(files.select("id"), "id", "left_anti").withColumnRenamed("id", "file_id"))

    new = {"photo": photo.unionByName(others["photo"].select(photo.columns)), "file": files.unionByName(others["file"].select(files.columns))}
    for name in OF_PHOTO:
        if name in tables:
            new[name] = tables[name].join(gone, "photo_id", "left_anti").select(tables[name].columns)
    if "photo_review" in new:
        reasons = found.select(F.col("id").alias("photo_id"), F.explode(F.array_distinct("review")).alias("reason"))
        new["photo_review"] = new["photo_review"].join(found.select(F.col("id").alias("photo_id")), "photo_id", "left_anti").unionByName(reasons)
    for name in OF_FILE:
        if name in tables:
            new[name] = tables[name].join(gone_files, "file_id", "left_anti").select(tables[name].columns)
    if "face" in tables:
        lost = tables["face"].join(gone_files, "file_id", "left_semi").select(F.col("id").alias("face_id"))
        for name in OF_FACE:
            if name in tables:
                new[name] = tables[name].join(lost, "face_id", "left_anti").select(tables[name].columns)

    adopted = None
    if "decision" in tables:
        doomed = checkpoint(tables["decision"].join(gone, "photo_id", "left_semi").where("source_size is not null and source_mtime is not null"))
        undecided = photo.where("trashed_at is null").select(F.col("id").alias("photo_id")).join(new["decision"].select("photo_id"), "photo_id", "left_anti")
        heirs = files.join(undecided, "photo_id", "left_semi").select("photo_id", "role", "size_bytes", "mtime_ns")
        adopted = checkpoint(adopt(doomed, heirs, checkpoint))
        moved = adopted.join(doomed, "photo_id").select(F.col("heir_id").alias("photo_id"), "rating", "rejected", F.lit(now).cast("long").alias("decided_at"), "source_size", "source_mtime")
        new["decision"] = new["decision"].unionByName(moved)
    if "library" in tables:
        stamp = F.when(F.col("id") == library_id, F.lit(now).cast("long")).otherwise(F.col("last_indexed_at"))
        new["library"] = tables["library"].withColumn("last_indexed_at", stamp)

    state = found.agg(F.count("*").alias("photos"), F.count_if(F.col("state") == "pair").alias("pairs"), F.count_if(F.col("state") == "ambiguous").alias("ambiguous"), F.count_if("needs_review").alias("needs_review"))
    parts = [files.agg(F.count("*").alias("files")), gone_files.agg(F.count("*").alias("removed_files")), gone.agg(F.count("*").alias("removed_photos"))]
    parts += [adopted.agg(F.count("*").alias("adopted_decisions"))] if adopted is not None else []
    for p in parts:
        state = state.crossJoin(p)  # single rows
    return new, state


def report(photos: DataFrame, files: DataFrame, scored: DataFrame, shoots: DataFrame, reused: DataFrame) -> DataFrame:
    """The counters that ``tables.inconsistencies`` checks, from tables: visible photographs, files, scored ones (photo_id,
    band), shoots (shoot_id) and reused measurements (photo_id)."""
    visible = photos.where("trashed_at is null")
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("pair", "raw_only", "raster_only", "ambiguous")]
    p = visible.agg(F.count("*").alias("photos"), *states, F.count_if(F.col("state") == "pair").alias("pairs"), F.count_if("needs_review").alias("needs_review"))
    ids = visible.select(F.col("id").alias("photo_id"))
    s = scored.join(ids, "photo_id", "left_semi").agg(F.count("*").alias("scored"), *(F.count_if(F.col("band") == b).alias(b) for b in ("keep", "review", "reject")))
    f = files.join(ids, "photo_id", "left_semi").agg(F.count("*").alias("scanned_files"))
    r = reused.join(ids, "photo_id", "left_semi").agg(F.count_distinct("photo_id").alias("reused"))
    out = p.crossJoin(s).crossJoin(f).crossJoin(shoots.agg(F.count_distinct("shoot_id").alias("shoots"))).crossJoin(r)  # single rows
    return out.withColumn("unscoreable", F.col("photos") - F.col("scored"))
