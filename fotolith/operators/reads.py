"""What a caller asks of a catalog: one photograph, one kind of file, capture times, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.functions.media import detail_camera
from fotolith.operators.scoring import reference

# The wording of explanations.
UNSCORED, UNMEASURED, NO_TERMS = "not scored", "Not scored — this file produced no measurement.", "No per-term breakdown was recorded for this photograph."
PERCENTILE, OF_SHOOT = "th percentile", "th percentile of this shoot"
_FILE = ("id", "path", "role", "size_bytes", "mtime_ns", "content_hash")


def capture_times(photos: DataFrame, files: DataFrame, exif: DataFrame) -> DataFrame:
    """(photo_id, camera, captured_at) from the raw files' metadata, in time order; model, else make, else empty."""
    raws = files.select(F.col("id").alias("file_id"), "photo_id", "role")
    on = (raws["photo_id"] == photos["id"]) & (raws["role"] == "raw")
    rows = photos.select("id").join(raws, on).join(exif.where("captured_at is not null"), "file_id")
    return rows.select("photo_id", F.coalesce("model", "make", F.lit("")).alias("camera"), "captured_at").orderBy("captured_at", "photo_id")


def library_at(libraries: DataFrame, root: str) -> DataFrame:
    return libraries.where(F.col("root") == root)


def files_for_photo(files: DataFrame, photo_id: int) -> DataFrame:
    """A photograph's files by role, then path."""
    return files.where(F.col("photo_id") == photo_id).select(*_FILE).orderBy("role", "path")


def files_by_role(files: DataFrame, role: str) -> DataFrame:
    return files.where(F.col("role") == role).select(*_FILE).orderBy("path")


def needing_review(photos: DataFrame) -> DataFrame:
    """Photographs to look at, those in the trash too."""
    return photos.where("needs_review").select("id", "dir", "stem", "state").orderBy("dir", "stem")


def review_reasons(reasons: DataFrame, photo_id: int) -> DataFrame:
    return reasons.where(F.col("photo_id") == photo_id).select("reason").orderBy("reason")


def content_hash_for_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("content_hash")


def set_content_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """The files with the given hashes (id, content_hash)."""
    new = hashes.groupBy("id").agg(F.min("content_hash").alias("__h"))
    return files.join(new, "id", "left").withColumn("content_hash", F.coalesce("__h", "content_hash")).select(files.columns)


def tags_for_photo(tags: DataFrame, photo_id: int) -> DataFrame:
    """A photograph's tags, the surest first."""
    return tags.where(F.col("photo_id") == photo_id).select("name", "confidence", "model").orderBy(F.desc("confidence"), "name")


def photos_with_tag(tags: DataFrame, photos: DataFrame, name: str) -> DataFrame:
    found = tags.where(F.col("name") == name).select(F.col("photo_id").alias("id"))
    return photos.where("trashed_at is null").join(found, "id", "left_semi").select("id").orderBy("id")


def scored_count(scores: DataFrame, photos: DataFrame) -> DataFrame:
    """n: visible photographs with a composite of any version."""
    visible = photos.where("trashed_at is null").select(F.col("id").alias("photo_id"))
    return scores.where("metric = 'composite'").join(visible, "photo_id", "left_semi").agg(F.count_distinct("photo_id").alias("n"))


def delete_at_version(rows: DataFrame, version: str) -> DataFrame:
    """Scores or measurements without those of a version."""
    return rows.where(F.col("scorer_version") != version)


def band_name(number: Column) -> Column:
    """The name of a stored band."""
    whole = number.cast("int")
    return F.when(whole == 2, "keep").when(whole == 1, "review").when(whole.isNotNull(), "reject")


def _measures(scores: DataFrame, version: str) -> DataFrame:
    """(photo_id, composite, band, shoot_size, shoot_relative, terms): a row a photograph; terms by name."""
    one = {c: F.max(F.when(F.col("metric") == c, F.col("value"))).alias(c) for c in ("composite", "band", "shoot_size", "shoot_relative")}
    term = F.when(F.startswith("metric", F.lit("term:")), F.struct(F.regexp_replace(F.substring("metric", 6, 1000), "_", " ").alias("label"), F.col("value").alias("percentile")))
    return scores.where(F.col("scorer_version") == version).groupBy("photo_id").agg(*one.values(), F.array_sort(F.collect_list(term)).alias("terms"))


def photo_details(photos: DataFrame, files: DataFrame, exif: DataFrame, scores: DataFrame, decisions: DataFrame, version: str) -> DataFrame:
    """One row a photograph: its files, the metadata of its first raw (else of any file that has some), its scores of a
    version and its decision. Narrow ``photos`` first for a point read; the rest is pruned by the joins."""
    ids = photos.select(F.col("id").alias("photo_id"), "stem", "dir", "state", "needs_review")
    own = files.join(ids.select("photo_id"), "photo_id", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("role", "path", "size_bytes"))), lambda f: F.struct(F.element_at(F.split(f["path"], "/"), -1).alias("name"), f["path"].alias("path"), f["role"].alias("role"), f["size_bytes"].alias("size_bytes")))
    by_photo = own.groupBy("photo_id").agg(listed.alias("files"))
    taken = ["make", "model", "lens", "iso", "f_number", "exposure_time", "focal_length", "captured_at"]
    meta = own.select("photo_id", "role", F.col("id").alias("file_id")).join(exif, "file_id").groupBy("photo_id")
    meta = meta.agg(F.min_by(F.struct(*taken), F.struct(F.when(F.col("role") == "raw", 0).otherwise(1), "file_id")).alias("x")).select("photo_id", "x.*")
    meta = meta.withColumn("camera", detail_camera(F.col("make"), F.col("model"))).drop("make", "model")
    measures = _measures(scores, version).select("photo_id", "composite", band_name(F.col("band")).alias("band"), "terms")
    rows = ids
    for other in (by_photo, meta, measures, decisions.select("photo_id", "rating", "rejected")):
        rows = rows.join(other, "photo_id", "left")
    return rows.withColumns({"files": F.coalesce("files", F.array().cast(by_photo.schema["files"].dataType)), "terms": F.coalesce("terms", F.array().cast(measures.schema["terms"].dataType)), "rating": F.coalesce("rating", F.lit(0)), "rejected": F.coalesce("rejected", F.lit(False))})


def explained(photos: DataFrame, scores: DataFrame, version: str, most: int = 4) -> DataFrame:
    """(photo_id, lines) from stored scores: a head with the rank's reference, then up to ``most`` terms by name."""
    size = F.coalesce("shoot_size", F.lit(0.0)).cast("long").cast("string")
    band = F.initcap(F.coalesce(band_name(F.col("band")), F.lit("review")))
    head = F.concat(band, F.lit(" — "), F.format_string("%.0f", F.bround(F.coalesce("composite", F.lit(0.0)), 0)), F.lit("/100 (ranked "), reference(F.coalesce("shoot_relative", F.lit(0.0)) > 0.5, size), F.lit(")"))
    each = F.transform(F.slice("terms", 1, most), lambda t: F.concat(F.lit("  "), t["label"], F.lit(": "), F.round(t["percentile"]).cast("long").cast("string"), F.lit(PERCENTILE)))
    rows = photos.select(F.col("id").alias("photo_id")).join(_measures(scores, version), "photo_id", "left")
    return rows.select("photo_id", F.when(F.col("terms").isNull(), F.array(F.lit(UNSCORED))).otherwise(F.concat(F.array(head), each)).alias("lines"))


def explained_native(details: DataFrame) -> DataFrame:
    """(photo_id, lines) in the short form, from ``photo_details``."""
    head = F.when(F.col("composite").isNull(), UNMEASURED).otherwise(F.concat(F.format_string("%.0f", F.bround("composite", 0)), F.lit("/100"), F.coalesce(F.concat(F.lit(" — "), F.col("band")), F.lit(""))))
    each = F.transform("terms", lambda t: F.concat(t["label"], F.lit(": "), F.format_string("%.0f", F.bround(t["percentile"], 0)), F.lit(OF_SHOOT)))
    none = F.when((F.size("terms") == 0) & F.col("composite").isNotNull(), F.array(F.lit(NO_TERMS))).otherwise(F.array().cast("array<string>"))
    return details.select("photo_id", F.concat(F.array(head), each, none).alias("lines"))


def totals(photos: DataFrame, people: DataFrame, tags: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: photographs, folders, groups of faces and named ones, tags in use, scored photographs."""
    visible = photos.where("trashed_at is null")
    named = tags.join(visible.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").agg(F.count_distinct("name").alias("tags"))
    p = visible.agg(F.count("*").alias("photos"), F.count_distinct("dir").alias("folders"))
    g = people.agg(F.count("*").alias("groups"), F.count("name").alias("named"))
    return p.crossJoin(g).crossJoin(named).crossJoin(scored_count(scores, photos).withColumnRenamed("n", "scored"))  # four single rows


def selection_totals(selection: DataFrame) -> DataFrame:
    """files, bytes, incomplete and missing of a selection to delete (see ``tables.delete_selection``)."""
    return selection.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if("incomplete").alias("incomplete"), F.count_if("missing").alias("missing"))
