"""Changes to catalog tables as new snapshots, and the work lists derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolith.functions.media import tag_name
from fotolith.operators.numbering import numbered


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key, the rest stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(old.columns))


def sweep(catalog: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """What the catalog has and the scan didn't see."""
    return catalog.join(seen.select(*keys).distinct(), keys, "left_anti")


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: appeared, vanished or kept."""
    a, b = before.select(*keys).distinct().withColumn("__a", F.lit(1)), after.select(*keys).distinct().withColumn("__b", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("__a").isNull(), "appeared").when(F.col("__b").isNull(), "vanished").otherwise("kept").alias("change"))


def reconcile_files(old: DataFrame, scanned: DataFrame, now: int, checkpoint: Callable[[DataFrame], DataFrame], after: int | None = None) -> DataFrame:
    """The file table after a scan (path, photo_id, role, size_bytes, mtime_ns): ids stay by path, new files get ids
    after the last (or after ``after``) in the order of paths; the hash is kept only while size and time are the same;
    unseen files go."""
    o = old.select("path", F.col("id").alias("__id"), F.col("size_bytes").alias("__s"), F.col("mtime_ns").alias("__m"), F.col("content_hash").alias("__h"))
    last = old.agg((F.coalesce(F.max("id"), F.lit(0)) if after is None else F.lit(after)).alias("__last"))
    rows = scanned.join(o, "path", "left")
    new = numbered(rows.where("__id is null").select("path"), ["path"], checkpoint, "__new")
    same = (F.col("__s") == F.col("size_bytes")) & (F.col("__m") == F.col("mtime_ns"))
    rows = rows.join(new, "path", "left").crossJoin(F.broadcast(last))  # one row
    return rows.select(F.coalesce("__id", F.col("__last") + F.col("__new")).alias("id"), "photo_id", "path", "role", "size_bytes", "mtime_ns", F.when(same, F.col("__h")).alias("content_hash"), F.lit(now).cast("long").alias("indexed_at"))


def stale_exif(files: DataFrame, exif: DataFrame, reader: int) -> DataFrame:
    """Visible raws and renderings without metadata, or with metadata of another file version or an older reader."""
    e = exif.select(F.col("file_id").alias("id"), "source_mtime_ns", "reader_version")
    fresh = F.coalesce((F.col("source_mtime_ns") == F.col("mtime_ns")) & (F.col("reader_version") == reader), F.lit(False))
    return files.where("role in ('raw', 'raster')").join(e, "id", "left").where(~fresh).select(files.columns)


def files_needing_faces(files: DataFrame, faces: DataFrame, detector: str) -> DataFrame:
    done = faces.where(F.col("detector") == detector).select(F.col("file_id").alias("id"), F.col("detected_size").alias("size_bytes"), F.col("detected_mtime").alias("mtime_ns")).distinct()
    return files.where("role in ('raw', 'raster')").join(done, ["id", "size_bytes", "mtime_ns"], "left_anti").select(files.columns)


def photos_needing_tags(photos: DataFrame, captions: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    out = photos.where("trashed_at is null").join(captions.where(F.col("model") == model).select(F.col("photo_id").alias("id")).distinct(), "id", "left_anti")
    return out.orderBy("id").limit(max(1, limit)) if limit is not None else out


def reusable(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Measurements of which any current file of the photograph is the measured version."""
    f = files.select("photo_id", F.col("path").alias("measured_path"), F.col("size_bytes").alias("measured_size"), F.col("mtime_ns").alias("measured_mtime"))
    return stored.join(f, ["photo_id", "measured_path", "measured_size", "measured_mtime"], "left_semi").select(stored.columns)


def set_trashed(photos: DataFrame, ids: DataFrame, at: int | None) -> DataFrame:
    hit = ids.select(F.col("photo_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    return photos.join(hit, "id", "left").withColumn("trashed_at", F.when(F.col("__hit"), F.lit(at).cast("long")).otherwise(F.col("trashed_at"))).select(photos.columns)


def clear_trashed_for_paths(photos: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """Photographs with a file among the paths (path) leave the trash."""
    return set_trashed(photos, files.join(paths.select("path"), "path", "left_semi").where("photo_id is not null"), None)


# people -----------------------------------------------------------------------------------------------------------


def people_counts(people: DataFrame, memberships: DataFrame, faces: DataFrame, files: DataFrame) -> DataFrame:
    """person_id, faces and distinct photographs of every person, those without faces too."""
    f = memberships.join(faces.select(F.col("id").alias("face_id"), "file_id"), "face_id").join(files.select(F.col("id").alias("file_id"), "photo_id"), "file_id", "left")
    rows = people.select(F.col("id").alias("person_id")).join(f, "person_id", "left")
    return rows.groupBy("person_id").agg(F.count("face_id").alias("faces"), F.count_distinct("photo_id").alias("photos"))


def merge_people(memberships: DataFrame, source: int, into: int) -> tuple[DataFrame, DataFrame]:
    """(new memberships, faces moved): faces of one person join another's; merging a person with itself does nothing."""
    if source == into:
        return memberships, memberships.where("false").select("face_id")
    have = memberships.where(F.col("person_id") == into).select("face_id")
    moved = memberships.where(F.col("person_id") == source).select("face_id").distinct().join(have, "face_id", "left_anti")
    return memberships.where(F.col("person_id") != source).unionByName(moved.select(F.lit(into).cast("long").alias("person_id"), "face_id")), moved


def split_person(people: DataFrame, memberships: DataFrame, person: int, chosen: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(people, memberships): chosen faces become a new person, and both are confirmed. Nothing changes if none or all of
    the person's faces are chosen."""
    mine = F.col("person_id") == person
    picked = chosen.select(F.col("face_id").alias("face_id")).distinct().withColumn("__hit", F.lit(True))
    rows = memberships.join(picked, "face_id", "left").withColumn("__goes", mine & F.coalesce("__hit", F.lit(False)))
    ids = people.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("__new"))
    # one row: whether the split is allowed, and the new id
    allowed = rows.agg(((F.count_if("__goes") > 0) & (F.count_if("__goes") < F.count_if(mine))).alias("__ok")).crossJoin(ids)
    rows = rows.crossJoin(F.broadcast(allowed))
    moved = rows.select(F.when(F.col("__ok") & F.col("__goes"), F.col("__new")).otherwise(F.col("person_id")).alias("person_id"), "face_id")
    both = people.crossJoin(F.broadcast(allowed))
    hit = F.col("__ok") & (F.col("id") == person)
    columns = people.columns
    kept = both.withColumns({"confirmed": F.col("confirmed") | hit, "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).select(columns)
    new = both.where(hit).select(F.col("__new").alias("id"), *(F.lit(None).cast("string").alias(c) if c == "name" else F.lit(True).alias(c) if c == "confirmed" else F.lit(now).cast("long").alias(c) if c in ("created_at", "updated_at") else F.col(c) for c in columns if c != "id"))
    return kept.unionByName(new.select(columns)), moved


def replace_people(people: DataFrame, memberships: DataFrame, clusters: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(people, memberships) after clustering (id, cluster, size): unconfirmed groups go; each cluster is a new person,
    largest first, without faces that confirmed people have."""
    keep = people.where("confirmed")
    kept = memberships.join(keep.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    names = clusters.select("cluster", "size").distinct()
    last = people.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    numbers = numbered(names, [F.desc("size"), F.asc("cluster")], checkpoint, "__k").crossJoin(F.broadcast(last))  # one row
    numbers = numbers.select("cluster", (F.col("__last") + F.col("__k")).alias("person_id"))
    faces = clusters.join(numbers, "cluster").select("person_id", F.col("id").alias("face_id")).join(kept.select("face_id"), "face_id", "left_anti")
    new = numbers.select(F.col("person_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("confirmed"))
    return keep.select("id", "name", "confirmed").unionByName(new), kept.select("person_id", "face_id").unionByName(faces.select("person_id", "face_id"))


# tags -------------------------------------------------------------------------------------------------------------


def dedupe_tags(tags: DataFrame) -> DataFrame:
    """photo_id, name, confidence: one row a name, the highest confidence."""
    return tags.withColumn("name", tag_name(F.col("name"))).where("name is not null").groupBy("photo_id", "name").agg(F.max("confidence").alias("confidence"))


def replace_tags(old: DataFrame, new: DataFrame, photos: DataFrame, model: str) -> DataFrame:
    """The tag table in which the model's tags of the given photographs are the new ones."""
    gone = photos.select("photo_id").distinct().withColumn("model", F.lit(model))
    fresh = dedupe_tags(new.join(photos.select("photo_id").distinct(), "photo_id", "left_semi")).withColumn("model", F.lit(model))
    return old.join(gone, ["photo_id", "model"], "left_anti").select("photo_id", "name", "confidence", "model").unionByName(fresh.select("photo_id", "name", "confidence", "model"))


def tag_counts(tags: DataFrame, photos: DataFrame, model: str | None = None) -> DataFrame:
    """name and number of distinct visible photographs."""
    rows = tags if model is None else tags.where(F.col("model") == model)
    visible = photos.where("trashed_at is null").select(F.col("id").alias("photo_id"))
    return rows.join(visible, "photo_id", "left_semi").groupBy("name").agg(F.count_distinct("photo_id").alias("n"))


# trash ------------------------------------------------------------------------------------------------------------


def operations(manifest: DataFrame) -> DataFrame:
    """op_id, at, files, bytes and purged of every move in the log (op_id, at, action, files), newest first."""
    purged = manifest.where("action = 'purge' or op_id like '%-purged'").select(F.regexp_replace("op_id", "-purged$", "").alias("op_id")).distinct().withColumn("__p", F.lit(True))
    sizes = F.aggregate(F.coalesce("files", F.array().cast(manifest.schema["files"].dataType)), F.lit(0).cast("long"), lambda s, f: s + F.greatest(f["size"], F.lit(0)))
    rows = manifest.where("action != 'purge' and op_id not like '%-purged'").select("op_id", "at", "reason", F.size("files").cast("long").alias("files"), sizes.alias("bytes"))
    return rows.join(purged, "op_id", "left").select("op_id", "at", "reason", "files", "bytes", F.coalesce("__p", F.lit(False)).alias("purged")).orderBy(F.desc("at"), "op_id")


def destinations(moves: DataFrame) -> DataFrame:
    """Moves (source, destination) with a free name each: the second of a name is ``stem~2.ext``, and so on."""
    k = F.row_number().over(Window.partitionBy("destination").orderBy("source"))
    name = F.regexp_replace("destination", r"(\.[^./]*)?$", "")
    ext = F.regexp_extract("destination", r"[^/.](\.[^./]*)$", 1)
    return moves.withColumn("__k", k).withColumn("destination", F.when(F.col("__k") == 1, F.col("destination")).otherwise(F.concat(F.regexp_replace("destination", r"\.[^./]*$", ""), F.lit("~"), F.col("__k").cast("string"), ext))).drop("__k")


def delete_selection(ids: DataFrame, photos: DataFrame, files: DataFrame) -> DataFrame:
    """(photo_id, stem, files, bytes, incomplete, missing) of a selection, by stem and id."""
    own = files.groupBy("photo_id").agg(F.count("*").alias("files"), F.sum(F.greatest("size_bytes", F.lit(0))).alias("bytes"))
    rows = ids.select("photo_id").distinct().join(photos.select(F.col("id").alias("photo_id"), "stem", "state"), "photo_id", "left").join(own, "photo_id", "left")
    return rows.select("photo_id", "stem", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce(F.col("state").isin("raw_only", "raster_only"), F.lit(False)).alias("incomplete"), F.col("files").isNull().alias("missing")).orderBy("stem", "photo_id")


def changed_since_plan(plan: DataFrame, now: DataFrame, now_s: int, planned_s: int, ttl: int = 3600) -> DataFrame:
    """(path, problem) of reasons not to delete: expired, appeared, vanished or changed (path, content_hash)."""
    if now_s - planned_s > ttl:
        return plan.select("path", F.lit("expired").alias("problem"))
    both = plan.select("path", F.col("content_hash").alias("__a"), F.lit(1).alias("__p")).join(now.select("path", F.col("content_hash").alias("__b"), F.lit(1).alias("__n")), "path", "full")
    what = F.when(F.col("__p").isNull(), "appeared").when(F.col("__n").isNull(), "vanished").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select("path", what.alias("problem")).where("problem is not null")


def evicted(cache: DataFrame, cap: int) -> DataFrame:
    """Cache files (path, size, mtime) to delete, oldest first, until the rest fits. The running sum is taken within
    seconds of age, whose totals come first, so no task sees all files."""
    day = F.floor(F.col("mtime") / 86400)
    sums = cache.groupBy(day.alias("__d")).agg(F.sum("size").alias("__s"))
    w = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    sums = sums.select("__d", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__before"))
    total = cache.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("__total"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("__d").orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cache.withColumn("__d", day).withColumn("__in", inside).join(sums, "__d").crossJoin(F.broadcast(total))  # one row
    return rows.where(F.col("__total") - (F.col("__before") + F.col("__in")) > cap).select(cache.columns)


def inconsistencies(report: DataFrame) -> DataFrame:
    """Broken invariants of a report row, one row each."""
    rules = {
        "scored and unscoreable make up the photographs": F.col("scored") + F.col("unscoreable") == F.col("photos"),
        "bands make up the scored": F.col("keep") + F.col("review") + F.col("reject") == F.col("scored"),
        "states make up the photographs": F.col("pair") + F.col("raw_only") + F.col("raster_only") + F.col("ambiguous") == F.col("photos"),
        "pairs are the paired": F.col("pairs") == F.col("pair"),
        "the ambiguous need review": F.col("needs_review") >= F.col("ambiguous"),
        "only the scored are reused": F.col("reused") <= F.col("scored"),
        "photographs have files": F.col("scanned_files") >= F.col("photos"),
        "photographs make shoots": ~((F.col("photos") > 0) & (F.col("shoots") == 0)),
    }
    found = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return report.select(F.explode(found).alias("problem"))


def histogram_percentiles(values: DataFrame, keys: list[str], value: str, bins: int, targets: tuple[float, ...]) -> DataFrame:
    """keys and p<i> for each target: percentiles of values in 0..1 from a histogram, interpolated within a bin."""
    bin_ = F.least(F.lit(bins - 1), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))) * (bins - 1))).cast("int")
    hist = values.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("bin")
    hist = hist.withColumns({"acc": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*keys))})
    out = []
    for i, p in enumerate(targets):
        target = F.greatest(F.lit(1.0), F.round(F.col("total") * p))
        hit = (F.col("acc") >= target) & (F.col("acc") - F.col("n") < target)
        at = (F.col("bin") + (target - (F.col("acc") - F.col("n"))) / F.col("n")) / (bins - 1)
        out.append(F.max(F.when(hit, F.least(F.lit(1.0), at))).alias(f"p{i}"))
    return hist.groupBy(*keys).agg(*out)


def endpoint_usage(replies: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Diagnosis of a tagging endpoint from its replies (tags, completion_tokens, seconds): whether all tags are of the
    vocabulary, tokens that said nothing, and photographs an hour."""
    wasted = F.greatest(F.lit(0), F.col("completion_tokens") - 12 * F.size("tags"))
    known = F.forall("tags", lambda t: t.isin(vocabulary))
    return replies.agg(F.coalesce(F.bool_and(known), F.lit(True)).alias("adheres"), F.sum(wasted).alias("wasted"), F.try_divide(F.lit(3600.0) * F.count("*"), F.sum("seconds")).alias("per_hour"))


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
