"""Sessions: shoots by folder and camera, bursts by camera."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolith.functions.media import hash_distance
from fotolith.operators.ranks import ordered_index

SHOOT_GAP, BURST_GAP, HASH_DISTANCE = 1800, 2, 8


def session_number(partition: list[str], order: list[str], starts: Column) -> Column:
    """Running number, from 1, of rows at which ``starts`` holds (it may look at the row before)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def shaped(frames: DataFrame) -> DataFrame:
    """Frames as sessions expect them: a camera is trimmed and null where blank, an exposure that isn't positive is null;
    other columns stay."""
    out = frames.withColumn("camera", F.nullif(F.trim("camera", F.lit(" \t\n\r")), F.lit("")))
    return out.withColumn("exposure_time", F.when(F.col("exposure_time") > 0, F.col("exposure_time"))) if "exposure_time" in frames.columns else out


def redundant(burst_frames: DataFrame) -> DataFrame:
    """(burst_id, size, redundant): whether a burst has more than one frame, so that some may go."""
    return burst_frames.groupBy("burst_id").agg(F.count("*").alias("size")).withColumn("redundant", F.col("size") > 1)


def shoots(frames: DataFrame, gap: int = SHOOT_GAP) -> DataFrame:
    """frames (photo_id, dir, camera, captured_at, ...) with shoot_id, shoot_size and time_clustered.

    A gap longer than ``gap`` seconds starts a new shoot; a folder and camera's frames without a time are a shoot of
    their own, after the others. Ids count from 0 by folder, camera (null first) and time.
    """
    key = ["dir", "camera"]
    timed = F.col("captured_at").isNotNull()
    w = Window.partitionBy(*key).orderBy(F.col("captured_at").asc_nulls_last(), "photo_id")
    last = F.lag("captured_at").over(w)
    rows = frames.withColumn("__new", timed & (last.isNull() | (F.col("captured_at") - last > gap)))
    rows = rows.withColumn("__k", F.when(timed, F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    own = rows.groupBy(*key).agg((F.coalesce(F.max("__k") + 1, F.lit(0))).alias("__timed"), (F.coalesce(F.max("__k") + 1, F.lit(0)) + F.max((~timed).cast("int"))).alias("__count"))
    # one row for each folder and camera
    before = Window.orderBy(F.col("dir"), F.col("camera").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__base", F.coalesce(F.sum("__count").over(before), F.lit(0))).withColumnsRenamed({"dir": "__dir", "camera": "__camera"})
    joined = rows.join(own, (F.col("dir") == F.col("__dir")) & F.col("camera").eqNullSafe(F.col("__camera")))
    out = joined.withColumn("shoot_id", (F.col("__base") + F.coalesce("__k", "__timed")).cast("long"))
    size = F.count("*").over(Window.partitionBy("shoot_id"))
    return out.select(*frames.columns, "shoot_id", size.alias("shoot_size"), timed.alias("time_clustered"))


def bursts(frames: DataFrame, gap: int = BURST_GAP, distance: int = HASH_DISTANCE) -> DataFrame:
    """frames (photo_id, camera, captured_at, hash, ...) that have a time, with burst_id and burst_size.

    A burst ends at a gap longer than ``gap`` seconds, or where the picture differs from the one just before in more
    than ``distance`` bits (both hashes known). Ids count from 0 by the smallest photo_id.
    """
    w = Window.partitionBy("camera").orderBy("captured_at", "photo_id")
    far = F.coalesce(hash_distance(F.col("hash"), F.lag("hash").over(w)) > distance, F.lit(False))
    last = F.lag("captured_at").over(w)
    rows = frames.where("captured_at is not null")
    rows = rows.withColumn("__new", last.isNull() | (F.col("captured_at") - last > gap) | far)
    rows = rows.withColumn("__k", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("camera", "__k")
    rows = rows.withColumns({"__first": F.min("photo_id").over(own), "burst_size": F.count("*").over(own)})
    ids = ordered_index(rows.select("__first").distinct(), "__first", "burst_id")
    return rows.join(ids, "__first").select(*frames.columns, "burst_id", "burst_size")


def brackets(burst_frames: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """(burst_id, is_bracket): at least three exposures, one ISO, even steps of about a multiple of a third of a stop."""
    b = burst_frames.groupBy("burst_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("exposure_time") > 0, F.col("exposure_time")))).alias("t"),
        F.count_distinct("iso").alias("isos"),
    )
    n = F.size("t")
    steps = F.transform(F.sequence(F.lit(2), n), lambda i: F.log2(F.element_at("t", i) / F.element_at("t", i - 1)))
    b = b.withColumn("steps", F.when(n >= 3, steps))
    mean = F.aggregate("steps", F.lit(0.0), lambda s, x: s + x) / F.size("steps")
    b = b.withColumn("mean", mean)
    near = F.forall("steps", lambda x: (x > 0) & (F.abs(x - F.round(x * 3) / 3) <= tolerance))
    even = F.forall("steps", lambda x: F.abs(x - F.col("mean")) <= tolerance)
    ok = (n >= 3) & (F.col("isos") <= 1) & near & even & (F.col("mean") >= 1 / 3 - tolerance)
    return b.select("burst_id", F.coalesce(ok, F.lit(False)).alias("is_bracket"))


def keepers(burst_frames: DataFrame, scores: DataFrame, manual: DataFrame, k: int = 2) -> DataFrame:
    """burst_frames with score, manual, is_bracket and keep: all of a bracket, all chosen by hand, and the best up to k."""
    rows = burst_frames.join(scores.select("photo_id", "score"), "photo_id", "left")
    rows = rows.join(manual.select("photo_id").distinct().withColumn("manual", F.lit(True)), "photo_id", "left").withColumn("manual", F.coalesce("manual", F.lit(False)))
    rows = rows.join(brackets(burst_frames), "burst_id")
    best = F.row_number().over(Window.partitionBy("burst_id").orderBy(F.desc("manual"), F.desc_nulls_last("score"), "photo_id"))
    return rows.withColumn("keep", F.col("is_bracket") | F.col("manual") | (best <= k))
