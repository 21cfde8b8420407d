"""From files to photographs: grouping by folder and stem, halves in sibling folders, suspected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolith.functions import paths as P

ROLES = ("raw", "raster", "sidecar", "video")


def state(raws: Column, rasters: Column) -> Column:
    return F.when((raws == 1) & (rasters == 1), "pair").when((raws == 1) & (rasters == 0), "raw_only").when((raws == 0) & (rasters == 1), "raster_only").otherwise("ambiguous")


def _reasons() -> Column:
    many_raw = F.when(F.size("raws") > 1, F.array(F.lit("multiple_raw"))).otherwise(F.array().cast("array<string>"))
    many_raster = F.when(F.size("rasters") > 1, F.array(F.lit("multiple_raster"))).otherwise(F.array().cast("array<string>"))
    copy = F.when(F.coalesce("__copy", F.lit(False)), F.array(F.lit("possible_duplicate_import"))).otherwise(F.array().cast("array<string>"))
    return F.concat(many_raw, many_raster, copy)


def group_files(files: DataFrame, scope: str = "siblings") -> DataFrame:
    """dir, stem, raws, rasters, sidecars, videos, state, review and needs_review of each photograph in ``files``
    (path). ``scope``: directory, siblings (halves in folders side by side are merged) or library (anywhere)."""
    rows = files.select("path", P.kind(F.col("path")).alias("role"), P.directory(F.col("path")).alias("dir"), P.stem(F.col("path")).alias("__s")).where("role != 'other'")
    rows = rows.withColumn("stem", P.normal_stem(F.col("__s")))
    lists = [F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("path")))).alias(f"{r}s") for r in ROLES]
    groups = rows.groupBy("dir", "stem").agg(*lists).where("size(raws) + size(rasters) + size(videos) > 0")
    groups = groups.withColumn("state", state(F.size("raws"), F.size("rasters")))
    if scope != "directory":
        groups = merge_halves(groups, scope)
    # stems are normal already, so what a copy's stem was copied from is, too
    groups = groups.withColumn("__base", P.duplicate_base(F.col("stem")))
    bases = groups.select("dir", "__base").where("__base is not null")
    known = bases.join(groups.select(F.col("dir"), F.col("stem").alias("__base")), ["dir", "__base"], "left_semi").distinct()
    marked = groups.join(known.withColumn("__copy", F.lit(True)), ["dir", "__base"], "left")
    marked = marked.withColumn("review", _reasons())
    return marked.select("dir", "stem", "raws", "rasters", "sidecars", "videos", "state", "review", ((F.col("state") == "ambiguous") | (F.size("review") > 0)).alias("needs_review"))


def merge_halves(groups: DataFrame, scope: str) -> DataFrame:
    """A raw without its rendering takes the one rendering of the same stem in a sibling folder; the first raw wins."""
    parent = F.when(F.contains("dir", F.lit("/")), F.regexp_replace("dir", "/[^/]*$", ""))
    halves = groups.where("state in ('raw_only', 'raster_only')").withColumn("__p", parent if scope == "siblings" else F.lit("")).where("__p is not null")
    order = F.split("dir", "/")
    raws = halves.where("state = 'raw_only'").select("stem", "__p", F.col("dir").alias("__to"), F.row_number().over(Window.partitionBy("stem", "__p").orderBy(order)).alias("__k")).where("__k = 1")
    one = halves.where("state = 'raster_only'").groupBy("stem", "__p").agg(F.count("*").alias("__n"), F.first("dir").alias("dir")).where("__n = 1")
    moves = one.join(raws, ["stem", "__p"]).select("stem", "dir", "__to")
    moved = groups.join(moves, ["stem", "dir"], "left").withColumn("dir", F.coalesce("__to", "dir"))
    joined = moved.groupBy("dir", "stem").agg(*(F.array_sort(F.flatten(F.collect_list(f"{r}s"))).alias(f"{r}s") for r in ROLES))
    return joined.withColumn("state", state(F.size("raws"), F.size("rasters")))


def files_of(groups: DataFrame) -> DataFrame:
    """(dir, stem, role, path), raws first, then renderings, sidecars and videos."""

    def named(role: str) -> Column:
        return F.transform(f"{role}s", lambda p: F.struct(F.lit(role).alias("role"), p.alias("path")))

    every = F.concat(*map(named, ROLES))
    return groups.select("dir", "stem", F.posexplode(every).alias("place", "x")).select("dir", "stem", "place", "x.role", "x.path")


def primary(files: DataFrame) -> DataFrame:
    """The file that stands for each photograph (photo_id, id, role, path): a raw before a rendering, then the lowest id."""
    w = Window.partitionBy("photo_id").orderBy(F.when(F.col("role") == "raw", 0).otherwise(1), "id")
    return files.where("role in ('raw', 'raster')").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def state_counts(groups: DataFrame) -> DataFrame:
    return groups.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pair", "raw_only", "raster_only", "ambiguous")), F.count_if("needs_review").alias("needs_review"), F.count("*").alias("photos"))
