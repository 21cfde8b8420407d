"""Ratings and rejections: setting them, what they were made for, and following photographs that were renamed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolith.operators.vectors import components

_RAW_FIRST = "case when role = 'raw' then 0 else 1 end"
_LAST = (1 << 63) - 1


def identities(files: DataFrame) -> DataFrame:
    """(photo_id, source_size, source_mtime) of each photograph's primary file: a raw before a rendering, then the
    lowest id."""
    rows = files.where("role in ('raw', 'raster')").groupBy("photo_id")
    first = rows.agg(F.min_by(F.struct("size_bytes", "mtime_ns"), F.struct(F.expr(_RAW_FIRST), "id", "size_bytes", "mtime_ns")).alias("x"))
    return first.select("photo_id", F.col("x.size_bytes").alias("source_size"), F.col("x.mtime_ns").alias("source_mtime"))


def set_decisions(decisions: DataFrame, files: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(decisions, previous) after new ones (photo_id, rating, rejected): each is stored with the identity of the primary
    file; previous has what was there, unrated where there was nothing."""
    ids = new.select("photo_id").distinct()
    stored = new.join(identities(files), "photo_id", "left").withColumn("decided_at", F.lit(now).cast("long"))
    columns = ["photo_id", "rating", "rejected", "decided_at", "source_size", "source_mtime"]
    kept = decisions.join(ids, "photo_id", "left_anti")
    previous = ids.join(decisions, "photo_id", "left").select("photo_id", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("rejected", F.lit(False)).alias("rejected"))
    return kept.select(*columns).unionByName(stored.select(*columns)), previous


def remember_identities(decisions: DataFrame, files: DataFrame, photos: DataFrame) -> DataFrame:
    """The decisions with the identities of today's primary files for the given photographs (photo_id)."""
    chosen = photos.select("photo_id").distinct().join(identities(files), "photo_id", "left").select("photo_id", F.col("source_size").alias("__s"), F.col("source_mtime").alias("__m"), F.lit(True).alias("__hit"))
    rows = decisions.join(chosen, "photo_id", "left")
    return rows.withColumns({"source_size": F.when(F.col("__hit"), F.col("__s")).otherwise(F.col("source_size")), "source_mtime": F.when(F.col("__hit"), F.col("__m")).otherwise(F.col("source_mtime"))}).select(decisions.columns)


def decision_count(decisions: DataFrame) -> DataFrame:
    """n: how many photographs are rated or rejected, those in the trash too."""
    return decisions.agg(F.count_if((F.col("rating") > 0) | F.col("rejected")).alias("n"))


def orphaned(decisions: DataFrame, photos: DataFrame) -> DataFrame:
    """Decisions with a known identity whose photograph is gone."""
    return decisions.where("source_size is not null and source_mtime is not null").join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_anti")


def _in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
    """One after the other, each decision takes the first photograph that is still free. What a list has passed is taken,
    so no list is read twice."""
    out, taken = [], set()
    h = pdf[pdf["rank"] >= 0].sort_values(["rank", "id"])
    heirs = {k: iter(g.tolist()) for k, g in h.groupby(["s", "m"])["id"]}
    for p, s, m in pdf[pdf["rank"] < 0].sort_values(["id", "s", "m"])[["id", "s", "m"]].itertuples(index=False, name=None):
        free = next((x for x in heirs.get((s, m), ()) if x not in taken), None)
        if free is not None:
            taken.add(free)
            out.append((p, free))
    return pd.DataFrame(out, columns=["photo_id", "heir_id"]).astype("int64")


def _ask(pdf: pd.DataFrame) -> pd.DataFrame:
    """The decisions of one size and time in order ask the first photograph that the one before hasn't passed and that no
    earlier decision of another size or time holds (``before``: it is held against decisions after this)."""
    h = pdf[pdf["rank"] >= 0].sort_values(["rank", "id"])
    left = zip(h["id"].tolist(), h["before"].tolist())
    photos, asked = [], []
    for p in np.sort(pdf.loc[pdf["rank"] < 0, "id"].to_numpy()).tolist():
        free = next((x for x, before in left if before >= p), None)
        if free is None:
            break
        photos.append(p)
        asked.append(free)
    return pd.DataFrame({"photo_id": photos, "s": pdf["s"].iat[0], "m": pdf["m"].iat[0], "heir_id": asked}).astype("int64")


def _in_rounds(rows: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``_in_turn`` gives, a task for each size and time. In every round all decisions ask; a photograph is held by the
    earliest that asked it, and the others ask further on. A photograph only changes to an earlier decision, so the rounds
    end, and the end is unique: it is what taking turns gives."""
    held = None
    while True:
        free = F.lit(_LAST).alias("before")
        if held is None:
            asking = rows.select("s", "m", "id", "rank", free)
        else:
            # of equal photo_ids, the smaller size and time comes first
            before = F.when(F.struct("by.s", "by.m") < F.struct("s", "m"), F.col("by.photo_id") - 1).otherwise(F.col("by.photo_id"))
            kept = rows.where("rank >= 0").join(held.select(F.col("heir_id").alias("id"), "by"), "id", "left")
            asking = kept.select("s", "m", "id", "rank", F.coalesce(before, F.lit(_LAST)).alias("before")).unionByName(rows.where("rank < 0").select("s", "m", "id", "rank", free))
        asked = checkpoint(asking.groupBy("s", "m").applyInPandas(_ask, "photo_id long, s long, m long, heir_id long"))
        held = asked.groupBy("heir_id").agg(F.min(F.struct("photo_id", "s", "m")).alias("by"), F.count("*").alias("n"))
        if held.where("n > 1").isEmpty():
            return asked.select("photo_id", "heir_id")


def adopt(doomed: DataFrame, heirs: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], in_turn: int = 100_000) -> DataFrame:
    """(photo_id, heir_id): decisions whose photograph is going move to a photograph without one that has a file of the
    same size and time. doomed: photo_id, source_size, source_mtime; heirs: photo_id, role, size_bytes, mtime_ns.

    In the order of photo_id each decision takes one heir, raw files first, then the lowest photo_id, and no heir is
    taken twice. Where every photograph that fits has one fitting size and time only, the k-th decision takes the
    k-th heir, by windows. Photographs with several (a raw and its rendering) tie sizes and times together; those
    are dealt with in turn, a task for each set of sizes and times that hang together, and in rounds where such a set
    has more than ``in_turn`` rows.
    """
    key = ["s", "m"]
    d = doomed.select("photo_id", F.col("source_size").alias("s"), F.col("source_mtime").alias("m")).where("s is not null and m is not null")
    h = heirs.where("role in ('raw', 'raster')").groupBy(F.col("photo_id").alias("heir_id"), F.col("size_bytes").alias("s"), F.col("mtime_ns").alias("m")).agg(F.min(F.expr(_RAW_FIRST)).alias("rank"))
    h = checkpoint(h.join(d.select(*key).distinct(), key, "left_semi").withColumn("node", F.xxhash64(*key)))
    several = h.groupBy("heir_id").agg(F.min("node").alias("src"), F.max("node").alias("hi")).where("src != hi").select("heir_id", "src")
    tied = components(h.join(several, "heir_id").where("node != src").select("src", F.col("node").alias("dst")), checkpoint)
    d = d.withColumn("node", F.xxhash64(*key))
    plain_d, plain_h = (x.join(tied, "node", "left_anti") for x in (d, h))
    nth = plain_d.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("photo_id")))
    plain = nth.join(plain_h.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "heir_id"))), [*key, "k"]).select("photo_id", "heir_id")
    rows = d.join(tied, "node").select("component", *key, F.col("photo_id").alias("id"), F.lit(-1).alias("rank"))
    rows = checkpoint(rows.unionByName(h.join(tied, "node").select("component", *key, F.col("heir_id").alias("id"), "rank")))
    large = checkpoint(rows.groupBy("component").count().where(F.col("count") > in_turn).select("component"))  # few, as each has so many rows
    small = rows.join(F.broadcast(large), "component", "left_anti")
    out = plain.unionByName(small.groupBy("component").applyInPandas(_in_turn, "photo_id long, heir_id long"))
    if large.isEmpty():
        return out
    return out.unionByName(_in_rounds(rows.join(F.broadcast(large), "component", "left_semi"), checkpoint))
