"""A cache of thumbnails: keyed by content, in folders by the key's first two digits, for each size."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Long edges by name.
SIZES = {"grid": 256, "loupe": 1024, "zoom": 2048}
CAP = 512 << 20


def key(content: Column) -> Column:
    """The name of a picture's thumbnails, a digest of its bytes."""
    return F.sha2(content, 256)


def size_named(name: str | None) -> str:
    return name if name in ("loupe", "zoom") else "grid"


def place(root: str, digest: str, size: str) -> str:
    return f"{root.rstrip('/')}/{SIZES[size]}/{digest[:2]}/{digest}.jpg"


def is_managed(path: Column) -> Column:
    """Whether the cache wrote a file; nothing else is ever deleted."""
    return path.rlike(r"(^|/)[0-9A-Fa-f]{64}\.jpg$")


def put(root: str, content: bytes, size: str, thumbnail: bytes) -> str:
    """Stores a thumbnail of a picture; written under another name and moved, so nobody reads a part of it."""
    at = Path(place(root, hashlib.sha256(content).hexdigest(), size))
    at.parent.mkdir(parents=True, exist_ok=True)
    part = at.with_suffix(f".{os.getpid()}.tmp")
    part.write_bytes(thumbnail)
    os.replace(part, at)
    return str(at)


def get(root: str, content: bytes, size: str) -> bytes | None:
    """A stored thumbnail, which counts as used now."""
    at = Path(place(root, hashlib.sha256(content).hexdigest(), size))
    try:
        os.utime(at)
        return at.read_bytes()
    except OSError:
        return None


def fill(files: DataFrame, root: str, size: str, make) -> DataFrame:
    """Makes the thumbnails that are missing for files (path, content) on the executors: (path, place, status). ``make``
    gives a thumbnail's bytes for a picture's bytes and long edge, or None."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                content = bytes(content)
                at = place(root, hashlib.sha256(content).hexdigest(), size)
                if os.path.exists(at):
                    out.append((p, at, "kept"))
                elif (made := make(content, SIZES[size])) is None:
                    out.append((p, None, "unreadable"))
                else:
                    out.append((p, put(root, content, size, made), "made"))
            yield pd.DataFrame(out, columns=["path", "place", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, place string, status string")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of the cache's own files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").option("ignoreMissingFiles", "true").load(root)
    rows = raw.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    return rows.where(is_managed(F.col("path")))


def stats(cache: DataFrame, cap: int = CAP) -> DataFrame:
    """files, bytes, cap and utilisation of cache files (path, size)."""
    row = cache.where(is_managed(F.col("path"))).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return row.withColumns({"cap": F.lit(cap).cast("long"), "utilisation": F.coalesce(F.try_divide(F.col("bytes").cast("double"), F.lit(float(cap))), F.lit(0.0))})


def trimmed(cache: DataFrame, keep: int) -> DataFrame:
    """Files (path, size, mtime) to delete so that the newest ``keep`` stay; of equal age the first by path stay, then the
    lowest in the other columns. A row that is there several times counts as often, so exactly ``keep`` rows stay. The
    newest are a top-k, whatever the cache's size."""
    if keep <= 0:
        return cache
    columns = ["mtime", "path", *(c for c in cache.columns if c not in ("mtime", "path"))]
    kept = cache.orderBy(F.desc("mtime"), *columns[1:]).limit(keep).groupBy(*columns).agg(F.count("*").alias("__kept"))
    edge = kept.orderBy(F.asc("mtime"), *map(F.desc, columns[1:])).limit(1)
    rows = cache.crossJoin(F.broadcast(edge.select("__kept", *(F.col(c).alias(f"__{c}") for c in columns))))  # one row
    after, same = F.lit(False), F.lit(True)
    for c in columns:
        mine, last = F.col(c), F.col(f"__{c}")
        # nulls are the oldest, and first in the other columns
        further = (mine < last) | (mine.isNull() & last.isNotNull()) if c == "mtime" else (mine > last) | (mine.isNotNull() & last.isNull())
        after, same = after | (same & F.coalesce(further, F.lit(False))), same & mine.eqNullSafe(last)
    copies = rows.where(same).groupBy(*columns, "__kept").agg(F.count("*").alias("__n")).where("__n > __kept")
    copies = copies.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n") - F.col("__kept"))))
    return rows.where(after).select(cache.columns).unionByName(copies.select(cache.columns))


def delete(files: DataFrame) -> int:
    """Deletes the cache's own files among these; returns how many went."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            n = 0
            for p in batch["path"]:
                try:
                    os.remove(p)
                    n += 1
                except OSError:
                    pass
            yield pd.DataFrame({"n": [n]})

    rows = files.where(is_managed(F.col("path"))).select("path").mapInPandas(run, "n long")
    return int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
