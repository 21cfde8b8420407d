"""Paths: kinds of files, stems, duplicate markers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extensions of each kind of file, and folders that are never indexed.
RAW = ["3fr", "ari", "arq", "arw", "cam", "cr2", "cr3", "crw", "dcr", "dng", "erf", "fff", "gpr", "iiq", "kdc", "lri", "mdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "ori", "pef", "raf", "raw", "rw2", "rwl", "sr2", "srf", "srw", "sti", "x3f"]
RASTER = ["avif", "heic", "heif", "jpe", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
SIDECAR = ["xmp", "aap", "acr", "thm", "rrdata", "pp3", "arp", "on1", "dop", "cos", "dtstyle"]
VIDEO = ["avi", "m4v", "mkv", "mov", "mp4"]
EXCLUDED = [".cull-trash", ".dtrash", ".git", ".stfolder", ".stversions", ".thumbnails"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension; null without one. A leading dot is part of the name."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)), F.lit(""))


def kind(path: Column) -> Column:
    """raw, raster, sidecar, video or other."""
    kinds = {e: k for k, exts in (("raw", RAW), ("raster", RASTER), ("sidecar", SIDECAR), ("video", VIDEO)) for e in exts}
    table = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("other"))


def is_indexable(ext: Column) -> Column:
    return F.lower(F.ltrim(ext, F.lit("."))).isin([*RAW, *RASTER, *SIDECAR, *VIDEO])


def bare_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normal_stem(stem: Column) -> Column:
    """NFC, then lower case. Only stems with non-ASCII characters reach Python."""
    plain = stem.rlike(r"^[\x00-\x7F]*$")
    return F.lower(F.when(plain, stem).otherwise(_nfc(F.when(~plain, stem))))


def stem(path: Column) -> Column:
    """The stem files of one photograph share; sidecars lose two extensions."""
    once = bare_stem(file_name(path))
    return F.when(kind(path) == "sidecar", bare_stem(once)).otherwise(once)


def duplicate_base(s: Column) -> Column:
    """What a copy's stem was copied from ("x (1)", "x copy", "x copy 2", "x-copy"), else null."""
    out = F.lit(None).cast("string")
    for pattern in (r"(?is)^(.+)-copy$", r"(?is)^(.+) copy [0-9]+$", r"(?is)^(.+) copy$", r"(?s)^(.+) \([0-9]+\)$"):
        out = F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1)).otherwise(out)
    return out


def is_scanned(path: Column) -> Column:
    """Not inside an excluded folder, not a resource fork stub, and of a known kind."""
    parts = F.split(path, "/")
    return ~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(EXCLUDED)) & ~file_name(path).startswith("._") & (kind(path) != "other")


def is_watched(path: Column, root: str) -> Column:
    """Under the root, no excluded or hidden part below it, and an indexable extension."""
    root = root.rstrip("/")
    inside = path.startswith(root + "/")
    parts = F.split(F.substring(path, len(root) + 2, F.length(path)), "/")
    return inside & ~F.exists(parts, lambda p: p.startswith(".")) & F.coalesce(is_indexable(extension(path)), F.lit(False))


def ancestors(d: Column) -> Column:
    """All folders above and with d, from the top; an absolute path's first is its first folder."""
    parts = F.split(d, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), lambda p: p != "")
