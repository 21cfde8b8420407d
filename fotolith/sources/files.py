"""Files as DataFrames: scans of folders, metadata containers, previews, sidecars, logs and vocabularies."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.functions import paths as P
from fotolith.schemas import schema


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, empty): path, size_bytes and mtime_ns of indexable files below a folder, and those without content.
    Contents aren't read: only the columns asked for reach the source. The source leaves out files without content, so
    these come from its listing, which the driver holds for any file source."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    tidy = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    listed = spark.createDataFrame([(unquote(p),) for p in raw.inputFiles()], "path string").select(tidy.alias("path")).where(P.is_scanned(F.col("path")))
    rows = raw.select(tidy.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).where(P.is_scanned(F.col("path")))
    return rows.where("size_bytes > 0"), listed.join(rows.where("size_bytes > 0").select("path"), "path", "left_anti")


def walk(spark: SparkSession, root: str, checkpoint) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, empty, unreadable) of a folder that all executors have mounted: path, size_bytes and mtime_ns of indexable
    files, paths of those without content, and path and reason of what couldn't be listed or looked at.

    The executors list folders, a level of the tree in each round, so no list passes through the driver. Links aren't
    followed and excluded folders not entered."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                out = []
                try:
                    entries = list(os.scandir(folder))
                except OSError as e:
                    entries, out = [], [(folder, "error", 0, 0, e.strerror)]
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            out.append((e.path, "folder", 0, 0, None))
                        elif e.is_file(follow_symlinks=False):
                            st = e.stat(follow_symlinks=False)
                            out.append((e.path, "file", st.st_size, st.st_mtime_ns, None))
                    except OSError as x:
                        out.append((e.path, "error", 0, 0, x.strerror))
                yield pd.DataFrame(out, columns=["path", "what", "size_bytes", "mtime_ns", "reason"])

    ddl = "path string, what string, size_bytes long, mtime_ns long, reason string"
    folders, found = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = checkpoint(folders.mapInPandas(listed, ddl))
        found = level if found is None else found.unionByName(level)
        folders = level.where("what = 'folder'").where(P.is_scanned(F.concat("path", F.lit("/x.jpg")))).select("path").repartition("path")
        if folders.isEmpty():
            break
    files = found.where("what = 'file'").where(P.is_scanned(F.col("path"))).select("path", "size_bytes", "mtime_ns")
    return files.where("size_bytes > 0"), files.where("size_bytes = 0").select("path"), found.where("what = 'error'").select("path", "reason")


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


# TIFF metadata ----------------------------------------------------------------------------------------------------

# Tags of the fields that are read.
_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "changed", 0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal_length", 0xA433: "lens_make", 0xA434: "lens"}
_EXIF_IFD = 0x8769
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def tiff_fields(data: bytes) -> dict:
    """Known fields of a TIFF block, the main directory first, then the EXIF directory; broken entries are left out."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    out: dict = {}
    queue, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    while queue:
        at = queue.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if tag == _EXIF_IFD:
                queue.append(struct.unpack_from(order + "I", data, entry + 8)[0])
            elif tag in _TAGS and (value := _value(data, order, kind, count, entry + 8)) is not None:
                out.setdefault(_TAGS[tag], value)
    return out


def _value(data: bytes, order: str, kind: int, count: int, at: int):
    size = _SIZES.get(kind, 0) * count
    if not size or size > 1 << 20:
        return None
    if size > 4:
        at = struct.unpack_from(order + "I", data, at)[0]
    if at + size > len(data):
        return None
    if kind in (2, 7):
        return data[at : at + size].split(b"\0")[0].decode(errors="replace").strip() or None
    if kind in (5, 10):
        a, b = struct.unpack_from(order + ("II" if kind == 5 else "ii"), data, at)
        return a / b if b else None
    numbers = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 9: "i"}[kind] * count, data, at)
    return numbers[0] / numbers[1] if count == 2 and numbers[1] else numbers[0]


def metadata_block(data: bytes) -> bytes | None:
    """The TIFF block of a TIFF, JPEG or box container file, or None."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            size = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    return None


#: Fixed value: the box that holds a CR3 file's metadata.
_CANON = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of content, end) of the boxes in a range; stops at a broken one."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def cr3_fields(data: bytes, most: int = 4 << 20) -> dict:
    """Fields of a CR3 file's two metadata blocks, the first that has a field wins."""
    if data[4:12] != b"ftypcrx ":
        return {}
    out: dict = {}
    for kind, a, b in boxes(data):
        if kind != b"moov":
            continue
        for inner, c, d in boxes(data, a, b):
            if inner == b"uuid" and data[c : c + 16] == _CANON:
                for name, e, f in boxes(data, c + 16, d):
                    if name in (b"CMT1", b"CMT2") and f - e <= most:
                        for k, v in tiff_fields(data[e:f]).items():
                            out.setdefault(k, v)
    return out


def _is_container(data: bytes) -> bool:
    """Whether metadata would have been found: JPEG, TIFF or PNG."""
    return data[:3] == b"\xff\xd8\xff" or data[:4] in (b"II*\0", b"MM\0*") or data[:8] == b"\x89PNG\r\n\x1a\n"


def _exif_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["make", "model", "lens", "taken", "iso", "f_number", "exposure_time", "focal_length", "orientation"]
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            if data is None:
                rows.append([path, "unreadable", *(None for _ in names)])
                continue
            f = cr3_fields(data)
            block = None if f else metadata_block(data)
            f = f or (tiff_fields(block) if block else {})
            f["taken"] = f.get("taken") or f.get("changed")
            f["lens"] = f.get("lens") or f.get("lens_make")
            status = "parsed" if any(f.get(n) for n in names) else "absent" if block or _is_container(data) else "unsupported"
            rows.append([path, status, *(f.get(n) for n in names)])
        yield pd.DataFrame(rows, columns=["path", "status", *names]).astype({n: "float64" for n in ("iso", "f_number", "exposure_time", "focal_length", "orientation")})


def read_exif(files: DataFrame) -> DataFrame:
    """path, status and fields of files (path, content): parsed; absent, the file has no metadata; unsupported, it is no
    container that is read here, so nothing is said of the file; unreadable, there is no content."""
    return files.mapInPandas(_exif_rows, "path string, status string, make string, model string, lens string, taken string, iso double, f_number double, exposure_time double, focal_length double, orientation double")


# previews ---------------------------------------------------------------------------------------------------------


class TooLarge(ValueError):
    """A file beyond what is looked through."""


def jpeg_extent(data: bytes, at: int) -> tuple[int, tuple[int, int] | None] | None:
    """(end, (width, height) of the frame header) of the JPEG that begins at a place: its segments are walked by their
    lengths, and coded data up to the next marker that isn't a stuffed byte or a restart; None for anything else. What
    lies inside a segment, a thumbnail of its own say, doesn't end it."""
    n, at, size = len(data), at + 2, None
    while at + 1 < n and data[at] == 0xFF:
        while at + 1 < n and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 1 >= n:
            return None
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            return at, size
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > n or (length := struct.unpack_from(">H", data, at)[0]) < 2:
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and length >= 7 and at + 7 <= n and size is None:
            h, w = struct.unpack_from(">HH", data, at + 3)
            size = (w, h) if w and h else None
        at += length
        if marker == 0xDA:
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < n and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return None
    return None


def previews(data: bytes, least: int = 512, most: int = 256 << 20) -> list[tuple[int, int, int, int]]:
    """(start, end, width, height) of embedded JPEGs with a long edge of at least ``least``, the largest first, the
    shorter file first among equals. The search goes on behind a JPEG that was found."""
    if len(data) > most:
        raise TooLarge(f"{len(data)} bytes")
    out, at = [], data.find(b"\xff\xd8\xff")
    while at >= 0:
        end, size = jpeg_extent(data, at) or (0, None)
        if size and max(size) >= least:
            out.append((at, end, *size))
        at = data.find(b"\xff\xd8\xff", max(end, at + 3))
    return sorted(out, key=lambda p: (-p[2] * p[3], p[1] - p[0]))


def preview_spans(files: DataFrame, least: int = 512) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, k, *x) for p, d in zip(batch["path"], batch["content"], strict=True) for k, x in enumerate(previews(d, least))], columns=["path", "place", "start", "stop", "width", "height"])

    return files.mapInPandas(run, "path string, place int, start long, stop long, width int, height int")


def decode_gray(data: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, luma) of a binary PGM; other formats need a decoder that the caller plugs in."""
    parts = data[:64].split(maxsplit=4)
    if len(parts) < 4 or parts[0] != b"P5" or parts[3][:3] != b"255":
        return None
    w, h = int(parts[1]), int(parts[2])
    return w, h, data[len(data) - w * h :]


def decode_source(data: bytes, picture, raw=None) -> np.ndarray | None:
    """The first picture that can be had: embedded previews in their order, the file itself, then its raw data.
    ``picture`` and ``raw`` are decoders of bytes to an array, or None where they can't read them."""
    for start, end, _, _ in previews(data):
        if (found := picture(data[start:end])) is not None:
            return found
    if (found := picture(data)) is not None:
        return found
    return raw(data) if raw is not None else None


# sidecars ---------------------------------------------------------------------------------------------------------


def _attribute(text: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, rf'[\s<]{name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(text, rf"[\s<]{name}\s*=\s*'([^']*)'", 1), F.lit("")))


def parse_sidecar(text: Column) -> Column:
    """struct<rating, label, keywords> of an XMP text; a rating that isn't 0 to 5 is none."""
    r = F.trim(_attribute(text, "xmp:Rating"))
    subject = F.regexp_extract(text, r"(?s)<dc:subject\b.*?>(.*?)</dc:subject>", 1)
    return F.struct(
        F.when(r.rlike("^[+]?0*[0-5]$"), r.cast("int")).alias("rating"),
        F.nullif(F.trim(_attribute(text, "xmp:Label")), F.lit("")).alias("label"),
        F.transform(F.regexp_extract_all(subject, F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), F.lit(1)), lambda x: F.trim(x)).alias("keywords"),
    )


# Fixed value: a document without properties.
_EMPTY = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/"/></rdf:RDF></x:xmpmeta>'


def merge_sidecar(text: Column, rating: Column, label: Column) -> Column:
    """The XMP text with a rating, and a label set or removed; everything else stays as it is."""
    base = F.when(F.contains(text, F.lit("<rdf:Description")), text).otherwise(_EMPTY)

    def put(t: Column, name: str, value: Column) -> Column:
        have = rf"""([\s<]{name}\s*=\s*)(?:"[^"]*"|'[^']*')"""
        escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
        safe = F.regexp_replace(escaped, r"([\\$])", r"\\$1")
        return F.when(t.rlike(have), F.regexp_replace(t, F.lit(have), F.concat(F.lit('$1"'), safe, F.lit('"')))).otherwise(F.regexp_replace(t, F.lit("<rdf:Description"), F.concat(F.lit(f'<rdf:Description {name}="'), safe, F.lit('"'))))

    rated = put(base, "xmp:Rating", rating.cast("string"))
    without = F.regexp_replace(rated, r"""\s+xmp:Label\s*=\s*(?:"[^"]*"|'[^']*')""", "")
    return F.when(label.isNull(), without).otherwise(put(rated, "xmp:Label", label))


def sidecar_path(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".xmp"))


def sidecar_plan(photos: DataFrame, decisions: DataFrame, primary: DataFrame) -> DataFrame:
    """photo_id, path, status: which sidecars are written and why others are not."""
    rows = photos.where("trashed_at is null").select(F.col("id").alias("photo_id")).join(decisions, "photo_id", "left").join(primary.select("photo_id", "path"), "photo_id", "left")
    status = F.when(F.col("rating").isNull(), "no_decision").when((F.col("rating") == 0) & ~F.col("rejected"), "unrated").when(F.col("path").isNull(), "no_file").when(~P.kind(F.col("path")).isin("raw", "raster"), "unsupported").otherwise("write")
    return rows.select("photo_id", sidecar_path(F.col("path")).alias("path"), status.alias("status"))


def write_sidecars(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """Writes the sidecars of a plan (``sidecar_plan``) beside the files, merged into those that are there, and returns
    (status, n, first_path). Executors write them; a file is written under another name and moved into place."""
    todo = plan.where("status = 'write'").join(decisions.select("photo_id", "rating"), "photo_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.copy()
            texts = []
            for p in batch["path"]:
                try:
                    with open(p, encoding="utf-8") as f:
                        texts.append(f.read())
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            batch["text"] = texts
            yield batch

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    with open(f"{p}.new", "w", encoding="utf-8") as f:
                        f.write(text)
                    os.replace(f"{p}.new", p)
                    out.append(("written", p))
                except OSError:
                    out.append(("failed", p))
            yield pd.DataFrame(out, columns=["status", "path"])

    have = todo.select("path", F.col("rating").cast("int").alias("rating")).mapInPandas(read, "path string, rating int, text string")
    merged = have.select("path", merge_sidecar(F.coalesce("text", F.lit("")), F.col("rating"), F.lit(None).cast("string")).alias("text"))
    done = merged.mapInPandas(write, "status string, path string")
    skipped = plan.where("status != 'write'").select(F.lit("skipped").alias("status"), "path")
    return done.unionByName(skipped).groupBy("status").agg(F.count("*").alias("n"), F.min(F.when(F.col("status") == "written", F.col("path"))).alias("first_path"))


# logs and vocabularies --------------------------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The move log, a JSON object a line; blank lines are skipped, a broken line is an error, no log has no entries."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema("manifest"))
    lines = spark.read.text(path).where("trim(value) != ''")
    row = F.from_json("value", schema("manifest"), {"mode": "FAILFAST"})
    return lines.select(row.alias("x")).select("x.*")


def append_manifest(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


_MAGIC = b"FLVOCAB1"


def vocabulary_bytes(vectors: np.ndarray, magic: bytes = _MAGIC) -> bytes:
    return magic + struct.pack("<II", *vectors.shape) + vectors.astype("<f4").tobytes()


def parse_vocabulary(data: bytes, phrases: list[str], magic: bytes = _MAGIC) -> list[tuple[str, list[float]]]:
    """(phrase, vector) of a vocabulary file: magic, count, dimensions, then the matrix; sizes must fit exactly."""
    if data[: len(magic)] != magic:
        raise ValueError("not a vocabulary")
    n, d = struct.unpack_from("<II", data, len(magic))
    body = data[len(magic) + 8 :]
    if len(body) != 4 * n * d or n != len(phrases):
        raise ValueError("the vocabulary has another size")
    return [(p, v.tolist()) for p, v in zip(phrases, np.frombuffer(body, "<f4").reshape(n, d), strict=True)]


def labelled_corpus(files: DataFrame) -> DataFrame:
    """Files below one folder a person with labels: the place of the folder's name among all, from 0."""
    rows = files.withColumn("person", F.element_at(F.split(P.directory(F.col("path")), "/"), -1))
    names = rows.select("person").distinct()
    from pyspark.sql import Window

    numbered = names.withColumn("label", F.row_number().over(Window.orderBy("person")) - 1)  # one row a person
    return rows.join(numbered, "person")
