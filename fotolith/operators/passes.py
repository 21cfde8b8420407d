"""Passes over a library with models that a caller plugs in: faces, picture tags by similarity, tags from an endpoint.

A model is a plain function over one decoded picture, so that any runtime fits; it runs on the executors, a batch of
files at a time. What is due is always derived from the catalog, so a pass that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.operators import people, tables, vectors
from fotolith.operators.resolve import primary

Decode = Callable[[bytes], "np.ndarray | None"]
_BOXES = "array<struct<x:double,y:double,width:double,height:double,confidence:double>>"


@dataclass(frozen=True)
class Detector:
    """``find`` gives (x, y, width, height, confidence, ten landmark numbers) of each face of a picture."""

    name: str
    find: Callable[[np.ndarray], list[tuple[float, float, float, float, float, list[float]]]]


@dataclass(frozen=True)
class Embedder:
    """``embed`` gives the vector of a picture, or of a face by its landmarks."""

    name: str
    embed: Callable[..., np.ndarray]


def _decoded(decode: Decode, data) -> np.ndarray | None:
    try:
        return decode(bytes(data)) if data is not None else None
    except (ValueError, IndexError, OSError):
        return None  # unreadable


def detect(files: DataFrame, contents: DataFrame, decode: Decode, detector: Detector) -> DataFrame:
    """(file_id, size, mtime, readable, boxes, landmarks) of files (id, path, size_bytes, mtime_ns) with contents (path,
    content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                picture = _decoded(decode, r.content)
                found = detector.find(picture) if picture is not None else []
                boxes = [dict(zip(("x", "y", "width", "height", "confidence"), map(float, f[:5]), strict=True)) for f in found]
                out.append((r.id, r.size_bytes, r.mtime_ns, picture is not None, boxes, [[float(x) for x in f[5]] for f in found]))
            yield pd.DataFrame(out, columns=["file_id", "size", "mtime", "readable", "boxes", "landmarks"])

    rows = files.select("id", "path", "size_bytes", "mtime_ns").join(contents, "path", "left")
    return rows.mapInPandas(run, f"file_id long, size long, mtime long, readable boolean, boxes {_BOXES}, landmarks array<array<float>>")


def embed_faces(due: DataFrame, faces: DataFrame, files: DataFrame, contents: DataFrame, decode: Decode, embedder: Embedder) -> DataFrame:
    """(face_id, vector) of faces (face_id, photo_id): the primary file's picture with the face's landmarks; faces without
    five landmarks or a readable picture are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                picture = _decoded(decode, r.content)
                if picture is not None:
                    out.append((r.face_id, [float(x) for x in embedder.embed(picture, np.asarray(r.landmarks, np.float64))]))
            yield pd.DataFrame(out, columns=["face_id", "vector"])

    marks = faces.where("size(landmarks) = 10").select(F.col("id").alias("face_id"), "landmarks")
    rows = due.join(marks, "face_id").join(primary(files).select("photo_id", "path"), "photo_id").join(contents, "path")
    return rows.select("face_id", "landmarks", "content").mapInPandas(run, "face_id long, vector array<float>")


def face_pass(catalog, contents: DataFrame, decode: Decode, detector: Detector, embedder: Embedder, now: int, checkpoint: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Detects faces in files that are due, embeds those that are due, and groups all into people; confirmed people keep
    their faces. Returns detected_files, faces_found, embedded, unreadable and people."""
    photos = catalog.table("photo").where("trashed_at is null")
    visible = catalog.table("file").join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    due = tables.files_needing_faces(visible, catalog.table("face"), detector.name)
    found = checkpoint(detect(due, contents, decode, detector))
    ok = found.where("readable")
    catalog.replace(face=people.replace_faces(catalog.table("face"), ok.drop("readable"), detector.name, now))
    counts = found.agg(F.count_if("readable").alias("detected_files"), F.coalesce(F.sum(F.when(F.col("readable"), F.size("boxes"))), F.lit(0)).alias("faces_found"), F.count_if(~F.col("readable")).alias("unreadable")).first()
    faces, embeddings = catalog.table("face"), catalog.table("face_embedding")
    needing = people.faces_needing_embeddings(faces, catalog.table("file"), photos, embeddings, embedder.name)
    made = checkpoint(embed_faces(needing, faces, catalog.table("file"), contents, decode, embedder))
    catalog.upsert("face_embedding", made.withColumns({"model": F.lit(embedder.name), "computed_at": F.lit(now).cast("long")}))
    rows = people.faces_with_embeddings(faces, catalog.table("file"), photos, catalog.table("face_embedding"), embedder.name)
    edges = vectors.knn_graph(rows.select(F.col("face_id").alias("id"), "vector"), checkpoint)
    clusters = checkpoint(vectors.clusters(edges, checkpoint))
    who, members = tables.replace_people(catalog.table("person"), catalog.table("person_face"), clusters, checkpoint)
    catalog.replace(person=who, person_face=members)
    n = clusters.select("cluster").distinct().count()
    return {**counts.asDict(), "embedded": made.count(), "people": n}


def clip_pass(catalog, contents: DataFrame, decode: Decode, embedder: Embedder, vocabulary: DataFrame, now: int, checkpoint: Callable[[DataFrame], DataFrame], keep: int = 5, least: float = 0.2) -> dict[str, int]:
    """Tags the photographs that are due with the nearest phrases (phrase, vector); a photograph near none keeps what it
    had. Returns tagged, unreadable and tags."""
    model = f"clip:{embedder.name}"
    due = tables.photos_needing_tags(catalog.table("photo"), catalog.table("photo_caption"), model).select(F.col("id").alias("photo_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                picture = _decoded(decode, r.content)
                out.append((r.photo_id, None if picture is None else [float(x) for x in embedder.embed(picture)]))
            yield pd.DataFrame(out, columns=["photo_id", "vector"])

    rows = due.join(primary(catalog.table("file")).select("photo_id", "path"), "photo_id").join(contents, "path", "left").select("photo_id", "content")
    seen = checkpoint(rows.mapInPandas(run, "photo_id long, vector array<float>"))
    ranked = checkpoint(vectors.rank_vocabulary(seen.where("vector is not null"), vocabulary, least, keep))
    tags = ranked.select("photo_id", F.col("phrase").alias("name"), F.col("similarity").alias("confidence"))
    _store_tags(catalog, tags, tags.select("photo_id").distinct(), model, now)
    counts = ranked.agg(F.count_distinct("photo_id").alias("tagged"), F.count("*").alias("tags")).first()
    return {**counts.asDict(), "unreadable": seen.where("vector is null").count()}


def _store_tags(catalog, tags: DataFrame, photos: DataFrame, model: str, now: int) -> None:
    """The model's tags of the given photographs become the new ones; all others stay as they are."""
    old = catalog.table("tag")
    gone = photos.select("photo_id").distinct().withColumn("model", F.lit(model))
    fresh = tables.dedupe_tags(tags).withColumns({"model": F.lit(model), "tagged_at": F.lit(now).cast("long")})
    catalog.replace(tag=old.join(gone, ["photo_id", "model"], "left_anti").unionByName(fresh, allowMissingColumns=True))


class Unreachable(RuntimeError):
    """The endpoint can't be reached; the pass stops."""


_REPLY = "photo_id long, status string, tags array<struct<name:string,confidence:double>>, description string, prompt_tokens long, completion_tokens long, reason string"


def ask(pictures: DataFrame, client: Callable[[bytes], dict]) -> DataFrame:
    """Replies of an endpoint for pictures (photo_id, content). ``client`` returns tags [(name, confidence)], description,
    prompt_tokens and completion_tokens, or raises. After an outage a task asks no more: the rest is ``pending``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        down = None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                row = [r.photo_id, "pending", [], None, 0, 0, down]
                if r.content is None:
                    row[1], row[6] = "unreadable", None
                elif down is None:
                    try:
                        got = client(bytes(r.content))
                        row[1:6] = "tagged", [{"name": n, "confidence": float(c)} for n, c in got["tags"]], got.get("description"), int(got.get("prompt_tokens", 0)), int(got.get("completion_tokens", 0))
                    except Unreachable as e:
                        down = row[6] = str(e)
                    except Exception as e:  # one picture's failure doesn't stop the others
                        row[1], row[6] = "failed", str(e)
                out.append(row)
            yield pd.DataFrame(out, columns=["photo_id", "status", "tags", "description", "prompt_tokens", "completion_tokens", "reason"])

    return pictures.mapInPandas(run, _REPLY)


def tag_pass(catalog, contents: DataFrame, client: Callable[[bytes], dict], model: str, limit: int, now: int, checkpoint: Callable[[DataFrame], DataFrame]) -> dict:
    """Asks for tags of up to ``limit`` photographs that are due, stores them with captions, and returns the counts,
    tokens, what remains and why it stopped."""
    due = checkpoint(tables.photos_needing_tags(catalog.table("photo"), catalog.table("photo_caption"), model))
    batch = due.orderBy("id").limit(max(1, limit)).select(F.col("id").alias("photo_id"))
    rows = batch.join(primary(catalog.table("file")).select("photo_id", "path"), "photo_id").join(contents, "path", "left")
    replies = checkpoint(ask(rows.select("photo_id", "content"), client))
    done = replies.where("status = 'tagged'")
    tags = done.select("photo_id", F.explode("tags").alias("t")).select("photo_id", "t.name", "t.confidence")
    _store_tags(catalog, tags, done.select("photo_id"), model, now)
    captions = done.where("trim(coalesce(description, '')) != ''").select("photo_id", F.lit(model).alias("model"), "description", F.lit(now).cast("long").alias("tagged_at"))
    catalog.upsert("photo_caption", captions)
    total = due.count()
    r = replies.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("tagged", "unreadable", "failed")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")),
        F.coalesce(F.sum(F.size("tags")), F.lit(0)).alias("tags"), F.count("*").alias("asked"), F.min(F.when(F.col("status") == "pending", F.col("reason"))).alias("stopped_because"),
    ).first().asDict()
    return {**r, "remaining": total - r["asked"]}
