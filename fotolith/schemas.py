"""Schemas of the catalog's tables. Times are epoch seconds, file times epoch nanoseconds, both as long."""

from __future__ import annotations

_TABLES = {
    "library": "id long, root string, created_at long, last_indexed_at long",
    "photo": "id long, library_id long, dir string, stem string, state string, needs_review boolean, trashed_at long",
    "file": "id long, library_id long, photo_id long, path string, role string, size_bytes long, mtime_ns long, content_hash string, indexed_at long",
    "photo_review": "photo_id long, reason string",
    "score": "photo_id long, metric string, value double, scorer_version string, computed_at long",
    "exif": "file_id long, source_mtime_ns long, captured_at long, make string, model string, lens string, iso int, f_number double, exposure_time double, focal_length double, orientation int, read_at long, reader_version int",
    "decision": "photo_id long, rating int, rejected boolean, decided_at long, source_size long, source_mtime long",
    "measurement": "photo_id long, scorer_version string, measured_path string, measured_size long, measured_mtime long, camera string, captured_at long, m0 double, m1 double, m2 double, m3 double, m4 double, m5 double, m6 double, m7 double, measured_at long",
    "setting": "key string, value string, updated_at long",
    "face": "id long, file_id long, x double, y double, width double, height double, confidence double, landmarks array<float>, detected_size long, detected_mtime long, detector string, detected_at long",
    "face_embedding": "face_id long, vector array<float>, model string, computed_at long",
    "person": "id long, library_id long, name string, confirmed boolean, created_at long, updated_at long",
    "person_face": "person_id long, face_id long",
    "tag": "id long, photo_id long, name string, confidence double, model string, description string, tagged_at long",
    "photo_caption": "photo_id long, model string, description string, tagged_at long",
    "manifest": "op_id string, at long, action string, reason string, files array<struct<source:string,destination:string,size:long,expected_hash:string>>",
}
#: Key columns that a snapshot write replaces rows by.
KEYS = {
    "library": ("id",), "photo": ("id",), "file": ("id",), "photo_review": ("photo_id", "reason"), "score": ("photo_id", "metric", "scorer_version"),
    "exif": ("file_id",), "decision": ("photo_id",), "measurement": ("photo_id", "scorer_version"), "setting": ("key",), "face": ("id",),
    "face_embedding": ("face_id",), "person": ("id",), "person_face": ("person_id", "face_id"), "tag": ("photo_id", "name", "model"),
    "photo_caption": ("photo_id", "model"),
}
VERSION = 11

#: The eight metrics by place in a measurement, and whether higher is better (None: not ranked into the score).
METRICS = ("focus", "detail", "anisotropy", "exposure_mean", "exposure_range", "clipped_high", "clipped_low", "noise")
HIGHER_BETTER = (True, True, None, None, True, False, False, False)


def schema(table: str) -> str:
    return _TABLES[table]


def tables() -> list[str]:
    return [t for t in _TABLES if t in KEYS]
