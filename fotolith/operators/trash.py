"""The trash of a library folder: plans, moves that can be undone, a log, and gates before anything is touched.

Moving files is a driver's job: a selection is what a user chose, and renames must happen one after the other so that a
failure can be rolled back. What the log says is a table (``tables.operations``, ``rollup``).
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.schemas import schema
from fotolith.sources.files import read_manifest

# Names in a library that editors keep while they have it open, and the trash's own names.
EDITOR_LOCKS = (".lrcat-wal", ".lrcat.lock", ".lrcat-journal", "library.db.lock", ".darktable.lock")
FOLDER, LOG = ".cull-trash", "MANIFEST.jsonl"
TTL_SECONDS = 3600


class Refused(RuntimeError):
    """A gate was closed; ``why`` names it."""

    def __init__(self, why: str, path: Path):
        super().__init__(f"{why}: {path}")
        self.why, self.path = why, path


class Changed(RuntimeError):
    """A file isn't what was planned for."""


@dataclass(frozen=True)
class Move:
    source: str
    destination: str
    size: int
    expected_hash: str | None = None


@dataclass
class Plan:
    op_id: str
    moves: list[Move]
    warnings: list[str] = field(default_factory=list)

    @property
    def bytes(self) -> int:
        return sum(m.size for m in self.moves)


def file_hash(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def hashes_of(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, content_hash) of files (path), read by the executors; for selections too large for one machine."""
    names = [r[0] for r in paths.select("path").distinct().collect()]  # a user's selection
    if not names:
        return spark.createDataFrame([], "path string, content_hash string")
    return spark.read.format("binaryFile").load(names).select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), F.sha2("content", 256).alias("content_hash"))


def suffixed(path: Path, n: int) -> Path:
    return path.with_name(f"{path.stem}~{n}{path.suffix}")


class Trash:
    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.folder, self.log = self.root / FOLDER, self.root / FOLDER / LOG
        for name in EDITOR_LOCKS:
            if (self.root / name).exists():
                raise Refused("an editor has the library open", self.root / name)
        if (self.root / "DCIM").is_dir() and (self.root / "MISC").is_dir():
            raise Refused("a camera's card", self.root)
        probe = self.folder / ".write-probe"
        try:
            self.folder.mkdir(parents=True, exist_ok=True)
            probe.write_bytes(b"")
            probe.unlink()
        except OSError:
            raise Refused("not writable", self.folder) from None

    def check(self, path: str | Path) -> None:
        """Refuses paths that may not be moved."""
        path = Path(path)
        if path == path.parent:
            raise Refused("the root of a file system", path)
        real, root = path.resolve(), self.root.resolve()
        if not real.is_relative_to(root):
            raise Refused("a link out of the library" if path.is_symlink() else "outside the library", path)
        if path.exists() and real.is_relative_to(self.folder.resolve()):
            raise Refused("in the trash already", path)

    def plan(self, files: list[str], hashes: dict[str, str], now: int) -> Plan:
        """Where each file would go: the same place under the day's folder, with ~2, ~3 ... where that is taken."""
        day = datetime.fromtimestamp(now, UTC).strftime("%Y-%m-%d")
        plan, taken = Plan(f"{day}-{now % 1_000_000:06d}", []), set()
        for name in files:
            self.check(name)
            path = Path(name)
            if not path.exists():
                plan.warnings.append(f"missing: {name}")
                continue
            first = self.folder / day / path.relative_to(self.root)
            to, n = first, 2
            while to.exists() or to in taken:
                to, n = suffixed(first, n), n + 1
            taken.add(to)
            if path.parent.stat().st_dev != self.folder.stat().st_dev:
                plan.warnings.append(f"another volume: {name}")
            plan.moves.append(Move(name, str(to), path.stat().st_size, hashes.get(name)))
        return plan

    def _append(self, entry: dict) -> None:
        with open(self.log, "a", encoding="utf-8") as f:
            f.write(json.dumps(entry) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def commit(self, plan: Plan, reason: str, now: int) -> int:
        """Moves the files and returns their number. Every file is hashed before the first one moves, the log is written
        before too, and a failure moves back what went."""
        for m in plan.moves:
            if m.expected_hash is None or file_hash(m.source) != m.expected_hash:
                raise Changed(m.source)
        if not plan.moves:
            return 0
        self._append({"op_id": plan.op_id, "at": now, "action": "trash", "reason": reason, "files": [vars(m) for m in plan.moves]})
        done: list[Move] = []
        try:
            for m in plan.moves:
                Path(m.destination).parent.mkdir(parents=True, exist_ok=True)
                os.rename(m.source, m.destination)
                done.append(m)
        except OSError:
            for m in reversed(done):
                os.rename(m.destination, m.source)
            raise
        return len(done)

    def entries(self) -> list[dict]:
        """The log's entries; without a log there are none, and a broken line is named in the error."""
        out = []
        if not self.log.exists():
            return out
        for n, line in enumerate(self.log.read_text(encoding="utf-8").splitlines(), 1):
            if line.strip():
                try:
                    out.append(json.loads(line))
                except ValueError as e:
                    raise ValueError(f"{self.log}, line {n}: {e}") from None
        return out

    def manifest(self, spark: SparkSession) -> DataFrame:
        return read_manifest(spark, str(self.log))

    def _entry(self, op_id: str) -> dict:
        found = next((e for e in self.entries() if e["op_id"] == op_id), None)
        if found is None:
            raise KeyError(op_id)
        return found

    def restore(self, op_id: str) -> dict:
        """Moves an operation's files back where their places are free; op_id, restored, already_present, missing."""
        out = {"op_id": op_id, "restored": 0, "already_present": 0, "missing": []}
        for m in self._entry(op_id)["files"]:
            source, kept = Path(m["source"]), Path(m["destination"])
            if not source.resolve().is_relative_to(self.root.resolve()):
                out["missing"].append(str(source))
            elif not kept.is_file():
                if source.is_file():
                    out["already_present"] += 1
                else:
                    out["missing"].append(str(kept))
            elif m.get("expected_hash") and file_hash(kept) != m["expected_hash"]:
                raise Changed(str(kept))
            elif source.exists():
                out["missing"].append(str(source))
            else:
                source.parent.mkdir(parents=True, exist_ok=True)
                os.rename(kept, source)
                out["restored"] += 1
        return out

    def purge(self, op_ids: list[str]) -> dict:
        """Deletes what operations hold in the trash, and nothing outside it; operations, removed, bytes."""
        out = {"operations": 0, "removed": 0, "bytes": 0}
        for op_id in op_ids:
            entry = self._entry(op_id)
            out["operations"] += 1
            for m in entry["files"]:
                kept = Path(m["destination"])
                if kept.is_file() and kept.resolve().is_relative_to(self.folder.resolve()):
                    kept.unlink()
                    out["removed"] += 1
                    out["bytes"] += m["size"]
            self._append({"op_id": f"{op_id}-purged", "at": entry["at"], "action": "purge", "reason": f"purged {len(entry['files'])} file(s)", "files": []})
        return out


@dataclass
class _Pending:
    photo_ids: list[int]
    hashes: dict[str, str]
    created: int


class DeleteSession:
    """Plan, look, commit: a plan is used once, for an hour, and not if a file has appeared since. ``files`` gives the
    paths of photographs today, by photograph."""

    def __init__(self, root: str | Path, files):
        self.root, self.files = root, files
        self._pending: _Pending | None = None

    @property
    def pending(self) -> bool:
        return self._pending is not None

    def cancel(self) -> None:
        self._pending = None

    def _paths(self, photo_ids: list[int]) -> list[str]:
        return [p for paths in self.files(photo_ids).values() for p in paths]

    def plan(self, photo_ids: list[int], now: int) -> Plan:
        paths = self._paths(photo_ids)
        hashes = {p: file_hash(p) for p in paths}
        plan = Trash(self.root).plan(paths, hashes, now)
        self._pending = _Pending(list(photo_ids), hashes, now)
        return plan

    def commit(self, now: int, reason: str = "culled") -> tuple[Plan, list[int]]:
        """(plan, photographs that are in the trash now)."""
        was, self._pending = self._pending, None
        if was is None:
            raise Refused("nothing is planned", Path(self.root))
        if now - was.created > TTL_SECONDS:
            raise Refused("the plan has expired", Path(self.root))
        found = self.files(was.photo_ids)
        paths = [p for own in found.values() for p in own]
        for p in paths:
            if p not in was.hashes:
                raise Refused("appeared since the plan", Path(p))
        trash = Trash(self.root)
        plan = trash.plan(paths, was.hashes, now)
        trash.commit(plan, reason, now)
        return plan, [i for i, own in found.items() if own]


def rollup(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(op_id, at, files, bytes, present, incomplete) of each move in the log, newest first; ``present`` has the paths that
    are in the trash now."""
    moves = manifest.where("action = 'trash'").select("op_id", "at", F.explode_outer("files").alias("f"))
    have = present.select(F.col("path").alias("__path")).distinct().withColumn("__here", F.lit(1))
    rows = moves.join(have, F.col("f.destination") == F.col("__path"), "left")
    out = rows.groupBy("op_id", "at").agg(F.count("f").alias("files"), F.coalesce(F.sum(F.greatest("f.size", F.lit(0))), F.lit(0)).alias("bytes"), F.count("__here").alias("present"))
    return out.withColumn("incomplete", F.col("present") < F.col("files")).orderBy(F.desc("at"), "op_id")


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema("manifest"))
