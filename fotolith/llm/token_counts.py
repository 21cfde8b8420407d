"""Token counts in rollups that deltas maintain.

A rollup is a folder of committed batches. A batch is a set of signed rows (documents, tokens) by source, language and
tokenizer version: inserts count up, deletes count down, and a revised count is its old value down and its new value
up. Rows are added up before the shuffle, so a batch is as small as the number of its groups. Sums are additive, so
batches may come in any order.

Commits are idempotent: a batch is written under a name of its own and is moved to its final name, which only one
writer can do; a batch id that is there already is left as it is, so retries and replays change nothing. ``compact``
folds batches into one that remembers their ids and what it covers; the move of that folder is the moment it counts.

Defined results: null texts have no tokens but count as documents; null source or language is a group of its own; groups
that cancel out to zero documents and tokens are left out of ``totals``; repeated rows count each; empty batches commit
an empty delta, and an empty table gives empty totals. Very long texts are counted whole, piece by piece. Extra columns
are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolith.llm import textkernel as tk

KEYS = ("source", "lang", "version")
DELTA = T.StructType([T.StructField("batch", T.StringType()), *(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])
DEFAULT_RANKS, OTHER_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits a text into words before merging bytes, as the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict[bytes, object] = {}


def _encoding(raw: bytes):
    if raw not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encodings[raw] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[raw]


_LONGEST = 20_000


def count_tokens(encoding, text: str | None) -> int:
    """Tokens of the whole text. Very long texts go piece by piece, cut before a space between words, where no token
    can reach across."""
    if not text:
        return 0
    total, at = 0, 0
    while len(text) - at > _LONGEST:
        cut = at + _LONGEST
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and cut + 1 < len(text) and text[cut + 1].isalnum()):
            cut += 1
        total += len(encoding.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(encoding.encode_ordinary(text[at:]))


@tk.tidy
def _count(batches: Iterator[pa.RecordBatch], raw, text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(raw.value)
    for whole in batches:
        for batch in tk.slices(whole, text):
            n = [count_tokens(encoding, t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "tokens"])


def counted(documents: DataFrame, keep: list[str], text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """The columns ``keep`` with the tokens of each whole text under a byte-level BPE vocabulary."""
    with open(ranks, "rb") as f:
        raw = documents.sparkSession.sparkContext.broadcast(f.read())
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "tokens long"])
    return documents.select(*keep, *([text] if text not in keep else [])).mapInArrow(lambda it: _count(it, raw, text, keep), schema)


def inserts(rows: DataFrame, version: str) -> DataFrame:
    """Signed rows of documents (source, lang, tokens) that came."""
    return rows.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("version"), F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long"))


def deletes(rows: DataFrame, version: str) -> DataFrame:
    return inserts(rows, version).withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})


def revisions(old: DataFrame, old_version: str, new: DataFrame, new_version: str) -> DataFrame:
    """Old counts down, new counts up, in one batch."""
    return deletes(old, old_version).unionByName(inserts(new, new_version))


class Rollup:
    """A rollup under a folder that all executors share: ``batches`` has a folder for each committed batch, and folders
    that stand for several (named with a plus), which say what they cover. Covered folders count no more, whether
    they are deleted yet or not, so compaction takes effect in one rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self) -> list[str]:
        top = self._path(f"{self.root}/batches")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _covered(self, folders: list[str]) -> set[str]:
        """Of these folders those that another one stands for."""
        paths = [f"{self.root}/batches/{n}/covers" for n in folders if n.startswith("+")]
        if not paths:
            return set()
        rows = self.spark.read.schema("folder string").parquet(*paths).where(F.col("folder").isin(folders)).collect()  # as many as folders are there
        return {r[0] for r in rows}

    def _live(self) -> list[str]:
        folders = self._folders()
        covered = self._covered(folders)
        return [n for n in folders if n not in covered]

    @staticmethod
    def _name(batch: str) -> str:
        return base64.urlsafe_b64encode(batch.encode()).decode().rstrip("=") or "="

    def committed(self, batch: str) -> bool:
        """Whether a batch is in, as a folder of its own or folded into another. The ids of folded batches are looked
        through by the executors."""
        if self._fs.exists(self._path(f"{self.root}/batches/{self._name(batch)}")):
            return True
        paths = [f"{self.root}/batches/{n}/ids" for n in self._live() if n.startswith("+")]
        return bool(paths) and not self.spark.read.schema("id string").parquet(*paths).where(F.col("id") == batch).isEmpty()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch once; False if its id is there already."""
        if self.committed(batch):
            return False
        rows = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).select(F.lit(batch).alias("batch"), *KEYS, "documents", "tokens")
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{staged}/deltas")
        return self._publish(staged, self._name(batch))

    def _publish(self, staged: str, name: str) -> bool:
        target = self._path(f"{self.root}/batches/{name}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(staged), target):
            self._fs.delete(self._path(staged), True)
            return False
        inner = self._path(f"{self.root}/batches/{name}/{self._path(staged).getName()}")
        if self._fs.exists(inner):  # another writer was first, and the rename moved into its folder
            self._fs.delete(inner, True)
            return False
        return True

    def deltas(self) -> DataFrame:
        paths = [f"{self.root}/batches/{n}/deltas" for n in self._live()]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens."""
        return self.deltas().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents != 0 or tokens != 0")

    def compact(self) -> bool:
        """Folds all batches into one that knows their ids. One compaction runs at a time (a lock file); a crash at any point
        leaves the totals as they were or as they are, and the next compaction cleans up. False if there was nothing to
        fold or the lock was taken; a lock left by a crash is removed with ``unlock``."""
        lock = self._path(f"{self.root}/compacting")
        if not self._fs.createNewFile(lock):
            return False
        try:
            self._sweep()
            live = self._live()
            if len(live) < 2:
                return False
            staged = f"{self.root}/staged/{uuid.uuid4().hex}"
            rows = self.spark.read.schema(DELTA).parquet(*(f"{self.root}/batches/{n}/deltas" for n in live))
            rows = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            rows.select(F.lit(None).cast("string").alias("batch"), *KEYS, "documents", "tokens").write.parquet(f"{staged}/deltas")
            own = [(base64.urlsafe_b64decode(n + "=" * (-len(n) % 4)).decode(),) for n in live if not n.startswith("+")]
            ids = self.spark.createDataFrame(own, "id string")
            older = [f"{self.root}/batches/{n}/ids" for n in live if n.startswith("+")]
            (ids.union(self.spark.read.schema("id string").parquet(*older)) if older else ids).write.parquet(f"{staged}/ids")
            self.spark.createDataFrame([(n,) for n in live], "folder string").write.parquet(f"{staged}/covers")
            done = self._publish(staged, "+" + uuid.uuid4().hex)
            self._sweep()
            return done
        finally:
            self.unlock()

    def _sweep(self) -> None:
        """Deletes covered folders."""
        for n in sorted(self._covered(self._folders())):
            self._fs.delete(self._path(f"{self.root}/batches/{n}"), True)

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/compacting"), False)
