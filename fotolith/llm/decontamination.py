"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is ``n`` consecutive words
of a benchmark item; a shorter item with words is one window. Every task scans its documents' token windows against
a sorted array of window hashes in numpy and verifies each hit word for word, so a hash collision can't mark text.

The benchmark reaches the executors in blocks of at most ``block_bytes`` of text (a fixed bound on what is collected
and broadcast at once; as flat arrays a block takes some four times its text). One block is the usual case; more blocks chain further passes over the same partitions that
carry the hits along, without a shuffle, so any benchmark size gives the same result.

Defined results: null or empty texts have no words and no hits; items without words have no windows; equal items each
count; repeated document rows give a row each; null item ids are left out of the item list but their windows count as
hits; ids of any type count as their text. An empty benchmark leaves everything clean; empty documents give an empty
result. Very long texts are scanned whole. Extra columns pass through, those named like measures too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm import textkernel as tk
from fotolith.llm.scratch import Scratch

N_WORDS = 10
BLOCK_BYTES = 8 << 20
#: Blocks that one pass holds, so that a worker's memory is bounded; further ones take further passes.
GROUP = 4

_HITS, _ITEMS, _N, _AGAIN = "__hits", "__items", "__n_words", "__again"


class Windows:
    """A block of benchmark windows, sorted by hash for each length in words: flat arrays over one buffer of bytes.

    For each length: hashes, first words (of the block's words) and items of the windows in the order of hash, content and
    item, and for each window where the windows of its content end. Windows of one hash nearly always are equal; they
    are told apart by their words here, so a document's words need comparing with one of each content only."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        buf, starts, ends, row, words = tokenise(pa.array([t for _, t in items], pa.large_string()))
        self.names = [i for i, _ in items]
        inside = np.concatenate([buf[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]) if len(starts) else buf[:0]
        self.data, self.offs = inside.tobytes(), np.concatenate([[0], np.cumsum(ends - starts)])
        count = np.bincount(row, minlength=len(items)) if len(items) else np.empty(0, np.int64)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for length in sorted({n, *(int(c) for c in np.unique(count) if 0 < c < n)}):
            at, keys = tk.windows(words, row, length)
            if length < n:
                ok = count[row[at]] == length
                at, keys = at[ok], keys[ok]
            if not len(at):
                continue
            order = np.lexsort((row[at], keys))
            at, keys = at[order], keys[order]
            same = np.flatnonzero(keys[1:] == keys[:-1])
            differ = [k for k in same.tolist() if self.words(at[k], length) != self.words(at[k + 1], length)]
            if differ:  # a hash of several contents: its windows are put in the order of content
                for key in set(keys[differ].tolist()):
                    lo, hi = np.searchsorted(keys, np.uint64(key)), np.searchsorted(keys, np.uint64(key), "right")
                    at[lo:hi] = sorted(at[lo:hi].tolist(), key=lambda i: (self.words(i, length), i))
            new = np.ones(len(at) + 1, bool)
            new[1:-1] = keys[1:] != keys[:-1]
            for key in set(keys[differ].tolist()):
                lo, hi = np.searchsorted(keys, np.uint64(key)), np.searchsorted(keys, np.uint64(key), "right")
                new[lo + 1 : hi] = [self.words(at[k], length) != self.words(at[k - 1], length) for k in range(lo + 1, hi)]
            first = np.flatnonzero(new)
            until = first[np.searchsorted(first, np.arange(len(at)), "right")]
            self.tables[length] = keys, at.astype(np.int32), row[at].astype(np.int32), until.astype(np.int32)

    def words(self, first: int, length: int) -> list[bytes]:
        o = self.offs[first : first + length + 1].tolist()
        return [self.data[x:y] for x, y in zip(o[:-1], o[1:], strict=True)]

    def items_of(self, length: int, key: int, words: list[bytes]) -> set[str | None] | None:
        """The items with a window of exactly these words, or None."""
        keys, at, item, until = self.tables[length]
        k, end = int(np.searchsorted(keys, np.uint64(key))), int(np.searchsorted(keys, np.uint64(key), "right"))
        while k < end:
            if self.words(int(at[k]), length) == words:
                return {self.names[i] for i in np.unique(item[k : until[k]]).tolist()}
            k = int(until[k])
        return None


def tokenise(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, ends, rows, hashes)."""
    buf, offs = tk.flat(column)
    buf = tk.LOWER[buf]
    starts, ends, row = tk.runs(tk.ALNUM[buf], offs)
    return buf, starts, ends, row, tk.Prefix(buf).ranges(starts, ends)


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of keys found in the sorted table; a bitmap of 16 key bits goes first."""
    seen = np.zeros(1 << 16, bool)
    seen[(table >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(keys >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, keys[maybe]), len(table) - 1)
    return maybe[table[at] == keys[maybe]]


def scan(column: pa.Array, block: Windows) -> tuple[list[bytes | None], list[list], np.ndarray]:
    """For each text: start and width of its hit windows as int32 pairs, the items found, and the number of words."""
    buf, starts, ends, row, words = tokenise(column)
    first = np.searchsorted(row, np.arange(len(column)))
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set] = {}
    for length, (table, *_) in block.tables.items():
        at, keys = tk.windows(words, row, length)
        known: dict[int, tuple[list[bytes], set | None]] = {}
        for k in _member(keys, table).tolist():
            i, r, key = int(at[k]), int(row[at[k]]), int(keys[k])
            own = [buf[starts[j] : ends[j]].tobytes() for j in range(i, i + length)]
            if key not in known or known[key][0] != own:
                known[key] = own, block.items_of(length, key, own)
            if (who := known[key][1]) is not None:
                spans.setdefault(r, []).append((i - int(first[r]), length))
                items.setdefault(r, set()).update(who)
    hits = [np.array(spans[r], np.int32).tobytes() if r in spans else None for r in range(len(column))]
    return hits, [sorted(x for x in items.get(r, ()) if x is not None) for r in range(len(column))], np.bincount(row, minlength=len(column))


def _scan_all(column: pa.Array, group: list) -> tuple[list[bytes | None], list[list], np.ndarray]:
    """``scan`` over several broadcast blocks."""
    hits, items, n = scan(column, group[0].value)
    for bc in group[1:]:
        more, who, _ = scan(column, bc.value)
        hits = [(a or b"") + (b or b"") or None for a, b in zip(hits, more, strict=True)]
        items = [sorted({*a, *b}) for a, b in zip(items, who, strict=True)]
    return hits, items, n


@tk.tidy
def _pass(batches: Iterator[pa.RecordBatch], group: list, text: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, text):
            hits, items, n = _scan_all(batch.column(text), group)
            had = batch.column(_HITS).to_pylist()
            had_items = batch.column(_ITEMS).to_pylist()
            cols = {c: batch.column(c) for c in batch.schema.names}
            cols[_HITS] = pa.array([(a or b"") + (b or b"") or None for a, b in zip(had, hits, strict=True)], pa.binary())
            cols[_ITEMS] = pa.array([sorted({*(a or ()), *b}) for a, b in zip(had_items, items, strict=True)], pa.list_(pa.string()))
            cols[_N] = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in bounded blocks, a partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(r[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


def prepared(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", n: int = N_WORDS, block_bytes: int = BLOCK_BYTES) -> list[list]:
    """The broadcasts of a benchmark's blocks, in groups of at most ``GROUP``."""
    sc = benchmark.sparkSession.sparkContext
    every = [sc.broadcast(Windows(block, n)) for block in blocks(benchmark, item, item_text, block_bytes)]
    return [every[k : k + GROUP] for k in range(0, len(every), GROUP)]


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N_WORDS, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, windows: list | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) plus ``__hits`` (int32 pairs: first word, width), ``__items`` (ids as text) and
    ``__n_words``. ``windows``: the benchmark as ``prepared`` gives it, if it is there already."""
    own = {_HITS, _ITEMS, _N}
    through = [c for c in (docs.columns if keep is None else keep) if c not in own]
    need = [*through, *([text] if text not in through else [])]
    df = docs.select(*(F.col(f"`{c}`") for c in need), F.lit(None).cast("binary").alias(_HITS), F.lit(None).cast("array<string>").alias(_ITEMS), F.lit(0).cast("long").alias(_N))
    scratch = None
    for k, group in enumerate(prepared(benchmark, item, item_text, n, block_bytes) if windows is None else windows):
        if k:  # a pass has Python workers of its own: no two in one task
            scratch = scratch or Scratch(docs.sparkSession)
            df = scratch.write(df, f"pass{k}")
        df = df.mapInArrow(lambda it, group=group: _pass(it, group, text), df.schema)
    return df.select(*(F.col(f"`{c}`") for c in through), _HITS, _ITEMS, _N)


def _word_mask(hits: bytes | None, n: int) -> np.ndarray:
    mask = np.zeros(n, bool)
    for a, width in np.frombuffer(hits or b"", np.int32).reshape(-1, 2).tolist():
        mask[a : a + width] = True
    return mask


def _digested(keys: list[pa.Array], keep: list[str], hits: list[bytes | None], items: list[list | None], n: list[int]) -> pa.RecordBatch:
    hit = [int(_word_mask(h, k).sum()) if h else 0 for h, k in zip(hits, n, strict=True)]
    sha = [hashlib.sha256(",".join(sorted(x or ())).encode()).hexdigest() for x in items]
    cols = [*keys, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x or ()) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


@tk.tidy
def _digest(batches: Iterator[pa.RecordBatch], keep: list[str], group: list | None, text: str) -> Iterator[pa.RecordBatch]:
    """Scans (or takes what was found before) and digests in one go."""
    for whole in batches:
        if group is None:
            yield _digested([whole.column(c) for c in keep], keep, whole.column(_HITS).to_pylist(), whole.column(_ITEMS).to_pylist(), whole.column(_N).to_pylist())
            continue
        for batch in tk.slices(whole, text):
            hits, items, n = _scan_all(batch.column(text), group)
            yield _digested([batch.column(c) for c in keep], keep, hits, items, n.tolist())


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", *, text: str = "text", **how) -> DataFrame:
    """For each document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    windows = prepared(benchmark, **how)
    if len(windows) == 1:
        (group,) = windows
        rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((key, text))))
        return rows.mapInArrow(lambda it: _digest(it, [key], group, text), schema)
    found = Scratch(docs.sparkSession).write(find(docs, benchmark, text=text, keep=[key], windows=windows), "found")
    return found.mapInArrow(lambda it: _digest(it, [key], None, text), schema)


def _without_spans(text: str | None, hits: bytes | None) -> str | None:
    """The text without its hit words, from the first to the last character of each run of hit words."""
    if text is None or not hits:
        return text
    raw = text.encode()
    _, starts, ends, _, _ = tokenise(pa.array([text], pa.large_string()))
    mask = _word_mask(hits, len(starts))
    out, at = [], 0
    for a, b, _ in zip(*tk.runs(mask, np.array([0, len(mask)])), strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


@tk.tidy
def _remove(batches: Iterator[pa.RecordBatch], text: str, columns: list[str], max_share: float) -> Iterator[pa.RecordBatch]:
    """Cuts the hits out of ``text``; the column of texts to scan again has those that were changed, else null."""
    for whole in batches:
        for batch in tk.slices(whole, text):
            hits, kind = batch.column(_HITS), batch.schema.field(text).type
            new, stays = batch.column(text), None
            again: pa.Array = pa.nulls(batch.num_rows, batch.schema.field(_AGAIN).type)
            if hits.null_count < len(hits):
                had, n = hits.to_pylist(), batch.column(_N).to_pylist()
                stays = [not h or bool(_word_mask(h, k).sum() <= max_share * k) for h, k in zip(had, n, strict=True)]
                made = [_without_spans(t, h) if h and s else t for t, h, s in zip(batch.column(text).to_pylist(), had, stays, strict=True)]
                new, again = pa.array(made, kind), pa.array([t if h else None for t, h in zip(made, had, strict=True)], kind)
            cols = {c: batch.column(c) for c in columns} | {text: new, _AGAIN: again}
            out = pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns)
            yield out if stays is None else out.filter(pa.array(stays))


#: How often a changed text is scanned again, as what stood before and after a passage may make up a new one.
ROUNDS = 3


@tk.tidy
def _clean(batches: Iterator[pa.RecordBatch], group: list, text: str, columns: list[str], max_share: float) -> Iterator[pa.RecordBatch]:
    """All rounds of one group of blocks: scan, cut, and scan again what was cut."""
    for whole in batches:
        for batch in tk.slices(whole, text):
            hits, _, n = _scan_all(batch.column(text), group)
            at = [i for i, h in enumerate(hits) if h]
            if not at:
                yield batch.select(columns)
                continue
            texts, stays = batch.column(text).to_pylist(), np.ones(batch.num_rows, bool)
            found, sizes = [hits[i] for i in at], [int(n[i]) for i in at]
            for k in range(ROUNDS):
                if k == ROUNDS - 1:
                    stays[at] = False
                    break
                for i, h, size in zip(at, found, sizes, strict=True):
                    if _word_mask(h, size).sum() <= max_share * size:
                        texts[i] = _without_spans(texts[i], h)
                    else:
                        stays[i] = False
                at = [i for i in at if stays[i]]
                again, _, n = _scan_all(pa.array([texts[i] for i in at], pa.large_string()), group)
                found, sizes = [h for h in again if h], [int(x) for x, h in zip(n, again, strict=True) if h]
                at = [i for i, h in zip(at, again, strict=True) if h]
                if not at:
                    break
            new = pa.array(texts, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([new if c == text else batch.column(c) for c in columns], names=columns).filter(pa.array(stays))


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", whole_documents: bool = False, max_share: float = 0.5, **how) -> DataFrame:
    """The documents without contaminated spans, with the columns they came with. Documents of which more than
    ``max_share`` of the words are hit go altogether, and with ``whole_documents`` every contaminated one goes. Texts that
    were changed are scanned again, and once more; those that still have hits go altogether."""
    columns, windows = docs.columns, prepared(benchmark, **how)
    own = [F.col(f"`{c}`") for c in columns]
    if whole_documents:
        return find(docs, benchmark, text=text, windows=windows).where(F.col(_HITS).isNull()).select(*own)
    if len(windows) == 1:
        (group,) = windows
        return docs.mapInArrow(lambda it: _clean(it, group, text, columns, max_share), docs.schema)
    # a benchmark of several groups: each pass and each cut is written, as all groups must be seen before a cut
    scratch, rows = Scratch(docs.sparkSession), docs.withColumns({_AGAIN: F.col(f"`{text}`")})
    for k in range(ROUNDS):
        # only texts that are new are scanned: at first all, then those that the round before has changed
        found = scratch.write(find(rows, benchmark, text=_AGAIN, windows=windows), f"found{k}")
        if k == ROUNDS - 1:
            return found.where(F.col(_HITS).isNull()).select(*own)
        rows = scratch.write(found.mapInArrow(lambda it: _remove(it, text, [*columns, _AGAIN], max_share), rows.schema), f"cut{k}")
