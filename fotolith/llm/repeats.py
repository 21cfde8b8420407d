"""Exact repeats of 200 bytes and more: common-prefix interval trees over enhanced suffix arrays, dealt by anchors.

A suffix array of everything doesn't fit anywhere, so the text is dealt so that equal strings meet. Each ``length``-byte
window belongs to its anchor, the smallest hashed ``k``-byte string within it; the windows of one anchor form a segment.
Equal windows have equal anchors at equal places, so only segments of equal anchor hash need to meet:

1. One Arrow pass finds the anchors (about 1.5 % of the bytes) and digests their segments (128 bits of BLAKE2b, so equal
   digests mean equal bytes).
2. Anchors are counted by hash with map-side combining. Those met once hold no repeat. A segment met again is a repeat
   as it is: no text moves for it.
3. The distinct segments of the other hashes, one of each kind, are fetched. Groups of more than ``most`` are cut first
   (``_cut``): windows are dealt again by ranges of their anchor's place, and by all the bytes that the windows of a
   range share, a longer anchor. What fits one group's surroundings only falls out, equal pieces become one, and the
   ranges shrink until a piece is one window, which its bytes decide alone. So each group ends with at most ``most``
   pieces, whatever number of documents holds a passage.
4. Groups are sorted into enhanced suffix arrays, a bounded number of bytes at a time. A stack scan of the common prefixes
   gives the interval tree; an interval whose occurrences differ in the byte to their left is a maximal repeat group.
   ``repeat_groups`` returns the groups with all occurrences; ``report`` takes the bytes that they cover.
5. The runs of each distinct text are joined back to the documents by its digest.

Copies of a text mostly are scanned once a task, and are removed whole since their number says so. Nothing is
collected to the driver but a bit filter of fixed size.

Defined results: null texts count as empty, texts under ``length`` bytes keep everything, repeated rows are copies and
are removed whole (both of them) if long enough, empty tables give empty results. Very long texts are scanned in blocks;
one text and its runs must fit a worker. Ties (equal anchors within a window) go to the leftmost. Extra columns are not
read by ``report``; a column named like one of its results doesn't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.llm import bitfilter
from fotolith.llm import textkernel as tk
from fotolith.llm.scratch import Scratch

LENGTH, K, MOST = 200, 64, 1000
#: Into how many ranges of places a group that is too large is cut.
PARTS = 6
_SLICE = 1 << 19
_BLOCK = 1 << 20
_PLACE = np.uint64((1 << 23) - 1)
_ARRAY_BYTES = 1 << 20
_ROOT = 0x9E3779B97F4A7C55
_SEEN = 1 << 15


def _smallest(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys."""
    span = 1
    while 2 * span <= w:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (w - span)], keys[w - span :]) if w > span else keys


def _rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of the k-byte strings of a buffer. Chance or made collisions only let more segments meet."""
    out = np.zeros(len(buf) - k + 1, np.uint64)
    have, step, at = 1, _ROOT, 0
    power = buf.astype(np.uint64) + np.uint64(1)  # hashes of the next ``have`` bytes, doubled for each bit of k
    while True:
        if k & have:
            out = out * np.uint64(step) + power[at : at + len(out)]
            at += have
        if 2 * have > k:
            return tk.mix(out)
        power = power[:-have] * np.uint64(step) + power[have:]
        have, step = 2 * have, step * step % (1 << 64)


def _digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digests of byte ranges, as two columns."""
    view = memoryview(np.ascontiguousarray(buf))
    blake = hashlib.blake2b
    raw = b"".join(blake(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def anchors(column: pa.Array, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, segment start in the row, segment bytes, anchor place in the segment, start in the buffer)."""
    buf, offs = tk.flat(column)
    n, w = len(buf), length - k + 1
    empty = np.empty(0, np.int64)
    parts = []
    for lo in range(0, n - length + 1, _BLOCK):
        hi = min(lo + _BLOCK, n - length + 1)
        hashes = _rolling(buf[lo : hi + length - 1], k)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_smallest(keys, w) & _PLACE).astype(np.int64)
        s = np.arange(lo, hi)
        row = np.searchsorted(offs, s, "right") - 1
        inside = s + length <= offs[row + 1]
        s, row, place = s[inside], row[inside], place[inside]
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        stop = s[np.append(begin[1:], len(s)) - 1] + length
        start, at, row = s[begin], place[begin], row[begin]
        parts.append((row, hashes[at].view(np.int64), start - offs[row], stop - start, at + lo - start, start))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty,) * 6


class _Recent:
    """Whether a text's digest was met lately: a table of fixed size, which forgets but never errs."""

    def __init__(self):
        self.slots = np.zeros((_SEEN, 2), np.int64)

    def fresh(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        keys = np.stack([h1, h2], 1)
        _, first = np.unique(keys, axis=0, return_index=True)
        out = np.zeros(len(h1), bool)
        out[first] = True
        at = h1 & (_SEEN - 1)
        out &= (self.slots[at] != keys).any(1)
        self.slots[at] = keys
        return out


def _numpy(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


@tk.tidy
def _anchors(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    recent = _Recent()
    for whole in batches:
        whole = whole.filter(pa.array(recent.fresh(*_numpy(whole, "h1", "h2"))))
        for batch in tk.slices(whole, "text", _SLICE):
            buf, _ = tk.flat(batch.column("text"))
            row, kh, start, size, place, at = anchors(batch.column("text"), length, k)
            for lo in range(0, len(row), 20_000):
                own = slice(lo, lo + 20_000)
                g = _digests(buf, at[own], at[own] + size[own])
                h1, h2 = (x[row[own]] for x in _numpy(batch, "h1", "h2"))
                yield _batch(kh=kh[own], g1=g[:, 0], g2=g[:, 1], h1=h1, h2=h2, **{c: x[own].astype(np.int32) for c, x in (("start", start), ("size", size), ("place", place))})


def _only(batches: Iterator[pa.RecordBatch], column: str, bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(bitfilter.might_contain(bits.value, *_numpy(batch, column))))


@tk.tidy
def _wanted_texts(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    recent = _Recent()
    for batch in batches:
        h1, h2 = _numpy(batch, "h1", "h2")
        yield batch.filter(pa.array(bitfilter.might_contain(bits.value, h1) & recent.fresh(h1, h2)))


def _gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of byte ranges put one after the other."""
    offs = np.concatenate([[0], np.cumsum(sizes)])
    return buf[np.repeat(starts - offs[:-1], sizes) + np.arange(offs[-1])], offs


@tk.tidy
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted segments of each text."""
    for whole in batches:
        for batch in tk.slices(whole, "text", _SLICE):
            buf, offs = tk.flat(batch.column("text"))
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            each = wanted.flatten()
            kh, g1, g2, start, size, place, once = (each.field(i).to_numpy(zero_copy_only=False) for i in range(7))
            h1, h2 = (x[row] for x in _numpy(batch, "h1", "h2"))
            for lo in range(0, len(row), 20_000):
                own = slice(lo, lo + 20_000)
                data, at = _gather(buf, offs[row[own]] + start[own], size[own].astype(np.int64))
                yield _batch(kh=kh[own], g1=g1[own], g2=g2[own], h1=h1[own], h2=h2[own], start=start[own], place=place[own], lo=np.zeros(len(row[own]), np.int32), once=once[own], bytes=tk.binary_array(data, at).cast(pa.binary()))


@tk.tidy
def _cut(batches: Iterator[pa.RecordBatch], length: int, k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The pieces of segments, one for each of ``PARTS`` ranges of the anchor's place in a window (``lo`` and the
    ``width`` - 1 after it): they meet again by what all windows of their range share."""
    step = -(-width // PARTS)
    for whole in batches:
        for batch in tk.slices(whole, "bytes", _SLICE):
            buf, offs = tk.flat(batch.column("bytes"))
            kh, g1, g2, h1, h2, start, place, lo, once = _numpy(batch, "kh", "g1", "g2", "h1", "h2", "start", "place", "lo", "once")
            size = np.diff(offs)
            for part in range(PARTS):
                low = lo + part * step
                high = np.minimum(np.minimum(low + step, lo + width) - 1, length - k)
                # a window whose anchor is at o starts at place - o
                first, last = np.maximum(place - high, 0), np.minimum(place - low, size - length)
                own = np.flatnonzero((low <= high) & (first <= last))
                if not len(own):
                    continue
                at, new_size, core = offs[own] + first[own], last[own] + length - first[own], offs[own] + place[own]
                shared = _digests(buf, core - low[own], core - high[own] + length)[:, 0].view(np.uint64)
                key = tk.mix(shared ^ tk.mix(kh[own].view(np.uint64) + (low[own] * 1024 + high[own]).astype(np.uint64))).view(np.int64)
                g = _digests(buf, at, at + new_size)
                data, to = _gather(buf, at, new_size)
                yield _batch(
                    kh=key, g1=g[:, 0], g2=g[:, 1], h1=h1[own], h2=h2[own], once=once[own],
                    **{c: x.astype(np.int32) for c, x in (("start", start[own] + first[own]), ("place", place[own] - first[own]), ("lo", low[own]), ("inner", first[own]))},
                    p_kh=kh[own], p_g1=g1[own], p_g2=g2[own], bytes=tk.binary_array(data, to).cast(pa.binary()),
                )


def suffix_array(data: np.ndarray, offs: np.ndarray, depth: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of at least ``shortest`` bytes of the rows of a buffer, sorted, and each one's common prefix with
    the one before; a suffix ends with its row. Prefix doubling from seven bytes on, to ``depth`` bytes at least."""
    n = len(data)
    ends = np.repeat(offs[1:], np.diff(offs))
    left = ends - np.arange(n)
    rank = np.zeros(n, np.int64)
    for j in range(7):
        rank <<= 9
        inside = left > j
        rank[inside] += data[np.flatnonzero(inside) + j].astype(np.int64) + 1
    levels, step = [], 7
    while True:
        order = np.argsort(rank)
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(rank[order][1:] != rank[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append((step, rank.astype(np.int32)))
        if step >= depth or (n and new[-1] == n - 1):
            break
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > step)
        after[inside] = rank[inside + step] + 1
        rank = rank * (n + 1) + after
        step *= 2
    sa = order[left[order] >= shortest]
    p, q = sa[:-1], sa[1:]
    most = np.minimum(left[p], left[q])
    same = np.zeros(len(p), np.int64)
    for size, rank in reversed(levels):
        going = np.flatnonzero(same < most)
        equal = going[rank[p[going] + same[going]] == rank[q[going] + same[going]]]
        same[equal] = np.minimum(same[equal] + size, most[equal])
    for _ in range(6):  # what is left of seven bytes
        going = np.flatnonzero(same < most)
        going = going[data[p[going] + same[going]] == data[q[going] + same[going]]]
        same[going] += 1
    return sa, np.concatenate([[0], same]) if len(sa) else same


def interval_tree(sa: np.ndarray, lcp: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the suffix array whose suffixes share at least ``shortest`` bytes,
    children before parents."""
    n = len(sa)
    interesting = np.flatnonzero(lcp >= shortest)
    if not len(interesting):
        return
    for part in np.split(interesting, np.flatnonzero(np.diff(interesting) > 1) + 1):
        stack: list[tuple[int, int]] = []
        lo, hi = int(part[0]), int(part[-1])
        values = lcp[lo : hi + 1].tolist() + [0]
        for i, value in enumerate(values, lo):
            first = i - 1
            while stack and stack[-1][0] > value:
                size, first = stack.pop()
                yield size, first, i - 1
            if value >= shortest and (not stack or stack[-1][0] < value):
                stack.append((value, first))
    assert not n or lcp[0] == 0


def maximal_repeats(data: np.ndarray, offs: np.ndarray, shortest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts of all occurrences) of the repeats that can't be longer to the left or right everywhere."""
    sa, lcp = suffix_array(data, offs, int(np.diff(offs).max(initial=0)), shortest)
    before = np.where(np.isin(sa, offs), -1 - np.arange(len(sa)), data[np.maximum(sa - 1, 0)].astype(np.int64))
    change = np.zeros(len(sa) + 1, np.int64)
    change[2:] = np.cumsum(before[1:] != before[:-1])
    for size, first, last in interval_tree(sa, lcp, shortest):
        if change[last + 1] > change[first + 1]:
            yield size, sa[first : last + 1]


def _covered(data: np.ndarray, offs: np.ndarray, shortest: int) -> np.ndarray:
    """Which bytes lie in a repeat."""
    edge = np.zeros(len(data) + 1, np.int64)
    for size, starts in maximal_repeats(data, offs, shortest):
        np.add.at(edge, starts, 1)
        np.subtract.at(edge, starts + size, 1)
    return np.cumsum(edge[:-1]) > 0


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of equal key, sorted by it, in tables of a bounded number of bytes (or one group)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in tk.slices(whole, "bytes", _ARRAY_BYTES):
            (kh,) = _numpy(batch, "kh")
            last = held[-1].column("kh")[-1].as_py() if held else None
            cut = 0
            if size > _ARRAY_BYTES and (other := np.flatnonzero(kh != last)).size:
                cut = int(other[0])
                yield _joined([*held, batch.slice(0, cut)])
                held, size = [], 0
            held.append(batch.slice(cut))
            size += batch.slice(cut).nbytes
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


@tk.tidy
def _arrays(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes in repeats among the pieces of each key."""
    for batch in _held(batches):
        data, offs = tk.flat(batch.column("bytes"))
        h1, h2, start, once = _numpy(batch, "h1", "h2", "start", "once")
        a, b, row = tk.runs(_covered(data, offs, length), offs)
        a, b, row = a[once[row]], b[once[row]], row[once[row]]
        base = start[row] - offs[row]
        yield _batch(h1=h1[row], h2=h2[row], a=(a + base).astype(np.int32), b=(b + base).astype(np.int32))


@tk.tidy
def _occurrences(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The maximal repeat groups among the pieces of each key, a row for each place in a piece."""
    for batch in _held(batches):
        data, offs = tk.flat(batch.column("bytes"))
        kh, g1, g2 = _numpy(batch, "kh", "g1", "g2")
        names, sizes, places = [], [], []
        for size, at in maximal_repeats(data, offs, length):
            names += [hashlib.blake2b(data[at[0] : at[0] + size], digest_size=16).hexdigest()] * len(at)
            sizes.append(np.full(len(at), size, np.int64))
            places.append(at)
        if names:
            at = np.concatenate(places)
            row = np.searchsorted(offs, at, "right") - 1
            yield _batch(group=pa.array(names, pa.string()), length=np.concatenate(sizes), kh=kh[row], g1=g1[row], g2=g2[row], inner=at - offs[row])


def _key(text: Column) -> list[Column]:
    """The first 128 bits of a text's SHA-256, as two numbers."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, a, 16), 16, -10).cast("long").alias(f"h{i}") for i, a in ((1, 1), (2, 17))]


_ID = ["kh", "g1", "g2"]
_PIECE = "kh long, g1 long, g2 long, h1 long, h2 long, start int, place int, lo int, once boolean, bytes binary"
_CUT = "kh long, g1 long, g2 long, h1 long, h2 long, once boolean, start int, place int, lo int, inner int, p_kh long, p_g1 long, p_g2 long, bytes binary"


class Repeats:
    """The repeats of one table's texts, by digest of the text: ``ranges`` of bytes and maximal repeat ``groups``."""

    def __init__(self, documents: DataFrame, text: str = "text", length: int = LENGTH, k: int = K, most: int = MOST):
        if not 1 <= k <= length < 512:
            raise ValueError("an anchor is at most as long as a repeat, and a repeat is looked for by under 512 bytes")
        self.scratch, self.length, self.k, self.most = Scratch(documents.sparkSession), length, k, most
        t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        self.docs = documents.select(*_key(t), t.alias("text")).where(F.octet_length("text") >= length)
        #: What the pieces of a level came from: documents at first, pieces of the level before then.
        self.sources: list[DataFrame] = []
        self.settled: list[DataFrame] = []
        self.ranges = self._found()

    def _found(self) -> DataFrame:
        s, length, k, docs = self.scratch, self.length, self.k, self.docs
        found = s.write(docs.mapInArrow(lambda it: _anchors(it, length, k), "kh long, g1 long, g2 long, h1 long, h2 long, start int, size int, place int"), "anchors")
        again = s.write(found.groupBy("kh").agg(F.count("*").alias("c")).where("c > 1").select("kh"), "again")
        bits = bitfilter.build(again)
        met = s.write(found.mapInArrow(lambda it: _only(it, "kh", bits), found.schema).join(again, "kh"), "met")
        s.drop("anchors", "again")
        self.sources.append(met)
        kinds = met.groupBy(*_ID).agg(F.count("*").alias("c"), F.min(F.struct("h1", "h2", "start", "size", "place")).alias("x"))
        kinds = s.write(kinds.select(*_ID, "c", "x.*"), "kinds")
        same = s.write(met.join(kinds.where("c > 1").select(*_ID), _ID).selectExpr("h1", "h2", "start as a", "start + size as b"), "same")

        # the distinct segments of anchors with several
        counts = self._counts(kinds, 0)
        mixed = s.write(kinds.join(counts.select("kh"), "kh", "left_semi"), "mixed")
        need = bitfilter.build(mixed.select("h1"))
        wanted = mixed.selectExpr("h1", "h2", "struct(kh, g1, g2, start, size, place, c = 1 as once) as x").groupBy("h1", "h2").agg(F.collect_list("x").alias("wanted"))
        texts = docs.mapInArrow(lambda it: _wanted_texts(it, need), "h1 long, h2 long, text string")
        texts = texts.join(wanted, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
        pieces = s.write(texts.mapInArrow(_segments, _PIECE), "pieces0")
        s.drop("kinds", "mixed")
        return same.union(self._arrayed(pieces, counts))

    def _counts(self, kinds: DataFrame, level: int) -> DataFrame:
        return self.scratch.write(kinds.groupBy("kh").agg(F.count("*").alias("kinds")).where("kinds > 1"), f"counts{level}")

    def _arrayed(self, pieces: DataFrame, counts: DataFrame) -> DataFrame:
        """The ranges of repeats among the pieces of each key; too large groups are cut and dealt again."""
        s, length, k = self.scratch, self.length, self.k
        width, level, out = length - k + 1, 0, None
        while True:
            large = counts.where(F.col("kinds") > self.most).select("kh")
            ends = width == 1 or large.isEmpty()
            small = pieces if ends else s.write(pieces.join(large, "kh", "left_anti"), f"settled{level}")
            self.settled.append(small)
            own = self._in_order(small).mapInArrow(lambda it: _arrays(it, length), "h1 long, h2 long, a int, b int")
            own = s.write(own, f"covered{level}")
            out = own if out is None else out.union(own)
            if ends:
                return out
            now = width
            cut = s.write(pieces.join(large, "kh", "left_semi").mapInArrow(lambda it: _cut(it, length, k, now), _CUT), f"cut{level}")
            self.sources.append(cut)
            first = F.min_by(F.struct("h1", "h2", "start", "place", "lo", "bytes"), F.struct("h1", "h2", "start"))
            kinds = s.write(cut.groupBy(*_ID).agg(F.count("*").alias("c"), F.bool_and("once").alias("alone"), first.alias("x")).select(*_ID, "c", "alone", "x.*"), f"cutkinds{level}")
            twice = cut.where("once").join(kinds.where("c > 1").select(*_ID), _ID).selectExpr("h1", "h2", "start as a", "cast(start + length(bytes) as int) as b")
            out = out.union(s.write(twice, f"twice{level}"))
            width, level = -(-width // PARTS), level + 1
            counts = self._counts(kinds, level)
            pieces = kinds.join(counts.select("kh"), "kh", "left_semi").select(*_ID, "h1", "h2", "start", "place", "lo", F.expr("c = 1 and alone").alias("once"), "bytes")
            pieces = s.write(pieces, f"pieces{level}")

    @staticmethod
    def _in_order(pieces: DataFrame) -> DataFrame:
        return pieces.repartition("kh").sortWithinPartitions("kh")

    def groups(self) -> DataFrame:
        """(group, length, h1, h2, start): maximal repeats within the segments of their anchor, and segments that
        repeat as they are, each with all its occurrences; group is a digest of the bytes."""
        length, out = self.length, None
        for level, pieces in enumerate(self.settled):
            own = self._in_order(pieces).mapInArrow(lambda it: _occurrences(it, length), "group string, length long, kh long, g1 long, g2 long, inner long")
            out = self._traced(own, level) if out is None else out.union(self._traced(own, level))
        for level, source in enumerate(self.sources):
            size = F.col("size") if level == 0 else F.length("bytes")
            twice = source.groupBy(*_ID).agg(F.count("*").alias("c"), F.first(size).cast("long").alias("length")).where("c > 1")
            name = F.sha2(F.concat_ws(":", "g1", "g2"), 256)
            out = out.union(self._traced(twice.select(F.substring(name, 1, 32).alias("group"), "length", *_ID, F.lit(0).cast("long").alias("inner")), level))
        return out.distinct()

    def _traced(self, rows: DataFrame, level: int) -> DataFrame:
        """Places in pieces as places in all the texts that have the piece."""
        for source in self.sources[level:0:-1]:
            up = source.select(*_ID, "p_kh", "p_g1", "p_g2", F.col("inner").alias("more"))
            rows = rows.join(up, _ID).select("group", "length", F.col("p_kh").alias("kh"), F.col("p_g1").alias("g1"), F.col("p_g2").alias("g2"), (F.col("inner") + F.col("more")).alias("inner"))
        found = self.sources[0].select(*_ID, "h1", "h2", "start")
        return rows.join(found, _ID).select("group", "length", "h1", "h2", (F.col("start") + F.col("inner")).alias("start"))

    def runs(self) -> DataFrame:
        """(h1, h2, whole, runs) of each distinct text with repeats: whether all of it goes (it has copies), and its
        byte ranges, which may touch or overlap, as numbers start * 2^32 + end."""
        s = self.scratch
        copies = self.docs.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2", F.lit(True).alias("whole"))
        ranges = self.ranges.groupBy("h1", "h2").agg(F.collect_set(F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("runs"))
        both = ranges.join(copies, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("whole", F.lit(False)).alias("whole"), F.expr("case when whole then array() else runs end").cast("array<bigint>").alias("runs"))
        return s.write(both, "runs")

    def close(self) -> None:
        """Drops the tables behind ``ranges`` and ``groups``."""
        self.scratch.clear(keep=["runs"])


@tk.tidy
def _digest(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, "text", _SLICE):
            buf, offs = tk.flat(batch.column("text"))
            n, runs = batch.num_rows, batch.column("runs")
            row = np.repeat(np.arange(n), runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            packed = runs.flatten().to_numpy(zero_copy_only=False)
            all_of = np.flatnonzero(batch.column("whole").fill_null(False).to_numpy(zero_copy_only=False))
            a = np.concatenate([offs[row] + (packed >> 32), offs[all_of]]).astype(np.int64)
            b = np.concatenate([offs[row] + (packed & 0xFFFFFFFF), offs[all_of + 1]]).astype(np.int64)
            gone = np.cumsum((np.bincount(a, minlength=len(buf) + 1) - np.bincount(b, minlength=len(buf) + 1))[:-1]) > 0
            removed = tk.per_row(gone, offs)
            _, _, of = tk.runs(gone, offs)
            kept = memoryview(np.ascontiguousarray(buf[~gone]))
            to = offs - np.concatenate([[0], np.cumsum(removed)])
            sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            yield _batch(**{key: batch.column(key)}, n_bytes=np.diff(offs), n_removed=removed, n_spans=np.bincount(of, minlength=n).astype(np.int64), kept_sha256=pa.array(sha, pa.string()))


def report(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    repeats = Repeats(documents, text, length, **how)
    runs = repeats.runs()
    repeats.close()
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(f"`{key}`"), t.alias("text"), *_key(t)).join(runs, ["h1", "h2"], "left").select(f"`{key}`", "text", "whole", "runs")
    return rows.mapInArrow(lambda it: _digest(it, key), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeat_groups(documents: DataFrame, text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """The repeat groups with all their occurrences: group, length, h1, h2 (the text's digest) and start."""
    return Repeats(documents, text, length, **how).groups()
