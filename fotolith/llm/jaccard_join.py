"""N-gram Jaccard join: grouped prefix join with exact verification.

1. ``_sketch``: every task counts its documents' distinct shingles into a fixed array of counters; the sum (4 MB at any
   input size) tells frequent shingles from rare ones. It only sets the order of shingles, never what is found. The level
   of a shingle takes the place of its lowest bits.
2. ``_describe``: each document gets the size and a 128-bit identity of its shingle set, and its prefix: by the order
   (frequency level, hash), the first n - ceil(tn) + 1 shingles. Two sets that reach the similarity share a shingle of
   their prefixes, and at the first such shingle both still have the overlap ahead that their sizes ask for.
3. Equal sets are one node. Documents of equal prefix and size are one group, and only groups meet on shingles, one row a
   group and shingle.
4. Group pairs: within each shingle every group meets the one whose prefix most others share, and of these only the one it
   meets most (a star, one pair a group). Size and prefix bounds filter the pairs, which expand to members and are
   verified on the texts. Linked sets become one component.
5. Groups that share a prefix shingle and have members in different components are counted as pairs: those that share as
   many as similar sets must expand to members and are verified too, so no link between components is lost, while members
   of one component never meet again. Members of one group that the star left apart meet on their second prefix, the next
   n - overlap + 1 shingles, as what they share in the first doesn't tell them apart.

Hot groups: copies collapse in step 3 before they meet anything, near copies are compared with a star's centre first.
Shingles of a high level are dealt over many cells; counts, centres and minima combine on the map side; joins are plain
equi joins that adaptive execution splits when skewed. All text work is a narrow Arrow pass. Intermediate tables are
written to the shared checkpoint folder. Verification compares words, not hashes.

Defined results: a null text, or one without words, has an empty set and is linked with nothing. Fewer words than the
shingle length: the whole sequence is the one shingle. A row without doc_id is linked with nothing, its component_id is
null. Repeated rows give a row each. Rows that share a doc_id are one document, whose links are those of all its texts.
Very long texts are read whole; a pair of texts must fit a worker. Extra columns don't matter; the result has its own
columns only. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolith.llm import bitfilter
from fotolith.llm import textkernel as tk
from fotolith.llm.components import components
from fotolith.llm.scratch import Scratch

WORDS = 5
#: The similarity as a fraction: links have 100 * intersection >= 75 * union.
NUM, DEN = 3, 4
#: Counters of the sketch and slices it is summed in.
BUCKETS, SLICES = 1 << 21, 64
_BUCKET_SHIFT = np.uint64(64 - 21)
_LEVEL = np.uint64(15)
#: Shingles above this level are dealt over 4, 16, 64 ... cells.
_COOL = 6
_MAX_ROWS = 4096


def _pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, _MAX_ROWS):
            yield from tk.slices(whole.slice(k, _MAX_ROWS), text)


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, whether in a word, word starts, ends, rows)."""
    buf, offs = tk.flat(column)
    buf = tk.LOWER[buf]
    inside = tk.NOT_SPACE[buf]
    return buf, inside, *tk.runs(inside, offs)


def _distinct(rows: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shingles)
    order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]
    rows, shingles = rows[order], shingles[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    return rows[new], shingles[new]


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of the distinct shingles, ordered by row and hash."""
    buf, _, starts, ends, row = _words(column)
    words = tk.Prefix(buf).ranges(starts, ends)
    at, shingles = tk.windows(words, row, k)
    rows = row[at]
    count = np.bincount(row, minlength=len(column))
    for n in range(1, k):
        if (count == n).any():
            at, short = tk.windows(words, row, n)
            whole = count[row[at]] == n
            rows, shingles = np.concatenate([rows, row[at[whole]]]), np.concatenate([shingles, tk.mix(short[whole] + np.uint64(n))])
    return _distinct(rows, shingles)


def exact_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle number) of the distinct shingles: equal numbers mean equal words, within the column."""
    buf, inside, starts, ends, row = _words(column)
    offs = np.concatenate([[0], np.cumsum(ends - starts)])
    code = tk.binary_array(buf[inside], offs).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count, many = np.bincount(row, minlength=len(column)), int(code.max(initial=0)) + 1
    rows, shingles, own = [], [], code
    for n in range(1, k + 1):
        if n > 1:
            own = own[: max(len(code) - n + 1, 0)] * many + code[n - 1 :]
            own = np.unique(own, return_inverse=True)[1].astype(np.int64)
        at = np.flatnonzero(row[: len(own)] == row[n - 1 :][: len(own)])
        at = at[(count[row[at]] == n) if n < k else slice(None)]
        rows.append(row[at])
        shingles.append(own[at] * (k + 1) + n)
    return _distinct(np.concatenate(rows), np.concatenate(shingles))


@tk.tidy
def _count(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in _pieces(batches, "text"):
        _, s = shingle_sets(batch.column("text"), k)
        total += np.bincount((s >> _BUCKET_SHIFT).astype(np.int64), minlength=BUCKETS)
    parts = np.minimum(total, 65535).astype(np.uint16).reshape(SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "counts"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint16).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Level of each bucket: 0 up to four standard deviations above the mean, then one more for each doubling. What
    chance puts into a bucket stays below, so levels above 0 mark frequent shingles at any size of the input."""
    parts = docs.mapInArrow(lambda it: _count(it, k), "slice int, counts binary").repartition(8, "slice").mapInArrow(_sum_slices, "slice int, counts binary")
    total = np.zeros((SLICES, BUCKETS // SLICES))
    for r in parts.collect():  # 8 bytes a counter
        total[r[0]] += np.frombuffer(r[1], np.int64)
    total = total.ravel()
    mean = max(total.mean(), 0.25)
    return np.clip(np.floor(np.log2(np.maximum((total - mean) / np.sqrt(mean), 1e-9) / 4)) + 1, 0, 15).astype(np.uint8)


def _ordered(column: pa.Array, k: int, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, shingle with its level, place) by row, level and hash, and the size and start of each row's set."""
    rows = len(column)
    row, s = shingle_sets(column, k)
    n = np.bincount(row, minlength=rows)
    starts = np.cumsum(n) - n
    own = level[(s >> _BUCKET_SHIFT).astype(np.int64)]
    order = np.argsort((row * 16 + own).astype(np.uint16), kind="stable")  # rows stay together
    s = (s[order] & ~_LEVEL) | own[order].astype(np.uint64)
    return row, s, np.arange(len(s)) - starts[row], n, starts


def _prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)


@tk.tidy
def _describe(batches: Iterator[pa.RecordBatch], k: int, levels) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << 16, np.int64)  # groups met lately: a table of fixed size
    for batch in _pieces(batches, "text"):
        rows = batch.num_rows
        row, s, place, n, starts = _ordered(batch.column("text"), k, levels.value)
        ends = starts + n

        def sums(x, starts=starts, ends=ends):
            c = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=c[1:])
            return c[ends] - c[starts]

        size = n.astype(np.uint64)
        s1, s2 = tk.mix(sums(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D))) + size), tk.mix(sums(tk.mix(s + np.uint64(0x14057B7EF767814F))) ^ size)
        length = _prefix_length(n)
        group = tk.mix(sums(np.where(place < length[row], tk.mix(s ^ np.uint64(0x2545F4914F6CDD1D)), np.uint64(0))) ^ tk.mix(size)).view(np.int64)
        linkable = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (n > 0)
        lead = np.zeros(rows, bool)
        own = np.flatnonzero(linkable)
        own = own[np.unique(group[own], return_index=True)[1]]
        slot = group[own] & (len(seen) - 1)
        lead[own[seen[slot] != group[own]]] = True
        seen[slot] = group[own]
        mine = (place < length[row]) & lead[row]
        offsets = np.concatenate([[0], np.cumsum(np.where(lead, length, 0))])
        tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(s[mine].view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(group), pa.array(lead), batch.column("h"), tokens], names=["doc_id", "n", "s1", "s2", "gk", "lead", "h", "prefix"])


@tk.tidy
def _second_prefixes(batches: Iterator[pa.RecordBatch], k: int, levels) -> Iterator[pa.RecordBatch]:
    """The shingles behind the prefix of which sets of equal size and prefix share one if they are similar."""
    for batch in _pieces(batches, "text"):
        row, s, place, n, _ = _ordered(batch.column("text"), k, levels.value)
        first = _prefix_length(n)
        most = n - (2 * NUM * n + NUM + DEN - 1) // (NUM + DEN) + 1
        own = (place >= first[row]) & (place < (first + most)[row])
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row[own])), pa.array(s[own].view(np.int64))], names=["node", "token"])


@tk.tidy
def _needed_texts(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column("key").to_numpy(zero_copy_only=False)
        maybe = np.zeros(len(h), bool)
        maybe[np.unique(h, return_index=True)[1]] = True
        yield batch.filter(pa.array(maybe & bitfilter.might_contain(bits.value, h)))


@tk.tidy
def _verify(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in _pieces(batches, "ta"):
        for batch in tk.slices(whole, "tb"):
            m = batch.num_rows
            row, s = exact_sets(pa.concat_arrays([batch.column("ta"), batch.column("tb")]), k)
            row, s = row % m, s
            order = np.lexsort((s, row))
            row, s = row[order], s[order]
            same = (row[1:] == row[:-1]) & (s[1:] == s[:-1])
            both = np.bincount(row[1:][same], minlength=m)
            union = np.bincount(row, minlength=m) - both
            yield batch.select(["u", "v"]).filter(pa.array((DEN * both >= NUM * union) & (both > 0)))


class JaccardJoin:
    """The join of one table with itself. ``documents`` has doc_id and text."""

    def __init__(self, documents: DataFrame, k: int = WORDS):
        self.spark, self.k = documents.sparkSession, k
        self.docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.scratch = Scratch(self.spark)
        self.levels = self.spark.sparkContext.broadcast(_sketch(self.docs.select("text"), self.k))

    def described(self) -> DataFrame:
        levels, k = self.levels, self.k
        out = self.docs.withColumn("h", F.xxhash64("text")).mapInArrow(lambda it: _describe(it, k, levels), "doc_id long, n long, s1 long, s2 long, gk long, lead boolean, h long, prefix array<bigint>")
        return self.scratch.write(out, "described")

    def _texts(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, text) for sets (node, doc_id, h), written out: the text of the row that the set is named after."""
        bits = bitfilter.build(nodes.select(F.xxhash64("doc_id", "h")))
        h = F.xxhash64("text")
        keyed = self.docs.where("doc_id is not null").select(F.xxhash64("doc_id", h).alias("key"), "doc_id", h.alias("h"), "text")
        texts = keyed.mapInArrow(lambda it: _needed_texts(it, bits), "key long, doc_id long, h long, text string")
        return self.scratch.write(texts.join(nodes, ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"]), name)

    def _links(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) whose texts are similar, written out."""
        k = self.k
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(sets.select("node", "doc_id", "h"), "node")
        texts = self._texts(self.scratch.write(nodes, f"nodes_{name}"), f"texts_{name}")
        left = texts.select(F.col("node").alias("u"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("v"), F.col("text").alias("tb"))
        both = pairs.join(right, "v").join(left, "u").select("u", "v", "ta", "tb")
        out = self.scratch.write(both.mapInArrow(lambda it: _verify(it, k), "u long, v long"), name)
        self.scratch.drop(f"nodes_{name}", f"texts_{name}")
        return out

    #: The shingles that similar sets of nu and nv have in common at least.
    OVERLAP = f"({NUM} * (nu + nv) + {NUM + DEN - 1}) div {NUM + DEN}"

    #: How many shingles the prefixes of similar sets have in common at least: of u's shingles at most nu - overlap are not
    #: in v, and a prefix has n - ceil(tn) + 1 places.
    ENOUGH = f"size(array_intersect(hu, hv)) >= least({OVERLAP} + 1 - ({NUM} * nu + {DEN - 1}) div {DEN}, {OVERLAP} + 1 - ({NUM} * nv + {DEN - 1}) div {DEN})"

    def _sets(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows (doc_id, n, h, node), sets (node, doc_id, h, gk, n) and groups (gk, n, prefix)."""
        s, described = self.scratch, self.described()
        known = described.where("doc_id is not null and n > 0")
        sets = known.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h", "gk", "n")).alias("x")).select("s1", "s2", "x.*")
        # a set is named after its smallest doc_id; further sets of that doc_id get a name by digest
        sets = s.write(sets, "unnamed")
        several = sets.groupBy("doc_id").agg(F.count("*").alias("c"), F.min(F.struct("s1", "s2")).alias("own")).where("c > 1").select("doc_id", "own")
        other = F.col("own").isNotNull() & (F.col("own") != F.struct("s1", "s2"))
        sets = sets.join(several, "doc_id", "left").withColumn("node", F.when(other, F.xxhash64("doc_id", "s1", "s2")).otherwise(F.col("doc_id"))).drop("own")
        sets = s.write(sets, "sets")
        s.drop("unnamed")
        groups = s.write(known.where("lead").groupBy("gk", "n").agg(F.first("prefix").alias("prefix")), "groups")
        linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        rows = described.select("doc_id", "n", "h", "s1", "s2").join(sets.select("s1", "s2", "node"), ["s1", "s2"], "left")
        rows = s.write(rows.select("doc_id", "n", "h", F.when(linkable, F.col("node")).alias("node")), "rows")
        s.drop("described")
        return rows, sets.select("node", "doc_id", "h", "gk", "n"), groups

    def _shared(self, groups: DataFrame) -> DataFrame:
        """(token, gk, n, place, met) of prefix shingles that several groups have."""
        rows = groups.select("gk", "n", F.posexplode("prefix").alias("place", "token"))
        hot = F.expr(f"(token & 15) > {_COOL}")
        dealt = F.expr(f"xxhash64(token, pmod(gk, shiftleft(1L, cast(2 * ((token & 15) - {_COOL}) as int))))")
        rows = rows.select(F.when(hot, dealt).otherwise(F.col("token")).alias("cell"), "token", "gk", "n", F.col("place").cast("int").alias("place"))
        w = Window.partitionBy("cell")
        met = rows.withColumns({"a": F.min("gk").over(w), "b": F.max("gk").over(w), "met": F.count("*").over(w)}).where(F.expr("a < b") | hot)
        # what a cell doesn't see of a hot shingle: how many groups have it in all
        every = rows.where(hot).groupBy("token").agg(F.count("*").alias("every"))
        met = met.join(every, "token", "left").where("every is null or every > 1")
        return self.scratch.write(met.select("token", "gk", "n", "place", F.coalesce("every", "met").alias("met")), "shared")

    def _star(self, shared: DataFrame, groups: DataFrame) -> DataFrame:
        """(gu, nu, gv, nv): each group with the centre it meets most. The centre of a shingle is the group whose prefix
        is shared most, which is nearest to what all were copied from."""
        s = self.scratch
        heat = shared.groupBy("gk", "n").agg(F.sum(F.col("met") - 1).alias("heat")).withColumn("heat", F.col("heat") / (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1))
        warm = s.write(shared.select("token", "gk", "n").join(heat, ["gk", "n"]), "warm")
        centre = warm.groupBy("token").agg(F.max(F.struct("heat", "gk", "n")).alias("c")).select("token", F.col("c.gk").alias("gv"), F.col("c.n").alias("nv"))
        star = warm.select("token", F.col("gk").alias("gu"), F.col("n").alias("nu")).join(centre, "token").where(f"gu != gv and {NUM} * nu <= {DEN} * nv and {NUM} * nv <= {DEN} * nu")
        star = star.groupBy("gu", "nu", "gv", "nv").agg(F.count("*").alias("k"))
        star = star.groupBy("gu", "nu").agg(F.max(F.struct("k", "gv", "nv")).alias("c")).select("gu", "nu", "c.gv", "c.nv")
        return s.write(self._sharing_enough(star, groups), "stars")

    def _sharing_enough(self, pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """The group pairs whose prefixes have enough shingles in common."""
        side = {x: groups.select(F.col("gk").alias(f"g{x}"), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"h{x}")) for x in "uv"}
        return pairs.join(side["u"], ["gu", "nu"]).join(side["v"], ["gv", "nv"]).where(self.ENOUGH).select("gu", "nu", "gv", "nv")

    def _apart(self, shared: DataFrame, parts: DataFrame, groups: DataFrame) -> DataFrame:
        """(gu, nu, gv, nv): pairs of groups with members (gk, n, c) in different components c that share as many prefix
        shingles as similar sets must. A group is one row a shingle, whatever number of components its members are in
        (c is null where they are several)."""
        s, overlap = self.scratch, self.OVERLAP
        own = parts.groupBy("gk", "n").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).select("gk", "n", "lo", "hi", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("c"))
        rows = shared.select("token", "gk", "n", "place").join(own, ["gk", "n"])
        tokens = rows.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("token", "least")
        # a place must let the sets still reach the overlap with the smallest set on the shingle
        least = f"greatest(least, ({NUM} * n + {DEN - 1}) div {DEN})"
        rows = rows.select("token", "gk", "n", "place", "c").join(tokens, "token").where(f"place <= n - ({NUM} * (n + {least}) + {NUM + DEN - 1}) div {NUM + DEN}").drop("least")
        rows = s.write(rows, "apart")
        a, b = (rows.selectExpr("token", f"gk as g{side}", f"n as n{side}", f"place as p{side}", f"c as c{side}") for side in "uv")
        far = f"(cu is null or cv is null or cu != cv) and (nu < nv or nu = nv and gu < gv) and {NUM} * nv <= {DEN} * nu and pu <= nu - {overlap} and pv <= nv - {overlap}"
        met = a.withColumnRenamed("token", "t").join(b, F.expr(f"t = token and {far}"))
        met = s.write(met.select("gu", "nu", "gv", "nv").distinct(), "met")
        return s.write(self._sharing_enough(met, groups), "enough")

    def _inner(self, members: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs of members of one group in different components that share a shingle of their second prefixes."""
        s, k, levels = self.scratch, self.k, self.levels
        split = parts.groupBy("gk", "n").agg(F.count("*").alias("parts")).where("parts > 1").select("gk", "n")
        own = s.write(members.join(split, ["gk", "n"]), "inner")
        if own.isEmpty():
            return own.selectExpr("node as u", "node as v")
        tokens = self._texts(own.select("node", "doc_id", "h"), "texts_inner").mapInArrow(lambda it: _second_prefixes(it, k, levels), "node long, token long")
        rows = s.write(tokens.join(own.select("node", "gk", "n", "c"), "node"), "seconds")
        a, b = (rows.selectExpr("gk", "n", "token", f"node as {side}", f"c as c{side}") for side in "uv")
        return a.join(b, ["gk", "n", "token"]).where("cu != cv and u < v").select("u", "v").distinct()

    def labels(self) -> tuple[DataFrame, DataFrame]:
        """Rows (doc_id, n, h, node) and the components (node, component) of linked sets."""
        s = self.scratch
        rows, sets, groups = self._sets()
        shared = self._shared(groups)
        star = self._star(shared, groups)
        centre = s.write(sets.groupBy("gk", "n").agg(F.min("node").alias("u"), F.count("*").alias("size")), "centres")
        across = star.join(centre.select(F.col("gk").alias("gv"), F.col("n").alias("nv"), "u"), ["gv", "nv"]).join(sets.select(F.col("gk").alias("gu"), F.col("n").alias("nu"), F.col("node").alias("v")), ["gu", "nu"]).select("u", "v")
        within = sets.join(centre.where("size > 1"), ["gk", "n"]).select("u", F.col("node").alias("v"))
        pairs = across.union(within).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = s.write(pairs, "pairs1")
        links = self._links(pairs, sets, "links1")
        first = components(links, s, "c1")

        # what still is apart
        members = s.write(sets.join(first, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "members")
        parts = s.write(members.select("gk", "n", "c").distinct(), "parts")
        side = {x: members.select(F.col("gk").alias(f"g{x}"), F.col("n").alias(f"n{x}"), F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "uv"}
        across = self._apart(shared, parts, groups).join(side["u"], ["gu", "nu"]).join(side["v"], ["gv", "nv"]).where("cu != cv").select("u", "v")
        rest = across.union(self._inner(members, parts)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
        rest = s.write(rest, "pairs2")
        return rows, components(links.union(self._links(rest, sets, "links2")), s, "c2")

    def components(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        s = self.scratch
        rows, found = self.labels()
        # a doc_id with several sets links them, and the name of a component is its smallest doc_id
        own = rows.where("node is not null").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
        several = own.groupBy("doc_id").agg(F.min("c").alias("u"), F.max("c").alias("hi")).where("u < hi").select("doc_id", "u")
        several = own.join(several, "doc_id").select("u", F.col("c").alias("v")).where("u != v").distinct()
        joined = components(s.write(several, "several"), s, "c3")
        named = own.join(joined.select(F.col("node").alias("c"), "component"), "c", "left").select("c", F.coalesce("component", "c").alias("root"), "doc_id")
        names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        names = s.write(named.select("c", "root").distinct().join(names, "root").select("c", "component_id"), "names")
        out = rows.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).join(names, "c", "left")
        out = s.write(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "out")
        s.clear(keep=["out"])
        return out

    def kept(self) -> DataFrame:
        """(doc_id, h) of the rows with a doc_id to keep: of each component the set of the smallest doc_id, and rows
        without words. h is the xxhash64 of the text."""
        s = self.scratch
        rows, found = self.labels()
        own = rows.where("node is not null").join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
        best = own.groupBy("c").agg(F.min(F.struct("doc_id", "node", "h")).alias("x")).select("x.doc_id", "x.h")
        out = s.write(best.union(rows.where("node is null and doc_id is not null").select("doc_id", "h")).distinct(), "kept")
        s.clear(keep=["kept"])
        return out


def join(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents."""
    return JaccardJoin(documents, k).components()


def keep_one(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """The documents of which no other text with a smaller doc_id is linked, directly or not; of rows with the same
    doc_id and text one stays. Rows without doc_id stay, once for each text. Texts of one doc_id that aren't similar are
    documents of their own."""
    kept = JaccardJoin(documents, k).kept().select(F.col("doc_id").alias("__id"), F.col("h").alias("__hash"))
    key, columns = F.col("doc_id").cast("long"), [F.col(f"`{c}`") for c in documents.columns]
    known = documents.where(key.isNotNull()).withColumns({"__id": key, "__hash": F.xxhash64("text")}).join(kept, ["__id", "__hash"]).dropDuplicates(["__id", "__hash"])
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    unknown = documents.where(key.isNull()).withColumns({"__hash": digest, "__null": F.col("text").isNull()}).dropDuplicates(["__hash", "__null"])
    return known.select(*columns).union(unknown.select(*columns))
