"""A bit filter of fixed size over 64-bit keys, built on the executors.

It lets most rows that a later join would drop go early. Its size doesn't grow: with too many keys it lets more rows
through, which costs time but never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fotolith.llm import textkernel as tk

BITS = 1 << 26
PAGE = 1 << 16  # bytes
_SCHEMA = "page int, bits binary"


def _bits(h: np.ndarray) -> list[np.ndarray]:
    x = tk.mix(h.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    shift = np.uint64(64 - (BITS - 1).bit_length())
    return [(x >> shift).astype(np.int64), (tk.mix(x + np.uint64(1)) >> shift).astype(np.int64)]


def _collect(pages: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, x in pages.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["page", "bits"])


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        for bit in _bits(batch.column(0).to_numpy(zero_copy_only=False)):
            bit = np.sort(bit)
            which, first = np.unique(bit // (8 * PAGE), return_index=True)
            for p, own in zip(which.tolist(), np.split(bit % (8 * PAGE), first[1:]), strict=True):
                np.bitwise_or.at(pages.setdefault(p, np.zeros(PAGE, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
    yield from _collect(pages)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("page").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            new = np.frombuffer(raw, np.uint8)
            pages[k] = pages[k] | new if k in pages else new
    yield from _collect(pages)


def build(keys: DataFrame):
    """A broadcast of the filter for a DataFrame of one long column: 8 MB at any number of keys."""
    parts = keys.mapInArrow(_part, _SCHEMA).repartition(8, "page").mapInArrow(_merge, _SCHEMA)
    table = np.zeros((BITS // (8 * PAGE), PAGE), np.uint8)
    for r in parts.collect():  # 128 pages of 64 KB
        table[r[0]] |= np.frombuffer(r[1], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.ravel())


def might_contain(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for b in _bits(h):
        found &= (table[b >> 3] >> (b & 7) & 1).astype(bool)
    return found
