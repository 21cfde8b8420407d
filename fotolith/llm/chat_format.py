"""Chat formatting by columnar byte assembly.

A conversation becomes ``<s>``, then for each turn ``<|role|>``, a newline, the text, ``<|end|>`` and a newline, then
``</s>``. Control strings start with ``<`` or ``[``; inside roles and texts these two, ``|`` and the backslash get a
backslash in front, so no text can forge a mark, and ``parse`` gives back exactly what was formatted.

Rows are dealt by conversation and sorted by turn within the partition (Spark spills that); a batch is assembled in
numpy: segment lengths, cumulative offsets and scatter indices place the bytes of headers and contents in one
preallocated Arrow buffer. No Python object is made per turn. The loss mask is the spans of assistant texts.

Defined results: null role or text counts as empty; turns come by turn number, null first, ties by role, then text;
repeated rows are turns of their own; rows with a null conversation id make one conversation. Extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm import textkernel as tk

_ESCAPED = tk.byte_set(*[(ord(c), ord(c)) for c in "\\<[|"])
_OPEN, _CLOSE, _END, _FIRST, _LAST = (np.frombuffer(x, np.uint8) for x in (b"<|", b"|>\n", b"<|end|>\n", b"<s>", b"</s>"))
LOSS_ROLE = "assistant"
_TURN = re.compile(r"<\|((?:[^\\<\[|]|\\.)*)\|>\n((?:[^\\<\[|]|\\.)*)<\|end\|>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def _escape_lengths(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which bytes get a backslash, how many up to each byte, escaped length of each row)."""
    flag = _ESCAPED[buf]
    upto = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(flag, out=upto[1:])
    return flag, upto, np.diff(offs) + upto[offs[1:]] - upto[offs[:-1]]


def _scatter(out: np.ndarray, to: np.ndarray, buf: np.ndarray, offs: np.ndarray, flag: np.ndarray, upto: np.ndarray) -> None:
    """Writes the rows of a column, escaped, to their places."""
    row_shift = np.repeat(to - offs[:-1] - upto[offs[:-1]], np.diff(offs))
    at = np.arange(len(buf)) + row_shift + upto[1:]
    out[at] = buf
    out[at[flag] - 1] = ord("\\")


def _constant(out: np.ndarray, to: np.ndarray, what: np.ndarray) -> None:
    out[(to[:, None] + np.arange(len(what))).ravel()] = np.tile(what, len(to))


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(formatted texts, loss spans in code points, first row of each conversation) for rows of whole conversations."""
    n = len(conv)
    first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if n else np.empty(0, np.int64)
    starts_conv, ends_conv = np.zeros(n, bool), np.zeros(n, bool)
    starts_conv[first] = True
    ends_conv[np.append(first[1:], n)[: len(first)] - 1] = True
    (rb, ro), (tb, to) = tk.flat(roles), tk.flat(texts)
    (rf, ru, rl), (tf, tu, tl) = _escape_lengths(rb, ro), _escape_lengths(tb, to)
    lead = np.where(starts_conv, len(_FIRST), 0)
    size = lead + len(_OPEN) + rl + len(_CLOSE) + tl + len(_END) + np.where(ends_conv, len(_LAST), 0)
    offs = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offs[-1], np.uint8)
    begin = offs[:-1] + lead
    text_at = begin + len(_OPEN) + rl + len(_CLOSE)
    _constant(out, offs[:-1][starts_conv], _FIRST)
    _constant(out, begin, _OPEN)
    _scatter(out, begin + len(_OPEN), rb, ro, rf, ru)
    _constant(out, text_at - len(_CLOSE), _CLOSE)
    _scatter(out, text_at, tb, to, tf, tu)
    _constant(out, text_at + tl, _END)
    _constant(out, offs[1:][ends_conv] - len(_LAST), _LAST)
    ends = np.append(offs[:-1][first[1:]], offs[-1]) if len(first) else np.empty(0, np.int64)
    bounds = np.concatenate([[0], ends]).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    chars = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
    loss = np.asarray(pc.equal(roles.fill_null(""), LOSS_ROLE).to_numpy(zero_copy_only=False)) & (tl > 0)
    which = np.searchsorted(first, np.flatnonzero(loss), "right") - 1
    base = chars[bounds[:-1]][which] if len(first) else np.empty(0, np.int64)
    a, b = chars[text_at[loss]] - base, chars[(text_at + tl)[loss]] - base
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))]), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["start", "stop"]))
    return formatted, spans, first


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        conv, roles, texts = (table.column(c).combine_chunks() for c in ("conv_id", "role", "text"))
        # equal neighbours are one conversation; nulls stand together since the rows are sorted
        number = np.concatenate([[0], np.cumsum(_changes(conv))])
        formatted, spans, first = assemble(number, roles, texts)
        turns = np.diff(np.append(first, len(number)))
        cols = [conv.take(pa.array(first)), pa.array(turns.astype(np.int64)), formatted.cast(pa.string()), spans]
        yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "formatted", "loss"])

    for whole in batches:
        for batch in tk.slices(whole, "text"):
            change = np.flatnonzero(_changes(batch.column("conv_id"))) + 1
            if held and not _equal(held[-1].column("conv_id")[-1], batch.column("conv_id")[0]):
                yield from done(held)
                held = []
            if len(change):
                last = int(change[-1])
                yield from done([*held, batch.slice(0, last)])
                held, batch = [], batch.slice(last)
            held.append(batch)
    if held:
        yield from done(held)


def _equal(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null equals null."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~np.asarray(same.to_numpy(zero_copy_only=False), bool)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted and loss (spans of code points under the loss mask) of each conversation."""
    kind = rows.schema[conv].dataType.simpleString()
    c = [F.col(f"`{x}`") for x in (conv, turn, role, text)]
    tidy = rows.select(c[0].alias("conv_id"), c[1].alias("turn"), c[2].cast("string").alias("role"), c[3].cast("string").alias("text"))
    dealt = tidy.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, f"conv_id {kind}, n_turns long, formatted string, loss array<struct<start:long,stop:long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    if not (formatted.startswith("<s>") and formatted.endswith("</s>")):
        raise ValueError("not a formatted conversation")
    out, at = [], 3
    while at < len(formatted) - 4:
        if (m := _TURN.match(formatted, at)) is None:
            raise ValueError(f"no turn at {at}")
        out.append((_UNESCAPE.sub(r"\1", m[1]), _UNESCAPE.sub(r"\1", m[2])))
        at = m.end()
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = parse(formatted)
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            learnt = "".join(_UNESCAPE.sub(r"\1", formatted[x["start"] : x["stop"]]) for x in loss)
            made.append((len(turns), sha, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *cols], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds in them."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
