"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over whole batches of texts, measure which share of a
text's characters lies inside duplicated word n-grams and duplicated lines. A row needs nothing but its own text, so
there is no shuffle: one Arrow pass in, one out, and a lost executor only repeats its own partitions.

Defined results: a null or empty text has no words, fails the base rule and is not kept; white-space-only texts
likewise. Very long texts are measured whole, in memory in proportion to the longest. Repeated rows are judged alike, one
result row for each input row. Shares equal to a limit pass it. Other columns of the input pass through
``annotate``; output columns of the same name replace them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm import textkernel as tk

_SYMBOL = tk.byte_set(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
_NEWLINE = 10


@dataclass(frozen=True)
class Rules:
    """Thresholds. ``coverage`` maps an n-gram length in words to the largest share of word characters that
    duplicated n-grams of that length may cover."""

    min_words: int = 10
    max_repeat_percent: int = 20
    coverage: dict[int, float] = field(default_factory=lambda: {2: 0.55, 3: 0.35, 8: 0.20})
    max_dup_line_chars: float = 0.30
    max_symbols_per_word: float = 0.35


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def measure(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The counts and coverages of each text."""
    buf, offs = tk.flat(column)
    rows = len(offs) - 1
    inside = tk.NOT_SPACE[buf]
    starts, ends, row = tk.runs(inside, offs)
    lead = (buf & 0xC0) != 0x80
    prefix = tk.Prefix(buf)
    words = prefix.ranges(starts, ends)
    salt = tk.mix(np.arange(1, rows + 1, dtype=np.uint64))
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside & lead, out=chars[1:])
    word_len = chars[ends] - chars[starts]
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": chars[offs[1:]] - chars[offs[:-1]],
        "n_symbols": tk.per_row(_SYMBOL[buf], offs),
    }
    # lines: cut at \n and at row bounds; only those with a word count
    line_s, line_e, line_row = tk.runs(buf != _NEWLINE, offs)
    word_at = np.zeros(len(buf) + 1, np.int64)
    word_at[starts + 1] = 1
    np.cumsum(word_at, out=word_at)
    has_word = word_at[line_e] > word_at[line_s]
    line_s, line_e, line_row = line_s[has_word], line_e[has_word], line_row[has_word]
    many, again = tk.repeated(prefix.ranges(line_s, line_e) ^ salt[line_row])
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    total = np.maximum(out["word_chars"], 1)
    line_chars = chars[line_e] - chars[line_s]
    out["dup_line_share"] = np.bincount(line_row[again], line_chars[again], minlength=rows) / total
    for n in sorted({5, *rules.coverage}):
        at, keys = tk.windows(words, row, n)
        many, _ = tk.repeated(keys ^ salt[row[at]])
        hit = tk.covered(len(words), at[many], n)
        if n == 5:
            out["n_repeat_words"] = np.bincount(row[hit], minlength=rows)
        if n in rules.coverage:
            out[f"share_{n}"] = np.bincount(row[hit], word_len[hit], minlength=rows) / total
    return out


def judge(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    bad = failed | (m["dup_line_share"] > rules.max_dup_line_chars) | (m["n_symbols"] > rules.max_symbols_per_word * m["n_words"])
    for n, most in rules.coverage.items():
        bad |= m[f"share_{n}"] > most
    return failed, ~bad


@tk.tidy
def _rows(batches: Iterator[pa.RecordBatch], rules: Rules, text: str, keep: list[str], names: list[str], only_kept: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.slices(whole, text):
            m = measure(batch.column(text), rules)
            failed, kept = judge(m, rules)
            if only_kept:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep], names=keep).filter(pa.array(kept))
                continue
            m |= {"base_failed": failed, "kept": kept}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(m[c]) for c in names], names=[*keep, *names])


def annotate(df: DataFrame, text: str = "text", rules: Rules | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with the measures, base_failed and kept. Measures win on a clash of names."""
    rules = rules or Rules()
    shares = ["dup_line_share", *(f"share_{n}" for n in rules.coverage)]
    made = {**_COLUMNS, **dict.fromkeys(shares, "double"), "base_failed": "boolean", "kept": "boolean"}
    through = [c for c in (df.columns if keep is None else keep) if c not in made]
    need = [*through, *([text] if text not in through else [])]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in through), *(f"{c} {t}" for c, t in made.items())])
    return df.select(*(F.col(f"`{c}`") for c in need)).mapInArrow(lambda it: _rows(it, rules, text, through, list(made), False), schema)


def keep_good(df: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    rules, columns = rules or Rules(), df.columns
    return df.mapInArrow(lambda it: _rows(it, rules, text, columns, [], True), df.schema)
