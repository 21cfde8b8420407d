"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is its marked words (a run of space marks and what follows up to the next mark), as no piece has a mark after
another character. Each batch's distinct unknown words are sorted, which walks their trie depth-first: the forward
scores of a word's first characters are those of the word before as far as both agree, and only the rest is computed.
An automaton of the pieces, built as it is walked, gives the pieces that end at a character.

The forward score of a prefix is the best sum, over the pieces that may end there, of the score before the piece, the
piece's own, and that of the border between the two. Unigram models: borders cost nothing. BPE models: sums of the
file's scores alone don't give what merging by rank gives, so a border costs nothing where no merge across it comes before
the merges that made its two sides, and is forbidden (minus infinity) elsewhere; pieces that merging their own
characters doesn't yield are forbidden too. Exactly one way through each prefix is allowed then, the library's, so the
search stops at the first allowed piece. Ids equal the library's (tested against it).

Decoding gathers bytes of pieces in numpy. Encoded texts decode to themselves, save that the mark character U+2581 is
read as a space, as the library does.

Defined results: null and empty texts have no ids. Repeated rows give a row each; extra columns pass through, but columns
of the input named n_tokens, token_ids or round_trip are replaced; empty tables give empty results. Very long texts are
encoded whole, in memory in proportion to the longest text. Memory besides: at most ``CACHE`` words (those of a slice if
they are more) are kept until the task ends, ``BORDERS`` borders and ``STEPS`` steps of the automaton for later tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm import textkernel as tk

MARK = "▁"
CACHE, BORDERS, STEPS = 300_000, 400_000, 400_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SLICE = 1 << 21
_SPACE = 32
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: A character that no piece is, as an item of a path.
_OTHER = -1
_kept: list[tuple[bytes, PieceModel]] = []


class PieceModel:
    """A SentencePiece model from the bytes of its file."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(raw)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are can be used")
        self.kind = m.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self.text = [p.piece for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (_NORMAL, _USER)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        self.scores = {i: m.pieces[i].score for i in self.ids.values()}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == _UNKNOWN)
        self.floor = min(self.scores.values()) - 10.0
        surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else b" \xe2\x81\x87 " if p.type == _UNKNOWN else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        self.sizes = np.array([len(x) for x in surface])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        # BPE: when a piece is merged; single characters are there from the start
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.scores[self.ids[p]], self.ids[p]))
        self.rank = {p: i + 1 for i, p in enumerate(order)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.beside: dict[int, bool] = {}
        # the automaton: a state is the longest end of what was read that begins a piece
        self.begins = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self._forget_steps()
        self._forget_words()

    @staticmethod
    def of(raw: bytes) -> PieceModel:
        """The worker's model: its automaton and borders, which are bounded, serve later tasks too."""
        if not _kept or _kept[0][0] != raw:
            _kept[:] = [(raw, PieceModel(raw))]
        return _kept[0][1]

    def _forget_steps(self) -> None:
        self.states: dict[str, int] = {"": 0}
        self.names = [""]
        self.steps: list[dict[str, int]] = [{}]
        self.ending = [self._ending("")]
        self.n_steps = 0

    def _forget_words(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _step(self, state: int, char: str) -> int:
        """The state after one more character."""
        name = self.names[state] + char
        while name and name not in self.begins:
            name = name[1:]
        # where no piece begins with the character, its states differ by nothing: the empty one
        if (to := self.states.get(name)) is None:
            to = self.states[name] = len(self.names)
            self.names.append(name)
            self.steps.append({})
            self.ending.append(self._ending(name))
        self.steps[state][char] = to
        self.n_steps += 1
        return to

    def _ending(self, name: str) -> list[tuple[int, int]]:
        """(characters, piece) of the allowed pieces at the end of a state, longest first."""
        out = []
        for k in range(len(name)):
            piece = self.ids.get(name[k:])
            if piece is not None and (self.kind == _UNIGRAM or self._whole(name[k:])):
                out.append((len(name) - k, piece))
        if not out or out[-1][0] > 1:
            out.append((1, _OTHER))
        return out

    def _merge(self, word: str) -> list[str]:
        """Merging by rank, leftmost first; the last merge of a piece is kept in ``halves``, of pieces only."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            self.halves.setdefault(parts[at] + parts[at + 1], (parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _whole(self, piece: str) -> bool:
        """Whether merging the piece's own characters yields it."""
        if len(piece) == 1:
            return True
        if piece not in self.halves:
            parts = self._merge(piece)
            if len(parts) > 1:
                self.halves[piece] = ("", "")
        return self.halves[piece] != ("", "")

    def _stable(self, a: str, b: str) -> bool:
        """Walks the merges of both pieces back from the last; a merge across the border must not come earlier."""
        rank, limit = self.rank, len(self.rank) + 2
        while True:
            r = rank.get(a + b)
            if r is not None and r < limit:
                return False
            ra, rb = rank.get(a, 0), rank.get(b, 0)
            if not ra and not rb:
                return True
            # undo the later merge; at the same rank the right one, as the left one came first
            if ra > rb:
                limit, a = ra, self._half(a)[1]
            else:
                limit, b = rb + 1, self._half(b)[0]

    def _half(self, piece: str) -> tuple[str, str]:
        self._whole(piece)
        return self.halves[piece]

    def _border(self, a: int, b: int) -> bool:
        """Whether the border of two pieces is allowed."""
        if a == _OTHER or b == _OTHER:
            return True
        if len(self.beside) >= BORDERS:
            self.beside.clear()
        ok = self.beside[a << 32 | b] = self._stable(self.text[a], self.text[b])
        return ok

    def learn(self, words: list[bytes]) -> None:
        """Adds the ids of sorted distinct words to the cache."""
        if self.n_steps >= STEPS:
            self._forget_steps()
        search = self._bpe if self.kind == _BPE else self._unigram
        # of each prefix: state of the automaton, forward score, characters and number of its last piece
        states, totals, sizes, lasts = [0], [0.0], [0], [_OTHER]
        ids: list[int] = []
        ends: list[int] = []
        before = ""
        for raw in words:
            word = raw.decode().replace(" ", MARK)
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            for column in (states, totals, sizes, lasts):
                del column[shared + 1 :]
            search(word[shared:], states, totals, sizes, lasts)
            end, path = len(word), []
            while end:
                path.append(lasts[end] if lasts[end] != _OTHER else -2 - end)
                end -= sizes[end]
            for piece in reversed(path):
                if piece >= 0:
                    ids.append(piece)
                elif self.byte_ids:
                    ids += [self.byte_ids[x] for x in word[-piece - 3].encode()]
                else:
                    ids.append(self.unknown)
            self.cache[raw] = len(self.at) - 1 + len(ends)
            ends.append(len(ids))
            before = word
        self.flat, self.at = np.concatenate([self.flat, np.array(ids, np.int32)]), np.concatenate([self.at, self.at[-1] + np.array(ends, np.int64)])

    def _bpe(self, rest: str, states: list[int], totals: list[float], sizes: list[int], lasts: list[int]) -> None:
        steps, ending, scores, beside = self.steps, self.ending, self.scores, self.beside
        state, end = states[-1], len(states) - 1
        for char in rest:
            to = steps[state].get(char)
            state = self._step(state, char) if to is None else to
            end += 1
            for size, piece in ending[state]:
                start = end - size
                if start:
                    last = lasts[start]
                    ok = beside.get(last << 32 | piece) if last >= 0 <= piece else True
                    if not (self._border(last, piece) if ok is None else ok):
                        continue
                totals.append(totals[start] + scores.get(piece, 0.0))
                sizes.append(size)
                lasts.append(piece)
                break
            states.append(state)

    def _unigram(self, rest: str, states: list[int], totals: list[float], sizes: list[int], lasts: list[int]) -> None:
        steps, ending, scores, floor = self.steps, self.ending, self.scores, self.floor
        state, end = states[-1], len(states) - 1
        for char in rest:
            to = steps[state].get(char)
            state = self._step(state, char) if to is None else to
            end += 1
            best = None
            for size, piece in ending[state]:
                total = totals[end - size] + scores.get(piece, floor)
                if best is None or total > best[0]:
                    best = total, size, piece
            totals.append(best[0])
            sizes.append(best[1])
            lasts.append(best[2])
            states.append(state)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets) of the texts of a column."""
        column = pc.replace_substring(column, MARK, " ")
        buf, offs = tk.flat(column)
        # a mark in front of each text that isn't empty
        marks = np.diff(offs) > 0
        bounds = offs + np.concatenate([[0], np.cumsum(marks)])
        data = np.empty(bounds[-1], np.uint8)
        inner = np.ones(len(data), bool)
        inner[bounds[:-1][marks]] = False
        data[inner], data[~inner] = buf, _SPACE
        space = data == _SPACE
        first = space.copy()
        first[1:] &= ~space[:-1] | ~inner[1:]
        begin = np.flatnonzero(first)
        words = tk.binary_array(data, np.append(begin, len(data))).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.cache) + len(distinct) > CACHE:
            self._forget_words()
        self.learn(sorted(w for w in distinct if w not in self.cache))
        place = np.fromiter(map(self.cache.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy(zero_copy_only=False)]
        size = self.at[place + 1] - self.at[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[place] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, bounds)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of rows of ids, without the mark in front of a text."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        out = self.bytes[at]
        bounds = np.concatenate([[0], ends])[offsets]
        drop = np.zeros(len(out), bool)
        filled = bounds[:-1][np.diff(bounds) > 0]
        drop[filled[out[filled] == 32]] = True
        gone = np.concatenate([[0], np.cumsum(drop)])
        return out[~drop], bounds - gone[bounds]


@tk.tidy
def _encode(batches: Iterator[pa.RecordBatch], raw, text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    model = PieceModel.of(raw.value)
    try:
        for whole in batches:
            for batch in tk.slices(whole, text, _SLICE):
                column = batch.column(text).fill_null("")
                ids, offsets = model.encode(column)
                back, bounds = model.decode(ids, offsets)
                ok = _rows_equal(back, bounds, *tk.flat(pc.replace_substring(column, MARK, " ")))
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(offsets)), listed, pa.array(ok)], names=[*keep, "n_tokens", "token_ids", "round_trip"])
    finally:
        model._forget_words()


def _rows_equal(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray) -> np.ndarray:
    same = np.diff(ao) == np.diff(bo)
    if len(a) == len(b) and same.all():
        wrong = np.concatenate([[0], np.cumsum(a != b)])
        return wrong[ao[1:]] == wrong[ao[:-1]]
    return np.array([x and a[ao[i] : ao[i + 1]].tobytes() == b[bo[i] : bo[i + 1]].tobytes() for i, x in enumerate(same.tolist())], bool)


def encode(df: DataFrame, text: str = "text", model: str = DEFAULT_MODEL, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with n_tokens, token_ids and round_trip (whether decoding the ids gives the
    text). ``model`` is a path on the driver; the file's bytes (some MB at most) are broadcast."""
    with open(model, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a piece model of more than 64 MB")
    raw = df.sparkSession.sparkContext.broadcast(data)
    PieceModel(data)
    made = {"n_tokens", "token_ids", "round_trip"}
    through = [c for c in (df.columns if keep is None else keep) if c not in made]
    need = [*through, *([text] if text not in through else [])]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in through), "n_tokens long, token_ids array<int>, round_trip boolean"])
    return df.select(*(F.col(f"`{c}`") for c in need)).mapInArrow(lambda it: _encode(it, raw, text, through), schema)


@tk.tidy
def _decode(batches: Iterator[pa.RecordBatch], raw, ids: str, keep: list[str], to: str) -> Iterator[pa.RecordBatch]:
    model = PieceModel.of(raw.value)
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            listed = batch.column(ids)
            offsets = np.concatenate([[0], np.cumsum(listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            data, bounds = model.decode(listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, to])


def decode(df: DataFrame, ids: str = "token_ids", to: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """The rows with the texts of their ids; null ids give an empty text."""
    with open(model, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != to]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{to}` string"])
    return df.mapInArrow(lambda it: _decode(it, raw, ids, keep, to), schema)
