"""Byte-level BPE encoding as a lazily determinised transducer, and streaming decoding.

Merges are compiled into one observation: a sequence of tokens is the BPE encoding of its bytes exactly if each two
adjacent tokens are what BPE gives for their joint bytes. The transducer reads bytes; its non-deterministic states are
(tokens guessed but not yet certain, place in the token trie). Subsets of them are determinised as they are met; a token
is emitted once all surviving guesses agree on it, which takes a lookahead of at most the longest token. Time is linear
in the text, whatever the length of a run without boundaries. Words of ordinary length are encoded once in a process and
kept; they run through the same configurations without determinising them, which pays only for what comes again.

Null and empty texts have an empty list of ids. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.staging import spread

#: Where the public vocabularies lie on the driver's machine, which sends them on; a parameter of all operators below.
TOKENIZER_DIR = os.environ.get("REVIEWLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"

# Fixed value: the pattern that splits text before the merges, as published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same with white space as the Unicode property, whatever \s means to the regex library.
_SPLIT = regex.compile(SPLIT.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
# The same for texts of ASCII alone, where the faster library will do.
_SPLIT_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Bounds of the memory that a worker keeps between texts; beyond them it starts afresh, results don't change.
MEMO_WORDS, MEMO_CHARS, MAX_STATES = 150_000, 48, 60_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class _State:
    """A determinised state; ``step`` holds the transitions met so far as (next state, tokens emitted)."""

    __slots__ = ("configs", "last", "step", "final")

    def __init__(self, last: int, configs: tuple) -> None:
        self.last, self.configs, self.step, self.final = last, configs, {}, None


class _Memo(dict):
    """Ids of pre-tokens, computed when first asked for; long ones are not kept."""

    def __init__(self, encode, run) -> None:
        super().__init__()
        self._encode, self._run = encode, run

    def __missing__(self, w: str) -> list[int]:
        if len(w) > MEMO_CHARS:
            return self._encode(w.encode("utf-8"))
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = self[w] = self._run(w.encode("utf-8"))
        return ids


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._edge: dict[int, int] = {}
        self._token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                node = self._edge.get(key) or self._grow(key)
            self._token_at[node] = rank
        self._fits: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self.ids_of = _Memo(self.encode_bytes, self.run_once)
        self._reset()

    def _grow(self, key: int) -> int:
        self._token_at.append(-1)
        self._edge[key] = len(self._token_at) - 1
        return self._edge[key]

    def _reset(self) -> None:
        self._states: dict[tuple, _State] = {}
        self._start = self._state(-1, (((), 0),))

    def _state(self, last: int, configs: tuple) -> _State:
        key = (last, configs)
        found = self._states.get(key)
        if found is None:
            found = self._states[key] = _State(last, configs)
        return found

    def merged(self, data: bytes, below: int = 1 << 40) -> list[int]:
        """BPE by its definition: the leftmost pair of lowest rank is merged until no pair is a token of a rank ``below`` the given one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < below and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``; None for a single byte, and for a token that merges don't reach."""
        if token not in self._split:
            data = self.bytes_of[token]
            parts = self.merged(data, token) if len(data) > 1 else []
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between the tokens a and b.

        Merges are undone from the latest back, on the side that was merged last. The boundary falls if what touches it at
        some time has a merge that comes before all that were undone.
        """
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._boundary_holds(a, b)
        return known

    def _boundary_holds(self, a: int, b: int) -> bool:
        ranks, bytes_of = self.ranks, self.bytes_of
        undone_left, undone_right = 1 << 40, 1 << 40
        while True:
            joint = ranks.get(bytes_of[a] + bytes_of[b])
            # Of equal merges the leftmost is first: one at the boundary precedes one to its right, but not one to its left.
            if joint is not None and joint < undone_left and joint <= undone_right:
                return False
            left, right = self._halves(a), self._halves(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                undone_left, undone_right = min(undone_left, a), min(undone_right, a)
                a = left[1]
            else:
                undone_left, undone_right = min(undone_left, b + 1), min(undone_right, b)
                b = right[0]

    def _advance(self, state: _State, b: int) -> tuple[_State, tuple]:
        configs = []
        for pending, node in state.configs:
            child = self._edge.get(node << 8 | b)
            if child is None:
                continue
            configs.append((pending, child))
            token = self._token_at[child]
            if token >= 0:
                before = pending[-1] if pending else state.last
                if before < 0 or self.fits(before, token):
                    configs.append(((*pending, token), 0))
        first = configs[0][0]
        sure = min(len(p) for p, _ in configs)
        k = 0
        while k < sure and all(p[k] == first[k] for p, _ in configs):
            k += 1
        emitted = first[:k]
        last = emitted[-1] if emitted else state.last
        target = self._state(last, tuple(sorted((p[k:], n) for p, n in configs)))
        state.step[b] = (target, emitted)
        return state.step[b]

    def _final(self, state: _State) -> tuple:
        state.final = next(p for p, n in state.configs if n == 0)
        return state.final

    def run_once(self, data: bytes) -> list[int]:
        """The ids of a pre-token by one run through the transducer's configurations as they are, without determinising them.

        Pre-tokens that are kept once encoded don't come again, so states made for them would be used but once. A prefix has
        one encoding, so a configuration is where its unfinished token starts and its place in the trie.
        """
        token = self.ranks.get(data)
        if token is not None:
            return [token]
        edge, token_at, fits = self._edge, self._token_at, self.fits
        last, start = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        live: list[tuple[int, int]] = []
        for i, b in enumerate(data):
            live.append((i, 0))
            grown = []
            for s, node in live:
                child = edge.get(node << 8 | b)
                if child is not None:
                    grown.append((s, child))
                    t = token_at[child]
                    if t >= 0 and last[i + 1] < 0 and (not s or fits(last[s], t)):
                        last[i + 1], start[i + 1] = t, s
            live = grown
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return out

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        token = self.ranks.get(data)
        if token is not None:
            return [token]
        if len(self._states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state = self._start
        for b in data:
            state, emitted = state.step.get(b) or self._advance(state, b)
            if emitted:
                out += emitted
                if len(self._states) > 2 * MAX_STATES:  # within one long run; the state at hand stays valid
                    self._reset()
        out += state.final if state.final is not None else self._final(state)
        return out

    def words(self, text: str) -> list[str]:
        """The pre-tokens; joined they are the text."""
        return (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)

    def sizes(self, words: list[str]) -> list[int]:
        """The number of tokens of each pre-token."""
        return list(map(len, map(self.ids_of.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of.__getitem__, self.words(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.ids_of.__getitem__, self.words(text)))) if text else 0


def _utf8_machine() -> list[dict[int, int]]:
    """Transitions of the UTF-8 automaton by state: 0 is between characters, others await continuation bytes."""
    cont = range(0x80, 0xC0)
    machine: list[dict[int, int]] = [{b: 0 for b in range(0x80)}, dict.fromkeys(cont, 0), dict.fromkeys(cont, 1), dict.fromkeys(cont, 2)]
    one, two, three = 1, 2, 3
    machine[0].update(dict.fromkeys(range(0xC2, 0xE0), one))
    machine[0].update(dict.fromkeys(range(0xE1, 0xF0), two))
    machine[0].update(dict.fromkeys(range(0xF1, 0xF4), three))
    # Leads whose second byte is narrowed: no overlong forms, no surrogates, nothing beyond U+10FFFF.
    for lead, second, after in ((0xE0, range(0xA0, 0xC0), one), (0xED, range(0x80, 0xA0), one), (0xF0, range(0x90, 0xC0), two), (0xF4, range(0x80, 0x90), two)):
        machine.append(dict.fromkeys(second, after))
        machine[0][lead] = len(machine) - 1
    return machine


class StreamDecoder:
    """Decodes ids piece by piece; characters come out as soon as their last byte is in.

    Malformed bytes come out as U+FFFD, one for each maximal part of a sequence, as Python's ``replace`` does.
    """

    _machine = _utf8_machine()

    def __init__(self, bpe: ByteBPE) -> None:
        self._bytes_of = bpe.bytes_of
        self._state, self._held = 0, b""
        self._known: dict[tuple[int, bytes, int], tuple[str, int, bytes]] = {}

    def _feed(self, token: int) -> tuple[str, int, bytes]:
        state, held, out = self._state, bytearray(self._held), []
        for b in self._bytes_of[token]:
            following = self._machine[state].get(b)
            if following is None and state:
                out.append("�")
                held.clear()
                state, following = 0, self._machine[0].get(b)
            if following is None:
                out.append("�")
                continue
            held.append(b)
            state = following
            if not state:
                out.append(held.decode("utf-8"))
                held.clear()
        return "".join(out), state, bytes(held)

    def push(self, ids: list[int]) -> str:
        out = []
        for t in ids:
            key = (self._state, self._held, t)
            known = self._known.get(key)
            if known is None:
                if len(self._known) > 300_000:
                    self._known.clear()
                known = self._known[key] = self._feed(t)
            s, self._state, self._held = known
            out.append(s)
        return "".join(out)

    def close(self) -> str:
        rest = "�" if self._held else ""
        self._state, self._held = 0, b""
        return rest


_loaded: dict[str, ByteBPE] = {}


def _path(directory: str, name: str) -> str:
    return os.path.join(directory, f"{name}.tiktoken")


def bpe(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> ByteBPE:
    """The tokenizer of this process; the vocabulary is read once."""
    path = _path(directory, name)
    if path not in _loaded:
        _loaded[path] = ByteBPE(read_ranks(path))
    return _loaded[path]


class Vocabulary:
    """A vocabulary read on the driver and sent to the workers (some 50,000 byte strings): they need no such file."""

    def __init__(self, spark: SparkSession, directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> None:
        self.path = _path(directory, name)
        self.ranks = spark.sparkContext.broadcast(read_ranks(self.path))

    def bpe(self) -> ByteBPE:
        """The tokenizer of the worker's process, which is kept from task to task."""
        if self.path not in _loaded:
            _loaded[self.path] = ByteBPE(self.ranks.value)
        return _loaded[self.path]


def int_lists(rows: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.empty(offsets[-1], np.int32)
    for row, at in zip(rows, offsets):
        flat[at : at + len(row)] = row
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_column(df: DataFrame, key: str, text: str, directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; null and empty texts have an empty list. Other columns are left out."""
    vocabulary = Vocabulary(df.sparkSession, directory, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = vocabulary.bpe()
        for batch in batches:
            # Ids are built for some rows at a time, so that a batch of very long texts stays small.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = int_lists([t.encode(x) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_column(df: DataFrame, key: str, text: str, out: str = "n_tokens", directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text``; ids are never materialised. 0 for null and empty texts."""
    vocabulary = Vocabulary(df.sparkSession, directory, name)

    @F.pandas_udf("int")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(list(map(vocabulary.bpe().count, texts)), dtype="int32")

    return spread(df).withColumn(out, tokens(F.col(text)))


def decode_column(df: DataFrame, key: str, ids: str, directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(key, text): the ids of each row decoded by the streaming decoder. A null list gives the empty text."""
    vocabulary = Vocabulary(df.sparkSession, directory, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = StreamDecoder(vocabulary.bpe())
        for batch in batches:
            texts = [stream.push(x or []) + stream.close() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
