"""Splitting texts above a token limit at natural boundaries, by dynamic programming over boundary positions.

A piece runs between two boundaries of the text. A cut inside a run without blanks counts for more than all that follows,
a cut between words of a sentence for more than the rest together; then each piece costs one, plus the penalty of the
boundary at its end (paragraph < sentence), plus the squared distance of its size from an even division. The cheapest
sequence of cuts over all boundaries is found exactly. The next piece starts up to ``overlap`` tokens before the cut, at
the earliest sentence start in that reach, else at the earliest word start, else at the cut.

As lesser cuts are made only where nothing better is possible, only sentences that don't fit between a cut and its
overlap (limit - overlap tokens) need their word boundaries looked at, and only words of such length the places within:
further candidates can't be in the best sequence. Tokens of a piece standing alone are counted; if they exceed the
limit, the text is cut anew under a limit lower by the excess, and a text that can't be cut is an error, never a longer
piece. Texts within the limit, empty and null texts have no rows. Pieces together cover the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.tokenizer import TOKENIZER_DIR, VOCABULARY, ByteBPE, Vocabulary
from reviewloom.staging import spread

LIMIT, OVERLAP = 512, 64
PARAGRAPH, SENTENCE, WORD, NONE = range(4)
#: Of paragraph and sentence ends; the others' depend on the text, see ``penalties``.
PENALTY = (0.0, 0.3)
KINDS = ["paragraph", "sentence", "word", "none"]
EVENNESS = 4.0
# What ends a sentence, and what may follow before the blank.
ENDS, CLOSERS = frozenset(".!?…。！？।॥"), "\"')]}»”’"

SCHEMA = "piece_no int, start_pos int, end_pos int, n_tokens int, overlap_tokens int, cut string, piece string"


def penalties(n: int) -> np.ndarray:
    """The cost of a cut of each kind among ``n`` candidates: one word cut outweighs all costs of n pieces, one cut of kind NONE n word cuts."""
    word = n * (1 + EVENNESS + PENALTY[SENTENCE])
    return np.array([*PENALTY, word, (n + 1) * word])


_INHERITS, _BLANK = 2, 4
_NO_LEAD, _SPACE, _OTHER_LEAD = 0, 8, 16


class _Features(dict):
    """A number for each pre-token: 1 if it ends a sentence, 2 if it has only closing marks, 4 if only blanks; and its leading blanks."""

    def __missing__(self, w: str) -> int:
        body = w.lstrip()
        core, lead = body.rstrip(CLOSERS), len(w) - len(body)
        found = (int(core[-1] in ENDS) if core else _INHERITS) | (0 if body else _BLANK) | (_NO_LEAD if not lead else _SPACE if body and w[:lead] == " " else _OTHER_LEAD)
        if len(w) <= 48:
            if len(self) > 200_000:
                self.clear()
            self[w] = found
        return found


_features = _Features()


def _line_ends(blank: str) -> int:
    return blank.count("\n") + blank.count("\r") - blank.count("\r\n")


def units_of(t: ByteBPE, words: list[str], sizes: list[int], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens before, characters before, kind, pre-tokens before) of each boundary between units, from 0 to the end of the text.

    Units are pre-tokens; one of more than an eighth of the limit is divided at token ends that are code point ends,
    where the number of pre-tokens before is -1.
    """
    n = len(words)
    each = np.array(sizes, np.int64)
    tokens, chars, places = (np.zeros(n + 1, np.int64) for _ in range(3))
    np.cumsum(each, out=tokens[1:])
    np.cumsum(np.fromiter(map(len, words), np.int64, n), out=chars[1:])
    places[:] = np.arange(n + 1)
    codes = np.fromiter(map(_features.__getitem__, words), np.int64, n)
    # Whether the text before a pre-token ends a sentence: its last sign that closes nothing says so.
    last = np.maximum.accumulate(np.where(codes & _INHERITS, 0, np.arange(n)))
    ended = (codes[last] & (1 | _INHERITS)) == 1
    kinds = np.full(n + 1, NONE)
    kinds[0] = kinds[n] = PARAGRAPH
    blank = (codes & _BLANK) != 0
    plain = np.flatnonzero(((codes[1:] & _SPACE) != 0) & ~blank[:-1]) + 1
    kinds[plain] = np.where(ended[plain - 1], SENTENCE, WORD)
    for k in (np.flatnonzero(~blank[1:] & (((codes[1:] & _OTHER_LEAD) != 0) | blank[:-1])) + 1).tolist():
        first = k
        while first and blank[first - 1]:
            first -= 1
        if not first:
            continue
        w = words[k]
        lines = _line_ends("".join(words[first:k]) + w[: len(w) - len(w.lstrip())])
        kinds[k] = PARAGRAPH if lines >= 2 else SENTENCE if lines or ended[k - 1] else WORD
    large = np.flatnonzero(each > limit // 8).tolist()
    if not large:
        return tokens, chars, kinds, places
    parts: list[tuple[np.ndarray, ...]] = []
    at = 0
    for k in large:
        parts.append((tokens[at : k + 1], chars[at : k + 1], kinds[at : k + 1], places[at : k + 1]))
        at = k + 1
        inner: list[tuple[int, int]] = []
        held, some, where = b"", 0, 0
        ids = t.ids_of[words[k]]
        for i, x in enumerate(ids[:-1], 1):
            held += t.bytes_of[x]
            some += 1
            try:
                where += len(held.decode("utf-8"))
            except UnicodeDecodeError:
                continue
            held = b""
            if some * 16 >= limit or some * 16 >= len(ids):
                inner.append((i, where))
                some = 0
        if inner:
            i = np.array(inner, np.int64)
            parts.append((tokens[k] + i[:, 0], chars[k] + i[:, 1], np.full(len(i), NONE), np.full(len(i), -1, np.int64)))
    parts.append((tokens[at:], chars[at:], kinds[at:], places[at:]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def cuts(tokens: np.ndarray, kinds: np.ndarray, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the pieces as boundary numbers, the cheapest in total."""
    last = len(tokens) - 1
    chosen = np.flatnonzero(kinds <= SENTENCE)
    for level in (WORD, NONE):
        wide = np.flatnonzero(np.diff(tokens[chosen]) > limit - overlap)
        more = [np.arange(chosen[i] + 1, chosen[i + 1]) for i in wide]
        if more:
            inner = np.concatenate(more)
            chosen = np.union1d(chosen, inner[kinds[inner] <= level])
    # Where the next piece would start, for each possible cut.
    start = chosen.copy()
    for level in (WORD, SENTENCE):
        natural = np.flatnonzero(kinds <= level)
        first = natural[np.searchsorted(tokens[natural], tokens[chosen] - overlap).clip(max=len(natural) - 1)]
        start = np.where((first < chosen) & (first > 0), first, start)
    start[0] = 0
    total = int(tokens[last])
    pieces = max(1, -(-(total - overlap) // (limit - overlap)))
    even = min(limit, (total + (pieces - 1) * overlap) / pieces)
    # A later cut never lets the next piece start earlier, so starts don't fall.
    n = len(chosen)
    penalty = penalties(n)
    size0 = tokens[start].astype(np.float64)
    best, came = np.full(n, np.inf), [0] * n
    best[0] = 0.0
    ends = tokens[chosen]
    low = np.searchsorted(size0, ends - limit).tolist()
    at_end, more = ends.tolist(), (1.0 + penalty[kinds[chosen]]).tolist()
    weight = EVENNESS / limit**2
    for j in range(1, n):
        lo = low[j]
        if lo >= j:  # a unit that nothing divides: it stands alone
            best[j], came[j] = best[j - 1] + 1.0 + penalty[NONE], j - 1
            start[j - 1] = chosen[j - 1]
            size0[j - 1] = tokens[chosen[j - 1]]
            continue
        cost = size0[lo:j] - (at_end[j] - even)
        cost *= cost
        cost *= weight
        cost += best[lo:j]
        k = int(cost.argmin())
        best[j], came[j] = cost[k] + more[j], lo + k
    found, j = [n - 1], n - 1
    while came[j] > 0:
        j = came[j]
        found.append(j)
    found.reverse()
    return [0, *(int(start[i]) for i in found[:-1])], [int(chosen[i]) for i in found]


def split_text(t: ByteBPE, text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple]:
    """Rows of SCHEMA for one text; none if it is within the limit."""
    if not text or len(text) * 4 <= limit:  # a code point gives four tokens at most
        return []
    words = t.words(text)
    each = t.sizes(words)
    if sum(each) <= limit:
        return []
    tokens, chars, kinds, places = units_of(t, words, each, limit)

    def alone(a: int, b: int) -> int:
        """The tokens of a piece standing alone. Pre-tokens don't depend on what is before them, and only blanks on what is behind."""
        if places[a] < 0 or places[b] < 0:
            return t.count(text[chars[a] : chars[b]])
        n, low, high = int(tokens[b] - tokens[a]), int(places[a]), int(places[b])
        at = high
        while at > low and words[at - 1].isspace():
            at -= 1
        return n if high - at < 2 else n - sum(each[at:high]) + t.count("".join(words[at:high]))

    under = limit
    while True:
        starts, ends = cuts(tokens, kinds, under, min(overlap, under // 2))
        sizes = [alone(a, b) for a, b in zip(starts, ends)]
        if max(sizes) <= limit:
            break
        if under <= 4:
            raise ValueError(f"a text of {len(text)} characters has no pieces of at most {limit} tokens")
        under = max(4, under - (max(sizes) - limit))
    texts = [text[chars[a] : chars[b]] for a, b in zip(starts, ends)]
    rows = []
    for k, (a, b) in enumerate(zip(starts, ends)):
        shared = int(tokens[ends[k - 1]] - tokens[a]) if k else 0
        rows.append((k, int(chars[a]), int(chars[b]), sizes[k], shared, "end" if b == len(tokens) - 1 else KINDS[kinds[b]], texts[k]))
    return rows


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """The pieces of every text above ``limit`` tokens: ``key`` and SCHEMA. Positions count code points."""
    vocabulary = Vocabulary(df.sparkSession, directory, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = vocabulary.bpe()
        names = ["k", *(f.split()[0] for f in SCHEMA.split(", "))]
        kinds = [None, *[pa.int32()] * 5, pa.string(), pa.string()]
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            held: list[tuple] = []
            size = 0
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in split_text(t, x.as_py(), limit, overlap):
                    held.append((k, *row))
                    size += len(row[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, d) for c, d in zip(zip(*held), kinds)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, d) for c, d in zip(zip(*held), kinds)], names=names)

    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)
