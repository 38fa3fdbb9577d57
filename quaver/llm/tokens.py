"""Encoding of a corpus with a public byte-level BPE vocabulary.

Boundaries of the pieces that merges must not cross are found without regular expressions: code points get
classes from a table, each class stands for a transition function over a few scanner states, and an
associative scan over the functions gives the state after every code point of a whole batch. The slices are
merged once each and cached; their places in the text are kept for decoding.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Classes of code points. The last five are classes in context: an apostrophe that a contraction may follow,
# and the letters that can follow it.
END, LETTER, NUMBER, BLANK, SPACE, OTHER, APOSTROPHE, LAST, FIRST = range(9)
# States of the scanner after a code point. ONE and TWO: inside a contraction with that many letters to come.
START, IN_LETTERS, IN_NUMBERS, AFTER_BLANK, AFTER_SPACE, IN_OTHER, ONE, TWO, DONE = range(9)

# The contractions of the pre-tokenizer, by number of letters
SHORT = "stmd"
LONG = ("re", "ve", "ll")


def _functions() -> np.ndarray:
    """For each class, the state that follows each state."""
    table = np.zeros((9, 9), np.uint8)
    for kind, to in ((END, START), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (BLANK, AFTER_BLANK), (SPACE, AFTER_SPACE), (OTHER, IN_OTHER)):
        table[kind] = to
    # an apostrophe opens a contraction where a piece begins: not behind a space or other signs
    table[APOSTROPHE] = ONE
    table[APOSTROPHE, [AFTER_SPACE, IN_OTHER]] = IN_OTHER
    table[LAST] = IN_LETTERS
    table[LAST, [ONE, TWO]] = DONE
    table[FIRST] = IN_LETTERS
    table[FIRST, ONE] = TWO
    return table


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the functions: function by number, numbers of the classes, table of compositions."""
    base = [tuple(f) for f in _functions().tolist()]
    known = {f: i for i, f in enumerate(dict.fromkeys(base))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = np.array(list(known), np.uint8)
    table = np.empty((len(known), len(known)), np.int16)
    for i, f in enumerate(known):
        for j, g in enumerate(known):
            table[i, j] = known.get(tuple(g[s] for s in f), 0)
    return every, np.array([known[f] for f in base], np.int16), table


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, by rule from its general category; blanks are those with White_Space."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[32] = SPACE
    return out


def scan(functions: np.ndarray) -> np.ndarray:
    """States after each code point: an inclusive associative scan by doubling over function numbers.

    Positions whose function ignores the state before are final at once; each doubling composes only the rest.
    """
    every, _, table = _monoid()
    constant = (every == every[:, :1]).all(axis=1)
    done, reach = functions.copy(), 1
    open_at = np.flatnonzero(~constant[done])
    while len(open_at):
        open_at = open_at[open_at >= reach]
        done[open_at] = table[done[open_at - reach], done[open_at]]
        open_at = open_at[~constant[done[open_at]]]
        reach *= 2
    return every[done, START]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in an array of code points, in which -1 parts texts (and is a piece of its own)."""
    if not len(points):
        return np.zeros(0, np.int64)
    kind = np.where(points < 0, END, _classes()[np.maximum(points, 0)])
    after = np.append(points[1:], -1)
    is_short = np.isin(points, [ord(c) for c in SHORT])
    long_first = np.zeros(len(points), bool)
    for a, b in LONG:
        long_first |= (points == ord(a)) & (after == ord(b))
    apostrophe = points == ord("'")
    follows = np.append(is_short[1:] | long_first[1:], False)
    kind[apostrophe & follows] = APOSTROPHE
    behind = np.append(False, apostrophe[:-1])
    kind[behind & long_first] = FIRST
    kind[behind & is_short] = LAST
    # the second letter of a long contraction ends it
    second = np.append(False, (behind & long_first)[:-1])
    kind[second] = LAST
    state = scan(_monoid()[1][kind])
    before = np.append(START, state[:-1])
    blank = (state == AFTER_BLANK) | (state == AFTER_SPACE)
    blank_before = (before == AFTER_BLANK) | (before == AFTER_SPACE)
    next_full = np.append(~blank[1:] & (points[1:] >= 0), False)
    same = (before == state) & ((state == IN_LETTERS) | (state == IN_NUMBERS) | (state == IN_OTHER))
    inside = same | (before == AFTER_SPACE) | (((state == DONE) | (state == TWO)) & ((before == ONE) | (before == TWO)))
    starts = np.where(blank, ~blank_before | next_full, ~inside)
    starts[points < 0] = True
    starts |= before == START
    return np.flatnonzero(starts)


class Vocabulary:
    """Ranks of a byte-level vocabulary, with pair merging and a cache of merged pieces."""

    def __init__(self, path: str, cached: int = 400_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached = cached

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece: the adjacent pair of lowest rank is merged until none is left (leftmost first)."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, b""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (r := self.ranks.get(joined + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, joined + parts[after[i]]))
            if before[i] >= 0 and (r := self.ranks.get(parts[before[i]] + joined)) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]] + joined))
        return tuple(self.ranks[p] for p in parts if p)

    def ids(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece, from the cache where it was merged before; long pieces are not kept."""
        found = self.cache.get(piece)
        if found is None:
            found = self.merge(piece.encode())
            if len(piece) <= 64:
                if len(self.cache) >= self.cached:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """For each text its ids, and for each id the place in the text (code points) where its piece begins."""
        joined = [t or "" for t in texts]
        # one array for the batch; each text ends with a mark that no text can hold
        points = np.full(sum(map(len, joined)) + len(joined), -1, np.int64)
        at = 0
        for t in joined:
            points[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            at += len(t) + 1
        starts = boundaries(points)
        out, ids, k, at = [], self.ids, 0, 0
        starts = starts.tolist()
        for t in joined:
            own, places, end = [], [], at + len(t)
            while starts[k] < end:
                a = starts[k] - at
                k += 1
                found = ids(t[a : starts[k] - at])
                own += found
                places += [a] * len(found)
            k += 1
            at = end + 1
            out.append((own, places))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    return Vocabulary(path)


def _batches(texts: list, chars: int = 1 << 20) -> Iterator[list]:
    """Slices of about ``chars`` characters, so that arrays stay small however long the texts are."""
    own, held = [], 0
    for t in texts:
        if own and held + len(t or "") > chars:
            yield own
            own, held = [], 0
        own.append(t)
        held += len(t or "") + 1
    if own:
        yield own


def encoded(df: DataFrame, text: str = "text", path: str = DEFAULT_VOCABULARY, ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """``df`` with a column of token ids, and with ``offsets`` one of the place where each id's piece begins.

    No special tokens are made: text that looks like one is plain text. Empty and null texts both have the
    empty list. Rows are kept as they are, repeated ones too; columns of the given names are replaced. The
    file at ``path`` must be at that place on every executor. A narrow map, no shuffle.
    """
    def done(batch: pd.Series) -> list[tuple[list[int], list[int]]]:
        words = vocabulary(path)
        return [x for part in _batches(batch.tolist()) for x in words.encode(part)]

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x[0] for x in done(batch)], dtype=object)

    @F.pandas_udf("struct<ids:array<int>,offsets:array<int>>")
    def encode_both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = done(batch)
            yield pd.DataFrame({"ids": [x[0] for x in both], "offsets": [x[1] for x in both]})

    if not offsets:
        return df.withColumn(ids, encode(F.col(text)))
    both = df.withColumn("_encoded", encode_both(F.col(text)))
    return both.withColumn(ids, F.col("_encoded.ids")).withColumn(offsets, F.col("_encoded.offsets")).drop("_encoded")


def token_counts(df: DataFrame, text: str = "text", path: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text; 0 for empty and null texts. Ids never leave the worker."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = vocabulary(path)
        for batch in batches:
            yield pd.Series([len(x[0]) for part in _batches(batch.tolist()) for x in words.encode(part)], dtype="int64")

    return df.withColumn(name, count(F.col(text)))


def decoded(df: DataFrame, ids: str = "ids", path: str = DEFAULT_VOCABULARY, name: str = "text") -> DataFrame:
    """``df`` with the text of a column of ids; null ids give null."""

    @F.pandas_udf(T.StringType())
    def decode(column: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return pd.Series([None if x is None else words.decode(list(x)) for x in column], dtype=object)

    return df.withColumn(name, decode(F.col(ids)))
