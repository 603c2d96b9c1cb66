"""Encoding of whole texts with a public byte-level BPE, by vectorised pre-tokenisation.

A batch of texts is one array of code points, each mapped to a class (letter, number, white space, other, with the
blank, the apostrophe and the letters of contractions apart).  The pre-tokeniser is an automaton whose transition
functions form a finite monoid, so they compose by table lookup; an associative scan over the code points composes them and
its states tell where slices start.  No regular expression is run.  The slices between boundaries feed a cache
of merged pairs; a slice that is not in it is merged once by the public library.  Byte offsets of the tokens are
returned on request, so that any range of the bytes can be decoded from its tokens.
"""

from __future__ import annotations

import base64
import bisect
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files are, if not given.
TOKENIZERS = "/opt/tokenizers"
#: Distinct slices that the cache of a worker holds before it starts anew.
CACHE_SLICES = 400_000

LETTER, NUMBER, SPACE, BLANK, OTHER = 1, 2, 3, 4, 5  # SPACE: white space but U+0020, BLANK: U+0020
# White space of Unicode beside U+0020.
WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions that are slices of their own.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


# Symbols of the automaton: a code point's class, with the letters of contractions and the apostrophe apart.
END, RE, VE, LL, E_, APOSTROPHE = 6, 7, 8, 9, 10, 11
SYMBOLS = 12
# States: what the last code point is part of.  TEXT: nothing before; MARK: an apostrophe that starts a slice;
# R, V, L: a letter behind such a mark that may become a contraction; DONE: the last letter of a contraction.
TEXT, WORD, DIGITS, SIGNS, WHITES, GAP, MARK, R, V, L, DONE = range(11)
STATES = 11


def _ranges() -> tuple[np.ndarray, np.ndarray]:
    """(first code points, symbols) of the ranges of code points with one symbol."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE] = SPACE
    out[0x20] = BLANK
    out[0x27] = APOSTROPHE
    for tail in CONTRACTIONS:
        out[ord(tail[0])] = END if len(tail) == 1 else {"r": RE, "v": VE, "l": LL}[tail[0]]
    out[ord("e")] = E_
    first = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
    return first.astype(np.int32), out[first]


def _step(state: int, symbol: int) -> int:
    """The state after one code point."""
    if symbol == BLANK:
        return GAP
    if symbol == SPACE:
        return WHITES
    if symbol == NUMBER:
        return DIGITS
    if symbol == OTHER:
        return SIGNS
    if symbol == APOSTROPHE:  # behind a blank or signs it belongs to them
        return SIGNS if state in (GAP, SIGNS, MARK) else MARK
    if state == MARK:
        return {END: DONE, RE: R, VE: V, LL: L}.get(symbol, WORD)
    if (state in (R, V) and symbol == E_) or (state == L and symbol == LL):
        return DONE
    return WORD


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, state that each function gives from each state).

    The functions are those that the symbols generate by composition; symbol + SYMBOLS is the symbol at the start
    of a text, whose function gives the same state whatever came before.
    """
    symbols = [tuple(_step(s, x) for s in range(STATES)) for x in range(SYMBOLS)]
    symbols += [(f[TEXT],) * STATES for f in symbols]
    known = {f: i for i, f in enumerate(dict.fromkeys(symbols))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in dict.fromkeys(symbols):
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    maps = np.array(list(known), np.uint8)
    then = np.empty((len(maps), len(maps)), np.uint16)  # then[f, g]: first f, then g
    for i, f in enumerate(maps):
        after = maps[:, f]
        then[i] = [known[tuple(x)] for x in after.tolist()]
    return np.array([known[f] for f in symbols], np.uint16), then, maps


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tables of _monoid and which functions are constant."""
    functions, then, maps = _monoid()
    return functions, then, maps, (maps == maps[:, :1]).all(axis=1)


@functools.cache
def _opening() -> np.ndarray:
    """[state before, symbol]: 1 if the code point starts a slice, 0 if not, 2 and 3 if what follows decides.

    2: white space behind white space, which starts a slice if it is the last of its run before something else.
    3: a letter that becomes part of a contraction or starts a slice.
    """
    out = np.ones((STATES, SYMBOLS), np.uint8)
    letters = [LETTER, END, RE, VE, LL, E_]
    out[np.ix_([WHITES, GAP], [SPACE, BLANK])] = 2
    out[np.ix_([GAP], [*letters, NUMBER, OTHER, APOSTROPHE])] = 0
    out[np.ix_([WORD, R, V, L], letters)] = 0
    out[DIGITS, NUMBER] = 0
    out[np.ix_([SIGNS, MARK], [OTHER, APOSTROPHE])] = 0
    out[MARK, END] = 0
    out[MARK, [RE, VE, LL]] = 3
    return out


def slice_starts(cps: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a slice starts; firsts: indices of the first code point of each text.

    The transition function of every code point is an element of a small finite monoid; an associative scan composes
    them by table lookup, doubling the stretch each time until all functions are constant, that is, until what
    came before no longer matters.
    """
    functions, then, maps, constant = _automaton()
    n = len(cps)
    first = np.zeros(n, bool)
    first[firsts[firsts < n]] = True
    symbol = classes[cps]
    scan = functions[symbol + np.where(first, np.uint8(SYMBOLS), np.uint8(0))]
    reach = 1
    while reach < n and not constant[scan].all():
        scan[reach:] = then[scan[:-reach], scan[reach:]]
        reach *= 2
    state = maps[scan, TEXT]
    before = np.empty(n, np.uint8)
    before[0] = TEXT
    before[1:] = state[:-1]
    before[first] = TEXT
    opening = _opening()[before, symbol]
    starts = opening == 1
    last = np.ones(n, bool)  # the last of its text
    last[:-1] = first[1:]
    at = np.flatnonzero(opening == 2)
    at = at[~last[at]]
    starts[at] = ~np.isin(symbol[at + 1], (SPACE, BLANK))
    at = np.flatnonzero(opening == 3)
    ends = last[at]
    starts[at] = ends | (state[np.minimum(at + 1, n - 1)] != DONE)
    return starts


class Encoder:
    """Encodes Arrow arrays of texts; one per worker process."""

    def __init__(self, path: str = TOKENIZERS, name: str = "byte_bpe_50k", ranges: tuple[np.ndarray, np.ndarray] | None = None):
        import tiktoken

        with open(f"{path}/{name}.tiktoken", "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        first, symbols = ranges or _ranges()
        self.classes = np.repeat(symbols, np.diff(np.append(first, 0x110000)))
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.pool: list[int] = []
        self.bounds: list[int] = [0]

    def _add(self, piece: bytes) -> int:
        ids = self.merge(piece)
        self.pool.extend(ids)
        self.bounds.append(len(self.pool))
        self.cache[piece] = k = len(self.bounds) - 2
        return k

    def slices(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slice number in the cache, byte offset of each slice, first slice of each text and the end)."""
        if len(self.cache) > CACHE_SLICES:
            self._clear()
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = data.to_pybytes()[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else b""
        bounds = bounds - bounds[0]
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        octets = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero((octets & 0xC0) != 0x80)  # byte offset of each code point
        cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        offsets = at[slice_starts(cps, np.searchsorted(at, bounds[:-1]), self.classes)]
        ends = np.append(offsets[1:], len(raw)).tolist()
        get, add = self.cache.get, self._add
        numbers = np.fromiter((k if (k := get(p := raw[a:b])) is not None else add(p) for a, b in zip(offsets.tolist(), ends)), np.int64, len(offsets))
        return numbers, offsets, np.append(np.searchsorted(offsets, bounds[:-1]), len(offsets))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        numbers, _, firsts = self.slices(texts)
        bounds, pool = np.asarray(self.bounds, np.int64), np.asarray(self.pool, np.int32)
        lengths = bounds[numbers + 1] - bounds[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(bounds[numbers] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[firsts]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        numbers, _, firsts = self.slices(texts)
        bounds = np.asarray(self.bounds, np.int64)
        ends = np.concatenate([[0], np.cumsum(bounds[numbers + 1] - bounds[numbers])])
        return np.diff(ends[firsts])

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(map(self._pieces.__getitem__, ids)).decode("utf-8")

    @functools.cached_property
    def _pieces(self) -> dict[int, bytes]:
        return {v: k for k, v in self.ranks.items()}

    @functools.cached_property
    def _sizes(self) -> np.ndarray:
        out = np.zeros(max(self.ranks.values()) + 1, np.int64)
        out[list(self.ranks.values())] = [len(k) for k in self.ranks]
        return out

    def byte_offsets(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each id the byte of its own text at which it begins."""
        ends = np.concatenate([[0], np.cumsum(self._sizes[ids])])
        return (ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))).astype(np.int32)

    def decode_range(self, ids: list[int], offsets: list[int], start: int, stop: int) -> bytes:
        """The bytes [start, stop) of the text of ids, from the tokens that cover them only."""
        a, b = max(0, bisect.bisect_right(offsets, start) - 1), bisect.bisect_left(offsets, stop)
        if a >= b:
            return b""
        return b"".join(map(self._pieces.__getitem__, ids[a:b]))[start - offsets[a] : stop - offsets[a]]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = TOKENIZERS, name: str = "byte_bpe_50k", ranges: tuple[np.ndarray, np.ndarray] | None = None) -> Encoder:
    """The encoder of this process; ranges: what _ranges gives, where it is known already."""
    if (path, name) not in _ENCODERS:
        _ENCODERS[path, name] = Encoder(path, name, ranges)
    return _ENCODERS[path, name]


@functools.cache
def _shared_ranges() -> tuple[np.ndarray, np.ndarray]:
    return _ranges()


def folder(df: DataFrame, path: str | None) -> str:
    """Where the vocabulary files are: path, else the session's setting spark.histrank.tokenizers, else TOKENIZERS."""
    return path or df.sparkSession.conf.get("spark.histrank.tokenizers", None) or TOKENIZERS


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None, name: str = "byte_bpe_50k", offsets: bool = False) -> DataFrame:
    """(key, ids): the ids of each text; null and empty texts give an empty list, strings of special tokens are ordinary text.

    With offsets=True also `offsets`: the byte of the text (in UTF-8) at which each id begins.
    """
    picked, path, ranges = df.select(key, text), folder(df, path), _shared_ranges()
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "offsets")[: 1 + offsets]]
    schema = T.StructType([picked.schema[0], *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, name, ranges)
        for b in batches:
            ids, bounds = enc.encode(b.column(1))
            at = pa.array(bounds.astype(np.int32))
            out = [pa.ListArray.from_arrays(at, pa.array(ids))]
            if offsets:
                out.append(pa.ListArray.from_arrays(at, pa.array(enc.byte_offsets(ids, bounds))))
            yield pa.RecordBatch.from_arrays([b.column(0), *out], names=schema.names)

    return picked.mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, n_tokens): the number of ids of each text."""
    picked, path, ranges = df.select(key, text), folder(df, path), _shared_ranges()
    schema = T.StructType([picked.schema[0], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, name, ranges)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.counts(b.column(1)))], names=[key, "n_tokens"])

    return picked.mapInArrow(run, schema)
