"""Vectorised pretokenising of Arrow text batches, and caches of what is known about a word.

The pieces are those of the pattern that comes with the public byte-level vocabularies:
contractions, runs of letters, of numbers and of other signs with one leading space, and
white space. Code points are classed by table and the piece borders found by array
operations; pieces are identified by a 64-bit hash with a second sum as check, so Python
touches each distinct piece of a worker once, not each piece of a text.
"""

from __future__ import annotations

import gc
import unicodedata
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

_CLASS: list = []
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: White space as the rank files' own library sees it (Unicode White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MULT = 0x9E3779B97F4A7C15
CHUNK = 1 << 19
_POWERS = np.ones(1, np.uint64)


def classes() -> np.ndarray:
    if not _CLASS:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[WHITE] = SPACE
        _CLASS.append(t)
    return _CLASS[0]


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _MULT, np.uint64)])
    return _POWERS


@dataclass
class Pieces:
    """Pieces of some whole documents. doc_piece[i]:doc_piece[i+1] are those of document first + i."""

    first: int
    code: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc_piece: np.ndarray
    hash: np.ndarray
    check: np.ndarray

    def text(self, i: int) -> str:
        return self.code[self.start[i] : self.start[i] + self.length[i]].tobytes().decode("utf-32-le")


def borders(code: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Starts of the pieces in code points of documents that start at ``doc_start`` (none is empty)."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    c = classes()[code]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:])
    edge[doc_start] = True
    white, blank = c == SPACE, code == 0x20
    last = np.empty(n, bool)  # last of its run
    last[:-1] = edge[1:]
    last[-1] = True
    doc_end = np.zeros(n, bool)
    doc_end[doc_start[1:] - 1] = True
    doc_end[-1] = True
    start = edge.copy()
    lead = edge & ~white  # a run after a blank starts at the blank
    lead[0] = False
    lead[doc_start] = False
    start[np.flatnonzero(lead)[blank[np.flatnonzero(lead) - 1]]] = False
    start |= white & last & ~doc_end
    quote = np.flatnonzero((code == 0x27) & start & edge & last & ~doc_end)
    if len(quote):
        at = np.minimum(quote[:, None] + np.arange(1, 3), n - 1)
        one, two = code[at[:, 0]], code[at[:, 1]]
        short = np.isin(one, [ord(x) for x in "stmd"])
        pair = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (one == ord(x)) & (two == ord(y))
        pair &= ~short & ~doc_end[at[:, 0]] & (quote + 2 < n)
        for hit, size in ((quote[short], 2), (quote[pair], 3)):
            start[hit + 1] = False
            after = hit + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


def split(texts: pa.Array, cut=borders):
    """Pieces of consecutive documents, a bounded number of code points at a time (a longer document alone).

    ``cut`` gives the starts of pieces from code points and documents' starts."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buf = texts.buffers()[2]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
        raw = np.frombuffer(buf, np.uint8)[off[at] : off[to]] if buf is not None and off[to] > off[at] else np.zeros(0, np.uint8)
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # code points before each byte
        bounds = heads[off[at : to + 1] - off[at]]
        filled = bounds[:-1][bounds[1:] > bounds[:-1]]
        start = cut(code, filled)
        length = np.diff(np.r_[start, len(code)])
        if len(start):
            with np.errstate(over="ignore"):
                inside = np.arange(len(code)) - np.repeat(start, length)
                x = code.astype(np.uint64) + np.uint64(1)
                h = np.add.reduceat(x * _powers(int(length.max()) + 1)[inside], start)
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                check = np.add.reduceat(x * x * (inside + 3).astype(np.uint64), start)
        else:
            h = check = np.zeros(0, np.uint64)
        yield Pieces(at, code, start, length, np.searchsorted(start, bounds), h, check)
        at = to


class Ragged:
    """Growing rows of numbers (or of bytes, as uint8), gathered for many row numbers at once."""

    def __init__(self, dtype):
        self.data, self.off, self.n = np.zeros(1024, dtype), np.zeros(1024, np.int64), 0

    def add(self, rows: list) -> None:
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        need, used = self.n + len(rows) + 1, int(self.off[self.n])
        if need > len(self.off):
            self.off = np.concatenate([self.off, np.zeros(max(need, len(self.off)), np.int64)])
        total = int(lens.sum())
        if used + total > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(total, len(self.data)), self.data.dtype)])
        if total:
            flat = np.frombuffer(b"".join(rows), np.uint8) if isinstance(rows[0], bytes) else np.fromiter(chain.from_iterable(rows), self.data.dtype, total)
            self.data[used : used + total] = flat
        self.off[self.n + 1 : need] = used + np.cumsum(lens)
        self.n += len(rows)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all rows in turn, offsets)."""
        begin = self.off[rows]
        lens = self.off[rows + 1] - begin
        ends = np.cumsum(lens)
        offs = np.r_[0, ends]
        take = np.arange(offs[-1]) + np.repeat(begin - offs[:-1], lens)
        return self.data[take], offs


class WordCache:
    """Numbers for distinct pieces; ``learn(list of str)`` is told of each new one, in order.

    Past ``limit`` pieces everything is forgotten, so a worker's memory is bounded."""

    def __init__(self, reset, limit: int = 1_000_000):
        self.reset, self.limit = reset, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict = {}
        self.odd: dict = {}  # pieces whose hash another piece has
        self.n = 0
        self.check = np.zeros(1024, np.uint64)
        self.learn = self.reset()

    def _add(self, p: Pieces, at: np.ndarray) -> np.ndarray:
        """Numbers for the pieces at the places ``at``, which are new."""
        gc.disable()  # many small lists and no cycles: the collector would only walk them
        try:
            self.learn([p.text(i) for i in at.tolist()])
        finally:
            gc.enable()
        base, self.n = self.n, self.n + len(at)
        if self.n > len(self.check):
            self.check = np.concatenate([self.check, np.zeros(self.n, np.uint64)])
        self.check[base : self.n] = p.check[at]
        return np.arange(base, self.n)

    def slots(self, p: Pieces) -> np.ndarray:
        if not len(p.start):
            return np.zeros(0, np.int64)
        if self.n > self.limit:
            self.clear()
        h, first, inverse = np.unique(p.hash, return_index=True, return_inverse=True)
        get = self.slot.get
        known = np.fromiter(map(get, h.tolist(), repeat(-1)), np.int64, len(h))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self._add(p, first[new])
            self.slot.update(zip(h[new].tolist(), known[new].tolist(), strict=True))
        out = known[inverse]
        for i in np.flatnonzero(self.check[out] != p.check).tolist():  # two pieces of one hash
            key = int(p.hash[i]), int(p.check[i])
            if key not in self.odd:
                self.odd[key] = int(self._add(p, np.array([i]))[0])
            out[i] = self.odd[key]
        return out


_CURRENT: dict = {}


def worker_cache(key, make):
    """What ``make()`` gives, kept while this Python worker serves ``key`` alone: workers outlive
    a stage, and the caches of several operators together would outgrow an executor."""
    if key not in _CURRENT:
        _CURRENT.clear()
        trim()
        _CURRENT[key] = make()
    return _CURRENT[key]


def forget() -> None:
    """Drop what an earlier operator of this worker has cached; for operators that cache nothing."""
    if _CURRENT:
        _CURRENT.clear()
        trim()


def trim(collect: bool = True) -> None:
    """Give freed memory back to the machine, where the C library can."""
    import ctypes

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
