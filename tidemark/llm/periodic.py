"""Periodic runs of words, caught online by dyadic blocks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

Edit = Callable[[int | None, list[bytes]], list[bytes]]


@dataclass(frozen=True)
class RunParams:
    """A run has ``exponent`` times its period and ``min_length`` words at least.

    Documents are laid end to end until ``stream_words`` words are reached, and appended ``chunk`` words at a time;
    neither changes the result.
    """

    exponent: int = 4
    min_length: int = 6
    stream_words: int = 1 << 16
    chunk: int = 1 << 16


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, _U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U64))


_POWERS = _Powers()


def _mixed(words: np.ndarray) -> np.ndarray:
    """A spread 64-bit code per word number."""
    x = words.astype(_U64) * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(29)
    x *= _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(32))


class SquareCatcher:
    """Squares (stretches repeated at once) of a growing sequence of word numbers, merged into maximal runs.

    A square of period q holds in its first half a whole block of b words that starts at a multiple of b, where
    2b <= q < 4b (one word for q < 4).  Each such block is a catcher: it waits for itself to come again 2b to 4b
    words later.  Appended words complete copies of blocks of all sizes; from a caught copy, the common suffix before and
    the common prefix behind are found with prefix hashes.  Where they reach a whole period there is a
    square, and the stretch it lies in is a run.  A stretch that touches the end of the text stays open
    and is carried on by the next words, so squares are reported as soon as they are complete.
    Every square is compared word by word before it is reported.
    """

    def __init__(self, longest_period: int | None = None):
        self.longest = longest_period
        self.n = 0
        self._words = np.empty(1024, np.int64)
        self._prefix = np.zeros(1025, _U64)
        self._run_of = np.full(1024, -1, np.int64)  # a run that covers the word
        self._start: list[int] = []
        self._end: list[int] = []
        self._period: list[int] = []
        self._known: dict[tuple[int, int], int] = {}
        self._open: dict[tuple[int, int], int] = {}  # (period, start) -> end, up to the end of the text

    def _grow(self, words: np.ndarray) -> None:
        new = self.n + len(words)
        if new > len(self._words):
            size = max(new, 2 * len(self._words))
            for name, fill, more in (("_words", 0, 0), ("_prefix", 0, 1), ("_run_of", -1, 0)):
                old = getattr(self, name)
                grown = np.full(size + more, fill, old.dtype)
                grown[:self.n + more] = old[:self.n + more]
                setattr(self, name, grown)
        _POWERS.reach(new + 1)
        self._words[self.n:new] = words
        terms = _mixed(words) * _POWERS.up[self.n:new]
        self._prefix[self.n + 1:new + 1] = self._prefix[self.n] + np.cumsum(terms, dtype=_U64)
        self.n = new

    def _hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self._prefix[start + length] - self._prefix[start]) * _POWERS.down[start]

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the text agrees from places a and b on (or before them), up to ``most`` words."""
        got = np.zeros(len(a), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            try_ = np.flatnonzero(got + step <= most)
            if len(try_):
                far = got[try_] + step
                x, y = (a[try_] - far, b[try_] - far) if back else (a[try_], b[try_])
                got[try_] += np.where(self._hash(x, far) == self._hash(y, far), step, 0)
            step >>= 1
        return got

    def append(self, words: np.ndarray) -> None:
        """Advance by some words; one at a time or many at once comes to the same."""
        old = self.n
        if not len(words):
            return
        self._grow(np.asarray(words, np.int64))
        for (q, start), end in list(self._open.items()):
            same = self._words[end:self.n] == self._words[end - q:self.n - q]
            more = len(same) if same.all() else int(same.argmin())
            del self._open[q, start]
            self._stretch(q, start, end + more)
        longest = min(self.n - 1, self.longest or self.n)
        size = 1
        while (low := 2 * size if size > 1 else 1) <= longest:
            self._advance(size, low, min(4 * size, longest + 1), old)
            size *= 2

    def _advance(self, size: int, low: int, high: int, old: int) -> None:
        """Copies, completed since ``old``, of blocks of ``size`` words at distances low to high - 1."""
        first = max(0, old + 1 - size - (high - 1)) // size
        count = (self.n - size - low) // size + 1 - first
        if count <= 0:
            return
        begin = first * size
        h = np.zeros((count - 1) * size + high, _U64)
        stop = min(self.n - size + 1, begin + len(h))
        np.subtract(self._prefix[begin + size:stop + size], self._prefix[begin:stop], out=h[:stop - begin])
        h[:stop - begin] *= _POWERS.down[begin:stop]
        blocks = h[:(count - 1) * size + 1:size]
        later = np.lib.stride_tricks.sliding_window_view(h[low:], high - low)[::size][:count]
        row, column = np.nonzero(later == blocks[:, None])
        at, q = begin + row * size, low + column
        done = at + q + size
        fresh = (done <= self.n) & (done > old)
        at, q = at[fresh], q[fresh]
        if len(at) and self._end:
            # inside a run whose period divides q this distance tells nothing new
            run = self._run_of[at]
            ends, periods = np.array(self._end), np.array(self._period)
            at, q = (x[~((run >= 0) & (q % periods[run] == 0) & (at + q <= ends[run]))] for x in (at, q))
        if not len(at):
            return
        before = self._common(at, at + q, at, back=True)
        behind = self._common(at + size, at + q + size, self.n - at - q - size, back=False)
        start, end = at - before, at + q + size + behind
        worth = (end - start >= 2 * q) | (end == self.n)
        for period, a, b in sorted(set(zip(q[worth].tolist(), start[worth].tolist(), end[worth].tolist(), strict=True))):
            self._stretch(period, a, b)

    def _stretch(self, q: int, start: int, end: int) -> None:
        if end == self.n:
            self._open[q, start] = end
        if end - start < 2 * q:
            return
        run = self._run_of[start]
        if (q, start) not in self._known:
            if run >= 0 and q % self._period[run] == 0 and q != self._period[run] and end <= self._end[run]:
                return  # a run of a shorter period, seen at a multiple of it
            if not np.array_equal(self._words[start:end - q], self._words[start + q:end]):
                raise ArithmeticError("two different stretches of words share a hash")
            self._known[q, start] = len(self._end)
            self._start.append(start)
            self._end.append(end)
            self._period.append(q)
        k = self._known[q, start]
        self._end[k] = end
        self._run_of[start:end] = k

    def runs(self, p: RunParams) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of the runs so far that are long enough, by start, then period."""
        found: dict[tuple[int, int], int] = {}
        for start, end, q in zip(self._start, self._end, self._period, strict=True):
            if end - start >= max(p.min_length, p.exponent * q):
                found[start, end] = min(q, found.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in found.items())


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space; null has none."""
    return [] if text is None else text.encode().split()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words))


class _Numbered(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def runs_of_all(documents: list[list[bytes]], p: RunParams = RunParams()) -> list[list[tuple[int, int, int]]]:
    """Runs of each document; they are appended to one catcher, parted by words that occur nowhere else.

    Words are told apart by their hashes first.  Every run is compared with the words themselves, and a stream in which
    one differs is done again with exact numbers.
    """
    out = []
    for low, high in _streams(documents, p):
        part = documents[low:high]
        try:
            found = _stream_runs(list(map(_hashed, part)), p)
            good = all(w[s:s + n - q] == w[s + q:s + n] for w, runs in zip(part, found, strict=True) for s, n, q in runs)
        except ArithmeticError:
            good = False
        out.extend(found if good else _stream_runs(list(map(_Numbered(), part)), p))
    return out


def _streams(documents: list[list[bytes]], p: RunParams) -> Iterator[tuple[int, int]]:
    low = total = 0
    for k, words in enumerate(documents):
        total += len(words) + 1
        if total >= p.stream_words:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(documents):
        yield low, len(documents)


def _stream_runs(documents: list[np.ndarray], p: RunParams) -> list[list[tuple[int, int, int]]]:
    parts = [x for k, d in enumerate(documents) for x in (d, np.array([-1 - k]))]
    text = np.concatenate(parts)
    # no run of the wanted exponent has a longer period
    catcher = SquareCatcher(max(1, max(map(len, documents)) // max(2, p.exponent)))
    for at in range(0, len(text), p.chunk):
        catcher.append(text[at:at + p.chunk])
    ends = np.cumsum([len(d) + 1 for d in documents])
    out = [[] for _ in documents]
    for start, length, q in catcher.runs(p):
        k = int(np.searchsorted(ends, start, "right"))
        out[k].append((start - int(ends[k] - len(documents[k]) - 1), length, q))
    return out


def collapsed(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains behind its first period."""
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return words if keep.all() else [words[k] for k in np.flatnonzero(keep)]


def scan(docs: DataFrame, p: RunParams = RunParams(), edit: Edit | None = None) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row: its periodic runs (start, length, period, in words) by start, then
    period, and its text with each run cut to one period, joined by single blanks.

    ``edit`` may change a row's words beforehand.  Null and blank texts have no words and no runs.  Rows are
    independent of each other, with equal ids or none; other columns are ignored.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            if edit:
                words = [edit(i, w) for i, w in zip(batch.column("doc_id").to_pylist(), words, strict=True)]
            found = runs_of_all(words, p)
            cut = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(listed, _RUNS),
                 pa.array(cut, pa.string())], ["doc_id", "n_words", "runs", "text"])

    kind = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, kind)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The edit of the contract: in a tenth of the documents, all words from some place on repeat a short stretch.

    A row without id keeps its words.
    """
    n = len(words)
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n or doc_id is None:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[:n - a]

