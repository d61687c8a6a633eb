"""Periodic runs against brute force, appended in pieces of any size."""

import numpy as np
import pytest

from tidemark.llm import periodic
from tidemark.llm.periodic import RunParams


def brute(words, p=RunParams()):
    n, found = len(words), {}
    for q in range(1, n // p.exponent + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(p.min_length, p.exponent * q):
                found.setdefault((at, end + q), q)
            at = end + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def texts(seed, count):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        n = int(rng.integers(0, 120))
        words = rng.integers(0, rng.integers(1, 5), n)
        for _ in range(rng.integers(0, 4) if n > 3 else 0):
            at, q = int(rng.integers(0, n)), int(rng.integers(1, max(2, n // 4)))
            unit, length = words[at:at + q].copy(), int(rng.integers(0, n - at + 1))
            words[at:at + length] = np.resize(unit, length)
        yield [b"%d" % w for w in words]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 1)])
def test_all_runs_whatever_the_pieces(chunk, exponent, least):
    docs = list(texts(chunk * 10 + exponent, 150))
    p = RunParams(exponent, least, stream_words=200, chunk=chunk)
    assert periodic.runs_of_all(docs, p) == [brute(d, p) for d in docs]


def test_squares_are_reported_as_soon_as_they_are_complete():
    catcher, seen = periodic.SquareCatcher(), []
    for k, word in enumerate([9, 1, 2, 3, 1, 2, 3, 1, 7]):
        catcher.append(np.array([word]))
        seen.append(catcher.runs(RunParams(2, 1)))
        assert bool(seen[-1]) == (k >= 6)
    assert seen[6] == [(1, 6, 3)] and seen[7] == seen[8] == [(1, 7, 3)]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic, "_hashed", lambda words: np.zeros(len(words), np.int64))
    docs = [[b"a", b"b", b"c"] * 9, [b"x"] * 8, []]
    assert periodic.runs_of_all(docs) == [[(0, 27, 3)], [(0, 8, 1)], []]


def test_long_texts_of_one_word_and_of_many():
    n = 150_000
    rng = np.random.default_rng(2)
    mixed = [b"%d" % w for w in rng.integers(0, 1000, n)]
    mixed[70_000:130_000] = mixed[70_000:82_000] * 5
    got = periodic.runs_of_all([[b"a"] * n, [b"b", b"c"] * n, mixed])
    assert got[0] == [(0, n, 1)] and got[1] == [(0, 2 * n, 2)]
    assert [(s, q) for s, _, q in got[2]] == [(70_000, 12_000)] and 60_000 <= got[2][0][1] < 60_010


def test_scan(spark):
    rows = [(1, "x " + "a b " * 6 + "y"), (2, None), (3, ""), (3, " \n\t"), (None, "no no no no no no"), (4, "été x " * 7),
            (5, "one two three")]
    docs = spark.createDataFrame([(*r, 0, "r") for r in rows], "doc_id long, text string, n_words int, runs string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["text"], r["n_words"]) for r in periodic.scan(docs).collect()),
                 key=str)
    assert got == sorted([(1, [(1, 12, 2)], "x a b y", 14), (2, [], "", 0), (3, [], "", 0), (3, [], "", 0),
                          (None, [(0, 6, 1)], "no", 6), (4, [(0, 7, 1)], "été x", 7), (5, [], "one two three", 3)], key=str)
    assert periodic.scan(docs.where("false")).count() == 0


def test_the_planted_tail():
    words = [b"%d" % k for k in range(100)]
    import zlib

    for i in range(300):
        got, h = periodic.repeated_tail(i, words), zlib.crc32(str(i).encode())
        g = h // 10
        a, p = g % 100, 1 + (100 - g % 100) // (3 + g % 8)
        assert got == ([words[k if k < a else a + (k - a) % p] for k in range(100)] if h % 10 == 0 else words)
    assert periodic.repeated_tail(None, words) == words and periodic.repeated_tail(5, []) == []
