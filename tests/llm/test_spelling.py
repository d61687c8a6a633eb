"""Spelling variants against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import spelling

SMALL = spelling.VariantParams(symbols=2, block=2, batch_cells=50)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(counts, p=spelling.VariantParams()):
    words = {w: n for w, n in counts.items() if n >= p.min_count and len(w) >= p.min_length}
    near = {w: set() for w in words}
    for a in words:
        for b in words:
            if len(a) == len(b):
                close = sum(x != y for x, y in zip(a, b, strict=True)) == 1
            else:
                close = len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
            if close:
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= p.dominance * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r) for r in rows}


def test_counts_and_the_planted_edit(spark):
    rows = [(k, t) for k, t in enumerate(["Colour COLOUR colour, été ÉTÉ", None, "", "a1b", "x" * 3000, "naïve naive×÷ Straße"] * 40)]
    rows += [(7, "twice the same id"), (7, "twice the same id"), (None, "no id at all")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    want, plain = collections.Counter(), collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            plain[run] += 1
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    total = lambda df: {r["word"]: r["n"] for r in df.groupBy("word").sum("n").toDF("word", "n").collect()}
    assert total(spelling.word_counts(docs)) == plain
    assert total(spelling.word_counts(docs, spelling.one_letter_less)) == want and want != plain
    got = found(spelling.variants(spelling.word_counts(docs, spelling.one_letter_less)))
    assert got == brute(want)
    assert spelling.variants(spelling.word_counts(docs.where("false"))).count() == 0


@pytest.mark.parametrize("p", [spelling.VariantParams(), SMALL])
def test_against_all_pairs(spark, p):
    rng, counts = np.random.default_rng(4), {}
    for _ in range(150):
        word = "".join(rng.choice(list("aabcé"), rng.integers(4, 9)))
        counts[word] = int(rng.choice([1, 3, 3, 6, 12, 25, 50, 200]))
    long = "ab" * 2000
    counts |= {long: 3, long + "a": 9, "a" + long[2:]: 4, None: 50}
    df = spark.createDataFrame([(w, n, w) for w, n in counts.items()], "word string, n long, form string").repartition(3)
    del counts[None]
    assert found(spelling.variants(df, p)) == brute(counts, p)


def test_chains_lead_to_the_last_form(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx", "abuvwzyx", "atuvwzyx", "stuvwzyx"]
    df = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    got = found(spelling.variants(df))
    assert {r[2] for r in got.values()} == {chain[-1]} and got[chain[-1]][1] is None
    assert got[chain[0]][1] == chain[1] and got[chain[0]][5] == 6


def test_a_neighbourhood_is_whole_and_without_repeats():
    for length in (1, 2, 5, 7):
        words = np.array([[1] * length, [1, 2, 3, 3, 2, 1, 1][:length]], np.uint8)
        row, h = spelling.neighbourhood(words, 3)
        for k, word in enumerate(words.tolist()):
            edited = {tuple(word)}
            for i in range(length + 1):
                edited |= {(*word[:i], s, *word[i:]) for s in (1, 2, 3)}
                if i < length:
                    edited |= {(*word[:i], s, *word[i + 1:]) for s in (1, 2, 3)} | {(*word[:i], *word[i + 1:])}
            want = [int(spelling._hashes(np.array([w], np.uint64))[0][0]) if w else 0 for w in edited]
            assert sorted(h[row == k].tolist()) == sorted(want)
