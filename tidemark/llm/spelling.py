"""Groups of spelling variants, found through words over a reduced alphabet."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

# Fixed value: Latin letters by falling frequency, so that frequent ones get different symbols.
_BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
_LETTERS = string.ascii_uppercase + string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
_U64 = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWERED = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

Edit = Callable[[int | None, list[str]], list[str]]


@dataclass(frozen=True)
class VariantParams:
    """``symbols`` is the size of the reduced alphabet.  It changes the work only: fewer symbols mean fewer neighbours
    to generate and more words to verify.  A class of reduced words is split into blocks of about ``block`` words."""

    symbols: int = 8
    min_length: int = 5
    min_count: int = 3
    dominance: int = 2
    block: int = 512
    batch_cells: int = 1 << 20


def symbol_of(letter: str, symbols: int) -> int:
    """Symbol of a letter, from 0."""
    at = _BY_FREQUENCY.find(letter)
    return (at if at >= 0 else ord(letter)) % symbols


def reduced(word: Column, p: VariantParams) -> Column:
    """The word with each letter replaced by its symbol."""
    return F.translate(word, _LETTERS, "".join(chr(ord("A") + symbol_of(c, p.symbols)) for c in _LETTERS))


def word_counts(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """(word, n): how often each maximal run of letters stands in the whole texts, A-Z in lower case.

    Counted per batch of rows, so a word may come in several rows.  ``edit`` may change the runs of a document
    (doc_id, run) beforehand.  Null texts have no words; rows are independent of each other, with equal ids or none.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                runs = Counter(_LETTER_RUN.findall(text.encode().translate(_LOWERED).decode()))
                if edit:
                    for word, n in zip(edit(doc_id, list(runs)), runs.values(), strict=True):
                        total[word] += n
                else:
                    total.update(runs)
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                             ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def vocabulary(counts: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; ``counts`` may hold a word in several rows."""
    return (counts.where(F.char_length("word") >= p.min_length).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= p.min_count))


def _hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each row, its prefix sums and the powers of the base."""
    powers = np.full(symbols.shape[1] + 1, _BASE, _U64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=_U64)
    prefix = np.zeros((len(symbols), symbols.shape[1] + 1), _U64)
    np.cumsum(symbols * powers[:-1], axis=1, dtype=_U64, out=prefix[:, 1:])
    return prefix[:, -1].copy(), prefix, powers


def neighbourhood(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word of one length, given as rows of symbols from 1, and of all words one edit away.

    Hashes of edited words come from prefix sums in constant time, whatever the length; each edited word comes once.
    """
    n, length = symbols.shape
    symbols = symbols.astype(_U64)
    own, prefix, powers = _hashes(symbols)
    rows, out = [np.arange(n)], [own]

    def add(h: np.ndarray, wanted: np.ndarray) -> None:
        row, at = np.nonzero(wanted)
        rows.append(row)
        out.append(h[row, at])

    other = np.ones((n, length), bool)
    other[:, 1:] = symbols[:, 1:] != symbols[:, :-1]  # in a stretch of one symbol, any deletion gives the same
    add(prefix[:, :-1] + (own[:, None] - prefix[:, 1:]) * _U64(_INVERSE), other)
    for s in map(_U64, range(1, alphabet + 1)):
        changed = symbols != s
        add(own[:, None] + (s - symbols) * powers[:-1], changed)
        # before an equal symbol an insertion gives the same as behind it
        before = np.ones((n, length + 1), bool)
        before[:, :-1] = changed
        add(prefix + s * powers + (own[:, None] - prefix) * _U64(_BASE), before)
    return np.concatenate(rows), np.concatenate(out)


def _symbols(words: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("ascii"), np.uint8)
    return codes.reshape(len(words), -1) - (ord("A") - 1)


def _by_length(words: list[str], cells: int, per_cell: int) -> Iterator[np.ndarray]:
    """Indexes of the words, gathered by length, few enough for the cells they open."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        found = np.flatnonzero(lengths == length)
        step = max(1, cells // (int(length) * per_cell))
        for at in range(0, len(found), step):
            yield found[at:at + step]


def reduced_links(vocab: DataFrame, p: VariantParams) -> DataFrame:
    """(a, b), a <= b: hashes of reduced words of the vocabulary that are equal or one edit apart.

    A pair comes once, unless reduced words share a hash.  The full neighbourhood of every distinct reduced word is joined with the reduced vocabulary.
    """
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["reduced"].tolist()
            for some in _by_length(words, p.batch_cells, 2 * p.symbols):
                row, h = neighbourhood(_symbols([words[k] for k in some]), p.symbols)
                own, h = h[:len(some)].view(np.int64)[row], h.view(np.int64)
                upward = h >= own  # the other word has this one in its neighbourhood, too
                yield pd.DataFrame({"a": own[upward], "b": h[upward]})

    distinct = vocab.select("reduced").distinct()
    known = vocab.select(F.col("class").alias("b")).distinct()
    return distinct.mapInPandas(expand, "a long, b long").join(known, "b", "left_semi")


def with_class(vocab: DataFrame, p: VariantParams) -> DataFrame:
    """The vocabulary with each word's reduced form and its hash, ``class``."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["reduced"].tolist()
            out = np.empty(len(words), np.int64)
            for some in _by_length(words, p.batch_cells, 1):
                out[some] = _hashes(_symbols([words[k] for k in some]).astype(_U64))[0].view(np.int64)
            yield batch.assign(**{"class": out})

    return vocab.select("word", "n", reduced(F.col("word"), p).alias("reduced")).mapInPandas(
        hashed, "word string, n long, reduced string, class long")


def near_words(vocab: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """(word, n, other, other_n): words of the vocabulary (word, n) exactly one edit apart, in both directions.

    An edit of a word changes its reduced form by one edit or not at all, so reduced forms that are linked hold all
    pairs; those are verified on the words themselves.  Classes that share a reduced form are split
    into blocks and compared block by block, so that none has to fit a task.
    """
    vocab = staged(with_class(vocab, p), "reduced")
    sizes = vocab.groupBy("class").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    placed = vocab.join(sizes, "class").select(
        "word", "n", "class", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"))
    links = reduced_links(vocab, p)
    many = sizes.where("blocks > 1")

    def blocks(side: str) -> DataFrame:
        return many.select(F.col("class").alias(side), F.sequence(F.lit(0), F.col("blocks") - 1).alias(f"{side}_blocks"))

    tiles = links.join(blocks("a"), "a", "left").join(blocks("b"), "b", "left")
    for side in ("a", "b"):
        tiles = tiles.withColumn(f"{side}_block", F.explode(F.coalesce(f"{side}_blocks", F.array(F.lit(0)))))

    def words(side: str) -> DataFrame:
        return placed.select(F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}"),
                             F.col("class").alias(side), F.col("block").alias(f"{side}_block"))

    left = tiles.select("a", "b", "a_block", "b_block").join(words("a"), ["a", "a_block"])
    right = words("b")
    met = (left["b"] == right["b"]) & (left["b_block"] == right["b_block"])
    verified = (F.levenshtein("word_a", "word_b", 1) == 1) & ((left["a"] != left["b"]) | (F.col("word_a") < F.col("word_b")))
    pairs = left.join(right, met & verified).select("word_a", "n_a", "word_b", "n_b").distinct()
    both = F.explode(F.array(F.struct(F.col("word_a").alias("word"), F.col("n_a").alias("n"), F.col("word_b").alias("other"),
                                      F.col("n_b").alias("other_n")),
                             F.struct(F.col("word_b").alias("word"), F.col("n_b").alias("n"), F.col("word_a").alias("other"),
                                      F.col("n_a").alias("other_n"))))
    return pairs.select(both.alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the chain of forms that starts at each word, by pointer doubling.

    A form is more frequent than its word, so chains end, and their length is logarithmic in the counts.
    """
    reached = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = staged(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                              F.col("further").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(counts: DataFrame, p: VariantParams = VariantParams()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary that ``counts`` (word, n) make up.

    ``form`` is the most frequent word one edit away (ties: the smallest in code-point order) if it is ``dominance``
    times as frequent as the word, ``root`` what the forms of forms lead to.  Null words don't count; an empty table
    gives an empty one; other columns are ignored.
    """
    vocab = staged(vocabulary(counts, p), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    near = near_words(vocab, p).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    dominant = form_n >= p.dominance * F.col("n")
    judged = staged(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(dominant, F.col("best.form")).alias("form"),
        F.when(dominant, form_n).alias("form_n")), "forms")
    return judged.join(roots(judged.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def one_letter_less(doc_id: int | None, runs: list[str]) -> list[str]:
    """The edit of the contract: one run of 97, told by the checksum of document and run, lacks a letter.

    Without doc_id the checksum is that of ``:<run>``.
    """
    before, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), []
    for run in runs:
        h = zlib.crc32(run.encode(), before)
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out.append(run)
    return out
