"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

_U64 = np.uint64
_BLANKS = bytes.maketrans(string.punctuation.encode() + string.ascii_uppercase.encode(),
                          b" " * len(string.punctuation) + string.ascii_lowercase.encode())


@dataclass(frozen=True)
class SeedParams:
    """``gram`` words make a seed.  A seed is rare if ``rare_items`` different items hold it at most.

    One rare seed opens a pair of passage and item.  Without one, the passage must hold ``common_share`` of the item's
    seeds; so only that many of them need be joined that, of any such share, one is among them, the rarest first.
    With ``all_seeds`` each seed opens pairs, the exact way against which the recall of the default is measured.

    The filter of seeds has ``filter_bits`` bits whatever the benchmark's size; a fuller filter lets more
    passages through to the join, never fewer.  ``margin`` words around a run of seeds are aligned with.
    A document copies an item if its passages align with parts of it that together reach ``threshold`` of the score of a
    verbatim copy, parts below ``least_part`` left out, or if one of them scores like ``long_match`` words in a row.
    ``hot_rows`` and ``salts`` only spread the work: seeds with more hits are joined over that many parts.
    """

    gram: int = 4
    rare_items: int = 16
    common_share: float = 1 / 3
    all_seeds: bool = False
    salts: int = 32
    hot_rows: int = 1 << 16
    filter_bits: int = 1 << 22
    margin: int = 64
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5
    least_part: float = 0.2
    long_match: int = 50


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words in lower case, ASCII punctuation counting as blanks."""
    return [] if text is None else text.lower().encode("utf-8", "replace").translate(_BLANKS).split()


def gram_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of the words from each position on; a shorter text is one gram."""
    if not words:
        return np.empty(0, _U64)
    size = min(size, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, len(words))
    total = np.zeros(len(words) - size + 1, _U64)
    for j in range(size):
        total = total * _U64(0x9E3779B97F4A7C15) + h[j:j + len(total)]
        total ^= total >> _U64(29)
    return total


def _seeds(items: DataFrame, p: SeedParams) -> DataFrame:
    """(hash, item, at, length) of every gram of every item (item, item_text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["item_text"], strict=True):
                words = words_of(text)
                h = gram_hashes(words, p.gram)
                yield pd.DataFrame({"hash": h.view(np.int64), "item": item,
                                    "at": np.arange(len(h), dtype=np.int32), "length": np.int32(len(words))})

    return items.select("item", "item_text").mapInPandas(run, "hash long, item long, at int, length int")


def _opening(seeds: DataFrame, p: SeedParams) -> DataFrame:
    """The seeds that open pairs, with ``rare``: whether one of them is enough."""
    if p.all_seeds:
        return seeds.withColumn("rare", F.lit(True))
    spread = seeds.groupBy("hash").agg(F.countDistinct("item").alias("items"))
    seeds = seeds.join(spread, "hash").withColumn("rare", F.col("items") <= p.rare_items)
    # one row per seed and item: an item's seeds are as many as its words at most
    distinct = seeds.groupBy("item", "hash", "items").agg(F.first("rare").alias("rare"))
    by_rarity = Window.partitionBy("item").orderBy("items", "hash")
    needed = F.ceil(F.count("*").over(Window.partitionBy("item")) * F.lit(p.common_share))
    placed = distinct.withColumn("place", F.row_number().over(by_rarity)).withColumn(
        "first_of_all", F.col("place") <= F.count("*").over(Window.partitionBy("item")) - needed + 1)
    chosen = placed.where("rare or first_of_all").select("item", "hash")
    return seeds.join(chosen, ["item", "hash"]).drop("items")


def _filter_of(seeds: DataFrame, p: SeedParams) -> np.ndarray:
    """Bit table of the seeds' hashes: one of fixed size per task comes to the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(p.filter_bits, np.uint8)
        for batch in batches:
            bits[batch["hash"].to_numpy().view(_U64) % _U64(p.filter_bits)] = 1
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    total = np.zeros(p.filter_bits // 8, np.uint8)
    for row in seeds.select("hash").coalesce(8).mapInPandas(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def _passages(docs: DataFrame, table: np.ndarray, p: SeedParams) -> DataFrame:
    """Stretches of documents around hits of the filter, with the hits' hashes and places."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(table).astype(bool)
        for batch in batches:
            rows = []
            for doc_id, tag, text in zip(batch["doc_id"], batch["tag"], batch["text"], strict=True):
                words = words_of(text)
                h = gram_hashes(words, p.gram)
                at = np.flatnonzero(bits[h % _U64(p.filter_bits)])
                if not len(at):
                    continue
                for run_ in np.split(at, np.flatnonzero(np.diff(at) > p.margin) + 1):
                    low, high = max(0, run_[0] - p.margin), run_[-1] + p.gram + p.margin
                    rows.append((doc_id, tag, low, b" ".join(words[low:high]), h[run_].view(np.int64),
                                 (run_ - low).astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "tag", "low", "words", "hashes", "places"]).astype(
                {"doc_id": "Int64"})

    return docs.mapInPandas(run, "doc_id long, tag long, low long, words binary, hashes array<long>, places array<int>")


def align(passage: np.ndarray, item: np.ndarray, p: SeedParams) -> tuple[int, int, int, int, int]:
    """Smith-Waterman over word numbers: best local score, its first and last word in the passage and in the item."""
    steps = np.arange(len(item) + 1) * -p.gap
    row, began = np.zeros(len(item) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
    here = np.arange(len(item) + 1)
    item_began = here.copy()
    best = (0, 0, -1, 0, -1)
    for i, word in enumerate(passage):
        diagonal = row[:-1] + np.where(item == word, p.match, p.mismatch)
        upper = row[1:] + p.gap
        new, start, item_start = np.zeros_like(row), np.full_like(began, i + 1), here.copy()
        take = diagonal >= upper
        new[1:] = np.maximum(np.where(take, diagonal, upper), 0)
        fresh, alive = row[:-1] <= 0, new[1:] > 0
        start[1:] = np.where(alive, np.where(take, np.where(fresh, i, began[:-1]), began[1:]), i + 1)
        item_start[1:] = np.where(alive, np.where(take, np.where(fresh, here[:-1], item_began[:-1]), item_began[1:]), here[1:])
        # gaps in the passage: the best start to the left, less a step per word
        lifted = new + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, here, 0))
        row, began, item_began = reach - steps, start[source], item_start[source]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(began[top]), i, int(item_began[top]), top - 1)
    return best


def _aligned(passage: bytes, low_at: int, high_at: int, text: str, rare: bool, p: SeedParams) -> tuple[int, ...] | None:
    """(score, first and last word in the passage, first and last in the item, score of the whole item) where it counts."""
    item, words = words_of(text), passage.split(b" ")
    low = max(0, low_at - len(item) // 4 - p.gram)
    words = words[low:high_at + len(item) // 4 + p.gram]
    number = {w: k for k, w in enumerate(dict.fromkeys(item))}
    held, asked = np.array([number.get(w, -1) for w in words]), np.array([number[w] for w in item])
    # no alignment scores more than the words both have
    common = np.minimum(np.bincount(held[held >= 0], minlength=len(number)), np.bincount(asked)).sum()
    least = min(p.least_part * len(item), p.long_match)
    if common < least:
        return None
    if not rare:
        of_item = np.unique(gram_hashes(item, p.gram))
        if np.isin(of_item, gram_hashes(words, min(p.gram, len(item)))).sum() < p.common_share * len(of_item):
            return None
    score, first, last, item_first, item_last = align(held, asked, p)
    if score < least * p.match:
        return None
    return score, low + first, low + last, item_first, item_last, p.match * len(item)


def _together(parts: list[tuple[int, ...]]) -> tuple[int, int, int]:
    """Score of the best parts that share no word of the item nor of the text, with the place of the best of them.

    ``parts`` are (score, first and last word in the text, first and last in the item).
    """
    taken: list[tuple[int, ...]] = []
    for part in sorted(parts, key=lambda x: (-x[0], x[1], x[2], x[3])):
        if all((part[1] > t[2] or part[2] < t[1]) and (part[3] > t[4] or part[4] < t[3]) for t in taken):
            taken.append(part)
    return sum(t[0] for t in taken), taken[0][1], taken[0][2]


def opened_pairs(passages: DataFrame, seeds: DataFrame, p: SeedParams) -> DataFrame:
    """(passage, item, low_at, high_at, rare): the pairs that seeds open, and where in the passage the item would lie."""
    hits = passages.select("passage", F.explode(F.arrays_zip("hashes", "places")).alias("hit")).select(
        "passage", F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("place"))
    opening = _opening(seeds, p)
    frequency = hits.groupBy("hash").agg(F.count("*").alias("n"))
    counted = staged(opening.join(frequency, "hash").withColumn("hot", F.col("n") > p.hot_rows).drop("n"), "opening")
    hot = counted.where("hot").drop("hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    spread = hits.withColumn("salt", F.pmod("passage", F.lit(p.salts)).cast("int")).join(hot, ["hash", "salt"]).drop("salt")
    return (hits.join(counted.where("not hot").drop("hot"), "hash").unionByName(spread)
            .groupBy("passage", "item")
            .agg(F.min(F.col("place") - F.col("at")).alias("low_at"),
                 F.max(F.col("place") - F.col("at") + F.col("length")).alias("high_at"),
                 F.max("rare").alias("rare")))


def contaminated(docs: DataFrame, benchmark: DataFrame, p: SeedParams = SeedParams()) -> DataFrame:
    """(doc_id, tag, item_id, score, first_word, last_word): which documents copy which items, and the place of the best part.

    Score is that of the alignments, divided by that of the whole item with itself.  ``tag`` is the hash of the
    text, so that rows without or with repeated ids are told apart.  Null or blank texts and items are never
    found; items shorter than a seed are seeded whole.  Items are told apart by their texts, so those without an id are
    found too, with a null item_id; items with equal ids are one item's versions.  Other columns of both tables are ignored.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item"),
                             F.col("text").alias("item_text")).where("item_text is not null")
    items = staged(named.groupBy("item").agg(F.min("item_text").alias("item_text")), "items")
    seeds = staged(_seeds(items, p), "seeds")
    table = _filter_of(seeds, p)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    passages = staged(_passages(docs, table, p).withColumn("passage", F.monotonically_increasing_id()), "passages")
    near = (opened_pairs(passages, seeds, p)
            .join(passages.select("passage", "doc_id", "tag", "low", "words"), "passage").join(items, "item"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                got = _aligned(r.words, r.low_at, r.high_at, r.item_text, r.rare, p)
                if got:
                    value, first, last, item_first, item_last, whole = got
                    rows.append((r.doc_id, r.tag, r.item, value, r.low + first, r.low + last, item_first, item_last, whole))
            yield pd.DataFrame(rows, columns=["doc_id", "tag", "item", *part, "whole"]).astype({"doc_id": "Int64"})

    part = ["value", "first", "last", "item_first", "item_last"]
    scored = near.select("doc_id", "tag", "item", "low", "words", "low_at", "high_at", "rare", "item_text").mapInPandas(
        score, "doc_id long, tag long, item long, value long, first long, last long, item_first long, item_last long, whole long")

    @F.pandas_udf("value long, first_word long, last_word long")
    def together(lists: pd.Series) -> pd.DataFrame:
        found = [_together([tuple(x[c] for c in part) for x in of_pair]) for of_pair in lists]
        return pd.DataFrame(found, columns=["value", "first_word", "last_word"])

    # the parts of one item in one document, as many as the document has passages at most
    pairs = (scored.groupBy("doc_id", "tag", "item").agg(F.collect_list(F.struct(*part)).alias("parts"), F.max("whole").alias("whole"))
             .withColumn("sum", together("parts")).withColumn("score", F.least(F.col("sum.value") / F.col("whole"), F.lit(1.0)))
             .where((F.col("score") >= p.threshold) | (F.array_max("parts.value") >= p.match * p.long_match)))
    best = F.max(F.struct("score", -F.col("sum.first_word"), "sum.last_word")).alias("best")
    return pairs.join(named.select("item_id", "item").distinct(), "item").groupBy("doc_id", "tag", "item_id").agg(best).select(
        "doc_id", "tag", "item_id", F.col("best.score").alias("score"),
        (-F.col("best.col2")).alias("first_word"), F.col("best.last_word").alias("last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: SeedParams = SeedParams()) -> DataFrame:
    """Rows of ``docs`` that copy no benchmark item.  Columns may have any names."""
    found = contaminated(docs, benchmark, p).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("tag"))
    same = packed["row.doc_id"].eqNullSafe(found["_id"]) & (packed["tag"] == found["_tag"])
    return packed.join(found, same, "left_anti").select("row.*")
