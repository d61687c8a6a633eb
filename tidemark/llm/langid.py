"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_PAIRS = 1 << 16
_TRIPLES = 1 << 16
_FEATURES = _PAIRS + _TRIPLES
_BLOCK = 1 << 20


@dataclass(frozen=True)
class LanguageParams:
    """``smoothing`` is added to every n-gram count; a score below ``ambiguous`` flags a text."""

    smoothing: float = 0.5
    ambiguous: float = 0.05
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    """Codeword per language (rows of +1/-1), n-gram weights and weight per bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def _ngrams(text: str) -> Iterator[np.ndarray]:
    """Indices of the byte pairs and triples of the lower-cased text, block by block."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(raw) - 1, _BLOCK):
        part = raw[at:at + _BLOCK + 2].astype(np.uint32)
        pairs = part[:-1] << 8 | part[1:]
        if at + _BLOCK + 2 <= len(raw):
            pairs = pairs[:-1]  # the next block starts with it
        yield pairs
        if len(part) > 2:
            triple = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            yield (triple * np.uint32(2654435761) >> np.uint32(16)) + np.uint32(_PAIRS)


def _counts(labelled: DataFrame) -> DataFrame:
    """(lang, feature, n) over whole texts, summed per task first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "feature": at.astype(np.int32), "n": total[at]})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang not in held and len(held) >= 64:
                    yield from flush()
                total = held.setdefault(lang, np.zeros(_FEATURES, np.int64))
                for grams in _ngrams(text):
                    total += np.bincount(grams, minlength=_FEATURES)
        yield from flush()

    return (labelled.select("lang", "text").mapInPandas(run, "lang string, feature int, n long")
            .groupBy("lang", "feature").agg(F.sum("n").alias("n")))


def code_matrix(n: int, seed: int) -> np.ndarray:
    """Codewords in rows: every two-way split up to five languages, else seeded random columns.

    Of many random matrices that with the largest smallest distance is taken.
    """
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        columns = np.arange(1, 2 ** (n - 1))
        bits = (columns[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.zeros(len(columns), int), bits]).astype(np.int8) * 2 - 1
    rng = np.random.default_rng(seed)
    best, distance = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n))))).astype(np.int8)
        code = code[:, np.abs(code.sum(0, dtype=int)) < n]
        agree = code.astype(int) @ code.T
        np.fill_diagonal(agree, -code.shape[1])
        if (found := (code.shape[1] - agree.max()) // 2) > distance:
            best, distance = code, found
    return best


def train(labelled: DataFrame, p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Model of all rows with a text and a language (columns ``text``, ``lang``).

    Every row counts, no sample is taken.  To the driver come n-gram totals, at most
    131,072 per language whatever the size of the corpus.  One binary classifier per bit
    weighs each n-gram by its log-odds between the languages on either side of the
    bit, each language counting alike.
    """
    total = _counts(labelled.where("lang is not null and text is not null")).toPandas()
    languages = sorted(total["lang"].unique())
    counts = np.zeros((len(languages), _FEATURES))
    place = {lang: k for k, lang in enumerate(languages)}
    counts[total["lang"].map(place).to_numpy(int), total["feature"].to_numpy(int)] = total["n"].to_numpy(float)
    counts += p.smoothing
    share = counts / counts.sum(1, keepdims=True) if len(languages) else counts
    codes = code_matrix(len(languages), p.seed)
    weights = np.empty((_FEATURES, codes.shape[1]), np.float32)
    trust = np.empty(codes.shape[1])
    for k in range(codes.shape[1]):
        plus, minus = share[codes[:, k] > 0].mean(0), share[codes[:, k] < 0].mean(0)
        log_odds = np.log(plus / minus)
        weights[:, k] = log_odds
        trust[k] = ((plus - minus) * log_odds).sum()  # expected margin between the two sides
    if len(trust):
        trust /= trust.sum()
    return LanguageModel(languages, codes, weights, trust)


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[str, float]:
    """Codeword of the smallest trust-weighted logistic loss, and how far it leads (0 to 1)."""
    loss = np.logaddexp(0, -model.codes * margins[None, :]) @ model.trust
    order = np.argsort(loss, kind="stable")
    best, second = loss[order[0]], loss[order[1]]
    return model.languages[order[0]], float(1 - best / second) if second > 0 else 0.0


def identify(docs: DataFrame, model: LanguageModel, p: LanguageParams = LanguageParams()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous`` added (replacing columns of these names).

    Only ``text`` is read.  Null texts and texts without a letter, and all texts where the model
    knows no language, are ``und`` with score 0 and flagged.  With one language, every other text is it.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None or not model.languages or not any(map(str.isalpha, text)):
                rows.append((UNDETERMINED, 0.0, True))
                continue
            if len(model.languages) == 1:
                rows.append((model.languages[0], 1.0, False))
                continue
            margins = np.zeros(model.weights.shape[1])
            for grams in _ngrams(text):
                margins += model.weights[grams].sum(0, dtype=np.float64)
            lang, score = decode(model, margins)
            rows.append((lang, score, score < p.ambiguous))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous"])

    found = docs.withColumn("_found", predict("text"))
    return found.select(*docs.columns, "_found.lang_pred", "_found.score", "_found.ambiguous")


def held_out(doc_id) -> F.Column:
    """The fold kept from training: crc32 of the id's text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train_on_fold(docs: DataFrame, p: LanguageParams = LanguageParams()) -> LanguageModel:
    return train(docs.where(~held_out("doc_id")).select("text", F.col("lang").cast("string").alias("lang")), p)
