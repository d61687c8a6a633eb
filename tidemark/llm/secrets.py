"""Secret scans: fixed forms, and strings that stay new to a primed compressor."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential",
              "private_key", "private key", "access key", "access_key", "auth", "bearer", "signature", "client_id",
              "connection string", "webhook", "session")
_SENSITIVE_WORD = re.compile("|".join(map(re.escape, _SENSITIVE)), re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}", re.ASCII)
_CLASSES = bytes.maketrans(bytes(range(128)), bytes(
    ord("a") if chr(c).islower() else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else ord("-")
    for c in range(128)))
_DICTIONARY = (
    "import from class def return self public static void private protected final const let var function async await "
    "string integer boolean float double long char byte null none true false undefined new delete throw catch try "
    "except finally raise yield lambda while for each if else elif switch case break continue default "
    "username password passwd secret token api_key apikey access_key client_id client_secret authorization bearer "
    "private_key public_key credential session cookie signature certificate connection_string webhook endpoint "
    "http:// https:// www. .com .org .net /usr/local/bin /etc/ /home/ /var/log localhost 127.0.0.1 "
    "config settings environment production development staging test example sample placeholder changeme your_ "
    "request response header content-type application/json text/html utf-8 base64 encode decode hash sha256 md5 "
    "get set put post update insert select where order by group limit join create table index primary key "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef qwertyuiop "
).encode()


@dataclass(frozen=True)
class NoveltyParams:
    """A candidate is a string of 8 or more letters, digits and signs that changes between those kinds ``changes`` times,
    with a sensitive word in itself or within ``reach`` characters before or behind it.

    The ``context`` characters on both sides prime the compressor.  Reported are candidates that add ``least_bytes`` or
    more, and ``least_share`` of a byte per character.  ``reach`` and ``context`` are part of what is asked for: a word
    further away doesn't make a string sensitive, and text further away doesn't make it known.
    """

    context: int = 512
    reach: int = 64
    changes: int = 3
    least_bytes: int = 7
    least_share: float = 0.55


class NoveltyMeter:
    """Marginal compressed bytes of a string behind its surroundings, both primed with code and identifiers."""

    def __init__(self):
        words = zstandard.ZstdCompressionDict(_DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=12, dict_data=words, write_content_size=False,
                                                   write_checksum=False, write_dict_id=False)

    def __call__(self, surroundings: str, candidate: str) -> int:
        plain = surroundings.encode("utf-8", "replace")
        return len(self.compressor.compress(plain + candidate.encode())) - len(self.compressor.compress(plain))


@dataclass(frozen=True)
class Found:
    """A measured string: ``start`` and ``end`` of what is reported, in code points, and of the string ``measured``."""

    start: int
    end: int
    kind: str
    measured: tuple[int, int]
    novelty: int = 0


def base_found(text: str) -> list[Found]:
    """The fixed forms, leftmost and without overlap within a kind."""
    low, out = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [Found(*m.span(), "assign", m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [Found(*m.span(), "access", m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [Found(*m.span(), "hex", m.span()) for m in _HEX.finditer(text)]
    return out


def candidates(text: str, p: NoveltyParams) -> Iterator[tuple[int, int]]:
    """Spans of all strings of mixed kinds in sensitive surroundings."""
    low = text.lower()
    if not any(w in low for w in _SENSITIVE):
        return
    words = [m.span() for m in _SENSITIVE_WORD.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    for m in _CANDIDATE.finditer(text):
        kinds = m[0].encode().translate(_CLASSES)
        if sum(a != b for a, b in zip(kinds, kinds[1:])) < p.changes or not (any(c == 48 for c in kinds) and any(c > 57 for c in kinds)):
            continue
        # the first word that ends at or behind the start of what is near, if it begins before its end
        k = bisect_left(ends, m.start() - p.reach + 1)
        if k < len(words) and starts[k] < m.end() + p.reach:
            yield m.span()


def all_found(text: str, meter: NoveltyMeter, p: NoveltyParams) -> tuple[list[Found], list[Found]]:
    """(fixed forms, candidates that lie in none of them), all with their marginal bytes."""
    def measured(f: Found) -> Found:
        start, end = f.measured
        around = text[max(0, start - p.context):start] + " " + text[end:end + p.context] + " "
        return replace(f, novelty=meter(around, text[start:end]))

    base = [measured(f) for f in base_found(text)]
    # furthest end of the fixed forms that start up to each of them
    spans = sorted((f.start, f.end) for f in base)
    begins, furthest = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    others = []
    for start, end in candidates(text, p):
        k = bisect_right(begins, start)
        if not (k and furthest[k - 1] >= end):
            others.append(measured(Found(start, end, "novel", (start, end))))
    return base, others


def is_novel(f: Found, p: NoveltyParams) -> bool:
    return f.novelty >= max(p.least_bytes, p.least_share * (f.measured[1] - f.measured[0]))


def _ordered(found: list[Found]) -> list[Found]:
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def _joined(found: list[Found]) -> str:
    return ",".join(f"{f.kind}:{f.start}:{f.end}" for f in _ordered(found))


def scan(docs: DataFrame, p: NoveltyParams = NoveltyParams()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, n_measured, novelty) of every row's whole text.

    Every fixed form and every string in sensitive surroundings is measured; ``novelty`` lists their marginal bytes as
    start:end:bytes of the measured string, those that are not reported too.  Spans count code points, end exclusive.
    Null text is empty and has none.  Rows are independent of each other; other columns are ignored.
    """
    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, "
                  "n_measured long, novelty string")
    def found(texts: pd.Series) -> pd.DataFrame:
        meter, rows = NoveltyMeter(), []
        for text in texts:
            base, others = all_found(text or "", meter, p)
            spans = base + [f for f in others if is_novel(f, p)]
            counts = [sum(f.kind == k for f in spans) for k in KINDS]
            listed = ",".join(f"{f.measured[0]}:{f.measured[1]}:{f.novelty}" for f in _ordered(base + others))
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                         len(base) + len(others), listed))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_measured", "novelty"])

    return docs.select("doc_id", found("text").alias("found")).select("doc_id", "found.*")
