"""Near-duplicate groups by SetSketch registers, banding, likelihood and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.components import connected

_U64 = np.uint64
_PAIRS_AT_ONCE = 1 << 16
_SKETCH = "key long, n long, signature binary, registers binary, bits binary, bands array<long>"


@dataclass(frozen=True)
class SketchParams:
    """Defaults miss a pair of similarity 0.75 with probability 5e-6, a closer one less often.

    ``base`` spaces the registers exponentially; ``rate`` and ``top`` set the range
    they are truncated to.  ``slack`` is the number of standard deviations below the
    threshold at which the likelihood estimate rejects a pair.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    top: int = 65534
    bitmap_bytes: int = 256
    slack: float = 5.0
    probe_block: int = 512
    member_block: int = 4096
    seed: int = 20240229

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64-bit words."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence where it is shorter."""
    if not words:
        return np.empty(0, _U64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), seed=len(words))], _U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, _U64)
    for j in range(size):
        total = _mix(total + h[j:j + n] + _U64(j + 1))
    return np.unique(total)


class Sketcher:
    """Registers, bitmap and band keys of shingle sets."""

    def __init__(self, p: SketchParams):
        self.p = p
        rng = np.random.default_rng(p.seed)
        self.mul = rng.integers(1, 2**63, (p.registers, 1), dtype=np.uint64) * _U64(2) + _U64(1)
        self.add = rng.integers(0, 2**63, (p.registers, 1), dtype=np.uint64)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.p.registers, 2**64 - 1, _U64)
        for at in range(0, len(hashes), 1024):
            part = hashes[None, at:at + 1024] * self.mul
            part += self.add
            np.minimum(least, part.min(axis=1), out=least)
        return least

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """Minima of exponential variables, on an exponential scale, truncated: mergeable by maximum."""
        u = (self.minima(hashes).astype(np.float64) + 0.5) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / self.p.rate
        k = np.floor(1 - np.log(x) / np.log(self.p.base))
        return np.clip(k, 0, self.p.top + 1).astype(np.uint16)

    def bitmap(self, hashes: np.ndarray) -> bytes:
        bits = np.zeros(self.p.bitmap_bytes * 8, np.uint8)
        bits[(hashes % _U64(self.p.bitmap_bytes * 8)).astype(np.int64)] = 1
        return np.packbits(bits).tobytes()

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        rows = registers.reshape(self.p.bands, self.p.rows).astype(_U64)
        key = np.arange(self.p.bands, dtype=_U64)
        for j in range(self.p.rows):
            key = _mix(key * _U64(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64)


def likelihood_jaccard(above, below, equal, n_a, n_b, base: float) -> np.ndarray:
    """Maximum of the joint likelihood of the register comparison, given both set sizes.

    ``above``, ``below``, ``equal`` count registers of a that are larger, smaller, the same.
    The derivative falls with J, so bisection finds the maximum.
    """
    above, below, equal = (np.asarray(x, np.float64) for x in (above, below, equal))
    u = np.asarray(n_a, np.float64) / (np.asarray(n_a) + np.asarray(n_b))
    v = 1 - u
    c = (base - 1) / base

    def log_likelihood(j):
        more = -np.log1p(-np.clip(u - v * j, 1e-12, 1) * c) / np.log(base)
        less = -np.log1p(-np.clip(v - u * j, 1e-12, 1) * c) / np.log(base)
        same = np.clip(1 - more - less, 1e-12, 1)
        return above * np.log(more) + below * np.log(less) + equal * np.log(same)

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(25):  # ternary search on a concave function
        one, two = low + (high - low) / 3, high - (high - low) / 3
        better = log_likelihood(one) < log_likelihood(two)
        low, high = np.where(better, one, low), np.where(better, high, two)
    return (low + high) / 2


def _sketches(docs: DataFrame, p: SketchParams) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Sketcher(p)
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                h = shingle_hashes(words_of(text), p.shingle)
                if not len(h):
                    rows.append((key, 0, None, None, None, None))
                    continue
                r = s.registers(h)
                signature = xxhash.xxh3_128_digest(h.tobytes())
                rows.append((key, len(h), signature, r.tobytes(), s.bitmap(h), s.band_keys(r)))
            yield pd.DataFrame(rows, columns=["key", "n", "signature", "registers", "bits", "bands"])

    return docs.mapInPandas(run, _SKETCH)


def _bounded(a: dict, b: dict, p: SketchParams) -> np.ndarray:
    """Which pairs may reach the threshold by strict bounds: a bit set in a only stands for an element of a only."""
    only_a = np.bitwise_count(a["bits"] & ~b["bits"]).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b["bits"] & ~a["bits"]).sum(-1, dtype=np.int64)
    both = np.minimum(a["n"] - only_a, b["n"] - only_b)
    return 100 * both >= p.percent * (a["n"] + b["n"] - both)


def _likely(a: dict, b: dict, p: SketchParams) -> np.ndarray:
    """Which pairs the likelihood estimate leaves near the threshold or above."""
    share = p.percent / 100
    ra, rb = a["registers"], b["registers"]
    estimate = likelihood_jaccard((ra > rb).sum(-1), (ra < rb).sum(-1), (ra == rb).sum(-1), a["n"], b["n"], p.base)
    return estimate >= share - p.slack * np.sqrt(share * (1 - share) / p.registers)


def _taken(x: dict, at: np.ndarray) -> dict:
    return {c: v[at] for c, v in x.items()}


def _arrays(frame: pd.DataFrame, suffix: str, p: SketchParams) -> dict:
    bits, registers = (b"".join(frame[c + suffix]) for c in ("bits", "registers"))
    return {"n": frame["n" + suffix].to_numpy(np.int64),
            "bits": np.frombuffer(bits, np.uint64).reshape(len(frame), p.bitmap_bytes // 8),
            "registers": np.frombuffer(registers, np.uint16).reshape(len(frame), p.registers)}


def _side(frame: DataFrame, suffix: str, *columns: str) -> DataFrame:
    return frame.select(F.col("key").alias(suffix), *[F.col(c).alias(c + "_" + suffix) for c in columns])


def _verified(pairs: DataFrame, sets: DataFrame, p: SketchParams) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    joined = pairs.join(_side(sets, "a", "elements"), "a").join(_side(sets, "b", "elements"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["elements_a"], batch["elements_b"], strict=True):
                x, y = np.frombuffer(x, _U64), np.frombuffer(y, _U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield batch.loc[good, ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def _star_pairs(members: DataFrame, sketches: DataFrame, p: SketchParams) -> DataFrame:
    """Each bucket's members beside its first and its last one, as far as the sketches allow."""
    ends = members.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    pairs = (members.join(ends, "band").select("key", F.explode(F.array("first", "last")).alias("other"))
             .where("key <> other")
             .select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct())
    columns = ("n", "bits", "registers")
    joined = pairs.join(_side(sketches, "a", *columns), "a").join(_side(sketches, "b", *columns), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = _arrays(batch, "_a", p), _arrays(batch, "_b", p)
                at = np.flatnonzero(_bounded(a, b, p))
                yield batch[["a", "b"]].iloc[at[_likely(_taken(a, at), _taken(b, at), p)]]

    return joined.mapInPandas(run, "a long, b long")


def _other_pairs(members: DataFrame, known: DataFrame, sketches: DataFrame, p: SketchParams) -> DataFrame:
    """Plausible pairs of buckets whose members are not yet all in one component.

    Members outside a bucket's main component are held against the whole bucket, in
    tiles of bounded size, each its own group; only plausible pairs leave a tile.
    """
    labelled = (members.join(known.withColumnRenamed("node", "key"), "key", "left")
                .withColumn("component", F.coalesce("component", "key")))
    split = (labelled.groupBy("band", "component").agg(F.count("*").alias("size"))
             .groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("main"),
                                  F.sum("size").alias("n_members"), F.max("size").alias("n_main"),
                                  F.count("*").alias("n_components"))
             .where("n_components > 1"))
    rows = labelled.join(split, "band").withColumn("probe", F.col("component") != F.col("main"))
    n_probe = F.ceil((F.col("n_members") - F.col("n_main")) / p.probe_block).cast("int")
    n_member = F.ceil(F.col("n_members") / p.member_block).cast("int")
    place = F.xxhash64("key", F.lit(p.seed))
    as_probe = (rows.where("probe")
                .withColumn("i", F.pmod(place, n_probe).cast("int"))
                .withColumn("j", F.explode(F.sequence(F.lit(0), n_member - 1))).withColumn("left", F.lit(True)))
    as_member = (rows.withColumn("j", F.pmod(place, n_member).cast("int"))
                 .withColumn("i", F.explode(F.sequence(F.lit(0), n_probe - 1))).withColumn("left", F.lit(False)))
    keep = ("band", "i", "j", "left", "key", "component", "probe")
    tiles = as_probe.select(*keep).union(as_member.select(*keep)).join(
        sketches.select("key", "n", "bits", "registers"), "key")

    def plausible(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        """Pairs of whole tiles, which begin at ``starts``; many small tiles are compared at once."""
        x, held, n_held = _arrays(frame, "", p), [], 0
        keys, components, left, probes = (frame[c].to_numpy() for c in ("key", "component", "left", "probe"))

        def flush() -> pd.DataFrame:
            i, j = np.concatenate(held, axis=1)
            at = np.flatnonzero(_bounded(_taken(x, i), _taken(x, j), p))
            at = at[_likely(_taken(x, i[at]), _taken(x, j[at]), p)]
            a, b = keys[i[at]], keys[j[at]]
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        for start, end in zip(starts, [*starts[1:], len(frame)], strict=True):
            mine = start + np.flatnonzero(left[start:end])
            others = start + np.flatnonzero(~left[start:end])
            step = max(1, _PAIRS_AT_ONCE // max(1, len(others)))
            for at in range(0, len(mine) if len(others) else 0, step):
                part = mine[at:at + step]
                i, j = np.repeat(part, len(others)), np.tile(others, len(part))
                good = (components[i] != components[j]) & (~probes[j] | (keys[j] > keys[i]))
                good &= 100 * np.minimum(x["n"][i], x["n"][j]) >= p.percent * np.maximum(x["n"][i], x["n"][j])
                held.append(np.stack([i[good], j[good]]))
                n_held += held[-1].shape[1]
                if n_held >= _PAIRS_AT_ONCE:
                    yield flush()
                    held, n_held = [], 0
        if held:
            yield flush()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            new = np.ones(len(frame), bool)
            new[1:] = np.logical_or.reduce([np.diff(frame[c].to_numpy()) != 0 for c in ("band", "i", "j")])
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield from plausible(frame.iloc[:starts[-1]], starts[:-1])
            rest = frame.iloc[starts[-1]:]  # may go on in the next batch
        if rest is not None:
            yield from plausible(rest.reset_index(drop=True), np.zeros(1, int))

    ordered = tiles.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    p: SketchParams = SketchParams()) -> DataFrame:
    """Component of every document under links of Jaccard similarity ``percent`` or more.

    Returns (id, n_shingles, component_id), one row per input row.  Null or blank
    texts have an empty set and are linked with nothing.  Rows that repeat an id count
    as one document if their texts agree; differing texts under one id are linked through
    it.  A null id is kept with a null component.  Other columns are ignored.

    Documents with the same set collapse to the smallest id first.  Registers of the
    others are cut into bands; bucket members are tried against the bucket's ends, and what
    that leaves unconnected is compared in tiles, so a bucket of near copies costs
    its size, not its square.  Every link is confirmed on full sets.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    sketched = staged(_sketches(docs, p), "sketches")
    named = sketched.where("key is not null and n > 0")
    classes = staged(named.groupBy("signature").agg(F.min("key").alias("class")), "classes")
    # every row of an id whose texts disagree keeps its own class; the id ties them together
    ties = named.select("key", "signature").distinct().join(classes, "signature").select("key", "class")
    first = (named.join(classes.withColumnRenamed("class", "key"), ["signature", "key"], "left_semi")
             .dropDuplicates(["key", "signature"]))
    members = staged(first.select("key", F.explode(F.array_distinct("bands")).alias("band")).distinct(), "bands")
    shared = members.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    members = staged(members.join(shared, "band"), "buckets")
    needed = members.select("key").distinct()
    sketches = staged(first.join(needed, "key", "left_semi").select("key", "n", "bits", "registers"), "shared")

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(words_of(t), p.shingle).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "elements": sets,
                                "signature": [xxhash.xxh3_128_digest(x) for x in sets]})

    sets = staged(docs.join(needed, "key").mapInPandas(elements, "key long, elements binary, signature binary")
                  .join(first.select("key", "signature"), ["key", "signature"], "left_semi")
                  .dropDuplicates(["key", "signature"]), "sets")
    links = staged(_verified(staged(_star_pairs(members, sketches, p), "pairs"), sets, p), "links")
    known = staged(connected(links), "components")
    rest = staged(_verified(staged(_other_pairs(members, known, sketches, p), "pairs"), sets, p), "links")
    by_id = ties.select(F.col("class").alias("a"), F.col("key").alias("b")).where("a <> b")
    final = staged(connected(links.union(rest).union(by_id)), "components")
    return (sketched.select("key", F.col("n").alias("n_shingles"))
            .join(final.withColumnRenamed("node", "key"), "key", "left")
            .select(F.col("key").alias(id_column), "n_shingles",
                    F.coalesce("component", "key").alias("component_id")))
