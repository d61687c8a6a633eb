"""Line deduplication over range-partitioned hashes, giving compressed keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii
from tidemark.session import pinned

_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineParams:
    """Keys of ``least_length`` code points or more in ``least_documents`` documents are cut to the last one."""

    least_length: int = 20
    least_documents: int = 3


def _lines(docs: DataFrame, p: LineParams) -> DataFrame:
    """(hash, doc_id, position) of every line long enough; keys are stripped and ASCII-lower-cased."""
    line = F.posexplode(F.split(lower_ascii(F.col("text")), "\n", -1))
    return (docs.where("text is not null and doc_id is not null").select("doc_id", line.alias("position", "line"))
            .select("doc_id", "position", F.btrim("line", F.lit(_BLANKS)).alias("key"))
            .where(F.length("key") >= p.least_length)
            .select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"), "doc_id", "position"))


def _runs(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: hashes, ids, and where a new hash or a new document of a hash begins."""
    h = np.frombuffer(b"".join(batch["hash"]), "S16")
    ids = batch["doc_id"].to_numpy()
    new_hash = np.ones(len(h), bool)
    new_hash[1:] = h[1:] != h[:-1]
    new_doc = new_hash.copy()
    new_doc[1:] |= ids[1:] != ids[:-1]
    return h, ids, new_hash, new_doc


class _Count:
    """Number of documents per hash along rows that come in order, from batch to batch."""

    def __init__(self, least: int, carried: tuple | None):
        self.least = least
        self.last_hash, self.last_doc, self.n = carried or (None, None, 0)

    def nth(self, batch: pd.DataFrame) -> np.ndarray:
        """Each row's document's number among its hash's, from 1."""
        h, ids, new_hash, new_doc = _runs(batch)
        goes_on = self.last_hash is not None and bytes(batch["hash"].iloc[0]) == self.last_hash
        if goes_on:
            new_hash[0] = False
            new_doc[0] = ids[0] != self.last_doc
        total = np.cumsum(new_doc)
        base = np.where(new_hash, total - 1, 0)
        nth = total - np.maximum.accumulate(base)
        if goes_on:  # rows before the first new hash go on counting
            upto = int(np.argmax(new_hash)) if new_hash.any() else len(h)
            nth[:upto] += self.n
        self.last_hash, self.last_doc, self.n = bytes(batch["hash"].iloc[-1]), ids[-1], int(nth[-1])
        return nth


def _edges(ordered: DataFrame, p: LineParams) -> list:
    """Per partition its number, its first and last hash with their numbers of documents, its last document.

    One row per partition, whatever their size: what a partition has to know of its neighbours.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, first = _Count(p.least_documents, None), None
        for batch in batches:
            if not len(batch):
                continue
            nth = count.nth(batch)
            h, head = batch["hash"], bytes(batch["hash"].iloc[0])
            if first is None:
                first = [head, 0]
            same = np.array([x == first[0] for x in (h.iloc[0], h.iloc[-1])])
            if same.all():
                first[1] = int(nth[-1])
            elif same[0]:
                first[1] = int(nth[np.frombuffer(b"".join(h), "S16") == np.array([first[0]], "S16")][-1])
        if first:
            yield pd.DataFrame([(TaskContext.get().partitionId(), *first, count.last_hash, int(count.last_doc), count.n)],
                               columns=["part", "hash", "n", "last_hash", "last_doc", "last_n"])

    rows = ordered.mapInPandas(run, "part int, hash binary, n int, last_hash binary, last_doc long, last_n int")
    return sorted(rows.collect(), key=lambda r: r["part"])


def _carried(edges: list) -> dict[int, tuple]:
    """Per partition: what precedes its first hash elsewhere, and how many documents of its last hash follow.

    Equal (hash, document) pairs never part, so counts of neighbours simply add.
    """
    out, before = {}, None
    for r in edges:
        goes_on = before is not None and before[0] == bytes(r["hash"])
        out[r["part"]] = [before if goes_on else None, 0]
        one_hash = bytes(r["last_hash"]) == bytes(r["hash"])
        before = (bytes(r["last_hash"]), r["last_doc"], r["last_n"] + (before[2] if goes_on and one_hash else 0))
    after = None
    for r in reversed(edges):
        last = bytes(r["last_hash"])
        follow = after[1] if after is not None and after[0] == last else 0
        out[r["part"]][1] = follow
        after = (bytes(r["hash"]), r["n"] + (follow if last == bytes(r["hash"]) else 0))
    return {part: tuple(x) for part, x in out.items()}


def dropped_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """(doc_id, position) of all lines to drop.

    Rows are dealt by ranges of (hash, document) and ordered by hash, document from the largest and position, so
    even a line of a third of all documents is spread over tasks.  Each task streams its rows: the
    first document of a hash keeps its lines, the second's wait for the next ones, later ones go.
    What a range shares with its neighbours is one row per partition.
    """
    order = (F.col("hash").asc(), F.col("doc_id").desc())
    ordered = pinned(_lines(docs, p).repartitionByRange(*order).sortWithinPartitions(*order, F.col("position").asc()))
    carried = _carried(_edges(ordered, p))
    least = p.least_documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, after = carried.get(TaskContext.get().partitionId(), (None, 0))
        count, waiting = _Count(least, before), []
        for batch in batches:
            if not len(batch):
                continue
            nth = count.nth(batch)
            frame = batch.assign(nth=nth)
            frame["hash"] = [bytes(x) for x in frame["hash"]]
            last = frame["hash"].iloc[-1]
            whole = pd.concat([*waiting, frame]) if waiting else frame
            total = whole.groupby("hash", sort=False)["nth"].transform("max")
            ended = (whole["hash"] != last).to_numpy()
            drop = ((whole["nth"] > 1) & (total >= least)).to_numpy()
            yield whole.loc[drop, ["doc_id", "position"]]
            # of the hash that may go on, only lines not yet decided wait: fewer than ``least`` documents
            rest = whole[~ended & ~drop & (total < least).to_numpy() & (whole["nth"] > 1).to_numpy()]
            waiting = [rest] if len(rest) else []
        if waiting and count.n + after >= least:
            yield waiting[0][["doc_id", "position"]]

    return ordered.mapInPandas(run, "doc_id long, position int")


def keep_bitmaps(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """(doc_id, keep, n_dropped): documents that lose lines, with a zlib-compressed bitmap of the lines kept.

    Bit k of the unpacked bitmap is line k's; lines beyond its end are kept.  Documents without a row keep everything.
    """
    def pack(positions: list) -> bytes:
        at = np.asarray(positions)
        keep = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)
        keep[at] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    @F.pandas_udf("binary")
    def packed(positions: pd.Series) -> pd.Series:
        return positions.map(pack)

    return (dropped_lines(docs, p).groupBy("doc_id").agg(F.collect_set("position").alias("positions"))
            .select("doc_id", packed("positions").alias("keep"), F.size("positions").cast("long").alias("n_dropped")))


def kept_text(text: str | None, keep: bytes | None) -> str:
    """The lines of ``text`` that the bitmap keeps, joined again."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    return "\n".join([x for k, x in enumerate(lines) if k >= len(bits) or bits[k]])


def line_digests(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row.

    Null or empty text is one empty line.  Rows without an id keep all lines and count for no other.  Rows that
    repeat an id are one document: they count once, and lose lines at the same positions.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maps = keep_bitmaps(docs, p).withColumnRenamed("doc_id", "map_id")

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def digest(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
        rows = []
        for text, keep in zip(texts, keeps, strict=True):
            kept, n = kept_text(text, keep), (text or "").count("\n") + 1
            n_kept = n if keep is None else n - _dropped(keep, n)
            rows.append((n, n - n_kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256"])

    joined = docs.join(maps, docs["doc_id"] == maps["map_id"], "left").withColumn("found", digest("text", "keep"))
    return joined.select("doc_id", "found.*")


def _dropped(keep: bytes, n_lines: int) -> int:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines]
    return int((bits == 0).sum())
