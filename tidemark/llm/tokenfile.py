"""Token ids in Arrow files of equal-length sequences, and their reader."""

from __future__ import annotations

import json
import os
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, staged

# Byte-level BPE writes each byte as one letter: printable Latin-1 as itself, the others from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_BLANK = chr(_BYTE_LETTERS[32])
_MET = 1 << 22  # places to note a word met once, a byte each; a word that shares its place with another is kept early
_FILES = ("part int, file_no int, path string, index_path string, n_tokens long, n_documents long")


@dataclass(frozen=True)
class TokenFileParams:
    """Sequences of ``length`` ids; ``batch`` of them per record batch; a file ends after ``file_tokens`` ids.

    ``cached_words`` bounds the memory of the tokens of words that a worker process has met more than once.
    """

    tokenizer: str
    end_id: int = 2
    length: int = 2048
    batch: int = 64
    file_tokens: int = 1 << 24
    cached_words: int = 900_000


def _splits_at_blanks(tokenizer) -> bool:
    """Whether this is plain byte-level BPE, which takes words one by one and changes nothing of a text beforehand."""
    spec = json.loads(tokenizer.to_str())
    model, first = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return (model["type"] == "BPE" and plain and spec["normalizer"] is None and first.get("type") == "ByteLevel"
            and first.get("use_regex") is True and first.get("add_prefix_space") is False)


class CachedEncoder:
    """Byte-level BPE of whole texts, one word at a time.

    The tokenizer never merges across the blank or newline between two words, so the ids of a text are those of its
    words, each with what stands before it.  Texts with other or doubled white space, with white space at
    an end, with NUL or with a special token go to the tokenizer whole.  So do all texts where the tokenizer works otherwise.
    A word is kept from the second time it has to be learned: most words of a text come once, and would fill the memory.
    """

    def __init__(self, p: TokenFileParams):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(p.tokenizer)
        self.by_word = _splits_at_blanks(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self._ids("\n") if self.by_word else b""
        self.points = {c: self._ids(c) for c in ".,"} if self.by_word else {}
        self.known: dict[str, bytes] = {}
        self.met = bytearray(_MET)
        self.limit = p.cached_words

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, words: list[str]) -> list[bytes]:
        # a newline is a token of its own between two words, so it parts the ids of one from the next
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == np.frombuffer(self.newline, "<u4")[0]), len(ids)).tolist()
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *[x + 1 for x in ends[:-1]]], ends, strict=True)]

    def _spelt(self, words: list[str]) -> list[bytes]:
        """Ids of words with what stands before them; one of Latin letters alone goes straight to the merges."""
        out, model, others = [None] * len(words), self.tokenizer.model, []
        for k, w in enumerate(words):
            bare = w[1:] if w[0] == " " else w
            if bare.isalpha() and max(bare) < "\u0250":
                plain = _BLANK * (len(w) - len(bare)) + bare
                letters = plain if bare.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = [t.id for t in model.tokenize(letters)]
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(k)
        for k, ids in zip(others, self._encoded([words[k] for k in others]) if others else [], strict=True):
            out[k] = ids
        return out

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words; a stop or comma after a letter or digit is a token of its own."""
        ended = {w for w in words if w[-1] in ".," and len(w) > 1 and w[-2].isalnum()}
        plain = list({w[:-1] for w in ended}.difference(self.known) | (words - ended))
        # a word that starts a text or line has no blank before it
        spelt = [w[1:] if w[0] in "\n\0" else " " + w for w in plain]
        new = dict(zip(plain, self._spelt(spelt), strict=True)) if plain else {}
        for w in plain:
            if w[0] == "\n":
                new[w] = self.newline + new[w]
        for w in ended:
            new[w] = (new.get(w[:-1]) or self.known[w[:-1]]) + self.points[w[-1]]
        return new

    def _keep(self, new: dict[str, bytes]) -> None:
        for word, ids in new.items():
            place = hash(word) % _MET
            if self.met[place]:
                self.known[word] = ids
            else:
                self.met[place] = 1

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in found]
        out: list = [None] * len(texts)
        parted, missing = {}, set()
        for k, text in enumerate(texts):
            pieces = ("\0" + text).replace("\n", " \n").split(" ")
            words = text.split()
            # as many pieces as words, and no white space but blanks and newlines: each of them parts two words
            if (not words or text[0].isspace() or "\0" in text or len(words) != len(pieces)
                    or len("".join(words)) != len(text) - len(pieces) + 1 or any(s in text for s in self.special)):
                out[k] = self._ids(text)
                continue
            found = list(map(self.known.get, pieces))
            if holes := [i for i, ids in enumerate(found) if ids is None]:
                parted[k] = found, [(i, pieces[i]) for i in holes]
                missing.update([pieces[i] for i in holes])
            else:
                out[k] = b"".join(found)
        if missing:
            new = self._learned(missing)
            if len(self.known) < self.limit:
                self._keep(new)
            for k, (found, holes) in parted.items():
                for i, w in holes:
                    found[i] = new[w]
                out[k] = b"".join(found)
        return out


def _shared_encoder(p: TokenFileParams) -> CachedEncoder:
    """The encoder of this worker process, kept from task to task with the words it knows."""
    home = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    encoders = home.__dict__.setdefault("encoders", {})
    key = (p.tokenizer, p.cached_words)
    if key not in encoders:
        encoders[key] = CachedEncoder(p)
    return encoders[key]


def _encoded_rows(batches: Iterator[pd.DataFrame], encoder: CachedEncoder) -> Iterator[tuple]:
    """(doc_id, ids) of all rows in order, encoded together about a million characters at a time."""
    for batch in batches:
        held, n_held = [], 0
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            held.append((doc_id, text))
            n_held += len(text)
            if n_held >= 1 << 20:
                yield from zip([d for d, _ in held], encoder.many([t for _, t in held]), strict=True)
                held, n_held = [], 0
        yield from zip([d for d, _ in held], encoder.many([t for _, t in held]), strict=True)


class _FileWriter:
    """One Arrow file of sequences and one of document positions, both renamed when complete."""

    def __init__(self, folder: str, name: str, n_ids: int, p: TokenFileParams):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.paths = [f"{root}/{name}.arrow", f"{root}/{name}.index.arrow"]
        self.uris = [f"{folder}/{name}.arrow", f"{folder}/{name}.index.arrow"]
        self.suffix, self.p = f".{uuid.uuid4().hex}.tmp", p
        self.id_type = pa.uint16() if n_ids <= 1 << 16 else pa.uint32()
        self.schema = pa.schema({"ids": pa.list_(self.id_type, p.length), "mask": pa.list_(pa.bool_(), p.length)})
        self.index_schema = pa.schema({"doc_id": pa.int64(), "offset": pa.int64(), "n_tokens": pa.int64()})
        self.streams = [self.fs.open_output_stream(path + self.suffix) for path in self.paths]
        self.body = pa.ipc.new_file(self.streams[0], self.schema)
        self.index = pa.ipc.new_file(self.streams[1], self.index_schema)
        self.held: list[bytes] = []
        self.n_held = self.n_tokens = self.n_documents = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        self.rows.append((doc_id, self.n_tokens, n))
        self.held.append(ids)
        self.n_tokens += n
        self.n_documents += 1
        self.n_held += n
        if self.n_held >= self.p.length * self.p.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % self.p.length
        rest = ids[whole:]
        fill = -whole % self.p.length
        values = np.concatenate([ids[:whole], np.zeros(fill, "<u4")]).astype(self.id_type.to_pandas_dtype())
        mask = np.arange(len(values)) < whole
        step = self.p.length * self.p.batch
        for at in range(0, len(values), step):
            self.body.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(part), self.p.length)
                for part in (values[at:at + step], mask[at:at + step])], schema=self.schema))
        self.held, self.n_held = [rest.tobytes()], len(rest)
        if self.rows:
            self.index.write_batch(pa.record_batch(
                [pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=self.index_schema))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        for writer, stream, path in zip((self.body, self.index), self.streams, self.paths, strict=True):
            writer.close()
            stream.close()
            self.fs.move(path + self.suffix, path)


def write_token_files(docs: DataFrame, folder: str, p: TokenFileParams) -> DataFrame:
    """Encode every text (null: empty), end it with ``end_id`` and write files in ascending doc_id order.

    Ids are 16 bits wide where the vocabulary allows it, masks one bit.  Ids of a file run on from sequence to sequence; only the last is padded, with mask 0.  Documents
    are dealt by ranges of doc_id, so files in the order (part, file_no) hold all ids in order.  Null ids come
    first; equal ids are ordered by text.  A repeated or lost attempt writes files of its own name, and only
    those of the returned list (part, file_no, path, index_path, n_tokens, n_documents) count.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = _shared_encoder(p), np.array([p.end_id], "<u4").tobytes()
        context = TaskContext.get()
        part, file_no, writer = context.partitionId(), 0, None

        def done(w: _FileWriter) -> pd.DataFrame:
            w.close()
            return pd.DataFrame([(part, file_no, *w.uris, w.n_tokens, w.n_documents)],
                                columns=["part", "file_no", "path", "index_path", "n_tokens", "n_documents"])

        for doc_id, ids in _encoded_rows(batches, encoder):
            if writer is None:
                name = f"part-{part:06d}-{file_no:05d}-{context.taskAttemptId()}"
                writer = _FileWriter(folder, name, max(encoder.tokenizer.get_vocab_size(), p.end_id + 1), p)
            writer.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
            if writer.n_tokens >= p.file_tokens:
                yield done(writer)
                file_no, writer = file_no + 1, None
        if writer is not None:
            yield done(writer)

    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1], recursive=True)
    # the start of the text only decides where rows of one id or without id part
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInPandas(run, _FILES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the listed files.

    Files are memory-mapped where the store allows it and read batch by batch.  ``start`` adds the ids of all files
    before: totals per part first, then within the part, so no task orders all files.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("words"))
    parts = parts.select("part", (F.sum("words").over(Window.orderBy("part")) - F.col("words")).alias("part_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file_no")) - F.col("n_tokens")
    placed = (files.withColumn("within", within).join(parts, "part")
              .select("path", "index_path", (F.col("part_start") + F.col("within")).alias("file_start")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, index_path, file_start in batch.itertuples(index=False):
                yield from _documents(path, index_path, int(file_start))

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (placed.repartition(n, "path").select("path", "index_path", "file_start")
            .mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _open(uri: str) -> pa.ipc.RecordBatchFileReader:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    local = isinstance(fs, pa.fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))


def _documents(path: str, index_path: str, file_start: int) -> Iterator[pd.DataFrame]:
    body, index = _open(path), _open(index_path)
    length = body.schema.field("ids").type.list_size
    held, held_from, next_batch = np.empty(0, "<u4"), 0, 0
    for k in range(index.num_record_batches):
        rows = []
        for row in index.get_batch(k).to_pylist():
            offset, n = row["offset"], row["n_tokens"]
            crc, at = 0, offset
            while at < offset + n:
                if at >= held_from + len(held):
                    held_from += len(held)
                    batch = body.get_batch(next_batch)
                    held = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
                    held = held[:batch.column("mask").flatten().true_count].astype("<u4")
                    next_batch += 1
                part = held[at - held_from:offset + n - held_from]
                crc, at = zlib.crc32(part, crc), at + len(part)
            rows.append((row["doc_id"], file_start + offset, n, crc))
        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
    assert length == body.schema.field("mask").type.list_size


def sequence(uri: str, number: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a file, without reading or copying the others.  The mask is unpacked."""
    ids, bits = packed_sequence(uri, number, batch)
    return ids, np.unpackbits(bits, bitorder="little")[:len(ids)].astype(bool)


def packed_sequence(uri: str, number: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one sequence and its mask, eight bits a byte, lowest first; both are views of the file's memory.

    The length of sequences must be a multiple of eight.
    """
    part = _open(uri).get_batch(number // batch)
    length = part.schema.field("ids").type.list_size
    if length % 8:
        raise ValueError(f"masks of {length} bits don't start at whole bytes")
    at = number % batch * length
    ids, mask = (part.column(c).flatten() for c in ("ids", "mask"))
    first = (mask.offset + at) // 8
    bits = np.frombuffer(mask.buffers()[1], np.uint8)[first:first + length // 8]
    return ids[at:at + length].to_numpy(zero_copy_only=True), bits


def token_output(spark: SparkSession, docs: DataFrame, p: TokenFileParams) -> DataFrame:
    """Write ``docs`` to a fresh shared folder and return the digests read back from its files."""
    return read_token_files(write_token_files(docs, fresh_path(spark, "tokens"), p))
