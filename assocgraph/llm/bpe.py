"""Byte-level BPE encoding and decoding.

A piece of text becomes a doubly linked list of symbols; a priority queue holds the merges that its neighbours allow,
lowest rank first and leftmost among equal ranks. A merge that has been overtaken (one of its symbols changed or went)
is skipped when it comes out of the queue. Decoding concatenates the vocabulary's byte strings.

Defined results: a null or empty text has no ids and decodes to the empty text; rows that repeat are encoded each;
columns other than id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_arrow, pieces

#: Entries of the memo of encoded pieces, per generation and Python worker. It only saves time.
MEMO = 150_000
#: How byte-level vocabularies cut a text into pieces before merging (a published, fixed pattern).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """The vocabulary of one tokenizer file, with a memo of pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = added
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pieces = regex.compile(PIECES).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a list of symbols, best rank first."""
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(*hit, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (hit := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, merged, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if hit := merges.get((merged, symbols[k])):
                    heapq.heappush(queue, (*hit, i, merged, symbols[k]))
            if (h := before[i]) >= 0 and (hit := merges.get((symbols[h], merged))):
                heapq.heappush(queue, (*hit, h, symbols[h], merged))
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece as little-endian 32-bit integers, from the memo or by merging."""
        got = self.old.get(piece)
        if got is None:
            ids = self.byte_ids
            got = np.array(self.merge([ids[b] for b in piece.encode()]), dtype="<u4").tobytes()
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        if len(piece) <= 64:
            self.new[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(np.uint32(self.added[part]).astype("<u4").tobytes() if part in self.added else self._plain(part) for part in self.cut.split(text) if part)

    def _plain(self, text: str) -> bytes:
        known, slow = self.new.get, self.piece
        return b"".join([known(p) or slow(p) for p in self.pieces(text)])

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    """The public byte-level vocabulary of 50,257 tokens, from the tokenizer files installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids: the token ids of the whole text, packed as little-endian unsigned 32-bit integers.

    path: the tokenizer file, at the same place on every executor.
    """

    def run(batches):
        own = codec(path)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    plain = id_and_text(docs, id_col, text_col)
    return in_arrow(plain, run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """What encode() gave, with the decoded text beside the ids."""

    def run(batches):
        own = codec(path)
        for batch in pieces(batches):
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([own.decode(i or b"") for i in ids.to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    slim = encoded.select("doc_id", "ids")
    return in_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded text."""
    return decoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
