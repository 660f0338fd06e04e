"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, each on its own class alone: one on ordinary documents, one on toxic
ones. A text is cut into overlapping windows of a few words. Each window is compressed twice, with the ordinary dictionary,
and with the toxic one put before it; as toxic texts are ordinary prose but for some passages, the bytes that the toxic
dictionary saves beyond the ordinary one (the window's margin) tell the two kinds apart. A document's distance is the mean
margin of its windows, and it is toxic from a threshold on, which labelled documents that the dictionaries did not see
calibrate: the one at which the shares of toxic documents caught and of ordinary ones left alone add up to the most. The
score is a logistic curve of the distance, 0.5 at the threshold.

Training picks a dictionary's content by coverage: words and beginnings of words that occur in a share of the class's
documents, in as many different neighbourhoods, so that copies of a passage count once. What covers most stands last, where
matches are cheapest. The ordinary share is much smaller than the toxic one: whatever is common enough to get into the toxic
dictionary without being toxic is in the ordinary one too, and has no margin. Common words of the toxic class that ordinary
texts have as well stay in its dictionary; it is compression that discounts them.

The fit reads a bounded sample of labelled rows (`FIT_ROWS`, the smallest hashes of the id); every text is scored whole.

Defined results: a null or empty text has one empty window and the score of a text without any margin; a text without
white space is cut into words of `LONG_WORD` characters; rows that repeat are scored each; equal texts score the same;
an empty table gives an empty table; other columns are ignored; without labelled rows of both kinds every score is the
share of toxic ones (0 if there are none). Labels that contradict each other count as toxic. `keep_clean` hands on all
columns of its rows as they are, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, in_arrow, pieces

#: Labelled documents that the fit reads at most.
FIT_ROWS = 8000
WINDOW_WORDS, STRIDE = 9, 6
LONG_WORD = 64
DICTIONARY_BYTES = 256 * 1024
#: Share of the documents of its class, and number of them, that a segment of a dictionary is in at least.
ORDINARY_SHARE, TOXIC_SHARE = (0.001, 3), (0.025, 5)
#: At lower levels the compressor misses long matches in a large dictionary; shorter matches cost time and tell little.
LEVEL, MIN_MATCH = 12, 5
BLOCK = 4096
PUNCTUATION = ".,;:!?\"'()[]"
#: Lengths of the beginnings of words that can be segments.
STEMS = (4, 5, 6, 7, 8)


def words_of(text: str) -> list[str]:
    found = []
    for w in text.lower().split():
        found += [w] if len(w) <= LONG_WORD else [w[i : i + LONG_WORD] for i in range(0, len(w), LONG_WORD)]
    return found


def windows_of(text: str) -> list[bytes]:
    """The whole text as overlapping runs of words, each with a space at both ends."""
    words = words_of(text)
    starts = range(0, max(1, len(words) - WINDOW_WORDS + STRIDE), STRIDE)
    return [f" {' '.join(words[i : i + WINDOW_WORDS])} ".encode(errors="replace") for i in starts]


def segments_of(word: str) -> list[str]:
    """A word and its beginnings, with the space before them."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)]


def train(texts: list[str], share: float, least: int) -> bytes:
    """The content of a dictionary of one class: the segments that cover most of its texts."""
    seen: set[int] = set()
    words: Counter = Counter()
    for t in texts:
        bare = ["", *(w.strip(PUNCTUATION) for w in words_of(t)), ""]
        own: dict[str, tuple] = {}
        for before, w, after in zip(bare, bare[1:], bare[2:]):
            if len(w) > 2:
                own.setdefault(w, (before, w, after))
        for w, around in own.items():
            h = xxhash.xxh3_64_intdigest(" ".join(around).encode(errors="replace"))
            if h not in seen:
                seen.add(h)
                words[w] += 1
    found: Counter = Counter()
    for w, n in words.items():
        for s in segments_of(w):
            found[s] += n
    need = max(least, share * len(texts))
    picked: list[str] = []
    covered: set[str] = set()
    room = DICTIONARY_BYTES
    for _, s in sorted(((-n * len(s), s) for s, n in found.items() if n >= need)):
        if s not in covered:
            room -= len(s.encode(errors="replace"))
            if room < 0:
                break
            picked.append(s)
            covered.update([s, *(s[: n + 1] for n in STEMS if n < len(s))])
    return "".join(reversed(picked)).encode(errors="replace")


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the threshold of the mean margin, and how far beyond it the odds of a toxic label grow by e."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    spread: float

    def compressors(self):
        make = lambda content: zs.ZstdCompressor(
            compression_params=zs.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False),
            dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT),
        )
        return make(self.ordinary), make(self.toxic + self.ordinary)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((margins - self.threshold) / self.spread, -50, 50)))


def sizes(compressor, windows: list[bytes]) -> np.ndarray:
    out = np.empty(len(windows), np.int32)
    for i in range(0, len(windows), BLOCK):
        packed = compressor.multi_compress_to_buffer(windows[i : i + BLOCK], threads=1)
        out[i : i + len(packed)] = [len(packed[j]) for j in range(len(packed))]
    return out


def margins(model: Model, pair, texts: list[str]) -> np.ndarray:
    """The mean margin of each text's windows, in bytes."""
    total, number = np.zeros(len(texts)), np.ones(len(texts))
    if not model.toxic:
        return total
    windows: list[bytes] = []
    owners: list[int] = []

    def flush():
        gain = sizes(pair[0], windows) - sizes(pair[1], windows)
        np.add.at(total, owners, gain)
        windows.clear()
        owners.clear()

    for k, text in enumerate(texts):
        own = windows_of(text)
        number[k] = len(own)
        for i in range(0, len(own), 4 * BLOCK):
            windows += own[i : i + 4 * BLOCK]
            owners += [k] * (len(windows) - len(owners))
            if len(windows) >= 4 * BLOCK:
                flush()
    if windows:
        flush()
    return total / number


def calibrate(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The threshold at which the shares of toxic ones at or above it and of others below add up to the most, and the
    standard deviation inside the two kinds, as the unit of distances from it."""
    order = np.argsort(-x, kind="stable")
    caught, lost = np.cumsum(toxic[order]), np.cumsum(~toxic[order])
    last = np.append(x[order][1:] != x[order][:-1], True)  # equal margins are on one side
    gain = np.where(last, caught / toxic.sum() - lost / (~toxic).sum(), -2.0)
    at = int(gain.argmax())
    above = x[order][at]
    below = x[order][at + 1] if at + 1 < len(x) else above - 1.0
    return float((above + below) / 2), float(np.sqrt((x[toxic].var() + x[~toxic].var()) / 2) + 1e-6)


def fit_local(rows: list[tuple[str, int]]) -> Model:
    """Two of three rows train the dictionaries; the third, which they did not see, calibrates."""
    rows = sorted(set(rows), key=lambda r: (xxhash.xxh3_64_intdigest(r[0].encode(errors="replace")), r))  # the same order however rows arrive
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    constant = Model(b"", b"", -float(np.log((share + 1e-9) / (1 - share + 1e-9))), 1.0)  # the share itself as score
    own, other = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    kinds = [[t for t, y in own if not y], [t for t, y in own if y]]
    seen = np.array([bool(y) for _, y in other], bool)
    if not all(kinds) or not seen.any() or seen.all():
        return constant
    plain, toxic = (train(texts, *need) for texts, need in zip(kinds, (ORDINARY_SHARE, TOXIC_SHARE)))
    if not plain or not toxic:
        return constant
    half = Model(plain, toxic, 0.0, 1.0)
    pair = half.compressors()
    found = [margins(half, pair, [t for t, _ in other[i : i + 512]]) for i in range(0, len(other), 512)]
    return Model(plain, toxic, *calibrate(np.concatenate(found), seen))


def labelled(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` labelled texts outside the held-out fold: those with the smallest hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # ids are chosen first, so that only the texts of the sample move; `rows` ids are small enough to broadcast
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id").select("text", "toxic").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = FIT_ROWS) -> Model:
    return fit_local([(r.text, int(r.toxic > 0)) for r in labelled(docs, labels, folds, held, rows).collect()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and margin (the mean of the windows, in bytes) of each whole text."""

    def run(batches):
        pair = model.compressors() if model.toxic else None
        for batch in pieces(batches):
            got = margins(model, pair, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(got), pa.float64()), pa.array(got, pa.float64())], ["doc_id", "score", "margin"])

    own = id_and_text(docs, id_col, text_col)
    return in_arrow(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double, margin double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, margin: fitted outside the held-out fold, scored everywhere."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "margin")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5."""

    at = docs.columns.index("text")

    def run(batches):
        pair = model.compressors() if model.toxic else None
        for batch in pieces(batches):
            got = margins(model, pair, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.scores(got) < 0.5))

    return in_arrow(docs, run, docs.schema)
