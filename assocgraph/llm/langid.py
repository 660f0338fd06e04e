"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed n-grams of one to three characters (of its UTF-8 bytes, lower case,
with one space for whatever is not a letter). The
labelled texts of each language are clustered by spherical k-means; a text gets the language of the centroid with the
largest cosine. Each centroid has a radius, the distance of its farthest labelled text but for a small share; a text
outside the radius of its nearest centroid is marked as rejected.

The fit reads a bounded sample of labelled rows, the smallest hashes of the id of each language, which have equal shares of
`FIT_ROWS`; every text is scored whole.

Defined results: a null text, or one without any letter (Unicode's letters: no digits, fractions or roman number signs), is
`und` with score 0; ties go to the language that comes first in
alphabetic order; texts that repeat score the same; an empty table gives an empty table; other columns are ignored; without
any labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, in_arrow, pieces

#: Labelled documents that the fit reads at most.
FIT_ROWS = 3000
BINS = 1 << 13
CENTROIDS, ROUNDS = 4, 8
#: Share of a centroid's own labelled texts that may lie outside its radius.
OUTSIDE = 0.002
#: Documents and bytes that are counted at once.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 22
#: Every ASCII byte but a letter becomes a space; runs of those count as one.
LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
LETTER = regex.compile(r"\p{L}")


def blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of the hashed n-grams, for runs of texts: (position of the first, texts x BINS)."""
    at = 0
    while at < len(texts):
        raw, total = [], 0
        while at + len(raw) < len(texts) and len(raw) < BLOCK_ROWS and (total < BLOCK_BYTES or not raw):
            raw.append(b" %b " % b" ".join(texts[at + len(raw)].lower().encode().translate(LETTERS).split()))
            total += len(raw[-1])
        yield at, counts(raw)
        at += len(raw)


def counts(raw: list[bytes]) -> np.ndarray:
    out = np.zeros(len(raw) * BINS, np.float32)
    start = 0
    while start < len(raw):  # whole texts, a very long one in pieces that overlap by two bytes
        end, total = start, 0
        while end < len(raw) and (end == start or total + len(raw[end]) <= BLOCK_BYTES):
            total += len(raw[end])
            end += 1
        if end - start == 1 and len(raw[start]) > BLOCK_BYTES:
            b = np.frombuffer(raw[start], np.uint8)
            for i in range(0, len(b), BLOCK_BYTES):
                add(out, b[max(0, i - 2) : i + BLOCK_BYTES], np.full(min(len(b), i + BLOCK_BYTES) - max(0, i - 2), start * BINS), min(i, 2))
        else:
            b = np.frombuffer(b"".join(raw[start:end]), np.uint8)
            add(out, b, np.repeat(np.arange(start, end) * BINS, [len(x) for x in raw[start:end]]), 0)
        start = end
    return out.reshape(len(raw), BINS)


def add(out: np.ndarray, b: np.ndarray, base: np.ndarray, skip: int) -> None:
    """Add the n-grams that end after the first `skip` bytes and lie within one text."""
    wide = b.astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        code = wide if n == 1 else code[:-1] * np.uint32(257) + wide[n - 1 :]
        mixed = ((code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(19)).astype(np.int64)
        inside = base[: len(code)] == base[n - 1 :]
        if skip > n - 1:
            inside[: skip - n + 1] = False
        out += np.bincount((mixed + base[n - 1 :])[inside], minlength=len(out))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: tuple[str, ...]  # of each centroid
    radii: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        named, scores, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return named, scores, out
        for at, n in blocks(texts):
            near = unit(np.log1p(n, out=n) * self.idf) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, k in enumerate(best.tolist()):
                if LETTER.search(texts[at + i]):
                    named[at + i] = self.languages[k]
                    scores[at + i] = min(1.0, max(0.0, float(near[i, k])))
                    out[at + i] = 1 - scores[at + i] > self.radii[k]
        return named, scores, out


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means. It starts from texts at even steps of closeness to the mean, so equal input gives equal output."""
    k = min(k, len(x))
    order = np.argsort(x @ unit(x.mean(axis=0)), kind="stable")
    centres = x[order[[int((i + 0.5) * len(x) / k) for i in range(k)]]]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([unit(x[own == i].mean(axis=0)) if (own == i).any() else centres[i] for i in range(k)])
    return centres


def fit_local(rows: list[tuple[str, str]]) -> Model:
    rows = sorted((t, y) for t, y in set(rows) if LETTER.search(t))  # the same order however rows arrive
    if not rows:
        return Model(np.zeros(BINS), np.zeros((0, BINS)), (), np.zeros(0))
    vectors = np.empty((len(rows), BINS), np.float32)
    for at, n in blocks([t for t, _ in rows]):
        np.log1p(n, out=vectors[at : at + len(n)])
    idf = (np.log((1 + len(rows)) / (1 + (vectors > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors *= idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    names = np.array([y for _, y in rows])
    parts, owners = [], []
    for language in sorted(set(names.tolist())):
        got = cluster(vectors[names == language], CENTROIDS)
        parts.append(got)
        owners += [language] * len(got)
    centroids = np.concatenate(parts)
    near = vectors @ centroids.T
    nearest = near.argmax(axis=1)
    distance = 1 - near.max(axis=1)
    radii = np.array([np.quantile(distance[nearest == k], 1 - OUTSIDE) if (nearest == k).any() else 0.0 for k in range(len(centroids))])
    return Model(idf, centroids, tuple(owners), radii)


def labelled(docs: DataFrame, folds: int = 3, held: int = 1, rows: int = FIT_ROWS) -> DataFrame:
    """At most `rows` texts with a language outside the held-out fold: of each language those with the smallest hash of the id."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", folds) != held)).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages = own.select("lang").distinct().count()
    # ids are chosen first, so that only the texts of the sample move; each task hands on no more than a language's share
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = own.select("doc_id", "lang").withColumn("at", F.row_number().over(place)).filter(F.col("at") <= max(1, rows // max(1, languages)))
    chosen = F.broadcast(ranked.select("doc_id", "lang").distinct().limit(rows))  # a bounded size
    return own.join(chosen, ["doc_id", "lang"]).select("text", "lang").limit(rows)


def fit(docs: DataFrame, folds: int = 3, held: int = 1, rows: int = FIT_ROWS) -> Model:
    return fit_local([(r.text, r.lang) for r in labelled(docs, folds, held, rows).collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine) and rejected of each whole text."""

    def run(batches):
        for batch in pieces(batches):
            named, scores, out = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    own = id_and_text(docs, id_col, text_col)
    return in_arrow(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: fitted outside the held-out fold, predicted everywhere."""
    return identify(docs, fit(docs)).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
