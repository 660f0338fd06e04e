"""Words and word n-grams of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

#: Characters that are split at once, and entries of a worker's memo of word hashes; both only save time and memory.
BLOCK_CHARS, MEMO = 500_000, 100_000


class WordHashes(dict):
    """The xxh3 hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


MEMORY = WordHashes()


def word_blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(position of the first text, hashes of all words, number of words of each text, the words in UTF-8) for runs of texts."""
    at = 0
    while at < len(texts):
        words: list[bytes] = []
        sizes: list[int] = []
        chars = 0
        while at + len(sizes) < len(texts) and (chars < BLOCK_CHARS or not sizes):
            text = texts[at + len(sizes)]
            own = text.encode().split()  # bytes are split at the white space of the contracts, and at no other
            words += own
            sizes.append(len(own))
            chars += len(text)
        yield at, np.fromiter(map(MEMORY.__getitem__, words), np.uint64, len(words)), np.array(sizes, np.int64), words
        at += len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: For each byte, whether it is white space of the contracts, and a fixed random number.
SPACE = np.isin(np.arange(256), list(b"\x20\t\n\x0b\f\r"))
NUMBERS = mix(np.arange(1, 257, dtype=np.uint64))
#: The base of the polynomial hash and its inverse modulo 2^64, and the bytes that are hashed at once.
BASE, INVERSE, AT_ONCE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64), 1 << 20


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def bounded_words(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(position of the first text, hashes of all words, number of words of each text, UTF-8, where each word begins and ends in
    it) for runs of texts. Equal words have equal hashes, which are polynomials over bytes and not those of `word_blocks`.
    """
    at = 0
    while at < len(texts):
        own: list[bytes] = []
        chars = 0
        while at + len(own) < len(texts) and (chars < BLOCK_CHARS or not own):
            own.append(texts[at + len(own)].encode())
            chars += len(own[-1])
        raw = b"\n".join(own)
        data = np.frombuffer(raw, np.uint8)
        space = np.concatenate([[True], SPACE[data], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        begin, end = edges[::2], edges[1::2]
        limits = np.cumsum([len(x) + 1 for x in own])
        sizes = np.diff(np.searchsorted(begin, limits), prepend=0)
        flat = np.empty(len(begin), np.uint64)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + AT_ONCE, "right")))
            low, high = begin[i:j] - begin[i], end[i:j] - begin[i]
            n = max(AT_ONCE, int(high[-1]))
            sums = np.zeros(int(high[-1]) + 1, np.uint64)
            np.cumsum(NUMBERS[data[begin[i] : end[j - 1]]] * powers(BASE, n)[: high[-1]], out=sums[1:])
            flat[i:j] = (sums[high] - sums[low]) * powers(INVERSE, n)[low]
            i = j
        yield at, mix(flat), sizes, raw, begin, end
        at += len(own)


def rolling(flat: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that start at each position; those that run past the end are left out."""
    m = max(0, len(flat) - n + 1)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = (h ^ flat[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)


def shingles(texts: list[str], n: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its different n-grams, sorted, and how often each occurs. A shorter text is one n-gram as a whole."""
    for _, flat, sizes, _ in word_blocks(texts):
        grams = rolling(flat, n)
        start = 0
        for size in sizes.tolist():
            own = grams[start : start + size - n + 1] if size >= n else rolling(flat[start : start + size], size) if size else grams[:0]
            yield np.unique(own, return_counts=True)
            start += size
