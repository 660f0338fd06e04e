"""Best-fit packing of token sequences by exact complements.

1. Every text becomes the ids of a public tokenizer and a closing id 0, cut into pieces of `SIZE` ids; only the last piece of a document may be
   shorter. White space separates what the tokenizer splits anyway, so it sees each run of other bytes once and a memo of
   bounded size gives the rest. A piece's place, length and crc32 are written once; ids do not travel.
2. The plan is made from the histogram of lengths, `SIZE` numbers however many documents there are. The longest pieces open
   sequences, as many at once as there are of them, and look for what fills the gap exactly: a single length, else a pair,
   else a triple, taken from an index of the sums that the lengths left can give. A combination is used as often as the
   availability counts allow, so each use ends a length. What finds no exact complement takes the longest piece that fits
   (best fit), and looks for an exact complement of what is left of the gap again.
3. Equal lengths are interchangeable: a piece's rank among those of its length is its place in the plan. Ranks are counted
   in cells of about `CELL_ROWS` rows, dealt by a hash, and shifted by the cells before, so the most frequent length is not one task.

Defined results: a null or empty text is the closing id alone; rows that repeat are packed each; an empty table gives an
empty table; other columns are ignored; of equal lengths a hash of id, piece and ids decides which piece goes where.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, id_and_text, in_arrow

SIZE, CLOSING = 2048, 0
CELL_ROWS = 20_000
#: Entries of each of the two generations of the memo, and marks that may follow a word.
MEMO, MARKS = 400_000, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


class Encoder:
    """The ids of texts, four bytes each, by the tokenizers library for each run of bytes without white space.

    The tokenizer lowers case anyway, so texts are lowered first, unless they may hold a special token. A run that is not in
    the memo is cut into letters and the marks after them, which the tokenizer cuts, too. Runs of letters go to the
    library together: each is one word, and its last id is one that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        own = self.tokenizer = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        words = own.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(own.get_vocab().values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ask(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """The ids of some runs, from the library."""
        words, found = [], {}
        others = []
        for r in runs:
            (words if r.decode().isalpha() else others).append(r)
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words):
                ids = ids.tobytes()
                found = dict(zip(words, map(ids.__getitem__, map(slice, np.concatenate([[0], 4 * cuts[:-1]]).tolist(), (4 * cuts).tolist()))))
            else:  # letters that are several words in lower case
                others += words
        for r, e in zip(others, self.tokenizer.encode_batch_fast([r.decode() for r in others], add_special_tokens=False)):
            found[r] = np.array(e.ids, "<u4").tobytes()
        return found

    def _known(self, runs: list[bytes]) -> list[bytes]:
        """The ids of different runs, from the memo or the library."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, runs))
        missing = [i for i, v in enumerate(out) if v is None]
        found = {r: v for i in missing if (v := old.get(r := runs[i])) is not None}
        found |= self._ask([r for i in missing if (r := runs[i]) not in found])
        new.update(found)
        for i in missing:
            out[i] = found[runs[i]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and the last one's end."""
        special = pc.match_substring(texts, "<|")
        runs = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = runs.flatten().dictionary_encode()
        cores, marks = split_marks(coded.dictionary)
        parts = pa.concat_arrays([cores, marks]).dictionary_encode()
        values = self._known(parts.dictionary.cast(pa.binary()).to_pylist())
        raw, sizes = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4
        half = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T
        # the ids of each different run, then those of all runs
        raw, ends = gathered(raw, np.cumsum(sizes) - sizes, sizes, half.ravel())
        first = ends[::2]
        raw, ends = gathered(raw, first[:-1], np.diff(first), coded.indices.to_numpy(zero_copy_only=False))
        return raw, ends[np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))])]


def gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches `which` of values, one after the other, and where each begins and the last ends."""
    n = sizes[which]
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    at = np.repeat(first[which] - ends[:-1], n)
    at += np.arange(len(at))
    return values[at], ends


def bounds(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and where each string begins and the last one ends."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def split_marks(runs: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Each run up to the marks at its end, and those marks (none where they do not follow a letter or digit in ASCII, or may
    be part of a special token)."""
    data, at = bounds(runs)
    bare, to = bounds(pc.ascii_rtrim(runs, MARKS))
    n = np.diff(to)
    after = np.zeros(len(runs), bool)
    after[n > 0] = ALNUM[bare[to[1:][n > 0] - 1]]
    after &= ~pc.match_substring(runs, "<|").to_numpy(zero_copy_only=False)
    middle = np.where(after, at[:-1] + n, at[1:])
    out = []
    for lo, hi in ((at[:-1], middle), (middle, at[1:])):
        letters, ends = gathered(data, lo, hi - lo, np.arange(len(lo)))
        out.append(pa.StringArray.from_buffers(len(lo), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)))
    return out[0], out[1]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def default_vocabulary() -> str:
    """The public word vocabulary of 49,408 tokens, from the tokenizer files installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""
    own = id_and_text(docs, id_col, text_col)
    names, end = ["doc_id", "piece", "start", "length", "ids_crc32"], np.array([CLOSING], "<u4").tobytes()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            ids, ends = coder.encode(batch.column(1))
            raw, ends = memoryview(ids.tobytes()), (4 * ends).tolist()
            for i in range(batch.num_rows):
                n = (ends[i + 1] - ends[i]) // 4 + 1
                for p, at in enumerate(range(0, n, size)):
                    last = min(at + size, n) == n
                    part = raw[ends[i] + 4 * at : ends[i + 1] if last else ends[i] + 4 * (at + size)]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(min(size, n - at))
                    crc.append(zlib.crc32(end, zlib.crc32(part)) if last else zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))], names)

    return in_arrow(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Stock:
    """How many pieces of each length are left, and which sums one, two or three of them give."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.size = counts, len(counts) - 1
        self.have = counts > 0
        self.have[0] = False
        #: pairs[s]: how many a <= b with a + b = s are there, of lengths that are left
        self.pairs = np.zeros(self.size + 1, np.int64)
        for a in np.flatnonzero(self.have):
            b = np.flatnonzero(self.have[a : self.size + 1 - a]) + a
            self.pairs[a + b] += 1

    def end(self, a: int) -> None:
        """No piece of length a is left."""
        b = np.flatnonzero(self.have[: self.size + 1 - a])
        self.pairs[a + b] -= 1
        self.have[a] = False

    def take(self, lengths: list[int], times: int) -> None:
        for x in lengths:
            self.counts[x] -= times
        for x in set(lengths):
            if not self.counts[x] and self.have[x]:
                self.end(x)

    def times(self, lengths: list[int]) -> int:
        """How often these lengths can be taken together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)

    def exact(self, held: list[int], gap: int) -> list[int]:
        """One, two or three lengths that fill the gap beside those held, the longest first; none if there are none."""
        if self.have[gap] and self.times([*held, gap]):
            return [gap]
        if self.pairs[gap]:
            for a in range(gap - 1, (gap - 1) // 2, -1):
                if self.have[a] and self.have[gap - a] and self.times([*held, a, gap - a]):
                    return [a, gap - a]
        a = np.arange(gap - 2, (gap - 1) // 3, -1)
        for a in a[self.have[a] & (self.pairs[gap - a] > 0)].tolist():
            rest = gap - a
            b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
            for b in b[self.have[b] & self.have[rest - b]].tolist():
                if self.times([*held, a, b, rest - b]):
                    return [a, b, rest - b]
        return []

    def longest(self, held: list[int], gap: int) -> int:
        """The longest length that fits into the gap beside those held, 0 if none."""
        for x in np.flatnonzero(self.have[: gap + 1])[::-1].tolist():
            if self.times([*held, x]):
                return x
        return 0


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces, sequences that look so) for pieces of which counts[n] have n ids."""
    stock, out = Stock(counts.copy()), []

    def use(lengths: list[int]) -> None:
        n = stock.times(lengths)
        stock.take(lengths, n)
        out.append((tuple(lengths), n))

    size = stock.size
    if stock.have[size]:
        use([size])
    for top in range(size - 1, 0, -1):  # exact complements of single pieces, the longest first
        while stock.have[top] and (more := stock.exact([top], size - top)):
            use([top, *more])
    for top in range(size - 1, 0, -1):  # then best fit until a complement is exact or nothing fits
        while stock.have[top]:
            held, gap = [top], size - top
            while gap:
                if more := stock.exact(held, gap):
                    held += more
                    break
                if not (x := stock.longest(held, gap)):
                    break
                held.append(x)
                gap -= x
            use(held)
    return out


def places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key (length and first rank), first sequence and offset of each slot of the plan, by key."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in plan:
        at = 0
        for x in lengths:
            rows.append((x << RANK_BITS | used.get(x, 0), base, at))
            used[x] = used.get(x, 0) + n
            at += x
        base += n
    key, first, offset = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return key, first, offset


#: A key is a length (12 bits) and a rank.
RANK_BITS = 50


def pack(docs: DataFrame, path: str, tables: Tables, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    own = tables.write("pieces", cut(docs, path, size, id_col, text_col))
    found = own.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length, `size` at most
    counts = np.zeros(size + 1, np.int64)
    for r in found:
        counts[r.length] = r.n
    key, first, offset = places(plan(counts))
    cells = spark.createDataFrame([(r.length, -(-r.n // CELL_ROWS)) for r in found], "length long, cells long")
    dealt = own.join(F.broadcast(cells), "length").withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("cell", F.pmod("h", "cells"))
    per_cell = dealt.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = per_cell.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "cell").orderBy("h", "doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rn", F.row_number().over(inside)).join(before, ["length", "cell"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    slim = ranked.select(*columns, (F.col("before") + F.col("rn") - 1).alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            slot = np.searchsorted(key, (length << RANK_BITS) + rank, side="right") - 1
            sequence = first[slot] + rank - (key[slot] & ((1 << RANK_BITS) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset[slot])], [*columns, "sequence_id", "offset"])

    return in_arrow(slim, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
