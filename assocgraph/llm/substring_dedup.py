"""Substring deduplication with a compressed FM-index per shard.

A window is `WINDOW` consecutive words of one document; it is removed where its words also start in a document with a
smaller doc_id. All text of a window is covered by the removal, and windows are judged on the input.

1. Shards. A window's anchor is its word 5-gram of least hash; neighbouring windows mostly share theirs, and together they
   are a segment. Equal windows have equal anchors, so all occurrences of a window are in the shard of its anchor. Anchors
   that occur in one document only cannot repeat across documents and go no further. Documents of one task that share an
   anchor are known to repeat it, so a very common anchor sends one row per task.
2. Segments are dealt by anchor. An anchor of more than `HOT` documents is cut into single windows, which are dealt by their
   own hash; equal windows still meet. Before that, equal windows among some rows of a task are one: all but those of the
   smallest doc_id are decided there, as a document with a smaller doc_id holds the same words. So no anchor and no passage,
   however common, is one task, and a common window is exchanged once for each such group, however many documents hold it.
3. Each shard (anchors up to `SHARD_WORDS` words) builds an FM-index over its different segments, streams their words
   through it by backward search, and reports the intervals whose matching statistic reaches the window's length. The
   least doc_id in an interval of the suffix array is that of the window's first document.
4. Reports go back to their rows, which drop the covered words. The texts are dealt by doc_id (rows without one by a hash of
   the text, so that they do not meet) once, for the segments and for this.

Defined results: a null or empty text has no words; a text of fewer than `WINDOW` words keeps them all; a null doc_id counts
as larger than any other; rows of equal doc_id are one document when windows are compared, so they remove nothing from each
other; rows that repeat are answered each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_arrow, pieces, written
from .fm_index import END, FIRST, SEPARATOR, FMIndex
from .shingles import bounded_words, mix, rolling

WINDOW, ANCHOR = 13, 5
SHARD_WORDS, HOT = 400_000, 5_000
LAST = 2**63 - 1
#: Rows whose texts a worker holds at once, and anchors that it combines.
SLICE, COMBINED = 512, 1_000_000
#: Occurrences of common windows that a worker holds at once, and rows of a batch that it makes of them.
GROUPED, BATCH_ROWS = 200_000, 2000


def anchored(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]]:
    """For runs of texts: (position of the first, text of each segment, anchor hash, first window, windows, the words of the
    segments at some places, joined by one space). Window positions count from the start of the text.
    """
    span = WINDOW - ANCHOR + 1
    for at, flat, sizes, raw, begin, end in bounded_words(texts):
        starts = np.concatenate([[0], np.cumsum(sizes)])
        grams = rolling(flat, ANCHOR)
        n = len(flat) - WINDOW + 1
        if n <= 0:
            continue
        place = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        whole = owner[:n] == owner[WINDOW - 1 :]
        # a segment starts where the anchor or the text changes
        fresh = whole & np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:n] != owner[: n - 1]) | ~whole[:-1]])
        first = np.flatnonzero(fresh)
        count = np.add.reduceat(whole.astype(np.int64), first) if len(first) else first

        def words(some, raw=raw, low=begin[first], high=end[first + count + WINDOW - 2]):
            return [b" ".join(raw[x:y].split()) for x, y in zip(low[some].tolist(), high[some].tolist())]

        yield at, owner[first], grams[place[first]], first - starts[owner[first]], count, words


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """c, mine (anchors of the document that also occur in another one), n (documents of an anchor, where it is counted).

    docs: c (the id, or for rows without one a hash of the text, so that they do not meet), text.
    """

    def combined(anchors, owners):
        a, c = np.concatenate(anchors), np.concatenate(owners)
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        a, c = a[new], c[new]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        here = np.diff(np.append(head, len(a)))
        names = ["k", "c", "here", "mine"]
        # a row for each anchor, and one for each row with the anchors that it shares with others here
        yield pa.RecordBatch.from_arrays([pa.array(a[head].view(np.int64)), pa.array(c[head]), pa.array(here, pa.int32()), pa.nulls(len(head), pa.list_(pa.int64()))], names)
        shared = np.repeat(here > 1, here)
        if shared.any():
            a, c = a[shared], c[shared]
            order = np.argsort(c, kind="stable")
            a, c = a[order].view(np.int64), c[order]
            cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            mine = pa.ListArray.from_arrays(pa.array(np.append(cut, len(a)), pa.int32()), pa.array(a))
            yield pa.RecordBatch.from_arrays([pa.array(mix(c[cut].astype(np.uint64)).view(np.int64)), pa.array(c[cut]), pa.array(np.zeros(len(cut)), pa.int32()), mine], names)

    def run(batches):
        held, n = [[], []], 0
        for batch in pieces(batches, SLICE):
            owners = batch.column("c").to_numpy()
            for at, owner, a, *_ in anchored(batch.column("text").to_pylist()):
                held[0].append(a)
                held[1].append(owners[owner + at])
                n += len(a)
            if n >= COMBINED:
                yield from combined(*held)
                held, n = [[], []], 0
        if n:
            yield from combined(*held)

    rows = in_arrow(docs.select("c", "text"), run, "k long, c long, here int, mine array<long>")
    same = Window.partitionBy("k")
    seen = rows.select("c", "k", "mine", (F.min("c").over(same) != F.max("c").over(same)).alias("far"), F.sum("here").over(same).alias("n"))
    again = seen.filter("mine IS NOT NULL OR far OR n > 1")
    return again.select("c", F.coalesce("mine", F.array("k")).alias("mine"), F.when(F.col("mine").isNull(), F.col("n")).alias("n"))


def segments(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """did, h, a, starts (windows), seg (words joined by one space) for the anchors that repeat.

    A segment that a row repeats is one row.
    """

    def paired(anchors, rows):
        """One number of an anchor and a row; where two meet by chance, a segment more goes on."""
        return mix(anchors.view(np.uint64) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in pieces(batches, SLICE):
            ids, hashes, texts = batch.column("did").to_numpy(), batch.column("h").to_numpy(), batch.column("text").to_pylist()
            lists = batch.column("anchors").flatten()
            per_row, per_list = (pc.list_value_length(x).to_numpy() for x in (batch.column("anchors"), lists))
            wanted = np.sort(paired(lists.flatten().to_numpy(), np.repeat(np.repeat(np.arange(len(texts)), per_row), per_list)))
            for at, owner, a, start, _, words in anchored(texts):
                key = paired(a, owner + at)
                hits = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                if not len(hits):
                    continue
                segs = words(hits)
                _, back, times = np.unique(key[hits], return_inverse=True, return_counts=True)
                places: list[list[int]] = [[x] for x in start[hits].tolist()]
                kept = np.ones(len(hits), bool)
                same: dict[tuple[int, bytes], int] = {}
                for i in np.flatnonzero(times[back] > 1).tolist():
                    if (j := same.setdefault((int(key[hits[i]]), segs[i]), i)) != i:
                        places[j] += places[i]
                        kept[i] = False
                rows = owner[hits] + at
                made = [pa.array(ids[rows]), pa.array(hashes[rows]), pa.array(a[hits].view(np.int64)), pa.array(places, pa.list_(pa.int32())), pa.array(segs, pa.string())]
                yield pa.RecordBatch.from_arrays(made, ["did", "h", "a", "starts", "seg"]).filter(pa.array(kept))

    marked = repeated.groupBy("c").agg(F.collect_list("mine").alias("anchors"))
    # all columns come along, so that strip() reads the same exchange of the texts
    return in_arrow(docs.join(marked, "c").select(*docs.columns, "anchors"), run, "did long, h long, a long, starts array<int>, seg string")


def first_of_group(found: DataFrame) -> DataFrame:
    """part, seg, did, h, starts, common: the segments, dealt by anchor, and those of common anchors as single windows.

    Of equal windows in a group of a task's rows only those of the smallest did go on. The others are decided: a row for each
    document with all their starts, without seg, dealt by what the document is dealt by.
    """
    names, kinds = ["part", "seg", "did", "h", "starts", "common"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

    def flush(first, decided):
        for at in range(0, len(windows := list(first)), BATCH_ROWS):
            some = windows[at : at + BATCH_ROWS]
            parts = [int(x) for x in np.array([xxhash.xxh3_64_intdigest(w) for w in some], np.uint64).view(np.int64)]
            yield made([(part, w, first[w][0], h, starts, True) for part, w in zip(parts, some) for h, starts in first[w][1]])
        for at in range(0, len(rows := list(decided.items())), BATCH_ROWS):
            yield made([(h if did == LAST else did, None, did, h, starts, True) for (did, h), starts in rows[at : at + BATCH_ROWS]])

    def run(batches):
        first: dict[str, tuple[int, list]] = {}
        decided: dict[tuple[int, int], list[int]] = {}
        n = 0
        for batch in batches:
            common = batch.column("common")
            rest = batch.filter(pc.invert(common))
            yield pa.RecordBatch.from_arrays([rest.column("a"), *(rest.column(k) for k in names[1:])], names)
            rows = batch.filter(common)
            for did, h, seg, starts in zip(*(rows.column(k).to_pylist() for k in ("did", "h", "seg", "starts"))):
                words = seg.split(" ")
                for i in range(len(words) - WINDOW + 1):
                    window, at = " ".join(words[i : i + WINDOW]), [s + i for s in starts]
                    least, owners = first.get(window, (None, None))
                    if owners is None or did < least:
                        for own, places in owners or ():
                            decided.setdefault((least, own), []).extend(places)
                        first[window] = did, [(h, at)]
                    elif did == least:
                        owners.append((h, at))
                    else:
                        decided.setdefault((did, h), []).extend(at)
                    n += len(at)
                if n >= GROUPED:
                    yield from flush(first, decided)
                    first, decided, n = {}, {}, 0
        yield from flush(first, decided)

    return in_arrow(found, run, "part long, seg string, did long, h long, starts array<int>, common boolean")


def first_documents(segs: list[str], dids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each segment the smallest doc_id over all segments that hold the window, by an FM-index; and the
    number of windows of each segment."""
    words = " \n ".join(segs).split(" ")  # a line break is no part of a word, so it separates
    words.append("\n")
    ids = dict(zip(dict.fromkeys(words), range(FIRST, FIRST + len(words))))
    stream = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    stream[stream == ids["\n"]] = SEPARATOR
    breaks = np.flatnonzero(stream == SEPARATOR)
    sizes = np.diff(np.concatenate([[-1], breaks])) - 1
    starts = breaks - sizes
    # words that occur once share one symbol; no window that holds one can occur twice, so none is searched
    seen = np.bincount(stream)
    seen[SEPARATOR] = 2
    common = np.flatnonzero(seen > 1)
    symbol = np.full(len(seen), FIRST)
    symbol[common] = np.where(common == SEPARATOR, SEPARATOR, np.arange(len(common)) + FIRST + 1)
    rare = np.concatenate([[0], np.cumsum(seen[stream] == 1)])
    stream = np.append(symbol[stream], END)
    counts = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(segs)), counts)
    ends = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) + WINDOW - 1
    asked = np.flatnonzero(rare[ends + 1] == rare[ends + 1 - WINDOW])
    index = FMIndex(stream, int(symbol.max()) + 1, WINDOW)
    length, lo, hi = index.matches(stream, ends[asked], WINDOW)
    own = np.array(dids, np.int64)
    least = own[owner]
    full = np.flatnonzero(length == WINDOW)
    found = asked[full]
    if len(full):
        # the document array in suffix order; the END and separators belong to no window
        documents = np.append(np.repeat(own, sizes + 1), LAST)[index.suffixes]
        spans, back = np.unique(lo[full] * (index.n + 1) + hi[full], return_inverse=True)
        bounds = np.column_stack([spans // (index.n + 1), spans % (index.n + 1)]).ravel()
        least[found] = np.minimum.reduceat(np.append(documents, LAST), bounds)[::2][back]
    return least, counts


def shard_reports(dealt: DataFrame) -> DataFrame:
    """did, h, starts, mask of the segments with windows to drop. dealt: part, seg, did, h, starts, common.

    Bit i of mask stands for the window at start + i. Rows without seg are decided and handed on.
    """
    names = ["did", "h", "starts", "mask"]

    def report(rows):
        segs, dids = rows.column("seg").to_pylist(), rows.column("did").to_pylist()
        first: dict[str, int] = {}
        for seg, did in zip(segs, dids):
            if did < first.get(seg, LAST + 1):
                first[seg] = did
        least, counts = first_documents(list(first), list(first.values()))
        place = dict(zip(first, range(len(first))))
        of = np.fromiter(map(place.__getitem__, segs), np.int64, len(segs))
        # the windows of each row, those of its segment
        n = counts[of]
        ends = np.cumsum(n)
        i = np.arange(ends[-1]) - np.repeat(ends - n, n)
        gone = least[np.repeat((np.cumsum(counts) - counts)[of], n) + i] < np.repeat(np.array(dids, np.int64), n)
        mask = np.add.reduceat(gone.astype(np.int64) << i, ends - n)
        some = pa.array(np.flatnonzero(mask))
        return pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks().take(some) for k in names[:3]), pa.array(mask[mask != 0])], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        words, last, now, seen = 0, None, None, {}
        for batch in batches:
            open_rows = batch.column("seg").is_valid()
            if batch.num_rows > open_rows.true_count:
                done = batch.filter(pc.invert(open_rows))
                yield pa.RecordBatch.from_arrays([*(done.column(k) for k in names[:3]), pa.array(np.ones(done.num_rows, np.int64))], names)
                batch = batch.filter(open_rows)
            common = np.flatnonzero(batch.column("common").to_numpy(zero_copy_only=False))
            if len(common):
                # rows come by did, so the first of a window has the least: others of that did have nothing to drop
                stay = np.ones(batch.num_rows, bool)
                some = batch.take(pa.array(common))
                for i, part, seg, did in zip(common.tolist(), *(some.column(k).to_pylist() for k in ("part", "seg", "did"))):
                    if part != now:
                        now, seen = part, {}
                    if seen.get(seg) == did:
                        stay[i] = False
                    seen.setdefault(seg, did)
                batch = batch.filter(pa.array(stay))
            if not batch.num_rows:
                continue
            parts = batch.column("part").to_numpy()
            size = np.cumsum(pc.count_substring(batch.column("seg"), " ").to_numpy() + 2)
            fresh = np.flatnonzero(np.concatenate([[parts[0] != last], parts[1:] != parts[:-1]]))
            at = 0
            for i in fresh.tolist():
                before = int(size[i - 1]) if i else 0
                if words + before - (int(size[at - 1]) if at else 0) >= SHARD_WORDS:
                    held.append(batch.slice(at, i - at))
                    yield report(pa.Table.from_batches(held))
                    held, words, at = [], 0, i
            held.append(batch.slice(at))
            words += int(size[-1]) - (int(size[at - 1]) if at else 0)
            last = parts[-1]
        if words:
            yield report(pa.Table.from_batches(held))

    return in_arrow(dealt.repartition("part").sortWithinPartitions("part", "did"), run, "did long, h long, starts array<int>, mask long")


def known_by() -> Column:
    """What rows are dealt by: the id, or for those without one the hash of their text."""
    return F.when(F.col("did") == LAST, F.col("h")).otherwise(F.col("did"))


def drops(docs: DataFrame) -> DataFrame:
    """c and windows to drop: (did, h, starts, mask), bit i of mask for the windows at each start + i. docs: did, h, c, text and more.

    A row's are those with its did and h, as rows may share an id.
    """
    repeated = written(repeated_anchors(docs))
    hot = repeated.filter(F.col("n") > HOT).select(F.get("mine", F.lit(0)).alias("a"), F.lit(True).alias("common")).distinct()
    n_hot = hot.count()
    found = segments(docs, repeated)
    if not n_hot:
        hits = shard_reports(found.select(F.col("a").alias("part"), "seg", "did", "h", "starts", F.lit(False).alias("common")))
    else:
        side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot  # a checked size
        hits = shard_reports(first_of_group(found.join(side, "a", "left").withColumn("common", F.coalesce("common", F.lit(False)))))
    return hits.groupBy(known_by().alias("c")).agg(F.collect_list(F.struct("did", "h", "starts", "mask")).alias("drops"))


def strip(docs: DataFrame, carry: tuple[str, ...] = (), rejoin: bool = True) -> DataFrame:
    """doc_id, text (the words that stay, joined by one space), n_words, n_removed, spans (removed words: first, end).

    carry: columns to hand on, in a struct `row`. Without rejoin a text that loses nothing stays as it is.
    """
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    own = plain.select(did.alias("did"), F.xxhash64("text").alias("h"), *plain.columns).withColumn("c", known_by())

    def run(batches):
        for batch in pieces(batches, SLICE):
            out: list[list] = [[], [], [], []]
            for did, h, text, drop in zip(*(batch.column(c).to_pylist() for c in ("did", "h", "text", "drops"))):
                words, spans, gone = text.encode().split(), [], 0
                kept = words
                if drop:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for d in drop:
                        for i in range(d["mask"].bit_length() if d["did"] == did and d["h"] == h else 0):
                            if d["mask"] >> i & 1:
                                for start in d["starts"]:
                                    edge[start + i] += 1
                                    edge[start + i + WINDOW] -= 1
                    covered = np.cumsum(edge)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    spans = turns.reshape(-1, 2).tolist()
                    gone = int(covered.sum())
                    kept = [w for w, c in zip(words, covered.tolist()) if not c]
                for values, v in zip(out, (b" ".join(kept) if rejoin or gone else text, len(words), gone, spans)):
                    values.append(v)
            made = [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *([batch.column("row")] if carry else [])], ["doc_id", "text", "n_words", "n_removed", "spans", *(["row"] if carry else [])])

    marked = own.join(drops(own), "c", "left").select("did", "h", "doc_id", "text", "drops", *(["row"] if carry else []))
    return in_arrow(marked, run, f"doc_id {kinds['doc_id']}, text string, n_words long, n_removed long, spans array<array<long>>" + (f", row {kinds['row']}" if carry else ""))


def digests(docs: DataFrame) -> DataFrame:
    return strip(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
