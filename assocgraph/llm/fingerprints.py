"""Merkle fingerprints of documents: root, sections, paragraphs, leaves of a few words.

A blank line starts a section, a line break a paragraph; a paragraph's leaves are runs of up to `LEAF_WORDS` words counted
from its start (a word counts once for each `WORD_CHARS` characters, so text without spaces has leaves, too). A paragraph's
digest is that of its leaf digests, a section's that of its paragraph digests, and the root's that of the section digests
and the text as it stands. So an edit changes some leaves of one paragraph and the branches above them only, and comparing
two trees goes down into differing branches alone. Everything is Catalyst expressions, and each digest is computed once.

A fingerprint is text: `root/section/section...`, a section `digest=paragraph,paragraph...`, a paragraph `digest:leaves`, with
64, 16, 12 and 8 hexadecimal digits for a root, section, paragraph and leaf.

Defined results: null counts as empty; the empty text has one section, paragraph and leaf; equal texts have equal
fingerprints, and the root covers every character, white space too; rows that repeat are fingerprinted each; an empty table
gives an empty table; other columns are ignored. In `edited_pairs` rows of equal doc_id follow each other in the order of a
hash of their text, and a null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

LEAF_WORDS, WORD_CHARS = 8, 16
ROOT_DIGITS, SECTION_DIGITS, PARAGRAPH_DIGITS, LEAF_DIGITS = 64, 16, 12, 8
LEAF = r"[\x09-\x0D\x20]*(?:[^\x09-\x0D\x20]{1,%d}[\x09-\x0D\x20]*){1,%d}" % (WORD_CHARS, LEAF_WORDS)
SECTION_BREAK = r"\n[ \t\r]*\n"


def sha(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed one time however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def joined(items: Column, part: Callable[[Column], Column], between: str = "") -> Column:
    return F.array_join(F.transform(items, part), between)


def leaves_of(paragraph: Column) -> Column:
    """The runs of words of a paragraph; what has no words is one leaf as it is."""
    return once(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda runs: F.when(F.size(runs) == 0, F.array(paragraph)).otherwise(runs))


def _paragraph(text: Column) -> Column:
    leaves = F.transform(leaves_of(text), sha)
    return once(leaves, lambda x: F.struct(sha(F.array_join(x, "")).alias("d"), joined(x, lambda y: F.left(y, F.lit(LEAF_DIGITS))).alias("t")))


def _section(text: Column) -> Column:
    paragraphs = F.transform(F.split(text, "\n"), _paragraph)
    as_text = lambda x: joined(x, lambda y: F.concat(F.left(y["d"], F.lit(PARAGRAPH_DIGITS)), F.lit(":"), y["t"]), ",")
    return once(paragraphs, lambda x: F.struct(sha(joined(x, lambda y: y["d"])).alias("d"), as_text(x).alias("t")))


def merkle(text: Column) -> Column:
    """The fingerprint of a text."""
    sections = F.transform(F.split(text, SECTION_BREAK), _section)
    # the root also covers the text as it stands, so white space between sections counts
    root = lambda x: sha(F.concat(joined(x, lambda y: y["d"]), sha(text)))
    as_text = lambda x: joined(x, lambda y: F.concat(F.left(y["d"], F.lit(SECTION_DIGITS)), F.lit("="), y["t"]), "/")
    return once(sections, lambda x: F.concat(root(x), F.lit("/"), as_text(x)))


def _cut(leaves: Column) -> Column:
    return F.regexp_extract_all(leaves, F.lit("[0-9a-f]{%d}" % LEAF_DIGITS), F.lit(0))


def leaf_digests(fingerprint: Column) -> Column:
    paragraphs = F.split(F.substring(fingerprint, ROOT_DIGITS + 2, 2**31 - 1), "[/,]")
    return _cut(joined(paragraphs, lambda x: F.substring_index(x, ":", -1)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, otherwise the share of different leaves that the fingerprints have in common (Dice)."""
    same = F.left(a, F.lit(ROOT_DIGITS)) == F.left(b, F.lit(ROOT_DIGITS))
    both = F.struct(F.array_distinct(leaf_digests(a)).alias("x"), F.array_distinct(leaf_digests(b)).alias("y"))
    dice = once(both, lambda v: F.lit(2.0) * F.size(F.array_intersect(v["x"], v["y"])) / (F.size(v["x"]) + F.size(v["y"])))
    return F.when(same, F.lit(1.0)).otherwise(dice)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each document."""
    return id_and_text(docs, id_col, text_col).select("doc_id", merkle(F.col("text")).alias("fingerprint"))


def branches(fingerprint: Column) -> Column:
    """The tree as an array, one entry for each paragraph: s and p (section and paragraph digest), first (the position of its
    first leaf, from 0) and leaves (an array)."""
    sections = F.split(F.substring(fingerprint, ROOT_DIGITS + 2, 2**31 - 1), "/")
    cut = lambda s: F.transform(F.split(F.substring_index(s, "=", -1), ","), lambda p: F.struct(F.left(s, F.lit(SECTION_DIGITS)).alias("s"), F.left(p, F.lit(PARAGRAPH_DIGITS)).alias("p"), _cut(F.substring_index(p, ":", -1)).alias("leaves")))
    flat = F.flatten(F.transform(sections, cut))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))
    starts = lambda x: F.aggregate(x, start, lambda acc, p: F.struct((acc["n"] + F.size(p["leaves"])).alias("n"), F.array_append(acc["at"], acc["n"]).alias("at")))["at"]
    return once(flat, lambda x: F.zip_with(x, starts(x), lambda p, at: F.struct(p["s"].alias("s"), p["p"].alias("p"), at.alias("first"), p["leaves"].alias("leaves"))))


def differing_leaves(a: Column, b: Column) -> Column:
    """The positions, from 0, of the leaves of a that b has not, found from the root down.

    Sections that b has too are skipped, then paragraphs that the other sections of b have, then leaves that the other
    paragraphs of these have: a branch that moved is the same branch, and only differing ones are entered.
    """
    digests = lambda x, name: F.transform(x, lambda y: y[name])
    only = lambda x, name, other: F.filter(x, lambda y: F.array_contains(F.array_except(digests(x, name), digests(other, name)), y[name]))
    trees = F.struct(branches(a).alias("x"), branches(b).alias("y"))
    narrowed = lambda v, name: F.struct(only(v["x"], name, v["y"]).alias("x"), only(v["y"], name, v["x"]).alias("y"))
    leaves = lambda x: F.flatten(F.transform(x, lambda y: F.transform(y["leaves"], lambda d, i: F.struct(d.alias("d"), (y["first"] + i).alias("at")))))
    found = once(once(trees, lambda v: narrowed(v, "s")), lambda v: narrowed(v, "p"))
    last = once(found, lambda v: F.struct(leaves(v["x"]).alias("x"), leaves(v["y"]).alias("y")))
    at = once(last, lambda v: F.transform(only(v["x"], "d", v["y"]), lambda y: y["at"]))
    return F.when(F.left(a, F.lit(ROOT_DIGITS)) == F.left(b, F.lit(ROOT_DIGITS)), F.array().cast("array<int>")).otherwise(at)


def block_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below doc_id, by halving an array literal: log2 of the cuts' number steps for a row."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(str(cuts)), "array<bigint>")
    span = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = doc_id >= F.get(table, mid)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), span, halve)["lo"]


def next_in_order(docs: DataFrame, rows_per_block: int, most_blocks: int = 20_000) -> DataFrame:
    """Each row with the following row's text and fingerprint, in descending doc_id; after the last comes the first.

    docs: doc_id, text. Rows go to ranges of doc_id at quantiles of the ids and are sorted inside them; a
    range's last row takes the first of the next range. So no task sees more than its share, and only a row for each range
    is handled together. An id that very many rows share makes one range larger; its sort spills.
    """
    blocks = max(1, min(most_blocks, docs.count() // rows_per_block))
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.5 / blocks)}) if blocks > 1 else []
    plain = docs.withColumn("tie", F.xxhash64("text")).withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(block_of(F.col("doc_id"), cuts)))
    placed = plain.withColumn("fingerprint", merkle(F.col("text")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    inside = Window.partitionBy("block").orderBy(*order)
    ranked = placed.select("doc_id", "text", "fingerprint", "block", F.lead(F.struct("text", "fingerprint")).over(inside).alias("follower"))
    # the first row of each block: at most `blocks` + 1 rows, the smallest in order by a map-side aggregation of ids alone,
    # whose texts are fetched and fingerprinted then
    heads = plain.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "tie")).alias("top"))
    heads = heads.select("block", (-F.col("top.down")).cast("long").alias("doc_id"), F.col("top.tie").alias("tie"))
    heads = plain.alias("p").join(F.broadcast(heads.alias("h")), (F.col("p.block") == F.col("h.block")) & F.col("p.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("p.tie") == F.col("h.tie")))
    heads = heads.groupBy("p.block").agg(F.first("p.text").alias("text")).select("block", F.struct("text", merkle(F.col("text")).alias("fingerprint")).alias("head"))
    chain = Window.orderBy(F.desc("block"))
    follow = heads.select("block").select("block", F.lead("block").over(chain).alias("nb"), F.first("block").over(chain).alias("top"))
    after = follow.select("block", F.coalesce("nb", "top").alias("nb")).join(heads.select(F.col("block").alias("nb"), "head"), "nb").select("block", "head")
    return ranked.join(after, "block", "left").select("doc_id", "text", "fingerprint", F.coalesce("follower", "head").alias("follower"))


def edited_pairs(docs: DataFrame, rows_per_block: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint, next_fingerprint, edited: the text with its last half replaced by the start of the next."""
    own = id_and_text(docs, id_col, text_col)
    rows = next_in_order(own.select("doc_id", "text"), rows_per_block)
    half = F.expr("CAST(char_length(text) DIV 2 AS INT)")
    edited = F.concat(F.expr("left(text, char_length(text) - CAST(char_length(text) DIV 2 AS INT))"), F.substring(F.col("follower.text"), F.lit(1), half))
    return rows.select("doc_id", "text", "fingerprint", F.col("follower.fingerprint").alias("next_fingerprint"), edited.alias("edited"))


def edits(docs: DataFrame, rows_per_block: int = 2000) -> DataFrame:
    """The fingerprints of each document and its edited text, and their likeness to each other and to the next one's."""
    rows = edited_pairs(docs, rows_per_block).withColumn("edited_fingerprint", merkle(F.col("edited")))
    own = F.col("fingerprint")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        sha(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )
