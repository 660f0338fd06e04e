"""Retrieval and chunk quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..session import Tables, common_join, durable
from . import tfidf


def recall_precision(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """recall, precision, f1 of lists of item, one row. Repeated items count as often as they are listed; empty lists give 0."""
    ratio = lambda rows, of, name: rows.join(of.select("item").distinct().withColumn("hit", F.lit(1)), "item", "left").agg(F.coalesce(F.sum("hit") / F.count("*"), F.lit(0.0)).alias(name))
    both = ratio(relevant, retrieved, "recall").crossJoin(ratio(retrieved, relevant, "precision"))
    f1 = 2 * F.col("recall") * F.col("precision") / F.nullif(F.col("recall") + F.col("precision"), F.lit(0.0))
    return both.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def hop_recall(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """hop, recall for relevant(item, hop)."""
    hits = retrieved.select("item").distinct().withColumn("hit", F.lit(1))
    return relevant.join(hits, "item", "left").groupBy("hop").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def coherence(vectors: DataFrame) -> DataFrame:
    """chunk, coherence for vectors(chunk, v): the mean cosine of its pairs, 1 for fewer than two.

    The cosines of all pairs add up to half of what the squared length of the sum of unit vectors exceeds the sum of their
    squared lengths by, so no pair is formed.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select("chunk", F.transform("v", lambda x: F.coalesce(x / F.nullif(length, F.lit(0.0)), F.lit(0.0))).alias("u"))
    own = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    sizes = unit.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(own).alias("self"))
    sums = unit.select("chunk", F.posexplode("u").alias("at", "x")).groupBy("chunk", "at").agg(F.sum("x").alias("x")).groupBy("chunk").agg(F.sum(F.col("x") * F.col("x")).alias("whole"))
    return sizes.join(sums, "chunk", "left").select("chunk", F.when(F.col("n") < 2, 1.0).otherwise((F.coalesce("whole", F.lit(0.0)) - F.col("self")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def mean_coherence(vectors: DataFrame) -> DataFrame:
    """coherence: the mean over chunks whatever their size, 0 without any."""
    return coherence(vectors).agg(F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("coherence"))


def density_variance(items: DataFrame) -> DataFrame:
    """variance of score / cost over positive scores, 0 without any."""
    return items.filter("score > 0").agg(F.coalesce(F.var_pop(F.col("score") / F.col("cost")), F.lit(0.0)).alias("variance"))


def percentiles(values: DataFrame, column: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """avg, low, high and nearest-rank percentiles, one row; nulls are left out.

    Different values are counted, ranked in ranges and shifted by the counts of the ranges before, so no task sees all.
    """
    tables = Tables(values.sparkSession)
    own = values.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    counted = own.groupBy("v").agg(F.count("*").alias("n")).repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part"))
    counted = tables.write("counted", counted)
    sizes = counted.groupBy("part").agg(F.sum("n").alias("size"))  # a row for each range
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    last = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = counted.withColumn("last", last).join(F.broadcast(before), "part").select("v", "n", (F.col("before") + F.col("last")).alias("last"))
    total = counted.agg(F.sum("n").alias("total"))
    placed = ranked.crossJoin(F.broadcast(total))  # one row
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("total") / 100))
    return placed.agg(
        (F.sum(F.col("v") * F.col("n")) / F.max("total")).alias("avg"), F.min("v").alias("low"), F.max("v").alias("high"), *[F.min(F.when(F.col("last") >= rank(p), F.col("v"))).alias(f"p{p}") for p in points]
    )


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """item, s: the k vectors (item, v) with the largest cosine to the one query vector (q)."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).select("item", cosine(F.col("v"), F.col("q")).alias("s")).orderBy(F.desc("s"), "item").limit(k)


def baseline_topk(docs: DataFrame, query: str, k: int) -> DataFrame:
    """item, s: a plain vector search to compare with: raw counts, idf ln((1 + n) / (1 + df)) + 1 fitted on the query and the
    documents (item, text), unit length, cosine."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    n = docs.count() + 1
    tf = durable(tfidf.counted(docs, "item", words=words(F.coalesce("text", F.lit("")))).select(F.col("node").alias("item"), "term", "tf"))
    asked = docs.sparkSession.range(1).select(F.explode(words(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    df = durable(tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(asked), "term", "left").withColumn("df", F.col("df") + F.col("qtf").isNotNull().cast("int")))
    idf = F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1
    rows = common_join(tf, df, "term", "df").select("item", (F.col("tf") * idf).alias("w"), (F.col("qtf") * idf).alias("q"))
    scored = rows.groupBy("item").agg((F.sum(F.col("w") * F.col("q")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("dot"))
    # the query's own length, unseen words included (they are in one text, the query)
    length = asked.join(df.select("term", "df"), "term", "left").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * (F.log((1 + F.lit(float(n))) / (1 + F.coalesce("df", F.lit(1)))) + 1), F.lit(2)))).alias("length"))
    return scored.filter("dot > 0").crossJoin(F.broadcast(length)).select("item", (F.col("dot") / F.col("length")).alias("s")).orderBy(F.desc("s"), "item").limit(k)


#: Positions of a bin of the interval join.
BIN = 64


def in_ranges(points: DataFrame, ranges: DataFrame, width: int = BIN) -> DataFrame:
    """points(pos, ...) with the columns of each of the ranges(first, end, ...) that they lie in, first <= pos < end.

    A range has a row for each bin that it crosses, a point for its own bin; they meet there by equality, and the bounds are
    looked at after. A bin of very many ranges is split by the join's own handling of skew.
    """
    crossed = ranges.filter("first < end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("end") - 1) / width))))
    placed = points.withColumn("_bin", F.floor(F.col("pos") / width))
    return placed.join(crossed, "_bin").filter("first <= pos AND pos < end").drop("_bin")


def range_coherence(vectors: DataFrame, chunks: DataFrame, width: int = BIN) -> DataFrame:
    """chunk, n, coherence of chunks(chunk, first, end) over vectors(pos, v), as in `coherence`; ranges may be uneven, overlap
    or hold nothing."""
    inside = in_ranges(vectors, chunks.select("chunk", "first", "end"), width).select("chunk", "v")
    tables = Tables(vectors.sparkSession)
    inside = tables.write("inside", inside)
    found = coherence(inside).join(inside.groupBy("chunk").agg(F.count("*").alias("n")), "chunk")
    return chunks.select("chunk").join(found, "chunk", "left").select("chunk", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("coherence", F.lit(1.0)).alias("coherence"))
