"""The term index: frequencies, weights, norms, ignition and similarity, all as long tables keyed by document and term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import Tables, common_join, durable

#: Documents that are counted at once.
ROWS = 1000
#: Terms whose frequencies each task has, because they have the most postings.
KNOWN = 1_000_000


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Column | None = None) -> DataFrame:
    """node, term, tf, max_tf: the tokens (or words) of each document counted where its text is, without an exchange; the rows
    of a document stay together. Where several rows have one id, they are one document, and their counts are added up."""
    own = docs.select(F.col(id_col).alias("node"), (tokens(F.col(text_col)) if words is None else words).alias("words"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(1)
                flat = lists.flatten().dictionary_encode()
                if not len(flat):
                    continue
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                key, tf = np.unique(owner * len(flat.dictionary) + flat.indices.to_numpy(), return_counts=True)
                owner, term = np.divmod(key, len(flat.dictionary))
                top = np.zeros(part.num_rows, np.int64)
                np.maximum.at(top, owner, tf)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), flat.dictionary.take(pa.array(term)), pa.array(tf, pa.int64()), pa.array(top[owner])], ["node", "term", "tf", "max_tf"])

    counts = own.mapInArrow(run, f"node {own.schema['node'].dataType.simpleString()}, term string, tf long, max_tf long")
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return counts
    return with_top(counts.groupBy("node", "term").agg(F.sum("tf").alias("tf")))


def with_top(counts: DataFrame) -> DataFrame:
    """counts with max_tf, the count of a document's most frequent term."""
    return counts.withColumn("max_tf", F.max("tf").over(Window.partitionBy("node")))  # the terms of one document


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, term, tf."""
    return counted(docs, id_col, text_col).select("node", "term", "tf")


def listed(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def bags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, key, tf, max_tf: a row for each document with tokens; key lists their hashes of 64 bits in ascending order, tf how
    often each occurs. As in `counted`, rows with one id are one document."""
    own = docs.select(F.col(id_col).alias("node"), F.transform(tokens(F.col(text_col)), lambda t: F.xxhash64(t)).alias("keys"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(1)
                flat = lists.flatten().dictionary_encode()
                if not len(flat):
                    continue
                keys = flat.dictionary.to_numpy()
                order = np.argsort(keys)
                place = np.empty(len(keys), np.int64)
                place[order] = np.arange(len(keys))
                keys, place = keys[order], place[flat.indices.to_numpy()]
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                each, tf = np.unique(owner * len(keys) + place, return_counts=True)
                owner, term = np.divmod(each, len(keys))
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sizes = np.diff(np.append(first, len(owner)))
                columns = [part.column(0).take(pa.array(owner[first])), listed(sizes, keys[term]), listed(sizes, tf.astype(np.int32)), pa.array(np.maximum.reduceat(tf, first), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "key", "tf", "max_tf"])

    made = own.mapInArrow(run, f"node {own.schema['node'].dataType.simpleString()}, key array<long>, tf array<int>, max_tf long")
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return made
    flat = made.select("node", F.explode(F.arrays_zip("key", "tf")).alias("t")).groupBy("node", F.col("t.key").alias("key")).agg(F.sum("t.tf").cast("int").alias("tf"))
    terms = flat.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "tf"))).alias("t"))  # the terms of one document
    return terms.select("node", F.col("t.key").alias("key"), F.col("t.tf").alias("tf"), F.array_max("t.tf").cast("long").alias("max_tf"))


def bag_frequency(bags: DataFrame) -> DataFrame:
    """key, df."""
    return bags.select(F.explode("key").alias("key")).groupBy("key").agg(F.count("*").alias("df"))


def bag_vectors(bags: DataFrame, n_docs: int, tables: Tables) -> DataFrame:
    """node, key, w, rare, rare_w, norm of stored bags, with the weights of `postings` and the norm of all of them.

    Terms with more than a `KNOWN`-th of all postings, of which there are no more than that, are weighed where their
    document is (key, w); the others (rare, rare_w) meet their frequencies in an exchange. Terms of one document only count for
    its norm and are not listed. Documents without an id count for the frequencies, but have no row.
    """
    df = tables.write("bag-df", bag_frequency(bags))
    total = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first().n
    is_common = F.col("df") > total / KNOWN
    common = df.filter(is_common).sort("key").toArrow()  # bounded
    known, often = (common.column(c).to_numpy() for c in ("key", "df"))
    idf = np.log(float(n_docs) / often) + 1

    def weighed(batches):
        for batch in batches:
            key, tf = (batch.column(c).flatten().to_numpy() for c in ("key", "tf"))
            owner = np.repeat(np.arange(batch.num_rows), batch.column("key").value_lengths().to_numpy(zero_copy_only=False))
            part = tf / batch.column("max_tf").to_numpy()[owner]
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            here = known[at] == key if len(known) else np.zeros(len(key), bool)
            w = part[here] * idf[at[here]]
            sizes, others = (np.bincount(owner[x], minlength=batch.num_rows) for x in (here, ~here))
            lists = listed(sizes, key[here]), listed(sizes, w), listed(others, key[~here]), listed(others, part[~here])
            yield pa.RecordBatch.from_arrays([batch.column("node"), *lists, pa.array(np.bincount(owner[here], w * w, batch.num_rows), pa.float64())], ["node", "key", "w", "others", "part", "squares"])

    lists = "key array<long>, w array<double>, others array<long>, part array<double>"
    own = tables.write("weighed", bags.filter("node IS NOT NULL").mapInArrow(weighed, f"node {bags.schema['node'].dataType.simpleString()}, {lists}, squares double"))
    flat = own.select("node", F.explode(F.arrays_zip("others", "part")).alias("t")).select("node", F.col("t.others").alias("key"), F.col("t.part").alias("part"))
    rare = flat.join(df.filter(~is_common), "key").select("node", "key", "df", (F.col("part") * (F.log(F.lit(float(n_docs)) / F.col("df")) + 1)).alias("w"))
    shared = F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("key", "w"))))
    rare = rare.groupBy("node").agg(shared.alias("t"), F.sum(F.col("w") * F.col("w")).alias("more"))
    norm = F.sqrt(F.col("squares") + F.coalesce("more", F.lit(0.0)))
    return own.drop("others", "part").join(rare, "node", "left").select("node", "key", "w", F.col("t.key").alias("rare"), F.col("t.w").alias("rare_w"), norm.alias("norm"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """term, df."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def postings(counts: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """node, term, tf, max_tf, w with w = tf / max_tf * (ln(N / df) + 1). N counts documents without terms, too.

    counts may have max_tf already; df should be stored, as it is read several times.
    """
    top = counts if "max_tf" in counts.columns else with_top(counts)
    weight = F.col("tf") / F.col("max_tf") * (F.log(F.lit(float(n_docs)) / F.col("df")) + 1)
    return common_join(top, df, "term", "df").select("node", "term", "tf", "max_tf", weight.alias("w"))


def norms(index: DataFrame) -> DataFrame:
    """node, max_tf, norm."""
    return index.groupBy("node").agg(F.max("max_tf").alias("max_tf"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def asked_postings(counts: DataFrame, df: DataFrame, vectors: DataFrame, n_docs: int) -> DataFrame:
    """The postings of the terms of stored vectors alone; no more than `BATCH_TERMS` of them are broadcast."""
    terms = vectors.select("term").distinct()
    if terms.count() <= BATCH_TERMS:
        terms = F.broadcast(terms)
    return postings(counts.join(terms, "term", "left_semi"), df.join(terms, "term", "left_semi"), n_docs)


def query_vector(df: DataFrame, query: str, n_docs: int) -> DataFrame:
    """term, w of a query. Unknown terms are dropped, but count for the largest frequency."""
    spark = df.sparkSession
    words = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    top = words.crossJoin(words.agg(F.max("tf").alias("max_tf")))  # one row
    return df.join(F.broadcast(top), "term").select("term", (F.col("tf") / F.col("max_tf") * (F.log(F.lit(float(n_docs)) / F.col("df")) + 1)).alias("w"))


def ignite(index: DataFrame, doc_norms: DataFrame, vector: DataFrame) -> DataFrame:
    """node, a: the cosine of the query and each document that shares a term; the rest is 0 and has no row.

    The query's terms are a few rows (a sentence), so only their postings are read.
    """
    q = vector.select("term", F.col("w").alias("qw"))
    length = vector.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    dots = index.join(F.broadcast(q), "term").groupBy("node").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(doc_norms, "node").crossJoin(F.broadcast(length)).filter("norm > 0 AND q_norm > 0").select("node", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("a"))


def query_vectors(df: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """q, term, w of many queries(q, text), each as in `query_vector`."""
    words = queries.select("q", F.explode(tokens(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("tf"))
    top = words.withColumn("max_tf", F.max("tf").over(Window.partitionBy("q")))  # the terms of one query
    return top.join(df, "term").select("q", "term", (F.col("tf") / F.col("max_tf") * (F.log(F.lit(float(n_docs)) / F.col("df")) + 1)).alias("w"))


#: Terms of a batch that are broadcast, after a count; those of a larger batch meet the postings in a shuffle.
BATCH_TERMS = 1_000_000


def ignite_many(index: DataFrame, doc_norms: DataFrame, vectors: DataFrame) -> DataFrame:
    """q, node, a of a batch of queries(q, term, w) that is stored, each as in `ignite`: one pass over the postings for all."""
    q = vectors.select("q", "term", F.col("w").alias("qw"))
    lengths = vectors.groupBy("q").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    if q.count() <= BATCH_TERMS:
        q = F.broadcast(q)
    dots = index.join(q, "term").groupBy("q", "node").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(doc_norms, "node").join(lengths, "q").filter("norm > 0 AND q_norm > 0").select("q", "node", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("a"))


def add_documents(counts: DataFrame, df: DataFrame, new_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and frequencies with new documents; stored counts make every weight exact again, without idf drift."""
    more = new_counts.groupBy("term").agg(F.count("*").alias("df"))
    return counts.unionByName(new_counts), df.unionByName(more).groupBy("term").agg(F.sum("df").alias("df"))


def update_documents(counts: DataFrame, df: DataFrame, new_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and frequencies with the new text of known documents. Terms that no document has any more are dropped.

    What a document keeps is taken away and added again, so old and new rows need not meet; ids are broadcast if they are few.
    """
    ids = durable(new_counts.select("node").distinct())
    if ids.count() <= BATCH_TERMS:
        ids = F.broadcast(ids)
    gone = counts.join(ids, "node", "left_semi").select("term", F.lit(-1).cast("long").alias("df"))
    come = new_counts.select("term", F.lit(1).cast("long").alias("df"))
    frequencies = df.unionByName(gone).unionByName(come).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return counts.join(ids, "node", "left_anti").unionByName(new_counts), frequencies
