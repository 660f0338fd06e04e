"""The term index stored by term: bucketed tables whose readers open only the buckets of a query's terms.

`postings` (term, node, tf, max_tf) and `df` (term, df) have the same buckets, so they meet without an exchange. `norms`
(node, norm) is bucketed by node. Pages that changed since go to small tables with the same buckets, beside the
large ones: a reader leaves out the changed nodes there and adds their new rows, and df sums up. Weights are made from the
counts when they are read, so they follow N and df; `compact` writes all tables anew, norms included.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tfidf
from ..session import Tables

COLUMNS = {"postings": "term STRING, node LONG, tf LONG, max_tf LONG", "df": "term STRING, df LONG", "norms": "node LONG, norm DOUBLE"}
KEY = {"postings": "term", "df": "term", "norms": "node"}


def with_top(counts: DataFrame) -> DataFrame:
    """term, node, tf, max_tf of counts(node, term, tf), which may have max_tf already."""
    own = counts if "max_tf" in counts.columns else tfidf.with_top(counts)
    return own.select("term", "node", "tf", "max_tf")


@dataclass
class TermStore:
    """`n_docs` counts documents without terms, too. The tables of a part are folders below `folder/part-<k>`; part 0 is the
    large one."""

    spark: SparkSession
    folder: str
    buckets: int
    n_docs: int
    parts: int

    def _name(self, table: str, part: int) -> str:
        return f"{table}_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.folder}/{part}').hex}"

    def _write(self, table: str, part: int, rows: DataFrame) -> None:
        key, name = KEY[table], self._name(table, part)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        # one file for each bucket
        rows.repartition(self.buckets, key).write.mode("overwrite").format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/part-{part}/{table}").saveAsTable(name)

    def _read(self, table: str, part: int) -> DataFrame:
        name = self._name(table, part)
        if not self.spark.catalog.tableExists(name):  # written by another session
            key = KEY[table]
            self.spark.sql(f"CREATE TABLE {name} ({COLUMNS[table]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/part-{part}/{table}'")
        return self.spark.table(name)

    def _log(self) -> None:
        """The facts of all parts so far, in a file that appears at once; the last one counts."""
        self.spark.createDataFrame([(self.buckets, self.n_docs, self.parts)], "buckets int, n_docs long, parts int").coalesce(1).write.parquet(f"{self.folder}/facts/n={self.parts:06d}")

    @classmethod
    def create(cls, counts: DataFrame, n_docs: int, folder: str, buckets: int = 64) -> TermStore:
        """counts: node, term, tf."""
        own = cls(counts.sparkSession, folder, buckets, n_docs, 1)
        own._write("postings", 0, with_top(counts))
        own._write("df", 0, own._read("postings", 0).groupBy("term").agg(F.count("*").alias("df")))
        own._write("norms", 0, tfidf.norms(own.postings()).select("node", "norm"))
        own._log()
        return own

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TermStore:
        last = spark.read.parquet(f"{folder}/facts").orderBy(F.desc("n")).first()
        return cls(spark, folder, last.buckets, last.n_docs, last.parts)

    def add(self, old: DataFrame, new: DataFrame, changed: DataFrame, n_docs: int) -> None:
        """Pages changed(node) with the counts before and after; a page that is new has none before, one that is gone none after."""
        part = self.parts
        self._write("postings", part, with_top(new))
        more = new.select("term", F.lit(1).alias("df")).unionByName(old.select("term", F.lit(-1).alias("df")))
        self._write("df", part, more.groupBy("term").agg(F.sum("df").cast("long").alias("df")))
        self._write("norms", part, changed.select("node", F.lit(0.0).alias("norm")).distinct())
        self.n_docs, self.parts = n_docs, part + 1
        self._log()

    def _rows(self, table: str, terms: list[str] | None) -> list[DataFrame]:
        parts = [self._read(table, k) for k in range(self.parts)]
        return parts if terms is None else [p.filter(F.col("term").isin(terms)) for p in parts]

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """term, df."""
        first, *more = self._rows("df", terms)
        if not more:
            return first
        for rows in more:
            first = first.unionByName(rows)
        return first.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def counts(self, terms: list[str] | None = None) -> DataFrame:
        """term, node, tf, max_tf: of all terms, or from the buckets of the given ones alone."""
        parts, out = self._rows("postings", terms), None
        for k, rows in enumerate(parts):
            for later in range(k + 1, self.parts):
                # the pages of a change are few
                rows = rows.join(F.broadcast(self._read("norms", later).select("node")), "node", "left_anti")
            out = rows if out is None else out.unionByName(rows.select(*out.columns))
        return out

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """The same with w."""
        weight = F.col("tf") / F.col("max_tf") * (F.log(F.lit(float(self.n_docs)) / F.col("df")) + 1)
        return self.counts(terms).join(self.frequencies(terms), "term").select("node", "term", "tf", "max_tf", weight.alias("w"))

    def norms(self) -> DataFrame:
        """node, norm: as stored, or made anew where pages changed since, as each of them changes the weights of all."""
        return self._read("norms", 0) if self.parts == 1 else tfidf.norms(self.postings()).select("node", "norm")

    def ignite(self, query: str) -> DataFrame:
        """node, a of a query: only the buckets of its terms are read."""
        words = [r.term for r in self.spark.range(1).select(F.explode(tfidf.tokens(F.lit(query))).alias("term")).distinct().collect()]  # a query's
        vector = tfidf.query_vector(self.frequencies(words), query, self.n_docs)
        return tfidf.ignite(self.postings(words), self.norms(), vector)

    def compact(self, folder: str) -> TermStore:
        """All parts as one, in another folder."""
        tables = Tables(self.spark)
        counts = tables.write("counts", self.counts())
        made = TermStore.create(counts, self.n_docs, folder, self.buckets)
        tables.drop()
        return made
