"""A corpus that is laid out once for all runs: bucketed tables that joins and caps read without a shuffle."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Passages of an article that the first table holds: no cap on candidates may be larger.
MOST = 256


@dataclass(frozen=True)
class ClusteredCorpus:
    """Three tables in a folder that all executors share.

    passages: every passage with its text and scores, bucketed and sorted by
    passage_id, for looking up seeds and texts. first: the first MOST passages
    of each article by id, with n (from 1) and without text, bucketed by
    article_id: bounded, however large an article is. articles: article_id and
    available, bucketed alike. Passages are scored and numbered here, once.
    """

    spark: SparkSession
    folder: str

    @staticmethod
    def write(corpus: DataFrame, folder: str, buckets: int = 64) -> ClusteredCorpus:
        """Lay out corpus(article_id, passage_id, title, text) in a new folder; a second layout in one folder is an error. Choose buckets for some hundred megabytes each."""
        from gleaner.operators.export import numbered_within
        from gleaner.operators.preparation import SCORES, scored

        spark, folder = corpus.sparkSession, folder.rstrip("/")
        out = ClusteredCorpus(spark, folder)
        rows = scored(corpus.select("article_id", "passage_id", "title", "text"))
        rows.repartition(buckets, "passage_id").write.format("parquet").bucketBy(buckets, "passage_id").sortBy("passage_id").option("path", f"{folder}/passages").mode("error").saveAsTable(out.name("passages"))
        numbered = numbered_within(out.table("passages").select("article_id", "passage_id", *SCORES), ["article_id"], ["passage_id"], "n")
        numbered.where(F.col("n") <= MOST).repartition(buckets, "article_id").write.format("parquet").bucketBy(buckets, "article_id").sortBy("article_id", "n").option("path", f"{folder}/first").mode("error").saveAsTable(out.name("first"))
        sizes = out.table("passages").groupBy("article_id").agg(F.count("*").alias("available"))
        sizes.repartition(buckets, "article_id").write.format("parquet").bucketBy(buckets, "article_id").sortBy("article_id").option("path", f"{folder}/articles").mode("error").saveAsTable(out.name("articles"))
        # last, so that a folder with it is whole
        layout = [(t, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.table(t).schema)) for t in ("passages", "first", "articles")]
        spark.createDataFrame(layout, "name string, buckets int, ddl string").coalesce(1).write.parquet(f"{folder}/layout")
        return out

    @staticmethod
    def open(spark: SparkSession, folder: str) -> ClusteredCorpus:
        """The tables of a folder, made known to this session's catalog where they are not."""
        out = ClusteredCorpus(spark, folder.rstrip("/"))
        keys = {"passages": ("passage_id", "passage_id"), "first": ("article_id", "article_id, n"), "articles": ("article_id", "article_id")}
        for r in spark.read.parquet(f"{out.folder}/layout").collect():  # three rows
            by, order = keys[r.name]
            spark.sql(f"create table if not exists {out.name(r.name)} ({r.ddl}) using parquet location '{out.folder}/{r.name}' clustered by ({by}) sorted by ({order}) into {r.buckets} buckets")
        return out

    def name(self, table: str) -> str:
        return f"gleaner_{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}_{table}"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def by_passage(self) -> DataFrame:
        return self.table("passages")

    def first(self, cap: int) -> DataFrame:
        """The first `cap` passages of every article."""
        if not 1 <= cap <= MOST:
            raise ValueError(f"the cap must be 1 to {MOST}")
        return self.table("first").where(F.col("n") <= cap)

    def sizes(self) -> DataFrame:
        """(article_id, available)."""
        return self.table("articles")
