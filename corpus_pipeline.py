"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontamination, sentencepiece_codec, simhash, suffix_dedup, toxicity
from gleaner.llm.common import Stages, table
from gleaner.llm.repeats import row_ids, without_equal_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the labels of a third of the documents are never learnt from.

    Each row is scored by its own text, repeated rows alike; null and empty
    texts have the lowest score and stay. Without labels every row stays.
    """
    labels = table(spark, sf_dir, "labels").where(toxicity.third() != 1)
    model = toxicity.train(docs, labels, Stages(spark, "toxicity"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of smallest doc_id.

    Rows without doc_id, or whose doc_id has another text too, come after all
    others and are told apart by doc_id and text; of equal rows one stays.
    Null, empty and blank texts are one group.
    """
    stages = Stages(spark, "groups")
    rows = stages.put(row_ids(docs.select(*COLUMNS), stages), "rows")
    groups = simhash.simhash_dedup(rows.select(F.col("row_id").alias("doc_id"), "text"))
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("row_id")).distinct()
    return without_equal_rows(rows.join(others.hint("merge"), "row_id", "left_anti"), "row_id").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that start earlier in the collection.

    Rows without doc_id come last and lose what stands before them. Null and
    empty texts stay as they are; a text of which all goes stays as an empty one.
    """
    spans = suffix_dedup.removal_spans(docs, unnamed=True)
    rest = suffix_dedup.deduplicated(docs, spans, COLUMNS)
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, however short its items are.

    Each row is judged by its own text, with or without doc_id; null and empty
    texts hold nothing and stay. Without benchmark items every row stays.
    """
    stages = Stages(spark, "leaks")
    rows = stages.put(row_ids(docs.select(*COLUMNS), stages), "rows")
    leaks = decontamination.contaminated(rows.select(F.col("row_id").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), shortest=1)
    leaks = stages.put(leaks.select(F.col("doc_id").alias("row_id")).distinct(), "ids")
    return rows.join(leaks, "row_id", "left_anti").select(*COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids; null and empty texts have none."""
    return sentencepiece_codec.encode(docs, keep=COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", tokenized),
]

#: No stage but decontamination can be said in SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    stages = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
