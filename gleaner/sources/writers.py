"""Writing run outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """Overwrite a table and read it back."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def append_table(rows: DataFrame, path: str, *by: str) -> None:
    """Add rows; what stands there stays."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_by_task(rows: DataFrame, path: str) -> None:
    """Add rows whose making is dear: what a task has finished stays, even if others fail and with them the job.

    Each task's file is moved to the table as soon as the task ends (the second
    algorithm of the file committer); readers see whole files only. A task that
    is run again after that adds its rows again, so the reader needs a key.
    """
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def fingerprint(columns: list[str]) -> list[Column]:
    """Aggregates rows and fingerprint: the number of rows and a sum of their hashes, whatever their order."""
    return [F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("fingerprint")]


def observed(rows: DataFrame, write: Callable[[DataFrame], object], *aggregates: Column) -> tuple[object, dict]:
    """What write(rows) gives, and aggregates over the rows that Spark collects while they are written. Nothing is read twice."""
    seen = Observation()
    out = write(rows.observe(seen, *aggregates))
    return out, dict(seen.get)


#: Origins that a row of bank_metadata shows itself; bank_origins has them all.
SHOWN_ORIGINS = 100


def bank_exports(bank: DataFrame, origins: DataFrame) -> dict[str, DataFrame]:
    """Cards, runtime rows, origins and metadata: projections of one bank, with the same index.

    bank: with index; origins: (content_key, memory_id, origin_no, origin, ...),
    a row an origin. A row of the metadata holds how many origins its card has and the first of them.
    """
    some = origins.where(F.col("origin_no") <= SHOWN_ORIGINS).groupBy("content_key").agg(F.array_sort(F.collect_list(F.struct("origin_no", "origin"))).alias("x"))
    return {
        "cards": bank.select("index", "memory_id", "card.*"),
        "bank": bank.select("index", "memory_id", "subject", F.col("card.concept_name").alias("concept"), "description"),
        "bank_origins": origins.join(bank.select("content_key", "index").hint("merge"), "content_key").select("index", "memory_id", "origin_no", "origin"),
        "bank_metadata": bank.join(some.hint("merge"), "content_key").select("index", "memory_id", "subject", "n_origins", F.transform("x", lambda x: x["origin"]).alias("synthesis_records")),
    }


def write_bank(bank: DataFrame, origins: DataFrame, folder: str) -> None:
    for name, rows in bank_exports(bank, origins).items():
        write_jsonl(rows, f"{folder}/{name}")
