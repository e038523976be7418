"""Reading passage groups, corpora, caches and stage results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import article_of

RECORD_LIMIT = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, place) of text files; U+2028 and U+0085 stay within a line.

    block and place say where a line stands, for line_numbers: the byte at which
    Spark split the file, and the line's place among all lines of its task.
    """
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def line_numbers(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(file, block, place, ...), some of read_lines()'s rows, with line: their number in their file, from 1, blank lines counted.

    A block is read by one task in one go, so a line's number in it is how far
    its place is from the block's first; the lines of the blocks before come on
    top. The lines are counted where they are read, and only a row a block and
    the wanted rows are moved.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return wanted.join(blocks.hint("merge"), ["file", "block"]).withColumn("line", F.col("place") - F.col("_first") + F.col("_before") + 1).drop("_first", "_before")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Corpus shards of JSON lines: (corpus, refused).

    corpus(article_id, passage_id, title, section, text, line_sha256,
    text_sha256); the line's hash covers its line break. Records over the size
    limit, without a string id or text, or that are no JSON are refused.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.length("value") > 0)
    v = F.try_parse_json("value")
    rows = lines.withColumn("v", v)

    def string(name: str):
        inner = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))

    problem = F.when(F.octet_length("value") + 1 >= RECORD_LIMIT, F.lit("record too large")).when(F.col("v").isNull(), F.lit("no JSON")).when(string("id").isNull(), F.lit("no id")).when(string("text").isNull(), F.lit("text is no string"))
    rows = rows.withColumn("problem", problem)
    corpus = rows.where("problem is null").select(
        article_of(string("id")).alias("article_id"), string("id").alias("passage_id"), F.coalesce(string("title"), F.lit("")).alias("title"), F.coalesce(string("section"), F.lit("")).alias("section"),
        string("text").alias("text"), F.sha2(F.concat("value", F.lit("\n")), 256).alias("line_sha256"), F.sha2(string("text"), 256).alias("text_sha256"),
    )
    return corpus, rows.where("problem is not null").select("file", "problem", F.substring("value", 1, 240).alias("start"))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not exist yet: empty then."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def all_prompts(prompts: dict[str, str]) -> dict[str, str]:
    """The prompt of every stage; repair_review takes card_review's where it has none of its own."""
    return {"repair_review": prompts.get("card_review", ""), **prompts}
