"""Reading passage groups and checking them before anything runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.records import MAX_GROUP, MAX_PASSAGE, MAX_PASSAGES, PASSAGE, group_spec
from gleaner.functions.strict import first_problem
from gleaner.functions.text import is_text, strip

GROUP = f"struct<group_id:string,subject:string,corpus:string,language:string,passages:array<{PASSAGE}>>"


def parsed_groups(lines: DataFrame, corpora: tuple[str, ...], languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """lines(value, ...) with problem and group. Blank lines are dropped; a line that breaks the schema keeps its first problem.

    Texts of the group are stripped. Duplicate keys in an object: the last one counts.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # exploded from arrays of one, so that a line is parsed once, however often its problem and group are asked for afterwards
    rows = lines.where(is_text(F.col("value"))).withColumn("problem", F.explode(F.array(first_problem(F.col("value"), group_spec(corpora, languages)))))
    g = F.from_json("value", GROUP)
    passages = F.transform(
        g["passages"],
        lambda p: F.struct(strip(p["source_id"]).alias("source_id"), strip(p["passage_id"]).alias("passage_id"), F.coalesce(p["title"], F.lit("")).alias("title"), strip(p["text"]).alias("text")),
    )
    clean = F.struct(strip(g["group_id"]).alias("group_id"), strip(g["subject"]).alias("subject"), g["corpus"].alias("corpus"), g["language"].alias("language"), passages.alias("passages"))
    rows = rows.withColumn("group", F.explode(F.array(F.when(F.col("problem").isNull(), clean))))
    ids = F.transform("group.passages", lambda p: F.struct(p["source_id"], p["passage_id"]))
    total = F.aggregate("group.passages", F.lit(0), lambda n, p: n + F.length(p["text"]))
    more = F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("$.passages: duplicate passage identity")).when(total > MAX_GROUP, F.lit("$.passages: too many characters"))
    rows = rows.withColumn("problem", F.coalesce("problem", more))
    return rows.withColumn("group", F.when(F.col("problem").isNull(), F.col("group")))


def valid_groups(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem is null").select("group.*", *[c for c in parsed.columns if c not in ("value", "problem", "group")])


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem is not null").drop("group")


def passages_of(groups: DataFrame) -> DataFrame:
    """One row per passage: group_id, pos and the passage's fields."""
    return groups.select("group_id", F.posexplode("passages").alias("pos", "p")).select("group_id", "pos", "p.*")


def group_violations(passages: DataFrame) -> DataFrame:
    """(violation, key) of what is wrong with passages(group_id, group_row, pos, source_id, passage_id, text).

    group_row tells input rows apart that claim one group_id.
    """
    group_rows = passages.groupBy("group_id").agg(F.min("group_row").alias("a"), F.max("group_row").alias("b")).where("a <> b").select(F.lit("duplicate group_id").alias("violation"), F.col("group_id").alias("key"))
    key = F.concat_ws("|", "source_id", "passage_id")
    twice = passages.groupBy("group_id", "group_row", "source_id", "passage_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = twice.select(F.lit("duplicate passage in group").alias("violation"), F.concat_ws("|", "group_id", key).alias("key")).distinct()
    # hashes and their extremes are combined before the shuffle, so no text travels
    said = F.sha2("text", 256)
    differ = passages.groupBy("source_id", "passage_id").agg(F.min(said).alias("a"), F.max(said).alias("b")).where("a <> b").select(F.lit("conflicting texts").alias("violation"), key.alias("key"))
    totals = passages.groupBy("group_id", "group_row").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    large = totals.where(F.col("chars") > MAX_GROUP).select(F.lit("too many characters").alias("violation"), F.col("group_id").alias("key")).distinct()
    many = totals.where(F.col("n") > MAX_PASSAGES).select(F.lit("too many passages").alias("violation"), F.col("group_id").alias("key")).distinct()
    long = passages.where(F.length(strip(F.col("text"))) > MAX_PASSAGE).select(F.lit("passage too long").alias("violation"), F.concat_ws("|", "group_id", key).alias("key")).distinct()
    blank = passages.where(~is_text(F.col("text"))).select(F.lit("blank text").alias("violation"), F.concat_ws("|", "group_id", key).alias("key")).distinct()
    out = group_rows
    for part in (twice, differ, large, many, long, blank):
        out = out.unionByName(part)
    return out


def require_groups(groups: DataFrame) -> DataFrame:
    if groups.isEmpty():
        raise ValueError("at least one passage group is required")
    return groups
