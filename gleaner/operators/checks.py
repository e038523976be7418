"""Relational checks of what the stages return: citations, coverage, gates, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "cast(array() as array<string>)"


def citation_check(citations: DataFrame, passages: DataFrame) -> DataFrame:
    """citations(group_id, source_id, passage_id, quote, ...) with ok and error: the quote must stand in that passage of its own group."""
    known = passages.select("group_id", "source_id", "passage_id", F.col("text").alias("passage_text"))
    joined = citations.join(known.hint("merge"), ["group_id", "source_id", "passage_id"], "left")
    ok = F.coalesce(F.contains("passage_text", "quote"), F.lit(False))
    return joined.withColumn("ok", ok).withColumn("error", F.when(~F.col("ok"), citation_error(F.col("source_id"), F.col("passage_id"), F.col("quote")))).drop("passage_text")


def citation_error(source_id: Column, passage_id: Column, quote: Column) -> Column:
    return F.concat(F.lit("no exact quotation: source_id="), source_id, F.lit(", passage_id="), passage_id, F.lit(", quote="), F.substring(quote, 1, 240))


def wrong_citations(citations: Column, passages: Column) -> Column:
    """The same check where a row holds both arrays: errors of citations that no passage bears out."""
    bad = F.filter(citations, lambda c: ~F.exists(passages, lambda p: (p["source_id"] == c["source_id"]) & (p["passage_id"] == c["passage_id"]) & F.contains(p["text"], c["quote"])))
    return F.transform(bad, lambda c: citation_error(c["source_id"], c["passage_id"], c["quote"]))


def label(field: Column, index: Column) -> Column:
    return F.concat(field, F.lit("["), F.coalesce(index.cast("string"), F.lit("null")), F.lit("]"))


def expected_labels(card: Column) -> Column:
    """What a card's grounding must cover: both scalars and every list item."""

    def of(name: str) -> Column:
        n = F.size(card[name])
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: label(F.lit(name), i))).otherwise(F.expr(NONE))

    return F.concat(F.array(label(F.lit("concept_name"), F.lit(None)), label(F.lit("definition"), F.lit(None))), of("trigger"), of("decision"), of("pitfall"))


def coverage(card: Column, actual: Column) -> Column:
    """struct(missing, extra, repeated), sorted labels. actual: array<string> of the grounding's labels."""
    expected = expected_labels(card)
    seen = F.array_distinct(actual)
    repeated = F.filter(seen, lambda x: F.size(F.filter(actual, lambda y: y == x)) > 1)
    return F.struct(F.array_sort(F.array_except(expected, actual)).alias("missing"), F.array_sort(F.array_except(actual, expected)).alias("extra"), F.array_sort(repeated).alias("repeated"))


def covers(indexes: Column, n: Column) -> Column:
    """Whether the indexes are 0 to n - 1, each once."""
    wanted = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_sort(F.transform(indexes, lambda i: i.cast("int"))) == wanted


def review_coverage(candidates: DataFrame, judgments: DataFrame) -> DataFrame:
    """(group_id, candidates, judged, covered) of every group with a candidate or a judgment."""
    n = candidates.groupBy("group_id").agg(F.count("*").alias("candidates"))
    seen = judgments.groupBy("group_id").agg(F.collect_list("card_index").alias("indexes"))
    both = n.join(seen.hint("merge"), "group_id", "full").withColumns({"candidates": F.coalesce("candidates", F.lit(0).cast("bigint")), "indexes": F.coalesce("indexes", F.expr("cast(array() as array<bigint>)"))})
    return both.select("group_id", "candidates", F.size("indexes").cast("bigint").alias("judged"), covers(F.col("indexes"), F.col("candidates")).alias("covered"))


def gate(flags: list[Column], *lists: Column) -> Column:
    """All flags true and all lists empty."""
    out = F.lit(True)
    for f in flags:
        out = out & F.coalesce(f, F.lit(False))
    for x in lists:
        out = out & (F.size(x) == 0)
    return out


def repaired(candidates: DataFrame, repairs: DataFrame, replacement: str) -> DataFrame:
    """Candidates after repair: replaced, kept where no repair names them, dropped where the replacement is null; indexes anew.

    candidates(group_id, card_index, <replacement>, ...), repairs(group_id,
    card_index, <replacement>). Gives original_index and the new card_index.
    """
    fixes = repairs.select("group_id", "card_index", F.col(replacement).alias("_new"), F.lit(True).alias("_named"))
    merged = candidates.join(fixes.hint("merge"), ["group_id", "card_index"], "left").withColumn(replacement, F.when(F.col("_named"), F.col("_new")).otherwise(F.col(replacement)))
    kept = merged.where(F.col(replacement).isNotNull()).drop("_new", "_named").withColumnRenamed("card_index", "original_index")
    return kept.withColumn("card_index", F.row_number().over(Window.partitionBy("group_id").orderBy("original_index")) - 1)


def repair_mismatch(rejected: DataFrame, repairs: DataFrame) -> DataFrame:
    """(group_id, card_index, problem) where the repairs are not exactly the rejected candidates."""
    a = rejected.select("group_id", "card_index", F.lit(1).alias("was_rejected"))
    b = repairs.groupBy("group_id", "card_index").agg(F.count("*").alias("n"))
    both = a.join(b.hint("merge"), ["group_id", "card_index"], "full")
    problem = F.when(F.col("n").isNull(), F.lit("no repair")).when(F.col("was_rejected").isNull(), F.lit("not rejected")).when(F.col("n") > 1, F.lit("repaired twice"))
    return both.withColumn("problem", problem).where("problem is not null").select("group_id", "card_index", "problem")
