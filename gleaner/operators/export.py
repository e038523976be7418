"""From accepted cards to a bank: exact dedup with lineage, rendering, row order and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import BANK_PREFIX, content_key, memory_id, render_card
from gleaner.sources.scratch import new_folder
from gleaner.sources.writers import fingerprint, write_table


def keyed(cards: DataFrame) -> DataFrame:
    """cards(group_order, card_index, subject, card, origin) with content_key."""
    return cards.withColumn("content_key", content_key(F.col("subject"), F.col("card")))


def bank(cards: DataFrame, prefix: str = BANK_PREFIX) -> DataFrame:
    """One row per content: (content_key, memory_id, subject, card, description, group_order, card_index, n_origins).

    cards: keyed(). The card of the first origin is kept. Only that and a count
    are merged, before the shuffle too, so a card of a million origins is a row
    a task; the origins themselves are lineage().
    """
    order = F.struct("group_order", "card_index")
    merged = cards.groupBy("content_key").agg(F.min_by(F.struct("card", "subject"), order).alias("kept"), F.min(order).alias("first"), F.count("*").alias("n_origins"))
    return merged.select(
        "content_key", memory_id(F.col("content_key"), prefix).alias("memory_id"), "kept.subject", "kept.card", render_card(F.col("kept.card")).alias("description"),
        F.col("first.group_order").alias("group_order"), F.col("first.card_index").alias("card_index"), "n_origins",
    )


def lineage(cards: DataFrame, prefix: str = BANK_PREFIX) -> DataFrame:
    """(content_key, memory_id, origin_no, group_order, card_index, origin): every origin of every card of the bank, numbered from 1 in order.

    cards: keyed(). A card's origins are spread over range partitions by their
    order, so a frequent card is many tasks' work.
    """
    rows = numbered_within(cards.select("content_key", "group_order", "card_index", "origin"), ["content_key"], ["group_order", "card_index"], "origin_no")
    return rows.select("content_key", memory_id(F.col("content_key"), prefix).alias("memory_id"), "origin_no", "group_order", "card_index", "origin")


def dense_index(rows: DataFrame, keys: list[str], name: str = "index") -> DataFrame:
    """Rows numbered from 0 in the order of keys, without one global window.

    Rows are range-partitioned, sorted and written with their place in their
    partition; the offset of a partition is the count of those before it. What
    is written is read by both, since a second range partitioning could draw
    other bounds.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the id's upper bits are the partition, the lower 33 the place in it
    placed = write_table(sorted_.withColumn("_place", F.monotonically_increasing_id()), f"{new_folder(spark, 'index')}/rows")
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_count"))
    # a row a partition: their number is bounded by the shuffle setting, not by the data
    before = counts.select("_part", F.coalesce(F.sum("_count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_place") - F.shiftleft("_part", 33) + F.col("_before")).drop("_part", "_place", "_before")


def numbered_within(rows: DataFrame, group: list[str], order: list[str], name: str, first: int = 1) -> DataFrame:
    """Rows numbered from `first` in each group, in order. A group may be larger than a task: it is numbered along with all rows, and its first number taken off."""
    numbered = dense_index(rows, [*group, *order], "_index")
    starts = numbered.groupBy(*group).agg(F.min("_index").alias("_start"))
    # one row a group on this side, so a large group's rows can be split
    return numbered.join(starts.hint("merge"), group).withColumn(name, F.col("_index") - F.col("_start") + first).drop("_index", "_start")


def outcome(prepared: Column, self_check: Column, n_cards: Column, n_revised: Column, accepted: Column, repaired_: Column, error: Column) -> Column:
    """struct(status, rejection_stage) of a group, from what its stages gave (null: the stage did not run)."""

    def of(status: str, stage: str | None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(stage).cast("string").alias("rejection_stage"))

    return (
        F.when(error.isNotNull(), of("error", None))
        .when(~F.coalesce(prepared, F.lit(False)), of("rejected", "source_preparation"))
        .when(~F.coalesce(self_check, F.lit(False)), of("rejected", "self_check"))
        .when(F.coalesce(n_cards, F.lit(0)) == 0, of("rejected", "empty_extraction"))
        .when(repaired_ & (F.coalesce(n_revised, F.lit(0)) == 0), of("rejected", "card_repair"))
        .when(F.coalesce(accepted, F.lit(False)), of("accepted", None))
        .when(repaired_, of("rejected", "repair_review"))
        .otherwise(of("rejected", "card_review"))
    )


def progress(outcomes: DataFrame) -> DataFrame:
    """One row: groups and how many of each status."""
    return outcomes.agg(
        F.count("*").alias("groups"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "error").alias("errors")
    )


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """One row: the number of rows and a sum of their hashes, whatever their order."""
    return rows.agg(*fingerprint(rows.columns))
