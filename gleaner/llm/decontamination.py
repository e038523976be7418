"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A spaced seed is a fixed mask over consecutive tokens: the tokens under its
ones are hashed, those under its zeros are ignored, so a hit survives
substitutions there. The masks for each width of a window are lossless: however
a fifth of its tokens is substituted, one of them hits. Seeds of documents and of benchmark items join on their
hash; each hit fixes an alignment, and the alignment is verified: some window
of `window` aligned tokens (the whole item if it is shorter) must agree in at
least `similarity` of its places.

Tokens are the lower-cased runs of letters and digits. Defined results: null
and empty texts have no tokens and are clean; an item with fewer tokens
than `shortest` is ignored (one: none is but those without tokens); an item of
fewer than five tokens must stand there whole; repeated rows of a document give one row per item; rows without doc_id or item_id are
ignored; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, table

#: Masks for each width of a window. Every substitution of floor(width / 5) tokens leaves a hit (the tests try all).
#: From eight tokens they have weight five; shorter items have lighter ones, below five tokens one over the whole item.
MASKS = {width: ("1" * width,) for width in range(1, 5)} | {5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("111011", "110111"), 9: ("111011",), 10: ("111011", "1101011", "1110011")} | {width: ("111101", "110010011") for width in range(11, 21)}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed_tokens(rows: DataFrame, row_id: str) -> DataFrame:
    """(row_id, h): the hashes of each row's tokens."""
    return rows.where(F.col(row_id).isNotNull() & F.col("text").isNotNull()).select(row_id, F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))


def seeds(h: Column, masks: tuple[str, ...]) -> Column:
    """Array of (seed, at): the hash under each mask at each place; at counts from 1."""

    def under(mask: str) -> Column:
        ones = [i for i, x in enumerate(mask) if x == "1"]
        last = F.size(h) - len(mask) + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(places, lambda p: F.struct(F.xxhash64(*[F.get(h, p - 1 + i) for i in ones], F.lit(int(mask, 2))).alias("seed"), p.alias("at")))

    return F.concat(*[under(m) for m in masks])


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: dict[int, tuple[str, ...]] = MASKS, window: int = 20, similarity: float = 0.8, shortest: int = 1, few: int = 500_000) -> DataFrame:
    """(doc_id, item_id, matched, window): the best verified window of each document and item.

    An item is looked for with the masks of its width, min(window, tokens);
    documents get the masks of the widths that the benchmark has.
    The benchmark's seeds are a written table; they are counted, broadcast up
    to `few` of them and joined by sorting beyond. The ids of documents with
    hits are a written table too, which Spark broadcasts only where its real
    size is below the threshold.
    """
    if window not in masks or similarity < 0.8:
        raise ValueError("the masks find every leak only for windows that they list and a similarity of 0.8 or more")
    stages = Stages(docs.sparkSession, "decontamination")
    items = stages.put(hashed_tokens(benchmark, "item_id").where(F.size("h") >= max(1, shortest)), "items")
    width = F.least(F.lit(window), F.size("h"))
    present = sorted(r.width for r in items.select(width.alias("width")).distinct().collect())
    used = tuple(sorted({m for w in present for m in masks[w]})) or masks[window]
    none = F.expr("cast(array() as array<struct<seed: bigint, at: int>>)")
    by_width = F.coalesce(*[F.when(width == w, seeds(F.col("h"), masks[w])) for w in present], none)
    wanted = stages.put(items.select("item_id", F.explode(by_width).alias("s")).select("item_id", "s.seed", F.col("s.at").alias("item_at")).distinct(), "seeds")
    found = hashed_tokens(docs, "doc_id").select("doc_id", F.explode(seeds(F.col("h"), used)).alias("s")).select("doc_id", "s.seed", "s.at")
    hits = found.join(F.broadcast(wanted) if wanted.count() <= few else wanted.hint("merge"), "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = stages.put(hits, "hits")
    lined = hits.join(items, "item_id")
    whole = docs.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = lined.join(hashed_tokens(whole, "doc_id").withColumnRenamed("h", "d").hint("merge"), "doc_id")
    places = F.sequence(F.lit(1), F.size("h"))
    agree = F.filter(places, lambda p: F.get(F.col("d"), p + F.col("shift") - 1) == F.get(F.col("h"), p - 1))
    # a window holds at most `window` of the sorted agreeing places, so each place looks no further than that
    held = F.transform(F.col("agree"), lambda a, i: F.size(F.filter(F.slice(F.col("agree"), i + 1, window), lambda b: b < a + F.col("width"))))
    best = F.array_max(held)
    scored = pairs.select("doc_id", "item_id", agree.alias("agree"), width.alias("width")).select("doc_id", "item_id", best.alias("matched"), F.col("width").alias("window"))
    passed = scored.where(F.col("matched") >= F.ceil(F.lit(similarity) * F.col("window")))
    return passed.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window"))


def op9_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
with tok as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents),
d as (select doc_id, unnest(range(1, len(w) + 1)) as at, unnest(w) as word from tok),
itok as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark),
i as (select item_id, least(20, len(w)) as width, unnest(range(1, len(w) + 1)) as at, unnest(w) as word from itok),
hit as (select distinct doc_id, item_id, width, d.at - i.at as shift, i.at from d join i using (word)),
likely as (select doc_id, item_id, shift from hit group by all having count(*) >= 0.8 * min(width)),
fit as (select a.doc_id, a.item_id, a.width, a.shift, a.at, count(*) as m from hit a join hit b on a.doc_id = b.doc_id and a.item_id = b.item_id and a.shift = b.shift and b.at >= a.at and b.at < a.at + a.width
  semi join likely l on a.doc_id = l.doc_id and a.item_id = l.item_id and a.shift = l.shift group by all)
select doc_id, item_id, cast(max(m) as bigint) as matched, cast(max(width) as bigint) as window from fit where m >= ceil(0.8 * width) group by doc_id, item_id
"""
