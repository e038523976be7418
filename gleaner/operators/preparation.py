"""Source preparation: quality flags, cue scores, same-article evidence, priority and budgeted selection.

Tables: seeds(group_id, pos, source_id, passage_id, title, text), one row per
given passage; corpus(article_id, passage_id, title, text), a DataFrame or a
ClusteredCorpus (sources/clustered.py). Candidates carry a text's length and
digest, not the text: a passage is offered to every group of its article, and
most are not taken. Texts are fetched for what was selected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.records import MAX_GROUP, MAX_PASSAGE
from gleaner.functions.text import article_of, strip
from gleaner.sources.clustered import ClusteredCorpus

# What marks a passage whose formula was lost, and the cue words.
LOST_FORMULA = (
    r"\b(?:requirement|complexity|cost)\s+(?:of\s*)?[,.;)]",
    r"\b(?:real|complex) number\s+[,;]",
    r"\bif\s+is\s+(?:a |positive|negative)",
    r"\bfor\s+and\s+(?:real|complex)",
    r"\b(?:defined|given|expressed) as:\s*\n\s*(?:This|The|In|For)\b",
)
#: Of each pattern, what any match of it must hold: one of each group. Looking for these first is far cheaper than a pattern.
LOST_FORMULA_HOLDS = ((("requirement", "complexity", "cost"),), ((" number",),), (("if",), ("is",)), (("for",), ("and",)), ((" as:",),))
USAGE_CUES = "calculate calculated divide multiply sum total ratio procedure steps compute if when using therefore implies example".split()
BOUNDARY_CUES = "unless except exception only not cannot however limitation assumption instead requires unlike".split()
SHORT = 80
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFD}]"


@dataclass(frozen=True)
class Limits:
    """Bounds of a preparation run."""

    passages: int = 5
    candidates: int = 64
    characters: int = MAX_GROUP

    def __post_init__(self):
        if not 1 <= self.passages <= 5 or not 1 <= self.candidates <= 256:
            raise ValueError("passages must be 1 to 5 and candidates 1 to 256")


def quality_issues(text: Column, title: Column) -> Column:
    """array<string> of signs of damage; a passage over the length limit has that issue alone."""

    def of(checked: Column) -> Column:
        found = [
            F.when(F.length(checked) < SHORT, F.lit("too_short")),
            F.when(checked.rlike(CONTROL), F.lit("damaged_encoding")),
            F.when(F.contains(F.lower(title), F.lit("(disambiguation)")), F.lit("disambiguation")),
        ]
        for pattern, groups in zip(LOST_FORMULA, LOST_FORMULA_HOLDS):
            may = reduce(and_, [reduce(or_, [F.contains(checked, F.lit(w)) for w in words]) for words in groups])
            found.append(F.when(may & checked.rlike(pattern), F.concat(F.lit("missing_formula: "), F.regexp_extract(checked, pattern, 0))))
        return F.array_compact(F.array(*found))

    # the stripped text is bound to a variable, so that it is worked out once
    checked = F.get(F.transform(F.array(strip(text)), of), F.lit(0))
    return F.when(F.length(text) > MAX_PASSAGE, F.array(F.lit("too_long"))).otherwise(checked)


def cue_count(text: Column, cues: list[str]) -> Column:
    """How many of the cue words stand in the text's first characters."""
    words = F.split(F.lower(F.substring(text, 1, MAX_PASSAGE)), r"[^\p{L}\p{N}_]+")
    return F.size(F.array_intersect(words, F.array(*[F.lit(c) for c in cues])))


SCORES = ("issues", "usage_cues", "boundary_cues", "usable", "length", "text_sha256")


def scored(passages: DataFrame) -> DataFrame:
    """With issues, usable, usage_cues, boundary_cues, length and text_sha256; where all of them are there, as they are."""
    if set(SCORES) <= set(passages.columns):
        return passages
    return passages.withColumns(
        {
            "issues": quality_issues(F.col("text"), F.coalesce("title", F.lit(""))),
            "usage_cues": cue_count(F.col("text"), USAGE_CUES),
            "boundary_cues": cue_count(F.col("text"), BOUNDARY_CUES),
            "length": F.length("text"),
            "text_sha256": F.sha2("text", 256),
        }
    ).withColumn("usable", F.size("issues") == 0)


def _rows(corpus: DataFrame | ClusteredCorpus) -> DataFrame:
    return corpus.by_passage() if isinstance(corpus, ClusteredCorpus) else corpus


def article_stats(corpus: DataFrame | ClusteredCorpus, cap: int) -> DataFrame:
    """(article_id, available, fetched, truncated)."""
    n = corpus.sizes() if isinstance(corpus, ClusteredCorpus) else corpus.groupBy("article_id").agg(F.count("*").alias("available"))
    return n.withColumns({"fetched": F.least("available", F.lit(cap).cast("bigint")), "truncated": F.col("available") > cap})


def seed_errors(seeds: DataFrame, corpus: DataFrame | ClusteredCorpus, prefix: str) -> DataFrame:
    """seeds with error: why a seed does not stand in the corpus as given, or null."""
    known = _rows(corpus).select("passage_id", F.sha2("text", 256).alias("corpus_text") if "text_sha256" not in _rows(corpus).columns else F.col("text_sha256").alias("corpus_text"), F.col("title").alias("corpus_title"))
    titled = F.length(F.coalesce("title", F.lit(""))) > 0
    error = (
        F.when(~F.col("passage_id").rlike("^[0-9]+#[0-9]+$"), F.lit("passage_id is not article#passage"))
        .when(F.col("source_id") != F.concat(F.lit(prefix), F.col("passage_id")), F.lit("source_id does not match the corpus prefix"))
        .when(F.col("corpus_text").isNull(), F.lit("passage not found in the corpus"))
        .when((F.col("corpus_text") != F.col("_said")) | (titled & (F.col("corpus_title") != F.col("title"))), F.lit("passage differs from the corpus"))
    )
    # a seed's digest is taken before the join: its text travels only if it is asked for
    return seeds.withColumn("_said", F.sha2("text", 256)).join(known.hint("merge"), "passage_id", "left").withColumn("error", error).drop("corpus_text", "corpus_title", "_said")


def article_candidates(seeds: DataFrame, corpus: DataFrame | ClusteredCorpus, prefix: str, cap: int) -> DataFrame:
    """Seeds and the first `cap` passages, by id as a string, of every article that a group's seeds come from; each once per group.

    (group_id, source_id, passage_id, is_seed), and what scored() adds where
    both tables have it: then each passage is scored once, however many groups
    it is offered to. The cap is taken within the corpus before the join, so
    groups of one article share the work; a clustered corpus has taken it.
    """
    if isinstance(corpus, ClusteredCorpus):
        first = corpus.first(cap)
    else:
        order = Window.partitionBy("article_id").orderBy("passage_id")
        first = corpus.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    more = [c for c in SCORES if c in seeds.columns and c in first.columns]
    # a group's own ids, at most as many as its passages, travel with its articles: what the join gives is filtered where it is, not moved
    wanted = seeds.groupBy("group_id").agg(F.collect_set(article_of(F.col("passage_id"))).alias("articles"), F.collect_set("passage_id").alias("given"))
    wanted = wanted.select("group_id", "given", F.explode("articles").alias("article_id"))
    offered = F.coalesce(~F.array_contains("given", F.col("passage_id")), F.lit(True))
    extra = wanted.join(first.select("article_id", "passage_id", *more).hint("merge"), "article_id").where(offered).select("group_id", F.concat(F.lit(prefix), F.col("passage_id")).alias("source_id"), "passage_id", *more)
    own = seeds.select("group_id", "source_id", "passage_id", *more)
    return own.withColumn("is_seed", F.lit(True)).unionByName(extra.withColumn("is_seed", F.lit(False)))


def supplied_candidates(seeds: DataFrame) -> DataFrame:
    """The mode without a corpus: the seeds alone."""
    return seeds.select("group_id", "source_id", "passage_id", F.lit(True).alias("is_seed"), *[c for c in SCORES if c in seeds.columns])


def missing_seeds(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Seeds that are not among the candidates of their group."""
    return seeds.join(candidates.hint("merge"), ["group_id", "source_id", "passage_id"], "left_anti")


def repeated_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("group_id", "source_id", "passage_id").agg(F.count("*").alias("n")).where("n > 1")


def rank_keys() -> list[Column]:
    """Seeds first, then more cues (boundary cues count twice), then passage_id."""
    return [(~F.col("is_seed")).cast("int"), -(F.col("usage_cues") + 2 * F.col("boundary_cues")), F.col("passage_id"), F.col("source_id")]


def ranked(candidates: DataFrame) -> DataFrame:
    """Usable candidates with their rank in the group."""
    return candidates.where("usable").withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*rank_keys())))


def selection(candidates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Scored candidates with selected and note.

    In rank order a text equal to a selected one is a duplicate_text; one that
    would break the budget of passages or characters is skipped
    (evidence_budget) without ending the selection. What is folded is a rank, a
    digest and a length; the state holds at most as many digests as passages
    may be selected, and every note follows from it: a text that is equal to
    one selected before it is a duplicate, and what was full stays full.
    """
    keys = [(~F.col("usable")).cast("int"), *rank_keys()]
    carried = [c for c in candidates.columns if c != "group_id"]
    item = F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], *carried)
    groups = candidates.groupBy("group_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    offered = F.filter(F.transform("items", lambda x, i: F.struct(i.alias("n"), x["text_sha256"].alias("digest"), x["length"].alias("length"), x["usable"].alias("usable"))), lambda x: x["usable"] & (x["length"] <= limits.characters))
    state = F.struct(F.expr("cast(array() as array<struct<n:int,digest:string>>)").alias("kept"), F.lit(0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) < limits.passages) & (acc["total"] + x["length"] <= limits.characters)
        take = fits & ~F.exists(acc["kept"], lambda k: k["digest"] == x["digest"])
        more = F.struct(F.array_append(acc["kept"], F.struct(x["n"].alias("n"), x["digest"].alias("digest"))).alias("kept"), (acc["total"] + x["length"]).alias("total"))
        return F.when(take, more).otherwise(acc)

    folded = groups.withColumn("kept", F.aggregate(offered, state, step, lambda acc: acc["kept"]))
    rows = folded.select("group_id", "kept", F.posexplode("items").alias("n", "x"))
    same = F.filter("kept", lambda k: k["digest"] == F.col("x.text_sha256"))
    first = F.get(same, F.lit(0))["n"]
    note = F.when(~F.col("x.usable"), F.lit(None)).when(first == F.col("n"), F.lit("selected")).when(first < F.col("n"), F.lit("duplicate_text")).otherwise(F.lit("evidence_budget"))
    out = rows.select("group_id", *[F.col(f"x.{c}").alias(c) for c in carried], note.alias("_note"))
    return out.select(*candidates.columns, F.coalesce(F.col("_note") == "selected", F.lit(False)).alias("selected"), F.when(F.col("_note") != "selected", F.col("_note")).alias("note"))


def preparation_summary(selected: DataFrame) -> DataFrame:
    """One row per group of what was offered, filtered and selected."""
    bad = F.size("issues") > 0
    return selected.groupBy("group_id").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("is_seed") & bad).alias("filtered_seeds"),
        F.count_if(bad).alias("filtered_candidates"),
        F.count_if("selected").alias("selected_passages"),
        F.count_if(F.col("selected") & ~F.col("is_seed")).alias("supplementary_passages"),
    )


def prepared_groups(selected: DataFrame, seeds: DataFrame, corpus: DataFrame | ClusteredCorpus | None = None) -> DataFrame:
    """(group_id, passages): the selected passages in rank order, with their texts; groups without any are absent.

    A seed's text is its group's own, a further passage's the corpus's.
    """
    # the others do not change the order of those selected
    chosen = ranked(selected.where("selected")).select("group_id", "source_id", "passage_id", "is_seed", "text_sha256", "rank")

    def passage(x: Column) -> Column:
        return F.struct(x["source_id"].alias("source_id"), x["passage_id"].alias("passage_id"), F.coalesce(x["title"], F.lit("")).alias("title"), strip(x["text"]).alias("text"))

    # at most as many passages as a group and a selection may have; joined by group alone, so that texts laid out by group stay where they are
    given = seeds.groupBy("group_id").agg(F.collect_list(F.struct("source_id", "passage_id", "title", "text")).alias("given"))
    rows = chosen.groupBy("group_id").agg(F.collect_list(F.struct("rank", "source_id", "passage_id", "is_seed")).alias("chosen")).join(given.hint("merge"), "group_id", "left")
    own = lambda c: F.get(F.filter("given", lambda g: (g["source_id"] == c["source_id"]) & (g["passage_id"] == c["passage_id"])), F.lit(0))
    found = F.filter(F.transform(F.filter("chosen", lambda c: c["is_seed"]), lambda c: F.struct(c["rank"].alias("rank"), own(c).alias("p"))), lambda x: x["p"].isNotNull())
    rows = rows.select("group_id", F.transform(found, lambda x: F.struct(x["rank"].alias("rank"), passage(x["p"]).alias("p"))).alias("x"))
    if corpus is not None:
        known = _rows(corpus).select("passage_id", F.col("title"), F.col("text"))
        further = chosen.where("not is_seed").join(known.hint("merge"), "passage_id").select("group_id", "rank", F.struct("source_id", "passage_id", "title", "text").alias("p"))
        further = further.groupBy("group_id").agg(F.collect_list(F.struct("rank", passage(F.col("p")).alias("p"))).alias("y"))
        rows = rows.join(further.hint("merge"), "group_id", "left").select("group_id", F.when(F.col("y").isNull(), F.col("x")).otherwise(F.concat("x", "y")).alias("x"))
    return rows.where(F.size("x") > 0).select("group_id", F.transform(F.sort_array("x"), lambda x: x["p"]).alias("passages"))
