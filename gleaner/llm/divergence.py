"""Source divergence audit: which sources of a language use its words unlike the others, and by which words.

Every (lang, source) group gives each kept term of its language the integer
share p = 1 + floor(10**9 * (count + 1) / (N + V)). Two groups are priced
against one another by the sum of floor((p - q)**2 / q) over all kept terms.
The terms of a language are dealt to blocks by hash; in a block, terms have
ids, every group is a segment tree over them, and trees are hash-consed: equal
subtrees of counts, of one group or of several, are one node. Two trees are
walked together from their roots, level by level; equal pairs of nodes are
merged with their number, so each is priced once. The sums of the blocks add up
to the price of the whole trees.

Words are counted in each Arrow batch before anything is shuffled, so a hot
source or word costs a row a batch. A block holds bounded numbers of rows and
of tree leaves, whatever the language's size.

Defined results: null text, lang and source are ''; a group without terms
has the smallest shares; a language without kept terms has pairs of value 0; a
source alone in its language has no pairs; repeated rows count each; other
columns are ignored; an empty table gives no rows. Counts are exact up to 9e15
words a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Stages, pieces, table, trimmed, utf8

SCALE = 1_000_000_000
#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 3
#: Bounds of a block: rows, leaves of all its trees together, and left-hand groups walked by one task.
BLOCK_ROWS, BLOCK_LEAVES, STRIPE = 400_000, 4_000_000, 64
#: Groups whose totals are broadcast; beyond, they are joined by sorting.
SMALL = 100_000
#: Each byte of a term, and a space for all others: letters, A-Z lower-cased, and what isn't ASCII.
FOLD = np.full(256, 32, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a batch of (lang, source, text)."""
    data, at = utf8(batch.column(2))
    folded = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(FOLD[data]))
    lists = pc.ascii_split_whitespace(folded)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    n_terms = len(coded.dictionary)
    rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    filled = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    if n_terms:
        keep = filled[codes]
        codes, rows = codes[keep], rows[keep]
    langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
    n_sources = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    in_doc, times = np.unique(rows * max(1, n_terms) + codes, return_counts=True)
    keys, which = np.unique(group[in_doc // max(1, n_terms)] * max(1, n_terms) + in_doc % max(1, n_terms), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, which, times)
    g = keys // max(1, n_terms)
    return pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(g // n_sources)),
            sources.dictionary.take(pa.array(g % n_sources)),
            coded.dictionary.take(pa.array(keys % max(1, n_terms))).cast(pa.string()),
            pa.array(n),
            pa.array(np.bincount(which, minlength=len(keys)).astype(np.int64)),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 22):
                yield _counted(batch)

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = texts.mapInArrow(trimmed(run), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", top, (total + terms).cast("decimal(19,0)")) + 1


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same as share() on arrays: nine digits by long division, three at a time, so that nothing leaves 64 bits."""
    digits, rest = np.divmod(n + 1, below)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, below)
        digits = digits * 1000 + step
    return digits + 1


class Forest:
    """Hash-consed segment trees over the columns of a matrix of counts, one tree a row."""

    PAD = -1

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, (counts.shape[1] - 1).bit_length())
        padded = np.full((counts.shape[0], width), self.PAD, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, ids = np.unique(padded, return_inverse=True)
        ids = ids.reshape(padded.shape)
        #: From the leaves up: the left and the right child of each node of a level.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            below = int(ids.max()) + 1
            nodes, inverse = np.unique(ids[:, ::2] * below + ids[:, 1::2], return_inverse=True)
            ids = inverse.reshape(ids.shape[0], -1)
            self.levels.append((nodes // below, nodes % below))
        self.roots = ids[:, 0]

    def pairs(self, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaf pairs of a tree with every tree, each once: the other tree, both counts, and how often they meet."""
        other = np.arange(len(self.roots))
        u, v, times = np.full(len(other), self.roots[left]), self.roots, np.ones(len(other), np.int64)
        for a, b in reversed(self.levels):
            other, u, v, times = np.tile(other, 2), np.concatenate([a[u], b[u]]), np.concatenate([a[v], b[v]]), np.tile(times, 2)
            size = int(max(u.max(), v.max())) + 1
            key, inverse = np.unique((other * size + u) * size + v, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, inverse, times)
            other, u, v, times = key // (size * size), key // size % size, key % size, total
        return other, self.leaves[u], self.leaves[v], times

    def prices(self, left: int, below: np.ndarray) -> np.ndarray:
        """Sum of floor((p - q)**2 / q) of a tree, p, against every tree, q. below: N + V of each tree."""
        other, mine, theirs, times = self.pairs(left)
        real = mine != self.PAD
        other, mine, theirs, times = other[real], mine[real], theirs[real], times[real]
        p, q = shares(mine, below[left]), shares(theirs, below[other])
        out = np.zeros(len(self.roots), np.int64)
        np.add.at(out, other, (p - q) * (p - q) // q * times)
        return out


def _walked(rows: pa.Table) -> pa.Table:
    """(lang, source, item, value) of a block of (lang, block, stripe, source, term, n, total, terms); rows without term only name a group."""
    sources = rows.column("source").combine_chunks().dictionary_encode()
    order = pc.sort_indices(sources.dictionary).to_numpy()
    names = sources.dictionary.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    group = place[sources.indices.to_numpy()]
    below = np.zeros(len(names), np.int64)
    below[group] = rows.column("total").to_numpy() + rows.column("terms").to_numpy()
    named = rows.column("term").combine_chunks()
    real = named.is_valid().to_numpy(zero_copy_only=False)
    ids = named.filter(pa.array(real)).dictionary_encode()
    n = rows.column("n").to_numpy()[real]
    # ids by falling count: the rare terms, most of whose counts are 0 in most groups, stand side by side
    overall = np.zeros(len(ids.dictionary), np.int64)
    np.add.at(overall, ids.indices.to_numpy(), n)
    rank = np.empty(len(overall), np.int64)
    rank[np.argsort(-overall, kind="stable")] = np.arange(len(overall))
    counts = np.zeros((len(names), len(overall)), np.int64)
    counts[group[real], rank[ids.indices.to_numpy()]] = n
    forest = Forest(counts) if len(overall) else None
    stripe = rows.column("stripe")[0].as_py()
    mine = [i for i in range(len(names)) if stripe * STRIPE <= i < (stripe + 1) * STRIPE]
    value = [forest.prices(i, below) if forest else np.zeros(len(names), np.int64) for i in mine]
    left = np.repeat(np.array(mine, np.int64), len(names))
    right = np.tile(np.arange(len(names)), len(mine))
    keep = left != right
    columns = [pa.repeat(rows.column("lang")[0], int(keep.sum())), names.take(pa.array(left[keep])), names.take(pa.array(right[keep])), pa.array(np.concatenate([*value, np.empty(0, np.int64)])[keep])]
    return pa.table(columns, names=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, top: int = 200, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' for every other source of the language, part 'term' for the `top` terms that a source overuses."""
    spark = docs.sparkSession
    stages = Stages(spark, "divergence")
    counts = stages.put(term_counts(docs), "counts")
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
    kept = stages.put(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    stages.drop("counts")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("nth") == 1).alias("firsts"))
    of_lang = Window.partitionBy("lang")
    totals = groups.join(sums.hint("merge"), ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    totals = totals.withColumns({"terms": F.sum("firsts").over(of_lang), "total_lang": F.sum("total").over(of_lang), "groups": F.count("*").over(of_lang)}).drop("firsts")
    totals = stages.put(totals, "totals")

    size = totals.agg(F.count("*"), F.coalesce(F.max(F.col("groups") * F.col("terms")), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    blocks = max(8, -(-kept.count() // BLOCK_ROWS), -(-size[1] // BLOCK_LEAVES))
    known = totals.hint("broadcast" if size[0] <= SMALL else "merge")
    stripes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("groups") / STRIPE).cast("int") - 1))
    leaves = kept.join(known, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), stripes.alias("stripe"), "source", "term", "n", "total", "terms")
    named = totals.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    named = named.select("lang", "block", stripes.alias("stripe"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "terms")
    # few bytes and much work: as many tasks as there may be, not as few as the bytes need
    dealt = leaves.unionByName(named).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "block", "stripe")
    walked = dealt.groupBy("lang", "block", "stripe").applyInArrow(_walked, "lang string, source string, item string, value long")
    pairs = walked.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    over = kept.join(known, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))})
    over = over.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= top))


def op11_source_divergence(spark, sf_dir) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct id) >= 3),
langs as (select d.lang, coalesce(v, 0) as v, coalesce(total, 0) as total from (select distinct lang from d) d left join (select lang, count(*) as v, sum(n) as total from kept group by lang) k on d.lang = k.lang),
counts as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term),
grps as (select g.lang, g.source, coalesce(t.total, 0) as total from (select distinct lang, source from d) g left join (select lang, source, sum(n) as total from counts group by lang, source) t on g.lang = t.lang and g.source = t.source),
shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total::hugeint + l.v) as p, 1 + (1000000000::hugeint * (k.n + 1)) // (l.total::hugeint + l.v) as q
  from grps g join langs l on g.lang = l.lang join kept k on g.lang = k.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pair as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(p.value, 0) as value from grps a join grps b on a.lang = b.lang and a.source <> b.source left join pair p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from shares where n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 200
"""
