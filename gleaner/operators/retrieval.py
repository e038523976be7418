"""Using a bank: nearest cards of a subject, controls for ablations, and accuracy tables."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.operators.export import numbered_within


#: Bytes of query vectors that are compared with the cards at once, and so broadcast; more queries are more passes.
QUERIES_AT_ONCE = 64 << 20
#: By how much a cosine of a matrix product may differ from that of an exact sum.
SLACK = 1e-9


def _exact(products: np.ndarray) -> np.ndarray:
    """Sums along the last axis from left to right, whatever stands beside."""
    return np.cumsum(products, axis=-1)[..., -1] if products.shape[-1] else np.zeros(products.shape[:-1])


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors in double, by length: those that are neither null nor zero, and hold finite numbers only."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    whole = np.ones(len(size), bool)
    if values.null_count:
        whole[np.repeat(np.arange(len(size)), size)[~values.is_valid().to_numpy(zero_copy_only=False)]] = False
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = np.cumsum(size) - size
    for n in np.unique(size[whole & (size > 0)]):
        rows = np.flatnonzero(whole & (size == n))
        found = flat[at[rows][:, None] + np.arange(n)]
        some = (found != 0).any(1) & np.isfinite(found).all(1)
        yield rows[some], found[some]


class _Best:
    """The k nearest cards of each query among those a task has seen, and any that rounding can't tell from the last of them."""

    def __init__(self, queries: pa.Table, k: int, by_subject: bool):
        self.k, self.by_subject = k, by_subject
        subjects = queries.column("subject").to_pylist() if by_subject else [None] * queries.num_rows
        #: By subject and length of vector: rows of queries, their vectors, and their norms.
        self.blocks: dict[tuple, tuple] = {}
        for rows, vectors in _vectors(queries.column("vector")):
            own = np.array([subjects[i] for i in rows], object)
            for subject in set(own.tolist()) - ({None} if by_subject else set()):
                mine = np.array([x == subject for x in own]) if by_subject else np.ones(len(rows), bool)
                self.blocks[subject, vectors.shape[1]] = rows[mine], vectors[mine], np.sqrt(_exact(vectors[mine] * vectors[mine]))
        n = queries.num_rows
        self.held: list[tuple[list, list]] = [([], []) for _ in range(n)]

    def see(self, ids: list, subjects: list, column: pa.Array) -> None:
        for rows, vectors in _vectors(column):
            norms = np.sqrt(_exact(vectors * vectors))
            places: dict = {}
            if self.by_subject:
                for i, row in enumerate(rows.tolist()):
                    places.setdefault(subjects[row], []).append(i)
            else:
                places[None] = range(len(rows))
            for subject, mine in places.items():
                if (subject, vectors.shape[1]) not in self.blocks:
                    continue
                mine = np.asarray(mine)
                queries, theirs, q_norms = self.blocks[subject, vectors.shape[1]]
                near = theirs @ vectors[mine].T / (q_norms[:, None] * norms[mine])
                for j, q in enumerate(queries.tolist()):
                    line = near[j]
                    least = np.partition(line, -self.k)[-self.k] if len(line) > self.k else -np.inf
                    if len(self.held[q][0]) == self.k:
                        least = max(least, self.held[q][0][-1])
                    took = mine[line >= least - SLACK]
                    if len(took):
                        cosine = _exact(theirs[j] * vectors[took]) / (q_norms[j] * norms[took])
                        self.add(q, cosine.tolist(), [ids[rows[t]] for t in took])

    def add(self, query: int, cosines: list, cards: list) -> None:
        held, names = self.held[query]
        best = heapq.nsmallest(self.k, zip([-c for c in [*held, *cosines]], [*names, *cards]))
        self.held[query] = [-c for c, _ in best], [x for _, x in best]


def nearest(queries: DataFrame, cards: DataFrame, k: int = 5, by_subject: bool = True, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, card_id, cosine, rank): the k cards of highest cosine, ties by card_id, of the query's subject where by_subject.

    queries(query_id, subject, vector), cards(card_id, subject, vector); one id
    may stand in one row, rows without id are left out. Vectors that are null or
    zero, or hold null or no finite number, are near nothing, and neither are
    vectors of different lengths, or without a subject where that counts. Cards stay where they are read: every task multiplies its
    batches with the queries and keeps k cards a query, so a large subject is
    many tasks' work, and at most k rows a query and task are shuffled. Queries
    are few against the cards; they are broadcast in passes of at most `at_once` bytes.
    """
    spark = cards.sparkSession
    asked = queries.select("query_id", "subject", "vector").where("query_id is not null")
    size = asked.agg(F.sum(F.lit(32) + 8 * F.size("vector"))).first()[0] or 0
    passes = max(1, -(-size // at_once))
    dealt = asked.withColumn("_pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, card_id {cards.schema['card_id'].dataType.simpleString()}, cosine double"

    def compared(number: int) -> DataFrame:
        some = spark.sparkContext.broadcast(dealt.where(F.col("_pass") == number).drop("_pass").toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(some.value, k, by_subject)
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    best.see(part.column(0).to_pylist(), part.column(1).to_pylist() if by_subject else [], part.column(2))
            n = [len(c) for c, _ in best.held]
            names = some.value.column("query_id").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([x for _, own in best.held for x in own], kind), pa.array([c for own, _ in best.held for c in own], pa.float64())], names=["query_id", "card_id", "cosine"]
            )

        return cards.select("card_id", "subject", "vector").where("card_id is not null").mapInArrow(run, schema)

    kind = to_arrow_type(cards.schema["card_id"].dataType)
    found = reduce(DataFrame.unionByName, [compared(i) for i in range(passes)])
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "card_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Strides of draws (fixed values): primes above any subject's number of cards, so that none divides it.
STRIDES = (2305843009213693951, 2305843009213693921, 2305843009213693907, 2305843009213693723)


def _number(c: Column) -> Column:
    """Sixty bits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("bigint")


def replaced_at_random(found: DataFrame, cards: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """found(query_id, subject, rank, card_id) with the first `share` of ranks replaced by other cards of the subject: (query_id, subject, rank, card_id, replaced).

    The cards of a subject are numbered. A query walks through the numbers by a
    stride and from a start of its own, both from the seed; the stride is prime
    and above their number, so the walk meets each card once. Cards that the
    query holds already, replaced ones too, are walked past, so none is drawn
    twice. A walk of as many steps as a query has ranks to replace and cards is
    long enough; where the subject has too few cards, the last ranks keep theirs.
    """
    numbered = numbered_within(cards.select("subject", "card_id").distinct(), ["subject"], ["card_id"], "number", first=0)
    sizes = numbered.groupBy("subject").agg(F.count("*").alias("size"))
    # at most as many ranks as were asked for
    held = found.groupBy("query_id", "subject").agg(F.max("rank").alias("depth"), F.collect_set("card_id").alias("held")).join(sizes.hint("merge"), "subject")
    swaps = F.least(F.ceil(F.lit(share) * F.col("depth")), F.col("depth")).cast("bigint")
    text = F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"))
    stride = F.get(F.array(*[F.lit(x) for x in STRIDES]), F.pmod(_number(F.concat(text, F.lit("|stride"))), F.lit(len(STRIDES))).cast("int"))
    walks = held.withColumns({"swaps": swaps, "stride": F.pmod(stride, F.col("size")), "start": F.pmod(_number(text), F.col("size"))}).where("swaps > 0")
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("swaps") + F.size("held")) - 1))
    # below 2**63 for subjects of up to 3e9 cards, however far a walk goes
    walks = walks.withColumn("step", steps).withColumn("number", F.pmod(F.col("start") + F.pmod(F.col("step"), F.col("size")) * F.col("stride"), F.col("size")))
    met = walks.join(numbered.withColumnRenamed("card_id", "other_id").hint("merge"), ["subject", "number"]).where(~F.array_contains("held", F.col("other_id")))
    drawn = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("step"))).where(F.col("rank") <= F.col("swaps"))
    drawn = drawn.select("query_id", F.col("rank").cast(found.schema["rank"].dataType).alias("rank"), "other_id")
    out = found.join(drawn.hint("merge"), ["query_id", "rank"], "left")
    return out.select("query_id", "subject", "rank", F.coalesce("other_id", "card_id").alias("card_id"), F.col("other_id").isNotNull().alias("replaced"))


def evidence_text(card_text: Column, passages: Column, card_limit: int = 4000, passage_limit: int = 1200) -> Column:
    """What a prompt shows of a card: passages cut to their limit, joined after the card, the whole cut to the card's limit."""
    parts = F.transform(passages, lambda p: F.substring(p, 1, passage_limit))
    return F.substring(F.concat_ws("\n", F.array(card_text), parts), 1, card_limit)


def lexical_rerank(pairs: DataFrame, k: int = 5) -> DataFrame:
    """pairs(query_id, query_text, card_id, card_text, rank) cut to the k cards that share most of the query's distinct words; ties by rank."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))

    share = F.size(F.array_intersect(words(F.col("query_text")), words(F.col("card_text")))) / F.greatest(F.size(words(F.col("query_text"))), F.lit(1))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "card_id")
    return pairs.withColumn("overlap", share).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def accuracy(answers: DataFrame, *dimensions: str) -> DataFrame:
    """Micro-averaged accuracy over every combination of the dimensions; an invalid (null) answer counts as wrong."""
    right = F.coalesce(F.col("answer") == F.col("expected"), F.lit(False)).cast("int")
    grouped = answers.withColumn("_right", right).cube(*dimensions)
    return grouped.agg(F.count("*").alias("items"), F.sum("_right").alias("correct"), (F.sum("_right") / F.count("*")).alias("accuracy"), F.grouping_id().cast("bigint").alias("grouping"))
