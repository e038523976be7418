"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

Each of `tables` hash tables joins `functions` cross-polytope hashes: the
vector, padded to a power of two, goes through three rounds of random signs
and a fast Hadamard transform, and the hash is the coordinate of the largest
magnitude with its sign. Multiprobe: a vector also stands in the buckets where
one of the functions takes its second choice. Two vectors of one label and
length are candidates when they share a bucket; their cosine is then computed
in double precision, and pairs at or above the threshold link.

Equal vectors of a label are one representative with a count, so copies make
no pairs. A pair is counted in the lowest bucket that both share, so links are
exact sums; large buckets are compared in blocks (see buckets.py). Defined
results: rows whose label or vector is null, or whose vector is empty, zero or
holds nulls or non-finite values, link with nothing; rows that share a vec_id
are that many vectors, equal or not; a vector without vec_id links like any
other, and its component goes by the smallest vec_id there is in it, or null;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.buckets import column_values, dealt, each_group, local_components
from gleaner.llm.common import Stages, table, trimmed
from gleaner.llm.components import components


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (of a power of two values), unscaled."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def bucket_codes(x: np.ndarray, tables: int, functions: int, seed: int) -> np.ndarray:
    """Codes of the buckets of each row: tables * (1 + functions) of them, of 64 bits with the table in the high ones."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, width])
    codes = []
    for t in range(tables):
        first, second = [], []
        for _ in range(functions):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
                y /= np.sqrt(width)
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            rank = np.take_along_axis(np.abs(y), two, 1)
            two = np.where((rank[:, :1] < rank[:, 1:]), two[:, ::-1], two)
            choice = 2 * two + (np.take_along_axis(y, two, 1) < 0)
            first.append(choice[:, 0])
            second.append(choice[:, 1])
        for probe in range(-1, functions):
            code = np.full(n, t, np.int64)
            for f in range(functions):
                code = (code * (2 * width) + (second if f == probe else first)[f]) % (1 << 56)
            codes.append(code | (np.int64(t) << np.int64(56)))
    return np.stack(codes, axis=1)


def usable(vector: str = "embedding"):
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def near_vectors(rows: DataFrame, threshold: float = 0.93, tables: int = 10, functions: int = 3, block: int = 1024, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of (vec_id, embedding, label)."""
    stages = Stages(rows.sparkSession, "embedding")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = F.coalesce(usable(), F.lit(False))
    vectors = stages.put(rows.select("*", F.when(good, F.xxhash64("label", "embedding")).alias("digest"), good.alias("good")), "vectors")
    reps = vectors.where("good").groupBy("digest", "label", "embedding").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies"))
    # a distinct vector goes by a number of its own: several may share a vec_id, or have none
    reps = stages.put(reps.select(F.monotonically_increasing_id().alias("rep"), "lowest", "copies", "embedding", F.xxhash64("label", F.size("embedding")).alias("kind")), "reps")

    def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                codes = bucket_codes(column_values(part.column(2)), tables, functions, seed)
                for k in range(0, len(at), 2000):
                    c = codes[k : k + 2000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel()))
                    rest = part.slice(k, len(c))
                    yield pa.RecordBatch.from_arrays([rest.column(i) for i in range(4)] + [lists], names=["rep", "copies", "embedding", "kind", "codes"])

    coded = stages.put(reps.select("rep", "copies", "embedding", "kind").mapInArrow(trimmed(code_rows), "rep long, copies long, embedding array<double>, kind long, codes array<long>"), "coded")
    # buckets first by ids alone; vectors join only those that share one
    placed = coded.select("rep", "kind", F.explode("codes").alias("code"))
    spread = stages.put(dealt(placed, ["kind", "code"], "rep", block), "spread")
    full = spread.join(coded.select("rep", "copies", "embedding", "codes").hint("merge"), "rep")

    def work(group: pa.Table) -> dict[str, np.ndarray] | None:
        rep, copies, x, codes, own = (column_values(group.column(c).chunk(0)) for c in ("rep", "copies", "embedding", "codes", "own"))
        bi, bj, code = (group.column(c)[0].as_py() for c in ("bi", "bj", "code"))
        x = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
        at, to = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        if not len(at) or not len(to):
            return None
        link = x[at] @ x[to].T >= threshold
        link &= at[:, None] != to[None, :]
        if not link.any():
            return None
        a, b = np.nonzero(link)
        label = local_components(len(rep), at[a], to[b])
        # a pair counts in the lowest bucket that both share: codes of one table stand together
        first, second = at[a], to[b]
        for k in range(0, len(a), 8192):
            x, y = (codes[side[k : k + 8192]].reshape(-1, tables, 1 + functions) for side in (first, second))
            shared = ((x[:, :, :, None] == y[:, :, None, :]) & (x[:, :, :, None] < code)).any((1, 2, 3))
            link[a[k : k + 8192][shared], b[k : k + 8192][shared]] = False
        links = np.zeros(len(rep), np.int64)
        links[at] += link @ copies[to]
        if bi != bj:
            links[to] += link.T @ copies[at]
        return {"rep": rep, "links": links, "low": rep[label]}

    found = stages.put(each_group(full, ["kind", "code", "bi", "bj"], work, "rep long, links long, low long"), "links")
    joined = components(found.where("low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b")), stages)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    in_components = stages.put(reps.select("rep", "lowest", "copies").join(joined.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    names = in_components.groupBy("component").agg(F.min("lowest").alias("component_id"))
    classes = (
        in_components.join(links.hint("merge"), "rep", "left").join(names.hint("merge"), "component")
        .select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    members = reps.select("rep", "embedding", "kind").join(classes.hint("merge"), "rep").select(F.xxhash64("kind", "embedding").alias("digest"), "kind", "embedding", "n_links", "component_id")
    keyed = vectors.select("vec_id", "embedding", F.when(F.col("good"), F.xxhash64("label", F.size("embedding"))).alias("kind"))
    keyed = keyed.withColumn("digest", F.when(F.col("kind").isNotNull(), F.xxhash64("kind", "embedding")))
    out = keyed.join(members.hint("merge"), ["digest", "kind", "embedding"], "left")
    # a vector that links with nothing is its own component; one whose component has no vec_id at all has none either
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op2_embedding_dedup(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP2_SQL = """
with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
good as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0),
pair as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach as (with recursive r(id, low) as (select a, least(a, b) from pair union select p.a, r.low from r join pair p on p.b = r.id) select id, min(low) as low from r group by id),
n as (select a as id, count(*) as n from pair group by a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(least(reach.low, v.vec_id), v.vec_id) as component_id, coalesce(least(reach.low, v.vec_id), v.vec_id) = v.vec_id as kept
from v left join n on n.id = v.vec_id left join reach on reach.id = v.vec_id
"""
