"""SimHash near-dedup with pigeonring filtering.

Fingerprints are sums over the XXH64 hashes of word shingles. Two documents
link when their fingerprints differ in at most `distance` bits. By the
pigeonring principle some segment of the ring starts a chain in which the
first l segments differ in at most l * distance / segments bits, for every l;
with more segments than allowed differences the first segment is equal and the
first two together differ in few bits, with five segments and four differences
in one at most. So a bucket is a segment and the next one with one bit left
out, for each such bit; the rest of the chain prunes pairs within buckets.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; repeated rows and exact copies share one fingerprint; rows that
share a doc_id and differ are documents of their own, and may be in different
components, each of which goes by its smallest doc_id; a row
without doc_id founds no group and takes the component of its fingerprint, or
null; an empty table gives no rows; further columns of `docs` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.buckets import column_values, dealt, each_group, local_components
from gleaner.llm.common import Stages, trimmed
from gleaner.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: A bucket's number is its first segment times this, plus the number of its mask.
STEP = 1000


def fingerprint(text: str | None, shingle: int = 4, chunk: int = 1 << 15) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = (starts[:1], ends[-1:]) if n < shingle else (starts[: n - shingle + 1], ends[shingle - 1 :])
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), chunk):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[i : i + chunk].tolist(), ends[i : i + chunk].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, fp long")


def segment_masks(segments: int) -> list[int]:
    """Masks of the ring's segments, their widths as even as can be."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def linked_pairs(x: np.ndarray, y: np.ndarray, first: int, masks: list[int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and y of pairs that pass the chain from segment `first` and the full check."""
    m = len(masks)
    diff = x[:, None] ^ y[None, :]
    grown = masks[first] | masks[(first + 1) % m]
    i, j = np.nonzero(np.bitwise_count(diff & np.uint64(grown)) <= 2 * distance // m)  # so far the bucket tells, but for the bit left out
    diff = diff[i, j]
    for length in range(3, m + 1):
        grown |= masks[(first + length - 1) % m]
        keep = np.bitwise_count(diff & np.uint64(grown)) <= length * distance // m
        i, j, diff = i[keep], j[keep], diff[keep]
    return i, j


def near_groups(fps: DataFrame, stages: Stages, distance: int = 4, segments: int = 5, block: int = 2048) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint in fps (doc_id, fp). Fingerprints are the nodes; a component goes by its smallest doc_id."""
    if segments <= distance:
        raise ValueError("pigeonring buckets need more segments than differing bits")
    if 2 * distance // segments > 1:
        raise ValueError("buckets leave one bit out: the first two segments may differ in one")
    masks = segment_masks(segments)
    reps = stages.put(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    kept = [(i, masks[i] | masks[(i + 1) % segments] & ~(1 << p)) for i in range(segments) for p in range(64) if masks[(i + 1) % segments] >> p & 1]
    keys = F.array(*[F.struct(F.lit(i * STEP + n).alias("seg"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("value")) for n, (i, m) in enumerate(kept)])
    rows = reps.withColumn("key", F.explode(keys)).select("fp", "key.seg", "key.value")
    spread = dealt(rows, ["seg", "value"], "fp", block)

    def work(group: pa.Table) -> dict[str, np.ndarray] | None:
        node, own = (column_values(group.column(c).chunk(0)) for c in ("fp", "own"))
        fp = node.astype(np.int64).view(np.uint64)
        bi, bj, seg = (group.column(c)[0].as_py() for c in ("bi", "bj", "seg"))
        at, to = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        a, b = [], []
        for k in range(0, len(at), 256):
            i, j = linked_pairs(fp[at[k : k + 256]], fp[to], seg // STEP, masks, distance)
            a.append(at[k + i])
            b.append(to[j])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        if not (a != b).any():
            return None
        label = local_components(len(node), a, b)
        moved = np.flatnonzero(label != np.arange(len(node)))
        return {"a": node[moved], "b": node[label[moved]]}

    edges = stages.put(each_group(spread, ["seg", "value", "bi", "bj"], work, "a long, b long"), "edges")
    found = components(edges, stages)
    placed = stages.put(reps.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return placed.join(names.hint("merge"), "component").select("fp", "component_id")


def simhash_dedup(docs: DataFrame, distance: int = 4, segments: int = 5, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text)."""
    stages = Stages(docs.sparkSession, "simhash")
    fps = stages.put(fingerprints(docs, shingle), "fps")
    return fps.join(near_groups(fps.where("doc_id is not null"), stages, distance, segments).hint("merge"), "fp", "left")


def op10_simhash_dedup(spark, sf_dir) -> DataFrame:
    from gleaner.llm.common import table

    out = simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
